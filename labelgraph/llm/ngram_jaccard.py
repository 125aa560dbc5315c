"""N-gram Jaccard join by grouped prefixes.

Each text's set of distinct 5-word shingles is put in one global order:
shingles common in the corpus last, otherwise by hash. Two sets with Jaccard
>= t share a shingle among their first ``n - ceil(t * n) + 1`` ones, so only
those prefixes are joined. Texts with the same prefix and size form one group
with one list of postings. Groups are joined by shingle and band of sizes, group
pairs filtered by size, by the place of the shingle they share and by the overlap
of their prefixes, and only then expanded to their members (one per distinct
set), which are verified on the whole sets.

A large family of near copies would make all its pairs candidates. So group
pairs are first taken in a few rounds of stars (each group with one centre, each
member with one member of it), which is linear, and in the full join that
follows only members that the links so far leave in different components are
paired. No link between components is lost; links inside a component do not
change the result. Bands of sizes split the postings of a shingle that very many
texts share; adaptive execution splits what is left of such a join.

Edge cases: null, empty or blank text has no shingle, size 0 and its own
component; texts of 1-4 words have one shingle; identical sets (repeated rows
included) are one class and share a component; doc_id must be unique and not
null (a null one is returned as its own row with a null component); an empty
table gives an empty result; other columns are ignored; a long text is one set,
worked on whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .words import K, parts, shingle_sets

#: A shingle in at least so many texts is ordered last; at most so many are listed.
COMMON, MOST_COMMON = 32, 1 << 20
#: Rounds of stars; more save candidate pairs only.
ROUNDS = 3
#: Ids up to this count (16 MB) are sent to the scan instead of being joined.
IDS_SENT = 1_000_000
_FLUSH = 1 << 20
_BUCKET_VALUES = 1 << 20


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def common_shingles(docs: DataFrame, k: int = K, least: int = COMMON, most: int = MOST_COMMON) -> tuple[int, np.ndarray]:
    """(bits, sorted keys): shingles in ``least`` or more texts, by the leading ``bits`` of the hash.

    All texts count. Each task sends its shingles, counted, in one row per
    bucket of hashes; buckets grow in number with the input. If over ``most``
    keys qualify, the threshold rises until they do not.
    """
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = max(6, int(np.ceil(np.log2(max(1, size / 6 / _BUCKET_VALUES)))))
    bits = bucket_bits + 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        room = 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            cut = np.searchsorted(key, np.arange((1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(32))
            low, n = key.astype(np.uint32), n.astype(np.uint32)
            rows = [(b, x[m == 1].tobytes(), x[m > 1].tobytes(), m[m > 1].tobytes()) for b in range(1 << bucket_bits) if cut[b] < cut[b + 1] for x, m in [(low[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]])]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["bucket", "once", "more", "times"])

        for batch in parts(batches):
            for _, s in shingle_sets(batch.column(0), k):
                held.append(s)
                room += len(s)
                if room >= _FLUSH:
                    yield flush()
                    room = 0
        if room:
            yield flush()

    def reduce(rows: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, np.uint32) for x in rows["once"].to_pylist()]
        more = [np.frombuffer(x, np.uint32) for x in rows["more"].to_pylist()]
        times = [np.frombuffer(x, np.uint32) for x in rows["times"].to_pylist()]
        low = np.concatenate(once + more)
        n = np.concatenate([np.ones(sum(map(len, once)), np.int64), *times])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        head = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, head) if len(low) else n
        keep = total >= least
        key = (rows["bucket"][0].as_py() << 32) + low[head[keep]].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(total[keep], pa.int64())})

    sent = docs.select("text").mapInArrow(count, "bucket int, once binary, more binary, times binary")
    heavy = written(sent.groupBy("bucket").applyInArrow(reduce, "key long, n long"), "common")
    by_count = heavy.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    taken, step = 0, 1 << 30
    for row in by_count:  # a few hundred rows at any size
        if taken + row["count"] > most:
            break
        taken, step = taken + row["count"], row["step"]
    keys = heavy.where(F.floor(F.log2("n") * 8) >= step).select("key").toArrow()["key"].to_numpy()
    return bits, np.sort(keys.astype(np.uint64))


def signatures(docs: DataFrame, percent: int, k: int, bits: int, common) -> DataFrame:
    """(doc_id, n, fp, grp, prefix, sketch): set size, set fingerprint, group of prefix and size, set of shingles as bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in parts(batches):
            n, fp, grp, prefix, bitmaps = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                bitmaps.append(sketch(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                p = prefix_size(len(s), percent) if len(s) else 0
                if len(last) and len(s):
                    key = s >> np.uint64(64 - bits)
                    at = np.minimum(np.searchsorted(last, key), len(last) - 1)
                    late = last[at] == key
                    s = np.r_[s[~late], s[late]]
                head = s[:p].view(np.int64)  # in the global order
                prefix.append(head)
                grp.append(int.from_bytes(hashlib.blake2b(head.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            at = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            held = np.cumsum([0, *map(len, bitmaps)], dtype=np.int32)
            bits_of = pa.ListArray.from_arrays(pa.array(held), pa.array(np.concatenate(bitmaps) if bitmaps else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(grp, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), bits_of], names=["doc_id", "n", "fp", "grp", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, fp binary, grp long, prefix array<long>, sketch array<long>")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle's hash in a string of 8 to 16 bits a shingle, a power of two of 64-bit words."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(shingles)) / 8))))
    bits = np.zeros(64 * words, bool)
    bits[(shingles & np.uint64(64 * words - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def sketched(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches leave them similar enough.

    A bit that only one sketch has stands for at least one shingle that only that set has, so that
    what the bits leave in common is never less than what the sets have in common.
    """
    own = signed.where("doc_id is not null").select(F.col("doc_id").alias("id"), "n", "sketch")
    both = pairs.join(own.toDF("a", "na", "x"), "a").join(own.toDF("b", "nb", "y"), "b")
    # The longer of two bit strings is folded to the length of the other.
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseOR(q))
    both = both.select("a", "b", "na", "nb", F.when(F.size("x") == 2 * F.size("y"), half("x")).otherwise(F.col("x")).alias("x"), F.when(F.size("y") == 2 * F.size("x"), half("y")).otherwise(F.col("y")).alias("y"))
    alone = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    both = both.withColumn("most", F.least(F.col("na") - alone("x", "y"), F.col("nb") - alone("y", "x")))
    return both.where(f"size(x) <> size(y) or {100 + percent} * most >= {percent} * (na + nb)").select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the texts named in ``ids``; few ids go to the scan, many are joined."""
    few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
    asked = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [s.view(np.int64) for _, s in shingle_sets(batch.column(1), k)]
            at = np.cumsum([0, *map(len, got)], dtype=np.int32)
            flat = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "shingles"])

    return asked.select("doc_id", "text").mapInArrow(sets, "id long, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * |a & b| >= percent * |a | b|."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(sets_of(docs, ids, k), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(F.expr(f"100 * i >= {percent} * (size(x) + size(y) - i)")).select("a", "b")


def _band(n: str, percent: int) -> Column:
    """Sizes in bands; sets that can be similar are of one band or of neighbouring ones."""
    return F.floor(F.log(n) / float(np.log(100 / percent)))


def _star(at: DataFrame, of: DataFrame, states: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members: those of a group with the pivot of the group they share most with, or of their own."""
    weight = at.groupBy("token", "band", "lo").agg(F.sum("members").alias("c"), F.min_by(F.struct("gid", "hi"), F.xxhash64("pivot")).alias("m"))
    centre = weight.groupBy("token", "band").agg(F.max_by(F.struct(F.col("m.gid").alias("centre"), F.col("lo").alias("clo"), F.col("m.hi").alias("chi")), F.struct("c", F.negative("lo"))).alias("m"))
    seen = at.join(centre.select("token", "band", "m.*"), ["token", "band"]).where("gid <> centre and not (lo = hi and clo = chi and lo = clo)")
    # A star only saves pairs later, so it takes the likely links: half of the overlap that both prefixes must show.
    likely = seen.groupBy("gid", "n", "centre").agg(F.count("*").alias("c")).where(f"2 * c >= ceil({2 * percent} * n / {100 + percent}) - floor({percent} * n / 100)")
    best = likely.groupBy("gid").agg(F.max_by("centre", F.struct("c", F.negative("centre"))).alias("centre"))
    inside = states.where("lo < hi").select("gid", F.col("gid").alias("centre"))
    pivots = of.join(states.select(F.col("pivot").alias("id")), "id", "left_semi").select(F.col("gid").alias("centre"), F.col("id").alias("pivot"), F.col("comp").alias("pcomp"))
    both = of.join(best.unionByName(inside), "gid").join(pivots, "centre").where("comp <> pcomp")
    return both.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _rest(at: DataFrame, of: DataFrame, prefixes: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of members of two components that the filters of group pairs, then of whole sets leave."""
    # Of two sets the smaller one needs only the prefix for partners of its size or more.
    x = at.where(f"pos <= n - ceil({2 * percent} * n / {100 + percent})").withColumn("top", F.floor(100 * F.col("n") / percent))
    x = x.select("token", F.explode(F.sequence("band", _band("top", percent))).alias("band"), F.col("gid").alias("ga"), F.col("n").alias("na"), F.col("lo").alias("la"), F.col("hi").alias("ha"), (F.col("n") - F.col("pos")).alias("ra"))
    y = at.select("token", "band", F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), (F.col("n") - F.col("pos")).alias("rb"))
    # The first shingle that a pair shares leaves it enough others on both sides.
    close = f"(na < nb or na = nb and ga < gb) and not (la = ha and lb = hb and la = lb) and 100 * na >= {percent} * nb and {100 + percent} * least(ra, rb) >= {percent} * (na + nb)"
    pairs = written(x.join(y, ["token", "band"]).where(close).select("ga", "gb").distinct(), "near")
    # Past the prefix that ends first, at most its set's rest can still be shared.
    both = pairs.join(prefixes.toDF("ga", "na", "pa"), "ga").join(prefixes.toDF("gb", "nb", "pb"), "gb")
    rest = f"floor({percent} * greatest(na, nb) / 100)"
    pairs = both.where(f"{100 + percent} * (size(array_intersect(pa, pb)) + {rest}) >= {percent} * (na + nb)").select("ga", "gb")
    # Members of a group share all of its prefix: a group of several components is a pair with itself.
    own = of.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    a = of.select(F.col("gid").alias("ga"), F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = of.select(F.col("gid").alias("gb"), F.col("id").alias("b"), F.col("comp").alias("cb"))
    found = written(pairs.unionByName(own), "grouppairs").join(a, "ga").join(b, "gb").where("ca <> cb and (ga <> gb or a < b)")
    return sketched(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), signed, percent)


def ngram_jaccard_join(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, group_id) for every row of ``docs`` (doc_id, text).

    class_id: least doc_id with the same set; group_id: least doc_id with the
    same prefix and size; component_id: least doc_id reachable by links.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, keys = common_shingles(docs, k)
    signed = written(signatures(docs, percent, k, bits, spark.sparkContext.broadcast(keys)), "signed")

    sets = signed.where("n > 0 and doc_id is not null")
    classes = written(sets.groupBy("n", "fp").agg(F.min_by(F.struct("doc_id", "grp"), "doc_id").alias("m")).select("n", "fp", F.col("m.doc_id").alias("id"), F.col("m.grp").alias("grp")), "classes")
    groups = written(classes.groupBy("grp", "n").agg(F.min("id").alias("gid"), F.count("*").alias("members")), "groups")
    members = written(classes.join(groups, ["grp", "n"]).select("id", "gid", "n", "members"), "members")
    prefixes = written(signed.join(groups.select(F.col("gid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("gid"), "n", "prefix"), "prefixes")

    # Postings of groups, of the shingles that two of them share.
    heads = prefixes.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = heads.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    lists = written(heads.join(shared, "token", "left_semi"), "postings")

    links = comp = None
    for r in range(ROUNDS + 1):
        of = members.join(comp, "id", "left") if comp is not None else members.withColumn("component", F.lit(None).cast("long"))
        of = written(of.select("id", "gid", "n", F.coalesce("component", "id").alias("comp")), "states")
        # Of each group its components, first and last, its members, and this round's pivot among them.
        pick = F.xxhash64("id", F.lit(r)) if r else F.col("id")
        states = of.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.min_by("id", pick).alias("pivot"))
        at = lists.join(states, "gid")
        if r:
            mixed = at.groupBy("token").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("token")
            at = at.join(mixed, "token", "left_semi")
        at = at.withColumn("band", _band("n", percent))
        pairs = _star(at, of, states, percent) if r < ROUNDS else _rest(at, of, prefixes, signed.select("doc_id", "n", "sketch"), percent)
        new = verified(docs, written(pairs, "pairs"), percent, k)
        links = written(new if links is None else links.unionByName(new).distinct(), "links")
        comp = written(components(links), "component")

    # Back to all texts: each to its class, each class to its component.
    named = members.join(comp, "id", "left").select(F.col("id").alias("class_id"), F.col("gid").alias("group_id"), F.coalesce("component", "id").alias("component_id"))
    of = signed.select("doc_id", "n", "fp").join(classes.select("n", "fp", F.col("id").alias("class_id")), ["n", "fp"], "left")
    of = of.withColumn("class_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    out = of.join(named, "class_id", "left")
    pick = lambda c: F.coalesce(c, "class_id").alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), pick("component_id"), "class_id", pick("group_id"))
