"""Three-way merge of two branches of a table whose texts are lists of lines with stable identifiers.

Base, L and R are full-outer joined by id, and each triple of rows is merged in an
Arrow-batched function. Columns, lines and the gaps after lines merge separately
and by value: a change on one side, or the same on both, is clean; other
changes are a conflict that takes R's state.

A table to merge has the id columns, further columns and

* ``line_ids`` array<long>: identifiers of the lines, in order,
* ``lines`` array<string>: their texts; null in a branch: as in the base.

A branch has dropped the base lines that it lacks. Lines unknown to the base were
inserted after the last base line before them. The base's lines keep its order.

Edge cases: null columns and null lines of the base are values like others; a row
without lines has an empty text; rows of one id are numbered in the order of their
contents and merged one by one by ``with_copies``; rows with a null id are
returned as the base has them (the branches' rows with a null id are not used);
empty tables give empty results; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = range(4)


def _state(ids: list, lines: list, base: dict) -> tuple[dict, dict]:
    """Texts of the base lines that a branch has, and the texts it inserts after each."""
    own, gaps, at = {}, {}, None
    for i, text in zip(ids, lines, strict=True):
        if i in base:
            own[i], at = base[i] if text is None else text, i
        else:
            gaps.setdefault(at, []).append(text)
    return own, gaps


def _row(base: tuple | None, left: tuple | None, right: tuple | None) -> tuple[tuple | None, list[int]]:
    """The merged (columns, lines) or None for no row, and the counts; rows are (columns, line_ids, lines)."""
    counts = [0, 0, 0, 0]
    if base is None:
        new = right or left
        counts[INSERT_INSERT if left and right and (left[0], left[2]) != (right[0], right[2]) else CLEAN] = 1
        return (new[0], new[2]), counts
    if left is None and right is None:
        counts[CLEAN] = 1
        return None, counts
    columns, ids, lines = base
    texts = dict(zip(ids, lines, strict=True))
    sides = [None if s is None else (s[0], *_state(s[1], s[2], texts)) for s in (left, right)]
    if left is None or right is None:
        kept = sides[0] or sides[1]
        if kept == (columns, texts, {}):
            counts[CLEAN] = 1
            return None, counts
        counts[EDIT_DELETE] = 1
        return (None if right is None else (right[0], _joined(ids, *kept[1:]))), counts
    (lcols, lown, lgaps), (rcols, rown, rgaps) = sides
    out = []
    for b, x, y in zip(columns, lcols, rcols, strict=True):
        if x != b or y != b:
            counts[CLEAN if x == b or y == b or x == y else EDIT_EDIT] += 1
        out.append(x if y == b else y)
    own, gaps = {}, {}
    for i in (None, *ids):
        if i is not None:
            b, x, y = (texts[i],), (lown[i],) if i in lown else None, (rown[i],) if i in rown else None
            if x != b or y != b:
                counts[CLEAN if x == b or y == b or x == y else EDIT_DELETE if x is None or y is None else EDIT_EDIT] += 1
            z = x if y == b else y
            if z is not None:
                own[i] = z[0]
        x, y = lgaps.get(i), rgaps.get(i)
        if x or y:
            counts[INSERT_INSERT if x and y and x != y else CLEAN] += 1
            gaps[i] = y or x
    return (tuple(out), _joined(ids, own, gaps)), counts


def _joined(ids: list, own: dict, gaps: dict) -> list:
    out = list(gaps.get(None, ()))
    for i in ids:
        if i in own:
            out.append(own[i])
        out += gaps.get(i, ())
    return out


def _side(batch: pa.RecordBatch, p: str, columns: list[str]) -> list[tuple | None]:
    """The batch's rows of one table; its lists are read as two flat columns."""
    flat = {}
    for name in ("line_ids", "lines"):
        a = batch.column(f"{p}_{name}")
        flat[name] = (a.offsets.to_pylist(), a.values.to_pylist())
    cols = list(zip(*(batch.column(f"{p}_{c}").to_pylist() for c in columns), strict=True)) if columns else [()] * len(batch)
    (ia, ids), (ta, texts) = flat["line_ids"], flat["lines"]
    here = batch.column(f"{p}_here").to_pylist()
    return [(cols[k], ids[ia[k] : ia[k + 1]], texts[ta[k] : ta[k + 1]]) if here[k] else None for k in range(len(batch))]


def merge_branches(base: DataFrame, left: DataFrame, right: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, columns, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) of every id that a table has.

    Columns are strings; text is the lines joined by breaks; all are null where the merge has no row.
    """
    named = ["line_ids", "lines"]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.col(ids[0]).isNotNull()).select(*ids, F.lit(True).alias(f"{p}_here"), *(F.col(c).alias(f"{p}_{c}") for c in [*columns, *named]))

    # The two branches, whose rows are short, meet first: the base's texts are shuffled once only.
    triples = side(left, "l").join(side(right, "r"), ids, "full_outer").join(side(base, "b"), ids, "full_outer")
    out = StructType([base.schema[c] for c in ids] + [StructField(c, StringType()) for c in [*columns, "text"]])
    for c in COUNTS:
        out = out.add(c, "long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = [], []
            for b, x, y in zip(*(_side(batch, p, columns) for p in "blr"), strict=True):
                row, n = _row(b, x, y)
                rows.append((*row[0], "\n".join("" if t is None else t for t in row[1])) if row else (None,) * (len(columns) + 1))
                counts.append(n)
            cols = [batch.column(c) for c in ids]
            cols += [pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns) + 1)]
            cols += [pa.array([n[k] for n in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    merged = triples.mapInArrow(merge, out)
    zero = F.lit(0).cast("long")
    unnamed = base.where(F.col(ids[0]).isNull()).select(*ids, *columns, F.array_join("lines", "\n", "").alias("text"), *(zero.alias(c) for c in COUNTS))
    return merged.unionByName(unnamed)


def with_copies(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``docs`` and ``copy``: 0, or the number of the row among the rows of its key where one is repeated."""
    counted = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    if not counted.where("_n > 1").take(1):
        return docs.withColumn("copy", F.lit(0).cast("long"))
    return docs.withColumn("copy", F.when(F.col(key).isNotNull(), F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).otherwise(0).cast("long"))


# The branches of a table of documents: each row, column and line is changed by a code of its name.


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, lang, source, line_ids, lines); nulls are empty, lines end at line breaks and are numbered from 0."""
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    full = with_copies(full, "doc_id", ["lang", "source", "text"])
    return full.withColumn("lines", F.split("text", "\n", -1)).select("doc_id", "copy", "lang", "source", F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1).alias("line_ids"), "lines")


def coded_branch(base: DataFrame, branch: str) -> DataFrame:
    """The base of ``document_lines`` as a branch has it, each change by the code crc32(branch:doc_id:name) modulo 7.

    Codes: 0 drops (a column: empties), 1 and 2 append ``!`` or ``?`` to a column or
    line, 3 and 4 insert a line ``!`` or ``?`` after a line, or for a row add
    another with the id -1 - doc_id and that text.
    """

    def code(name: Column) -> Column:
        return F.crc32(F.concat(F.lit(f"{branch}:"), F.col("doc_id").cast("string"), F.lit(":"), name)) % 7

    def edited(c: str) -> Column:
        k = F.col(f"_{c}")
        return F.when(k == 0, "").when(k == 1, F.concat(c, F.lit("!"))).when(k == 2, F.concat(c, F.lit("?"))).otherwise(F.col(c))

    def line(i: Column, k: Column, text: Column) -> Column:
        part = lambda n, t: F.struct(n.cast("long").alias("id"), t.cast("string").alias("text"))
        own, none = part(i, F.lit(None)), F.lit(None)
        after = lambda t: F.array(own, part(i + F.size("lines"), F.lit(t)))
        return (
            F.when(k == 0, F.array(F.lit(none).cast("struct<id:bigint,text:string>")))
            .when(k == 1, F.array(part(i, F.concat(text, F.lit("!")))))
            .when(k == 2, F.array(part(i, F.concat(text, F.lit("?")))))
            .when(k == 3, after("!"))
            .when(k == 4, after("?"))
            .otherwise(F.array(own))
        )

    coded = base.withColumns({f"_{c}": code(F.lit(c)) for c in ("row", "lang", "source")})
    parts = F.transform("line_ids", lambda i: F.struct(i.alias("i"), code(i.cast("string")).alias("k")))
    new = F.flatten(F.transform(parts, lambda p: line(p["i"], p["k"], F.get(F.col("lines"), p["i"].cast("int")))))
    coded = coded.withColumn("_new", F.when(F.col("_row") != 0, F.filter(new, lambda x: x.isNotNull())))
    row = lambda ident, copy, lang, source, ids, lines: F.struct(ident.alias("doc_id"), copy.alias("copy"), lang.alias("lang"), source.alias("source"), ids.alias("line_ids"), lines.alias("lines"))
    kept = row(F.col("doc_id"), F.col("copy"), edited("lang"), edited("source"), F.col("_new.id"), F.col("_new.text"))
    # The copy number of an added row is below 0: no row of the base has it, whatever its id.
    mark = F.when(F.col("_row") == 3, "!").otherwise("?")
    added = row(-1 - F.col("doc_id"), -1 - F.col("copy"), F.col("lang"), F.col("source"), F.array(F.lit(0).cast("long")), F.array(mark))
    rows = F.array_compact(F.array(F.when(F.col("_row") != 0, kept), F.when(F.col("_row").isin(3, 4), added)))
    return coded.where("doc_id is not null").select(F.inline(rows))


def merge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, lang, source, text, counts): branches L and R of ``docs`` (doc_id, text, lang, source) merged."""
    base = document_lines(docs)
    return merge_branches(base, coded_branch(base, "L"), coded_branch(base, "R"), ["doc_id", "copy"], ["lang", "source"])


_CRC = "xor(list_reduce(list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 7"


def oracle_sql() -> str:
    """The same result as DuckDB SQL, for tables whose doc_ids are distinct and no less than 0."""
    code = lambda b, name: _CRC.format(f"'{b}:' || doc_id || ':' || {name}")
    edit = lambda k, c: f"CASE {k} WHEN 0 THEN '' WHEN 1 THEN {c} || '!' WHEN 2 THEN {c} || '?' ELSE {c} END"
    ctes = [
        "tab AS MATERIALIZED (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) c FROM range(256) r(i)))",
        "d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') lang, coalesce(source, '') AS source FROM documents)",
        f"rw AS (SELECT d.*, {', '.join(code(b, q) + f' {b.lower()}_{n}' for b in 'LR' for n, q in (('row', chr(39) + 'row' + chr(39)), ('lang', chr(39) + 'lang' + chr(39)), ('source', chr(39) + 'source' + chr(39))))} FROM d, tab)",
        f"ed AS (SELECT *, {', '.join(edit(f'{b}_{c}', c) + f' {b}{c}' for b in 'lr' for c in ('lang', 'source'))} FROM rw)",
        f"ln AS (SELECT doc_id, i - 1 i, ls[i] x, {code('L', '(i - 1)')} l, {code('R', '(i - 1)')} r FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM d), unnest(range(1, len(ls) + 1)) u(i), tab)",
        "st AS (SELECT *, CASE l WHEN 0 THEN 'd' WHEN 1 THEN '!' WHEN 2 THEN '?' END le, CASE r WHEN 0 THEN 'd' WHEN 1 THEN '!' WHEN 2 THEN '?' END re, CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END lg, CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END rg FROM ln)",
        "mg AS (SELECT *, coalesce(re, le) e, coalesce(rg, lg) g FROM st)",
        "tx AS (SELECT doc_id, "
        + ", ".join(f"coalesce(string_agg(CASE WHEN {e} = 'd' THEN {g} ELSE x || coalesce({e}, '') || coalesce(chr(10) || {g}, '') END, chr(10) ORDER BY i) FILTER (NOT coalesce({e} = 'd' AND {g} IS NULL, false)), '') {n}" for e, g, n in (("e", "g", "tboth"), ("re", "rg", "tright")))
        + ", count(*) FILTER ((le IS NOT NULL OR re IS NOT NULL) AND (le IS NULL OR re IS NULL OR le = re)) + count(*) FILTER ((lg IS NOT NULL OR rg IS NOT NULL) AND (lg IS NULL OR rg IS NULL OR lg = rg)) ok, count(*) FILTER (le <> re AND 'd' NOT IN (le, re)) ee, count(*) FILTER (le <> re AND 'd' IN (le, re)) dd, count(*) FILTER (lg <> rg) ii, count(*) FILTER (le IS NOT NULL OR lg IS NOT NULL) nl, count(*) FILTER (re IS NOT NULL OR rg IS NOT NULL) nr FROM mg GROUP BY doc_id)",
        "al AS (SELECT ed.*, tboth, tright, ok, ee, dd, ii, nl > 0 OR llang <> lang OR lsource <> source lchg, nr > 0 OR rlang <> lang OR rsource <> source rchg FROM ed JOIN tx USING (doc_id))",
    ]
    one = lambda c: f"((l{c} <> {c} OR r{c} <> {c}) AND (l{c} = {c} OR r{c} = {c} OR l{c} = r{c}))::INT"
    two = lambda c: f"(l{c} <> {c} AND r{c} <> {c} AND l{c} <> r{c})::INT"
    take = lambda c: f"CASE WHEN r{c} <> {c} THEN r{c} ELSE l{c} END"
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT doc_id, {take('lang')} AS lang, {take('source')} AS source, sha256(tboth) text_sha256, (ok + {one('lang')} + {one('source')})::BIGINT n_clean, (ee + {two('lang')} + {two('source')})::BIGINT n_edit_edit, dd::BIGINT n_edit_delete, ii::BIGINT n_insert_insert FROM al WHERE l_row <> 0 AND r_row <> 0
UNION ALL SELECT doc_id, CASE WHEN k THEN rlang END, CASE WHEN k THEN rsource END, CASE WHEN k THEN sha256(tright) END, (NOT c)::BIGINT, 0, c::BIGINT, 0 FROM (SELECT *, l_row = 0 AND r_row <> 0 AND rchg k, (l_row = 0 AND r_row <> 0 AND rchg) OR (r_row = 0 AND l_row <> 0 AND lchg) c FROM al WHERE l_row = 0 OR r_row = 0)
UNION ALL SELECT -1 - doc_id, lang, source, sha256(CASE WHEN coalesce(nullif(r_row IN (3, 4), false), false) THEN CASE r_row WHEN 3 THEN '!' ELSE '?' END ELSE CASE l_row WHEN 3 THEN '!' ELSE '?' END END), (NOT z)::BIGINT, 0, 0, z::BIGINT FROM (SELECT *, l_row IN (3, 4) AND r_row IN (3, 4) AND l_row <> r_row z FROM al WHERE l_row IN (3, 4) OR r_row IN (3, 4))"""
    )
