"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: words, word characters, symbols, repeated lines and repeated 3-word
windows. Across texts: every line is normalised (lower-cased, white space
collapsed, trimmed) and hashed; distinct documents are counted by (host, line),
each row one document. Lines in more than
``max(least_docs, share * documents of the host)`` documents are removed, and a
document is rejected when over ``depleted`` of its words lie in removed lines.

Line counts combine before they are shuffled by (host, line), so neither a hot
host nor a hot line meets one task. Frequent lines go to the scan only while
there are at most ``SENT`` of them, else they are joined.

Edge cases: null or blank text has zeros and fails the base rules; a null host
is a host of its own; repeated rows are returned each and count each (with
``copies=False`` identical texts of a host count once); a line in just as many
documents as a limit stays; an empty table gives an empty result; other columns
are ignored; a long text is one row, its words and lines arrays of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

LEAST_DOCS, SHARE, DEPLETED = 20, 0.01, 0.5
SENT = 500_000
_SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def _covered(p: Column) -> Column:
    """How many words the 3-word windows at sorted places ``p`` cover."""
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array ``w``."""

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return _let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))

    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(places(h), _covered)))


def text_rules(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a non-null text."""

    def of(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return _let(words(text), of)


def normal_lines(text: Column) -> Column:
    """Array of (h, n): hash and words of each normalised line that has a word."""
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def line_quality(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED, copies: bool = True) -> DataFrame:
    """doc_id, the per-text rules, base_failed, n_frequent_words, kept: one row for each row of ``docs``."""
    # A row is known by its place in the written table, so that repeated and null ids stay apart.
    base = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    marked = base.select("doc_id", "host", F.xxhash64("text").alias("t"), text_rules(F.col("text")).alias("r"), normal_lines(F.col("text")).alias("lines"))
    marked = written(marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "t", "r.*", "lines"), "lines")

    counted = marked if copies else marked.join(marked.groupBy("host", "t").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")
    sizes = counted.groupBy("host").agg(F.count("*").alias("docs"))
    once = counted.select("host", F.explode(F.array_distinct("lines.h")).alias("h"))
    counts = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    frequent = written(counts.join(sizes, "host").where(F.col("n") > F.col("docs") * share).select("host", "h"), "frequent")
    few = frequent.limit(SENT + 1).count() <= SENT
    lines = marked.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    removed = lines.join(F.broadcast(frequent) if few else frequent, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("n").cast("long").alias("n_frequent_words"))

    out = marked.drop("lines", "host", "t").join(removed, "row", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_frequent_words") <= F.col("n_words") * depleted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


_SP = "[\\x20\\x09-\\x0D]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') host, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, host, list_filter(string_split_regex(t, '{_SP}'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM w, unnest(range(1, len(w) - 1)) u(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, trim(x) x FROM d, unnest(string_split(regexp_replace(lower(t), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10))) u(x)),
lw AS (SELECT doc_id, host, t, x, len(string_split(x, ' ')) n FROM ln WHERE x <> ''),
f AS (SELECT host, x FROM lw GROUP BY host, x HAVING count(DISTINCT doc_id) > {LEAST_DOCS} AND count(DISTINCT doc_id) > any_value((SELECT count(*) FROM d d2 WHERE d2.host = lw.host)) * {SHARE}),
r AS (SELECT doc_id, sum(n)::BIGINT n FROM lw SEMI JOIN f USING (host, x) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w)::BIGINT n_words, coalesce(length(array_to_string(w.w, '')), 0)::BIGINT word_chars,
 (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
 coalesce(cov.n, 0)::BIGINT n_repeat_words, coalesce(r.n, 0)::BIGINT n_frequent_words
 FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_frequent_words <= n_words * {DEPLETED} kept, n_frequent_words FROM m
"""
