"""License scan by diagonal voting, in DataFrame functions only.

All rolling ``K``-word hashes of every text are joined to their positions in a
fixed table of license texts and notices. Each hit votes for a diagonal, its
place in the text less its place in the template. Diagonals within ``MERGE`` of
each other merge, so that inserted, dropped or replaced words do not split a
match, and a merged span is verified: at least ``LEAST`` distinct places of the
template must vote, they must be ``DENSE`` of those between the first and the
last one, and the span may be ``STRETCH`` times as long as that part of the
template. Word runs that templates of two labels share do not vote. The score is
the largest share of a template's votes that one span has.

Short phrases (the base) are templates of two-word hashes that must hold all of
theirs on one diagonal, so they match exactly where their words stand
consecutively.

The template table is a constant of this module, hence the broadcast. Rows are
shuffled once, by text. Words are compared by 64-bit hashes.

Edge cases: null text is empty; texts without words have zeros, null places,
empty labels, score 0; repeated rows are returned each; an empty table gives an
empty result; labels found more than once are listed once, in order; other
columns are ignored; a long text is one row whose words are exploded in turn.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, MERGE, LEAST, DENSE, STRETCH = 5, 5, 8, 0.4, 1.5
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Public license texts, and the notices by which longer licenses are applied.
TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details "
        "you should have received a copy of the gnu lesser general public license along with this library",
        "lgpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mpl"),
    ("this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", "cc-by"),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        "unlicense",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
]


def _grams() -> list[tuple[list[str], int, int, int, int, bool, str]]:
    """(words, template, place, rank among and number of the voting hashes of the template, base, label); runs of words under two labels are left out."""
    rows, labels = [], {}
    for t, (text, label) in enumerate([*PHRASES, *TEMPLATES]):
        base = t < len(PHRASES)
        w, k = text.split(), 2 if base else K
        for i in range(len(w) - k + 1):
            rows.append((w[i : i + k], t, i, base, label))
            labels.setdefault((base, *w[i : i + k]), set()).add(label)
    rows = [r for r in rows if r[3] or len(labels[(False, *r[0])]) == 1]
    voting = Counter(r[1] for r in rows)
    rank = Counter()
    out = []
    for w, t, i, base, label in rows:
        out.append((w, t, i, rank[t], voting[t], base, label))
        rank[t] += 1
    return out


def _templates(spark: SparkSession) -> DataFrame:
    """(h, template, place, rank, size, base, label): the hash of every gram."""
    out = []
    for k, base in ((2, True), (K, False)):
        names = ", ".join(f"w{i}" for i in range(k))
        rows = ", ".join("(" + ", ".join(f"'{x}'" for x in w) + f", {t}, {i}, {v}, {n}, {str(b).lower()}, '{label}')" for w, t, i, v, n, b, label in _grams() if b == base)
        out.append(spark.sql(f"SELECT xxhash64({names}) AS h, template, place, rank, size, base, label FROM VALUES {rows} AS t({names}, template, place, rank, size, base, label)"))
    return out[0].unionByName(out[1])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row for each row of ``docs``.

    spans: array of (label, start, end, score), word offsets, end exclusive.
    """
    spark = docs.sparkSession
    w = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _OTHER), "")

    def hashes(w: Column) -> Column:
        """Struct (at, h) of all grams of both lengths; hash 0 at place -1 keeps texts without a hit in the join."""
        rolled = lambda k: F.transform(F.slice(w, 1, F.greatest(F.size(w) - k + 1, F.lit(0))), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))).alias("h")))
        return F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("h"))), rolled(2), rolled(K))

    packed = F.transform(F.array(w), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hashes(w).alias("hashes")))[0]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", packed.alias("p"))
    grams = texts.select("row", "doc_id", F.col("p.n_words").alias("n_words"), F.inline("p.hashes").alias("at", "h"))
    none = spark.sql("SELECT 0L AS h, -1 AS template, 0 AS place, 0 AS rank, 1 AS size, false AS base, '' AS label")
    hits = grams.join(F.broadcast(_templates(spark).unionByName(none)), "h").where("template >= 0 or at = -1")
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))

    keys = ["row", "doc_id", "n_words", "template", "size", "base", "label"]
    votes = hits.repartition("row").groupBy(*keys, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"), *(f(c).alias(f"{c}_{n}") for c in ("place", "rank") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > MERGE, F.lit(True))
    spans = votes.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*keys, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("place", "rank") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    spans = spans.withColumn("score", F.col("votes") / F.col("size").cast("double"))
    good = F.when(F.col("base"), F.col("votes") == F.col("size")).otherwise(F.expr(f"votes >= {LEAST} and votes >= {DENSE} * (rank_hi - rank_lo + 1) and hi - lo + {K} <= {STRETCH} * (place_hi - place_lo + {K})"))
    spans = spans.withColumn("ok", F.coalesce(good, F.lit(False)) & (F.col("template") >= 0))

    base = F.col("ok") & F.col("base")
    start = F.when(base, F.col("lo").cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.least(F.col("score"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct(F.col("lo").alias("start"), (F.col("hi") + F.when(F.col("base"), 2).otherwise(K)).alias("end"), "label", "score")))).alias("spans"),
    ).drop("row")


def oracle_sql() -> str:
    """DuckDB SQL of the contract's columns."""
    rows = ", ".join(f"({t}, {i}, {v}, {n}, {b}, '{label}', '{' '.join(w)}')" for w, t, i, v, n, b, label in _grams())
    gram = lambda k: " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
WITH g(template, place, rank, size, base, label, g) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w FROM documents),
k AS (SELECT doc_id, i - 1 pos, {gram(2)} g FROM d, unnest(range(1, len(w))) u(i) UNION ALL SELECT doc_id, i - 1, {gram(K)} FROM d, unnest(range(1, len(w) - {K - 2})) u(i)),
h AS (SELECT doc_id, template, label, base, size, place, rank, pos, pos - place diagonal FROM k JOIN g USING (g)),
v AS (SELECT doc_id, template, label, base, size, diagonal, list(DISTINCT place) places, min(pos) lo, max(pos) hi, min(place) pl, max(place) ph, min(rank) rl, max(rank) rh FROM h GROUP BY ALL),
s AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > {MERGE}, true) THEN 1 ELSE 0 END fresh FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) span FROM s),
m AS (SELECT doc_id, template, label, base, size, span, len(list_distinct(flatten(list(places)))) votes, min(lo) lo, max(hi) hi, min(pl) pl, max(ph) ph, min(rl) rl, max(rh) rh FROM c GROUP BY ALL),
ok AS (SELECT *, votes / size::DOUBLE score FROM m WHERE CASE WHEN base THEN votes = size ELSE votes >= {LEAST} AND votes >= {DENSE} * (rh - rl + 1) AND hi - lo + {K} <= {STRETCH} * (ph - pl + {K}) END),
r AS (SELECT doc_id, count(*) FILTER (base) n_base, min(lo) FILTER (base) first_word, max(lo) FILTER (base) last_word,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') labels, max(least(score, 1.0)) score FROM ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_base, 0)::BIGINT n_base, first_word::BIGINT first_word, last_word::BIGINT last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::DOUBLE score
FROM d LEFT JOIN r USING (doc_id)
"""
