"""Greedy one-to-one matching and overlap suppression.

Both accept items in a strict total order while what they need is free. Groups
(images) are small and many: each becomes one sorted array, which is folded in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(pairs: DataFrame, by_score: bool = True) -> DataFrame:
    """``pairs`` (image_id, g, p, score, ...) that are taken in order of score, then g, then p (or of g, p) while both ends are free."""
    keys = [F.negative(F.col("score").cast("double")).alias("_k"), "g", "p"] if by_score else ["g", "p"]
    rest = [c for c in pairs.columns if c not in ("image_id", "g", "p")]
    images = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*keys, F.struct(*rest).alias("_rest")))).alias("_all"))
    numbered = F.transform("_all", lambda x, i: F.struct(i.cast("long").alias("i"), x["g"].alias("g"), x["p"].alias("p")))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("g"), none.alias("p"), none.alias("i"))

    def step(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["g"], x["g"]) & ~F.array_contains(s["p"], x["p"])
        grown = F.struct(*(F.array_append(s[c], x[c]).alias(c) for c in ("g", "p", "i")))
        return F.when(free, grown).otherwise(s)

    taken = F.aggregate(numbered, start, step, lambda s: s["i"])
    out = images.withColumn("_taken", taken).select("image_id", F.explode(F.transform("_taken", lambda i: F.get(F.col("_all"), i.cast("int")))).alias("_x"))
    return out.select("image_id", "_x.g", "_x.p", "_x._rest.*").select(*pairs.columns)


def suppress(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(image_id, tok_idx): boxes by confidence, each kept if none kept before has intersection / union above ``overlap``."""
    fields = ("tok_idx", "x1", "y1", "x2", "y2")
    box = F.struct(F.negative("conf").alias("_k"), *fields)
    images = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("_all"))
    kind = "struct<" + ",".join(f"{f}:bigint" for f in fields) + ">"
    plain = F.transform("_all", lambda b: F.struct(*(b[f].cast("long").alias(f) for f in fields)))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    def clash(a: Column, b: Column) -> Column:
        w, h = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        return (w > 0) & (h > 0) & (w * h > overlap * (area(a) + area(b) - w * h))

    kept = F.aggregate(plain, F.array().cast(f"array<{kind}>"), lambda s, b: F.when(F.exists(s, lambda a: clash(a, b)), s).otherwise(F.array_append(s, b)))
    return images.select("image_id", F.explode(kept).alias("_b")).select("image_id", "_b.tok_idx")
