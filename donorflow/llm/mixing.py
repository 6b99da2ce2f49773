"""Mixing sources to target weights: whole copies at the floor of each source's rate, one more by a hash-seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.llm.common import WORD, checkpointed, in_order, packed, small, uniform, unpacked


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, int]:
    """Target of each source, and how many there are. sizes: (source, source_size), one row a source.

    Sources in code point order, null last, weigh `weights` in turn. Targets fill up like water: `share` of all sizes is
    dealt by weight, a source stops at `most` times its size, and the excess is dealt again among the rest. Each round
    brings only two sums to the driver; the capped sources only grow, so the rounds end.
    """
    ranked = in_order(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    total, n = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    level, held = 0.0, -1
    while n:
        over = (F.col("top") <= F.lit(level) * F.col("weight")) if held >= 0 else F.lit(False)
        left, capped, k = ranked.agg(
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if k == held or left == 0:
            break
        held, level = k, (share * total - capped) / left
    return ranked.select("source", "source_size", F.least(F.col("top"), F.lit(level) * F.col("weight")).alias("target")), n


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 8,
    size: Column | None = None, source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """Every input row with `size`, `source_size`, `target` and `copies`, the times the mix takes it.

    A document's rate is its source's target over the source's size; it is taken floor(rate) times, and once more if a
    number in [0, 1) from the seed and its key lies below the fraction. Null text or no words: size 0. A source without any
    word has target 0 and its rows are taken once. Null source: one source of its own. Rows with equal keys draw alike. No
    rows: no rows. Input columns of our names are replaced.
    """
    rows = packed(docs, source=F.col(source), key=F.col(key), size=size if size is not None else word_count())
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets, n = source_targets(sizes, weights, share, most)
    targets = targets.withColumnRenamed("source", "_source")
    joined = rows.join(small(targets, n), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    copies = F.floor(rate) + (uniform(seed, "key") < rate - F.floor(rate)).cast("long")
    return unpacked(joined.withColumn("copies", copies.cast("long")), "size", "source_size", "target", "copies")


def repeat_rows(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as `copies` says. Null or no copies: the row goes. Other columns pass through, whatever their names."""
    again = packed(mixed, times=F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int"))))
    return again.select("row.*")
