"""Bootstrap replicates as vectors: no row for a (score, replicate) pair.

A resample gives every distinct score a Poisson weight with the mean of its count. The weights
of all replicates of one score are one vector, which a task makes from the score's place in
the order with integer arithmetic, so that they need not be stored and any engine can make
them again. Scores lie in range chunks: one pass sums the vectors of each chunk, sums of
earlier chunks are carried forward, and a second pass makes the weights again and adds up the
areas. Vectors are made for some hundred scores at a time, whatever the size of a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorflow.operators.ordered import in_chunks
from donorflow.session import reliable_checkpoint

CELLS = 400_000  # weights made at a time
CHUNK = 50_000
TAIL = 12  # standard deviations on each side; what lies beyond has a chance below 1e-30
_WORD = np.uint64(0xFFFFFFFF)
# Multipliers of a mixing function of 32-bit words, and the golden ratio's
_FIRST, _SECOND, _GOLDEN, _OTHER = 0x7FEB352D, 0x846CA68B, 0x9E3779B9, 0x3C6EF372


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words (held in 64 bits) that spreads every bit."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(_FIRST)) & _WORD
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(_SECOND)) & _WORD
    return x ^ (x >> np.uint64(16))


def uniforms(place: np.ndarray, salt: int, stream: int, replicates: int) -> np.ndarray:
    """A number in (0, 1) for each place and replicate, from two words of the place, the salt and the stream."""
    place = place.astype(np.uint64)
    low, high = place & _WORD, place >> np.uint64(32)
    a = mix(np.uint64((salt + stream * _GOLDEN) & 0xFFFFFFFF))
    one = mix(mix(low ^ a) ^ high)
    two = mix(mix((low + a + np.uint64(_OTHER)) & _WORD) ^ high)
    step = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) & _WORD
    word = mix(one[:, None] ^ mix((two[:, None] + step) & _WORD))
    return (word.astype(np.float64) + 0.5) / 4294967296.0


def _cumulative(least: int, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """Chances of least, least + 1, ... summed, from the logarithms of each one's ratio to the one before."""
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return least, chance / chance[-1]


@lru_cache(maxsize=2048)
def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """First value and cumulative chances of a Poisson number, as far as TAIL standard deviations."""
    reach = math.ceil(TAIL * math.sqrt(mean)) + 20
    least = max(0, mean - reach)
    return _cumulative(least, np.log(mean / np.arange(least + 1, mean + reach + 1)))


def binomial_table(n: int, k: int) -> tuple[int, np.ndarray]:
    """The same for how often one of k special rows comes up in n draws from n rows."""
    reach = math.ceil(TAIL * math.sqrt(k * (n - k) / n)) + 20
    least, most = max(0, k - reach), min(n, k + reach)
    at = np.arange(least + 1, most + 1)
    return _cumulative(least, np.log((n - at + 1) / at * (k / (n - k))))


def weights(counts: np.ndarray, place: np.ndarray, salt: int, stream: int, replicates: int) -> np.ndarray:
    """Poisson weights with the counts as means: one row a score, one column a replicate."""
    out = np.zeros((len(counts), replicates))
    u = uniforms(place, salt, stream, replicates)
    for c in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == c)
        least, chance = poisson_table(int(c))
        out[rows] = least + np.searchsorted(chance, u[rows], side="right")
    return out


def salt_of(seed: int, by: Sequence[str]) -> Column:
    """32 bits of an MD5 of the seed and the group."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _pieces(chunk: pd.DataFrame, replicates: int):
    """(rows, weights of positives, weights of negatives) of a chunk, some rows at a time, in order."""
    chunk = chunk.sort_values("__step")
    step = max(1, CELLS // replicates)
    for at in range(0, len(chunk), step):
        part = chunk.iloc[at : at + step]
        place = part["__before"].to_numpy() + np.arange(at, at + len(part))
        salt = int(part["__salt"].iloc[0])
        yield part, *[weights(part[c].to_numpy(), place, salt, stream, replicates) for stream, c in enumerate(("pos", "neg"), 1)]


def area_pieces(pos: np.ndarray, neg: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """What each score adds to the area under the precision-recall curve, times the positives.

    pos, neg: weights at the score; tp, fp: sums up to it, the score included. Between two
    points false positives grow linearly with true ones; the integral has a closed form.
    """
    true0, start = tp - pos, tp - pos + fp - neg
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = 1 + neg / pos
        straight = pos / slope
        bend = (true0 - start / slope) / slope * np.log((start + slope * pos) / start)
    return np.where(pos <= 0, 0.0, np.where(start <= 0, straight, straight + bend))


def resampled_areas(
    counts: DataFrame, replicates: int, seed: int, by: Sequence[str], stratified: bool, cuts: Mapping[str, Column] | None = None,
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """(by, replicate, P, N, AUPR, AUROC) of each replicate, and for each cut (name, condition) its ``tp_`` and ``fp_`` sums.

    ``counts`` has threshold, pos and neg, one row a distinct score of a group; a score's weights depend on the seed, the
    group and its place from the largest score down. With ``stratified`` the weights of each class are scaled back to the
    class size, as a resample inside each class keeps it. Replicates without one of the classes have NULL areas.
    """
    cuts = dict(cuts or {})
    named = list(cuts)
    keys = list(by) or ["__all"]
    frame = counts if by else counts.withColumn("__all", F.lit(0))
    frame = frame.select(*keys, "pos", "neg", (-F.col("threshold")).alias("__down"), *[c.cast("int").alias(f"__cut_{n}") for n, c in cuts.items()])
    cells = in_chunks(frame, "__down", keys, chunk_rows)
    sizes = cells.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "__chunk", before.alias("__before"), F.sum("__pos").over(group).alias("__allpos"), F.sum("__neg").over(group).alias("__allneg"), salt_of(seed, by).alias("__salt"))
    cells = reliable_checkpoint(cells.join(sizes, [*keys, "__chunk"]))
    types = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    sums = ["pos", "neg", *[f"{side}_{n}" for n in cuts for side in ("tp", "fp")]]

    def summed(chunk: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((len(sums), replicates))
        for part, pos, neg in _pieces(chunk, replicates):
            total[0] += pos.sum(0)
            total[1] += neg.sum(0)
            for i, n in enumerate(named):
                inside = part[f"__cut_{n}"].to_numpy(dtype=bool)
                total[2 + 2 * i] += pos[inside].sum(0)
                total[3 + 2 * i] += neg[inside].sum(0)
        head = chunk.iloc[0]
        return pd.DataFrame([[*[head[k] for k in keys], head["__chunk"], *total]], columns=[*keys, "__chunk", *sums])

    vectors = cells.groupBy(*keys, "__chunk").applyInPandas(summed, f"{types}, __chunk long, {', '.join(f'{s} array<double>' for s in sums)}")
    long = vectors.select(*keys, "__chunk", F.posexplode(F.arrays_zip(*sums)).alias("__i", "v")).select(*keys, "__chunk", "__i", "v.*")
    whole = Window.partitionBy(*keys, "__i")
    earlier = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = reliable_checkpoint(long.withColumns({
        "__tp": F.coalesce(F.sum("pos").over(earlier), F.lit(0.0)), "__fp": F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)),
        "P": F.sum("pos").over(whole), "N": F.sum("neg").over(whole),
    }))
    starts = long.groupBy(*keys, "__chunk").agg(F.sort_array(F.collect_list(F.struct("__i", "__tp", "__fp", "P", "N"))).alias("v"))
    starts = starts.select(*keys, "__chunk", *[F.col(f"v.{n}").alias(n) for n in ("__tp", "__fp", "P", "N")])

    def areas(chunk: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        head = start.iloc[0]
        tp, fp, every, none = (np.array(head[n], dtype=float) for n in ("__tp", "__fp", "P", "N"))
        with np.errstate(divide="ignore", invalid="ignore"):
            up = chunk["__allpos"].iloc[0] / every if stratified else np.ones(replicates)
            un = chunk["__allneg"].iloc[0] / none if stratified else np.ones(replicates)
            pr, roc = np.zeros(replicates), np.zeros(replicates)
            for _, pos, neg in _pieces(chunk, replicates):
                tps, fps = tp + np.cumsum(pos, 0), fp + np.cumsum(neg, 0)
                pr += area_pieces(pos * up, neg * un, tps * up, fps * un).sum(0)
                roc += (pos * up * ((none - fps) * un + 0.5 * neg * un)).sum(0)
                tp, fp = tps[-1], fps[-1]
            pr, roc = pr / (every * up), roc / (every * up * none * un)
        return pd.DataFrame([[*[chunk[k].iloc[0] for k in keys], pr, roc]], columns=[*keys, "pr", "roc"])

    parts = cells.groupBy(*keys, "__chunk").cogroup(starts.groupBy(*keys, "__chunk")).applyInPandas(areas, f"{types}, pr array<double>, roc array<double>")
    parts = parts.select(*keys, F.posexplode(F.arrays_zip("pr", "roc")).alias("__i", "v"))
    found = parts.groupBy(*keys, "__i").agg(F.sum("v.pr").alias("AUPR"), F.sum("v.roc").alias("AUROC"))
    totals = long.groupBy(*keys, "__i").agg(F.max("P").alias("P"), F.max("N").alias("N"), *[F.sum(s).alias(s) for s in sums[2:]])
    joined = totals.join(found, [*keys, "__i"]).withColumn("replicate", F.col("__i") + 1)
    defined = (F.col("P") > 0) & (F.col("N") > 0)
    return joined.select(*by, "replicate", "P", "N", *sums[2:], *[F.when(defined, F.col(a)).alias(a) for a in ("AUPR", "AUROC")])


def resampled_cells(cells: DataFrame, pairs: Sequence[tuple[str, str]], replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Bootstrap counts of pairs of cells whose sum a resample keeps: one binomial number a pair and replicate.

    ``cells`` has one row a group; replicate r of pair i uses place i of the group's numbers. One row per (by, replicate).
    """
    names = [c for p in pairs for c in p]
    frame = cells.select(*by, *[F.col(n).cast("long").alias(n) for n in names], salt_of(seed, by).alias("__salt"))
    schema = ", ".join([*[f"`{b}` {cells.schema[b].dataType.simpleString()}" for b in by], "replicate int", *[f"{n} double" for n in names]])

    def draw(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                out = {b: row[b] for b in by} | {"replicate": np.arange(1, replicates + 1, dtype=np.int32)}
                for i, (a, b) in enumerate(pairs):
                    k, n = int(row[a]), int(row[a] + row[b])
                    drawn = np.full(replicates, float(k))
                    if 0 < k < n:
                        least, chance = binomial_table(n, k)
                        drawn = least + np.searchsorted(chance, uniforms(np.array([i]), int(row["__salt"]), 0, replicates)[0], side="right").astype(float)
                    out |= {a: drawn, b: n - drawn}
                yield pd.DataFrame(out)

    return frame.mapInPandas(draw, schema)
