"""Quality rules of documents, and verdicts on whole hosts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import checkpointed, packed, small, tidy, unpacked

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_TEXT = np.uint64(0x9FB21C651E98DF25)


def _of_texts(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[begin[1:]] - sums[begin[:-1]]


def _spread(first: np.ndarray) -> np.ndarray:
    """Owner of each item, from the first item of each owner (and the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def text_features(texts: symbols.Texts) -> list[np.ndarray]:
    """FEATURES of each text of a block."""
    data, n = texts.data, len(texts.data)
    w = symbols.words(texts)
    opened = np.zeros(n + 1, np.int8)
    opened[w.start] += 1
    np.subtract.at(opened, w.end, 1)
    inside = np.cumsum(opened[:n], dtype=np.int8).astype(bool)
    rolling = symbols.byte_rolling(data)
    features = [np.diff(w.first), _of_texts(inside & ((data & 0xC0) != 0x80), texts.begin), _of_texts(SYMBOLS[data], texts.begin)]

    # lines: cut at \n and at the texts' ends; those with a word and of one text and content
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([texts.begin[:-1], breaks + 1])) if n else np.zeros(0, np.int64)
    start = start[start < n]
    end = np.minimum(np.append(start[1:], n), n)
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A), end - 1, end) if n else end
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has], end[has]
    owner = np.searchsorted(texts.begin, start, side="right") - 1
    lines = np.bincount(owner, minlength=len(texts))
    seen = np.unique(np.stack([owner.astype(np.uint64), rolling.of(start, end)], 1), axis=0)[:, 0].astype(np.int64) if len(owner) else owner
    features.append(lines - np.bincount(seen, minlength=len(texts)))

    # words that a window of three, found twice or more in the text, covers
    covered = np.zeros(len(w.start) + 1, np.int8)
    if len(w.start) >= 3:
        grams = symbols.Rolling(rolling.of(w.start, w.end)).grams(3)
        owner = _spread(w.first)
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        grams = symbols.mix(symbols.mix(grams[whole]) ^ (owner[whole].astype(np.uint64) * _TEXT))
        order = np.argsort(grams)
        ordered = grams[order]
        twin = np.zeros(len(ordered), bool)
        twin[1:] = ordered[1:] == ordered[:-1]
        twin[:-1] |= twin[1:]
        at = whole[order[twin]]
        for k in range(3):
            covered[at + k] = 1
    features.append(_of_texts(covered[:-1], w.first))
    return features


def measure(rows: DataFrame, text: str = "text") -> DataFrame:
    """FEATURES beside the other columns, which pass through; `text` itself is dropped."""
    keep = [c for c in rows.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in symbols.blocks(batches, text):
            found = text_features(symbols.as_texts(block.column(text)))
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *[pa.array(x.astype(np.int64)) for x in found]], names=[*keep, *FEATURES])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(tidy(work), f"{kinds}{', ' * bool(keep)}{', '.join(f'{f} long' for f in FEATURES)}")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, failed, rate): failures of each host, shrunk with a beta prior whose two numbers come from all hosts by moments.

    The prior's mean is the failure rate of all documents. Its strength is found from the spread of the hosts' rates beyond
    what chance gives; with no such spread the hosts all get the mean, with one host its own rate.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(base_failed(), 1).otherwise(0)).alias("failed"))
    hosts = checkpointed(hosts)
    k, n, failed, squares = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    mean = failed / n if n else 0.0
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    strength = float("inf")
    if k and k > 1 and 0 < mean < 1:
        # E[spread] = mean (1 - mean) (k - 1) + variance (n - squares / n - (k - 1)), from the beta-binomial's variance
        variance = (spread - mean * (1 - mean) * (k - 1)) / max(n - squares / n - (k - 1), 1e-9)
        strength = mean * (1 - mean) / variance - 1 if 0 < variance < mean * (1 - mean) else (float("inf") if variance <= 0 else 0.0)
    rate = F.lit(mean) if strength == float("inf") else (F.col("failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failed", rate.cast("double").alias("rate"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.8) -> DataFrame:
    """Every input row with FEATURES, `base_failed`, `host_rate` and `kept`.

    A document fails by itself with fewer than 50 words, or when repeated windows of three words cover over half of them. A
    host fails when its shrunken failure rate is above `limit`; then all its documents go. The limit stands high, so that
    clean documents of a mixed host stay. Failures are counted per host before any shuffle; verdicts come back by a join,
    broadcast only when the hosts are few. Null texts have no words and fail; null hosts are one host of their own; repeated
    rows count each; no rows give no rows. Input columns of our names are replaced.
    """
    rows = packed(docs, text=F.col(text), host=F.col(host).cast("string"))
    measured = measure(rows)
    rates = host_rates(measured)
    judged = measured.join(small(rates.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), rates.count()), F.col("host").eqNullSafe(F.col("_host")))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))
    return unpacked(judged, *FEATURES, "base_failed", "host_rate", "kept")
