"""Toxicity by a weighted lexicon: matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

1. Folding: compatibility forms, lower case, letters that look Latin as Latin ones, digits and signs inside words as the
   letters they stand for, everything that is neither letter nor digit as one space. `l` folds like `i`, as a one may mean either.
2. The lexicon is learned from labelled texts: words and beginnings of words that occur in more toxic texts than chance
   gives, weighted by the logarithm of their odds. Longer words that begin like one of them, but are common in clean
   texts, are exceptions, and so are given phrases.
3. Each word counts by its longest entry. The sums of a text, also by its length, go into a logistic curve fitted to the
   labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.llm import symbols
from donorflow.llm.common import checkpointed, packed, tidy, uniform, unpacked

LABELS = 200_000
ENTRIES = 20_000
HELD_TERMS = 300_000
SHORTEST, LONGEST, WHOLE = 3, 6, 24

# Letters of other scripts that look like Latin ones, digits and signs used for letters, invisible characters.
LOOKALIKES = ("аеорсухіѕјһԁԛԝкмтвнгαερτυνικηχβωοıɑɡ", "aeopcyxisjhdqwkmtbhraeptuviknxbwoiag")
STAND_FOR = (b"01l|!3@4$5+789", b"oiiiieaassttbg")
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Phrases with a word of the kind that insults are made of, but harmless as a whole.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pathetic fallacy", "stupid question", "scum pond", "sore loser rule")

_FOREIGN = re.compile(f"[{LOOKALIKES[0]}{INVISIBLE}]")
_FOREIGN_TABLE = str.maketrans(*LOOKALIKES, INVISIBLE)
_OUTSIDE = re.compile(r"[^\w\x00-\x7f]+")
_UNUSUAL = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0130\u0132-\u024f]")  # no common letter: only then the slower steps run
_SIGNS = b"|!@$+"
_SIGN = re.compile(rb"(?<![|!@$+])[|!@$+]++(?![0-9a-z\x80-\xff])")
_PLAIN = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_TABLE = bytes(dict(zip(*STAND_FOR, strict=True)).get(c, _PLAIN[c]) for c in range(256))
FEATURES = ["hits", "total", "best", "words"]


def fold(text: str) -> str:
    """Words of a text in their folded form, each between spaces."""
    if text.isascii():
        text = text.lower()
    else:
        text = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
        text = text.lower()
        if _UNUSUAL.search(text):
            text = text.translate(_FOREIGN_TABLE) if _FOREIGN.search(text) else text
            text = _OUTSIDE.sub(" ", text)
    data = text.encode()
    if len(data.translate(None, _SIGNS)) < len(data):
        data = _SIGN.sub(b" ", data)
    return f" {b' '.join(data.translate(_TABLE).split()).decode()} "


def beginnings(word: str) -> list[str]:
    """A word's entries: its beginnings of 3 to 6 letters behind a space, and the whole word between spaces."""
    out = [f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1)]
    return [*out, f" {word} "] if SHORTEST <= len(word) <= WHOLE else out


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, pos, neg): in how many toxic and clean texts a term occurs. labelled: (text, toxic). Counted in the task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = (Counter(), Counter()), {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                terms: set[str] = set()
                for word in set(fold(text.as_py() or "").split()):
                    if word not in known:
                        if len(known) > HELD_TERMS:
                            known.clear()
                        known[word] = beginnings(word)
                    terms.update(known[word])
                counts[toxic].update(terms)
                if sum(map(len, counts)) > HELD_TERMS:
                    yield rows(counts)
                    counts = (Counter(), Counter())
        if any(counts):
            yield rows(counts)

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        clean, toxic = counts
        terms = list(clean.keys() | toxic.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    return labelled.select("text", "toxic").mapInArrow(tidy(work), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Lexicon:
    """Weights of folded entries; exceptions have weight 0. Entries begin with a space, whole words and phrases end with one."""

    weights: dict[str, float] = field(default_factory=dict)

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight, term.count(" ") > 2))
        found.make_automaton()
        return found


def likelihood_ratio(pos: Column, neg: Column, toxic: int, clean: int) -> Column:
    """Twice the gain in log likelihood from a term's own rate over the rate of all texts."""
    share = toxic / (toxic + clean)
    part = lambda n, p: F.when(n > 0, n * F.ln(n / ((pos + neg) * F.lit(p)))).otherwise(0.0)
    return 2 * (part(pos, share) + part(neg, 1 - share))


def learn(labelled: DataFrame, support: int = 3, odds: float = 3.0, entries: int = ENTRIES, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from (text, toxic) rows: at most `entries` terms and as many exceptions, the surest ones.

    A term needs `support` toxic texts, `odds` times the rate of clean ones, and a likelihood ratio that chance alone gives
    to fewer than one of all terms. The bound is the model's size; all texts count.
    """
    counts = checkpointed(term_counts(labelled))
    toxic, clean = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    phrases = {fold(p): 0.0 for p in exceptions}
    if not toxic or not clean:
        return Lexicon(phrases)
    supported = counts.filter(F.col("pos") >= support)
    tested = supported.count()
    weight = F.ln((F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (clean + 1)))
    surety = likelihood_ratio(F.col("pos"), F.col("neg"), int(toxic), int(clean))
    sure = supported.select("term", weight.alias("weight"), surety.alias("surety")).filter((F.col("weight") >= float(np.log(odds))) & (F.col("surety") >= 2 * float(np.log(tested + 1))))
    terms = {r.term: r.weight for r in sure.orderBy(F.desc("surety"), "term").limit(entries).collect()}
    stems = F.explode(F.transform(F.sequence(F.lit(SHORTEST + 1), F.length("term") - 1), lambda k: F.substr("term", F.lit(1), k)))
    held = counts.sparkSession.createDataFrame([(t,) for t in terms], "stem string")
    common = counts.filter((F.col("neg") >= 3 * support) & (F.length("term") > SHORTEST + 1)).select("term", "neg", weight.alias("weight"), stems.alias("stem"))
    common = common.filter(F.col("weight") < float(np.log(odds)) / 2).join(F.broadcast(held), "stem").select("term", "neg").distinct()  # at most `entries` rows
    plain = {r.term: 0.0 for r in common.orderBy(F.desc("neg"), "term").limit(entries).collect()}
    return Lexicon({**plain, **terms, **phrases})


def measure(rows: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """FEATURES beside the other columns: words with a weight, the sum of their weights, the greatest, and all words."""
    keep = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value.matcher()
        for block in symbols.blocks(batches, text, 1 << 20):
            found = [_features(fold(x.as_py() or ""), matcher) for x in block.column(text)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *columns], names=[*keep, *FEATURES])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.mapInArrow(tidy(work), f"{kinds}hits long, total double, best double, words long")


def _features(folded: str, matcher) -> tuple[int, float, float, int]:
    longest: dict[int, tuple[int, float]] = {}  # by the start of the word, in order
    covered = -1
    for end, (size, weight, phrase) in matcher.iter(folded) if len(matcher) else ():
        start = end - size + 1
        if phrase:
            covered = end
            for at in reversed(longest):
                if at < start:
                    break
                longest[at] = (len(folded), 0.0)
        elif start >= covered and size > longest.get(start, (0, 0.0))[0]:
            longest[start] = (size, weight)
    weights = [w for _, w in longest.values() if w]
    return len(weights), sum(weights), max(weights, default=0.0), folded.count(" ") - 1 if folded.strip() else 0


def inputs() -> list[Column]:
    """What the logistic curve sees: the greatest weight, the sum alone, by the root of the length and by the length, and the hits."""
    n = F.col("words") + 1.0
    return [F.col("best"), F.log1p("total"), F.col("total") / F.sqrt(n), F.col("total") / n, F.log1p(F.col("hits").cast("double"))]


def fit(features: DataFrame) -> list[float]:
    """Intercept and coefficients for inputs(), from rows with FEATURES and `toxic`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = checkpointed(features.select(array_to_vector(F.array(*inputs())).alias("features"), F.col("toxic").cast("double").alias("label")))
    model = LogisticRegression(maxIter=100, regParam=1e-3, tol=1e-8).fit(ready)
    return [float(model.intercept), *map(float, model.coefficients)]


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", learn_from: Column | None = None, most: int = LABELS, **settings) -> DataFrame:
    """Every input row with FEATURES, `score` from 0 to 1 and `predicted` (1 from 0.5 on), learned from `labels` (key, toxic).

    `learn_from` is a condition on the key; rows elsewhere are never learned from. At most about `most` labelled documents
    take part, chosen by a hash of the key where there are more; they are the only rows that meet a table of this bounded
    size. The lexicon is bounded as well. Labelled texts are read twice more, and no text is shuffled or written; scores see
    the text alone.

    Null and empty texts have no words and get the curve's value for none. Several labels of one key count as toxic if one
    is; null labels and null keys are left out, documents without label only get scores. Repeated rows count each. Without
    toxic labels every score is 0, with toxic labels only it is 1; no rows give no rows. Input columns of our names are
    replaced.
    """
    rows = packed(docs, text=F.col(text), id=F.col(key))
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).select(F.col(key).alias("of"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.filter(learn_from) if learn_from is not None else known
    known = checkpointed(known.groupBy("of").agg(F.max("toxic").alias("toxic")))
    count, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if count > most:
        known = known.filter(uniform(11, "of") < most / count)
    known = F.broadcast(known)  # about `most` narrow rows at most
    labelled = rows.select("id", "text").join(known, F.col("id") == F.col("of")).select("text", "toxic")
    lexicon = learn(labelled, **settings)
    if 0 < toxic < count:
        curve = fit(measure(labelled, lexicon))
        score = F.lit(curve[0])
        for c, x in zip(curve[1:], inputs(), strict=True):
            score = score + F.lit(c) * x
        score = 1 / (1 + F.exp(-score))
    else:
        score = F.lit(1.0 if toxic else 0.0)
    judged = measure(rows, lexicon).withColumn("score", score.cast("double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return unpacked(judged, *FEATURES, "score", "predicted")
