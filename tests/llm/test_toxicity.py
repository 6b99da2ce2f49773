"""The learned lexicon: folding, exceptions, odd rows, and accuracy on texts held out of the learning."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from donorflow.llm import registry, toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def test_fold():
    assert toxicity.fold("You 1D10T!") == toxicity.fold("you idiot") == " you idiot "
    assert toxicity.fold("lоsеr") == toxicity.fold("l0s3r") == toxicity.fold("LO​SER") == " ioser "  # Cyrillic o and e; digits; invisible space
    assert toxicity.fold("$tupid, a$$et!! x") == " stupid asset x "
    assert toxicity.fold("ｓｔｕｐｉｄ") == " stupid "
    assert toxicity.fold("") == toxicity.fold(" \n") == "  "


def test_longest_entry_and_exceptions():
    m = toxicity.Lexicon({" tras": 1.0, " trash ": 2.0, " trashy": 0.0, toxicity.fold("trash can"): 0.0, " can": 5.0}).matcher()
    of = lambda text: toxicity._features(toxicity.fold(text), m)[:3]
    assert of("trash") == (1, 2.0, 2.0) and of("trasher") == (1, 1.0, 1.0) and of("trashy thing") == (0, 0, 0.0)
    assert of("a trash can") == (0, 0, 0.0) and of("trash can trash") == (1, 2.0, 2.0) and of("can trash can can") == (2, 10.0, 5.0)
    assert of("") == of("xtrash") == (0, 0, 0.0)


def made(seed, count):
    r = random.Random(seed)
    clean = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(count):
        toxic = r.random() < 0.15
        words = [r.choice(clean) for _ in range(r.randint(5, 400))]
        if toxic:
            for _ in range(r.randint(2, 4)):
                bad = r.choice(["zorg", "vile", "zorgling", "mukk"])
                words.insert(r.randrange(len(words)), r.choice([bad, bad.upper(), bad.replace("o", "0").replace("i", "1"), bad.replace("o", "о"), bad + "!!"]))
        elif r.random() < 0.1:
            words.insert(0, "zorgonian")  # begins like one, but is common in clean texts
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_accuracy_and_odd_rows(spark):
    docs, labels = made(1, 1500)
    odd = [(5000, None), (5001, ""), (5002, " \n"), (None, "zorg mukk vile"), (7, docs[7][1]), (5003, "word " * 100000 + "zorg mukk zorg")]
    df = spark.createDataFrame(docs + odd, DOCS).repartition(5).withColumns({c: F.lit("x") for c in ("score", "row", "id", "hits", "of", "toxic")})
    marks = spark.createDataFrame([*labels, (None, 1), (5001, None), (9, 1 - labels[9][1]), (9, labels[9][1])], LABELS)
    got = toxicity.judge(df, marks, learn_from=F.col("doc_id") % 3 != 0).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 3 == 0 and r.doc_id != 9]
    truth = dict(labels)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and by_id[5000].score == by_id[5001].score == by_id[5002].score and by_id[5000].predicted == 0
    assert by_id[5003].words == 100003 and by_id[5003].hits == 3
    assert {r.score for r in got if r.doc_id == 7} == {by_id[7].score}


@pytest.mark.parametrize("marks,score", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)])
def test_labels_of_one_kind(spark, marks, score):
    df = spark.createDataFrame([(1, "some text"), (2, None)], DOCS)
    assert {r.score for r in toxicity.judge(df, spark.createDataFrame(marks, LABELS)).collect()} == {score}
    assert toxicity.judge(df.limit(0), spark.createDataFrame(marks, LABELS)).collect() == []


def test_more_labels_than_the_bound(spark):
    docs, labels = made(2, 1200)
    got = toxicity.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), most=700).collect()
    assert sum(r.predicted == labels[r.doc_id][1] for r in got) >= 0.97 * len(got)


def test_counts(spark):
    df = spark.createDataFrame([("ab abc abc", 1), ("abcd", 0), (None, 0)], "text string, toxic int")
    assert {r.term: (r.pos, r.neg) for r in toxicity.term_counts(df).collect()} == {" abc": (1, 1), " abc ": (1, 0), " abcd": (0, 1), " abcd ": (0, 1)}


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = registry.QUERIES["op11_toxic_lexicon"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    hit = got[got.toxic == 1].predicted.mean()
    assert hit > 0.85 and got[got.toxic == 0].predicted.mean() < 0.01
    assert re.fullmatch("[01]+", "".join(map(str, got.predicted)))
