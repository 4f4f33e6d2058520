import math
import zlib
from collections import Counter

import numpy as np
import pytest
from plain import words
from pyspark.sql import functions as F

from panelspark.llm import class_lm, queries


def brute(rows):
    tokens = lambda t: [*words(t), None]
    counts = Counter(x for _, t, training in rows if training for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return sorted(((i, training, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens(t))) for i, t, training in rows), key=repr)


def check(got, want):
    got = sorted(((r["doc_id"], r["training"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=lambda r: repr(r[:5]))
    want = sorted(want, key=lambda r: repr(r[:5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("frequent", [class_lm.FREQUENT, 20])
def test_counts_and_base_scores(edges, frequent):
    docs = edges.withColumn("training", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)))
    got = class_lm.score(docs, frequent=frequent).collect()
    check(got, brute([(r["doc_id"], r["text"], r["training"]) for r in docs.collect()]))
    assert all(r["score"] < 0 and abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in got)


def test_nothing_to_learn_from(edges, empty):
    got = class_lm.score(edges.withColumn("training", F.lit(False))).collect()
    assert all(r["train_tokens"] == r["n_known"] == r["base_score"] == 0 and r["score"] < 0 for r in got)
    assert class_lm.score(empty.withColumn("training", F.lit(True))).count() == 0


def test_probabilities_sum_to_one(given):
    model, counts = class_lm.fit(given.select("text"))
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass = np.zeros(class_lm.CLASSES)
    rows = counts.collect()
    words_, spellings = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["spelling"] for r in rows])
    unit, _ = model.vocabulary.look_up(class_lm.Tokens(words_, spellings, np.zeros(1, int)))
    np.add.at(mass, model.classes[unit], [r["n"] + 1 for r in rows])
    assert np.allclose((mass + 1) / 10**model.emission, 1)  # the words of a class and one unseen word


def test_exchange_gains_likelihood(given):
    training = given.select("text")
    vocabulary = class_lm.frequent_words(class_lm.word_counts(training))
    classes = np.arange(class_lm.UNITS) % class_lm.CLASSES

    def likelihood(classes):
        n = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
        np.add.at(n, classes, class_lm.neighbour_classes(training, vocabulary, classes)[:, : class_lm.CLASSES].astype(float))
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    neighbours = class_lm.neighbour_classes(training, vocabulary, classes)
    assert neighbours[:, : class_lm.CLASSES].sum() == neighbours[:, class_lm.CLASSES :].sum()
    assert likelihood(class_lm.exchange(classes, neighbours)) > likelihood(classes)


def test_query_beats_its_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op2_class_lm(spark, sf).collect()
    renamed = [r.asDict() | {"training": not r["held_out"]} for r in got]
    check(renamed, brute([(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in rows]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
