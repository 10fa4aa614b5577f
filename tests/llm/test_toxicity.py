import random
import zlib

from asofspark.llm import toxicity


def frames(spark, n=900):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("aeinrst") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randrange(20, 80))
        toxic = int(rnd.random() < 0.15)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Vilebad,", "horridman", "NASTYONE."]))
        docs.append((i, " ".join(words), "x", 1.0))
        labels.append((i, 1, toxic))
    docs += [(9001, None, "x", 1.0), (9002, "", "x", 1.0), (None, "horridman " * 40_000, "x", 1.0), (3, docs[3][1], "x", 1.0), (9003, "?! ...", "x", 1.0)]
    labels += [(None, 1, 1), (9002, 1, None), (5, 1, 0), (77_777, 0, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {d: t for d, _, t in labels[:n]},
    )


def test_held_out_accuracy_and_contract(spark):
    docs, labels, truth = frames(spark)
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert wrong <= 0.05 * len(held)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 0 and kept.filter("text is null or text = ''").count() == 2


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = frames(spark, 300)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_sample_is_bounded(spark):
    docs, labels, _ = frames(spark)
    assert 20 < toxicity.training_rows(docs, labels, 100).count() < 180


def test_empty_tables(spark):
    docs, labels, _ = frames(spark, 5)
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_fit_equals_a_plain_loop_over_coordinates():
    """FTRL-proximal as published, one coordinate after the other."""
    import math
    import random

    import numpy as np
    import pytest

    rnd = random.Random(3)
    rows = [(np.unique([rnd.randrange(30) for _ in range(8)]), float(rnd.random() < 0.4)) for _ in range(200)]
    bias = 1 << toxicity.HASH_BITS
    z, n = {}, {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == bias else toxicity.L1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for found, label in rows:
            at = [*found.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    at, w = toxicity.fit_ftrl(rows)
    expected = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(expected, rel=1e-9)
    assert len(expected) > 5
