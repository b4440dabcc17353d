import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import labelled, quality, svm, toxicity

from .helpers import frame


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 + rng.normal(0, 0.5, 200) > 0, 1.0, -1.0)
    every = np.arange(5)
    w = svm.dual_coordinate_descent([(every, r) for r in x], y, 5, np.full(200, 0.5), rounds=400)
    loss = lambda w: w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w[:5] + w[5])).sum()
    best = loss(w)
    for _ in range(300):
        assert best <= loss(w + rng.normal(0, 0.02, 6)) + 1e-3


def test_platt_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 2, 20_000)
    positive = rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))
    a, b = svm.platt(m, positive)
    assert abs(a - 1.5) < 0.1 and abs(b + 0.5) < 0.1
    assert svm.platt(np.zeros(0), np.zeros(0, bool)) == (1.0, 0.0)
    assert svm.platt(np.ones(3), np.ones(3, bool))[1] > 0


def plain_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_all_subsequences():
    s = ["banana", "abc", "xyz", "aaaa", "idiot"]
    t = ["bandana", "axbxc", "abc", "aaa", "idxiot"]
    assert np.allclose(toxicity.kernel(toxicity.coded(s), toxicity.coded(t)), [plain_kernel(a, b) for a, b in zip(s, t, strict=True)], rtol=1e-4)


def test_similarities_tolerate_gaps():
    similar = toxicity.Similarity(["villain"])
    of = lambda text: max([0.0, *(float(k.max()) for k in similar.sentences([text])[0])])
    assert of("a villain!") > 0.99
    for text in ("v i l l a i n there", "vil-lain", "v.i.l.l.a.i.n", "the villlain", "vixllain"):
        assert of(text) > 0.5, text
    assert of("the cat sat on the mat") == 0 and of("") == 0
    assert of("bcdefghjkm" * 4 + "villain" + "opqrstuwxz" * 4) > 0.35


def labelled_docs(word, n=400):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, 30))
        y = i % 3 == 0
        if y:
            w[int(rng.integers(30))] = word
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return rows, labels


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_accuracy(spark, which):
    sf = "/root/testdata/sf0.1"
    run = toxicity.toxicity if which == "toxic" else quality.quality
    got = run(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", F.col(which).alias("y"), "score").collect()
    assert len(both) > 500
    assert sum(r.predicted == r.y for r in both) / len(both) > 0.97
    assert all(0 <= r.score <= 1 for r in both)


def test_defined_results_of_odd_rows(spark):
    rows, labels = labelled_docs("villain")
    rows += [(None, "villain"), (1000, None), (1001, ""), (1002, "a villain"), (1002, "a villain"), (1003, "x " * 50_000)]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), marks).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % labelled.FOLDS == labelled.HELD)
        assert r.predicted == int(r.score >= 0.3)
    assert by[None][0].predicted == 1 and [r.predicted for r in by[1002]] == [1, 1]
    assert by[1000][0].score == by[1001][0].score < 0.3 and by[1003][0].predicted == 0
    assert toxicity.toxicity(frame(spark, []), marks).collect() == []


def test_defined_results_of_odd_rows_in_quality(spark):
    rows, labels = labelled_docs("excellent")
    rows += [(None, "excellent"), (1000, None), (1001, ""), (1002, "an excellent one"), (1002, "an excellent one"), (1003, "x " * 50_000), (1004, "\x00 \u3000é")]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    got = quality.quality(frame(spark, rows), marks).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % labelled.FOLDS == labelled.HELD)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert by[1000][0].score == by[1001][0].score and by[1002][0].score == by[1002][1].score
    assert quality.quality(frame(spark, []), marks).collect() == []
    kept = quality.keep_quality(frame(spark, rows), marks)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.predicted for r in got)


def test_quality_labels_never_reach_a_held_out_row(spark):
    rows, labels = labelled_docs("excellent", 200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in quality.quality(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_log_count_ratios_by_counting():
    rows, labels = labelled_docs("excellent", 90)
    features = quality.Features()
    found, y = [features(t) for _, t in rows], np.array([v for _, v in labels]) == 1
    n = quality.WORDS + quality.FORMS
    got = quality.log_count_ratios(found, y, n)
    sets = [set(a.tolist()) | set(b.tolist()) for a, b in found]
    for k in [*sorted(sets[0])[:40], 3]:
        p, q = (1 + sum(k in s for s, v in zip(sets, y, strict=True) if v == one) for one in (True, False))
        assert np.isclose(got[k], np.log(p / (y.sum() + 2)) - np.log(q / ((~y).sum() + 2)))


def test_calibration_rows_are_in_no_count():
    rows, labels = labelled_docs("excellent", 300)
    texts, marks = [t for _, t in rows], [y for _, y in labels]
    other = ["zzz " + t if k % 5 == 4 else t for k, t in enumerate(texts)]
    one, two = quality.fit(texts, marks), quality.fit(other, marks)
    assert np.array_equal(one["weights"], two["weights"]) and one["bias"] == two["bias"]
    rows, labels = labelled_docs("villain", 300)
    texts, marks = [t for _, t in rows], [y for _, y in labels]
    other = [t.replace("villain", "scoundrel") if k % 5 == 4 else t for k, t in enumerate(texts)]
    assert toxicity.fit(texts, marks)["landmarks"] == toxicity.fit(other, marks)["landmarks"]


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run, keep in ((quality.quality, quality.keep_quality), (toxicity.toxicity, toxicity.drop_toxic)):
        df = frame(spark, [(1, "a b"), (2, None)])
        assert [r.score for r in run(df, none).collect()] == [0.5, 0.5]
        assert keep(df, none).count() == 2


def test_filters_keep_all_columns(spark):
    rows, labels = labelled_docs("villain", 200)
    df = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(df, marks).collect()}
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if not p)


def test_labels_never_reach_a_held_out_row(spark):
    rows, labels = labelled_docs("villain", 200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_letters_in_every_gap_are_no_empty_text():
    pairs = {"idiot": "ixdxixoxt", "scum": "sxcxuxm", "moron": "mxoxrxoxn", "stupid": "sqtwueprid"}
    for landmark, text in pairs.items():
        own = [plain_kernel(a, b) for a, b in ((landmark, text), (landmark, landmark), (text, text))]
        got = toxicity.Similarity([landmark], np.ones(1)).margins(["", f"a {text} here"])
        assert got[0] == 0 and np.isclose(got[1], own[0] / np.sqrt(own[1] * own[2]), rtol=1e-3) and got[1] > 0.1
    rows, labels = labelled_docs("villain")
    score = toxicity.scorer(toxicity.fit([t for _, t in rows], [y for _, y in labels]))
    empty, exact, *found = score(["", "a villain", *(f"a {x} here" for x in ("vxixlxlxaxixn", "vqiwlelraiiyn", "viollkljahigfn"))])
    assert exact >= 0.3 > empty and all(x > empty for x in found)
