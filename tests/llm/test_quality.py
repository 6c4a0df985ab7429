import math

import numpy as np
import pytest

from quire.llm import classifier, rules

from conftest_rows import texts
from llm_data import rule_counts


def counts(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_rule_counts_match_python(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = rules.op7_quality_rules(spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = rule_counts(docs[r.doc_id])
        assert counts(r) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_odd_rows(odd, none, labels):
    rows = rules.quality_rules(odd, labels).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *counts(r)) for r in rows) == sorted((i if i is not None else -1, *rule_counts(t)) for i, t in texts())
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (4, 5, 10))
    assert rules.quality_rules(none, labels).collect() == []
    assert rules.quality_rules(odd, labels.limit(0)).filter("size(failed_rules) > 0").count() == 0


def test_binomial():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.3)):
        assert math.isclose(rules.binomial_at_most(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_cutoffs_hold_their_limit(spark):
    """Good texts with 0.4 % outliers: the cutoff passes them at a limit of 2 %, and none is set from a few labels."""
    rows = [(i, "a" if i < 4000 else "b", *([100] * 9)) for i in range(4010)]
    names = ["doc_id", "stratum", *rules.COUNTS]
    df = spark.createDataFrame(rows, names).selectExpr("doc_id", "stratum", *(c if c != "n_symbols" else "CASE WHEN doc_id % 250 = 0 THEN 60L ELSE doc_id % 5 END AS n_symbols" for c in rules.COUNTS))
    labels = df.selectExpr("doc_id", "1 AS quality")
    found = {(s, r): c for s, r, c in rules.cutoffs(df, labels, risk=0.02)}
    assert found["a", "symbols"] == pytest.approx(0.04)
    assert not any(s == "b" for s, _ in found)


def test_pairwise_sum_identity():
    rng = np.random.default_rng(1)
    model = {"b": 0.3, "w": rng.standard_normal(50).astype(np.float32), "v": rng.standard_normal((50, 4)).astype(np.float32)}
    places, values = [np.asarray([3, 7, 20]), np.asarray([1])], [np.asarray([0.2, 1.0, -0.5], np.float32), np.asarray([2.0], np.float32)]
    for p, x, got in zip(places, values, classifier.scores(model, places, values)):
        z = 0.3 + sum(model["w"][i] * a for i, a in zip(p, x)) + sum(float(model["v"][p[i]] @ model["v"][p[j]]) * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = classifier.op10_quality_classifier(spark, sf).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.score, label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y, _ in judged if y == 1], [s for s, y, _ in judged if y == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc > 0.95 and np.mean([p for _, y, p in judged if y == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifier_on_odd_rows(odd, none, labels):
    rows = classifier.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[9]) == 1 and by[4] == by[5]
    assert classifier.classify(none, labels).collect() == []
    assert classifier.classify(odd, labels.limit(0)).count() == odd.count()


def test_metadata_is_read_only_when_named(odd, labels):
    plain = {r.doc_id: r.score for r in classifier.classify(odd, labels).collect()}
    more = {r.doc_id: r.score for r in classifier.classify(odd, labels, metadata=("n_chars",)).collect()}
    assert set(plain) == set(more) and plain != more


def test_repeated_labels_are_no_evidence(spark):
    """150 good labels set no cutoff; neither do the same 150 ten times, nor ten rows of each document."""
    names = ["doc_id", "stratum", *rules.COUNTS]
    df = spark.createDataFrame([(i, "a", *([100] * 9)) for i in range(150)], names)
    labels = df.selectExpr("doc_id", "1 AS quality")
    many = lambda x: x.crossJoin(spark.range(10).select()).select(x.columns)
    assert rules.cutoffs(df, labels) == rules.cutoffs(df, many(labels)) == rules.cutoffs(many(df), labels) == []
    enough = spark.createDataFrame([(i, "a", *([100] * 9)) for i in range(1500)], names)
    good = enough.selectExpr("doc_id", "1 AS quality")
    assert rules.cutoffs(enough, good) and rules.cutoffs(many(enough), many(good)) == rules.cutoffs(enough, good)
    assert rules.cutoffs(enough, good.union(enough.selectExpr("doc_id", "0 AS quality"))) == []  # labels that disagree


def test_repeated_rows_do_not_widen_the_fit(odd, labels):
    before = classifier.train(odd, labels)
    after = classifier.train(odd.union(odd), labels.union(labels).union(labels))
    assert (before["w"] == after["w"]).all() and before["b"] == after["b"]
