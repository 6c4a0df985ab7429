"""Every query that SQL can express agrees with DuckDB on the smallest tables; all names resolve."""

import pytest

import __spark_entry__ as entry
from quire import queries as core

from duck import same


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, tiny, name):
    same(core.queries()[name](spark, tiny), core.oracle_sql()[name], tiny)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gate_queries_see_every_defect(spark, tiny):
    for name, sound, cases in (("gate_adjudication", {0}, 9), ("gate_proposal", {0}, 10), ("gate_verification", {0, 5}, 6), ("gate_global", {0, 4}, 5)):
        rows = core.queries()[name](spark, tiny).select("case", "error").distinct().collect()
        assert {r.case for r in rows} == set(range(cases)) and all((r.error is None) == (r.case in sound) for r in rows), name


def test_recurring_statements_have_all_bands(spark, tiny):
    """The corpus that SQL can follow meets every relation and disposition that statements can have in it."""
    rows = core.queries()["unit_decisions"](spark, tiny).select("relation", "disposition").distinct().collect()
    assert {r.relation for r in rows} == {"exact_equivalent", "paraphrase_equivalent", "partial_overlap", "uncertain"}
    assert {r.disposition for r in rows} == {"preserve_in_place", "human_review", "merge_into_centre"}


def test_repeated_and_missing_ids_are_rejected(spark):
    from quire.plans.analysis import analyse

    rows = [(1, "One here. Two there."), (2, "Same id."), (2, "Other text."), (None, "No id.")]
    a = analyse(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.ord, r.char_start) for r in a.units.orderBy("ord").collect()] == [(1, 0, 0), (1, 1, 10)]
    assert sorted((str(r.doc_id), r.reason) for r in a.rejects.collect()) == [("2", "doc_id is repeated"), ("2", "doc_id is repeated"), ("None", "doc_id is missing")]


def test_instability_is_that_of_whole_texts(spark, tiny):
    import difflib
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in core.queries()["pass_instability"](spark, tiny).collect():
        text = texts[r.doc_id]
        changed = re.sub("[.] ", ". See above. ", text)
        assert r.instability == pytest.approx(0 if text == changed else 1 - difflib.SequenceMatcher(None, text, changed).ratio(), abs=1e-6)


def test_recurring_statements_are_worked_out_once(spark, tiny):
    """What reads the derived documents, admission's filter among it, must not work out their texts again."""
    from quire.operators import ledger

    def digests(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    assert digests(core.recurring(docs)) == digests(ledger.units(ledger.admit(core.recurring(docs))[0])) == 3


def test_readers_of_units_pay_for_no_pairs(spark, tiny, monkeypatch):
    from quire.operators import relate

    def refuse(*_):
        raise AssertionError("pairs were worked out")

    monkeypatch.setattr(relate, "candidate_edges", refuse)
    assert core.queries()["gate_global"](spark, tiny).count() > 0


def test_pairs_are_counted_where_their_document_lies(spark, tiny):
    """Pairs are many more than units: only the words of units may move, once."""
    from quire.operators import ledger, relate

    units = core.stored(ledger.units(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")))
    assert relate.blocked_pairs(units)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_rounding_is_pythons_next_to_middles(spark):
    import math
    import random

    from quire.functions import text as T

    dice, values = random.Random(5), [0.0, 1.0, 0.35, 1999.99995, 2000.00005, 123456.78905]
    for _ in range(4000):
        x = dice.choice([dice.random(), dice.randrange(20001) / 20000, dice.randrange(1, 60) / dice.randrange(1, 60), dice.random() * 3000])
        values += [x, math.nextafter(x, 9e9), math.nextafter(x, 0)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert all(r.r == round(r.v, 4) for r in rows.select("v", T.rounded("v", "r")).collect())


def test_stored_units_hold_no_word_sets(spark, tiny):
    """Word sets follow from the normalised text; stored too, they were over half of what a run keeps on disk."""
    from quire.plans.analysis import analyse

    kept = []
    a = analyse(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").limit(5), keep=lambda df: kept.append(df) or df)
    assert {"tokens", "content", "concepts"} <= set(a.units.columns) and not {"tokens", "content", "concepts"} & set(kept[0].columns)


def test_anchors_are_those_of_pythons_patterns(spark):
    """Digits that lead a longer word are no number, and a letter beyond ASCII goes on with a word: no term ends there."""
    from quire.operators import ledger

    texts = ['token = "11acdfb36b"', "Thshea Stte\xe4 zu", "7th of 7, 2321b", "Open Data Set", "1\xe9 and 12%"]
    rows = ledger.units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.numbers, r.defined_terms) for r in rows} == {0: ([], []), 1: ([], []), 2: (["7,"], []), 3: ([], ["Open Data Set"]), 4: (["12%"], [])}


def test_certification_reads_the_first_rounds_analysis(spark, tiny, monkeypatch):
    """Originals were analysed twice, once in the first round and once to certify it; the report must stay the same."""
    from pyspark.sql import functions as F

    from quire.operators import ledger
    from quire.plans.safe_pass import SafePass, certify_formally, safe_pass

    made, plain = [], ledger.bare_units
    monkeypatch.setattr(ledger, "bare_units", lambda docs: made.append(docs) or plain(docs))
    rows = core.recurring(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").filter("doc_id % 10 = 0"))
    odd = spark.createDataFrame([(-1, "One id. One id."), (-1, "Two texts."), (-2, " "), (-3, None), (None, "No id.")], "doc_id long, text string")
    done = safe_pass(core.stored(rows.union(odd)), max_transactions=2)
    found = certify_formally(done)
    assert len(made) == 3  # two rounds and the revised texts
    again = certify_formally(SafePass(done.documents, done.transactions))
    for a, b in zip(found[:2], again[:2]):
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # what was not kept of the first round can still be asked for
    assert found[2].decisions.select(F.struct("*")).exceptAll(again[2].decisions.select(F.struct("*"))).isEmpty()


def test_plans_of_documents_are_worked_out_once(spark, tiny):
    """Complexity reads the plan three times; its windows and joins were worked out for each."""
    from quire.plans.analysis import analyse

    a = analyse(core.recurring(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").limit(5)))
    assert "Window" not in a.complexity._jdf.queryExecution().optimizedPlan().toString()


def test_driver_collects_its_garbage_between_tables():
    """Plans of tables already written filled the driver's heap up to its limit, and it never shrank."""
    from types import SimpleNamespace as Own

    from quire.sources import scratch

    def collected(total):
        seen = []
        lang = Own(Runtime=Own(getRuntime=lambda: Own(totalMemory=lambda: total, maxMemory=lambda: 1000)), System=Own(gc=lambda: seen.append(1)))
        scratch._tidy(Own(_jvm=Own(java=Own(lang=lang))))
        return len(seen)

    assert [collected(total) for total in (400, 500, 501, 1000)] == [0, 0, 1, 1]
