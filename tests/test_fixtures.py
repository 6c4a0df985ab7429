"""Behaviour on small documents whose results were worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import conserve, invariants, ledger, relate, transact
from quire.plans.analysis import analyse
from quire.plans.hybrid import hybrid_pass
from quire.plans.safe_pass import certify_formally, safe_pass

S1 = "The archive preserves every original record."
DOCS = {
    1: f"# Background\n\n{S1}\n\n# Analysis\n\n{S1}",
    2: "# Evidence\n\nThe measured log contains 418 events and the archive preserves every original record.\n\n# Analysis\n\n"
    "The archive preserves every original record so reviewers can reconstruct the transformation.",
    3: "# Method\n\nThe checkpoint hash is recorded twice. The checkpoint hash is recorded twice.",
    4: "# Background\n\nAccess reviews occur every 90 days.\n\n# Recommendations\n\nAccess reviews occur every 90 days.",
    5: f"# Background\n\n{S1}\n\n# Analysis\n\n{S1}\n\n# Recommendations\n\n{S1}",
    6: f"# Background\n\n{S1}\n\n# Analysis\n\nThe archive retains every original record, but temporary diagnostic traces expire after 30 days.",
    7: '# Background\n\nThe "core archive" preserves every original record.\n\n# Analysis\n\nThe core archive preserves every original record.',
    71: '# Background\n\nThe "core archive" preserves every original record.\n\n# Analysis\n\nThe core archive preserves every original record.\n\n# Context\n\n'
    "The core archive preserves every original record.",
    8: "Fin de phrase. Éa continue. Next one.",
    9: "# T\r\n\r\nBody a.\n## Sub\n\ntext\n###\n\nglued\n#no\n####### seven",
    10: "#Not a heading\n\nOne sentence here.",
    12: "# A\n\n## B",
    13: " ",
    14: None,
    18: 'The "Control Record" retained 418 events (Smith 2026).',
    20: "Intro 😀 text.  Two spaces. And more.\n\n\n  Third para.\n\n# Head \n\ntail é. Zed.",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def run(docs):
    return analyse(docs)


@pytest.fixture(scope="module")
def passed(docs):
    return safe_pass(docs)


def test_rejects(run):
    assert {r.doc_id: r.reason for r in run.rejects.collect()} == {13: "document is empty", 14: "text is missing"}


def test_too_large_is_rejected(spark):
    good, bad = ledger.admit(spark.createDataFrame([(1, "é" * 6)], "doc_id long, text string"), max_bytes=11)
    assert good.count() == 0 and bad.first().reason == "document is too large"


def test_sections(run):
    found = {}
    for r in run.sections.orderBy("doc_id", "sec_ord").collect():
        found.setdefault(r.doc_id, []).append((r.section_id, r.title, r.level))
    assert found[9] == [("s_001", "T", 1), ("s_002", "Sub", 2), ("s_003", "glued", 3)]
    assert found[10] == [("s_001", "Document", 1)]
    assert found[12] == [("s_001", "A", 1), ("s_002", "B", 2)]
    assert found[20][0] == ("s_000", "Preamble", 1)


def test_units_slice_to_their_text_and_ids_are_unique(run):
    rows = run.units.collect()
    assert all(DOCS[r.doc_id][r.char_start : r.char_end] == r.text for r in rows)
    assert len({(r.doc_id, r.unit_id) for r in rows}) == len(rows)
    assert [r.text for r in sorted(rows, key=lambda r: r.ord) if r.doc_id == 8] == ["Fin de phrase. Éa continue.", "Next one."]
    assert [(r.paragraph_index, r.sentence_index) for r in sorted(rows, key=lambda r: r.ord) if r.doc_id == 20] == [(0, 0), (0, 1), (0, 2), (1, 0), (0, 0), (0, 1)]


def test_anchors(run):
    r = run.units.filter("doc_id = 18").first()
    assert (r.numbers, r.quotations, r.citations, r.defined_terms) == (["418", "2026"], ["Control Record"], ["(Smith 2026)"], ["Control Record"])


def test_pairs_scores_and_decisions(run):
    composite = {r.doc_id: r.composite for r in run.pairs.filter("doc_id <> 5 AND doc_id <> 71").collect()}
    assert composite == {1: 0.925, 2: 0.4417, 3: 0.925, 4: 1.0, 6: 0.57, 7: 0.925}
    scores = {r.doc_id: r.scores for r in run.plan.collect()}
    assert scores[1] == {"Background": 0.4758, "Analysis": 0.5983}
    assert scores[4] == {"Background": 0.4758, "Recommendations": 0.5633}
    assert scores[5] == {"Background": 0.4592, "Analysis": 0.5817, "Recommendations": 0.5467}
    assert scores[6] == {"Background": 0.4758, "Analysis": 0.6428}
    assert scores[3] == {"Method": 0.4431} or scores[3]["Method"] > 0.44
    plan = {r.doc_id: r for r in run.plan.collect()}
    assert (plan[1].risk_score, plan[1].risk_band, plan[6].risk_score, plan[6].risk_band) == (0.45, "moderate", 0.875, "high")
    assert (plan[4].centre, plan[4].competing_centre) == ("Recommendations", "Background")
    assert plan[1].label == "Archive · Data · Original" and plan[4].label == "Periodic access-control review"
    how = {(r.doc_id, r.section_title): (r.relation, r.disposition) for r in run.decisions.collect()}
    assert how[1, "Background"] == ("exact_equivalent", "merge_into_centre")
    assert how[2, "Evidence"] == ("uncertain", "preserve_in_place") and how[2, "Analysis"] == ("uncertain", "human_review")
    assert how[3, "Method"][1] == "preserve_in_place"
    assert how[6, "Background"] == ("partial_overlap", "human_review") and how[6, "Analysis"] == ("partial_overlap", "preserve_in_place")
    status = {r.doc_id: r.status for r in run.invariants.collect()}
    assert status[1] == "ANALYSIS_VERIFIED_REWRITE_NOT_YET_RUN" and status[6] == "ANALYSIS_COMPLETE_REWRITE_WITHHELD"


def test_blocking_loses_no_edge(run):
    units = run.units
    wide = relate.all_pairs(units).filter("composite >= 0.43").select("doc_id", "left_ord", "right_ord", "composite").collect()
    assert sorted(wide) == sorted(run.edges.select("doc_id", "left_ord", "right_ord", "composite").collect())
    low = relate.candidate_edges(units, 0.2).count()
    assert low == relate.all_pairs(units).filter("composite >= 0.2").count()


def test_families_are_cliques_and_apart(run):
    edges = {(r.doc_id, r.left_ord, r.right_ord) for r in run.edges.collect()}
    seen, by = set(), {}
    for r in run.members.collect():
        assert (r.doc_id, r.ord) not in seen
        seen.add((r.doc_id, r.ord))
        by.setdefault((r.doc_id, r.emission), []).append(r.ord)
    for (doc, _), own in by.items():
        assert all((doc, a, b) in edges for a in own for b in own if a < b)


def test_grouping_rule():
    assert list(relate._cliques([(0, 1), (1, 2)])) == [[0, 1]]
    assert list(relate._cliques([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)])) == [[0, 1, 2], [3, 4]]


def test_anchor_loss_blocks_or_rolls_back(run):
    found = {r.doc_id: r for r in transact.prepare(run).collect()}
    assert 7 not in found
    assert found[71].state == "rolled_back" and found[71].revised_document == DOCS[71] and not found[71].anchors_preserved


def test_safe_pass(passed):
    out = {r.doc_id: r for r in passed.documents.collect()}
    assert out[1].revised_text == DOCS[1].replace(S1, "See Analysis for the canonical treatment of Archive · Data · Original.", 1)
    turns = {}
    for r in passed.transactions.collect():
        turns.setdefault(r.doc_id, []).append((r.tx_ord, len(r.changed_unit_ids)))
    assert {k: sorted(v) for k, v in turns.items()} == {1: [(0, 1)], 4: [(0, 1)], 5: [(0, 2), (1, 1)]}
    assert out[71].revised_text == DOCS[71] and out[71].eligible_families_remaining == 1


def test_whole_passes_of_documents_agree_with_rounds_over_the_collection(spark, docs, passed):
    """Rounds over the collection took some forty tables each; a document's rounds need nothing of other documents."""
    from quire.plans.safe_pass import finished
    from quire.queries import recurring

    made = finished(docs)
    assert made.count() > 10 and sorted(made.collect()) == sorted(passed.documents.select(*made.columns).collect())
    # statements in groups, all dispositions among them, and a cap that some documents reach
    rows = recurring(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id % 4 = 0")).localCheckpoint().union(docs)
    made, by_rounds = finished(rows, max_transactions=1), safe_pass(rows, max_transactions=1).documents
    assert sorted(made.collect()) == sorted(by_rounds.select(*made.columns).collect()) and {r.stop_reason[:6] for r in made.collect()} == {"Safety", "No fur"}


def test_all_rounds_of_prose_store_no_tables(spark, tiny, monkeypatch):
    """Writing each round's tables took longer than the work in them."""
    from pyspark.sql import DataFrameWriter

    from quire.queries import prose_safe_pass

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_, **__: pytest.fail("a table was stored"))
    assert prose_safe_pass(spark, tiny).count() == 200


def test_sentences_met_often_are_counted_alike(monkeypatch):
    """Many meetings are counted in arrays, few one by one; words of a group are other words than their concept."""
    from quire.plans import rounds

    dice = random.Random(3)
    words = ["archive", "keep", "retain", "evidence", "proof", "418", "Open Data Set", "review", "should", "quartz", "ledger", "beacon"]
    own = [" ".join(dice.choices(words, k=dice.randint(1, 9))) + "." for _ in range(400)]
    found = []
    for many in (0, 10**9):
        monkeypatch.setattr(rounds, "_MANY", many)
        kinds = rounds.Kinds()
        for text in own:
            kinds.recurs(kinds(text))
        found.append(kinds.near)
    assert found[0] == found[1] and sum(map(len, found[0])) > 1000
    # pairs that were passed over because they share too little are none
    kinds._least = 0
    for b in range(len(kinds.own)):
        for a in range(b):
            if kinds.own[a].concepts & kinds.own[b].concepts and b not in kinds.near[a]:
                kinds._score(b, a, len(kinds.own[a].concepts & kinds.own[b].concepts))
                assert b not in kinds.near[a]


def test_conservation_after_safe_pass(passed):
    report = {r.doc_id: r for r in certify_formally(passed)[1].collect()}
    assert all(r.ledger_coverage == 1.0 and not r.failures for k, r in report.items() if k != 12)
    assert report[12].ledger_coverage == 0.0 and report[12].status == "NOT_VERIFIED"
    assert report[6].status == "FORMAL_GATES_PASSED_UNRESOLVED_SEMANTICS"


def test_losses_are_found(spark):
    pairs = spark.createDataFrame(
        [
            (13, "One thing stays. Another thing goes.", "One thing stays."),
            (14, "The log holds 418 events in all.", "The log holds many events in all."),
            (15, f"# A\n\n{S1}\n\n# B\n\n{S1}", f"# A\n\n# B\n\n{S1}"),
        ],
        "doc_id long, original_text string, revised_text string",
    )
    before = analyse(pairs.select("doc_id", F.col("original_text").alias("text")))
    after = analyse(pairs.select("doc_id", F.col("revised_text").alias("text")))
    none = transact.prepare(before).withColumn("tx_ord", F.lit(0)).limit(0)
    report = {r.doc_id: r for r in conserve.verify(pairs, before, after, none)[1].collect()}
    assert report[13].ledger_coverage == 0.5 and len(report[13].missing_unit_ids) == 1
    assert report[14].missing_hard_anchors == ["418"] and report[14].status == "NOT_VERIFIED"
    assert report[15].ledger_coverage == 0.5


def test_plan_bands(spark):
    text = spark.createDataFrame([(1, "x" * 26), (2, "A line of text. " * 2000)], "doc_id long, text string")
    small = {r.doc_id: r for r in ledger.resource_plan(text, ledger.sections(text), context_limit=10_000).collect()}
    assert (small[1].estimated_tokens, small[1].strategy, small[1].initial_pass_cap) == (6, "whole_document", 1)
    large = {r.doc_id: r for r in ledger.resource_plan(text, ledger.sections(text), context_limit=3000, safety_ratio=0.5).collect()}[2]
    assert large.strategy.startswith("overlapping") and large.initial_pass_cap <= 5 and large.context_pressure == 5.3333
    with pytest.raises(ValueError):
        ledger.resource_plan(text, ledger.sections(text), context_limit=10)


def test_continuation(spark):
    base = dict(doc_id=1, pass_number=1, repetition_burden=0.2, substantive_ledger_coverage=1.0, pass_instability=0.1, unresolved_occurrences=2, initially_planned=2, conservation_risk=0.0, expected_benefit=1.0, previous_burden=None)
    cases = [
        (dict(substantive_ledger_coverage=0.99), "STOP_NOT_VERIFIED"), (dict(previous_burden=0.2, repetition_burden=0.195, pass_instability=0.01, pass_number=2), "STOP_STABLE"),
        (dict(pass_number=2), "ADD_PASS"), (dict(pass_number=5), "STOP_SAFETY_CAP"), (dict(conservation_risk=0.7, expected_benefit=0.4), "STOP_HUMAN_REVIEW"), ({}, "CONTINUE"),
    ]
    kinds = "doc_id long, pass_number int, repetition_burden double, substantive_ledger_coverage double, pass_instability double, unresolved_occurrences int, initially_planned int, conservation_risk double, expected_benefit double, previous_burden double"
    names = [k.split()[0] for k in kinds.split(", ")]
    rows = [tuple({**base, **change, "doc_id": i}[n] for n in names) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, kinds).withColumn("critical_failures", F.array().cast("array<string>"))
    assert [r.action for r in invariants.continuation(df).orderBy("doc_id").collect()] == [want for _, want in cases]


def test_rounding_is_that_of_python(spark):
    random.seed(4)
    values = [k / 20000 for k in range(1, 20000, 2)] + [random.random() for _ in range(3000)] + [random.random() * 1900 for _ in range(2000)] + [random.random() / 5000 for _ in range(2000)] + [0.0, 1.0]
    got = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", T.round4(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x, 4) for r in got)


def test_title_case(spark):
    words = ["don't stop c·b", "access-control review", "éa 3rd ünit", ""]
    got = spark.createDataFrame([(w,) for w in words], "x string").select("x", T.title_case(F.col("x")).alias("r")).collect()
    assert all(r.r == r.x.title() for r in got)


def test_fails_closed_without_a_model(docs):
    out = {r.doc_id: r for r in hybrid_pass(docs.filter("doc_id IN (1, 6)")).documents.collect()}
    assert not out[1].eligible and out[1].semantic_status == "MODEL_UNAVAILABLE" and out[1].model_status == "MODEL_UNAVAILABLE"
    assert out[6].semantic_status == "NOT_RUN" and out[6].reasons == ["1 occurrence(s) still require semantic adjudication"]


def test_result_does_not_depend_on_partitions(docs, run):
    again = analyse(docs.repartition(3, F.rand(1)))
    assert sorted(map(str, again.plan.collect())) == sorted(map(str, run.plan.collect()))
