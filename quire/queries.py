"""Named queries of the engine over the standard tables, and the same in SQL where SQL can express them.

``documents`` is plain text, so most queries give its lines titles in turn first (``ledger.sectionise``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import gates, invariants, ledger, relate, transact
from .plans import analysis, hybrid, safe_pass
from .sources.scratch import stored
from .sql import ORACLES
from .sql_recurring import ORACLES as RECURRING


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _plain_units(spark, sf_dir):
    return ledger.units(ledger.admit(_docs(spark, sf_dir))[0])


def _sections(spark, sf_dir):
    return ledger.sections(ledger.admit(ledger.sectionise(_docs(spark, sf_dir)))[0])


def _units(spark, sf_dir):
    return ledger.units(ledger.admit(ledger.sectionise(_docs(spark, sf_dir)))[0])


def recurring(docs: DataFrame) -> DataFrame:
    """Documents of statements that recur, one for each line of docs: groups of equal, similar and loosely similar ones.

    The hash of a line chooses the statement's group, whose eight words and marker all its statements share, and one of
    eight variants, four of which add nothing, while the others add two to eight words of their own. So the groups of a
    document are cliques that nothing links, as SQL needs them to tell the families; all bands of similarity occur.
    """
    letters = lambda x: F.translate(F.md5(x), "0123456789", "ghijklmnop")
    number = lambda h, at: F.conv(F.substring(h, at, 7), 16, 10).cast("long")

    def words(lead: str, seed: Column, n: Column) -> Column:
        return T.bound(letters(seed), lambda a: F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), 1, n), lambda j: F.concat(F.lit(lead), F.substring(a, j * 4 + 1, F.lit(4)))))

    def statement(x: Column) -> Column:
        key, v = x["key"], x["v"]
        more = words(" v", F.concat_ws("", F.lit("variant"), key, F.lit("."), v), F.when(v == 4, 2).when(v == 5, 6).when(v > 5, 8).otherwise(0))

        def told(own: Column) -> Column:
            cited = F.concat(F.lit(" because ("), F.get(own, F.lit(0)), F.lit(" 19"), (key % 90 + 10).cast("string"), F.lit(")"))
            mark = F.when(key % 6 == 1, " access review").when(key % 6 == 2, " source transformed").when(key % 6 == 3, " record restated").when(key % 6 == 4, " should").when(key % 6 == 5, cited).otherwise("")
            return F.concat(F.lit("The "), F.array_join(own, " "), mark, F.when(v < 4, "").otherwise(F.array_join(more, "")), F.lit("."))

        return T.bound(words("k", F.concat(F.lit("key"), key), F.lit(8)), told)

    def statements(lines: Column) -> Column:
        groups = F.greatest(F.lit(3), F.floor(F.size(lines) / 3).cast("int"))
        return T.bound(groups, lambda n: F.transform(F.transform(lines, lambda x: F.md5(x)), lambda h: T.bound(F.struct((number(h, 1) % n).alias("key"), (number(h, 8) % 8).alias("v")), statement)))

    told = T.bound(F.split("text", "\n", -1), lambda lines: F.array_join(statements(lines), "\n"))
    return T.once(ledger.sectionise(docs.select("doc_id", told.alias("text"))))


def _analysis(spark, sf_dir):
    return analysis.analyse(recurring(_docs(spark, sf_dir)))


def _prose(spark, sf_dir):
    return analysis.analyse(ledger.sectionise(_docs(spark, sf_dir)))


def _one_round(spark, sf_dir):
    return safe_pass.safe_pass(recurring(_docs(spark, sf_dir)), max_transactions=1)


def _flat(df: DataFrame, *more: str) -> DataFrame:
    """Arrays of strings as one string each; other nested columns, and those named, are left out."""
    keep = [f for f in df.schema.fields if f.name not in more and not f.dataType.simpleString().startswith(("map", "struct", "array<struct"))]
    return df.select(*(F.array_join(f.name, "|").alias(f.name) if f.dataType.simpleString() == "array<string>" else f.name for f in keep))


def admit_documents(spark, sf_dir):
    good, bad = ledger.admit(_docs(spark, sf_dir), max_bytes=20_000)
    return good.select("doc_id", F.lit("admitted").alias("outcome")).union(bad.select("doc_id", "reason"))


def sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section_id", "title", "level", "start")


def doc_title(spark, sf_dir):
    return ledger.document_title(_sections(spark, sf_dir))


def resource_plan(spark, sf_dir):
    docs = ledger.sectionise(_docs(spark, sf_dir))
    out = ledger.resource_plan(docs, ledger.sections(docs), context_limit=1000)
    return out


def normalize_units(spark, sf_dir):
    return _plain_units(spark, sf_dir).select("doc_id", "ord", "text", "normalized_text")


def unit_ledger(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", "ord", "unit_id", "section_id", "section_title", "paragraph_index", "sentence_index")


def unit_offsets(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", "ord", "char_start", "char_end")


def unit_tokens(spark, sf_dir):
    return _plain_units(spark, sf_dir).select("doc_id", "ord", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


def discourse_role(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "ord", "role")


def local_function(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "ord", "section_title", "function")


def _marked(spark, sf_dir):
    """Sectionised documents with a marker sentence in each section, for the corpus has few markers of its own."""
    marks = F.array(*(F.lit(f" {words[0].strip().capitalize()} it.") for _, words in T.ROLE_MARKERS))
    docs = _docs(spark, sf_dir)
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(line, F.get(marks, i % len(T.ROLE_MARKERS))))
    docs = ledger.sectionise(docs.select("doc_id", F.array_join(lines, "\n").alias("text")))
    return ledger.units(docs)


def _anchored(spark, sf_dir):
    """Units of whole texts with a line more that holds every kind of anchor, made from the row's own values."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = F.concat(F.lit('The "Record '), F.col("doc_id"), F.lit('" kept $'), F.col("n_chars"), F.lit(".50 and 12% of "), F.col("source"), F.lit(" in Open Data Set (Smith 2024) [see "), F.col("doc_id"), F.lit("]."))
    return ledger.units(rows.select("doc_id", F.concat_ws("\n", "text", extra).alias("text")))


def _anchors(kind):
    def query(spark, sf_dir):
        return _anchored(spark, sf_dir).select("doc_id", "ord", F.array_join(kind, "|").alias(kind))

    return query


anchors_numbers, anchors_quotations, anchors_citations, anchors_terms = map(_anchors, ("numbers", "quotations", "citations", "defined_terms"))
for _name in ("numbers", "quotations", "citations", "terms"):
    globals()[f"anchors_{_name}"].__name__ = f"anchors_{_name}"


def content_concepts(spark, sf_dir):
    return _plain_units(spark, sf_dir).select("doc_id", "ord", F.array_join("content", " ").alias("content"), F.array_join("concepts", " ").alias("concepts"))


def pair_evidence(spark, sf_dir):
    pairs = relate.blocked_pairs(_units(spark, sf_dir))
    return pairs.select("doc_id", "left_ord", "right_ord", "lexical_overlap", "concept_overlap", "anchor_overlap", "role_compatibility", "composite")


def candidate_edges(spark, sf_dir):
    return relate.candidate_edges(_units(spark, sf_dir)).select("doc_id", "left_ord", "right_ord", "composite")


def degree(spark, sf_dir):
    return relate.degrees(relate.candidate_edges(_units(spark, sf_dir)))


def exact_repeat_families(spark, sf_dir):
    return relate.exact_repeats(_units(spark, sf_dir))


def families(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).families)


def family_labels(spark, sf_dir):
    return _analysis(spark, sf_dir).families.select("doc_id", "family_id", "label")


def family_evidence(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    rows = relate.pair_evidence(a.pairs).select("doc_id", "emission", F.explode("pair_evidence").alias("pair", "x"))
    return rows.join(a.families.select("doc_id", "emission", "family_id", "label"), ["doc_id", "emission"]).select("doc_id", "family_id", "label", "pair", "x.*")


def family_means(spark, sf_dir):
    """Mean composite of each family's pairs."""
    a = _analysis(spark, sf_dir)
    return relate.family_means(a.pairs).join(a.families.select("doc_id", "emission", "family_id"), ["doc_id", "emission"]).select("doc_id", "family_id", "pairs", "mean_composite")


def centre_scores(spark, sf_dir):
    return _analysis(spark, sf_dir).scores.select("doc_id", "family_id", "section_title", "score", "strongest")


def centre_choice(spark, sf_dir):
    return _analysis(spark, sf_dir).choice.drop("emission", "scores")


def unit_decisions(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).decisions)


def disposition_counts(spark, sf_dir):
    return _analysis(spark, sf_dir).decisions.groupBy("doc_id", "disposition").agg(F.count("*").alias("occurrences"))


def family_risk(spark, sf_dir):
    return _analysis(spark, sf_dir).plan.select("doc_id", "family_id", "risk_score", "risk_band")


def family_plan(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).plan)


def analysis_invariants(spark, sf_dir):
    return _flat(_analysis(spark, sf_dir).invariants)


def complexity(spark, sf_dir):
    return _analysis(spark, sf_dir).complexity


def transactions(spark, sf_dir):
    return _flat(transact.public(transact.prepare(_analysis(spark, sf_dir))))


def compare_view(spark, sf_dir):
    return transact.compare_view(transact.prepare(_analysis(spark, sf_dir)))


def safe_pass_documents(spark, sf_dir):
    """One round: the first transaction of each document."""
    out = _one_round(spark, sf_dir)
    return out.documents.select("doc_id", F.sha2("revised_text", 256).alias("revised_sha256"), "eligible_families_remaining", "stop_reason")


def global_report(spark, sf_dir):
    return _flat(safe_pass.certify_formally(_one_round(spark, sf_dir))[1])


def conservation_ledger(spark, sf_dir):
    return safe_pass.certify_formally(_one_round(spark, sf_dir))[0]


def certification(spark, sf_dir):
    return _flat(hybrid.hybrid_pass(recurring(_docs(spark, sf_dir)), max_transactions=1).documents, "original_text", "revised_text")


def pass_metrics(spark, sf_dir):
    """Metrics of the one round; its instability is ``pass_instability``'s matter, for SQL has no such ratio."""
    done = _one_round(spark, sf_dir)
    _, report, _, after = safe_pass.certify_formally(done)
    passes = done.documents.join(report, "doc_id").select(
        "doc_id", F.lit(1).alias("pass_number"), F.col("original_text").alias("previous_document"), F.col("revised_text").alias("current_document"), F.col("accounted_unit_count").alias("accounted"),
        F.col("original_unit_count").alias("total"), F.col("failures").alias("critical_failures"),
    )
    return _flat(invariants.pass_metrics(passes, after.units, after.decisions, after.complexity).drop("pass_instability"))


def prose_family_plan(spark, sf_dir):
    """Plans of the corpus' own sentences, whose groups SQL can't tell."""
    return _flat(_prose(spark, sf_dir).plan)


def prose_transactions(spark, sf_dir):
    return _flat(transact.public(transact.prepare(_prose(spark, sf_dir))))


def prose_safe_pass(spark, sf_dir):
    """All rounds until no document has a transaction left."""
    out = safe_pass.finished(ledger.sectionise(_docs(spark, sf_dir)))
    return out.select("doc_id", F.sha2("revised_text", 256).alias("revised_sha256"), "eligible_families_remaining", "stop_reason")


def previous_pass(spark, sf_dir):
    """The burden of the pass before, over order lines as passes of an order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pass_number"))
    return invariants.with_previous(rows.agg(F.min("l_tax").alias("repetition_burden")))


def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


def continuation(spark, sf_dir):
    """The continuation rule over a grid of pass metrics made from order lines."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grid = rows.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pass_number"), (F.col("l_discount") * 10 - F.floor(F.col("l_discount") * 10)).alias("x"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN 0D ELSE l_tax END").alias("repetition_burden"), F.expr("CASE WHEN l_suppkey % 10 = 0 THEN 0.99D ELSE 1D END").alias("substantive_ledger_coverage"),
        F.expr("l_discount / 4").alias("pass_instability"), F.expr("CAST(l_quantity AS INT) % 3").alias("unresolved_occurrences"),
        F.expr("CASE WHEN l_returnflag = 'R' AND l_partkey % 7 = 0 THEN array('x') ELSE CAST(array() AS ARRAY<STRING>) END").alias("critical_failures"),
        F.expr("CAST(l_partkey % 6 AS INT)").alias("initially_planned"), F.expr("l_discount * 8").alias("conservation_risk"), F.expr("0.7D").alias("expected_benefit"),
        F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax + l_discount / 8 END").alias("previous_burden"),
    )
    return invariants.continuation(grid)


def pass_instability(spark, sf_dir):
    rows = _docs(spark, sf_dir)
    changed = F.regexp_replace("text", "[.] ", ". See above. ")
    return rows.select("doc_id", F.round(invariants.instability(F.col("text"), changed), 6).alias("instability"))


def canonical_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("document_hash"), T.canonical_hash(F.col("text")).alias("canonical_hash"))


def rounding(spark, sf_dir):
    """Four-place rounding of ratios, ties among them."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ratio = F.col("l_linenumber") * F.col("l_partkey") % 20001 / 20000.0
    return rows.select("l_orderkey", "l_linenumber", T.round4(ratio).alias("rounded"))


def _judged(gate, bodies: list[Column], context: DataFrame, *against: DataFrame) -> DataFrame:
    """A message of each kind for every row of context, by number, and what the gate says of it."""
    cases = F.posexplode(F.array(*bodies)).alias("case", "body")
    key = [c for c in ("doc_id", "family_id") if c in context.columns]
    return gate(context.select(*key, cases), *(against or (context,))).select(*key, "case", "error")


def gate_adjudication(spark, sf_dir):
    """Adjudications of every family: one that keeps everything, and one for each of eight defects."""
    context = gates.family_context(_analysis(spark, sf_dir))
    none = F.array().cast("array<string>")
    occurrence = lambda u, how, residual, risk: F.struct(
        u["unit_id"].alias("unit_id"), F.lit("exact_equivalent").alias("semantic_relation"), F.lit("context").alias("local_function"), F.lit(how).alias("disposition"), none.alias("duplicated_payload"),
        residual.alias("unique_residual_payload"), risk.alias("hard_anchor_risk"), F.lit("same").alias("rationale"),
    )

    def body(units, how="preserve_in_place", residual=none, risk=none, family=F.col("family_id"), centre=None, **extra):
        centre = F.get("members", F.lit(0))["section_title"] if centre is None else centre
        return F.to_json(F.struct(
            family.alias("family_id"), F.lit("theme").alias("theme_label"), none.alias("shared_payload"), centre.alias("centre_section"), F.lit("fits").alias("centre_rationale"),
            F.transform(units, lambda u: occurrence(u, how, residual, risk)).alias("occurrences"), none.alias("unresolved_questions"), *(v.alias(k) for k, v in extra.items()),
        ))

    some, members = F.array(F.lit("x")), F.col("members")
    elsewhere = F.get(F.filter("titles", lambda t: ~F.exists("members", lambda u: u["section_title"] == t)), F.lit(0))
    bodies = [
        body(members), body(members, surplus=F.lit(1)), body(F.slice(members, 1, 1)), body(F.concat(members, F.slice(members, 1, 1))), body(members, "remove_fully_redundant", some),
        body(members, "merge_into_centre", risk=some), body(members, family=F.lit("f_other")), body(members, centre=F.lit("Nowhere")), body(members, centre=F.coalesce(elsewhere, F.lit("None"))),
    ]
    return _judged(gates.adjudications, bodies, context)


def gate_proposal(spark, sf_dir):
    """Proposals that make references of all members but the first: a sound one, and one for each of nine defects."""
    context = gates.family_context(_analysis(spark, sf_dir))
    none, members = F.array().cast("array<string>"), F.col("members")
    first, others = F.get(members, F.lit(0)), F.slice("members", 2, F.size("members"))
    given = lambda value, own: own if value is None else value

    def donor(u, i, sha=None, hard=None, how="convert_to_cross_reference", residual=none):
        odd = lambda value, own: own if value is None else F.when(i == 0, value).otherwise(own)
        return F.struct(
            u["unit_id"].alias("unit_id"), odd(sha, F.sha2(u["text"], 256)).alias("source_text_sha256"), u["text"].alias("original_text"), F.array(u["text"]).alias("duplicated_payload"), residual.alias("unique_residual_payload"),
            F.lit("context").alias("local_function"), none.alias("grammatical_dependencies"), odd(hard, u["anchors"]).alias("hard_anchors"), F.lit(how).alias("disposition"), F.lit("See there.").alias("proposed_repair"),
        )

    def body(donors=others, unit=None, centre=None, family=F.col("family_id"), changed=None, extra=(), **how):
        receiver = F.struct(
            given(unit, first["unit_id"]).alias("unit_id"), F.sha2(first["text"], 256).alias("source_text_sha256"), first["text"].alias("original_text"), none.alias("incoming_payload"), first["text"].alias("proposed_text"),
            F.transform(donors, lambda u: F.struct(u["unit_id"].alias("source_unit_id"), none.alias("integrated_payload"))).alias("provenance"),
        )
        return F.to_json(F.struct(
            family.alias("family_id"), given(centre, first["section_title"]).alias("centre_section"), F.transform(donors, lambda u, i: donor(u, i, **how)).alias("donors"), receiver.alias("receiver"),
            given(changed, others["unit_id"]).alias("changed_unit_ids"), none.alias("unresolved_questions"), *extra,
        ))

    bodies = [
        body(), body(extra=[F.lit(1).alias("surplus")]), body(family=F.lit("f_other")), body(F.concat(others, others)), body(unit=F.lit("u_x")), body(centre=F.lit("Nowhere")), body(sha=F.lit("0")),
        body(hard=F.array(F.lit("9"))), body(how="remove_fully_redundant", residual=F.array(F.lit("x"))), body(changed=none),
    ]
    return _judged(gates.proposals, bodies, context)


def _verdict(units: Column, unit_checks: list[str], checks: list[str], failed: str | None = None, overall: str = "passed", extra=(), first=()) -> Column:
    yes = lambda names: [F.lit(n != failed).alias(n) for n in names]
    each = F.transform(units, lambda u: F.struct(u.alias("unit_id"), *yes(unit_checks), F.lit("x").alias("rationale")))
    return F.to_json(F.struct(*first, each.alias("unit_checks"), *yes(checks), F.lit(overall).alias("overall"), F.array().cast("array<string>").alias("failures"), *extra))


def gate_verification(spark, sf_dir):
    """Verifications of every family: a sound one, four defects, and an honest failure."""
    context = gates.family_context(_analysis(spark, sf_dir))
    body = lambda units=F.col("unit_ids"), **how: _verdict(units, gates.UNIT_BOOLEANS, gates.FAMILY_BOOLEANS, first=[F.col("family_id")], **how)
    bodies = [body(), body(extra=[F.lit(1).alias("surplus")]), body(F.slice("unit_ids", 1, 1)), body(failed="no_meaning_shift"), body(failed="hard_anchors_preserved"), body(failed="no_meaning_shift", overall="failed")]
    return _judged(gates.verifications, bodies, context)


def gate_global(spark, sf_dir):
    """Reviews of whole documents: a sound one, three defects, and an honest failure."""
    units = _analysis(spark, sf_dir).units
    context = units.groupBy("doc_id").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))
    body = lambda units=F.col("unit_ids"), **how: _verdict(units, gates.GLOBAL_UNIT_BOOLEANS, gates.GLOBAL_BOOLEANS, **how)
    bodies = [body(), body(extra=[F.lit(1).alias("surplus")]), body(F.slice("unit_ids", 2, F.size("unit_ids"))), body(failed="evidence_preserved"), body(failed="evidence_preserved", overall="failed")]
    return _judged(gates.global_verifications, bodies, context, units)


def paragraph_units(spark, sf_dir):
    """Places of the sentences where every line is a paragraph and the first heading depends on the document."""
    titles = F.array(*map(F.lit, ledger.TITLES))
    rows = _docs(spark, sf_dir)
    text = F.concat(F.lit("# "), F.get(titles, F.pmod("doc_id", F.lit(7)).cast("int")), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = ledger.admit(rows.select("doc_id", text.alias("text")))[0]
    named = ledger.document_title(ledger.sections(docs))
    return ledger.units(docs).select("doc_id", "ord", "paragraph_index", "sentence_index", "char_start", "char_end").join(named, "doc_id")


def staged_views(spark, sf_dir):
    """Rows of each of the nine views of a run, a row a document and view."""
    a = _analysis(spark, sf_dir)
    views = {
        "1 read": a.documents, "2 ledger": a.units, "3 recurrences": a.families, "4 classify": a.decisions, "5 centres": a.choice, "6 plan": a.plan, "7 pass": transact.prepare(a), "8 verify": a.invariants,
        "9 report": a.complexity,
    }
    out = None
    for name, table in views.items():
        rows = table.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("view"), "n")
        out = rows if out is None else out.union(rows)
    return out


def section_units(spark, sf_dir):
    return _units(spark, sf_dir).groupBy("doc_id", "section_title").agg(F.count("*").alias("n_units"))


_QUERIES = [
    admit_documents, sections, doc_title, resource_plan, normalize_units, unit_ledger, unit_offsets, unit_tokens, discourse_role, local_function, anchors_numbers, anchors_quotations, anchors_citations,
    anchors_terms, content_concepts, pair_evidence, candidate_edges, degree, exact_repeat_families, families, family_labels, family_evidence, family_means, centre_scores, centre_choice, unit_decisions,
    disposition_counts, family_risk, family_plan, analysis_invariants, complexity, transactions, compare_view, safe_pass_documents, global_report, conservation_ledger, certification, pass_metrics, previous_pass,
    continuation, pass_instability, canonical_hashes, word_counts, rounding, gate_adjudication, gate_proposal, gate_verification, gate_global, staged_views, section_units, paragraph_units, prose_family_plan, prose_transactions, prose_safe_pass,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLES | RECURRING
