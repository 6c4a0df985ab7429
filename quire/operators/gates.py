"""Strict validators of model messages: raw JSON tables against the analysis they speak about.

Every gate takes messages ``doc_id, family_id, body`` and returns them, whatever other columns they have, with the parsed
message ``m`` and ``error``: null for an accepted message, else the first rule that it breaks, in a fixed order. A body that is no JSON of the expected shape is an error of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.analysis import Analysis
from .ledger import anchors

OCCURRENCE = (
    "struct<unit_id:string,semantic_relation:string,local_function:string,disposition:string,duplicated_payload:array<string>,unique_residual_payload:array<string>,"
    "hard_anchor_risk:array<string>,rationale:string>"
)
ADJUDICATION = f"struct<family_id:string,theme_label:string,shared_payload:array<string>,centre_section:string,centre_rationale:string,occurrences:array<{OCCURRENCE}>,unresolved_questions:array<string>>"
DONOR = (
    "struct<unit_id:string,source_text_sha256:string,original_text:string,duplicated_payload:array<string>,unique_residual_payload:array<string>,local_function:string,"
    "grammatical_dependencies:array<string>,hard_anchors:array<string>,disposition:string,proposed_repair:string>"
)
RECEIVER = (
    "struct<unit_id:string,source_text_sha256:string,original_text:string,incoming_payload:array<string>,proposed_text:string,"
    "provenance:array<struct<source_unit_id:string,integrated_payload:array<string>>>>"
)
PROPOSAL = f"struct<family_id:string,centre_section:string,donors:array<{DONOR}>,receiver:{RECEIVER},changed_unit_ids:array<string>,unresolved_questions:array<string>>"
UNIT_BOOLEANS = ["original_payload_covered", "unique_residual_covered", "local_function_preserved", "hard_anchors_preserved"]
FAMILY_BOOLEANS = ["receiver_complete", "no_new_duplication", "no_meaning_shift", "narrative_continuity"]
GLOBAL_UNIT_BOOLEANS = ["disposition_confirmed", "semantic_payload_preserved", "unique_content_preserved", "local_function_preserved", "hard_anchors_preserved"]
GLOBAL_BOOLEANS = [
    "evidence_preserved", "qualifications_preserved", "exceptions_preserved", "hard_anchors_preserved", "cross_references_resolve", "gravity_centres_coherent",
    "no_new_accidental_redundancy", "narrative_continuity",
]


def _booleans(names: list[str]) -> str:
    return ",".join(f"{n}:boolean" for n in names)


VERIFICATION = f"struct<family_id:string,unit_checks:array<struct<unit_id:string,{_booleans(UNIT_BOOLEANS)},rationale:string>>,{_booleans(FAMILY_BOOLEANS)},overall:string,failures:array<string>>"
GLOBAL_VERIFICATION = f"struct<unit_checks:array<struct<unit_id:string,{_booleans(GLOBAL_UNIT_BOOLEANS)},rationale:string>>,{_booleans(GLOBAL_BOOLEANS)},overall:string,failures:array<string>>"


def _keys(schema: str) -> list[str]:
    """Names of the top fields of a struct's text."""
    depth, out, word = 0, [], ""
    for c in schema[len("struct<") : -1] + ",":
        if c == "," and not depth:
            out.append(word.split(":")[0])
            word = ""
            continue
        depth += (c == "<") - (c == ">")
        word += c
    return sorted(out)


def _parse(messages: DataFrame, schema: str) -> DataFrame:
    keys = F.array_sort(F.json_object_keys("body"))
    exact = F.coalesce(keys == F.array(*map(F.lit, _keys(schema))), F.lit(False))
    return messages.withColumn("m", F.from_json("body", schema)).withColumn("exact", exact)


def _differ(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def _twice(a: Column) -> Column:
    return F.size(a) != F.size(F.array_distinct(a))


def _listed(a: Column) -> Column:
    return F.when(F.size(a) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(F.array_sort(a), "', '"), F.lit("']")))


# The texts of the rules below.
def _first(*rules: tuple[Column, Column | str]) -> Column:
    """The text of the first rule that a message breaks; a rule that can't be evaluated is a broken shape."""
    out = [F.when(F.coalesce(broken, F.lit(True)), F.lit(text) if isinstance(text, str) else text) for broken, text in rules]
    return F.coalesce(*out).alias("error")


def family_context(a: Analysis) -> DataFrame:
    """``doc_id, family_id, unit_ids, members, titles``: what the gates need to know of each family; too much to be joined on the driver."""
    member = F.struct("unit_id", "section_title", "text", anchors().alias("anchors"))
    own = a.family_units.groupBy("doc_id", "family_id").agg(F.array_sort(F.collect_list(F.struct("ord", member.alias("u")))).alias("x"))
    titles = a.sections.groupBy("doc_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    return own.select("doc_id", "family_id", F.col("x.u.unit_id").alias("unit_ids"), F.col("x.u").alias("members"), F.map_from_entries(F.transform("x.u", lambda u: F.struct(u["unit_id"], u))).alias("by_id")).join(titles, "doc_id").hint("merge")


def adjudications(messages: DataFrame, context: DataFrame) -> DataFrame:
    rows = _parse(messages, ADJUDICATION).join(context, ["doc_id", "family_id"])
    ids, expected = F.col("m.occurrences.unit_id"), F.col("unit_ids")
    mismatch = F.concat(F.lit("Adjudication ledger mismatch; missing="), _listed(F.array_except(expected, ids)), F.lit(", extra="), _listed(F.array_except(ids, expected)))
    removal = F.exists("m.occurrences", lambda o: (o["disposition"] == "remove_fully_redundant") & (F.size(o["unique_residual_payload"]) > 0))
    risky = F.exists("m.occurrences", lambda o: (F.size(o["hard_anchor_risk"]) > 0) & ~o["disposition"].isin("preserve_in_place", "human_review"))
    # rules on occurrences are tried occurrence by occurrence: the earlier one decides
    first_removal = F.array_position(F.transform("m.occurrences", lambda o: (o["disposition"] == "remove_fully_redundant") & (F.size(o["unique_residual_payload"]) > 0)), True)
    first_risk = F.array_position(F.transform("m.occurrences", lambda o: (F.size(o["hard_anchor_risk"]) > 0) & ~o["disposition"].isin("preserve_in_place", "human_review")), True)
    full, risk = "Model proposed full removal while unique residual payload remains", "Risked hard anchors require preservation or human review"
    error = _first(
        (~F.col("exact"), "Adjudication keys do not match the strict contract"),
        (_twice(ids), "Adjudication contains duplicate occurrence IDs"),
        (_differ(ids, expected), mismatch),
        (removal & (~risky | (first_removal <= first_risk)), full),
        (risky, risk),
        (F.col("m.family_id") != F.col("family_id"), "Adjudication returned the wrong family ID"),
        (~F.array_contains("titles", F.col("m.centre_section")), "Adjudication selected a gravity centre that does not exist"),
        (~F.exists("members", lambda u: u["section_title"] == F.col("m.centre_section")), "Adjudication selected a gravity centre with no family occurrence"),
    )
    return rows.select(*messages.columns, "m", error)


def proposals(messages: DataFrame, context: DataFrame) -> DataFrame:
    rows = _parse(messages, PROPOSAL).join(context, ["doc_id", "family_id"])
    donors, receiver, by_id = F.col("m.donors"), F.col("m.receiver"), F.col("by_id")
    unit = lambda i: F.try_element_at(by_id, i)
    bound = lambda r: (r["original_text"] == unit(r["unit_id"])["text"]) & (r["source_text_sha256"] == F.sha2(unit(r["unit_id"])["text"], 256))
    unbound = F.get(F.concat(F.transform(F.filter(donors, lambda d: ~F.coalesce(bound(d), F.lit(False))), lambda d: d["unit_id"]), F.when(~F.coalesce(bound(receiver), F.lit(False)), F.array(receiver["unit_id"])).otherwise(F.array().cast("array<string>"))), F.lit(0))
    stray = F.filter(donors, lambda d: ~F.coalesce(F.array_sort(d["hard_anchors"]) == unit(d["unit_id"])["anchors"], F.lit(False)))
    full = F.exists(donors, lambda d: (d["disposition"] == "remove_fully_redundant") & (F.size(d["unique_residual_payload"]) > 0))
    first_full = F.array_position(F.transform(donors, lambda d: (d["disposition"] == "remove_fully_redundant") & (F.size(d["unique_residual_payload"]) > 0)), True)
    first_stray = F.array_position(F.transform(donors, lambda d: ~F.coalesce(F.array_sort(d["hard_anchors"]) == unit(d["unit_id"])["anchors"], F.lit(False))), True)
    changed = F.array_distinct(F.concat(donors["unit_id"], F.when(receiver["proposed_text"] != receiver["original_text"], F.array(receiver["unit_id"])).otherwise(F.array().cast("array<string>"))))
    removal = "Full removal is forbidden while residual payload remains"
    error = _first(
        (~F.col("exact") | (F.col("m.family_id") != F.col("family_id")), "Rewrite proposal does not match the family contract"),
        (_twice(donors["unit_id"]) | (F.size(F.array_except(donors["unit_id"], "unit_ids")) > 0), "Rewrite proposal contains invalid or duplicate donor IDs"),
        (~F.array_contains("unit_ids", receiver["unit_id"]), "Rewrite receiver is outside the recurrence family"),
        (unit(receiver["unit_id"])["section_title"] != F.col("m.centre_section"), "Rewrite receiver is outside the selected gravity centre"),
        (unbound.isNotNull(), F.concat(F.lit("Source binding failed for "), unbound)),
        (full & ((first_stray == 0) | (first_full < first_stray)), removal),
        (F.size(stray) > 0, F.concat(F.lit("Hard-anchor inventory mismatch for "), F.get(stray["unit_id"], F.lit(0)))),
        (_differ(F.col("m.changed_unit_ids"), changed), "changed_unit_ids does not match the actual proposal scope"),
    )
    return rows.select(*messages.columns, "m", error)


def _all_true(checks: Column, names: list[str]) -> Column:
    def sound(c: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.coalesce(c[n], F.lit(False))
        return out

    return F.forall(checks, sound)


def verifications(messages: DataFrame, context: DataFrame) -> DataFrame:
    rows = _parse(messages, VERIFICATION).join(context, ["doc_id", "family_id"])
    ids, sound = F.col("m.unit_checks.unit_id"), _all_true(F.col("m.unit_checks"), UNIT_BOOLEANS)
    for n in FAMILY_BOOLEANS:
        sound = sound & F.coalesce(F.col(f"m.{n}"), F.lit(False))
    error = _first(
        (~F.col("exact") | (F.col("m.family_id") != F.col("family_id")), "Semantic verification does not match the family contract"),
        (_differ(ids, F.col("unit_ids")) | _twice(ids), "Semantic verification does not reconcile every family unit exactly once"),
        ((F.col("m.overall") == "passed") & (~sound | (F.size("m.failures") > 0)), "Semantic verifier claimed pass despite a failed check"),
    )
    return rows.select(*messages.columns, "m", error)


def global_verifications(messages: DataFrame, units: DataFrame) -> DataFrame:
    """messages: ``doc_id, body``; units: those of the original documents."""
    expected = units.groupBy("doc_id").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))
    rows = _parse(messages, GLOBAL_VERIFICATION).join(expected, "doc_id")
    ids, sound = F.col("m.unit_checks.unit_id"), _all_true(F.col("m.unit_checks"), GLOBAL_UNIT_BOOLEANS)
    for n in GLOBAL_BOOLEANS:
        sound = sound & F.coalesce(F.col(f"m.{n}"), F.lit(False))
    mismatch = F.concat(F.lit("Global semantic ledger mismatch; missing="), _listed(F.array_except("unit_ids", ids)), F.lit(", extra="), _listed(F.array_except(ids, F.col("unit_ids"))))
    error = _first(
        (~F.col("exact"), "Global semantic verification keys do not match the strict contract"),
        (_twice(ids) | _differ(ids, F.col("unit_ids")), mismatch),
        ((F.col("m.overall") == "passed") & (~sound | (F.size("m.failures") > 0)), "Global semantic verifier claimed pass despite a failed check"),
    )
    return rows.select(*messages.columns, "m", error)


def response_text(response: Column) -> tuple[Column, Column]:
    """(text, error) of a raw model response: its output text, the first text part of a message, or why there is none."""
    parsed = F.from_json(response, "struct<output_text:string,output:array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>>")
    parts = F.flatten(F.transform(F.filter(parsed["output"], lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string,refusal:string>>"))))
    telling = F.get(F.filter(parts, lambda p: (p["type"] == "refusal") | ((p["type"] == "output_text") & p["text"].isNotNull())), F.lit(0))
    text = F.coalesce(parsed["output_text"], F.when(telling["type"] == "output_text", telling["text"]))
    error = F.when(text.isNull(), F.when(telling["type"] == "refusal", F.concat(F.lit("Model refusal: "), F.coalesce(telling["refusal"], F.lit("unspecified")))).otherwise("The response holds no structured output text"))
    return text, error


def request(model: str, schema_name: str, schema: str, instruction: str, payload: Column, effort: str = "high") -> Column:
    """A strict request: nothing is stored, two messages, output bound to the schema."""
    form = F.struct(F.struct(F.lit("json_schema").alias("type"), F.lit(schema_name).alias("name"), F.lit(True).alias("strict"), F.lit(schema).alias("schema")).alias("format"))
    messages = F.array(F.struct(F.lit("developer").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), F.to_json(payload).alias("content")))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(False).alias("store"), F.struct(F.lit(effort).alias("effort")).alias("reasoning"), messages.alias("input"), form.alias("text")))
