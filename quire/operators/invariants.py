"""Checks and measures of an analysis: invariants, status, complexity, pass metrics and the continuation rule."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROTECTED
from ..functions import text as T

CHECKS = (
    "stable_unique_unit_ids", "all_family_occurrences_have_one_decision", "every_family_has_a_gravity_centre", "protected_occurrences_are_not_removed",
    "uncertain_occurrences_fail_closed", "no_automatic_deletion_before_rewrite_verification",
)


def invariants(documents: DataFrame, units: DataFrame, plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """Six checks, warnings and the status of each document."""
    own = units.groupBy("doc_id").agg((F.count("*") == F.count_distinct("unit_id")).alias(CHECKS[0]))
    once = decisions.groupBy("doc_id", "unit_id").agg(F.count("*").alias("n")).groupBy("doc_id").agg((F.max("n") == 1).alias(CHECKS[1]))
    centred = plan.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("centre") != "", F.lit(False))).alias(CHECKS[2]), F.count("*").alias("families"))
    removed, weak = F.col("disposition") == "remove_fully_redundant", F.col("relation").isin("uncertain", "related_non_duplicate")
    safe = decisions.groupBy("doc_id").agg(
        F.bool_and(~(F.col("function").isin(*PROTECTED) & removed)).alias(CHECKS[3]), F.bool_and(~weak | (F.col("disposition") == "human_review")).alias(CHECKS[4]),
        F.bool_and(~removed).alias(CHECKS[5]), F.count_if(F.col("disposition") == "human_review").alias("reviews"),
    )
    rows = documents.select("doc_id")
    for table in (own, once, centred, safe):
        rows = rows.join(table.hint("merge"), "doc_id", "left")
    rows = rows.select("doc_id", *(F.coalesce(c, F.lit(True)).alias(c) for c in CHECKS), F.coalesce("families", F.lit(0)).alias("families"), F.coalesce("reviews", F.lit(0)).alias("reviews"))
    sound = F.lit(True)
    for c in CHECKS:
        sound = sound & F.col(c)
    warnings = F.array_compact(F.array(
        F.when(F.col("reviews") > 0, F.concat(F.col("reviews").cast("string"), F.lit(" occurrence decision(s) require human or model-assisted adjudication."))),
        F.when(F.col("families") == 0, "No recurrence family crossed the conservative candidate threshold."),
        F.when(~sound, "At least one structural invariant failed."),
    ))
    status = F.when(~sound, "NOT_VERIFIED").when(F.col("reviews") > 0, "ANALYSIS_COMPLETE_REWRITE_WITHHELD").otherwise("ANALYSIS_VERIFIED_REWRITE_NOT_YET_RUN")
    return rows.select("doc_id", *CHECKS, "families", "reviews", warnings.alias("warnings"), status.alias("status"))


def complexity(documents: DataFrame, resource_plan: DataFrame, sections: DataFrame, units: DataFrame, plan: DataFrame) -> DataFrame:
    """Complexity index of each document and the passes it plans for."""
    n_sections = sections.groupBy("doc_id").agg(F.count("*").alias("s"))
    n_units = units.groupBy("doc_id").agg(F.count("*").alias("u"))
    spread = plan.join(n_sections, "doc_id").withColumn("part", F.expr("CASE WHEN s > 1 THEN greatest(0, size(sections) - 1) / CAST(s - 1 AS DOUBLE) ELSE 0D END"))
    own = spread.groupBy("doc_id").agg(F.sum("n_members").alias("members"), F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    shared = plan.select("doc_id", F.explode("unit_ids").alias("unit_id")).groupBy("doc_id", "unit_id").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("shared"))
    rows = documents.select("doc_id").join(resource_plan.select("doc_id", "context_pressure"), "doc_id")
    for table in (n_sections, n_units, own, shared):
        rows = rows.join(table.hint("merge"), "doc_id", "left")
    mean = F.when(F.size("parts") > 0, F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"]) / F.size("parts")).otherwise(F.lit(0.0))
    units_n = "CAST(greatest(1, coalesce(u, 0)) AS DOUBLE)"
    rows = rows.select(
        "doc_id", F.expr("least(1D, context_pressure)").alias("context"), F.expr("least(1D, greatest(0, coalesce(s, 0) - 1) / 20D)").alias("sect"),
        F.expr(f"least(1D, coalesce(members, 0) / {units_n})").alias("density"), F.coalesce(mean, F.lit(0.0)).alias("dispersion"), F.expr(f"least(1D, coalesce(shared, 0) / {units_n})").alias("dependency"),
    ).withColumn("idx", F.expr("0.3D * context + 0.2D * sect + 0.25D * density + 0.15D * dispersion + 0.1D * dependency"))
    i = F.col("idx")
    passes = F.when(i <= 0.2, 1).when(i <= 0.4, 2).when(i <= 0.6, 3).when(i <= 0.8, 4).otherwise(5)
    why = F.concat(
        F.lit("Initial cap "), passes.cast("string"), F.lit(": context pressure "), T.percent(F.col("context")), F.lit(", section complexity "), T.percent(F.col("sect")), F.lit(", recurrence density "),
        T.percent(F.col("density")), F.lit(", thematic dispersion "), T.percent(F.col("dispersion")), F.lit(", cross-family dependency "), T.percent(F.col("dependency")),
        F.lit(". The cap is adaptive and may stop early; it is never a mandatory rewrite count."),
    )
    return rows.select(
        "doc_id", T.rounded("context", "context_pressure"), T.rounded("sect", "section_complexity"), T.rounded("density", "repetition_density"), T.rounded("dispersion", "thematic_dispersion"),
        T.rounded("dependency", "cross_section_dependency"), T.rounded("idx", "complexity_index"), passes.alias("planned_passes"), why.alias("rationale"),
    )


def _unlikeness(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in frames:
        yield pd.Series([0.0 if x == y else 1.0 - difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def instability(before: Column, after: Column) -> Column:
    """One less the Ratcliff-Obershelp similarity of two texts. Spark has none, so Arrow batches go to Python's."""
    return F.pandas_udf(_unlikeness, "double")(before, after)


def pass_metrics(passes: DataFrame, units: DataFrame, decisions: DataFrame, measured: DataFrame) -> DataFrame:
    """Metrics of a pass.

    passes: ``doc_id, pass_number, previous_document, current_document, accounted, total, critical_failures``; units and
    decisions are those of the current document, measured its complexity.
    """
    mass = units.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("mass"))
    loose = decisions.groupBy("doc_id").agg(
        F.sum(F.when(F.col("disposition").isin("merge_into_centre", "remove_fully_redundant"), F.col("n_tokens")).otherwise(0)).alias("redundant"),
        F.count_if(F.col("disposition") == "human_review").alias("unresolved"),
    )
    rows = passes.join(mass, "doc_id", "left").join(loose, "doc_id", "left").join(measured.select("doc_id", "thematic_dispersion"), "doc_id", "left")
    rows = rows.withColumn("burden", F.expr("coalesce(redundant, 0) / CAST(greatest(1, coalesce(mass, 0)) AS DOUBLE)")).withColumn("cover", F.expr("accounted / CAST(greatest(1, total) AS DOUBLE)"))
    rows = rows.withColumn("change", instability(F.col("previous_document"), F.col("current_document")))
    return rows.select(
        "doc_id", "pass_number", T.rounded("burden", "repetition_burden"), T.rounded("cover", "substantive_ledger_coverage"), "thematic_dispersion", T.rounded("change", "pass_instability"),
        F.coalesce("unresolved", F.lit(0)).alias("unresolved_occurrences"), "critical_failures",
    )


# The messages that a continuation decision carries.
REASONS = {
    "STOP_NOT_VERIFIED": "A critical invariant or ledger-coverage check failed; the document must roll back or enter human review.",
    "STOP_HUMAN_REVIEW": "Expected consolidation benefit no longer exceeds the measured conservation risk.",
    "STOP_STABLE": "No material accidental recurrence remains and the complete ledger is reconciled.",
    "STABLE_CHANGE": "Change instability is below 2% and marginal burden improvement is below 1%.",
    "STOP_SAFETY_CAP": "The absolute five-pass safety cap was reached with unresolved work; certification is withheld.",
    "ADD_PASS": "Unresolved dispersion remains after the initial plan; one bounded pass was added.",
    "CONTINUE": "Material recurrence remains, ledger coverage is complete, and expected benefit exceeds conservation risk.",
}


def with_previous(metrics: DataFrame) -> DataFrame:
    """Pass metrics with ``previous_burden``, the burden of the document's pass before; null for its first."""
    before = F.lag("repetition_burden").over(Window.partitionBy("doc_id").orderBy("pass_number"))
    return metrics.withColumn("previous_burden", before)


def continuation(metrics: DataFrame) -> DataFrame:
    """Whether another pass is due.

    metrics: pass metrics with ``initially_planned, conservation_risk, expected_benefit`` and the burden of the pass
    before, ``previous_burden`` (null for none; ``with_previous`` finds it).
    """
    planned = F.least(F.lit(5), F.greatest(F.lit(1), "initially_planned"))
    left = (F.col("unresolved_occurrences") > 0) | (F.col("repetition_burden") > 0)
    key = (
        F.when((F.size("critical_failures") > 0) | (F.col("substantive_ledger_coverage") < 1), "STOP_NOT_VERIFIED")
        .when(F.col("conservation_risk") >= F.col("expected_benefit"), "STOP_HUMAN_REVIEW")
        .when((F.col("unresolved_occurrences") == 0) & (F.col("repetition_burden") == 0), "STOP_STABLE")
        .when(F.col("previous_burden").isNotNull() & (F.col("pass_instability") < 0.02) & (F.col("previous_burden") - F.col("repetition_burden") < 0.01), "STABLE_CHANGE")
        .when(F.col("pass_number") >= 5, "STOP_SAFETY_CAP")
        .when((F.col("pass_number") >= planned) & left, "ADD_PASS")
        .otherwise("CONTINUE")
    )
    rows = metrics.withColumn("key", key).withColumn("planned", F.when(F.col("key") == "ADD_PASS", F.least(F.lit(5), planned + 1)).otherwise(planned))
    remaining = F.when(F.col("key").isin("ADD_PASS", "CONTINUE"), F.greatest(F.lit(0), F.col("planned") - F.col("pass_number"))).otherwise(0)
    reason = F.coalesce(*(F.when(F.col("key") == k, F.lit(v)) for k, v in REASONS.items()))
    action = F.when(F.col("key") == "STABLE_CHANGE", "STOP_STABLE").otherwise(F.col("key"))
    return rows.select("doc_id", "pass_number", action.alias("action"), F.col("planned").alias("passes_initially_planned"), remaining.alias("estimated_passes_remaining"), reason.alias("reason"))
