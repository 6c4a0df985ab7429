"""Where a recurring statement belongs, what becomes of each occurrence, and how risky that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CENTRE_FIT, PROTECTED, RATIONALES
from ..functions import text as T


def _fit(function: Column) -> Column:
    return F.coalesce(*(F.when(function == k, F.lit(v)) for k, v in CENTRE_FIT.items()))


def centre_scores(family_units: DataFrame, families: DataFrame) -> DataFrame:
    """A row for each (family, section title): how well the section could hold the canonical treatment."""
    spread = families.select("doc_id", "emission", F.size("sections").alias("n_sections"))
    by = family_units.groupBy("doc_id", "emission", "family_id", "section_title").agg(
        F.max(_fit(F.col("function"))).alias("fit"),
        F.sum(F.size("tokens")).alias("mass"),
        F.max((F.col("function") == "evidentiary").cast("int")).alias("evidence"),
        F.count("*").alias("n"),
        F.min(F.struct("char_start", "ord")).alias("first"),
        F.max_by("function", F.struct(_fit(F.col("function")), -F.col("char_start"), -F.col("ord"))).alias("strongest"),
    )
    score = (
        "0.35D * fit + 0.25D * least(1D, mass / 45D) + 0.15D * (CASE WHEN evidence = 1 THEN 1D ELSE 0.45D END)"
        " + 0.15D * (CASE WHEN n > 1 THEN 1D ELSE 0.65D END) + 0.1D * (1D / (1 + greatest(0, n_sections - 1)))"
    )
    return by.join(spread, ["doc_id", "emission"]).withColumn("raw", F.expr(score)).select("doc_id", "emission", "family_id", "section_title", T.rounded("raw", "score"), "first", "strongest")


def centre_choice(scores: DataFrame) -> DataFrame:
    """The best section of each family and the runner-up; ties go to the section that comes first."""
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "emission").orderBy(F.desc("score"), "first")))
    best, second = F.col("place") == 1, F.col("place") == 2
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    return ranked.groupBy("doc_id", "emission", "family_id").agg(
        pick(best, "section_title").alias("centre"), pick(best, "score").alias("centre_score"), pick(best, "strongest").alias("strongest"),
        pick(second, "section_title").alias("competing_centre"), pick(second, "score").alias("competing_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_title", "score")))).alias("scores"),
    )


def relation(score: Column) -> Column:
    """Bands of the unrounded mean."""
    return (
        F.when(score >= 0.92, "exact_equivalent").when(score >= 0.68, "paraphrase_equivalent").when(score >= 0.50, "partial_overlap")
        .when(score >= 0.43, "uncertain").otherwise("related_non_duplicate")
    )


def unit_means(pairs: DataFrame) -> DataFrame:
    """Mean composite of each member's pairs, summed in the order of the other member."""
    ends = pairs.select("doc_id", "emission", F.col("left_ord").alias("ord"), F.col("right_ord").alias("other"), "composite").union(
        pairs.select("doc_id", "emission", F.col("right_ord").alias("ord"), F.col("left_ord").alias("other"), "composite")
    )
    listed = ends.groupBy("doc_id", "emission", "ord").agg(F.array_sort(F.collect_list(F.struct("other", "composite"))).alias("x"))
    return listed.select("doc_id", "emission", "ord", (F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v["composite"]) / F.size("x")).alias("mean"))


def decisions(family_units: DataFrame, pairs: DataFrame, choice: DataFrame) -> DataFrame:
    """A row for each occurrence: relation, disposition, confidence, rationale and what only it says."""
    words = family_units.select("doc_id", "emission", "ord", F.explode("content").alias("word"))
    alone = words.groupBy("doc_id", "emission", "word").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).filter("n = 1")
    residual = alone.groupBy("doc_id", "emission", "ord").agg(F.array_sort(F.collect_list("word")).alias("residual"))
    same = F.count("*").over(Window.partitionBy("doc_id", "emission", "normalized_text"))
    rows = family_units.withColumn("twins", same).join(unit_means(pairs), ["doc_id", "emission", "ord"]).join(residual, ["doc_id", "emission", "ord"], "left")
    rows = rows.join(choice.select("doc_id", "emission", "centre"), ["doc_id", "emission"]).withColumn("residual", F.coalesce("residual", F.array().cast("array<string>")))
    band = relation(F.col("mean"))
    rows = rows.withColumn("relation", F.when((band == "paraphrase_equivalent") & (F.col("twins") == 1) & (F.size("residual") >= 3), "partial_overlap").otherwise(band))
    weak, rel = F.col("relation").isin("uncertain", "related_non_duplicate"), F.col("relation")
    case = [
        (F.col("function").isin(*PROTECTED), "preserve_in_place", "protected"), (weak, "human_review", "weak"), (F.col("section_title") == F.col("centre"), "preserve_in_place", "centre"),
        (F.col("function").isin("summary", "conclusive"), "preserve_in_place", "echo"), (rel == "partial_overlap", "human_review", "partial"),
    ]
    first = lambda k, last: F.coalesce(*(F.when(c[0], F.lit(c[k] if k == 1 else RATIONALES[c[2]])) for c in case), F.lit(last))
    return rows.select(
        "doc_id", "emission", "family_id", "ord", "unit_id", "section_title", "centre", "relation", "function", first(1, "merge_into_centre").alias("disposition"),
        T.rounded("mean", "confidence"), first(2, RATIONALES["merge"]).alias("rationale"), F.col("residual").alias("unique_residual_tokens"), F.size("tokens").alias("n_tokens"),
    )


def plan(families: DataFrame, found: DataFrame, choice: DataFrame, counts: DataFrame) -> DataFrame:
    """Families with centre, risk, rationale and their order in the document.

    counts: ``doc_id, n_sections, n_units``. The order is by risk, size and emission.
    """
    shares = found.groupBy("doc_id", "emission").agg(
        F.count("*").alias("n"), F.sum((F.col("relation") == "partial_overlap").cast("int")).alias("partial"), F.sum((F.col("disposition") == "human_review").cast("int")).alias("review")
    )
    rows = families.join(choice, ["doc_id", "emission", "family_id"]).join(shares, ["doc_id", "emission"]).join(counts, "doc_id")
    risk = "0.3D * (partial / n) + 0.25D * (size(sections) / CAST(greatest(1, n_sections) AS DOUBLE)) + 0.25D * (review / n) + 0.2D * least(1D, n / CAST(greatest(2, n_units) AS DOUBLE))"
    rows = rows.withColumn("raw", F.expr(risk)).withColumn("risk_score", T.rounded("raw"))
    band = F.when(F.col("risk_score") < 0.25, "low").when(F.col("risk_score") < 0.5, "moderate").otherwise("high")
    two = lambda c: T.two_places(F.col(c))
    rival = F.when(F.col("competing_centre").isNull(), " It is the only functionally competent candidate section.").otherwise(
        F.concat(F.lit(" It scored "), two("centre_score"), F.lit(" versus "), two("competing_score"), F.lit(" for "), "competing_centre", F.lit("."))
    )
    why = F.concat(
        "centre", F.lit(" has the strongest "), F.translate("strongest", "_", " "), F.lit(" role fit and can host the canonical treatment."), rival,
        F.lit(" Redistribution risk is "), band, F.lit(" ("), two("risk_score"), F.lit("); protected and uncertain occurrences remain outside the centre."),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("risk_score", "n", "emission"))
    return rows.select(
        "doc_id", place.alias("place"), "emission", "family_id", "label", "unit_ids", "sections", "centre", "centre_score", "competing_centre", "competing_score", "scores", "risk_score", band.alias("risk_band"),
        why.alias("rationale"), F.col("n").alias("n_members"),
    )
