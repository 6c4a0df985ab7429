"""Where documents come from and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import API_CONTEXT_LIMIT, MAX_BYTES
from ..plans.analysis import Analysis

#: Most bytes of a JSON request.
MAX_REQUEST = 5_100_000
#: The same limits that requests have by default.
OPTIONS = "struct<text:string,context_limit:int,safety_ratio:double,candidate_threshold:double>"

SAMPLE = "# Background\n\nEvery result is checked twice.\n\n# Analysis\n\nEvery result is checked twice. The second check is independent."


def files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text``: each file is one document; ids are hashes of the path and so don't depend on the order."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def requests(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with options, rejects) of JSON requests ``doc_id, body``.

    A body must be a JSON object of 1 to 5,100,000 bytes with a string ``text`` that is not blank and has at most
    5,000,000 bytes in UTF-8.
    """
    m = F.from_json("body", OPTIONS)
    kind = F.substring(F.ltrim("body"), 1, 1)
    text_is_string = F.regexp_like(F.coalesce(F.get_json_object("body", "$.text"), F.lit("")), F.lit(r"(?s).*")) & F.array_contains(F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")), "text")
    reason = (
        F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "request is empty").when(F.octet_length("body") > MAX_REQUEST, "request is too large")
        .when((kind != "{") | F.json_object_keys("body").isNull(), "request is no JSON object").when(~text_is_string | F.trim("m.text").isNull() | (F.regexp_replace("m.text", r"\s", "") == ""), "text must be a non-empty string")
        .when(F.octet_length("m.text") > MAX_BYTES, "text is too large")
    )
    judged = bodies.withColumn("m", m).withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(
        "doc_id", "m.text", F.coalesce("m.context_limit", F.lit(API_CONTEXT_LIMIT)).alias("context_limit"), F.coalesce("m.safety_ratio", F.lit(0.6)).alias("safety_ratio"),
        F.coalesce("m.candidate_threshold", F.lit(0.43)).alias("candidate_threshold"),
    )
    return good, judged.filter("reason IS NOT NULL").select("doc_id", "reason")


def tables(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents of a Parquet table."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """A document for each conversation: its turns are sections named after their roles."""
    turn = F.struct("turn", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("part"))
    rows = spark.read.parquet(path).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("doc_id", F.array_join("turns.part", "\n\n").alias("text"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A document for each web page: headings become headings, paragraphs paragraphs, other tags go."""
    html = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    html = F.regexp_replace(html, r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\n\n# $2\n\n")
    html = F.regexp_replace(F.regexp_replace(html, r"(?is)</?(p|div|li|tr|br)[^>]*>", "\n\n"), r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return spark.read.parquet(path).select(F.col("page_id").alias("doc_id"), html.alias("text"))


def results(a: Analysis) -> DataFrame:
    """``doc_id, result``: the whole analysis of each document as JSON."""
    units = a.units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "unit_id", "text", "normalized_text", "section_id", "section_title", "paragraph_index", "sentence_index", "char_start", "char_end", "role", "function", "numbers", "quotations", "citations", "defined_terms", "tokens"))).alias("units"))
    sections = a.sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_ord", "section_id", "title", "level"))).alias("sections"))
    decisions = a.decisions.groupBy("doc_id", "emission").agg(F.array_sort(F.collect_list(F.struct("ord", "unit_id", "relation", "function", "disposition", "confidence", "rationale", "unique_residual_tokens"))).alias("decisions"))
    families = a.plan.join(decisions, ["doc_id", "emission"])
    families = families.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "family_id", "label", "unit_ids", "sections", "centre", "centre_score", "competing_centre", "competing_score", "risk_score", "rationale", F.to_json("scores").alias("scores"), "decisions"))).alias("families"))
    rows = a.documents.select("doc_id").join(sections, "doc_id", "left").join(units, "doc_id", "left").join(families, "doc_id", "left").join(a.resource_plan, "doc_id").join(a.invariants.drop("families", "reviews"), "doc_id")
    return rows.select("doc_id", F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("result"))


def write_results(a: Analysis, path: str) -> None:
    """One JSON object a line."""
    results(a).select(F.col("result").alias("value")).write.text(path)


#: What a document must show before it is published.
RELEASE = {
    "eligible": "eligible", "label": "label = 'VERIFIED'", "ledger_covered": "ledger_coverage = 1", "nothing_unresolved": "unresolved_occurrences = 0", "no_anchor_lost": "size(missing_hard_anchors) = 0",
    "semantic_passed": "semantic_status = 'PASSED'", "repaired": "repairs > 0",
}


def release_gate(documents: DataFrame, report: DataFrame, transactions: DataFrame) -> DataFrame:
    """The documents of a certified run with a column ``gate_<name>`` for each of seven checks and ``released``, all of them."""
    repairs = transactions.filter("state = 'committed'").groupBy("doc_id").agg(F.count("*").alias("repairs"))
    rows = documents.join(report.select("doc_id", "ledger_coverage", "unresolved_occurrences", "missing_hard_anchors"), "doc_id", "left").join(repairs, "doc_id", "left").withColumn("repairs", F.coalesce("repairs", F.lit(0)))
    rows = rows.select("*", *(F.coalesce(F.expr(c), F.lit(False)).alias(f"gate_{n}") for n, c in RELEASE.items()))
    return rows.withColumn("released", F.expr(" AND ".join(f"gate_{n}" for n in RELEASE)))


def publish(gated: DataFrame, path: str) -> None:
    """The revised texts of released documents, one file for each document under a folder of its id."""
    gated.filter("released").select(F.col("doc_id"), F.col("revised_text").alias("value")).repartition("doc_id").write.partitionBy("doc_id").option("lineSep", "\0").text(path)
