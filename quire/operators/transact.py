"""Exact transactions: whole-sentence duplicates become cross-references, or nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.analysis import Analysis
from .ledger import anchors

CHECKS = ("ledger_reconciled", "anchors_preserved", "scope_isolated", "cross_references_resolve", "new_duplication_absent")


def prepare(a: Analysis, families: DataFrame | None = None) -> DataFrame:
    """A row for each family that has something to move: the transaction, committed or rolled back.

    The receiver is the preserved occurrence at the centre with most tokens, the first of equals. Donors are exact
    occurrences elsewhere without words of their own whose normalised text is the receiver's. A donor whose anchors
    the receiver lacks is left alone and fails the transaction; if no donor is left there is no transaction.
    """
    plan = (families if families is not None else a.plan).select("doc_id", "emission", "place", "label", "unit_ids")
    units = a.units.select("doc_id", "ord", "text", "normalized_text", "char_start", "char_end", anchors().alias("anchors"), F.size("tokens").alias("mass"))
    rows = a.decisions.join(units, ["doc_id", "ord"]).join(plan, ["doc_id", "emission"])
    kept = rows.filter((F.col("section_title") == F.col("centre")) & (F.col("disposition") == "preserve_in_place"))
    best = F.max_by(F.struct("text", "normalized_text", "anchors"), F.struct("mass", -F.col("char_start"), -F.col("ord")))
    receivers = kept.groupBy("doc_id", "emission").agg(best.alias("receiver"))
    donors = rows.filter((F.col("disposition") == "merge_into_centre") & (F.col("relation") == "exact_equivalent") & (F.size("unique_residual_tokens") == 0))
    donors = donors.join(receivers, ["doc_id", "emission"]).filter("normalized_text = receiver.normalized_text")
    repair = F.concat(F.lit("See "), "centre", F.lit(" for the canonical treatment of "), "label", F.lit("."))
    donors = donors.withColumn("safe", F.size(F.array_except("anchors", "receiver.anchors")) == 0).withColumn("repair", repair)
    donors = donors.withColumn("fresh", ~F.contains(T.normalise(F.col("repair")), F.col("normalized_text")))
    record = F.struct(
        "char_start", "char_end", "unit_id", F.col("text").alias("original_text"), F.array("text").alias("duplicated_payload"), F.array().cast("array<string>").alias("unique_residual_payload"),
        F.col("function").alias("local_function"), F.col("anchors").alias("hard_anchors"), F.col("repair").alias("proposed_repair"),
    )
    grouped = donors.groupBy("doc_id", "emission", "place", "family_id", "centre", "receiver", "unit_ids").agg(
        F.array_sort(F.collect_list(F.when(F.col("safe"), record))).alias("donors"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("safe"), F.struct("char_start", "unit_id")))), lambda x: F.concat(x["unit_id"], F.lit(": donor hard anchors are not present at the receiver"))).alias("failures"),
        F.coalesce(F.bool_and(F.when(F.col("safe"), F.col("fresh"))), F.lit(True)).alias("new_duplication_absent"),
    ).filter(F.size("donors") > 0)
    decided = a.decisions.groupBy("doc_id", "emission").agg(F.count("*").alias("rows"), F.count_distinct("unit_id").alias("decided"))
    grouped = grouped.join(decided, ["doc_id", "emission"]).withColumn("ledger_reconciled", (F.col("rows") == F.col("decided")) & (F.col("decided") == F.size("unit_ids")))
    titles = a.sections.select("doc_id", F.col("title").alias("centre")).distinct().withColumn("cross_references_resolve", F.lit(True))
    done = grouped.join(a.documents, "doc_id").join(titles, ["doc_id", "centre"], "left").withColumn("cross_references_resolve", F.coalesce("cross_references_resolve", F.lit(False)))
    done = done.withColumn("base_document_hash", F.sha2("text", 256)).withColumn("anchors_preserved", F.size("failures") == 0)
    edits = F.transform("donors", lambda d: F.struct(d["char_start"].alias("s"), d["char_end"].alias("e"), d["proposed_repair"].alias("txt")))
    done = done.withColumn("edits", F.array_sort(edits)).withColumn("spliced", T.splice(F.col("text"), F.col("edits")))
    done = done.withColumn("scope_isolated", T.outside_kept(F.col("text"), F.col("spliced"), F.col("edits")))
    passed = F.lit(True)
    for c in CHECKS:
        passed = passed & F.col(c)
    receiver = F.struct(
        F.col("receiver.text").alias("original_text"), F.col("donors.original_text").alias("incoming_payload"), F.col("receiver.text").alias("proposed_text"),
        F.transform("donors", lambda d: F.struct(d["unit_id"].alias("source_unit_id"), F.col("receiver.text").alias("target_span"))).alias("provenance"),
    )
    return done.select(
        "doc_id", "emission", "place", "family_id", F.concat(F.lit("tx_"), F.substring(F.sha2(F.concat_ws("|", "base_document_hash", "family_id"), 256), 1, 12)).alias("transaction_id"),
        "base_document_hash", F.when(passed, "committed").otherwise("rolled_back").alias("state"), "centre",
        F.transform("donors", lambda d: d.dropFields("char_start", "char_end")).alias("donors"), receiver.alias("receiver"), F.col("donors.unit_id").alias("changed_unit_ids"),
        "ledger_reconciled", "anchors_preserved", "scope_isolated", "cross_references_resolve", "new_duplication_absent",
        F.lit("passed").alias("semantic_adjudication"), "failures", F.array_join(F.array_sort("unit_ids"), "|").alias("signature"),
        F.when(passed, F.col("spliced")).otherwise(F.col("text")).alias("revised_document"),
    )


def public(transactions: DataFrame) -> DataFrame:
    """Transactions as they may leave the engine: without any text, the revised document as its hash."""
    return transactions.withColumn("revised_sha256", F.sha2("revised_document", 256)).drop("donors", "receiver", "revised_document")


def checks_pass():
    """All checks of a transaction row."""
    out = (F.col("semantic_adjudication") == "passed") & (F.size("failures") == 0)
    for c in CHECKS:
        out = out & F.col(c)
    return out


def first_commit(transactions: DataFrame) -> DataFrame:
    """The committed transaction that comes first in each document."""
    w = Window.partitionBy("doc_id").orderBy("place")
    return transactions.filter("state = 'committed'").withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def compare_view(transactions: DataFrame) -> DataFrame:
    """Before and after of every repaired sentence."""
    rows = transactions.select("doc_id", "transaction_id", "state", "centre", F.explode("donors").alias("d"))
    return rows.select("doc_id", "transaction_id", "state", "centre", "d.unit_id", F.col("d.original_text").alias("before"), F.col("d.proposed_repair").alias("after"))
