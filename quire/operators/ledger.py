"""Documents to sections to sentence units: the ledger that later stages account for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONTEXT_LIMIT, MAX_BYTES, SAFETY_RATIO
from ..functions import text as T


#: Most repeated ids that travel to every executor; more meet their documents in a shuffle.
FEW = 10_000


def admit(docs: DataFrame, *, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents to analyse, rejects with a reason): rows without an id, rows that share one, and blank, missing and
    oversized texts are rejected.

    A document is what one id names, so rows that repeat an id are all turned away. The ids alone are counted first; if
    none is repeated, as is usual, no text moves.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("again"))
    n = again.limit(FEW + 1).count()
    rows = docs.select("doc_id", "text")
    rows = rows.join(F.broadcast(again) if n <= FEW else again, "doc_id", "left") if n else rows.withColumn("again", F.lit(False))
    reason = (
        F.when(F.col("doc_id").isNull(), "doc_id is missing").when(F.col("again"), "doc_id is repeated").when(F.col("text").isNull(), "text is missing")
        .when(T.strip(F.col("text")) == "", "document is empty").when(F.octet_length("text") > max_bytes, "document is too large")
    )
    judged = rows.select("doc_id", "text", reason.alias("reason"))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").select("doc_id", "reason")


def _cut(text: Column, pattern: str) -> Column:
    """array<start, sep, text>: the pieces between matches of pattern with the match before each and the piece's place.

    Pieces and matches alternate, so running lengths give the places without a search.
    """
    pieces = F.split(text, pattern, -1)
    seps = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = F.zip_with(pieces, seps, lambda p, s: F.struct(s.alias("sep"), p.alias("text")))
    place = lambda at, x: F.struct((at + F.length(x["sep"])).alias("start"), x["sep"].alias("sep"), x["text"].alias("text"))
    return T.bound(rows, lambda own: F.zip_with(T.running(F.transform(own, lambda x: F.length(x["sep"]) + F.length(x["text"]))), own, place))


def _sections(text: Column) -> Column:
    """array<sec_ord, section_id, title, level, start, body> of a text's sections in order."""

    def section(x: Column, k: Column, n: Column) -> Column:
        head = lambda group: F.regexp_extract(x["sep"], T.HEADING, group)
        return F.struct(
            k.alias("sec_ord"), F.format_string("s_%03d", F.when(n == 1, 1).otherwise(k)).alias("section_id"),
            F.when(n == 1, "Document").when(k == 0, "Preamble").otherwise(T.strip(head(2))).alias("title"), F.when(k == 0, 1).otherwise(F.length(head(1))).alias("level"),
            x["start"].alias("start"), x["text"].alias("body"),
        )

    rows = T.bound(_cut(text, T.HEADING), lambda cut: F.transform(cut, lambda x, k: section(x, k, F.size(cut))))
    return T.bound(rows, lambda own: F.filter(own, lambda x: (x["sec_ord"] > 0) | (F.size(own) == 1) | (T.strip(x["body"]) != "")))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, sec_ord, section_id, title, level, start, body`` in document order; body is the raw text.

    Headings part the text; what stands before the first is a preamble unless blank, and a text without headings is
    one section. Everything happens inside a document's row, so no text is shuffled.
    """
    return docs.select("doc_id", F.inline(_sections(F.col("text"))))


def units(docs: DataFrame) -> DataFrame:
    """Sentence units of documents, with ids, places, roles, anchors and token sets."""
    return with_words(bare_units(docs))


def with_words(bare: DataFrame) -> DataFrame:
    """Units with the word sets of their normalised text. These are over half of a unit's bytes and follow from it, so
    tables of units are stored without them."""
    rows = bare.withColumn("tokens", T.tokens(F.col("normalized_text"))).withColumn("content", T.content(F.col("tokens")))
    return rows.withColumn("concepts", T.concepts(F.col("content")))


def bare_units(docs: DataFrame) -> DataFrame:
    """Sentence units of documents, with ids, places, roles and anchors.

    Sections, paragraphs and sentences are nested arrays of the document's row, which are flattened once: the place in
    the flat array is the unit's number in the document. No window, no shuffle.
    """

    def sentences(s: Column, paragraph: Column, index: Column) -> Column:
        own = F.filter(F.transform(_cut(paragraph["text"], T.SENTENCE), lambda x: F.struct(x["text"].alias("raw"), x["start"].alias("start"), T.strip(x["text"]).alias("text"))), lambda x: x["text"] != "")
        lead = lambda x: F.length(x["raw"]) - F.length(F.regexp_replace(x["raw"], rf"\A{T.WS}+", ""))
        return F.transform(own, lambda x, i: F.struct(
            s["section_id"].alias("section_id"), s["title"].alias("section_title"), index.alias("paragraph_index"), i.alias("sentence_index"),
            (s["start"] + paragraph["start"] + x["start"] + lead(x)).alias("char_start"), x["text"].alias("text"),
        ))

    def paragraphs(s: Column) -> Column:
        own = F.filter(_cut(s["body"], T.PARAGRAPH), lambda p: T.strip(p["text"]) != "")
        return F.flatten(F.transform(own, lambda p, i: sentences(s, p, i)))

    rows = docs.select("doc_id", F.posexplode(F.flatten(F.transform(_sections(F.col("text")), paragraphs))).alias("ord", "u")).select("doc_id", "ord", "u.*")
    rows = rows.withColumn("normalized_text", T.normalise(F.col("text"))).withColumn("role", T.discourse_role(F.col("text")))
    ident = F.sha2(F.concat_ws("|", "section_id", "paragraph_index", "sentence_index", "normalized_text"), 256)
    return rows.select(
        "doc_id",
        "ord",
        F.concat(F.lit("u_"), F.substring(ident, 1, 12)).alias("unit_id"),
        "section_id",
        "section_title",
        "paragraph_index",
        "sentence_index",
        "char_start",
        (F.col("char_start") + F.length("text")).alias("char_end"),
        "text",
        "normalized_text",
        "role",
        T.local_function(F.col("section_title"), F.col("role")).alias("function"),
        T.numbers(F.col("text")).alias("numbers"),
        T.quotations(F.col("text")).alias("quotations"),
        T.citations(F.col("text")).alias("citations"),
        T.defined_terms(F.col("text")).alias("defined_terms"),
    )


def anchors(*, quotations: bool = True) -> Column:
    """Distinct anchors of a unit; similarity leaves quotations out."""
    kinds = ["numbers", *(["quotations"] if quotations else []), "citations", "defined_terms"]
    return F.array_sort(F.array_distinct(F.concat(*kinds)))


def document_title(found: DataFrame) -> DataFrame:
    """``doc_id, title``: the first heading's, or a fixed one."""
    first = F.min(F.when(F.col("sec_ord") > 0, F.struct("sec_ord", "title")))
    return found.groupBy("doc_id").agg(F.coalesce(first["title"], F.lit("Untitled document")).alias("title"))


def resource_plan(docs: DataFrame, found: DataFrame, *, context_limit: int = CONTEXT_LIMIT, safety_ratio: float = SAFETY_RATIO) -> DataFrame:
    """Estimated tokens against the safe budget, the reading strategy and the cap of passes."""
    if context_limit < 1000:
        raise ValueError("the configured context limit is implausibly small")
    budget = max(1, round(context_limit * safety_ratio))
    counts = found.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sections"))
    rows = docs.select("doc_id", F.greatest(F.lit(1), F.rint(F.length("text") / 4).cast("int")).alias("estimated_tokens")).join(counts, "doc_id")
    rows = rows.withColumn("p", F.col("estimated_tokens") / F.lit(float(budget)))
    p = F.col("p")
    strategy = F.when(p <= 0.55, "whole_document").when(p <= 1, "section_chunks_with_global_synthesis").otherwise("overlapping_structural_chunks_with_global_ledger")
    chunks = F.when(p <= 0.55, 1).when(p <= 1, F.greatest(F.lit(2), "n_sections")).otherwise(F.greatest(F.col("n_sections"), F.floor(p).cast("int") + 2))
    rationale = F.concat(
        F.lit("Estimated input uses "), T.percent(p), F.lit(" of the configured safe input budget; selected "), strategy,
        F.lit(". The pass count is a safety cap, not a mandatory rewrite count."),
    )
    return rows.select(
        "doc_id", "estimated_tokens", F.lit(context_limit).alias("configured_context_limit"), F.lit(budget).alias("safe_input_budget"), T.rounded("p", "context_pressure"),
        strategy.alias("strategy"), chunks.alias("overlapping_chunks"), (1 + (p > 0.45).cast("int") + (p > 0.85).cast("int")).alias("initial_pass_cap"), rationale.alias("rationale"),
    )


#: Titles that the sectioniser gives to lines in turn.
TITLES = ["Executive Summary", "Method", "Background", "Evidence", "Analysis", "Recommendations", "Conclusion"]


def sectionise(docs: DataFrame) -> DataFrame:
    """Plain documents as Markdown: each line becomes the body of a section, titles in turn."""
    titles = F.array(*map(F.lit, TITLES))
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(F.lit("## "), F.get(titles, i % len(TITLES)), F.lit("\n\n"), line))
    return docs.select("doc_id", F.array_join(lines, "\n").alias("text"))
