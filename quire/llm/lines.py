"""Line-level deduplication across documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LAST_ID, ascii_lower


def _exploded(base: DataFrame, min_chars: int) -> DataFrame:
    """(id, version, pos, two hashes of the key) of every line whose key is long enough to be judged."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    return (
        base.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "version", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that several documents share, except in the document with the smallest id.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least
    ``min_chars`` code points that at least ``min_docs`` distinct ids hold loses its lines everywhere but in the
    smallest id. Repeats inside that document stay. Returns ``id_col, text (rebuilt), n_lines, n_dropped``, one
    row for each input row; no other input column is read, so extra columns can't clash.

    Null or empty text is one empty line. A null id counts as one document after all others. Rows that repeat an
    id are one document: each keeps its row. An empty table gives an empty result.

    Plan: the exploded side carries 36 bytes a line, never the line itself. Keys are counted with map-side
    partial aggregation, so a line in a third of all documents reaches its reducer as one row a task; the join
    that finds the positions is a plain equi-join that adaptive execution may split where a key is hot. Texts
    move once, by (id, version), and meet only the list of their dropped positions.
    """
    base = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("id"),
        F.col(id_col).alias("own_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    lines = _exploded(base, min_chars)
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    else:
        held = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        shared = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("one").alias("n")).filter(F.col("n") >= min_docs)
    drops = (
        lines.join(shared.select("h1", "h2", "first"), ["h1", "h2"])
        .filter("id > first")
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("drop"))
    )
    split = base.join(drops.hint("shuffle_hash"), ["id", "version"], "left").select("own_id", "text", "drop", F.split("text", "\n", -1).alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    rebuilt = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        F.col("own_id").alias(id_col),
        F.when(F.col("drop").isNull(), F.col("text")).when(F.size(stays) == 0, F.lit("")).otherwise(rebuilt).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
