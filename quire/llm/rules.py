"""Quality rules whose cutoffs come from labelled rows with a guaranteed limit on false rejections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, HashCache, gram_hashes, materialise, released, small_batches

SYMBOLS = "#*$%&|<>"
#: rule -> its measure, a ratio of the counts below (0 for empty texts). A text fails a rule if its measure is above the cutoff.
RULES = {
    "long_words": "try_divide(word_chars, n_words)",
    "symbols": "try_divide(n_symbols, n_chars)",
    "duplicate_lines": "try_divide(n_dup_lines, n_lines)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
    "capitals": "try_divide(n_upper, n_chars)",
    "shouts": "try_divide(n_shouts, n_words)",
}
#: Possible cutoffs, the same for every corpus; the last bin of each rule rejects nothing.
GRID = {
    "long_words": [4 + 0.25 * i for i in range(64)],
    "symbols": [0.005 * i for i in range(1, 61)],
    "duplicate_lines": [0.02 * i for i in range(1, 50)],
    "repeated_words": [0.02 * i for i in range(1, 50)],
    "capitals": [0.02 * i for i in range(1, 50)],
    "shouts": [0.02 * i for i in range(1, 50)],
}
#: Highest share of good texts that a rule may reject in a stratum, and the chance that any cutoff breaks it.
RISK, DELTA = 0.01, 0.05

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_shouts")


def _counter() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()

        def repeats(words: list[bytes]) -> int:
            grams = gram_hashes(cache.of(words), 3)
            if len(grams) < 2:
                return 0
            in_order = np.sort(grams)
            twice = in_order[1:][in_order[1:] == in_order[:-1]]
            if not len(twice):
                return 0
            hit = np.isin(grams, twice)
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : i + len(grams)] |= hit
            return int(covered.sum())

        for batch in batches:
            out = {c: [] for c in COUNTS}
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = text.encode().split()
                lines, seen, dup = text.split("\n"), set(), 0
                for line in lines:
                    if line in seen:
                        dup += 1
                    elif line.strip(BLANKS):
                        seen.add(line)
                raw = np.frombuffer(text.encode(), np.uint8)
                values = (
                    len(words),
                    len(text) - sum(map(text.count, BLANKS)),
                    sum(map(text.count, SYMBOLS)),
                    dup,
                    repeats(words),
                    len(text),
                    len(lines),
                    int(((raw >= 65) & (raw <= 90)).sum()),
                    text.count("!"),
                )
                for name, value in zip(COUNTS, values):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(out[c], pa.int64()) for c in COUNTS)], ["doc_id", "stratum", *COUNTS])

    return run


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Counts of every whole text; null text counts as empty."""
    small_batches(docs.sparkSession)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), stratum.alias("stratum"))
    return rows.mapInArrow(released(_counter()), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def _bin(rule: str) -> str:
    """Index of the smallest cutoff that the measure does not exceed; the grid's length if it exceeds all."""
    grid = ", ".join(f"{x!r}D" for x in GRID[rule])
    return f"coalesce(nullif(array_position(transform(array({grid}), x -> coalesce({RULES[rule]}, 0D) <= x), true), 0) - 1, {len(GRID[rule])})"


def cutoffs(counts: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff): per stratum and rule the strictest cutoff whose limit on false rejections holds.

    A cutoff holds if, were the true share of good texts above it ``risk``, so few of the labelled good texts
    would be above it with probability at most ``delta`` over the number of all tests (Bonferroni over strata,
    rules and cutoffs): the exact one-sided binomial bound. A stratum without enough good labels gets no cutoff for
    the rule and rejects nothing by it. A histogram a stratum and rule reaches the driver.

    Every labelled document counts once, however often its label or its row is repeated: repeats are no evidence. It is
    good if all its labels that aren't null are 1; of several rows with its id the one with the least counts stands.
    """
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = counts.join(agreed.filter("least = 1 AND most = 1").select("doc_id"), "doc_id")
    good = good.groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("x")).select("doc_id", "x.*")
    bins = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(_bin(r)).cast("int").alias("bin")) for r in RULES)))
    held: dict[tuple[str, str], dict[int, int]] = {}
    for r in good.select("stratum", bins.alias("x")).groupBy("stratum", "x.rule", "x.bin").count().toLocalIterator():
        held.setdefault((r["stratum"], r["rule"]), {})[r["bin"]] = r["count"]
    tests = sum(len(GRID[rule]) for _, rule in held)
    out = []
    for (stratum, rule), by_bin in sorted(held.items()):
        n, above, best = sum(by_bin.values()), by_bin.get(len(GRID[rule]), 0), None
        for i in reversed(range(len(GRID[rule]))):
            if binomial_at_most(above, n, risk) > delta / tests:
                break
            best = GRID[rule][i]
            above += by_bin.get(i, 0)
        if best is not None:
            out.append((stratum, rule, best))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts and verdict of every text.

    A text fails the base rules with under 50 words or over half of its words repeated. Beyond them it is rejected if
    a measure passes its stratum's cutoff, where ``cutoffs`` guarantees that each rejects at most ``risk`` of the good
    texts. Returns a row for each input row: ``doc_id, stratum``, the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Null or empty text has no word and fails the base rules. Null ids meet no label. Repeated rows get equal verdicts.
    A null stratum is the stratum "". Without labels no cutoff is set. An empty table gives no rows. Columns of other
    names are not read.
    """
    counts = materialise(text_counts(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "counts")
    found = cutoffs(counts, labels, risk=risk, delta=delta)
    kinds = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("limits", T.MapType(T.StringType(), T.DoubleType()))])
    per: dict[str, dict[str, float]] = {}
    for stratum, rule, cutoff in found:
        per.setdefault(stratum, {})[rule] = cutoff
    limits = counts.sparkSession.createDataFrame(list(per.items()), kinds)
    judged = counts.join(F.broadcast(limits) if len(per) <= 10_000 else limits, "stratum", "left")
    failing = F.array_compact(F.array(*(F.when(F.expr(f"coalesce({m}, 0D)") > F.coalesce(F.col("limits")[r], F.lit(float("inf"))), F.lit(r)) for r, m in RULES.items())))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "stratum", *COUNTS, base.alias("base_failed"), failing.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
