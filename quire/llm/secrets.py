"""Secret scans in DataFrame operations: fixed patterns, and character Markov models for what they miss."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, running

#: The base patterns. Hex and access keys need no check after the match: a run that is too short
#: holds no longer one. Assignments keep the pattern without a limit and drop short values afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "markov")

#: Labelled sample: this many random strings of each alphabet, and the words of this many documents.
RANDOM_STRINGS, SAMPLE_DOCS = 2000, 2000
#: Least log-likelihood ratio of a span: odds of a million to one, for words are many and secrets few.
LEAST_RATIO = math.log(1e6)
#: And the least for each character: rare pairs add up in long ordinary identifiers, but thinly.
LEAST_EACH = 0.8
LEAST_LENGTH = 20
#: A stretch of a run's pieces ends where its sum falls by more than this below its best.
DIP = 5 * LEAST_EACH
#: Added to each count of a pair of characters.
PRIOR = 0.5
_CODES = 128


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """array<start, end, kind order, kind, match> of the leftmost matches that don't overlap, in code points.

    The pieces between the matches and the matches themselves alternate, so running lengths give their places, in
    time that grows with the text and hardly faster than the matches. Texts without a match skip the work.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,match:string>>")
    cut = bound(matches, lambda m: F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("gap"), F.length(x).alias("size"), x.alias("match"))))

    def span(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        return F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["match"].alias("match"))

    placed = bound(cut, lambda steps: F.zip_with(running(F.transform(steps, lambda x: x["gap"] + x["size"])), steps, span))
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(none)


def labelled_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strings: int = RANDOM_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, label): seeded random strings in three alphabets as 1; words of a bounded sample of documents as 0.

    The documents with the smallest hashes of their ids are taken, ``sample_docs`` at most; words with a digit
    or an access key are left out.
    """
    spark = docs.sparkSession
    n = spark.range(strings).select(F.sha2(F.concat(F.lit("random "), F.col("id")), 512).alias("hex"))
    raw = F.regexp_replace(F.base64(F.unhex("hex")), "=+$", "")
    random = n.select(F.explode(F.array(F.substring("hex", 1, 40), F.substring(raw, 1, 40), F.upper(F.substring(raw, 41, 24)))).alias("sample"))
    # ids alone are sorted; the texts of the chosen ones, at most ``sample_docs``, are fetched afterwards
    chosen = docs.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(29), "id"), "id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    taken = rows.join(F.broadcast(chosen), "id")
    words = taken.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("sample"))
    words = words.filter(~F.regexp_like("sample", F.lit(f"[0-9]|{ACCESS}")) & (F.length("sample") < 100))
    return random.withColumn("label", F.lit(1)).union(words.withColumn("label", F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary: 128 x 128 values, row by first.

    Each model is a first-order chain; counts are made by Spark and at most 2 x 16,384 of them reach the driver.
    """
    chars = F.split("sample", "")
    pairs = F.zip_with(F.slice(chars, 1, F.length("sample") - 1), F.slice(chars, 2, F.length("sample") - 1), lambda a, b: F.ascii(a) * _CODES + F.ascii(b))
    counted = samples.filter(F.length("sample") >= 2).select("label", F.explode(pairs).alias("pair")).filter(f"pair < {_CODES * _CODES}").groupBy("label", "pair").count()
    counts = [[PRIOR] * (_CODES * _CODES) for _ in (0, 1)]
    for r in counted.toLocalIterator():
        counts[r["label"]][r["pair"]] += r["count"]
    used = 65  # characters that candidates have
    out = [0.0] * (_CODES * _CODES)
    for a in range(_CODES):
        row = slice(a * _CODES, (a + 1) * _CODES)
        total = [sum(c[row]) - PRIOR * (_CODES - used) for c in counts]
        for b in range(_CODES):
            i = a * _CODES + b
            out[i] = math.log(counts[1][i] / total[1]) - math.log(counts[0][i] / total[0])
    return out


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of an ASCII string."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.length(token) - 1, F.lit(1))), lambda a, b: F.coalesce(F.get(table, a * _CODES + b), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def masked(text: Column, pattern: str, own=None) -> Column:
    """The text with blanks in place of the matches, or of those that own() accepts."""
    blank = lambda x: F.repeat(F.lit(" "), F.length(x))
    hidden = blank if own is None else lambda x: F.when(own(x), blank(x)).otherwise(x)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.concat(p, F.coalesce(hidden(m), F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(parts, "")).otherwise(text)


def parts_of(run: Column, table: Column) -> Column:
    """array<start, end> within a run: stretches of its pieces between + / _ = - that the models take for random.

    The sum of ratio less ``LEAST_EACH`` a character runs along the pieces. It starts anew after it falls under zero
    or by more than ``DIP`` below its best; each stretch goes as far as its best sum.
    """
    excess = lambda x: ratio(x, table) - LEAST_EACH * F.length(x)
    found = F.regexp_extract_all(run, F.lit("[+/_=-]*[A-Za-z0-9]+"), F.lit(0))
    last = lambda x: F.regexp_extract(x, ".$", 0)
    pieces = bound(found, lambda x: F.zip_with(x, F.concat(F.array(F.lit("")), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))), lambda own, before: F.struct(own.alias("own"), last(before).alias("before"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = lambda at, start, total, best, end, spans: F.struct(at.alias("at"), start.alias("start"), total.alias("total"), best.alias("best"), end.alias("end"), spans.alias("spans"))
    kept = lambda acc: F.when(acc["best"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"])

    def add(acc: Column, piece: Column) -> Column:
        x = piece["own"]
        core = F.regexp_extract(x, "[A-Za-z0-9]+", 0)
        end = acc["at"] + F.length(x)
        joined = acc["total"] + excess(F.concat(piece["before"], x)) + LEAST_EACH * F.length(piece["before"])
        alone = excess(core)
        goes_on = (acc["best"] > 0) & (joined > 0) & (joined >= acc["best"] - DIP)
        fresh = state(end, end - F.length(core), alone, F.greatest(alone, F.lit(0.0)), end, kept(acc))
        more = state(end, acc["start"], joined, F.greatest(acc["best"], joined), F.when(joined > acc["best"], end).otherwise(acc["end"]), acc["spans"])
        return F.when(goes_on, more).otherwise(fresh)

    zero = F.lit(0.0)
    return F.aggregate(pieces, state(F.lit(0), F.lit(0), zero, zero, F.lit(0), none), add, kept)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Secrets in every whole text: ``doc_id, spans``, an array of ``start, end, rank, kind, match``.

    Base spans are the leftmost matches per kind that don't overlap: assignments whose value has at least 8
    characters, access keys and hex runs. The models add spans of kind "markov": strings of at least 20 characters
    whose log-likelihood under the chain of random strings exceeds that under the chain of ordinary identifiers by
    ``least_ratio`` and by 0.8 a character, in what the base spans leave of the text. Where a whole run falls short, the
    stretches of its pieces between + / _ = - are judged in the same way. Places are code points, ends exclusive; spans stand in order of
    start, then kind.

    What the base spans leave: assignments, then access keys, then hex runs are blanked out. Where two of them overlap,
    what the second has beyond the first is judged like other text.

    Null text is empty. Null ids and repeated rows are rows of their own. An empty table gives no rows. Other columns
    are not read. The scan is one pass over the texts without a shuffle or a Python worker; the models are 16,384
    numbers in the plan.
    """
    model = train(labelled_sample(docs, id_col=id_col, text_col=text_col) if samples is None else samples)
    table = F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in model) + "]"), "array<double>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    valued = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE
    found = rows.select(
        "doc_id",
        F.filter(spans_of(text, ASSIGN, "assign"), lambda s: valued(s["match"])).alias("assign"),
        spans_of(text, ACCESS, "access").alias("access"),
        spans_of(text, HEX, "hex").alias("hex"),
        "text",
        masked(text, ASSIGN, valued).alias("left"),
    )
    found = found.select("doc_id", F.concat("assign", "access", "hex").alias("base"), masked(F.col("left"), ACCESS).alias("left"))
    found = found.select("doc_id", "base", masked(F.col("left"), HEX).alias("left"))
    base = found.select("doc_id", "base", spans_of(F.col("left"), CANDIDATE, "markov").alias("candidates"))
    random = lambda x: (F.length(x) >= LEAST_LENGTH) & (ratio(x, table) >= F.greatest(F.lit(least_ratio), LEAST_EACH * F.length(x)))

    def part(s: Column, x: Column) -> Column:
        begin = s["start"] + x["start"]
        return F.struct(begin.alias("start"), (s["start"] + x["end"]).alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), F.substring(s["match"], x["start"] + 1, x["end"] - x["start"]).alias("match"))

    def judged(s: Column) -> Column:
        return F.when(random(s["match"]), F.array(s)).otherwise(F.filter(F.transform(parts_of(s["match"], table), lambda x: part(s, x)), lambda x: random(x["match"])))

    own = F.flatten(F.transform("candidates", judged))
    return base.select("doc_id", F.array_sort(F.concat("base", own)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
