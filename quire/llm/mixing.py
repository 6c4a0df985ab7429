"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, released, small_batches, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 32
SHARD_WORDS = 1_000_000
#: Shards that share one row of the driver's table.
BUNDLE = 256
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Share budget by weight; what would pass ``most`` times a size is shared again among the rest."""
    out, active, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], budget
    while active:
        total = sum(weights[i] for i in active)
        share = {i: left * weights[i] / total for i in active}
        over = [i for i in active if share[i] > most * sizes[i]]
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        if not over:
            for i in active:
                out[i] = share[i]
            break
        active = [i for i in active if i not in set(over)]
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients w / (2k + 1), none above its cap; ties go to the lower index.

    A divisor just too large gives every seat whose quotient is surely among the highest at once; the few that
    remain are handed out one by one from a heap, so the cost doesn't grow with the number of seats.
    """
    seats = min(seats, sum(c for c, w in zip(caps, weights) if w > 0))
    got = [0] * len(weights)
    if seats <= 0:
        return got

    def at(divisor: float) -> list[int]:
        return [min(c, math.floor(w / divisor + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps)]

    low, high = 0.0, 2 * sum(weights) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(at(mid)) <= seats else (mid, high)
    got = at(high)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if w > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _permutation(n: int, seed: int, source: str | None, shard: int) -> tuple[int, int]:
    """a, c of the seeded permutation j -> (a * j + c) mod n of a shard's blocks."""
    h = xxhash.xxh64_intdigest(f"{seed}/{source is None}/{source}/{shard}")
    a = 1 + h % max(1, n - 1)
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, (h >> 32) % n


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 11,
) -> DataFrame:
    """How many words of every document the mix takes.

    Sources in code point order, null last, take the weights in turn. The budget is ``budget`` times all words;
    a source's target stops at ``max_repeat`` times its size and the excess is shared again. Inside a source,
    documents are dealt to shards by a seeded hash and laid end to end in seeded order; each shard's words are cut
    into blocks of ``block_words``. Sainte-Lague gives every source its number of blocks, then every bundle of
    ``BUNDLE`` shards, then every shard its integer quota q of n blocks: each block is taken q // n times and the first
    q % n of a seeded permutation once more, so no block, and so no document, is taken more than ``max_repeat`` times.

    Returns ``doc_id, size, source_size, target, taken`` and, for writers, ``source, start`` (the first word's
    place in the shard), ``base, rest, n_blocks, mul, add`` (the shard's quota and permutation). Null text has
    size 0 and nothing taken; a null source is a source of its own, the last one; null ids and repeated rows are rows of
    their own, and rows with equal ids stand side by side; an empty table gives no rows. Other columns are not read.

    Only counts reach the driver: a row for each source, as the contract's order and resharing of sources ask, and one
    for each bundle, some 256 million words. Shards get their quotas in tasks, a bundle at a time. A shard's running sum
    covers about ``shard_words`` words, however large a source is; only rows with one and the same id stay together.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    totals = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).toLocalIterator()}
    order = sorted((s for s in totals if s is not None), key=lambda s: s) + [None] * (None in totals)
    sizes = [totals[s] for s in order]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], budget * sum(sizes), max_repeat)

    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.LongType())])
    rows = [(s, n, t, max(1, math.ceil(n / shard_words))) for s, n, t in zip(order, sizes, wanted)]
    n_shards = sum(r[3] for r in rows)
    by_source = _small(spark.createDataFrame(rows, kinds), len(rows))
    a, b = sized.alias("a"), by_source.alias("b")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.doc_id", "a.source", "a.size", "b.source_size", "b.target", F.pmod(key, F.col("b.shards")).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("deal")
    )
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = shards.select("source", F.expr(f"shard div {BUNDLE}").alias("bundle"), "shard", "words", F.ceil(F.col("words") / block_words).cast("long").alias("blocks"))
    shards = materialise(shards.groupBy("source", "bundle").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("shard", "words", "blocks"))).alias("shards")), "mix-shards")
    bundles: dict[str | None, list[tuple[int, int, int]]] = {s: [] for s in order}
    for r in shards.select("source", "bundle", "words", "blocks").toLocalIterator():
        bundles[r["source"]].append((r["bundle"], r["words"], r["blocks"]))
    full = [t >= max_repeat * n for n, t in zip(sizes, wanted)]
    caps = [max_repeat * sum(n for *_, n in bundles[s]) for s in order]
    # sources at their limit take every block that often; the others share the rest of the budget's blocks
    free = [i for i, f in enumerate(full) if not f]
    seats = sainte_lague([wanted[i] for i in free], round(sum(wanted[i] for i in free) / block_words), [caps[i] for i in free])
    quota = dict(zip((order[i] for i in free), seats)) | {order[i]: caps[i] for i, f in enumerate(full) if f}

    plan = []
    for s in order:
        own = sorted(bundles[s])
        for (bundle, _, _), q in zip(own, sainte_lague([float(w) for _, w, _ in own], quota[s], [max_repeat * n for *_, n in own])):
            plan.append((s, bundle, q))
    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("bundle", T.LongType()), T.StructField("quota", T.LongType())])
    given, s = _small(spark.createDataFrame(plan, kinds), len(plan)).alias("g"), shards.alias("s")
    dealt = s.join(given, F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.bundle") == F.col("g.bundle"))).select("s.source", "g.quota", "s.shards")
    quotas = _small(dealt.mapInArrow(released(_shard_quotas(max_repeat, seed)), _QUOTAS), n_shards).alias("q")

    w = Window.partitionBy("source", "shard").orderBy("deal", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("start", F.sum("size").over(w) - F.col("size")).alias("p")
    out = laid.join(quotas, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard"))).select(
        "p.doc_id", "p.size", "p.source_size", "p.target", "p.source", "p.start", "q.n_blocks", "q.base", "q.rest", "q.mul", "q.add"
    )
    return out.withColumn("taken", F.when(F.col("size") > 0, F.expr(taken_sql(block_words))).otherwise(F.lit(0)).cast("long"))


_QUOTAS = "source string, shard long, n_blocks long, base long, rest long, mul long, add long"


def _shard_quotas(max_repeat: int, seed: int) -> Callable:
    """Over bundles (source, quota, shards): a row for each shard, its blocks shared by the same method."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _QUOTAS.split(", ")]
        for batch in batches:
            rows = []
            for source, quota, shards in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = [x["blocks"] for x in shards]
                for x, n, q in zip(shards, blocks, sainte_lague([float(x["words"]) for x in shards], quota, [max_repeat * n for n in blocks])):
                    mul, add = _permutation(n, seed, source, x["shard"]) if n else (0, 0)
                    rows.append((source, x["shard"], n, q // n if n else 0, q % n if n else 0, mul, add))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(len(names))], names)

    return run


def taken_sql(block_words: int) -> str:
    """base times the size, and the words in blocks that the seeded permutation takes once more."""
    b = block_words
    return (
        f"base * size + CASE WHEN rest = 0 THEN 0 ELSE aggregate(sequence(start div {b}, (start + size - 1) div {b}), 0L, (acc, j) -> acc + "
        f"CASE WHEN (mul * j + add) % n_blocks < rest THEN least(start + size, (j + 1) * {b}) - greatest(start, j * {b}) ELSE 0L END) END"
    )


def _writer(block: int, columns: list[str], text_col: str) -> Callable:
    """Over rows (doc, plan) of a document's columns and its plan: a row for each time that its words are taken."""
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            rows, texts = [], []
            for i, (text, p) in enumerate(zip(fields[place].to_pylist(), batch.column(1).to_pylist())):
                size, start, n, rest = p["size"], p["start"], p["n_blocks"], p["rest"]
                if not size:
                    continue
                more = [(p["mul"] * j + p["add"]) % n < rest for j in range(start // block, (start + size - 1) // block + 1)]
                rows += [i] * p["base"]
                texts += [text] * p["base"]
                if all(more):
                    rows.append(i)
                    texts.append(text)
                elif any(more):
                    spots, first, parts = [m.span() for m in _WORDS.finditer(text)], start // block, []
                    k = 0
                    while k < len(more):
                        if more[k]:
                            e = k
                            while e < len(more) and more[e]:
                                e += 1
                            a, b = max(start, (first + k) * block) - start, min(start + size, (first + e) * block) - start
                            parts.append(text[spots[a][0] : spots[b - 1][1]])
                            k = e
                        k += 1
                    rows.append(i)
                    texts.append("\n".join(parts))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else field.take(at) for k, field in enumerate(fields)], columns)

    return run


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time words of a document are taken.

    A document whose blocks are all taken keeps its text; otherwise the text has its taken blocks, runs of them as
    they stand and a line break between runs. Rows that repeat an id with as many words share the plan of the first of
    them in plan order. Null and empty texts have no words and so no row. Null ids are ids like others. An empty table
    gives no rows. The columns of docs travel in one struct, so none of their names can clash.
    """
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, block_words=block_words, **options)
    numbers = F.struct("start", "size", "n_blocks", "base", "rest", "mul", "add")
    plan = plan.filter("taken > 0").groupBy("doc_id", "size").agg(F.min(numbers).alias("plan"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("key"), word_count(F.col(text_col)).alias("words"))
    small_batches(docs.sparkSession)
    joined = whole.join(plan.hint("shuffle_hash"), whole["key"].eqNullSafe(plan["doc_id"]) & (whole["words"] == plan["size"])).select("doc", "plan")
    return joined.mapInArrow(released(_writer(block_words, docs.columns, text_col)), docs.schema)


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a table made on the driver while it has few rows; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if n <= 50_000 else df


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    mix = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
