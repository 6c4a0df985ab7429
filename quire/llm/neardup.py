"""Near-duplicate groups of whole documents: MinHash signatures in an LSH forest, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HashCache, binary_rows, discard, gram_hashes, materialise, released, small_batches
from .graph import components

SHINGLE = 5
TREES, DEPTH = 24, 6
#: Least number of leading signature values that neighbours share.
MIN_DEPTH = 3
#: Rows a row looks back over in each order.
LOOK_BACK = 4
#: Documents and shingles of a block that one task compares.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Standard deviations by which an estimate may miss.
SIGMAS = 5.5


def _shingles(words: list[bytes], cache: HashCache, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence as one if there are fewer words."""
    if len(words) < size:
        return np.asarray([cache[b"\x00".join(words)]] if words else [], np.uint64)
    h = gram_hashes(cache.of(words), size)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _sketcher(size: int, trees: int, depth: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)
        cache = HashCache()

        def signatures(sets: list[np.ndarray]) -> np.ndarray:
            flat = np.concatenate(sets)
            starts = np.cumsum([0, *map(len, sets)])[:-1]
            out = np.empty((len(sets), trees * depth), ">u4")
            for k in range(trees * depth):
                y = flat * mul[k]
                y += add[k]
                out[:, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
            return out

        for batch in batches:
            texts = binary_rows(batch.column(1))
            n, keys, sigs = [], [], [None] * len(texts)
            sets: list[np.ndarray] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                if sets:
                    for row, s in zip(rows, signatures(sets)):
                        sigs[row] = s.tobytes()
                sets.clear()
                rows.clear()

            for i, text in enumerate(texts):
                words = text.lower().split()
                own = _shingles(words, cache, size)
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                if words:
                    sets.append(own)
                    rows.append(i)
                    held += len(own)
                    if held > 16_384:
                        flush()
                        held = 0
            flush()
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "key", "sig"])

    return run


def _neighbours(look_back: int, min_depth: int, percent: int) -> Callable:
    """Over rows in (tree, signature) order: pairs of near rows, and each partition's first and last rows."""
    width = 4 * min_depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "part", "place", "a", "b", "na", "nb", "tree", "prefix"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        part = TaskContext.get().partitionId()
        tail: tuple = ()
        head: list = []

        def edge(kind: int, rows: list[tuple]) -> list[tuple]:
            return [(kind, part, i, r[1], None, r[2], None, r[0], r[3]) for i, r in enumerate(rows)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids, n = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            prefix = np.frombuffer(b"".join(x[:width] for x in batch.column(1).to_pylist()), f"V{width}")
            if len(head) < look_back:
                head += [(int(tree[i]), int(ids[i]), int(n[i]), prefix[i].tobytes()) for i in range(min(look_back - len(head), len(ids)))]
            if tail:
                tree, ids, n, prefix = (np.concatenate(x) for x in zip(tail, (tree, ids, n, prefix)))
            fresh = len(tail[0]) if tail else 0
            found = []
            for back in range(1, min(look_back, len(ids) - 1) + 1):
                lo = max(back, fresh)
                same = (tree[lo:] == tree[lo - back : -back]) & (prefix[lo:] == prefix[lo - back : -back])
                a, b, na, nb = ids[lo:][same], ids[lo - back : -back][same], n[lo:][same], n[lo - back : -back][same]
                near = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (a != b)
                found.append((np.minimum(a, b)[near], np.maximum(a, b)[near]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
                none = lambda t: pa.nulls(len(pairs), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(pairs), np.int32)), none(pa.int32()), none(pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *map(none, kinds[5:])], names
                )
            tail = tuple(x[-look_back:] for x in (tree, ids, n, prefix))
        if head:
            last = [(int(tree[i]), int(ids[i]), int(n[i]), prefix[i].tobytes()) for tree, ids, n, prefix in [tail] for i in range(len(ids))]
            yield out(edge(1, head) + edge(2, last))

    return run


_NEIGHBOUR_SCHEMA = "kind int, part int, place int, a long, b long, na long, nb long, tree int, prefix binary"


def _agreeing(least: float) -> Callable:
    """Pairs whose signatures agree in at least this share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "u4").reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array((left == right).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(near)

    return run


def _spanning(ids: np.ndarray, n: np.ndarray, sigs: np.ndarray, least: float, percent: int) -> list[tuple[int, int]]:
    """(id, least linked id) of the rows of a block that agreeing signatures join; every pair is looked at."""
    m, need = len(ids), least * sigs.shape[1]
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    columns, step = np.ascontiguousarray(sigs.T), max(1, 4_000_000 // m)
    for at in range(0, m, step):
        end = min(m, at + step)
        same = np.zeros((end - at, m), np.int16)
        if m <= 64:
            same += (sigs[at:end, None, :] == sigs[None, :, :]).sum(2, dtype=np.int16)
        else:
            for c in columns:
                same += c[at:end, None] == c[None, :]
        near = (same >= need) & (100 * np.minimum(n[at:end, None], n[None, :]) >= percent * np.maximum(n[at:end, None], n[None, :]))
        for i, j in zip(*np.nonzero(near)):
            if i + at < j and (a := find(i + at)) != (b := find(j)):
                a, b = (a, b) if ids[a] <= ids[b] else (b, a)
                root[b] = a
    return [(int(ids[i]), int(ids[r])) for i in range(m) if ids[r := find(i)] != ids[i]]


def _crowd_links(least: float, percent: int) -> Callable:
    """Over rows (tree, prefix, bi, bj, id, n, loose, low) grouped by block: a spanning forest of the near rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> list[tuple[int, int]]:
            if len({r[2] for r in rows}) < 2:
                return []  # one loose cluster already
            ids, n = (np.asarray([r[i] for r in rows], np.int64) for i in (0, 1))
            return _spanning(ids, n, np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1), least, percent)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for tree, prefix, bi, bj, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, prefix, bi, bj) != key:
                    found += done()
                    key, rows = (tree, prefix, bi, bj), []
                rows.append(row)
            yield out(found)
        yield out(done())

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest byte of each signature value: equal values have equal bytes."""
    for batch in batches:
        low = [np.frombuffer(x, np.uint8)[3::4].tobytes() for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(low, pa.binary()), batch.column(4)], ["id", "n", "loose", "low", "heads"])


def _meet(table: DataFrame, *key: str) -> DataFrame:
    """A row of every pair of its group's ``blocks`` that its own block is in, as bi <= bj."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    paired = table.withColumn("own", own).withColumn("other", F.explode(meets))
    paired = paired.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    return paired.repartition(*key, "bi", "bj").sortWithinPartitions(*key, "bi", "bj", "id")


def _crowds(classes: DataFrame, loose: DataFrame, trees: int, depth: int, least: float, percent: int) -> DataFrame:
    """Links of rows that share ``MIN_DEPTH`` leading values with more rows than the look-back reaches.

    Every group of such rows that is not one loose cluster already is scanned whole, in pairs of blocks.
    """
    head = f"transform(sequence(0, {trees - 1}), t -> substring(sig, t * {4 * depth} + 1, {4 * MIN_DEPTH}))"
    tagged = classes.join(loose.select("id", F.col("component").alias("loose")), "id", "left").select("id", "n", F.coalesce("loose", "id").alias("loose"), "sig", F.expr(head).alias("heads"))
    keys = tagged.select("id", "loose", F.posexplode("heads").alias("tree", "prefix"))
    groups = keys.groupBy("tree", "prefix").agg(F.count("*").alias("docs"), F.min("loose").alias("x"), F.max("loose").alias("y")).filter(f"docs > {LOOK_BACK + 1} AND x <> y")
    groups = materialise(groups.select("tree", "prefix", F.ceil(F.col("docs") / BLOCK_DOCS).cast("int").alias("blocks")), "crowds")
    low = tagged.mapInArrow(released(_low_bytes), "id long, n long, loose long, low binary, heads array<binary>")
    members = low.select("id", "n", "loose", "low", F.posexplode("heads").alias("tree", "prefix")).join(groups, ["tree", "prefix"])
    rows = _meet(members, "tree", "prefix").select("tree", "prefix", "bi", "bj", "id", "n", "loose", "low")
    return rows.mapInArrow(released(_crowd_links(least, percent)), "a long, b long").distinct()


def _set_maker(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_shingles(t.lower().split(), cache, size).tobytes() for t in binary_rows(part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], ["cluster", "id", "blocks", "shingles"])

    return run


def _linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, least linked id) of the documents of a block that confirmed links join, from full intersections.

    Postings of the block's shingles give a document's intersections with all others in one count.
    """
    m, sizes = len(ids), np.asarray([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    posting = owner[np.argsort(which, kind="stable")]
    ends = np.cumsum(counts)
    offsets = np.cumsum([0, *sizes])
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(m):
        own = which[offsets[i] : offsets[i + 1]]
        own = own[counts[own] > 1]
        if not len(own):
            continue
        c = counts[own]
        places = np.arange(c.sum()) + np.repeat(ends[own] - c - np.concatenate([[0], np.cumsum(c)[:-1]]), c)
        shared = np.bincount(posting[places], minlength=m)
        for j in np.nonzero(100 * shared >= percent * (sizes[i] + sizes - shared))[0].tolist():
            a, b = find(i), find(j)
            if a != b:
                a, b = (a, b) if ids[a] <= ids[b] else (b, a)
                root[b] = a
    return [(int(ids[i]), int(ids[r])) for i in range(m) if ids[r := find(i)] != ids[i]]


def _block_links(percent: int) -> Callable:
    """Over rows (cluster, bi, bj, id, shingles) grouped by block: the links' spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def done() -> list[tuple[int, int]]:
            return _linked(np.asarray(ids, np.int64), sets, percent) if len(ids) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for *own, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    found += done()
                    key, ids, sets = own, [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(data, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    shingle: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = 5,
) -> DataFrame:
    """Connected groups of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set has its distinct
    ``shingle``-word shingles, or its whole sequence where it has fewer words. Returns a row for each input row:
    ``doc_id, n_shingles, component_id`` (smallest id of its group, itself included) and ``kept``
    (``doc_id = component_id``). Documents without a word, null texts among them, have an empty set and are linked
    with nothing. A row without an id is linked with nothing and has a null component and ``kept`` true. Rows that
    repeat an id are one document. An empty table gives no rows. Other columns are not read.

    1. One pass makes each text's signature of ``trees * depth`` MinHash values. Equal word sequences become one
       class at once; only its smallest id goes on, so exact copies cost one row, however many there are.
    2. The forest: for each tree, classes are sorted by that tree's values (a range shuffle with the id as last
       key, so equal signatures spread over tasks). A row's candidates are the up to ``LOOK_BACK`` rows before it that
       share at least ``MIN_DEPTH`` leading values: sparse regions use shallow prefixes, crowded ones only their
       deepest. A pair at 0.85 shares three values in a given tree with probability 0.61, so it is apart in all
       24 with probability 1e-10 (at 0.80: 3e-8). Candidates grow with the rows, never with a group's square.
    3. Candidates whose whole signatures agree within ``SIGMAS`` standard deviations of the threshold tie classes
       into loose clusters. Where more rows share the leading values than the look-back reaches, those between need
       not be similar: every such group that is not one loose cluster already is scanned whole, each pair by a byte
       of every signature value (equal values always pass), in pairs of blocks that return a spanning forest.
    4. Every pair inside a loose cluster is then held to the exact test on full sets: this is what makes the result
       whole. A cluster is cut into blocks of at most 1,024 documents or two million shingles; each pair of blocks is
       a task of its own that counts all intersections from the block's postings and returns a spanning forest, at
       most a row for each document. No task grows with a cluster. Last, forests of several blocks are joined.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialise(rows.mapInArrow(released(_sketcher(shingle, trees, depth, seed)), "id long, n long, key binary, sig binary"), "sketches")
    known = sketches.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min(F.struct("id", "n", "sig")).alias("x")).select("key", "x.id", "x.n", "x.sig")
    classes = materialise(classes, "classes")

    grown = classes.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    forest = grown.select("tree", F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})").alias("s"), "id", "n")
    forest = forest.repartitionByRange("tree", "s", "id").sortWithinPartitions("tree", "s", "id")
    near = materialise(forest.mapInArrow(released(_neighbours(LOOK_BACK, MIN_DEPTH, percent)), _NEIGHBOUR_SCHEMA), "neighbours")
    candidates = near.filter("kind = 0").select("a", "b").union(_across(near, percent)).distinct()

    p = percent / 100
    least = p - SIGMAS * math.sqrt(p * (1 - p) / (trees * depth))
    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    signed = candidates.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    loose = materialise(components(signed.mapInArrow(released(_agreeing(least)), "a long, b long")), "loose")
    discard(near)
    crowded = _crowds(classes, loose, trees, depth, least, percent)
    clusters = components(loose.select(F.col("id").alias("a"), F.col("component").alias("b")).union(crowded))
    clusters = materialise(clusters.select("id", F.col("component").alias("cluster")), "clusters")
    discard(loose)

    sized = clusters.join(classes.select("id", "n"), "id").groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = clusters.join(sized.select("cluster", blocks.alias("blocks")), "cluster")
    texts = rows.join(members.hint("shuffle_hash"), "id").select("cluster", "id", "blocks", "text")
    sets = texts.mapInArrow(released(_set_maker(shingle)), "cluster long, id long, blocks int, shingles binary")
    paired = _meet(sets, "cluster").select("cluster", "bi", "bj", "id", "shingles")
    links = paired.mapInArrow(released(_block_links(percent)), "a long, b long")
    joined = components(links)

    found = known.select("id", "key").join(classes.select("key", F.col("id").alias("first")), "key")
    found = found.join(joined.select(F.col("id").alias("first"), "component"), "first", "left").groupBy("id").agg(F.min(F.coalesce("component", "first")).alias("component"))
    out = sketches.select("id", "n", "key").join(found, "id", "left")
    group = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        group.alias("component_id"),
        F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"),
    )


def _across(near: DataFrame, percent: int) -> DataFrame:
    """Pairs that a partition's border parts: its first rows with the last ones before, a few rows a partition."""
    edges = near.filter("kind > 0").select("kind", "part", "place", "a", F.col("na").alias("n"), "tree", "prefix")
    w = Window.orderBy("part", "kind", "place").rowsBetween(-4 * LOOK_BACK, -1)
    row = F.struct("kind", "part", "a", "n", "tree", "prefix")
    seen = edges.withColumn("before", F.collect_list(row).over(w)).filter("kind = 1").select("part", "a", "n", "tree", "prefix", F.explode("before").alias("x"))
    seen = seen.filter(
        "x.kind = 2 AND x.part < part AND x.tree = tree AND x.prefix = prefix AND x.a <> a"
        f" AND 100 * least(x.n, n) >= {percent} * greatest(x.n, n)"
    )
    return seen.select(F.least("a", "x.a").alias("a"), F.greatest("a", "x.a").alias("b"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
s AS (SELECT doc_id, hash(shingle) AS h FROM (SELECT DISTINCT doc_id, shingle FROM g)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id
"""
