"""Pairs of units that may recur: evidence channels, candidate edges, and complete-link families."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CANDIDATE_THRESHOLD, ROLE_MARKERS
from ..functions import text as T
from .ledger import anchors

#: What anchors and roles can give a pair without a shared concept.
WITHOUT_CONCEPT = 0.30


#: What scoring needs of a unit beside what it shares with another: numbers of words, concepts and anchors, and the role.
_SIZES = ("words", "themes", "anchors", "role")
_ROLES = [role for role, _ in ROLE_MARKERS]


def _sides(units: DataFrame) -> DataFrame:
    side = units.select("doc_id", "ord", "content", "concepts", anchors(quotations=False).alias("hard"), F.array_position(F.array(*map(F.lit, _ROLES)), F.col("role")).cast("int").alias("role"))
    return side.select("doc_id", "ord", F.size("content").alias("words"), F.size("concepts").alias("themes"), F.size("hard").alias("anchors"), "role", "content", "concepts", "hard")


def _overlap(shared: str, a: str, b: str) -> str:
    """SQL of the larger of Jaccard and three quarters of containment; 0 if a side is empty."""
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0D ELSE greatest({shared} / CAST({a} + {b} - {shared} AS DOUBLE), 0.75D * ({shared} / CAST(least({a}, {b}) AS DOUBLE))) END"


def _score(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """pairs: doc_id, left_ord, right_ord, the sizes of both sides (l_words, r_words, ...), and raw, con, hard: the
    numbers of content words, concepts and anchors that both have."""
    both = pairs.select(
        "doc_id", "left_ord", "right_ord",
        F.expr(_overlap("raw", "l_words", "r_words")).alias("lex"),
        F.expr(_overlap("con", "l_themes", "r_themes")).alias("con"),
        F.expr("CASE WHEN l_anchors + r_anchors = 0 THEN 0.5D ELSE hard / CAST(l_anchors + r_anchors - hard AS DOUBLE) END").alias("anc"),
        F.expr("CASE WHEN l_role = r_role THEN 1D ELSE 0.35D END").alias("rol"),
    ).withColumn("all", F.expr("0.35D * lex + 0.35D * con + 0.15D * anc + 0.15D * rol"))
    # rounding is the costly part; the margin is what it can add
    near = both.filter(f"all >= {threshold - 0.0001}D") if threshold > 0 else both
    return near.select(
        "doc_id", "left_ord", "right_ord",
        T.rounded("lex", "lexical_overlap"), T.rounded("con", "concept_overlap"), T.rounded("anc", "anchor_overlap"), F.col("rol").alias("role_compatibility"), T.rounded("all", "composite"),
    )


def _as(df: DataFrame, side: str, *more: str) -> DataFrame:
    """A side of the pairs: its place and sizes under its own names."""
    place = "left_ord" if side == "l" else "right_ord"
    return df.select("doc_id", F.col("ord").alias(place), *(F.col(c).alias(f"{side}_{c}") for c in _SIZES), *more)


def all_pairs(units: DataFrame) -> DataFrame:
    """Evidence of every pair of a document: quadratic, for thresholds that blocking can't serve, and for tests."""
    side = _sides(units).withColumn("own", F.struct("content", "concepts", "hard"))
    pairs = _as(side, "l", "own").withColumnRenamed("own", "a").join(_as(side, "r", "own").withColumnRenamed("own", "b"), "doc_id").filter("left_ord < right_ord")
    shared = lambda c: F.size(F.array_intersect(f"a.{c}", f"b.{c}"))
    return _score(pairs.select("*", shared("content").alias("raw"), shared("concepts").alias("con"), shared("hard").alias("hard")))


def blocked_pairs(units: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Evidence of the pairs that share a concept: all that can reach a threshold above 0.30, for anchors and roles
    give at most that much.

    Units meet on (document, word), where a word is one that is a concept too, a concept of a group, a word of a group, or
    an anchor. All that scoring needs are the numbers of words met and the sizes of both sides, so no wide row is
    fetched for a pair. Words are dealt by document once; the pairs, far more of them, are met and counted there. So a
    document's pairs are counted in one task, as its grouping is later; they spill, whatever their number.
    """
    kind = lambda n, words: F.transform(words, lambda w: F.struct(F.lit(n).alias("kind"), w.alias("word")))
    each = F.concat(
        kind(0, F.array_intersect("content", "concepts")), kind(1, F.array_except("concepts", "content")), kind(2, F.array_except("content", "concepts")), kind(3, F.col("hard")),
    )
    held = _sides(units).select("doc_id", F.struct("ord", *_SIZES).alias("u"), F.inline(each)).repartition("doc_id")
    # a join on (document, word) would deal both sides anew and its pairs once more; groups are content with the deal by document
    shared = held.groupBy("doc_id", "kind", "word").agg(F.sort_array(F.collect_list("u")).alias("at")).filter(F.size("at") > 1)
    shared = shared.select("doc_id", "kind", "at", F.posexplode("at").alias("i", "a"))
    met = shared.select("doc_id", "kind", "a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("b"))
    sides = [F.col(f"{x}.{c}").alias(f"{side}_{c}") for side, x in (("l", "a"), ("r", "b")) for c in _SIZES]
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    met = met.select("doc_id", "kind", F.col("a.ord").alias("left_ord"), F.col("b.ord").alias("right_ord"), *sides)
    pairs = met.groupBy(*(c for c in met.columns if c != "kind")).agg(count(0, 2).alias("raw"), count(0, 1).alias("con"), count(3).alias("hard"))
    return _score(pairs.filter("con > 0"), threshold)


def candidate_edges(units: DataFrame, threshold: float = CANDIDATE_THRESHOLD) -> DataFrame:
    """Pairs whose rounded composite reaches the threshold."""
    pairs = blocked_pairs(units, threshold) if threshold > WITHOUT_CONCEPT else all_pairs(units)
    return pairs.filter(F.col("composite") >= threshold)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("doc_id", F.col("left_ord").alias("ord")).union(edges.select("doc_id", F.col("right_ord").alias("ord")))
    return ends.groupBy("doc_id", "ord").agg(F.count("*").alias("degree"))


def _cliques(edges: Iterable[tuple[int, int]]) -> Iterator[list[int]]:
    """Complete-link groups of one document, in order of emission.

    In each component, by its smallest unit: the unit with most remaining neighbours starts a group, its neighbours
    join in order of theirs if they are linked with all members; ties go to the earlier unit.
    """
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    unseen = set(near)
    for start in sorted(near):
        if start not in unseen:
            continue
        part, front = {start}, [start]
        while front:
            more = near[front.pop()] - part
            part |= more
            front += more
        unseen -= part
        if all(len(near[u]) == len(part) - 1 for u in part):
            yield sorted(part)  # all are linked with all, as most components are
            continue
        rank = {u: (-len(near[u]), u) for u in part}
        heap = sorted(rank.values())
        while part:
            best = heapq.heappop(heap)
            seed = best[1]
            if seed not in part or rank[seed] != best:
                continue  # left already, or has lost neighbours since
            group = {seed}
            fits = near[seed] & part
            for u in sorted(fits, key=rank.__getitem__):
                if u in fits:
                    group.add(u)
                    fits &= near[u]
            part -= group
            # only neighbours of those that left have other ranks now
            lost = Counter(v for u in group for v in near[u] if v in part)
            for v, n in lost.items():
                rank[v] = (rank[v][0] + n, v)
                heapq.heappush(heap, rank[v])
            if len(group) > 1:
                yield sorted(group)


def _group_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over edges sorted by document: (doc_id, emission, ord) of the members of each family."""
    doc, edges, first = None, [], True
    rows: list[tuple[int, int, int]] = []

    def done() -> None:
        rows.extend((doc, k, u) for k, group in enumerate(_cliques(edges)) for u in group)

    for batch in batches:
        for own, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if first or own != doc:
                if not first:
                    done()
                doc, edges, first = own, [], False
            edges.append((a, b))
        yield _member_rows(rows)
        rows.clear()
    if not first:
        done()
    yield _member_rows(rows)


def _member_rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "emission", "ord"])


def family_members(edges: DataFrame) -> DataFrame:
    """``doc_id, emission, ord``. The greedy grouping is sequential within a document, so a document's edges stream
    through one task in order; a partition holds many documents and one of them at a time in memory."""
    dealt = edges.select("doc_id", "left_ord", "right_ord").repartition("doc_id").sortWithinPartitions("doc_id", "left_ord", "right_ord")
    return dealt.mapInArrow(_group_documents, "doc_id long, emission int, ord int")


def _has_root(words: str, *roots: str) -> str:
    return "exists({}, x -> {})".format(words, " OR ".join(f"startswith(x, '{r}')" for r in roots))


def families(units: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_id, emission, family_id, label, unit_ids, sections``. Lists are as long as a family, which a document bounds."""
    lists = members.join(units, ["doc_id", "ord"]).groupBy("doc_id", "emission").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "ord", "unit_id", "content", "concepts"))).alias("m"), F.array_sort(F.collect_set("section_title")).alias("sections")
    )
    fold = lambda field, how: F.aggregate(F.slice("m", 2, F.size("m")), F.col("m")[0][field], lambda acc, x: how(acc, x[field]))
    lists = lists.select(
        "doc_id", "emission", "sections", F.col("m.unit_id").alias("unit_ids"),
        fold("content", F.array_intersect).alias("common_raw"), fold("concepts", F.array_intersect).alias("common"), F.array_distinct(F.flatten("m.content")).alias("vocabulary"),
    )
    # content words hold no stop word, so only "every" is left to take out
    shown = F.array_sort(F.array_distinct(F.transform(F.filter("common", lambda t: t != "every"), T.concept_display)))
    useful = F.filter(shown, lambda t: F.length(t) > 2)
    label = (
        F.when(F.expr(_has_root("vocabulary", "access")) & F.expr(_has_root("vocabulary", "review")), "Periodic access-control review")
        .when(F.array_contains("vocabulary", "source") & F.expr(_has_root("vocabulary", "transform")), "Transformation provenance record")
        .when((F.expr(_has_root("vocabulary", "evidence", "proof", "record")) | F.array_contains("common", "c2")) & F.expr(_has_root("vocabulary", "repeat", "restat", "explan", "consolid")), "Evidence-preserving consolidation")
        .when(F.size(useful) > 0, T.title_case(F.translate(F.array_join(F.slice(useful, 1, 3), " · "), "_", " ")))
        .otherwise("Recurring semantic theme")
    )
    ident = F.concat(F.lit("f_"), F.substring(F.sha2(F.array_join("unit_ids", "|"), 256), 1, 10))
    return lists.select("doc_id", "emission", ident.alias("family_id"), label.alias("label"), "unit_ids", "sections")


def family_units(units: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each member of the families found, with its unit's columns."""
    return members.join(units, ["doc_id", "ord"]).join(found.select("doc_id", "emission", "family_id"), ["doc_id", "emission"])


def family_pairs(own: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of the pairs inside families, with the ids of both units: a clique's pairs are all edges."""
    m = own.select("doc_id", "emission", "ord", "unit_id")
    left, right = m.withColumnsRenamed({"ord": "left_ord", "unit_id": "left_id"}), m.withColumnsRenamed({"ord": "right_ord", "unit_id": "right_id"})
    return edges.join(left, ["doc_id", "left_ord"]).join(right, ["doc_id", "right_ord", "emission"])


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """``doc_id, emission, pair_evidence``: "a|b" -> the five channels."""
    channels = F.struct("lexical_overlap", "concept_overlap", "anchor_overlap", "role_compatibility", "composite")
    entry = F.struct(F.concat_ws("|", "left_id", "right_id").alias("key"), channels.alias("value"))
    return pairs.groupBy("doc_id", "emission").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("pair_evidence"))


def family_means(pairs: DataFrame) -> DataFrame:
    """``doc_id, emission, pairs, mean_composite`` of each family, summed in order of the pairs."""
    listed = pairs.groupBy("doc_id", "emission").agg(F.array_sort(F.collect_list(F.struct("left_ord", "right_ord", "composite"))).alias("x"))
    mean = listed.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v["composite"]) / F.size("x"))
    return mean.select("doc_id", "emission", F.size("x").cast("long").alias("pairs"), T.rounded("mean", "mean_composite"))


def exact_repeats(units: DataFrame) -> DataFrame:
    """Sentences that recur word for word in a document and have content words."""
    return units.filter(F.size("content") > 0).groupBy("doc_id", "normalized_text").agg(F.count("*").alias("occurrences"), F.min("ord").alias("first_ord"), F.count_distinct("section_title").alias("titles")).filter("occurrences > 1")
