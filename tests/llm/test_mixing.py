import heapq
import random

from quire.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 250 * 2 / 3]
    assert mixing.targets([10, 0, 10], [3, 1, 2], 30, 2) == [18.0, 0.0, 12.0]
    assert mixing.targets([], [], 0, 2) == []


def test_seats_are_those_of_the_highest_quotients():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 7)
        weights, caps = [float(random.randint(0, 50)) for _ in range(n)], [random.randint(0, 30) for _ in range(n)]
        seats = random.randint(0, 60)
        want, heap = [0] * n, [(-w, i) for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 and c > 0]
        heapq.heapify(heap)
        for _ in range(min(seats, sum(c for c, w in zip(caps, weights) if w > 0))):
            _, i = heapq.heappop(heap)
            want[i] += 1
            if want[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * want[i] + 1), i))
        assert mixing.sainte_lague(weights, seats, caps) == want


def test_query(spark, tiny):
    rows = mixing.op5_source_mix(spark, tiny).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total, by = 0, {}
    for r in rows:
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        total += r["size"]
        by.setdefault(docs[r.doc_id].source, []).append(r)
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    wanted = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * total, 2)
    for s, n, t in zip(order, sizes, wanted):
        assert {(r.source_size, round(r.target, 6)) for r in by[s]} == {(n, round(t, 6))}
        assert abs(sum(r.taken for r in by[s]) - t) <= 64 + 0.01 * t
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op5_source_mix(spark, tiny).collect()))


def test_many_shards_and_odd_rows(odd, none):
    rows = mixing.plan_mix(odd, shard_words=500, block_words=8).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r.source for r in rows} == {"a", "b", "é", None}
    assert mixing.plan_mix(none).collect() == []


def test_written_words_are_the_planned_ones(odd):
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(docs, block_words=8).collect()}
    out = mixing.mix_documents(docs, block_words=8)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {k: v for k, v in plan.items() if v}


def test_shards_come_in_bundles(odd, monkeypatch):
    """Many bundles of few shards give the same totals, and names like those used inside don't clash."""
    monkeypatch.setattr(mixing, "BUNDLE", 3)
    rows = mixing.plan_mix(odd, shard_words=500, block_words=8).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8 * 70
    named = odd.selectExpr("*", "1 AS mix_size", "2 AS mix_id", "3 AS doc", "4 AS plan", "5 AS words")
    out = mixing.mix_documents(named, block_words=8)
    assert out.columns == named.columns and {r.mix_id for r in out.collect()} == {2}
