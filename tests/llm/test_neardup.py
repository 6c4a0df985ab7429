from collections import Counter

from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.neardup import SQL, near_duplicates, op1_minhash_near_dedup

from duck import same
from llm_data import brute_components


def as_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert as_rows(op1_minhash_near_dedup(spark, tiny)) == brute_components([(r.doc_id, r.text) for r in docs], 85)


def test_whole_table_equals_sql(spark, tiny):
    same(op1_minhash_near_dedup(spark, tiny), SQL, tiny)


def test_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert found[1].component_id == found[2].component_id == found[3].component_id == 1
    assert found[6].component_id == found[7].component_id == 6 and found[7].n_shingles == 1 and not found[7].kept
    assert all(found[i].n_shingles == 0 and found[i].component_id == i and found[i].kept for i in (4, 5, 10))
    assert found[None].component_id is None and found[None].kept
    assert found[8].n_shingles > 20_000


def test_empty_table(none):
    assert near_duplicates(none).collect() == []


def test_crowded_group_is_whole(spark):
    """A hundred edited copies and other texts: one group, found whole over several blocks."""
    import quire.llm.neardup as op

    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 300, 3))]
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60))) for i in range(50)]
    df, old = spark.createDataFrame(rows, "doc_id long, text string"), op.BLOCK_DOCS
    try:
        op.BLOCK_DOCS = 16
        got = as_rows(near_duplicates(df))
    finally:
        op.BLOCK_DOCS = old
    assert got == brute_components(rows, 85)
    assert Counter(c for _, c in got.values())[0] == 100


def test_near_copies_in_a_crowd_are_found(spark, monkeypatch):
    """Two near copies of a passage that many longer texts hold, with those between them in every order."""
    import quire.llm.neardup as op

    monkeypatch.setattr(op, "BLOCK_DOCS", 256)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(0, f"{passage} a0 a1 a2"), (100_000, f"{passage} b0 b1 b2")]
    rows += [(1 + i, f"{passage} " + " ".join(f"c{i}_{j}" for j in range(20))) for i in range(700)]
    got = as_rows(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_components(rows, 85) and got[100_000][1] == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    found = {r.id: r.component for r in components(edges).collect()}
    assert set(found.values()) == {0, 500} and len(found) == 203
