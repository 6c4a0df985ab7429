import hashlib

from quire.llm import lines

from duck import same


def brute(rows):
    blank = " \t\n\x0b\x0c\r"
    last = 1 << 62
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (last if i is None else i)]
        out.append((i, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_sql(spark, tiny):
    same(lines.op3_line_dedup(spark, tiny), lines.SQL, tiny)


def test_odd_rows_match_brute_force(odd):
    from conftest_rows import texts

    from pyspark.sql import functions as F

    out = lines.dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(texts())


def test_more_documents_than_two(spark):
    rows = [(i, "a line that some share\n" + ("this one only a pair has" if i < 2 else "")) for i in range(3)]
    out = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert out == {0: 0, 1: 1, 2: 1}


def test_empty_table(none):
    assert lines.dedup_lines(none).collect() == []
