import random

import duckdb

from tickloom.llm import decontam as d


def brute(items, text, window=10):
    words = d.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = d.words_of(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(hit), found


def test_search_matches_brute_force():
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice("aé b c d".split()) for _ in range(n))
    for _ in range(200):
        items = [(str(i), say(rnd.choice((0, 1, 2, 3, 5, 8)))) for i in range(4)]
        text = say(rnd.randint(0, 40))
        spans, found = d.scan(d.compile_items(items, 4), d.words_of(text))
        assert (sum(b - a for a, b in spans), found) == brute(items, text, 4)


def test_blocks_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x A b c y"), (1, "x A b c y"), (None, None), (2, ""), (3, "q q")], "doc_id long, text string").selectExpr("*", "1 AS found_0", "'z' AS items")
    bench = spark.createDataFrame([(7, "a B c"), (7, "a B c"), (8, None), (None, "q"), (9, "c y")], "item_id long, text string")
    whole, parts = (d.find_benchmark(spark, docs, bench, max_block_bytes=m, into="hits").selectExpr("doc_id", "hits.n_words AS n", "array_sort(hits.items) AS i", "items") for m in (10**6, 2))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    got = {r.doc_id: (r.n, r.i) for r in whole.collect()}
    assert got == {1: (5, ["7", "9"]), None: (0, []), 2: (0, []), 3: (2, [])}
    empty = d.find_benchmark(spark, docs, bench.limit(0), into="hits")
    assert empty.where("size(hits.items) > 0").count() == 0


def test_very_long_text():
    tables = d.compile_items([("1", " ".join(f"w{k}" for k in range(12)))])
    words = ["a"] * 500_000 + [f"w{k}" for k in range(1, 11)] + ["a"] * 500_000
    spans, found = d.scan(tables, d.words_of(" ".join(words)))
    assert found == {"1"} and sum(b - a for a, b in spans) == 10


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(d.OP1_SQL).df()
    got = d.op1_decontamination(spark, sf).toPandas()
    columns = sorted(want.columns)
    assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist()


def test_no_block_exceeds_its_bound(spark):
    """Many small items, an id with much text in many rows, and items above half the bound and above all of it."""
    rows = [(str(k), "w" * (k % 90)) for k in range(400)] + [("hot", "x" * 40)] * 300 + [("large", "y" * 600), ("huge", "z" * 3000)]
    placed = d.blocks_of(spark.createDataFrame(rows, "i string, t string").repartition(7), 1000)
    got = placed.collect()
    assert sorted((r.i, r.t) for r in got) == sorted(rows)
    size, of = {}, {}
    for r in got:
        size[r.block] = size.get(r.block, 0) + len(r.i) + len(r.t)
        of.setdefault(r.block, set()).add(r.i)
    assert all(n <= 1000 or of[b] == {"huge"} for b, n in size.items()) and len(size) <= 2 + 2 * sum(map(len, (i + t for i, t in rows))) // 1000
    assert d.blocks_of(spark.createDataFrame([], "i string, t string"), 1000).count() == 0
