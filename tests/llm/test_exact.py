import hashlib
import string
from collections import defaultdict

import duckdb
import pytest

from tickloom.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for docs in groups.values():
        keep = max((d for d in docs if d is not None), default=None)
        out += [(d, keep, len(docs)) for d in docs]
    return sorted(out, key=str)


def odd_rows():
    long = "Long text. " * 20_000
    rows = [(1, None), (2, ""), (3, " "), (4, "ÀB"), (5, "àb"), (6, "Àb"), (7, "K"), (8, "K"), (9, "k"), (None, "k"), (None, "alone"), (10, long), (11, long[:-1] + "!"), (12, long.upper())]
    rows += [(20, "same id"), (20, "same id"), (20, "same id"), (19, "Same id")]
    rows += [(100 + i, "hot copy") for i in range(200)]
    rows += [(400 + i, "p" * 300 + chr(97 + i % 7) + "tail") for i in range(30)]
    return rows


@pytest.mark.parametrize("bound", [300_000, 0])
def test_matches_brute_force(spark, monkeypatch, bound):
    """With broadcast keys, and with shuffled ones."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", bound)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bytes", "'x' AS digest", "2 AS row", "3 AS start", "4 AS id")
    got = exact_dedup.exact_duplicates(df, carry=["digest", "bytes"]).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({(t or "").translate(LOWER) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and {(r.digest, r.bytes) for r in got} == {("x", 1)}


def test_texts_alone(spark):
    """By length, by prefix, and only by what comes after the prefix."""
    rows = [(1, "a"), (2, "b"), (3, "ccc"), (4, "p" * 400 + "a"), (5, "p" * 400 + "b")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i, 1, True) for i in range(1, 6)]


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_sql(spark, sf):
    got = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.op11_exact_dedup(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(exact_dedup.OP11_SQL).fetchall())
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {g[0]: g[4] for g in got} == {d: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() for d, t in docs}
