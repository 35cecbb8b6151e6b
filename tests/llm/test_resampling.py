import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rnd = random.Random(3)


def features(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(low)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out, eligible = [], []
    for doc, text in docs:
        found, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[: 5 * len(eligible) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def test_crc_matrix_is_crc32():
    for size in (1, 2, 7, 300):
        rows = [bytes(rnd.randrange(256) for _ in range(size)) for _ in range(50)]
        got = resampling.crc_matrix(np.frombuffer(b"".join(rows), np.uint8).reshape(50, size).T)
        assert got.tolist() == [zlib.crc32(r) for r in rows]


def test_slices_of_many_lengths():
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(20_000)), np.uint8)
    start = np.array([rnd.randrange(15_000) for _ in range(400)])
    length = np.array([rnd.choice((1, 2, 3, 9, 40, 2_048, 2_049, 5_000)) for _ in start])
    assert resampling.crcs(data, start, length).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start, length)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_pieces_do_not_matter(monkeypatch, size):
    """A text cut anywhere has the features of the whole."""
    monkeypatch.setattr(resampling, "PIECE_BYTES", size)
    texts = ["", None, "One", "two words", "  Ünïcode wörds, 3 numbers-and more -- ", "x" * 200, " ".join(rnd.choice("abcdefgh") for _ in range(300)), "\x00\x7f", "end \ttabs\nlines "]
    got = Counter()
    for piece in resampling.pieces(texts):
        got.update(zip(*(x.tolist() for x in resampling.buckets_of(*piece))))
    assert got == Counter((i, bucket(f)) for i, t in enumerate(texts) for f in features(t)[0])


def test_many_short_texts_of_a_piece_take_seconds():
    """A piece's words are gathered once, not copied again for each text."""
    began = time.time()
    words = [len(piece[0]) for piece in resampling.pieces(["ab cd ef gh"] * 80_000)]
    assert words == [320_000] and time.time() - began < 5


def odd_docs():
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "NAÏVE", "x" * 3000, "日本語"]
    docs = [(i, " ".join(rnd.choice(vocabulary[: rnd.choice((20, 64))]) for _ in range(rnd.choice((0, 5, 19, 20, 21, 80))))) for i in range(300)]
    return docs + [(1000, None), (1001, ""), (None, "no id " * 10), (1002, "Long, " * 30_000)] + [(2000 + i, docs[0][1] + " same tail" * 10) for i in range(100)]


def test_matches_brute_force(spark):
    docs, target = odd_docs(), ["w1 w2 w3 w4 été", "w5 w6", None, "", "w7"]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "3 AS score", "4 AS rank")
    drawn = resampling.importance_sample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in drawn.collect()), key=str) == brute(docs, target)


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = [(7, "some words " * 15)] * 100
    drawn = resampling.importance_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("other",)], "text string")).collect()
    assert len(drawn) == 100 and sorted(r["rank"] for r in drawn if r["rank"]) == [1, 2, 3, 4, 5] and len({r.score for r in drawn}) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_sample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.n_features, r["rank"]) for r in resampling.importance_sample(one, none).collect()] == [(1, 6, None)]


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.op12_resampling(spark, sf).collect()), key=str)
    assert got == brute(docs, target)
