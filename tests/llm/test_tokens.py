import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import bpe, token_files, token_fsm
from tickloom.llm.common import shared_dir

rnd = random.Random(3)
SIGNS = "ab e'sthe  \n\téß中́\U0001f600² \u0085!?.,019_ªIİΣσ rvlm'd<|•"
TEXTS = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
TEXTS += [None, "", "a" * 3000, "the" * 400, "I'll it's <|endoftext|> x <|startoftext|>", " ".join("the" * 3 for _ in range(99))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_bpe_matches_tiktoken():
    b = bpe.Bpe(P.path(bpe.VOCABULARY), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    got = b.encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t or "") for t in TEXTS]
    assert b.decode(got) == [(t or "").encode() for t in TEXTS]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    monkeypatch.setattr(bpe, "LONG_PIECE", 4)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 7)
    test_bpe_matches_tiktoken()


def test_many_long_pieces_in_one_batch():
    """The queries have 400 MB and nowhere to spill."""
    own = random.Random(11)
    b = bpe.Bpe(P.path(bpe.VOCABULARY), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    texts = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randint(100, 512))) for _ in range(700)]
    texts += ["，".join("".join(chr(own.randrange(0x4E00, 0x9000)) for _ in range(15)) for _ in range(40)) for _ in range(64)]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_very_long_pieces_match_tiktoken():
    own = random.Random(12)
    b = bpe.Bpe(P.path(bpe.VOCABULARY), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    texts = ["a" * 1_000_000, " " * 1_000_000, "ACGT" * 5000, "".join(own.choice("etaoin") for _ in range(3000)), "\u6587\u5b57" * 3000, "".join(own.choice("-=_*") for _ in range(2000))]
    # The library's own pattern fails on runs of this length, so it is given the pieces.
    want = [sum((enc._encode_single_piece(x.encode()) for x in b.split(t)), []) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(texts)] == want


def test_long_varied_pieces_match_tiktoken():
    """Pieces of windows that meet, of windows that do not, and of both; time grows with the length."""
    own = random.Random(13)
    b = bpe.Bpe(P.path(bpe.VOCABULARY), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(own.choice(of) for _ in range(n))
    texts = [letters(n) for n in (512, 513, 640, 641, 897, 1025, 3000)] + [letters(2000) + "a" * 3000 + letters(2000), letters(6000, "ab"), letters(4000, "ACGT"), "ab" * 5000, letters(1500) * 4]
    texts += ["".join(chr(own.randrange(0x4E00, 0x9FFF)) for _ in range(4000)), letters(100_000)]
    began = time.time()
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    assert time.time() - began < 120


def test_odd_tables(spark):
    """Clashing columns, null and repeated ids, and no rows, for BPE and for token counts."""
    rows = [(1, None), (1, "a b"), (None, ""), (1, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS n_tokens", "4 AS both")
    coded = bpe.encode_documents(docs, P.path(bpe.VOCABULARY))
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in coded.collect()) == [("1", b""), ("1", b"a b"), ("1", b"a b"), ("None", b"")]
    assert bpe.encode_documents(docs.limit(0), P.path(bpe.VOCABULARY)).count() == 0
    assert token_fsm.op4_token_counts.__doc__


def test_transducer_matches_library(library, monkeypatch):
    t = token_fsm.Transducer(P.path(token_fsm.TOKENIZER))
    want = [len(library.encode(x or "", add_special_tokens=False).ids) for x in TEXTS]
    assert [t.count(x) for x in TEXTS] == want
    assert [t.count(x, chunk=7) for x in TEXTS] == want
    monkeypatch.setattr(token_fsm, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(token_fsm, "MAX_EDGES", 50)
    monkeypatch.setattr(token_fsm, "MAX_PATHS", 5)
    assert [t.count(x) for x in TEXTS] == want


def test_chunk_maps_compose_associatively():
    t = token_fsm.Transducer(P.path(token_fsm.TOKENIZER))
    text = "don't stop the 123 music's play re'lly ok"
    maps = [t.chunk_map(text[i : i + 3], lambda s: t.read(t.gap, s)) for i in range(0, len(text), 3)]
    left = maps[0]
    for m in maps[1:]:
        left = t.compose(left, m)
    assert t.scan(maps)[-1] == left


def test_encoder_matches_library(library, monkeypatch):
    for cached in (token_files.CACHED, 3):
        monkeypatch.setattr(token_files, "CACHED", cached)
        e = token_files.Encoder(P.path(token_files.TOKENIZER), 2)
        assert [x[:-1].tolist() for x in e.encode(TEXTS)] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_plain_pieces_go_to_the_model_at_once(library):
    """New lower-case ASCII pieces cost no pass of the library's normalizer and splitter, and have the same ids."""
    e = token_files.Encoder(P.path(token_files.TOKENIZER), None)
    whole, asked = e._whole, []
    e._whole = lambda text: asked.append(text) or whole(text)
    texts = ["".join(rnd.choice("abcdefgh ijk'st.,!?0129 \n") for _ in range(200)) for _ in range(200)] + ["the" * 500, "i'll don't 12,5 -- ~~~", "caf\u00e9 bar", "a\x00b a\x7fb"]
    assert [x.tolist() for x in e.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked == ["caf\u00e9", "\x00", "\x7f"]


def test_every_code_point_below_256(library):
    """\\x1c to \\x1f are white space to Python alone."""
    path = P.path("word_bpe_49k.json")
    e, t, b = token_files.Encoder(path, None), token_fsm.Transducer(path), bpe.Bpe(P.path(bpe.VOCABULARY), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    for c in map(chr, range(256)):
        for text in (c, f"ab{c}cd", f"a{c}{c}'s", f"1{c}é!", f"中 x{c}y", f"don't{c}stop " * 5):
            want = library.encode(text, add_special_tokens=False).ids
            assert e.encode([text])[0].tolist() == want, text
            assert [t.count(text, chunk=k) for k in (1, 2, 7, token_fsm.CHUNK)] == [len(want)] * 4, text
            assert np.frombuffer(b.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text), text


def test_perfect_hash():
    keys = np.array(rnd.sample(range(-(10**12), 10**12), 5000))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    s = token_files.Shard(token_files.pack(sorted(keys.tolist()), [np.array([k % 7]) for k in range(5000)], 2))
    assert [x.tolist() for x in s.get(sorted(keys.tolist())[17])] == [[17 % 7]]
    assert s.get(10**15) == []


def test_token_files(spark, library):
    df = spark.createDataFrame([(None, "x y"), (3, "abc"), (3, "abd"), (3, "abc"), (1, None), (-2, "")], "doc_id long, text string")
    for shard_tokens in (4, 1000):
        m = token_files.write_token_files(df, shared_dir(spark, "t"), P.path(token_files.TOKENIZER), shard_tokens=shard_tokens)
        rows = token_files.read_token_files(m).orderBy("start").collect()
        assert [r.key for r in rows] == [None, -2, 1, 3, 3, 3]
        assert [r.start for r in rows] == np.cumsum([0] + [len(r.ids) // 4 for r in rows[:-1]]).tolist()
    empty = token_files.write_token_files(df.limit(0), shared_dir(spark, "t"), P.path(token_files.TOKENIZER))
    assert token_files.read_token_files(empty).count() == 0


def test_queries_match_libraries(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    files = {r.doc_id: r for r in token_files.op2_token_files(spark, sf).collect()}
    counts = {r.doc_id: r for r in token_fsm.op4_token_counts(spark, sf).collect()}
    coded = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, sf).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    assert files.keys() == counts.keys() == coded.keys() == docs.keys()
    for d in sorted(docs):
        ids = library.encode(docs[d], add_special_tokens=False).ids
        with_end = np.array([*ids, 2], dtype="<u4")
        assert (files[d].start, files[d].n_tokens, files[d].ids_crc32) == (start, len(with_end), zlib.crc32(with_end.tobytes()))
        assert (counts[d].n_bytes, counts[d].n_tokens, counts[d].over_limit) == (len(docs[d].encode()), len(ids), len(ids) > 2048)
        raw = np.array(enc.encode_ordinary(docs[d]), dtype="<u4")
        assert (coded[d].n_tokens, coded[d].ids_sha256) == (len(raw), hashlib.sha256(raw.tobytes()).hexdigest())
        assert coded[d].decoded_sha256 == hashlib.sha256(docs[d].encode()).hexdigest()
        start += len(with_end)
