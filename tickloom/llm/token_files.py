"""Token ids as binary shards, with a minimal perfect hash from document keys to offsets.

Documents are range-partitioned and sorted by key. Each partition encodes its texts and
writes shards of at most ``SHARD_TOKENS`` ids (a single longer document has a shard of its
own). A shard holds its keys, token offsets, the index and the raw ids, two bytes each if
the vocabulary allows, else four:

    magic, then eight unsigned 64-bit numbers: documents, tokens, bytes of an id, distinct
    keys, levels, and three reserved; per level its number of bits; the bits of all levels;
    per slot the fingerprint (u32), first document (u32) and number of documents (u32);
    per document the key (i64) and whether there is one (u8); offsets (u64); ids.

The index cascades over levels: a key that is alone in its place of a level's bit table is
settled there, the others go on to the next level; the rank of its bit is its slot. The
stored fingerprint tells unknown keys apart. The manifest, one row a shard, is a Parquet
table written with Spark's commit, so only shards of tasks that succeeded are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.common import is_plain, shared_dir, short_batches, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 16_000_000
#: Words, or pieces of words, of a generation. A worker remembers two of each; what both have met stays.
CACHED = 350_000
MAGIC = b"TLOOM\x00\x00\x01"

MANIFEST = "part int, seq int, path string, first_key bigint, last_key bigint, n_docs bigint, n_tokens bigint"

#: The tokenizer's splitting pattern, and the same for lower-case words of characters that is_plain() admits.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9ß-öø-ÿ]+")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; the seed makes independent functions."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1. Bits take about three bits a key."""

    FINGERPRINT = 1 << 20

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, below = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(below + np.cumsum(ones) - ones)
            below += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            n_words = -(-2 * len(left) // 64)
            at = (_mix(left, len(levels)) % np.uint64(64 * n_words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in has any slot or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mix(keys[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    @classmethod
    def fingerprints(cls, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, cls.FINGERPRINT) >> np.uint64(32)).astype("<u4")


def pack(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One shard. Equal keys must be neighbours."""
    known = np.array([k is not None for k in keys], dtype=np.uint8)
    key = np.array([0 if k is None else k for k in keys], dtype="<i8")
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    where = np.flatnonzero(known)
    distinct, first, count = np.unique(key[where], return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    entry = np.zeros((3, len(distinct)), dtype="<u4")
    entry[:, slots] = PerfectHash.fingerprints(distinct), where[first] if len(where) else first, count
    head = [len(keys), int(offsets[-1]), width, len(distinct), len(index.levels), 0, 0, 0]
    parts = [np.array(head, dtype="<u8"), np.array([64 * len(w) for w in index.levels], dtype="<u8"), *index.levels, entry, key, known, offsets, *(x.astype(f"<u{width}") for x in ids)]
    return MAGIC + b"".join(x.tobytes() for x in parts)


class Shard:
    """A shard's bytes; ``rows`` finds documents by key in constant time each."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("this is not a shard of token ids")
        self.raw, self.at = raw, 8
        self.n_docs, self.n_tokens, self.width, n_keys, n_levels, *_ = map(int, self._take("<u8", 8))
        sizes = [int(x) for x in self._take("<u8", n_levels)]
        self.index = PerfectHash([self._take("<u8", s // 64) for s in sizes])
        self.fingerprint, self.first, self.count = (self._take("<u4", n_keys) for _ in range(3))
        self.keys, self.known = self._take("<i8", self.n_docs), self._take("u1", self.n_docs).astype(bool)
        self.offsets = self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.ids = self._take(f"<u{self.width}", self.n_tokens)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype=kind, count=n, offset=self.at)
        self.at += out.nbytes
        return out

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; -1 and 0 where the shard has no such key."""
        slots = self.index.slots(keys)
        ok = slots >= 0
        ok[ok] = self.fingerprint[slots[ok]] == PerfectHash.fingerprints(keys[ok])
        first, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        first[ok], count[ok] = self.first[slots[ok]], self.count[slots[ok]]
        return first, count

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of the documents with this key."""
        (first,), (count,) = self.rows(np.array([key]))
        return [self.ids[self.offsets[r] : self.offsets[r + 1]] for r in range(first, first + count)]


class Memory(dict):
    """What was met, in two generations: what is asked for again moves into the present one."""

    def __init__(self, learn):
        self.learn, self.older = learn, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(key)) is None:
            out = self.learn(key)
        self[key] = out
        return out


class Encoder:
    """Ids as the tokenizers library gives them; words and pieces met before come from memory.

    Where the tokenizer splits at white space in any case, a text's ids are those of its
    words one after another, and a word's those of its pieces.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", []) if p["type"] == "Split"] == [PIECES]
        # Such tokenizers leave a lower-case piece of printable ASCII as it is, so it can go to their model at once.
        normal = spec.get("normalizer") or {}
        normal = {n["type"]: n for n in normal.get("normalizers", [normal] if normal else [])}
        spaces = normal.pop("Replace", {"pattern": {"Regex": r"\s+"}})["pattern"]
        last = pre["pretokenizers"][1:] if self.by_word else []
        self.direct = spaces == {"Regex": r"\s+"} and normal.keys() <= {"NFC", "Lowercase"} and [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in last] == [("ByteLevel", False, False)]
        self.model = self.library.model
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) or r"(?!)")
        size = max(self.library.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        self.pieces = Memory(self._piece)
        self.words = Memory(self._word)

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        if not (self.direct and piece.isascii() and piece.isprintable()):
            return self._whole(piece)
        ids = [token.id for token in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.pieces[word]
        return b"".join(map(self.pieces.__getitem__, _PLAIN_PIECES.findall(word)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            t = t or ""
            if self.by_word and is_plain(t) and not ("<" in t and self.special.search(t)):
                raw = b"".join(map(self.words.__getitem__, t.lower().split()))
            else:
                raw = self._whole(t)
            out.append(np.frombuffer(raw + self.end, dtype=f"<u{self.width}"))
        return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _write(folder: str, shard: bytes, name: str) -> str:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(shard)
    return f"{folder}/{name}"


def _read(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Writes shards and manifest below ``folder``, a URI that all executors reach; returns the manifest.

    Keys are integers and ascend over the shards, null keys first; they are stored but cannot
    be looked up. Rows of equal key stand together, in the order of a hash of their texts. A
    null text is empty. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, end_id)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        part, seq, held = TaskContext.get().partitionId(), 0, 0

        def flushed() -> pd.DataFrame:
            shard = _write(folder, pack(keys, ids, encoder.width), f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids")
            known = [k for k in keys if k is not None]
            row = (part, seq, shard, known[0] if known else None, known[-1] if known else None, len(keys), sum(map(len, ids)))
            keys.clear()
            ids.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for key, got in zip(batch["k"], encoder.encode(batch["t"].tolist())):
                if keys and held + len(got) > shard_tokens:
                    yield flushed()
                    seq, held = seq + 1, 0
                keys.append(None if pd.isna(key) else int(key))
                ids.append(got)
                held += len(got)
        if keys:
            yield flushed()

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .withColumn("n", F.monotonically_increasing_id())
        .repartitionByRange("k", "h", "n")
        .sortWithinPartitions("k", "h")
        .select(F.col("k").cast("string").alias("k"), "t")
    )
    ordered.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, each found through its shard's index: key, start, ids (u32 bytes)."""
    shards = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                s = Shard(_read(path))
                row = np.flatnonzero(~s.known)
                first, count = s.rows(np.unique(s.keys[s.known]))
                if (count == 0).any():
                    raise ValueError(f"the index of {path} lacks a key")
                row = np.sort(np.concatenate([row, np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]))
                for some in np.array_split(row, max(1, s.n_tokens // 1_000_000)):
                    at = s.offsets[some]
                    ids = [s.ids[a:b].astype("<u4").tobytes() for a, b in zip(at, s.offsets[some + 1])]
                    key = pd.array(s.keys[some], dtype="Int64")
                    key[~s.known[some]] = pd.NA
                    yield pd.DataFrame({"key": key, "start": int(base) + at, "ids": ids})

    return shards.select("path", "base", "part", "seq").repartitionByRange(n, "part", "seq").mapInPandas(read, "key bigint, start bigint, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, lengths and checksums of all documents' ids, read back from the written shards; null texts count as empty."""
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return read_token_files(manifest).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
