"""Byte-level BPE, encoded and decoded with DuckDB queries inside each task.

A text is split by the vocabulary's pattern. The distinct pieces that a worker has
not met become rows (piece, position, token), beginning with a token a byte. A
recursive query joins neighbouring rows to the merge table and contracts, for each
piece and step, the leftmost pair of least rank, until no piece has a pair left.
Decoding joins ids to the vocabulary and aggregates their bytes in order of position.

Documents are independent, so the work follows the input's partitions and nothing is
shuffled. A worker remembers the ids of at most ``CACHE_PIECES`` pieces and starts anew
beyond that. The recursion comes in two forms with the same contractions. ``ENCODE`` keeps
the rows of every step, which is quick for words but quadratic in a piece's length, so new
pieces are cut into queries by the sum of their squared lengths. Longer pieces are contracted
in windows that overlap and meet at a token that both have. Where they have none in common, as
in runs of one letter, windows are joined, and ``ENCODE_LONG`` contracts the whole: it keeps
the last step alone, as keyed rows that each step overwrites, and contracts all pairs of the
least rank in one step where that cannot make a pair of lower rank.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import is_plain, short_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_PIECES = 300_000
#: Bytes of a window of a longer piece, a quarter of which it shares with the next; and the sum of lengths of one query
#: of ENCODE_LONG, which contracts windows that had to be joined.
LONG_PIECE, LONG_BYTES = 512, 100_000
#: Sum of squared lengths of the pieces of one encoding query. It makes at most half as many rows of 16 bytes.
LEARN_SQUARES = 4_000_000
#: Tokens that one decoding query joins and sorts.
DECODE_TOKENS = 2_000_000

#: public_tokenizers.PATTERN for the characters that is_plain() admits.
_PLAIN_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)

ENCODE = """
WITH RECURSIVE state(step, piece, pos, token) AS (
  SELECT 0, piece, pos, token FROM pieces
  UNION ALL
  SELECT s.step + 1, s.piece, CASE WHEN s.pos > b.pos THEN s.pos - 1 ELSE s.pos END,
         CASE WHEN s.pos = b.pos THEN b.token ELSE s.token END
  FROM state s JOIN (
    SELECT piece, (best & 4294967295)::INTEGER AS pos, (best >> 32)::INTEGER AS token
    FROM (
      SELECT a.piece, min((m.merged::BIGINT << 32) | a.pos) AS best
      FROM state a JOIN state n ON n.piece = a.piece AND n.pos = a.pos + 1
      JOIN merges m ON m.first = a.token AND m.second = n.token
      GROUP BY a.piece)
  ) b ON b.piece = s.piece
  WHERE s.pos <> b.pos + 1
)
SELECT s.piece, s.token
FROM state s JOIN (SELECT piece, max(step) AS step FROM state GROUP BY piece) l ON l.piece = s.piece AND l.step = s.step
ORDER BY s.piece, s.pos
"""

ENCODE_LONG = """
WITH RECURSIVE state(piece, pos, token) USING KEY (piece, pos) AS (
  SELECT piece, pos, token FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT a.piece, a.pos, m.merged, m.steady
     FROM state a JOIN state n ON n.piece = a.piece AND n.pos = a.pos + 1
     JOIN merges m ON m.first = a.token AND m.second = n.token),
   best AS (SELECT piece, min((merged::BIGINT << 32) | pos) AS best FROM pairs GROUP BY piece),
   least AS (
     SELECT p.piece, p.pos, p.merged, row_number() OVER (PARTITION BY p.piece ORDER BY p.pos) AS n
     FROM pairs p JOIN best b ON b.piece = p.piece AND p.merged = (b.best >> 32) AND (p.steady OR p.pos = (b.best & 4294967295))),
   -- of pairs that overlap, every other one, from the left
   taken AS (
     SELECT piece, pos, merged FROM (
       SELECT piece, pos, merged, row_number() OVER (PARTITION BY piece, pos - n ORDER BY pos) AS k FROM least) WHERE k % 2 = 1),
   after AS (
     SELECT s.piece, s.pos, coalesce(c.merged, s.token) AS token, g.pos IS NOT NULL AS gone
     FROM (SELECT * FROM state WHERE token >= 0) s SEMI JOIN best b ON b.piece = s.piece
     LEFT JOIN taken c ON c.piece = s.piece AND c.pos = s.pos
     LEFT JOIN taken g ON g.piece = s.piece AND g.pos + 1 = s.pos),
   numbered AS (
     SELECT piece, token, gone, row_number() OVER (PARTITION BY piece, gone ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY piece) AS size
     FROM after)
   -- the last places are free now: they hold no token
   SELECT piece, (CASE WHEN gone THEN size - 1 - place ELSE place END)::INTEGER, CASE WHEN gone THEN -1 ELSE token END FROM numbered))
SELECT piece, token FROM state WHERE token >= 0 ORDER BY piece, pos
"""

DECODE = """
SELECT i.doc, unhex(string_agg(v.hex, '' ORDER BY i.pos)) AS bytes
FROM ids i JOIN vocabulary v ON v.token = i.token GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _groups(pieces: list[tuple[str, bytes]], cost: Callable[[int], int], most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The pieces in groups whose costs by length add up to ``most`` at the most, but for single pieces."""
    group: list[tuple[str, bytes]] = []
    total = 0
    for piece in pieces:
        more = cost(len(piece[1]))
        if group and total + more > most:
            yield group
            group, total = [], 0
        group.append(piece)
        total += more
    if group:
        yield group


class Bpe:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.own_pattern = pattern == public_tokenizers.PATTERN
        self.byte_tokens = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(self.ranks.values())] = list(map(len, self.ranks))
        self.cache: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [
            (a, b, merged)
            for whole, merged in self.ranks.items()
            for k in range(1, len(whole))
            if (a := self.ranks.get(whole[:k])) is not None and (b := self.ranks.get(whole[k:])) is not None
        ]
        merges = np.array(pairs, dtype=np.int32)
        # A token is steady if no pair with it has a lower rank than its own.
        earliest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max)
        for side in (0, 1):
            np.minimum.at(earliest, merges[:, side], merges[:, 2])
        self._table("merges", dict(zip(("first", "second", "merged"), merges.T)) | {"steady": earliest[merges[:, 2]] > merges[:, 2]})
        self._table("vocabulary", {"token": np.array([*self.ranks.values()], dtype=np.int32), "hex": [x.hex() for x in self.ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict) -> dict:
        self.db.register(name, pa.table(columns))
        out = self.db.execute(sql).fetchnumpy()
        self.db.unregister(name)
        return out

    def split(self, text: str) -> list[str]:
        if self.own_pattern and is_plain(text):
            return _PLAIN_PATTERN.findall(text)
        return self.pattern.findall(text)

    def _learn(self, pieces: set[str]) -> None:
        new = []
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[p] = np.uint32(whole).tobytes()
            else:
                new.append((p, raw))
        new.sort(key=lambda x: len(x[1]))
        cut = bisect_right(new, LONG_PIECE, key=lambda x: len(x[1]))
        for group in _groups(new[:cut], lambda n: n * n, LEARN_SQUARES):
            self._contract(group, ENCODE)
        for p, raw in new[cut:]:
            self.cache[p] = self._windows(raw)

    def _ids(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of bytes, each by the recursion for its length."""
        out: dict[bytes, bytes] = {}
        new = sorted(set(raws), key=len)
        cut = bisect_right(new, LONG_PIECE, key=len)
        for group in _groups([(b, b) for b in new[:cut]], lambda n: n * n, LEARN_SQUARES):
            out |= self._contracted(group, ENCODE)
        for group in _groups([(b, b) for b in new[cut:]], lambda n: n, LONG_BYTES):
            out |= self._contracted(group, ENCODE_LONG)
        return [np.frombuffer(out[b], dtype="<u4") for b in raws]

    def _windows(self, raw: bytes) -> bytes:
        """Ids of a long piece from those of windows that overlap.

        Tokens follow one another in a text's ids exactly if each two of them do so when they
        stand alone. So where two windows have one and the same token in the part that they share,
        the ids of the first up to it and those of the second after it are the ids of both. Windows
        that share no token are joined and contracted as one, until all seams are found.
        """
        shared = LONG_PIECE // 4
        spans = [(a, min(a + LONG_PIECE, len(raw))) for a in range(0, len(raw) - shared, LONG_PIECE - shared)]
        ids = dict(zip(spans, self._ids([raw[a:b] for a, b in spans])))
        while True:
            # Ends of tokens by window, and where each window's tokens are left for those of the next.
            ends = {span: span[0] + np.cumsum(self.lengths[ids[span]]) for span in spans}
            seams = [self._seam(ids[x], ends[x], ids[y], ends[y], y[0]) for x, y in zip(spans, spans[1:])]
            if None not in seams:
                break
            joined = [spans[0]]
            for span, seam in zip(spans[1:], seams):
                joined[-1:] = [joined[-1], span] if seam is not None else [(joined[-1][0], span[1])]
            new = [span for span in joined if span not in ids]
            ids |= zip(new, self._ids([raw[a:b] for a, b in new]))
            spans = joined
        parts, first = [], 0
        for span, seam in zip(spans, [*seams, (len(ids[spans[-1]]), 0)]):
            parts.append(ids[span][first : seam[0]])
            first = seam[1]
        return b"".join(p.tobytes() for p in parts)

    def _seam(self, x: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_ends: np.ndarray, start: int) -> tuple[int, int] | None:
        """(tokens to take of x, tokens to leave of y) at the last token that both have in the same place."""
        both, i, j = np.intersect1d(x_ends, y_ends, assume_unique=True, return_indices=True)
        same = np.flatnonzero((x[i] == y[j]) & (both - self.lengths[x[i]] >= start))
        return (int(i[same[-1]]) + 1, int(j[same[-1]]) + 1) if same.size else None

    def _contract(self, new: list[tuple[str, bytes]], query: str) -> None:
        self.cache |= self._contracted(new, query)

    def _contracted(self, new: list[tuple], query: str) -> dict:
        """Ids of pieces of bytes by their names."""
        lengths = np.array([len(raw) for _, raw in new])
        piece = np.repeat(np.arange(len(new), dtype=np.int32), lengths)
        pos = (np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        token = self.byte_tokens[np.frombuffer(b"".join(raw for _, raw in new), dtype=np.uint8)]
        got = self._query(query, "pieces", {"piece": piece, "pos": pos, "token": token})
        tokens = got["token"].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(got["piece"], minlength=len(new)))
        start, out = 0, {}
        for (p, _), end in zip(new, ends.tolist()):
            out[p] = tokens[start:end]
            start = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cache.clear()
            missing = set().union(*split)
        self._learn(missing)
        ids = self.cache.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def decode(self, encoded: list[bytes | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[np.ndarray] = []
        size = 0
        for raw in [*encoded, None]:
            ids = np.frombuffer(raw or b"", dtype="<u4").astype(np.int32)
            if group and (size + len(ids) > DECODE_TOKENS or len(out) + len(group) == len(encoded)):
                out += self._decode(group)
                group, size = [], 0
            group.append(ids)
            size += len(ids)
        return out

    def _decode(self, group: list[np.ndarray]) -> list[bytes]:
        doc = np.repeat(np.arange(len(group), dtype=np.int32), [len(x) for x in group])
        got = self._query(DECODE, "ids", {"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "token": np.concatenate(group)})
        out = [b""] * len(group)
        for d, b in zip(got["doc"].tolist(), got["bytes"]):
            out[d] = bytes(b)
        return out


_workers: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Bpe(path, pattern)
    return _workers[path, pattern]


def encoder(path: str, pattern: str = public_tokenizers.PATTERN):
    """UDF: text to ids, as little-endian unsigned 32-bit integers; null gives no ids."""

    @pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_bpe(path, pattern).encode(texts.tolist()), dtype=object)

    return encode


def decoder(path: str, pattern: str = public_tokenizers.PATTERN):
    """UDF: ids, as ``encoder`` gives them, to the bytes of the text; null gives no bytes."""

    @pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(_bpe(path, pattern).decode(ids.tolist()), dtype=object)

    return decode


def round_trip(path: str, pattern: str = public_tokenizers.PATTERN):
    """UDF: text to (ids, decoded), both as above, in one worker."""

    @pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = _bpe(path, pattern).encode(texts.tolist())
            yield pd.DataFrame({"ids": ids, "decoded": _bpe(path, pattern).decode(ids)}, dtype=object)

    return both


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` and the ``decoded`` bytes.

    Null and empty texts have no ids. Rows are independent: repeated rows and null
    ids stay as they are, other columns are not carried.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col), round_trip(path)(F.col(text_col)).alias("both")).select(id_col, "both.ids", "both.decoded")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document's whole text, and of the bytes they decode to; null texts count as empty."""
    return digests(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
