"""Token counts from a tokenizer compiled to a deterministic transducer.

The transducer reads the normalised text one character at a time; each transition
carries the number of tokens by which the count so far changes. A state joins where the
splitting pattern stands (between pieces, in a run of letters or of other signs, after
an apostrophe that may begin a contraction) with what the merges still need to know of
the piece: for every boundary from which a token may reach beyond the present
character, the characters since it, the last token before it and its count. A sequence
is what the merges give exactly if each neighbouring pair is, so the next boundary's last
token is the one whose pair with the token before it is. States are compiled when first
reached; different pieces that end alike share them.

A long text is cut into chunks. A chunk's map from the state before it to the state after
it has an open head (up to the first white space, which leads any state to the gap), a
count and a state. Maps compose associatively, so a prefix scan over them gives the count.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from tickloom.llm.common import free_name, is_plain, short_batches, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 14
NEVER = 1 << 60
#: A count difference of 0 in eight bits; tokens are far shorter.
ZERO = 128
#: From so few tokens that may follow a boundary, a state keeps them instead of the token before.
FEW = 16
#: Transitions that a worker keeps; beyond, it compiles anew.
MAX_TRANSITIONS = 200_000
#: Steps of single boundaries that it keeps; they are dearer to find than the transitions made of them.
MAX_EDGES = 300_000
#: Words of a generation whose paths a worker keeps; it keeps two, and what both have met stays.
MAX_PATHS = 80_000
END = "</w>"
#: The splitting pattern that the lexer states stand for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next unused one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}

State = dict
_INFO, _END = 0, 1


class Transducer:
    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if splits != [PIECES] or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("this tokenizer splits in another way than the lexer states")
        self.vocab = set(spec["model"]["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(spec["model"]["merges"])}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        #: Tokens that go on after these characters, if they are few, else None.
        self.beyond: dict[str, tuple[str, ...] | None] = {}
        for t in self.vocab:
            body = t.removesuffix(END)
            for k in range(1, len(body) + t.endswith(END)):
                few = self.beyond.get(body[:k], ())
                self.beyond[body[:k]] = None if few is None or len(few) == FEW else (*few, t)
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.kinds: dict[str, tuple[str, str]] = {}
        self.paths: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.clear()

    @cached_property
    def library(self) -> Tokenizer:
        """Only characters that are not plain need it."""
        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        """Forgets all that was compiled, but for the sums of whole words."""
        self.nodes: list[tuple] = []
        self.node_ids: dict[tuple, int] = {}
        self.edges: dict[int, int] = {}
        self.begun = array("I", [self._node("", None) << 8 | ZERO]).tobytes()
        self.clear_states()

    def clear_states(self) -> None:
        """Forgets the transitions; what they are made of stays."""
        self.states: dict[tuple, State] = {}
        self.size = 0
        self.gap = self._state(("gap",))

    def _state(self, key: tuple) -> State:
        if key not in self.states:
            self.states[key] = {_INFO: key}
        return self.states[key]

    # The merges. ``live`` holds a number for each boundary that a token may still reach across: its node
    # and, in the low eight bits, its count less the present count. Other boundaries are gone.

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(END) and token != END:
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _parts(self, token: str) -> tuple[int, str, str]:
        """Rank of the merge that makes a token, and the two tokens that it joins; -1 for a symbol, -2 if the merges never make it."""
        if (known := self.parts.get(token)) is None:
            symbols, rank = self._symbols(token), -1
            while len(symbols) > 1:
                rank, i = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:])))
                if rank == NEVER or len(symbols) == 2:
                    break
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            known = self.parts[token] = (-1, token, token) if len(symbols) == 1 else (-2 if rank == NEVER else rank, symbols[0], symbols[-1])
        return known

    def valid(self, last: str | None, token: str) -> bool:
        """Whether the merges leave this pair of neighbours as it is.

        Undoes the merges of both, latest first; a merge across the border must never come before
        the one that is undone. On the left side, a merge of equal rank across the border comes later.
        """
        rank, *_ = self._parts(token)
        if rank == -2 or last is None:
            return rank != -2
        left, right, bound = last, token, NEVER
        while True:
            if self.ranks.get((left, right), NEVER) < bound:
                return False
            (a, _, inner_left), (b, inner_right, _) = self._parts(left), self._parts(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, bound = inner_left, a
            else:
                right, bound = inner_right, b + 1

    def _node(self, text: str, last: str | tuple | None) -> int:
        """Number of what a state keeps of a boundary: the characters since it, and its last token or the tokens that may follow."""
        key = text, last
        if (node := self.node_ids.get(key)) is None:
            node = self.node_ids[key] = len(self.nodes)
            self.nodes.append(key)
        return node

    def _edge(self, node: int, byte: str) -> int:
        """The node after one more byte, -1 if no token reaches beyond it, and in the lowest bit whether a token may end there."""
        text, last = self.nodes[node]
        text += byte
        if isinstance(last, tuple):
            ends, left = text in last, tuple(t for t in last if t.startswith(text) and t != text)
        else:
            ends, left = text in self.vocab and self.valid(last, text), last
            if few := self.beyond.get(text):
                left = tuple(t for t in few if self.valid(last, t))
        gone = left == () or text not in self.beyond
        edge = self.edges[node << 9 | ord(byte)] = (-1 if gone else self._node(text, left)) << 1 | ends
        return edge

    def _advance(self, live: bytes, byte: str) -> tuple[bytes, int]:
        """After one more byte inside a piece: what is live, and the change of the count."""
        kept, token, change, edges, code = [], None, 0, self.edges, ord(byte)
        for at in memoryview(live).cast("I"):
            edge = edges.get(at >> 8 << 9 | code)
            if edge is None:
                edge = self._edge(at >> 8, byte)
            if edge & 1 and token is None:
                token, change = self.nodes[at >> 8][0] + byte, (at & 255) - ZERO + 1
            if edge >= 0:
                kept.append(edge >> 1 << 8 | at & 255)
        return array("I", [*(k - change for k in kept), self._node("", token) << 8 | ZERO]).tobytes(), change

    def _ended(self, live: bytes) -> int:
        """Change of the count when the piece ends here."""
        for at in memoryview(live).cast("I"):
            text, last = self.nodes[at >> 8]
            if text and (text + END in last if isinstance(last, tuple) else text + END in self.vocab and self.valid(last, text + END)):
                return (at & 255) - ZERO + 1
        raise AssertionError("a piece has tokens")

    def _grown(self, live: bytes, ch: str) -> tuple[bytes, int]:
        total = 0
        for byte in self.kind(ch)[1]:
            live, change = self._advance(live, byte)
            total += change
        return live, total

    def _piece(self, text: str) -> int:
        live, total = self.begun, 0
        for ch in text:
            live, change = self._grown(live, ch)
            total += change
        return total + self._ended(live)

    def kind(self, ch: str) -> tuple[str, str]:
        """L, N, O or S for letters, numbers, others and white space, and the bytes, as the library has them."""
        if (known := self.kinds.get(ch)) is None:
            known = self.kinds[ch] = self._kind(ch)
        return known

    def _kind(self, ch: str) -> tuple[str, str]:
        if is_plain(ch):
            kind = "L" if ch.isalpha() else "N" if ch.isdigit() else "S" if ch.isspace() else "O"
            return kind, "".join(BYTES[b] for b in ch.encode())
        split = self.library.pre_tokenizer.pre_tokenize_str
        if not (own := split(ch)):
            return "S", ""
        return ("L" if len(split("a" + ch)) == 1 else "O" if len(split("!" + ch)) == 1 else "N"), own[0][0]

    # The lexer.

    def _run(self, what: str, text: str) -> tuple[State, int]:
        live, total = self.begun, 0
        for ch in text:
            live, change = self._grown(live, ch)
            total += change
        return self._state((what, live)), total

    def final(self, state: State) -> int:
        """Change of the count when the text ends here."""
        if _END not in state:
            what, *rest = state[_INFO]
            if what == "gap":
                state[_END] = 0
            elif what == "apostrophe":
                state[_END] = self._piece("'") + (self._piece(rest[0]) if rest[0] else 0)
            else:
                state[_END] = self._ended(rest[0])
        return state[_END]

    def compile(self, state: State, ch: str) -> tuple[State, int]:
        what, *rest = state[_INFO]
        kind = self.kind(ch)[0]
        if what == "gap":
            if ch == "'":
                to = self._state(("apostrophe", "")), 0
            elif kind == "S":
                to = self.gap, 0
            elif kind == "N":
                to = self.gap, self._piece(ch)
            else:
                to = self._run(kind, ch)
        elif what == "apostrophe":
            begun = rest[0]
            if f"'{begun}{ch}" in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                to = self.gap, self._piece(f"'{begun}{ch}")
            elif not begun and ch in "rvl":
                to = self._state(("apostrophe", ch)), 0
            elif not begun and kind == "O":
                to = self._run("O", "'" + ch)
            else:
                on, change = self._run("L", begun) if begun else (self.gap, 0)
                on, more = self.step(on, ch)
                to = on, self._piece("'") + change + more
        elif kind == what:
            live, change = self._grown(rest[0], ch)
            to = self._state((what, live)), change
        else:
            on, change = self.step(self.gap, ch)
            to = on, self.final(state) + change
        state[ch] = to
        self.size += 1
        return to

    def step(self, state: State, ch: str) -> tuple[State, int]:
        return state[ch] if ch in state else self.compile(state, ch)

    def read(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for ch in text:
            try:
                state, change = state[ch]
            except KeyError:
                state, change = self.compile(state, ch)
            count += change
        return state, count

    def read_plain(self, text: str) -> tuple[State, int]:
        """``read`` from the gap. White space leads back to it, so each word before the last is a path from the gap
        to the gap; the sum along it is kept for words met before."""
        words = text.split()
        last = words.pop() if words and not text[-1].isspace() else ""
        if len(self.paths) > MAX_PATHS:
            self.older, self.paths = self.paths, {}
        for w in set(words).difference(self.paths):
            known = self.older.get(w)
            self.paths[w] = self._ends(*self.read(self.gap, w)) if known is None else known
        state, count = self.read(self.gap, last)
        return state, count + sum(map(self.paths.__getitem__, words))

    def _ends(self, state: State, count: int) -> int:
        return count + self.final(state)

    # Chunks: (head, None, None) without white space, else (head, count, state); head is read from the state before.

    def chunk_map(self, text: str, read) -> tuple:
        space = next((m for m in re.finditer(r"\s", text) if self.kind(m[0])[0] == "S"), None)
        if not space:
            return text, None, None
        state, count = read(text[space.end() :])
        return text[: space.end()], count, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, count = self.read(a[2], b[0])
        return (a[0], a[1] + count, state) if b[2] is None else (a[0], a[1] + count + b[1], b[2])

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions, by doubling distances."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps[step:] = [self.compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def count_segment(self, text: str, chunk: int = CHUNK) -> int:
        if is_plain(text):
            text, read = text.lower(), self.read_plain
        else:
            text, read = self.library.normalizer.normalize_str(text), lambda t: self.read(self.gap, t)
        if len(text) <= chunk:
            return self._ends(*read(text))
        head, rest, last = self.scan([self.chunk_map(text[i : i + chunk], read) for i in range(0, len(text), chunk)])[-1]
        count = self._ends(*self.read(self.gap, head))
        return count if last is None else count + rest + self.final(last)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a text; strings of special tokens inside it count one each."""
        if not text:
            return 0
        if self.size > MAX_TRANSITIONS:
            self.clear() if len(self.edges) > MAX_EDGES else self.clear_states()
            gc.collect()
        if "<" not in text or not self.special.search(text):
            return self.count_segment(text, chunk)
        parts = self.special.split(text)
        return sum(self.count_segment(p, chunk) for p in parts) + len(parts) - 1


_workers: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    """The worker's own, which outlives the task; closures would carry a copy of the dictionary."""
    if path not in _workers:
        _workers[path] = Transducer(path)
    return _workers[path]


def counter(path: str):
    """UDF: text to its number of tokens; null has none."""

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count_of = _transducer(path).count
        for texts in batches:
            yield pd.Series([count_of(t) for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text_col`` in ``into`` (a free name if that is taken).

    Null and empty texts have none. Rows are independent, so ties and repeated rows are
    counted alike and nothing is shuffled.
    """
    short_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, into), counter(path)(F.col(text_col)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document's whole text, and whether it has more than ``LIMIT`` tokens; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
