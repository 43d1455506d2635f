"""BPE encoding and decoding by a tokenization automaton.

*Compiling.* The automaton reads tokens and accepts exactly the tokenizations that the merges give. It begins with one
state and a loop per byte. The gadget of a merge (u, v), applied in order of rank, does three things: every state that u
leads to gets a copy without the arc v (so u, v can't be read in a row), u now leads to that copy, and the merged token
becomes an arc wherever u was one, leading where v leads. What u leads to never depends on where it starts, so a gadget
adds one state: the copy, kept as its parent and the label it lost. An arc is looked up by walking from copy to parent.

*Encoding.* The pre-tokenizer of the file splits texts into words. For words the automaton is spelled out in bytes and
made deterministic: a state is the set of unfinished tokens (trie node, token state before it), and its transition by a
byte gives the next set and the one token that ends there. Transitions are entered into a table when a word first takes
them; the table is bounded and starts anew when full. A word's tokens are read back from the tokens that end at its
prefixes. Words are encoded once per task's cache (``tokens.Coder``), as texts repeat them.

*Decoding* emits the bytes on the arcs and reads them as UTF-8, invalid sequences becoming U+FFFD.

A null text counts as empty and has no ids. Empty tables give no rows; repeated rows and null ids stay as they are; other
columns are ignored. A long text is one piece of work of its own; words over 64 characters are encoded but not cached.
The strings of special tokens become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.common import slices, table

_SIGNS = {c: b for b, c in tokens._BYTES.items()} | {chr(b): b for b in tokens._PRINTED}  # how the file writes bytes
TABLE_LIMIT = 300_000  # transitions in the table
_STATE_BITS = 24
_STATE_MASK = (1 << _STATE_BITS) - 1


class Automaton:
    """The token automaton of a list of merges, and its byte-wise transition table."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        size = max(vocabulary.values(), default=-1) + 1
        self.labels = [b""] * size
        for text, t in vocabulary.items():
            self.labels[t] = bytes(map(_SIGNS.__getitem__, text))
        # Per token: what it was merged from, and the state that it leads to. Per state: parent, lost label, owner.
        self.left, self.born, self.state = [-1] * size, [0] * size, [0] * size
        self.parent, self.lost = [0], [-1]
        self.live = [len(x) == 1 for x in self.labels]
        self.first, self.owner, self.cuts = [0] * size, [-1], {}  # the states that a token's own gadgets made, as label -> state
        self.allowed: dict[int, bool] = {}
        for u, v in merges:
            self._gadget(vocabulary[u], vocabulary[v], vocabulary[u + v])
        self._spell()

    def _gadget(self, u: int, v: int, merged: int) -> None:
        if not (self.live[u] and self.live[v] and self.arc(self.state[u], v)):
            return  # u, v can't be read in a row already, so the merge never applies
        if self.live[merged]:
            raise ValueError(f"two merges give {self.labels[merged]!r}")
        new = len(self.parent)
        self.live[merged] = True
        self.left[merged], self.born[merged] = u, new
        self.state[merged] = self.first[merged] = self.state[v]
        self.parent.append(self.state[u])
        self.lost.append(v)
        self.owner.append(u)
        self.cuts.setdefault(u, {}).setdefault(v, new)
        self.state[u] = new

    def arc(self, state: int, token: int) -> bool:
        """Is there an arc ``token`` at ``state``? A copy lost one label; tokens made later have an arc where their left part has one.

        States that gadgets of one token made follow each other, so their lost labels are looked up together.
        """
        if not self.live[token]:
            return False
        spine, later = [], len(self.parent) + 1
        while True:  # the token, its left part and so on, each with the time when it stopped to be the newest part
            spine.append((token, later))
            if self.left[token] < 0:
                break
            later, token = self.born[token], self.left[token]
        while state:
            owner = self.owner[state]
            cuts = self.cuts[owner]
            for label, until in spine:
                made = cuts.get(label)
                if made is not None and made <= state and made <= until:
                    return False
            state = self.first[owner]
        return True

    def _spell(self) -> None:
        """The trie of the live labels: children by (node, byte), the token of a node, and which nodes go on."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, label in enumerate(self.labels):
            if self.live[t]:
                node = 0
                for b in label:
                    self.inner[node] = True
                    if (key := node << 8 | b) not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = self.child[key]
                self.token[node] = t
        self.sizes = list(map(len, self.labels))
        self._fresh()

    def _fresh(self) -> None:
        for row in getattr(self, "rows", {}).values():
            row.clear()  # rows refer to each other
        self.start = Row(self, (0,))
        self.rows = {self.start.held: self.start}
        self.entered = 0

    def transition(self, row: Row, byte: int) -> tuple[Row, int]:
        """From a set of unfinished tokens by a byte: the next set and the token that ends."""
        going, ended, child, token, inner, allowed = [], -1, self.child, self.token, self.inner, self.allowed
        for held in row.held:
            if (node := child.get((held >> _STATE_BITS) << 8 | byte)) is not None:
                state = held & _STATE_MASK
                if ended < 0 and (t := token[node]) >= 0:
                    if (ok := allowed.get(state << 32 | t)) is None:
                        if len(allowed) > 2 * TABLE_LIMIT:
                            allowed.clear()
                        ok = allowed[state << 32 | t] = self.arc(state, t)
                    if ok:
                        ended = t
                if inner[node]:
                    going.append(node << _STATE_BITS | state)
        going.append(self.state[ended])
        key = tuple(going)
        if (to := self.rows.get(key)) is None:
            to = self.rows[key] = Row(self, key)
        self.entered += 1
        row[byte] = out = (to, ended)
        return out

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word."""
        if self.entered > TABLE_LIMIT:
            self._fresh()
        row, ends = self.start, []
        for byte in word:
            row, t = row[byte]
            ends.append(t)
        out, i, sizes = [], len(word), self.sizes
        while i:
            t = ends[i - 1]
            out.append(t)
            i -= sizes[t]
        out.reverse()
        return out


class Row(dict):
    """One state of the byte automaton: transitions by byte, entered when first asked for."""

    __slots__ = ("automaton", "held")

    def __init__(self, automaton: Automaton, held: tuple[int, ...]) -> None:
        self.automaton, self.held = automaton, held  # trie node and token state of each unfinished token

    def __missing__(self, byte: int) -> tuple[Row, int]:
        return self.automaton.transition(self, byte)


class AutomatonCoder(tokens.Coder):
    """Cuts and caches texts as ``Coder`` does; words get their ids from the automaton, not from the library's model."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.words:
            raise ValueError("the automaton is for byte-level vocabularies")
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {a["content"]: a["id"] for a in whole["added_tokens"]}
        self.automaton = Automaton({t: n for t, n in model["vocab"].items() if t not in special}, merges)
        self.special = special
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.emit = list(self.automaton.labels)
        for text, t in special.items():
            self.emit.extend([b""] * (t + 1 - len(self.emit)))
            self.emit[t] = text.encode()

    def _ids(self, piece: str) -> list[int]:
        return [t for word, _ in self.split(piece) for t in self.automaton.encode(bytes(map(_SIGNS.__getitem__, word)))]

    def _word(self, word: str) -> bytes:
        """A word of letters is one word of the pre-tokenizer, with the space before it; a line feed stays apart."""
        if word[0] == "\n":
            return array(self.code, [self.line_feed, *self.automaton.encode(word[1:].encode())]).tobytes()
        return array(self.code, self.automaton.encode(b" " + word.encode())).tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, self._ids(p)).tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not any("<" in t and self.marks.search(t) for t in texts) if all(s[:1] == "<" for s in self.special) else not any(map(self.marks.search, texts)):
            return super().encode(texts)
        parts = [[p for p in self.marks.split(t) if p] for t in texts]  # plain text and special tokens in turn
        plain = iter(super().encode([p for some in parts for p in some if p not in self.special]))
        return [b"".join(np.array([self.special[p]], self.dtype).tobytes() if p in self.special else next(plain) for p in some) for some in parts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.emit.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[str, AutomatonCoder] = {}


def coder(path: str) -> AutomatonCoder:
    """One per worker process and tokenizer file."""
    if path not in _CODERS:
        tokens.release()
        _CODERS[path] = AutomatonCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    path = path or tokens.default_path(tokens.BYTE_LEVEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in (p for b in batches for p in slices(b, 1)):
            ids = [np.frombuffer(c, own.dtype).astype("<u4").tobytes() for c in own.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows that ``encode`` gave; null ids give a null text."""
    path = path or tokens.default_path(tokens.BYTE_LEVEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in (p for b in batches for p in slices(b, 1)):
            texts = [None if i is None else own.decode(np.frombuffer(i, "<u4")) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids decoded in the same task, so that they cross no process border."""
    path = path or tokens.default_path(tokens.BYTE_LEVEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in (p for b in batches for p in slices(b, 1)):
            n, ids_sha, text_sha = [], [], []
            for code in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(code, own.dtype)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
