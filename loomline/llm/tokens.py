"""Token ids of whole texts with a public tokenizer, in Arrow batches, with a bounded cache of words.

``encode`` gives the ids that the tokenizer itself gives for the whole text: a text is cut only where the tokenizer
always cuts (see ``_units``), each different piece is encoded once by the tokenizer, and texts are put together from
the pieces. Pieces over 64 characters are never kept.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import compress
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_LEVEL, WORD_END = "byte_bpe_50k.json", "word_bpe_49k.json"
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space but " " and "\n"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = pa.array([c for c in map(chr, range(0x100)) if c.isalpha() and c not in "\xaa\xb5\xba"], pa.large_string())
_CUT = re.compile(r"(?<!\s) (?!\s)")
_LIMIT = 100_000  # pieces learnt at a time
_KNOWN = 1_000_000  # pieces held in Arrow
#: How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ID = attrgetter("id")
_CODERS: dict[str, Coder] = {}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Encodes texts to ids of ``dtype``; ``words`` says that white space only separates (no piece spans or keeps it)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Where it knows the special token, it encodes many pieces in one call, with that token between them.
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.words = not self.tokenizer.encode(" \n a \t", add_special_tokens=False).ids[1:]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line_feed = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [0])[0]
        self.known = Known.none(self.dtype)

    def _units(self, texts: list[str]) -> tuple[pa.ListArray, list[int]]:
        """Per text, pieces whose ids, put together, are the text's, and the places of the texts, which come in another order.

        All but the first stand for themselves after one space (or, where white space only separates, without one).
        """
        column = pa.array(texts, pa.large_string())
        if self.words:
            return pc.split_pattern(pc.replace_substring(column, "\n", " "), " "), list(range(len(texts)))
        # Between two characters that aren't white space, a space always begins a new piece, which takes it along.
        odd = [bool("  " in t or " \n" in t or "\n " in t or "\n\n\n" in t or t[:1] == " " or t[-1:] == " " or t[-2:] == "\n\n" or _OTHER.search(t)) for t in texts]
        # One or two line feeds between two such characters are pieces of their own; each begins a unit that has no space.
        even = pc.split_pattern(pc.replace_substring(column.filter(pa.array([not o for o in odd], pa.bool_())), "\n", " \n"), " ")
        cut = pa.array([_CUT.split(t) for t in compress(texts, odd)], even.type)
        return pa.concat_arrays([even, cut]), sorted(range(len(texts)), key=odd.__getitem__)

    def _learn(self, need: list[str]) -> None:
        """Put pieces at the end of the known ones: from their word and the marks after it, or by the tokenizer."""
        pieces, known = self._base(pa.array(need, pa.large_string())), self.known
        stems = pc.ascii_rtrim(pieces, characters=_MARKS)
        marked = pc.and_(pc.not_equal(stems, pieces), pc.is_in(pc.utf8_slice_codeunits(stems, -1), value_set=_LETTERS))
        bases = pc.if_else(marked, stems, pieces).dictionary_encode()
        names, places = _strings(bases.dictionary), known.places(bases.dictionary).tolist()
        asked = [w for w, at in zip(names, places) if at < 0]
        small = "\u0130" if self.words else "\u0250"  # letters below have one lower-case form, which ``_base`` gives
        plain = [w for w in asked if (w[1:] if w[:1] == "\n" else w).isalpha() and (w.isascii() or max(w) < small)]
        have = dict(zip(plain, map(self._word, plain)))
        rest = [w for w in asked if w not in have]
        have.update(zip(rest, self._encode(self._spaced(rest))))
        codes = [have[w] if at < 0 else known.code(at) for w, at in zip(names, places)]
        which = bases.indices.to_numpy().tolist()
        tails = [p[len(names[k]) :] for p, k in zip(_strings(pieces), which)]
        kinds = list(set(tails))
        last = dict(zip(kinds, self._encode(kinds)))
        new = set(asked).difference(need)  # words that have only been seen with marks or in upper case
        self.known = known.extended([*new, *need], [*map(have.__getitem__, new), *(codes[k] + last[tail] for k, tail in zip(which, tails))])

    def _base(self, words: pa.Array) -> pa.Array:
        """The form under which words are asked for; lower case where the tokenizer lowers, for letters that have one form."""
        return pc.if_else(pc.match_substring_regex(words, "[^\\x00-\\x{12F}]"), words, pc.utf8_lower(words)) if self.words else words

    def _word(self, word: str) -> bytes:
        """Ids of a word of Latin letters, after a space: one piece, so the tokenizer's model takes it as it is."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        if word[0] == "\n":
            return array(self.code, [self.line_feed, *map(_ID, self.model.tokenize(piece[1:]))]).tobytes()
        return array(self.code, map(_ID, self.model.tokenize(piece if self.words else "\u0120" + piece))).tobytes()

    def _spaced(self, units: list[str]) -> list[str]:
        return units if self.words else [u if u[:1] == "\n" else " " + u for u in units]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if "<|" not in p] if self.mark_id is not None else []
        done: dict[str, bytes] = {}
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            self.tokenizer.encode_special_tokens = False
            try:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.int64)
            finally:
                self.tokenizer.encode_special_tokens = True
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            data, width, start = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
            for piece, end in zip(some, ends.tolist()):
                done[piece] = data[start * width : end * width]
                start = end + 1
        rest = [p for p in pieces if p not in done]
        done.update(zip(rest, [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]))
        return [done[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``. No cycles are made here, so the collector of cycles can rest."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            pa.default_memory_pool().release_unused()  # else what the cutting took once stays with the worker
            if resting:
                gc.enable()

    def _texts(self, texts: list[str]) -> list[bytes]:
        lists, order = self._units(texts)
        words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if self.words:
            return self._gathered(words, bounds)
        firsts, inner = words.take(pa.array(bounds[:-1])), np.ones(len(words), bool)
        inner[bounds[:-1]] = False  # the first piece has no space before it
        codes = self._gathered(words.filter(pa.array(inner)), bounds - np.arange(len(bounds)))
        firsts = _strings(firsts)
        kinds = list(set(firsts))
        heads, out = dict(zip(kinds, self._encode(kinds))), [b""] * len(texts)
        for at, first, code in zip(order, firsts, codes):
            out[at] = heads[first] + code
        return out

    def _gathered(self, words: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """Ids of the words between each two bounds: Arrow finds the words among the known ones, their ids are gathered."""
        coded = words.dictionary_encode()
        places = self.known.places(coded.dictionary)
        seen, new = places[places >= 0], np.flatnonzero(places < 0)
        if len(new):
            names = _strings(coded.dictionary.take(pa.array(new)))
            short, long = [k for k, w in enumerate(names) if len(w) <= 64], [k for k, w in enumerate(names) if len(w) > 64]
            for a in range(0, len(short), _LIMIT):
                some = short[a : a + _LIMIT]
                self._learn([names[k] for k in some])
                places[new[some]] = np.arange(-len(some), 0) + len(self.known.words)
        known = self.known
        known.used[seen] += 1
        if len(new) and long:
            apart = [names[k] for k in long]
            known = known.extended(apart, self._encode(self._spaced(apart)))
            places[new[long]] = np.arange(-len(long), 0) + len(known.words)
        which = places[coded.indices.to_numpy()]
        sizes = known.sizes[which]
        ends = np.cumsum(sizes)
        places = np.repeat(known.starts[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data, width = known.ids[places].tobytes(), self.dtype.itemsize
        cuts = (np.append(0, ends)[bounds] * width).tolist()
        if len(self.known.words) > _KNOWN:
            self.known = self.known.trimmed()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Known:
    """Words with their ids, one after the other in ``ids``, and how many calls used them since the last trim."""

    def __init__(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        self.words, self.ids, self.sizes, self.used = words, ids, sizes, used
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def none(cls, dtype: np.dtype) -> Known:
        return cls(pa.array([], pa.large_string()), np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where these different words are, or -1. Theirs is the table that is hashed: it is smaller than that of all known words."""
        hit = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy()
        out, at = np.full(len(words), -1), np.flatnonzero(hit >= 0)
        out[hit[at]] = at
        return out

    def code(self, at: int) -> bytes:
        return self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tobytes()

    def extended(self, words: list[str], codes: list[bytes]) -> Known:
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // self.ids.dtype.itemsize
        ids = np.append(self.ids, np.frombuffer(b"".join(codes), self.ids.dtype))
        return Known(pa.concat_arrays([self.words, pa.array(words, pa.large_string())]), ids, np.append(self.sizes, sizes), np.append(self.used, np.zeros(len(codes), np.int32)))

    def trimmed(self) -> Known:
        """Those used most since the last trim, half of the limit at most."""
        least = 1
        while 2 * np.count_nonzero(self.used >= least) > _KNOWN:
            least += 1
        keep = self.used >= least
        return Known(self.words.filter(pa.array(keep)), self.ids[np.repeat(keep, self.sizes)], self.sizes[keep], np.zeros(np.count_nonzero(keep), np.int32))


def coder(path: str) -> Coder:
    """One per worker process and tokenizer file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def release() -> None:
    """Drop this worker's coders with their words, and what Arrow holds unused: for other operators' tasks, as workers are used again."""
    _CODERS.clear()
    pa.default_memory_pool().release_unused()
