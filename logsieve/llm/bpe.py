"""Whole texts to token ids with the tokenizers library, each distinct part of a text encoded once.

Words repeat, so a text is cut where its tokenizer never joins the two sides; each part is looked up among those that
the process has encoded, and only new parts go to the library. The ids are the library's own for the whole text. Cuts
stand before commas and full stops and at white space. Where a cut is not certain (punctuation or white space on both
sides) the text is cut at white space only, and failing that the library gets it whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # tasks are the parallelism

MARK = "\x01"               # stands at the cuts; texts that hold it go to the library whole
CACHE_PARTS = 600_000       # distinct parts that a process holds; beyond, it forgets the later half
_EMPTY, _SPACE, _ALNUM, _OTHER = range(4)
_LATIN_END = "ɐ"


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _kind(c: str) -> int:
    return _EMPTY if not c else _SPACE if c.isspace() and not "\x1c" <= c <= "\x1f" else _ALNUM if c.isalnum() else _OTHER


class Encoder:
    """`encode(texts)` gives the ids of all texts and where each text's begin.

    `kind` is `byte` for a byte-level vocabulary in which words begin with their space, `word` for one in lower case
    that drops white space.
    """

    def __init__(self, path: str, kind: str):
        self.tokenizer, self.byte = tokenizers.Tokenizer.from_file(path), kind == "byte"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.first, self.last = np.zeros(0, np.int8), np.zeros(0, np.int8)

    def _forget(self) -> None:
        """Keeps the first half: what came first is what comes often."""
        half = CACHE_PARTS // 2
        self.codes = dict(list(self.codes.items())[:half])
        self.flat = self.flat[:self.starts[half]].copy()
        self.starts, self.lengths = self.starts[:half].copy(), self.lengths[:half].copy()
        self.first, self.last = self.first[:half].copy(), self.last[:half].copy()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _ids(self, parts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """(ids, kind of the first character, kind of the last) of parts.

        A run of Latin letters is one word to the tokenizer, so its model gets it directly.
        """
        out: list = [None] * len(parts)
        first, last = np.full(len(parts), _ALNUM, np.int8), np.full(len(parts), _ALNUM, np.int8)
        rest, spaced, model, byte, letters = [], [], self.model.tokenize, self.byte, self.letters
        for i, part in enumerate(parts):
            word = part.lstrip(" ") if byte else part.lower()
            if word.isalpha() and len(part) - len(word) <= 1:
                if word.isascii():
                    plain = word if len(word) == len(part) else "\u0120" + word
                elif max(word) < _LATIN_END:
                    plain = (part if byte else word).encode().decode("latin-1").translate(letters)
                else:
                    rest.append(i)
                    continue
                if byte and len(word) < len(part):
                    spaced.append(i)
                out[i] = [t.id for t in model(plain)]
            else:
                rest.append(i)
        first[spaced] = _SPACE
        for i, ids in zip(rest, self._whole([parts[i] for i in rest])):
            out[i] = ids
            part = parts[i] if byte else parts[i].lower()
            first[i], last[i] = _kind(part[:1]), _kind(part[-1:])
        return out, first, last

    def _learn(self, new: list[str]) -> None:
        ids, first, last = self._ids(new)
        self.codes.update(zip(new, range(len(self.starts), len(self.starts) + len(new))))
        lengths = np.array(list(map(len, ids)), np.int32)
        starts = (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)
        self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(ids)), np.uint32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, last])

    def _cut(self, texts: pa.Array, at_stops: bool) -> pa.ListArray:
        cuts = [(" ", MARK + " "), ("\n", f"{MARK}\n{MARK}")] if self.byte else [(" ", MARK), ("\n", MARK)]
        for old, new in cuts + [(",", MARK + ","), (".", MARK + ".")] * at_stops:
            texts = pc.replace_substring(texts, old, new)
        return pc.split_pattern(texts, MARK)

    def _doubtful(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether the cut before each part may be one that the tokenizer would not make."""
        first, before = self.first[codes], np.empty(len(codes), np.int8)
        before[1:] = self.last[codes[:-1]]
        if self.byte:
            bad = (first == _SPACE) & (before <= _SPACE) | (first == _OTHER) & (before != _ALNUM)
            line = self.codes.get("\n", -1)         # what follows a line end stands by itself, unless it is white space
            bad[1:] &= ~((codes[:-1] == line) & (first[1:] != _SPACE))
        else:
            bad = (first == _OTHER) & (before == _OTHER)
        bad[begins] = False
        again = begins[self.first[codes[begins]] == _EMPTY] + 1     # an empty part at the start of a text is no part
        bad[again[again < len(codes)]] = False
        return bad

    def encode(self, texts: pa.Array, at_stops: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): the ids of text i are `ids[bounds[i]:bounds[i + 1]]`; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.codes) > CACHE_PARTS:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        cut = self._cut(texts, at_stops)
        parts = cut.flatten().dictionary_encode()
        known = parts.dictionary.to_pylist()
        own = list(map(self.codes.get, known))
        new = [p for p, c in zip(known, own) if c is None]
        if new:
            fresh = iter(range(len(self.starts), len(self.starts) + len(new)))
            self._learn(new)
            own = [next(fresh) if c is None else c for c in own]
        codes = np.array(own, np.int32)[parts.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        doubt = np.logical_or.reduceat(self._doubtful(codes, begins), begins)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths, dtype=np.int32)
        # the place of every id: where its part starts, plus its place in the part
        ids = self.flat[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1], dtype=np.int32)]
        bounds = np.concatenate([[0], ends[begins + sizes - 1]]).astype(np.int64)
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        redo = np.flatnonzero(doubt | marked)
        if not len(redo):
            return ids, bounds
        out = np.split(ids, bounds[1:-1])
        unmarked = redo[~marked[redo]] if at_stops else redo[:0]
        again, at = self.encode(texts.take(pa.array(unmarked)), False)
        for j, i in enumerate(unmarked):
            out[i] = again[at[j]:at[j + 1]]
        whole = np.setdiff1d(redo, unmarked)
        for i, one in zip(whole, self._whole(texts.take(pa.array(whole)).to_pylist())):
            out[i] = np.array(one, np.uint32)
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])


def encoder(path: str, kind: str) -> Encoder:
    """The process's encoder for a tokenizer file.

    Functions travel to the workers by value, so a global of this module would begin empty in every task; the library's
    module stays for the life of a worker.
    """
    held = vars(tokenizers).setdefault("held_encoders", {})
    if (path, kind) not in held:
        held[path, kind] = Encoder(path, kind)
    return held[path, kind]


def release_encoders() -> None:
    """Frees what `encoder` keeps: a stage that does not encode calls it, as workers are used again."""
    if vars(tokenizers).pop("held_encoders", None):
        pa.default_memory_pool().release_unused()
