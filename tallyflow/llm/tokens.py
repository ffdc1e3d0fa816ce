"""Token ids of whole texts with a public tokenizer file, encoding every distinct word of a task once.

A text is cut after each run of word bytes, so that a piece is white space and the word behind it, and between an
ASCII letter and an ASCII sign other than the apostrophe behind it. The tokenizers used here split texts at these places
before they merge, so the ids of the pieces joined are the ids of the text. A text with white space other than ASCII, where that need not hold, is encoded whole.
Strings of special tokens inside a text are ordinary text. Equality with whole-text encoding is tested.
"""
from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from tallyflow.llm.text import words

#: Bytes of text encoded at once: pieces that repeat inside a chunk are looked up once.
ENCODE_BYTES = 4 << 20
#: Distinct pieces kept by a Python worker before it starts again with none.
REMEMBERED = 800_000
#: Pieces encoded in one call: what the tokenizer returns for a piece takes far more memory than its ids.
LEARNED_AT_ONCE = 8_192
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_SPACE = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file in this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def other_space_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space which is not ASCII, or an information separator."""
    at = np.flatnonzero(_RARE[data])
    if not at.size:
        return at
    raw = data.tobytes()
    found = [p for p in at.tolist() if raw[p] < 0x20 or raw[p:p + 2] in _OTHER_SPACE or raw[p:p + 3] in _OTHER_SPACE]
    return np.unique(np.searchsorted(offsets, np.array(found, np.int64), "right") - 1)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), LEARNED_AT_ONCE):
            self._add(pieces[i:i + LEARNED_AT_ONCE])

    def _add(self, pieces: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        lists = [e.ids for e in got]
        n = len(self.slot)
        ends = self.at[n] + np.cumsum([len(x) for x in lists])
        while self.at.size < n + len(lists) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.ids.size < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[n + 1:n + 1 + len(lists)] = ends
        self.ids[self.at[n]:ends[-1]] = np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1] - self.at[n]))
        self.slot.update(zip(pieces, range(n, n + len(pieces))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and row offsets in them."""
        _, ends, _ = words(data, offsets)
        cut = np.zeros(data.size + 1, bool)
        cut[ends] = cut[offsets] = True
        cut[1:data.size] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
        cuts = np.flatnonzero(cut)
        n = cuts.size - 1
        if n <= 0:
            return np.zeros(0, np.uint32), np.zeros(offsets.size, np.int64)
        pieces = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.slot) + len(distinct) > REMEMBERED:
            self.clear()
        new = [p for p in distinct if p not in self.slot]
        if new:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        size = self.at[slots + 1] - self.at[slots]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[slots] - (ends - size), size) + np.arange(ends[-1])]
        at = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        whole = other_space_rows(data, offsets)
        if not whole.size:
            return ids, at
        rows = [ids[at[i]:at[i + 1]] for i in range(offsets.size - 1)]
        for i in whole:
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
            rows[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([r.size for r in rows])])


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to every row."""
    n = offsets.size - 1
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(n + 1)
