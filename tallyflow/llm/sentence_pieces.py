"""SentencePiece BPE encoding and decoding in vectorised merge rounds, with a public model file.

A text is cut between bytes that no piece of the model holds side by side, so that no merge can cross a cut. The distinct units
of a task are encoded together: one flat array of symbols with marks where units begin. Every round takes the smallest rank of a
mergeable pair in each unit, merges all pairs of that rank at once (the leftmost of pairs that overlap), closes the gaps and looks
up only the pairs beside a merge, until no pair remains. A border between two symbols that no piece holds side by side splits its
unit, and a unit without pairs leaves the arrays.

Merging all pairs of one rank at once gives the library's result (one merge at a time, best score first, then leftmost) when the
merged piece cannot join a neighbour at a rank as good as its own. Pieces for which it could are known from the model; in a unit
whose best pair is such a piece only the leftmost is merged in that round. Units of more than ``LONG`` symbols, which could need as
many rounds, are merged one by one with a heap in the same order.

Models: BPE with byte fallback, identity normalisation and a dummy prefix; others are refused. Defined results: null is the empty
text, which has no ids; a text's U+2581 counts as a space, as in the library; repeated rows are encoded each; ids of no document
are looked at, so null and equal ids pass through.
"""
from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyflow.llm.frames import add_columns, name_of

#: Symbols of a unit beyond which it is merged with a heap.
LONG = 2048
#: Distinct units a Python worker remembers before it starts again with none.
REMEMBERED = 600_000
#: Bytes of text handled at once; larger chunks repeat fewer units.
CHUNK_BYTES = 4 << 20
_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_NEVER = np.iinfo(np.int32).max
_CODECS: dict[str, "Codec"] = {}

codecs.register_error("one_each", lambda e: ("�" * (e.end - e.start), e.end))


def codec(path: str) -> "Codec":
    """The codec of a model file in this process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _fields(raw: bytes):
    """(field, value) of a serialized message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at:at + size]
            at += size


def _check(model: bytes) -> None:
    """Refuse models whose encoding has other rules than those below."""
    # Field numbers of the public model format.
    parts = {2: {}, 3: {}}
    for field, value in _fields(model):
        if field in parts:
            parts[field] = dict(_fields(value))
    trainer, normal = parts[2], parts[3]
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
        raise ValueError("the model must be BPE with byte fallback and white space as prefix")
    if normal.get(2, b"") or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
        raise ValueError("the model must keep texts as they are, with a dummy prefix")


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        _check(lib.serialized_model_proto())
        self.size = n = lib.get_piece_size()
        every = range(n)
        pieces = [lib.id_to_piece(i) for i in every]
        self.control = np.array([lib.is_control(i) for i in every])
        self.is_byte = np.array([lib.is_byte(i) for i in every])
        if any(lib.is_unused(i) for i in every):
            raise ValueError("unused pieces are not supported")
        special = self.control | self.is_byte | np.array([lib.is_unknown(i) for i in every])
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.ids = {pieces[i]: i for i in every if not special[i]}
        self._ranks([lib.get_score(i) for i in every])
        self._pairs()
        self._borders()
        surface = [b"" if self.control[i] else bytes([int(pieces[i][1:-1], 16)]) if self.is_byte[i]
                   else pieces[i].replace(_MARK, " ").encode() if not special[i] else lib.decode([i]).encode() for i in every]
        self.surface, self.surface_at = _flat(surface)
        self.marked = np.array([not special[i] and pieces[i].startswith(_MARK) for i in every])
        self.decimal, self.decimal_at = _flat([b"%d," % i for i in every])
        self.clear()

    def _ranks(self, scores: list[float]) -> None:
        """Rank of every piece (best score 0, equal scores equal) and the pieces that must be merged one at a time."""
        _, self.rank = np.unique(-np.array(scores), return_inverse=True)
        self.rank = self.rank.astype(np.int32)
        self.alone = np.zeros(self.size, bool)
        for whole, i in self.ids.items():
            for cut in range(1, len(whole)):
                for part in (whole[:cut], whole[cut:]):
                    p = self.ids.get(part)
                    if p is not None and self.rank[p] >= self.rank[i]:
                        self.alone[p] = True

    def _pairs(self) -> None:
        """Pairs of pieces that stand side by side inside some piece, in order, and what they merge to (-1: nothing)."""
        found = {}
        for whole in self.ids:
            for a in range(len(whole) - 1):
                for c in range(a + 2, len(whole) + 1):
                    merged = self.ids.get(whole[a:c], -1)
                    for b in range(a + 1, c):
                        left, right = self.ids.get(whole[a:b]), self.ids.get(whole[b:c])
                        if left is not None and right is not None:
                            found[left * self.size + right] = merged
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.fromiter(found.values(), np.int64, len(found))[order], -1)

    def _borders(self) -> None:
        """Bytes that some piece holds side by side, and the piece of every single code point (-1: none)."""
        self.beside = np.zeros(1 << 16, bool)
        self.symbol = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            raw = np.frombuffer(piece.replace(_MARK, " ").encode(), np.uint8).astype(np.int64)
            self.beside[raw[:-1] << 8 | raw[1:]] = True
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[0x20] = self.symbol[ord(_MARK)]

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.known = np.zeros(1 << 18, np.int32)

    # ---- encoding ------------------------------------------------------------------------------

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols merge to (-1: nothing) and whether any piece holds them side by side."""
        both = (left < self.size) & (right < self.size)
        key = np.where(both, left * self.size + right, -1)
        at = np.searchsorted(self.keys, key)
        beside = self.keys[at] == key
        return np.where(beside, self.merged[at], -1), beside

    def _rank_of(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], _NEVER)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols after all merges, at the place of their first code point; -1 elsewhere. ``first`` marks where units begin."""
        out = np.full(symbols.size, -1, np.int64)
        if not symbols.size:
            return out
        place = np.arange(symbols.size)
        first = first.copy()
        merged = np.full(symbols.size, -1, np.int64)
        merged[:-1], beside = self.look_up(symbols[:-1], symbols[1:])
        first[1:] |= ~beside
        merged[:-1][first[1:]] = -1
        merged[-1] = -1
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, symbols.size))
        for i in np.flatnonzero(size > LONG):
            a, b = starts[i], starts[i] + size[i]
            for p, s in self._merge_long(symbols[a:b].tolist()):
                out[a + p] = s
            merged[a:b] = -1
        done = np.repeat(size > LONG, size)
        symbols, place, merged, first = symbols[~done], place[~done], merged[~done], first[~done]
        while symbols.size:
            rank = self._rank_of(merged)
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, symbols.size))
            best = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(best, size)) & (rank < _NEVER)
            over = np.repeat(best == _NEVER, size)
            out[place[over]] = symbols[over]
            at = np.flatnonzero(hit)
            unit = np.searchsorted(starts, at, "right") - 1
            one = np.zeros(starts.size, bool)
            one[unit[self.alone[merged[at]]]] = True
            leads = np.ones(at.size, bool)
            leads[1:] = unit[1:] != unit[:-1]
            new_run = np.ones(at.size, bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            in_run = np.arange(at.size) - np.maximum.accumulate(np.where(new_run, np.arange(at.size), 0))
            at = at[np.where(one[unit], leads, in_run % 2 == 0)]
            symbols[at] = merged[at]
            keep = ~over
            keep[at + 1] = False
            now = np.cumsum(keep) - 1
            symbols, place, merged, first, at = symbols[keep], place[keep], merged[keep], first[keep], now[at]
            last = np.append(first[1:], True)
            check = np.unique(np.concatenate([at, at[~first[at]] - 1]))
            merged[check] = -1
            check = check[~last[check]]
            merged[check], beside = self.look_up(symbols[check], symbols[check + 1])
            first[check[~beside] + 1] = True
        return out

    def _merge_long(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(place, symbol) of one unit after all merges, best rank first, then leftmost."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        table = dict(zip(self.keys.tolist(), self.merged.tolist()))
        heap = []

        def offer(i):
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and max(symbols[i], symbols[j]) < self.size:
                to = table.get(symbols[i] * self.size + symbols[j], -1)
                if to >= 0:
                    heapq.heappush(heap, (int(self.rank[to]), i, symbols[i], symbols[j], to))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, to = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = to, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [(i, s) for i, s in enumerate(symbols) if s >= 0]

    def _learn(self, units: list[str]) -> None:
        length = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(length) - length
        first = np.zeros(points.size, bool)
        first[begin] = True
        symbols = np.where(self.symbol[points] >= 0, self.symbol[points], self.size + points)
        got = self.merge(symbols, first)
        place = np.flatnonzero(got >= 0)
        got = got[place]
        point = np.where(got >= self.size, got - self.size, 0)
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        ids = np.repeat(got, width)
        inside = np.arange(ids.size) - np.repeat(np.cumsum(width) - width, width)
        odd = np.flatnonzero(ids >= self.size)
        ids[odd] = self.byte_ids[_utf8_byte(ids[odd] - self.size, inside[odd], np.repeat(width, width)[odd])]
        unit = np.searchsorted(begin, place, "right") - 1
        n = len(self.slot)
        ends = self.at[n] + np.cumsum(np.bincount(unit, width, len(units)).astype(np.int64))
        while self.at.size < n + len(units) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.known.size < ends[-1]:
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.at[n + 1:n + 1 + len(units)] = ends
        self.known[self.at[n]:ends[-1]] = ids
        self.slot.update(zip(units, range(n, n + len(units))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and row offsets in them."""
        data, offsets = _with_prefix(*_plain_marks(data, offsets))
        cut = np.zeros(data.size + 1, bool)
        if data.size:
            cut[1:-1] = ~self.beside[data[:-1].astype(np.int64) << 8 | data[1:]] & (data[1:] & 0xC0 != 0x80)
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        n = cuts.size - 1
        if n <= 0:
            return np.zeros(0, np.int32), np.zeros(offsets.size, np.int64)
        units = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if len(self.slot) + len(distinct) > REMEMBERED:
            self.clear()
        new = [u for u in distinct if u not in self.slot]
        if new:
            self._learn(new)
        slots = np.fromiter((self.slot[u] for u in distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        ids, ends = _gather(self.known, self.at, slots)
        return ids, ends[np.searchsorted(cuts, offsets)]

    # ---- decoding ------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows of ids one after another, and row offsets in them. The mark of a row's first piece is left out,
        and every byte of byte pieces that make no code point becomes U+FFFD."""
        data, ends = _gather(self.surface, self.surface_at, ids)
        speaks = np.flatnonzero(~self.control[ids])
        nth = np.searchsorted(speaks, offsets[:-1])
        has = nth < np.searchsorted(speaks, offsets[1:])
        lead = speaks[nth[has]]
        drop = ends[lead[self.marked[ids[lead]]]]
        at = ends[offsets]
        at = at - np.searchsorted(drop, at, "left")
        data = np.delete(data, drop)
        return self._repaired(data, at)

    @staticmethod
    def _repaired(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = at[(at < data.size)]
        if not (data[inner] & 0xC0 == 0x80).any():
            try:
                data.tobytes().decode()
                return data, at
            except UnicodeDecodeError:
                pass
        rows = [data[at[i]:at[i + 1]].tobytes().decode("utf-8", "one_each").encode() for i in range(at.size - 1)]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])

    def digests(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Lowercase hex sha256 of every row's ids in decimal, joined by commas."""
        text, ends = _gather(self.decimal, self.decimal_at, ids)
        raw, at = text.tobytes(), ends[offsets]
        return [hashlib.sha256(raw[a:max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _flat(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def _gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``values[at[r]:at[r + 1]]`` of all ``rows`` one after another, and where each begins (one entry more)."""
    size = at[rows + 1] - at[rows]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(at[rows] - ends[:-1], size) + np.arange(ends[-1])], ends


def _utf8_byte(point: np.ndarray, i: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Byte ``i`` of the UTF-8 form, ``width`` bytes long, of code points."""
    bits = point >> 6 * (width - 1 - i)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
    return np.where(i == 0, bits | lead, bits & 0x3F | 0x80)


def _plain_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with every U+2581 as a space."""
    e = np.flatnonzero(data[:-2] == _MARK_BYTES[0]) if data.size > 2 else np.zeros(0, np.int64)
    e = e[(data[e + 1] == _MARK_BYTES[1]) & (data[e + 2] == _MARK_BYTES[2])]
    if not e.size:
        return data, offsets
    data = data.copy()
    data[e] = 0x20
    return np.delete(data, np.concatenate([e + 1, e + 2])), offsets - 2 * np.searchsorted(e, offsets)


def _with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before every one that is not empty."""
    full = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][full], 0x20), offsets + np.concatenate([[0], np.cumsum(full)])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    def make():
        c = codec(path)

        def of(data, offsets, part):
            ids, at = c.encode(data, offsets)
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
        return of

    return add_columns(docs, text, [StructField("ids", ArrayType(IntegerType()))], make, [doc_id], CHUNK_BYTES)


def decode(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids. Null ids are the empty text; an id outside the model raises an error."""
    kept = rows.select(F.col(name_of(doc_id)), F.coalesce(F.col(name_of(ids)).cast("array<int>"), F.array().cast("array<int>")).alias("ids_of_row"))
    schema = StructType([kept.schema[0], StructField("text", StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            lists = batch.column(1)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if flat.size and not (0 <= flat.min() and flat.max() < c.size):
                raise ValueError("ids outside the model")
            size = np.diff(lists.offsets.to_numpy())
            data, at = c.decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, then decode its ids."""
    def make():
        c = codec(path)

        def of(data, offsets, part):
            ids, at = c.encode(data, offsets)
            back, ends = c.decode(ids, at)
            raw, ends = back.tobytes(), ends.tolist()
            return [pa.array(np.diff(at), pa.int64()), pa.array(c.digests(ids, at), pa.string()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())]
        return of

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return add_columns(docs, text, fields, make, [doc_id], CHUNK_BYTES)
