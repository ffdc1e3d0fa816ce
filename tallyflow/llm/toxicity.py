"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (runs of letters, lower-cased): all words of the labelled sample, however rare, and beginnings of 4 to 7 bytes that
clearly differ between the labels. Document frequencies come from all documents. A term weighs (1 + log count) * idf * (floor + evidence), where
evidence (0 to 1) is how surely its share among toxic examples differs from that among others; words that no example has carry no weight.
Labelled examples are sparse vectors of unit length, so a copy of one has cosine 1 with it. Equal vectors are one entry with its counts of
labels, so ties at the k-th neighbour count whole. Entries are laid out by their heaviest term and cut into blocks; the
inverted index keeps for every term its postings and, for the blocks it occurs in, the largest weight. A query bounds every block by these
maxima, opens the few of highest bound, then those whose bound is not below the k-th cosine found so far: the result is exact.
Votes weigh 1 / (distance + 0.05) and are drawn to the share of toxic labels. A logistic curve, fitted
on the whole sample with each example's own vote left out, turns votes into probabilities.

Defined cases: null and empty texts, and texts without a word of any example, have no neighbour and get the score of the share of toxic labels; without
labels or with one kind only, every score is the smoothed share of label 1; repeated rows are scored each; extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tallyflow.llm.frames import add_columns, labelled_sample, name_of, stored
from tallyflow.llm.quality import _curve, _logit
from tallyflow.llm.text import chunks, spans, word_hashes

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PREFIXES = (4, 5, 6, 7)
BLOCK = 64
#: Blocks that a query opens first, to learn how near its neighbours are at least.
FIRST_BLOCKS = 4
#: Share of blocks from which on whole postings are read, which takes less than choosing their parts.
WHOLE = 0.6
_FILTER = 1 << 20
_MARK = np.uint64(_FILTER - 1)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all rows, and the row of each."""
    starts, ends, first = spans(_LETTER[data], offsets)
    row = np.repeat(np.arange(offsets.size - 1), np.diff(first))
    hashes, rows = [word_hashes(data, starts, ends)], [row]
    for n in PREFIXES:
        long = ends - starts >= n
        hashes.append(word_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``size`` from ``low`` on, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if size.size else 0) + np.repeat(low - (ends - size), size)


@dataclass
class Vocabulary:
    """Terms sorted by hash, with a filter on 20 bits in front of the search."""
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __post_init__(self):
        self.seen = np.zeros(_FILTER, bool)
        self.seen[(self.hashes & _MARK).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term number and count of every term of every row, in order of row and term."""
        h, row = terms(data, offsets)
        some = self.seen[(h & _MARK).astype(np.int64)]
        h, row = h[some], row[some]
        if not self.hashes.size or not h.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), self.hashes.size - 1)
        hit = self.hashes[at] == h
        both, n = np.unique(row[hit] * self.hashes.size + at[hit], return_counts=True)
        return both // self.hashes.size, both % self.hashes.size, n


@dataclass
class Examples:
    """Inverted index of distinct example vectors with sparse block maxima, their votes and the calibration."""
    vocabulary: Vocabulary
    weight: np.ndarray
    prior: float = 0.5
    k: int = 15
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the unit vector."""
        w = (1 + np.log(n)) * self.weight[term]
        return term, w / np.sqrt((w * w).sum())

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, toxic: np.ndarray, example: np.ndarray) -> np.ndarray:
        """Index entries given as (terms, weights); returns the place of each."""
        heavy = np.array([t[np.argmax(w)] for t, w in vectors], np.int64)
        order = np.lexsort(([-w.max() for _, w in vectors], heavy))
        vectors, self.total, self.toxic, self.example = [vectors[i] for i in order], total[order], toxic[order], example[order]
        term = np.concatenate([t for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        entry = np.repeat(np.arange(len(vectors)), [t.size for t, _ in vectors])
        by = np.lexsort((entry, term))
        term, entry, weight = term[by], entry[by], weight[by]
        new = np.append(True, (term[1:] != term[:-1]) | (entry[1:] // BLOCK != entry[:-1] // BLOCK))
        self.piece_from = np.append(np.flatnonzero(new), term.size)  # postings of a term in a block
        self.piece_at = np.searchsorted(term[new], np.arange(self.vocabulary.hashes.size + 1))  # pieces of a term
        self.piece_block = entry[new] // BLOCK
        self.piece_max = np.maximum.reduceat(weight, self.piece_from[:-1])
        self.posting_entry, self.posting_weight = entry, weight
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        return place

    def neighbours(self, term: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Entries among the k nearest examples (ties whole) and their cosines; ``without`` has one example less."""
        blocks = -(-self.total.size // BLOCK)
        low = self.piece_at[term]
        size = self.piece_at[term + 1] - low
        piece, q = _ranges(low, size), np.repeat(weight, size)
        block = self.piece_block[piece]
        bound = np.bincount(block, q * self.piece_max[piece], blocks)
        order = np.argsort(-bound, kind="stable")
        left = np.append(self.total, np.zeros(blocks * BLOCK - self.total.size))
        if without >= 0:
            left[without] -= 1
        entries, cosines, least, opened, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, FIRST_BLOCKS
        while opened < blocks and bound[order[opened]] > 0 and bound[order[opened]] >= least - 1e-12:
            now = order[opened:opened + step]
            now = now[bound[now] >= max(least - 1e-12, 1e-300)]
            opened += step
            step = blocks
            open_ = np.zeros(blocks, bool)
            open_[now] = True
            sums = self._cosines(term, weight) if now.size > WHOLE * blocks else self._cosines_of(piece, q, open_[block])
            found = np.flatnonzero((sums > 0) & (sums >= least - 1e-12) & (left > 0) & np.repeat(open_, BLOCK))
            entries, cosines = np.concatenate([entries, found]), np.concatenate([cosines, sums[found]])
            rank = np.argsort(-cosines, kind="stable")
            entries, cosines = entries[rank], cosines[rank]
            enough = np.searchsorted(np.cumsum(left[entries]), self.k)
            if enough < entries.size:
                least = cosines[enough]
                stay = cosines >= least - 1e-12
                entries, cosines = entries[stay], cosines[stay]
        # equal cosines: blocks of higher bound first, in groups of 1, 2, 4, ..., then by entry
        group = np.empty(blocks, np.int64)
        group[order] = np.frexp(np.arange(1, blocks + 1))[1]
        rank = np.lexsort((entries, group[entries // BLOCK], -cosines))
        return entries[rank], cosines[rank]

    def _cosines(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of all entries."""
        start = self.piece_from[self.piece_at[term]]
        size = self.piece_from[self.piece_at[term + 1]] - start
        posting = _ranges(start, size)
        return self._sums(posting, np.repeat(weight, size))

    def _cosines_of(self, piece: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Cosines of the entries of the blocks whose pieces are ``chosen``, and 0 for others."""
        some = np.flatnonzero(chosen)
        start = self.piece_from[piece[some]]
        size = self.piece_from[piece[some] + 1] - start
        return self._sums(_ranges(start, size), np.repeat(weight[some], size))

    def _sums(self, posting: np.ndarray, weight: np.ndarray) -> np.ndarray:
        blocks = -(-self.total.size // BLOCK)
        return np.bincount(self.posting_entry[posting], weight * self.posting_weight[posting], blocks * BLOCK)

    def votes(self, term: np.ndarray, n: np.ndarray, without: int = -1, own: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic votes, and the entries and cosines behind it. One example of label ``own`` of the entry ``without`` has no vote."""
        if not term.size or not self.total.size:
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        entries, cosines = self.neighbours(*self.vector(term, n), without)
        total, toxic = self.total[entries].copy(), self.toxic[entries].copy()
        at = entries == without
        total[at] -= 1
        toxic[at] -= own
        w = 1 / (1 - np.minimum(cosines, 1) + 0.05)
        return float(((w * toxic).sum() + self.prior) / ((w * total).sum() + 1)), entries, cosines

    def probability(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 4_000,
        k: int = 15, floor: float = 0.1, half: float = 6.0) -> Examples:
    """Index about ``most`` labelled documents for which ``learn`` holds. A term without evidence weighs ``floor`` of its IDF; one
    whose log-likelihood ratio between the labels is ``half`` a quarter of it. The driver gets the counts of their words, not their texts."""
    spark = docs.sparkSession
    rows = labelled_sample(docs, labels, label, doc_id, text, learn, most).select(F.col(name_of(doc_id)).cast("long").alias("id"), "text", "label")
    rows = stored(rows.repartition(32, "id"), "examples")  # 32 tasks for a sample of bounded size
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    empty = Examples(Vocabulary(), np.zeros(0), (n1 + 0.5) / (n1 + n0 + 1), k)
    if not n1 or not n0:
        return empty

    def count(batches):
        for part, data, offsets in chunks(batches, "text"):
            h, row, n_words = *terms(data, offsets), spans(_LETTER[data], offsets)[0].size
            y, begins = part.column("label").to_numpy(), np.arange(h.size) >= n_words
            order = np.lexsort((row, h))
            h, row, begins = h[order], row[order], begins[order]
            new = np.ones(h.size, bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, y, begins = h[new], y[row[new]], begins[new]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if h.size else np.zeros(0, np.int64)
            toxic = np.add.reduceat(y, starts) if h.size else starts
            yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(begins[starts]), pa.array(toxic.astype(np.int64)),
                                              pa.array(np.diff(np.append(starts, h.size)) - toxic)], names=["h", "begins", "toxic", "clean"])

    seen = (rows.select("text", "label").mapInArrow(count, "h long, begins boolean, toxic long, clean long").groupBy("h")
            .agg(F.min("begins").alias("begins"), F.sum("toxic").alias("a"), F.sum("clean").alias("b")))
    pa_, pb = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    p = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    gain = F.abs(F.col("a") * F.log(pa_ / p) + F.col("b") * F.log(pb / p))
    known = (seen.select("h", "begins", (F.col("a") + F.col("b")).alias("n"), gain.alias("gain"), F.greatest(pa_ / pb, pb / pa_).alias("lift"))
             .filter("NOT begins OR n >= 4 AND lift >= 4 AND gain >= 6").select("h", F.when(F.col("lift") >= 2, F.col("gain")).otherwise(0.0).alias("gain")).toArrow())
    if not known.num_rows:
        return empty
    hashes = known["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    words, evidence = Vocabulary(hashes[order]), known["gain"].to_numpy()[order]
    evidence = (evidence / (evidence + half)) ** 2
    sent = spark.sparkContext.broadcast(words)
    words_n = int(hashes.size)

    def frequency(batches):
        df, n = np.zeros(words_n, np.int64), 0
        for part, data, offsets in chunks(batches, "text"):
            _, term, _ = sent.value.counts(data, offsets)
            df += np.bincount(term, minlength=words_n)
            n += part.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "n"])

    texts = docs.select(F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text"))
    got = texts.mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(words_n + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()  # the last is the number of documents
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-3
    model = Examples(words, idf * (floor + evidence), empty.prior, k)

    def vectors(batches):
        for part, data, offsets in chunks(batches, "text"):
            row, term, n = sent.value.counts(data, offsets)
            at = np.searchsorted(row, np.arange(offsets.size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32))),
                                              pa.ListArray.from_arrays(pa.array(at), pa.array(n.astype(np.int32)))], names=["id", "label", "term", "n"])

    listed = rows.mapInArrow(vectors, "id long, label int, term array<int>, n array<int>").toArrow().combine_chunks().sort_by("id")
    size = pc.list_value_length(listed["term"]).to_numpy()
    ends = np.cumsum(size)
    term, n = (pc.list_flatten(listed[c]).to_numpy().astype(np.int64) for c in ("term", "n"))
    entry: dict[tuple, int] = {}
    entry_of = np.full(size.size, -1)
    for i in np.flatnonzero(size):
        at = slice(ends[i] - size[i], ends[i])
        entry_of[i] = entry.setdefault((term[at].tobytes(), n[at].tobytes()), len(entry))
    if not entry:
        return model
    first = np.flatnonzero(entry_of >= 0)[np.unique(entry_of[entry_of >= 0], return_index=True)[1]]
    ids, y = listed["id"].to_numpy(), listed["label"].to_numpy().astype(float)
    some = entry_of >= 0
    total, toxic = np.bincount(entry_of[some]).astype(float), np.bincount(entry_of[some], y[some])
    place = model.build([model.vector(term[ends[i] - size[i]:ends[i]], n[ends[i] - size[i]:ends[i]]) for i in first], total, toxic, ids[first])
    own = np.where(entry_of >= 0, place[entry_of], -1)
    with_own = spark.sparkContext.broadcast((model, ids, own))

    def left_out(batches):
        m, known_ids, places = with_own.value
        for part, data, offsets in chunks(batches, "text"):
            row, term, n = m.vocabulary.counts(data, offsets)
            at = np.searchsorted(row, np.arange(offsets.size))
            label = part.column("label").to_numpy()
            mine = places[np.searchsorted(known_ids, part.column("id").to_numpy())]
            share = [m.votes(term[at[i]:at[i + 1]], n[at[i]:at[i + 1]], int(mine[i]), int(label[i]))[0] for i in range(label.size)]
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.float64()), part.column("label")], names=["share", "label"])

    tuned = rows.mapInArrow(left_out, "share double, label int").toArrow().sort_by([("share", "ascending"), ("label", "ascending")])
    sent.destroy(), with_own.destroy()
    model.slope, model.shift = _curve(_logit(tuned["share"].to_numpy()), tuned["label"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Examples, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the probability of label 1, the raw share of votes and up to three nearest entries as evidence:
    an example's id, its cosine, and how many examples have its vector and how many of these are toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    near = StructType([StructField("example", LongType()), StructField("cosine", DoubleType()), StructField("examples", IntegerType()), StructField("toxic", IntegerType())])
    arrow = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("examples", pa.int32()), ("toxic", pa.int32())]))

    def make():
        m = sent.value

        def of(data, offsets, part):
            row, term, n = m.vocabulary.counts(data, offsets)
            at = np.searchsorted(row, np.arange(offsets.size))
            share, evidence = np.full(offsets.size - 1, m.prior), [[]] * (offsets.size - 1)
            for i in np.flatnonzero(np.diff(at)):
                share[i], entries, cosines = m.votes(term[at[i]:at[i + 1]], n[at[i]:at[i + 1]])
                evidence[i] = [{"example": int(m.example[e]), "cosine": float(c), "examples": int(m.total[e]), "toxic": int(m.toxic[e])}
                               for e, c in zip(entries[:3], cosines[:3])]
            return [pa.array(m.probability(share)), pa.array(share), pa.array(evidence, arrow)]
        return of

    fields = [StructField("score", DoubleType()), StructField("votes", DoubleType()), StructField("evidence", ArrayType(near))]
    return add_columns(docs, text, fields, make, ["doc_id"] if keep is None else keep)
