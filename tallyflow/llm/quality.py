"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential is linear in its own features and in those of the
line before and after it; neighbouring labels are tied by a 2 x 2 table. Training documents pass their
label to all their lines. The document's quality is the mean of the forward-backward marginals weighted by
line length, mapped to a probability of label 1 by a logistic curve fitted on the same documents.

Defined cases: a null text is empty; an empty text is one line of length 0; without labels, or with labels
of one kind, every score is the smoothed share of label 1 (0.5 without any); repeated rows are scored each,
equal texts equally; null ids and extra columns are carried along. Line count and length have no limit.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField

from tallyflow.llm.frames import add_columns, labelled_sample
from tallyflow.llm.text import chunks, per_span, spans, word_hashes, words

#: Bytes by kind: letters (ASCII letters and all of multi-byte characters), upper case, digits, sentence marks, other ASCII signs.
_KINDS = np.zeros((5, 256), bool)
_KINDS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS[1, 65:91] = True
_KINDS[2, 48:58] = True
_KINDS[3, [ord(c) for c in ".,;:'\"?()-"]] = True
_KINDS[4, [i for i in range(33, 127) if not _KINDS[:4, i].any()]] = True
FEATURES = 13


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, line lengths in bytes, and the first line of each row (one entry more).
    A row always has a line: an empty or newline-only row has one of length 0."""
    n = offsets.size - 1
    starts, ends, first = spans(data != 10, offsets)
    empty = np.diff(first) == 0
    if empty.any():
        starts = np.insert(starts, first[:-1][empty], offsets[:-1][empty])
        ends = np.insert(ends, first[:-1][empty], offsets[:-1][empty])
        first = first + np.concatenate([[0], np.cumsum(empty)])
    size = (ends - starts).astype(np.float64)
    at_least = np.maximum(size, 1.0)
    share = [per_span(kind[data], starts, ends) / at_least for kind in _KINDS]
    w0, w1, _ = words(data, offsets)
    h = word_hashes(data, w0, w1)
    line = np.searchsorted(starts, w0, "right") - 1
    lines = starts.size
    count = np.bincount(line, minlength=lines).astype(np.float64)
    some = np.maximum(count, 1.0)
    same = np.zeros(h.size)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    new = np.ones(h.size)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], new, lines) / some
    tail = np.bincount(line, _KINDS[4][data[w1 - 1]], lines) / some if h.size else np.zeros(lines)
    alone = np.bincount(line, (w1 - w0 == 1) & _KINDS[4][data[w0]], lines) / some if h.size else np.zeros(lines)
    features = np.stack([*share, np.log1p(size) / 10, np.log1p(count) / 10, np.minimum(size / some, 40.0) / 10,
                         np.bincount(line, same, lines) / some, 1 - distinct, tail, alone, (size == 0) * 1.0], axis=1)
    assert features.shape[1] == FEATURES and first.size == n + 1
    return features, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, flags for the document's first and last line, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    top, end = np.zeros(len(x)), np.zeros(len(x))
    top[first[:-1]], end[first[1:] - 1] = 1, 1
    before[top == 1], after[end == 1] = 0, 0
    return np.concatenate([x, before, after, top[:, None], end[:, None], np.ones((len(x), 1))], axis=1)


def marginals(s: np.ndarray, first: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) of every line from log potentials ``s`` and the log table ``tie`` (2 x 2), the log
    normaliser of every sequence, and expected counts of neighbouring labels (2 x 2 per sequence, summed by
    the caller's weights). Sequences advance together, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    head, size = first[:-1][order], size[order]
    s = np.clip(s, -30, 30)
    psi = np.stack([np.ones_like(s), np.exp(s)], axis=1)
    table = np.exp(np.clip(tie, -20, 20))
    alpha, scale = np.empty_like(psi), np.empty(len(s))
    steps = int(size[0]) if size.size else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    for t in range(steps):
        i = head[:active[t]] + t
        a = psi[i] if t == 0 else (alpha[i - 1] @ table) * psi[i]
        scale[i] = a.sum(1)
        alpha[i] = a / scale[i][:, None]
    beta = np.ones_like(psi)
    pairs = np.zeros((len(size), 2, 2))
    for t in range(steps - 2, -1, -1):
        i = head[:active[t + 1]] + t
        right = psi[i + 1] * beta[i + 1] / scale[i + 1][:, None]
        pairs[:active[t + 1]] += alpha[i][:, :, None] * table * right[:, None, :]
        beta[i] = right @ table.T
    out = np.empty_like(pairs)
    out[order] = pairs
    return (alpha * beta)[:, 1], np.add.reduceat(np.log(scale), first[:-1]) if len(s) else np.zeros(0), out


@dataclass
class Field:
    """Weights of the random field and of the curve from mean marginal to probability."""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * FEATURES + 3))
    tie: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    slope: float = 0.0
    shift: float = 0.0

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.spread, first)

    def documents(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal and probability of label 1 of every document."""
        good, _, _ = marginals(self.lines(x, first) @ self.weights, first, self.tie)
        weight = np.maximum(size, 1.0)
        mean = per_span(good * weight, first[:-1], first[1:]) / per_span(weight, first[:-1], first[1:])
        return mean, 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with a small penalty; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.5 * a, (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        step = np.linalg.solve([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]], g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(a, 1e-3), b


def fit_field(x: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 160, longest: int = 64,
              penalty: float = 1e-3) -> Field:
    """Maximise the penalised conditional likelihood with Adam. Training sequences are pieces of at most
    ``longest`` lines; each document weighs the same and both labels weigh the same in total."""
    out = Field(mean=x.mean(0), spread=x.std(0) + 1e-3)
    of_doc = np.repeat(np.arange(len(y)), np.diff(first))
    z = out.lines(x, first)
    place = np.arange(len(x)) - first[:-1][of_doc]
    cut = np.append(np.flatnonzero(place % longest == 0), len(x))
    label = y[of_doc].astype(float)
    by_class = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    weight = (by_class / np.diff(first))[of_doc]
    per_piece = weight[cut[:-1]]
    inner = np.ones(len(x), bool)
    inner[cut[:-1]] = False
    seen = np.zeros((2, 2))
    kind = label.astype(int)
    np.add.at(seen, (kind[:-1][inner[1:]], kind[1:][inner[1:]]), weight[1:][inner[1:]])
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        good, _, pairs = marginals(z @ theta[:-4], cut, theta[-4:].reshape(2, 2))
        grad = np.concatenate([z.T @ (weight * (label - good)), (seen - (pairs * per_piece[:, None, None]).sum(0)).ravel()]) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out.weights, out.tie = theta[:-4], theta[-4:].reshape(2, 2)
    mean, _ = out.documents(x, size, first)
    out.slope, out.shift = _curve(_logit(mean), y.astype(float))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        most: int = 6_000) -> Field:
    """Fit on about ``most`` labelled documents for which ``learn`` holds; their line features, not their
    texts, go to the driver."""
    rows = labelled_sample(docs, labels, label, doc_id, text, learn, most).select("text", "label")

    def run(batches):
        for part, data, offsets in chunks(batches, "text"):
            x, size, first = line_features(data, offsets)
            row = np.diff(first)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat),
                                              pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(size)),
                                              part.column("label"), pa.array(row.astype(np.int32))], names=["x", "size", "label", "lines"])

    got = rows.mapInArrow(run, "x array<array<float>>, size array<double>, label int, lines int").toArrow()
    y = got["label"].to_numpy().astype(int)
    if y.size == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (y.size + 1.0)
        return Field(slope=0.0, shift=float(np.log(share / (1 - share))))
    x = got["x"].combine_chunks().flatten().flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
    size = got["size"].combine_chunks().flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(got["lines"].to_numpy())])
    return fit_field(x, size, first, y)


def score(docs: DataFrame, model: Field, text: str = "text", keep: list[str] | None = None, names=("score", "good_share", "n_lines")) -> DataFrame:
    """``keep`` columns with the probability of label 1, the mean marginal and the number of lines."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        field_ = sent.value

        def of(data, offsets, part):
            x, size, first = line_features(data, offsets)
            mean, p = field_.documents(x, size, first)
            return [pa.array(p), pa.array(mean), pa.array(np.diff(first).astype(np.int32))]
        return of

    fields = [StructField(names[0], DoubleType()), StructField(names[1], DoubleType()), StructField(names[2], IntegerType())]
    return add_columns(docs, text, fields, make, ["doc_id"] if keep is None else keep)


def filter_documents(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5, text: str = "text", **fit_options) -> DataFrame:
    """The rows of ``docs`` whose quality reaches ``threshold``, with their own columns only."""
    from tallyflow.llm.frames import free_name, name_of
    from pyspark.sql import functions as F

    model = fit(docs, labels, learn, text=text, **fit_options)
    names = [free_name(docs.columns, n) for n in ("quality_score", "quality_share", "quality_lines")]
    kept = score(docs, model, text, docs.columns, names).filter(F.col(names[0]) >= threshold)
    return kept.select(*[F.col(name_of(c)) for c in docs.columns])
