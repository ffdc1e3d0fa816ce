"""Language of a document by error-correcting output codes over character trigrams.

Every language has a codeword of +1/-1 bits. For each bit a binary classifier (a multinomial model on
hashed trigrams of lower-cased letters, with word breaks) separates the languages of +1 from those of -1.
Its answer is the mean log odds of a text's trigrams, scaled to a margin. Decoding adds up, over bits, a
logistic loss of margin against codeword bit, weighted by how well that bit's classifier did for that
language on a sample of training texts, and takes the codeword of least loss.

Defined cases: ``und`` with score 0 for a null text or one without a letter, or when nothing was learned;
with one learned language every text with a letter is that language with score 1; ties go to the language
first in code-point order; rows with null language do not teach; repeated rows are treated alike.
A text is ambiguous when its two best losses differ by less than ``margin``.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField

from tallyflow.llm.frames import add_columns, free_name, name_of
from tallyflow.llm.text import chunks

UNKNOWN = "und"
BUCKETS = 1 << 16
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code points below 2^16: the lower-case letter, or 0 for what is no letter."""
    if not _FOLD:
        _FOLD.append(np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(1 << 16))], np.uint32))
    return _FOLD[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows, and row offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    folded = np.where(points < (1 << 16), _fold()[np.minimum(points, (1 << 16) - 1)], 0)
    wide = np.flatnonzero(points >= (1 << 16))
    for p in np.unique(points[wide]):
        if chr(p).isalpha():
            folded[wide[points[wide] == p]] = p
    return folded, before[offsets]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all trigrams that hold a letter in the middle, the row of each, and whether each row has a letter."""
    c, at = letters(data, offsets)
    n = at.size - 1
    row = np.repeat(np.arange(n), np.diff(at))
    mid = np.flatnonzero(c)
    left = np.where((mid > 0) & (row[mid - 1] == row[mid]), c[mid - 1], 0) if mid.size else c[mid]
    after = np.minimum(mid + 1, max(c.size - 1, 0))
    right = np.where((mid + 1 < c.size) & (row[after] == row[mid]), c[after], 0) if mid.size else c[mid]
    h = left * np.uint32(0x9E3779B1) + c[mid] * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return ((h >> np.uint32(16)) & np.uint32(BUCKETS - 1)).astype(np.int64), row[mid], np.bincount(row[mid], minlength=n) > 0


def codewords(k: int, most: int = 64) -> np.ndarray:
    """Codewords of ``k`` languages: all different non-constant splits up to 6 languages, otherwise random
    splits in half, as many as 8 log2(k) at least, kept while languages stay far apart."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 6:
        return np.array([[1, *bits] for bits in product((1, -1), repeat=k - 1) if -1 in bits], float).T
    rng = np.random.default_rng(7)
    best, apart = None, -1
    bits = min(most, int(np.ceil(8 * np.log2(k))))
    for _ in range(200):
        m = np.stack([rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0)) for _ in range(bits)], axis=1)
        distance = (bits - m @ m.T) / 2 + np.eye(k) * bits
        if distance.min() > apart:
            best, apart = m, distance.min()
    return best


@dataclass
class LanguageCode:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    odds: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds of every row and bit, scaled, and whether the row has a letter."""
        h, row, has = trigrams(data, offsets)
        n = offsets.size - 1
        count = np.maximum(np.bincount(row, minlength=n), 1)
        mean = np.stack([np.bincount(row, self.odds[h, b], n) for b in range(self.code.shape[1])], axis=1) if self.code.shape[1] else np.zeros((n, 0))
        return mean / count[:, None] * self.scale, has

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every row and language."""
        z = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -4 * z) * self.trust[None, :, :]).sum(2)


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", tuning: int = 4_000) -> LanguageCode:
    """Trigram counts come from all rows where ``learn`` holds and the language is known; the scale and
    trust of the bits from a sample of about ``tuning`` of them. The driver gets languages x buckets counts."""
    rows = docs.filter(learn & F.col(name_of(lang)).isNotNull()).select(
        F.col(name_of(lang)).cast("string").alias("lang"), F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.col(name_of(doc_id)).cast("string")), F.lit(1 << 30)).alias("draw"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for part, data, offsets in chunks(batches, "text"):
            h, row, _ = trigrams(data, offsets)
            names = part.column("lang").dictionary_encode()
            kind = names.indices.to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                got = np.bincount(h[kind[row] == i], minlength=BUCKETS)
                sums[name] = sums[name] + got if name in sums else got
                texts[name] = texts.get(name, 0) + int((kind == i).sum())
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (at.size + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)),
                                              pa.array(np.append(got[at], texts[name]).astype(np.int64))], names=["lang", "bucket", "n"])

    got = (rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket")
           .agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(got["lang"].to_pylist()))
    if not names:
        return LanguageCode()
    table = np.zeros((len(names), BUCKETS + 1))
    index = {n: i for i, n in enumerate(names)}
    table[[index[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    total, table = table[:, -1].sum(), table[:, :-1]
    code = codewords(len(names))
    share = (table + 0.05) / (table.sum(1, keepdims=True) + 0.05 * BUCKETS)
    bits = code.shape[1]
    odds = np.stack([np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0)) for b in range(bits)], axis=1).astype(np.float32) \
        if bits else np.zeros((BUCKETS, 0), np.float32)
    odds[table.sum(0) == 0] = 0
    model = LanguageCode(names, code, odds, np.ones(bits), np.ones(code.shape))
    if not bits:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for part, data, offsets in chunks(batches, "text"):
            m, has = sent.value.margins(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("lang").filter(pa.array(has)), pa.array(list(m[has]), pa.list_(pa.float64()))], names=["lang", "m"])

    sample = rows.filter(F.col("draw") < int((1 << 30) * min(1.0, tuning / max(total, 1)))).select("lang", "text")
    seen = sample.mapInArrow(margins, "lang string, m array<double>").toArrow()
    if seen.num_rows:
        m = seen["m"].combine_chunks().flatten().to_numpy().reshape(-1, bits)
        kind = np.array([index.get(x, 0) for x in seen["lang"].to_pylist()])
        model.scale = 1 / np.maximum(np.median(np.abs(m), axis=0), 1e-6)
        right = (m * code[kind]) > 0
        for i in range(len(names)):  # share of right bits per language, smoothed, above chance
            mine = right[kind == i]
            model.trust[i] = np.maximum((mine.sum(0) + 1) / (len(mine) + 2) - 0.5, 0.05)
    model.trust /= model.trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: LanguageCode, text: str = "text", keep: list[str] | None = None, margin: float = 0.02,
            names=("lang_pred", "score", "second", "ambiguous", "code_distance")) -> DataFrame:
    """``keep`` columns with the decoded language, its probability (softmax of the losses), the runner-up,
    whether the decision is ambiguous and the number of hard bits that differ from the codeword."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        known = np.array([*m.languages, UNKNOWN], object)

        def of(data, offsets, part):
            z, has = m.margins(data, offsets)
            n, k = len(has), len(m.languages)
            best, second = np.full(n, k), np.full(n, k)
            p, gap, wrong = np.zeros(n), np.full(n, np.inf), np.zeros(n)
            if k == 1:
                best, p = np.where(has, 0, k), has * 1.0
            elif k:
                loss = m.losses(z)
                order = np.argsort(loss, axis=1, kind="stable")
                i = np.arange(n)
                soft = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
                soft /= soft.sum(1, keepdims=True)
                best, second = np.where(has, order[:, 0], k), np.where(has, order[:, 1], k)
                p = np.where(has, soft[i, order[:, 0]], 0.0)
                gap = loss[i, order[:, 1]] - loss[i, order[:, 0]]
                wrong = ((z * m.code[order[:, 0]]) <= 0).sum(1) * has
            return [pa.array(known[best], pa.string()), pa.array(p), pa.array(known[second], pa.string()),
                    pa.array(has & (gap < margin)), pa.array(wrong.astype(np.int32))]
        return of

    fields = [StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), StringType(), BooleanType(), IntegerType()))]
    return add_columns(docs, text, fields, make, ["doc_id"] if keep is None else keep)


def filter_documents(docs: DataFrame, learn: Column, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with a language that is not ambiguous, with their own columns only."""
    model = fit(docs, learn, text=text, **options)
    names = [free_name(docs.columns, n) for n in ("language_pred", "language_score", "language_second", "language_ambiguous", "language_distance")]
    kept = predict(docs, model, text, docs.columns, names=names).filter((F.col(names[0]) != UNKNOWN) & ~F.col(names[3]))
    return kept.select(*[F.col(name_of(c)) for c in docs.columns])
