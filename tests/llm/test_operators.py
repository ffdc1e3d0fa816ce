"""Brute-force versions, round trips and odd inputs of the corpus operators."""
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyflow.llm import decontaminate, hmm, language, ngram_join, packing, quality, queries, simhash, token_files, tokens, toxicity, url_lists
from tallyflow.llm.frames import components, remainder
from tallyflow.llm.text import text_bytes
from tallyflow.sources.storage import work_path
from tests.llm.conftest import PROSE, SCHEMA

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def every():
    return F.lit(True)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name,end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_ids_of_pieces_are_those_of_the_text(name, end):
    texts = [None, "", " ", "a", "  two  spaces ", "tab\tand\n\nnewlines \n", "it's Don't  'll", "é ü ß 漢字 x", "no break  \n\nand em", "end ",
             "<|endoftext|> x<|endoftext|>", "á b ́c", "12,345.67% $5", "x" * 5000, "\x1c sep\x1f", " 　 ", "A\r\nB\x0b\x0cC"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab C\n\t 'sé9.,!-<|$_  漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    e = tokens.Encoder(public_tokenizers.path(name))
    ids, at = tokens.with_end(*e.encode(*text_bytes(pa.array(texts, pa.string()))), end)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [end], repr(t)


def test_token_files_read_back(spark, odd, none):
    name = public_tokenizers.path("byte_bpe_50k.json")
    path = work_path(spark, "t")
    token_files.write(odd, path, name, 2)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert token_files.read_document(spark, path, 6) == [r["ids"] for r in rows if r["doc_id"] == 6]
    assert len(token_files.read_document(spark, path, 2)) == 2 and token_files.read_document(spark, path, 99) == []
    empty = work_path(spark, "t")
    token_files.write(none, empty, name, 2)
    assert token_files.read(spark, empty).count() == 0


def test_dictionary_is_checked(spark, documents):
    path = work_path(spark, "t")
    token_files.write(documents, path, public_tokenizers.path("byte_bpe_50k.json"), 2, dictionary_size=4096)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert len(row["dictionary"]) > 1000 and hashlib.sha256(row["dictionary"]).hexdigest() == row["dict_hash"]
    spark.createDataFrame([(b"other", row["dict_hash"], 2)], "dictionary binary, dict_hash string, width int").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_files.read(spark, path)


def test_plan_places_every_rank_once():
    rng = random.Random(3)
    for capacity in (1, 2, 3, 10, 64):
        counts = {s: rng.randrange(1, 30) for s in range(1, capacity + 1) if rng.random() < 0.7}
        plan = packing.plan(counts, capacity)
        filled = defaultdict(list)
        for i, (size, first, sequence, each, offset) in enumerate(plan.tolist()):
            last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == size else counts[size]
            for rank in range(first, last):
                nth = rank - first
                filled[sequence + nth // each].append((offset + nth % each * size, size))
        assert sum(map(len, filled.values())) == sum(counts.values())
        for parts in filled.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= capacity and sum(3 * size > capacity for _, size in parts) <= 2
        assert len(filled) <= 1.3 * -(-sum(s * n for s, n in counts.items()) // capacity) + sum(n for s, n in counts.items() if 2 * s > capacity)


@pytest.mark.parametrize("rows", [1, 50_000])
def test_packing(spark, odd, none, rows, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", rows)
    name = public_tokenizers.path("word_bpe_49k.json")
    held, placed = packing.pack(odd, name, 1, capacity=256)
    got = placed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == held.count()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0 and max(map(sum, parts)) <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 1
    t = Tokenizer.from_file(name)
    ids = t.encode(PROSE, add_special_tokens=False).ids + [1]
    assert [r["ids"] for r in held.filter("doc_id = 1").collect()] == [ids, ids]
    assert packing.pack(none, name, 1)[1].count() == 0


def test_sequences_hold_the_ids(spark, documents):
    held, placed = packing.pack(documents, public_tokenizers.path("word_bpe_49k.json"), 1)
    whole = packing.sequences(held, placed).agg(F.sum(F.size("ids")), F.max(F.size("ids"))).first()
    assert whole[0] == held.agg(F.sum("length")).first()[0] and whole[1] <= 4096


def linked(rows, k, percent):
    """Set sizes, components and links by comparing all pairs."""
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = words(t)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    links = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return sorted((d, len(sets[i]), low[find(i)], links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("leaf", [2, 512])
def test_join_equals_all_pairs(spark, leaf, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF_MEMBERS", leaf)
    monkeypatch.setattr(ngram_join, "POINT_MEMBERS", leaf)
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)] for n in (3, 5, 8, 12, 20, 40, 90, 200)]
    rows = []
    for w in base:
        for c in range(12):
            v = list(w)
            for _ in range(c // 3 * max(1, len(w) // 60)):
                v[rng.randrange(len(v))] = "new" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "One", "one", "one two", "A b c d", "a B c d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80), (1, 50)):
        got = sorted(tuple(r) for r in ngram_join.similar(df, k, percent).collect())
        assert got == linked(rows, k, percent), (k, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for n in (*range(1, 40), 97, 230, 700):
        for percent in (80, 85, 50):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            gone = rng.integers(0, 1 + x.size * (100 - percent) // 100)
            y = x[np.sort(rng.permutation(x.size)[gone:])]
            if not np.array_equal(x, y) and 100 * y.size >= percent * x.size:
                assert np.intersect1d(ngram_join.keys(x, percent), ngram_join.keys(y, percent)).size


def test_bound_keeps_linked_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for n in (6, 30, 200, 900):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for c in range(8):
            gone = rng.permutation(base.size)[:c * n // 40]
            sets.append(np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 2**64, gone.size, dtype=np.uint64)])))
    size = np.array([x.size for x in sets])
    linked = {(i, j) for i, x in enumerate(sets) for j in range(i) if 9 * np.intersect1d(x, sets[j]).size >= 4 * (x.size + sets[j].size)}  # 80 per cent
    fine, coarse = (np.stack([np.bincount((x >> np.uint64(64 - g)).astype(np.int64), minlength=1 << g) for x in sets]) for g in (8, 5))
    one = {(max(i, j), min(i, j)) for i, near in ngram_join.near_points(size, fine, None, None, 80) for j in near.tolist()}
    two = {(i, j) for i, near in ngram_join.near_points(size, fine, size, coarse, 80) for j in near.tolist() if j < i}
    assert linked and linked <= one and linked <= two and len(one) < len(sets) * (len(sets) - 1) // 4


def test_join_of_odd_rows(spark, odd, none):
    got = ngram_join.similar(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1} and {r["n_shingles"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None])
    assert ngram_join.similar(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_rows_without_ids_meet_their_own_text_only(spark):
    rows = [(i if i % 2 else None, " ".join(f"w{(i // 3) * 7 + j}" for j in range(12)) + f" end{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = ngram_join.points(docs, 4, 50).where("node IS NOT NULL").select("node", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), F.lit(1).alias("copies"))
    families = at.select("node", F.lit(0).alias("component"))
    assert ngram_join._members(docs, at, families, "members", "text", "doc_id").count() == len(rows)


def test_work_tables_are_deleted(spark):
    folder = Path(work_path(spark, "x").removeprefix("file:")).parent
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(20)], "doc_id long, text string")
    before = {p.name for p in folder.iterdir()}
    assert ngram_join.keep_one(docs).count() == 10
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert not left & {"points", "neighbours", "leaves", "points-leaves", "forest", "survivors"}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(200, 300 + i) for i in range(50)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    root = {}
    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    used = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in used}


def test_language(spark, documents, odd, none):
    out = queries.op1(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["held_out"]]) > 0.95
    model = language.fit(odd, every())
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (7, "fr"), (1, "en")} <= got
    nothing = language.fit(none, every())
    assert {(r["lang_pred"], r["score"]) for r in language.predict(odd, nothing).collect()} == {("und", 0.0)}
    one = language.fit(odd.filter("lang = 'en'"), every())
    assert {r["lang_pred"] for r in language.predict(odd, one).collect()} == {"en", "und"}
    assert language.filter_documents(odd, every()).columns == odd.columns and language.filter_documents(none, every()).count() == 0


def test_codewords_differ():
    for k in range(2, 40):
        m = language.codewords(k)
        assert len({tuple(r) for r in m}) == k and all(abs(m[:, b].sum()) < k for b in range(m.shape[1]))


def test_quality(spark, labels, odd, none):
    out = queries.op6(spark, SF).join(labels, "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in out if r["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, every())
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and {r["n_lines"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    flat = quality.fit(none, labels, every())
    assert {r["score"] for r in quality.score(odd, flat).collect()} == {0.5}
    assert quality.filter_documents(odd, labels, every()).columns == odd.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    s, tie = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 9])
    got, log_z, pairs = quality.marginals(s, first, tie)
    for q, (a, b) in enumerate(zip(first, first[1:])):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            w = np.exp(sum(s[a + i] * y[i] for i in range(b - a)) + sum(tie[u, v] for u, v in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
            for u, v in zip(y, y[1:]):
                two[u, v] += w
        assert np.allclose(got[a:b], one / total) and np.isclose(log_z[q], np.log(total)) and np.allclose(pairs[q], two / total)


def test_toxicity(spark, labels, odd, none):
    out = queries.op10(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9 and not [r for r in held if r["predicted"] and not r["toxic"]][2:]
    assert any(r["evidence"] for r in out)
    flat = toxicity.fit(none, labels, every())
    rows = toxicity.score(odd, flat).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows}) == 1


def test_cosines_are_those_of_whole_texts(spark):
    """Nearest examples against plain TF-IDF over dictionaries, beginnings and evidence included."""
    rng = random.Random(11)
    plain = [a + b + c for a in ("ba", "ko", "ti") for b in ("lu", "mar", "sen") for c in ("", "do", "nag")]
    texts = []
    for i in range(90):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 30))] + ["only%s" % chr(97 + i % 26)]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), "venom" + rng.choice(("ous", "ed", "")))
        texts.append(" ".join(words).capitalize())
    texts += [texts[0], texts[7], "", None, "unseen words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, every())
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}

    def counts(text):
        words = re.findall("[a-z]+", (text or "").lower())
        return Counter(words), Counter((w[:n], n) for w in words for n in (4, 5, 6, 7) if len(w) >= n)

    both = [counts(t) for t in texts]
    a, b = Counter(), Counter()
    for i in range(60):
        (a if i % 3 == 0 else b).update({*both[i][0], *both[i][1]})
    weight = {}
    for t in {*a, *b}:
        pa, pb, p = (a[t] + 0.5) / 21, (b[t] + 0.5) / 41, (a[t] + b[t] + 1) / 62
        gain, lift = abs(a[t] * np.log(pa / p) + b[t] * np.log(pb / p)), max(pa / pb, pb / pa)
        if isinstance(t, tuple) and not (a[t] + b[t] >= 4 and lift >= 4 and gain >= 6):
            continue
        gain = gain if lift >= 2 else 0
        df = sum(t in w or t in start for w, start in both)
        weight[t] = (np.log((len(texts) + 1) / (df + 1)) + 1e-3) * (0.1 + (gain / (gain + 6)) ** 2)
    assert any(isinstance(t, tuple) for t in weight) and any("only" in t for t in weight)

    def vector(i):
        v = {t: (1 + np.log(n)) * weight[t] for c in both[i] for t, n in c.items() if t in weight}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(i) for i in range(len(texts))]
    for i, text in enumerate(texts):
        best = sorted((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) for j in range(60)), reverse=True)
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [c for c in best[:3] if c > 0])
        assert not vectors[i] or got[i]["evidence"][0]["examples"] >= 1
    assert {got[i]["evidence"][0]["example"] for i in (0, 90)} == {0} and np.isclose(got[91]["evidence"][0]["cosine"], 1)
    assert len({got[i]["score"] for i in (92, 93, 94)}) == 1 and not got[94]["evidence"]
    assert min(got[i]["score"] for i in range(0, 90, 3)) > max(got[i]["score"] for i in range(90) if i % 3)


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    v, m = 40, 700
    model = toxicity.Examples(toxicity.Vocabulary(np.arange(v, dtype=np.uint64)), rng.random(v) + 0.2, k=15)
    vectors = [model.vector(t := np.sort(rng.permutation(v)[:rng.integers(1, 6)]), rng.integers(1, 4, t.size)) for _ in range(m)]
    total, toxic = rng.integers(1, 4, m).astype(float), np.zeros(m)
    model.build(vectors, total, toxic, np.arange(m))
    dense = np.zeros((m, v + 1))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    dense = dense[model.example]
    for t, w in vectors[:60]:
        q = np.zeros(v + 1)
        q[t] = w
        cosine = dense @ q
        order = np.argsort(-cosine, kind="stable")
        kth = cosine[order[np.searchsorted(np.cumsum(model.total[order]), 15)]]
        entries, cosines = model.neighbours(t, w)
        assert set(entries) == set(np.flatnonzero(cosine >= kth - 1e-9)) and np.allclose(cosines, cosine[entries])


def test_forward_equals_enumeration():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    symbols, at = rng.integers(0, 5, 12), np.array([0, 5, 6, 12])
    t = hmm.TimeMajor(symbols, at)
    scale, _ = model.forward(t)
    got = np.bincount(t.sequence, np.log(scale), 3)
    counts, moves, first = model.expected(t)
    assert np.isclose(counts.sum(), 12) and np.isclose(moves.sum(), 9) and np.isclose(first.sum(), 3)
    for i, (a, b) in enumerate(zip(at, at[1:])):
        p = np.zeros(1)
        for path in np.ndindex(*[3] * (b - a)):
            w = model.start[path[0]] * model.emit[symbols[a], path[0]]
            for j in range(1, b - a):
                w *= model.move[path[j - 1], path[j]] * model.emit[symbols[a + j], path[j]]
            p += w
        assert np.isclose(got[i], np.log(p[0]))


def test_language_model(spark, documents, odd, none):
    rows = documents.select("doc_id", "text").collect()
    tokens_of = {r["doc_id"]: words(r["text"]) + [None] for r in rows}
    count = Counter(w for d, ws in tokens_of.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op8(spark, SF).collect()}
    for d, ws in tokens_of.items():
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n) and np.isclose(r["base_score"], base)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    model, counts = hmm.fit(odd, every())
    assert {r["n_tokens"] for r in hmm.score(odd, model, counts).collect() if r["doc_id"] in (3, 4, 5)} == {1}
    model, counts = hmm.fit(none, every())
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in hmm.score(odd, model, counts).collect()} == {(0.0, 0.0, 0)}


def test_language_model_starts_from_every_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red green w{i % 9} blue" if i % 2 else f"one two n{i % 7}") for i in range(60)], "doc_id long, text string")
    sizes, sums = [], hmm._sums

    def counted(encoded, *rest):
        sizes.append(encoded.count())
        return sums(encoded, *rest)

    monkeypatch.setattr(hmm, "_sums", counted)
    model, _ = hmm.fit(docs, every(), states=2, least=15, rounds=4, passes=1)
    assert max(sizes[1:5]) < 60 and sum(sizes[1:5]) == 60 and sizes[5:] == [60]    # the rounds' shares, then a pass
    assert np.allclose(model.hmm.emit.sum(axis=0), 1) and np.allclose(model.hmm.move.sum(axis=1), 1)
    sizes.clear()
    hmm.fit(docs, every(), states=2, rounds=2, passes=1)
    assert sizes == [60] * 4


def plain_pass(texts, start, move, emit):
    """One Baum-Welch pass over whole sequences of words, in a loop: expected (word, state), (state, next state) and first states."""
    counts, moves, first = Counter(), np.zeros_like(move), np.zeros_like(start)
    for ws in texts:
        e = np.array([emit(w) for w in ws])
        a, b = [start * e[0]], [np.ones(len(start))]
        for x in e[1:]:
            a.append((a[-1] @ move) * x)
        for x in e[:0:-1]:
            b.append(move @ (x * b[-1]))
        a, b = np.array(a), np.array(b[::-1])
        p = a[-1].sum()
        for t, w in enumerate(ws):
            counts[w] = counts[w] + a[t] * b[t] / p
        for t in range(len(ws) - 1):
            moves += np.outer(a[t], e[t + 1] * b[t + 1]) * move / p
        first += a[0] * b[0] / p
    return counts, moves, first


def test_language_model_has_emissions_for_every_word(spark, monkeypatch):
    """Two passes of Baum-Welch over whole texts and the score, against loops, with three words held by the driver, the others in two buckets."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["red", "green"] + [f"w{i}" for i in range(i % 2, 14, 2)], rng.integers(4, 9))) for i in range(40)] + ["red " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(hmm, "_BUCKET", 8), monkeypatch.setattr(hmm, "_BLOCK", 40)
    begun = []
    whole = hmm._whole_pass
    monkeypatch.setattr(hmm, "_whole_pass", lambda encoded, model, base, known: (begun.append((model.hmm, base)), whole(encoded, model, base, known)))
    model, counts = hmm.fit(docs, every(), states=2, symbols=3, rounds=3, passes=2)
    count = Counter(w for t in texts for w in t.split() + [None])
    start, base = begun[0]
    key = {int(h): i for i, h in enumerate(model.frequent)}
    hash_of = lambda w: hmm.END if w is None else hmm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
    symbol = {w: key.get(int(hash_of(w)), len(key)) for w in count}
    rare = [w for w in count if symbol[w] == len(key)]
    assert 3 <= len(key) <= 4 and len(rare) > 8 and model.bits > 0

    def emission(at, counted):
        held = sum(counted[w] for w in rare) + (len(rare) + 1) / 2 if counted else None
        return lambda w: at.emit[symbol[w]] * (1.0 if symbol[w] < len(key) or counted is None else (counted.get(w, 0) + 0.5) / held) if w in symbol else at.emit[len(key)] * 0.5 / held

    now, counted = start, None
    for _ in range(2):
        counted, moves, first = plain_pass([t.split() + [None] for t in texts], now.start, now.move, emission(now, counted))
        table = np.zeros((len(key) + 1, 2))
        for w in count:
            table[symbol[w]] += counted[w]
        now = now.updated(table, moves, first, base)
    assert np.allclose(model.hmm.emit, now.emit, rtol=1e-4) and np.allclose(model.hmm.move, now.move, rtol=1e-4) and np.allclose(model.hmm.start, now.start, rtol=1e-4)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:6], "red never w3", ""])], "doc_id long, text string")
    emit = emission(now, counted)
    for r in hmm.score(asked, model, counts).collect():
        ws = asked.filter(f"doc_id = {r['doc_id']}").first()["text"].split() + [None]
        a = now.start * emit(ws[0])
        for w in ws[1:]:
            a = (a @ now.move) * emit(w)
        assert np.isclose(r["score"], np.log10(a.sum()), rtol=1e-4) and r["n_known"] == sum(count[w] > 0 for w in ws)
    profile = np.concatenate([hmm._long(r["e"], 2) for r in model.own.collect()])
    assert len(profile) == len(rare) and np.ptp(profile[:, 1] / profile.sum(axis=1)) > 1e-6


def test_simhash(spark, documents, odd, none):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in simhash.edited_pairs(documents).collect()}
    likeness = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    prints = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        after, r, half = rows[(i + 1) % len(rows)], got[d], len(t) // 2
        edited = t[:len(t) - half] + after[1][:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert np.isclose(r["near_edited"], likeness(r["fingerprint"], r["edited_fingerprint"])) and np.isclose(r["near_next"], likeness(r["fingerprint"], got[after[0]]["fingerprint"]))
        prints[t].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert simhash.edited_pairs(odd).count() == odd.count() and simhash.edited_pairs(none).count() == 0


def test_simhash_votes(spark):
    text = "a b c a b a a b"
    w = text.split()
    pairs = spark.createDataFrame([(x, y) for x, y in zip(w, w[1:])], "x string, y string").select(F.xxhash64(F.xxhash64("x"), F.xxhash64("y")).alias("h")).collect()
    want = sum(1 << i for i in range(64) if 2 * sum((r["h"] >> i) & 1 for r in pairs) > len(pairs))
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t").first()["fingerprint"]
    assert got % (1 << 64) == want


def test_near_fingerprints(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for v in values for _ in range(3)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "f long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) % (1 << 64)).count("1") <= 3}
    assert {(r["a"], r["b"]) for r in simhash.near(df, "f", 3).collect()} == want


def test_leaks(spark, odd, none):
    item = "Tom has 12 apples and gives 5 apples to Anna so how many apples are left for Tom after 3 days of eating 2 apples each day"
    swapped = item.replace("Tom", "Ben").replace("Anna", "Eva").replace("12", "48").replace(" 5 ", " 7 ").replace(" 3 days", " 9 weeks").replace(" 2 ", " 4 ")
    names = "we know Ann and then Bob and if Ann gives 5 marbles to Bob then Bob gives 5 back to Ann so what do Ann and Bob hold"
    mixed = "we know Al and then Bo and if Cy gives 3 marbles to Di then Ed gives 9 back to Flo so what do Gus and Hal hold"
    items = spark.createDataFrame([(1, item), (2, "short one of five words"), (3, "no"), (5, names), (4, None), (None, "this item has no id but it has quite enough words to be found")], "item_id long, text string")
    rows = [(1, f"Before it. {item} After it."), (2, f"before it all {swapped}"), (3, mixed), (4, "a clean text about apples and days and how many are left for everyone"),
            (5, "so short one of five words here"), (6, None), (7, ""), (1, f"Before it. {item} After it."), (8, "this item has no id but it has quite enough words to be found")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (8, None)}
    assert got[(1, 1)]["changed_slots"] == 0 and got[(2, 1)]["changed_slots"] > 5 and got[(2, 1)]["consistent_slots"] == got[(2, 1)]["n_slots"]
    assert sorted(r["doc_id"] for r in decontaminate.filter_documents(docs, items).collect()) == [3, 4, 6, 7]
    assert decontaminate.matches(odd, items).count() == 0 and decontaminate.filter_documents(odd, items).count() == odd.count()
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_leaks_in_several_copies(spark):
    item = "Tom has 12 apples and gives 5 apples to Anna so how many apples are left for Tom after 3 days of eating 2 apples each day"

    def varied(j):
        return item.replace("Tom", ["Ben", "Max", "Leo"][j]).replace("Anna", ["Eva", "Ida", "Mia"][j]).replace("12", f"4{j}").replace(" 5 ", f" {j + 7} ").replace(" 3 ", f" {j + 13} ").replace(" 2 ", f" {j + 23} ")

    longer = item.replace("Tom", "Mary Lou").replace("12", "1 200")
    rows = [(1, f"see {item} and then {varied(0)}"), (2, f"see {varied(0)} and then {varied(1)} and then {varied(2)}"), (3, f"{varied(1)} {varied(2)} " * 4), (4, f"see {longer} and more"),
            (5, f"see {longer} and then {varied(0)}")]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5]
    assert all(r["consistent_slots"] >= 0.75 * r["n_slots"] and r["n_slots"] <= 8 for r in found if r["doc_id"] != 4)


def test_leaks_of_numbers_and_few_words(spark):
    dense = "Complete the sequence 2, 4, 8, 16, 32, 64, 128, 256, 512"
    items = [(1, dense), (2, "1 2 4 7 11 16 22 29"), (3, "Define entropy briefly"), (4, "Why?"), (5, "3.5"), (6, "Name two primes above 10 and go on 11 13 17 19 23 29 31 37 41 43"), (7, "?!"), (8, "Solve 3 4 5")]
    rows = [(10, f"Now then. {dense}. What is next?"), (11, "now complete the sequence 3, 6, 12, 24, 48, 96, 192, 384, 768."), (12, "a table 9 8 7 6 5 4 3 2 1 0 9 8 7 6 5 4 3 2 1"),
            (20, "as in 1 2 4 7 11 16 22 29."), (21, "as in 1 2 4 7 11 16 22 30"), (30, "He said: define entropy briefly and go"), (31, "define entropy in brief"),
            (40, "So it is. Why? Nobody knows"), (41, "nobody knows why it is"), (50, "It gives.\n3.5\n"), (51, "it gives 3.5 in all"), (60, "they count and go on 11 13 17 19 23 29 31 37 41 43 and so on"),
            (80, "to solve 3 4 5 is easy"), (81, "to solve 6 7 8 is easy")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {(10, 1), (11, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6), (80, 8), (81, 8)}
    assert got[(10, 1)]["changed_slots"] == 0 and got[(11, 1)]["changed_slots"] > 5 and got[(20, 2)]["n_slots"] == 8


def test_leaks_behind_other_marks(spark):
    items = [(1, "What is the capital city of the country"), (2, "Name both largest rivers")]
    heads = ["Question: ", "so, ", "see (", 'as in "', "Q - ", "", "Then. "]
    rows = [(10 * i + j, f"{head}{text} now") for i, text in items for j, head in enumerate(heads)] + [(5 + 90, "Question: What is the largest city of the country")]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10 * i + j, i) for i, _ in items for j in range(len(heads))}
    assert all(r["changed_slots"] == 0 for r in found)


def test_leaks_find_whole_items(spark, documents):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in documents.collect() if any(i in r["text"] for i in items)}
    assert holds and holds <= {r["doc_id"] for r in queries.op7(spark, SF).collect()}


def test_shuffled_item_windows_give_the_same(spark, documents, monkeypatch):
    want = {tuple(r) for r in queries.op7(spark, SF).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in queries.op7(spark, SF).collect()} == want


def test_lists(spark):
    changes = spark.createDataFrame([
        ("bad.com", "add", "x", "2024-01-10"), ("bad.com", "remove", None, "2024-03-10"), ("BAD.com", "ADD", "y", "2024-05-01"), ("bad.com", "add", "y", "2024-05-01"),
        ("a.bad.com", "add", "z", "2024-02-01"), ("ok.org/p/", "add", "w", "2024-01-01"), (None, "add", "x", "2024-01-01"), ("ok.org", "what", "x", "2024-01-01"), ("ok.org", "add", "x", None)],
        "entry string, action string, category string, at string")
    rows = [(1, "http://www.bad.com/", "2024-01-09"), (2, "http://www.bad.com/", "2024-01-10"), (3, "http://bad.com:80/x", "2024-04-01"), (4, "https://u@A.bad.com/q?x", "2024-06-01"),
            (5, "http://ok.org/p/1", "2025-01-01"), (6, "http://ok.org/px", "2024-06-01"), (7, None, "2024-06-01"), (8, "http://bad.com", None), (9, "nonsense", "2024-06-01"), (2, "http://www.bad.com/", "2024-01-10")]
    captures = spark.createDataFrame(rows, "id long, url string, fetched_at string").withColumn("row", F.lit("kept"))
    out = url_lists.evaluate(captures, changes)
    got = sorted((r["id"], r["list_entry"], r["list_category"], r["active_entries"]) for r in out.collect() if r["listed"])
    assert got == [(2, "bad.com", "x", 1), (2, "bad.com", "x", 1), (4, "a.bad.com", "z", 2), (5, "ok.org/p/", "w", 1)]
    assert out.count() == 10 and set(captures.columns) <= set(out.columns)
    assert url_lists.evaluate(captures.limit(0), changes).count() == 0 and url_lists.evaluate(captures, changes.limit(0)).filter("listed").count() == 0


def test_pipeline_stages(spark, documents, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "benchmark_leaks", "packing"]
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() > 0.6 * documents.count()
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    bad = {r["doc_id"] for r in queries.op7(spark, SF).collect()}
    assert not ids & bad and remainder("doc_id", 4) is not None and SCHEMA


def test_lists_do_not_depend_on_how_captures_arrive(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    changes = queries._list_changes(pages)
    stamped = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 7919 % 31_536_000)).withColumn("pad", F.repeat(F.md5("url"), 20))
    twice = stamped.union(stamped.filter("page_id % 3 = 0"))
    columns = ["page_id", "listed", "list_entry", "list_category", "listed_from", "active_entries"]
    want = sorted(tuple(map(str, r)) for r in url_lists.evaluate(stamped, changes).select(*columns).collect())
    want = sorted(want + [r for r in want if int(r[0]) % 3 == 0])
    shuffled = twice.repartition(7, "pad").join(spark.range(0, 10**6, 1, 5).withColumnRenamed("id", "page_id"), "page_id")
    assert sorted(tuple(map(str, r)) for r in url_lists.evaluate(shuffled, changes).select(*columns).collect()) == want
    named = url_lists.evaluate(stamped.withColumn("listed", F.lit("x")), changes)
    assert named.columns[-5:] == ["listed_", "list_entry", "list_category", "listed_from", "active_entries"] and named.filter("listed <> 'x'").count() == 0

def test_the_encoder_learns_pieces_in_bounded_calls(monkeypatch):
    import public_tokenizers
    from tallyflow.llm import tokens

    words = [f" w{i}x{i * 7}" for i in range(50)]
    data, at = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0] + [len(w) for w in words])
    whole = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(data, at)
    sizes, enc = [], tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    add = enc._add
    monkeypatch.setattr(tokens, "LEARNED_AT_ONCE", 7)
    monkeypatch.setattr(enc, "_add", lambda pieces: (sizes.append(len(pieces)), add(pieces)))
    got = enc.encode(data, at)
    assert max(sizes) <= 7 and all((a == b).all() for a, b in zip(got, whole))


def test_packing_encodes_in_small_chunks():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(500)])
    texts = [" ".join(rng.choice(words, 2_000)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(500), "text": texts})
    path = public_tokenizers.path("word_bpe_49k.json")
    list(packing.cut(iter([batch.slice(0, 1)]), path, 1, 4096))  # load the encoder
    tracemalloc.start()
    rows = n_tokens = 0
    for made in packing.cut(iter([batch]), path, 1, 4096):
        rows += len(set(made.column("doc_id").to_pylist()))
        n_tokens += len(made.column("ids").flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 500 and n_tokens > 1_000_000
    assert peak < 60 << 20


def test_search_reads_postings_twice_at_most(monkeypatch):
    """Examples that hardly differ, so that no block can be ruled out: a round for every doubling of blocks was made before."""
    rng = np.random.default_rng(31)
    v, n = 60, 1_500
    model = toxicity.Examples(toxicity.Vocabulary(np.arange(v, dtype=np.uint64)), np.ones(v), k=5)
    vectors = [model.vector(np.arange(v), rng.integers(1, 4, v)) for _ in range(n)]
    model.build(vectors, np.ones(n), np.zeros(n), np.arange(n))
    dense = np.zeros((n, v))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    reads, bincount = [], np.bincount
    monkeypatch.setattr(toxicity.np, "bincount", lambda *a: reads.append(1) or bincount(*a))
    for _ in range(20):
        t, w = model.vector(np.arange(v), rng.integers(1, 4, v))
        reads.clear()
        entries, cosines = model.neighbours(t, w)
        assert len(reads) <= 3  # the bounds, the first blocks, the rest
        full = dense @ w
        assert set(model.example[entries]) == set(np.argsort(-full)[:5]) and np.allclose(cosines, np.sort(full)[::-1][:5])
