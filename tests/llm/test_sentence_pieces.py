"""Merge rounds against the sentencepiece library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from tallyflow.llm import sentence_pieces
from tallyflow.llm.text import text_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.codec(PATH)


def check(codec, lib, texts):
    ids, at = codec.encode(*text_bytes(pa.array(texts, pa.string())))
    back, ends = codec.decode(ids, at)
    for i, text in enumerate(texts):
        want = lib.encode(text or "")
        assert ids[at[i]:at[i + 1]].tolist() == want, repr(text)[:200]
        assert back[ends[i]:ends[i + 1]].tobytes().decode() == lib.decode(want)


def test_odd_texts(codec, lib):
    check(codec, lib, [None, "", " ", "  ", "a", "▁", "▁▁x", "a▁ ▁b", " a  b   c ", "\n\n\t\0x", "<s></s><0x0A><unk>", "漢字かな 😀😀 é", "́", "�", "É" * 3,
                       "\r\n line\x0b\x0c", "�\U0010ffff", "tokens urbinitial" * 20, "no space" + " " + "here"])


def test_random_texts(codec, lib):
    rng = random.Random(3)
    check(codec, lib, ["".join(rng.choice("abcdefg tionesr  \n.,'é漢😀▁") for _ in range(rng.randrange(200))) for _ in range(800)])
    pieces = [p for p in codec.ids if len(p) > 1]
    check(codec, lib, ["".join(rng.choice(pieces).replace("▁", rng.choice(["", " "])) for _ in range(rng.randrange(30))) for _ in range(1500)])


def test_runs_whose_merges_depend_on_their_order(codec, lib):
    rng = random.Random(4)
    check(codec, lib, [" " * i for i in range(80)] + ["=" * i for i in range(80)] + ["ab" * i + "a" for i in range(60)]
          + ["".join(rng.choice("ab") for _ in range(rng.randrange(300))) for _ in range(200)])
    assert codec.alone.any()


def test_long_units_take_the_heap(codec, lib):
    rng = random.Random(5)
    texts = [" " * 5000, "ab" * 4000, "x" * 20000] + ["".join(rng.choice("etaoinshrdlu") for _ in range(4000)) for _ in range(4)]
    check(codec, lib, texts)


def test_rounds_and_heap_agree(codec):
    rng = random.Random(6)
    text = "".join(rng.choice("etaoinshrdlu ") for _ in range(1500))
    symbols = codec.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    first = np.zeros(symbols.size, bool)
    first[0] = True
    got = codec.merge(symbols.copy(), first)
    assert [(i, int(got[i])) for i in np.flatnonzero(got >= 0)] == codec._merge_long(symbols.tolist())


def test_forgetting_units_changes_nothing(codec, lib, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    check(codec, lib, ["one two three", "two three four"])
    check(codec, lib, ["five one", "two"])
    codec.clear()


def test_decoding_any_ids(codec, lib):
    rng = np.random.default_rng(2)
    rows = [[], [0], [1, 2], [28705], [28705, 28705], [1, 28705, 264], [3 + 0xE3, 300], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 264], [3 + 0xE6, 3 + 0xBC, 264], [3 + 0xED, 3 + 0xA0, 3 + 0x80],
            [3 + 0x0A, 264], [2, 3 + 0xF0, 3 + 0x9F, 3 + 0x98, 3 + 0x80]]
    rows += [rng.integers(0, rng.choice([300, 32000]), rng.integers(0, 12)).tolist() for _ in range(300)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data, ends = codec.decode(np.array([i for r in rows for i in r], np.int64), at)
    for i, r in enumerate(rows):
        assert data[ends[i]:ends[i + 1]].tobytes().decode() == lib.decode(r), r


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sentence_pieces._check(b"")


def test_tables(spark, odd, none, lib):
    texts = {r["doc_id"]: [] for r in odd.collect()}
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    want = sorted((str(i), len(ids := lib.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
                  for i, ts in texts.items() for t in ts)
    got = sentence_pieces.round_trips(odd, PATH)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert sentence_pieces.round_trips(none, PATH).collect() == []
    back = sentence_pieces.decode(sentence_pieces.encode(odd, PATH), PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), t) for i, ts in texts.items() for t in ts)
    renamed = odd.withColumnRenamed("doc_id", "ids_sha256")
    assert sentence_pieces.encode(renamed, PATH, doc_id="ids_sha256").count() == odd.count()


def test_a_text_longer_than_a_chunk(spark, lib):
    text = " ".join(f"word{i} 漢{i}" for i in range(400_000))
    assert len(text.encode()) > sentence_pieces.CHUNK_BYTES
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_pieces.round_trips(df, PATH).collect()}
    assert got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, lib.encode(text))).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
