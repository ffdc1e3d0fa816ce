"""Token ids of documents in block files with a shared zstandard dictionary.

A token folder holds three tables. ``dictionary``: the trained dictionary, its SHA-256 and the width of an
id. ``blocks``: runs of documents in ascending id; each has the documents' ids, token counts and byte
offsets, and a payload in which every document is a zstandard frame of its own. ``shards``: ids before each
shard. A single document is read by one block's offsets and one frame. All three are written by Spark, so a
repeated task replaces its output and any store that Spark writes to will do.

Defined cases: null text is empty and has the end id only; null document ids sort first; rows with equal
ids stand in the order of their texts' hashes; an empty table gives empty files; with too few texts to
train on, the dictionary is empty and frames stand alone. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyflow.llm.frames import name_of
from tallyflow.llm.text import chunks
from tallyflow.llm.tokens import ENCODE_BYTES, encoder, with_end

BLOCK_BYTES = 1 << 20
BLOCK_DOCUMENTS = 4096


def _dictionary(samples: list[bytes], size: int) -> bytes:
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def _codec(dictionary: bytes, level: int = 3):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write(docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id",
          dictionary_size: int = 32 << 10, training_texts: int = 500) -> None:
    """Write the token folder of ``docs`` to ``path``. The dictionary is trained on the serialised ids of
    about ``training_texts`` documents chosen by a hash of their ids, at most 64 KB of each."""
    spark = docs.sparkSession
    rows = docs.select(F.col(name_of(doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(name_of(text)).cast("string"), F.lit("")).alias("text"))
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    kind = f"<u{width}"

    def serialise(batches):
        for part, data, offsets in chunks(batches, "text", ENCODE_BYTES):
            ids, at = with_end(*encoder(tokenizer).encode(data, offsets), end)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype(kind).tobytes()[:1 << 16] for a, b in zip(at, at[1:])], pa.binary())], names=["b"])

    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, training_texts / max(n, 1))))
    samples = some.select("text").mapInArrow(serialise, "b binary").toArrow()["b"].to_pylist()
    dictionary = _dictionary(samples, dictionary_size)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dictionary, digest, width)], "dictionary binary, dict_hash string, width int").write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)

    def pack(batches):
        from pyspark import TaskContext

        shard, compress = TaskContext.get().partitionId(), _codec(sent.value)[0].compress
        held: list[tuple] = []
        bytes_held, block, before = 0, 0, 0

        def flush():
            nonlocal held, bytes_held, block, before
            sizes = [len(h[2]) for h in held]
            known = [h[0] for h in held if h[0] is not None]
            row = ([shard], [block], [min(known, default=None)], [max(known, default=None)], [before], [[h[0] for h in held]], [[h[1] for h in held]],
                   [np.concatenate([[0], np.cumsum(sizes)]).tolist()], [b"".join(h[2] for h in held)], [digest])
            before, block, held, bytes_held = before + sum(h[1] for h in held), block + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

        for part, data, offsets in chunks(batches, "text", ENCODE_BYTES):
            ids, at = with_end(*encoder(tokenizer).encode(data, offsets), end)
            out = ids.astype(kind)
            for key, a, b in zip(part.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist()):
                frame = compress(out[a:b].tobytes())
                held.append((key, b - a, frame))
                bytes_held += len(frame)
                if bytes_held >= BLOCK_BYTES or len(held) >= BLOCK_DOCUMENTS:
                    yield flush()
        if held:
            yield flush()

    names = ["shard", "block", "first_doc", "last_doc", "start", "doc_ids", "n_tokens", "offsets", "payload", "dict_hash"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(pack, "shard int, block int, first_doc long, last_doc long, start long, doc_ids array<long>, "
                                      "n_tokens array<long>, offsets array<long>, payload binary, dict_hash string")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    # one row per shard: as many as the writer had tasks
    totals = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("shard", before.alias("before"), "n").write.parquet(f"{path}/shards")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    return dictionary, row["dict_hash"], row["width"]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a token folder; start counts the ids
    of all documents before. Every frame is decompressed; a block written with another dictionary is refused."""
    dictionary, digest, width = _opened(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "before")
    if shards.count() <= 200_000:  # 16 bytes each
        shards = F.broadcast(shards)
    rows = blocks.join(shards, "shard").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "n_tokens", "offsets", "payload", "dict_hash")
    sent = spark.sparkContext.broadcast(dictionary)

    def unpack(batches):
        decompress = _codec(sent.value)[1].decompress
        for batch in batches:
            for i in range(batch.num_rows):
                start, keys, sizes, at, payload, used = (batch.column(j)[i].as_py() for j in range(6))
                if used != digest:
                    raise ValueError("a block was written with another dictionary")
                ids = [np.frombuffer(decompress(payload[a:b]), f"<u{width}").astype("<u4") for a, b in zip(at, at[1:])]
                if [x.size for x in ids] != sizes:
                    raise ValueError("token counts differ from the index")
                out = [pa.array(keys, pa.int64()), pa.array(start + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)), pa.array(sizes, pa.int64()),
                       pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(out)])

    return rows.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id), from the blocks that can hold it and its frames alone."""
    dictionary, _, width = _opened(spark, path)
    decompress = _codec(dictionary)[1].decompress
    held = (spark.read.parquet(f"{path}/blocks").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
            .select("shard", "block", F.posexplode("doc_ids").alias("i", "doc_id"), "offsets", "payload").filter(F.col("doc_id") == doc_id)
            .select("shard", "block", "i", F.expr("substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))").alias("frame"))
            .orderBy("shard", "block", "i"))
    return [np.frombuffer(decompress(bytes(r["frame"])), f"<u{width}").tolist() for r in held.collect()]
