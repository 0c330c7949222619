"""Token ids in binary blocks, each document compressed on its own with one shared dictionary.

Layout of a store (a folder of Parquet tables, so that any store Spark writes
to will do and a lost task leaves nothing half written):

* ``dictionary``: one row, ``hash, bytes``: a zstandard dictionary trained on
  serialised id arrays of a bounded sample, and its sha256;
* ``blocks``: ``shard, block, first_id, last_id, dictionary_hash, payload`` and the
  index of the payload: ``doc_ids, offsets, counts, starts`` (ids before each
  document in its shard);
* ``shards``: ``shard, start``: ids before the shard; one row per shard.

Documents are in ascending ``doc_id`` order through blocks and shards. One
document is read by its block's id range and its offset alone.

Defined results: null text is an empty document (its end id only); null
``doc_id`` comes first; repeated ids and rows stay, ordered by their text; texts
of any length are encoded whole; an empty table gives an empty store; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekernel as K
from .common import ship
from .encoding import PieceEncoder

#: Documents and bytes at most in a block (a longer document has its own).
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
#: The dictionary is trained on about so many documents, on so many characters of each.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_SIZE = 1000, 4000, 64 * 1024
LEVEL = 3


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or none (empty) where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(bytes_: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(bytes_) if bytes_ else None


def _compressor(bytes_: bytes):
    import zstandard

    d = _dictionary(bytes_)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d else zstandard.ZstdCompressor(level=LEVEL)


def _decompressor(bytes_: bytes):
    import zstandard

    d = _dictionary(bytes_)
    return zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, partitions: int | None = None) -> None:
    """Encode every whole text and write the store under ``path`` (in a folder all executors share)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    share = min(1.0, DICTIONARY_DOCS / max(total, 1))
    # A stretch from anywhere in the text; it shapes the dictionary, which changes sizes and no results.
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - DICTIONARY_CHARS, F.lit(1))) + 1
    drawn = rows.select(F.substring(F.col("text"), begin.cast("int"), F.lit(DICTIONARY_CHARS)).alias("text")).sample(False, share, 5).limit(2 * DICTIONARY_DOCS)

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer, spaced)
        for batch in K.trimmed(batches):
            out = []
            for ids, count in encoder.encode(batch.column(0)):
                out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in drawn.mapInArrow(serialised, "ids binary").collect()]
    words = train_dictionary(samples)
    digest = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(digest, bytearray(words))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(words)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = PieceEncoder.of(tokenizer, spaced), _compressor(shared.value)
        end = np.array([end_id], np.uint32)
        state = {"start": 0, "block": 0}
        doc_ids, offsets, counts, starts, payload = [], [0], [], [], bytearray()

        def block() -> pa.RecordBatch:
            columns = [
                pa.array([state["block"]], pa.int64()),
                pa.array([doc_ids[0]], pa.int64()),
                pa.array([doc_ids[-1]], pa.int64()),
                pa.array([digest]),
                pa.array([bytes(payload)], pa.binary()),
                *[pa.array([list(x)], pa.list_(pa.int64())) for x in (doc_ids, offsets, counts, starts)],
            ]
            state["block"] += 1
            for x in (doc_ids, counts, starts, payload):
                x.clear()
            offsets[:] = [0]
            return pa.RecordBatch.from_arrays(columns, names=["block", "first_id", "last_id", "dictionary_hash", "payload", "doc_ids", "offsets", "counts", "starts"])

        for batch in K.trimmed(batches):
            names, at = batch.column(0).to_pylist(), 0
            for ids, count in encoder.encode(batch.column(1)):
                for x in np.split(ids, np.cumsum(count)[:-1]):
                    one = np.concatenate([x, end])
                    frame = press.compress(one.astype("<u4").tobytes())
                    if doc_ids and (len(doc_ids) == BLOCK_DOCS or len(payload) + len(frame) > BLOCK_BYTES):
                        yield block()
                    doc_ids.append(names[at])
                    payload.extend(frame)
                    offsets.append(len(payload))
                    counts.append(len(one))
                    starts.append(state["start"])
                    state["start"] += len(one)
                    at += 1
        if doc_ids:
            yield block()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Spark samples the range keys to the driver, so only the head of a text is one; it sorts as the text does, and texts are kept whole.
    head = F.substring("text", 1, 64)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), head).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = "block long, first_id long, last_id long, dictionary_hash string, payload binary, doc_ids array<long>, offsets array<long>, counts array<long>, starts array<long>"
    ordered.mapInArrow(blocks, schema).select(F.spark_partition_id().alias("shard"), "*").write.parquet(f"{path}/blocks")
    # One row per shard; the running sum over them is small whatever the documents are.
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.max(F.element_at("starts", -1) + F.element_at("counts", -1)).alias("ids"))
    at, starts = 0, []
    for r in sizes.orderBy("shard").collect():
        starts.append((r["shard"], at))
        at += r["ids"]
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/shards")


def _load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    words = bytes(row["bytes"])
    if hashlib.sha256(words).hexdigest() != row["hash"]:
        raise ValueError("the dictionary is damaged")
    return row["hash"], words


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document, from the files alone."""
    ship(spark)
    digest, words = _load_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(words)
    shards = spark.read.parquet(f"{path}/shards")
    blocks = spark.read.parquet(f"{path}/blocks").join(shards, "shard").select("start", "dictionary_hash", "payload", "doc_ids", "offsets", "counts", "starts")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _decompressor(shared.value)
        for batch in K.trimmed(batches):
            for r in range(batch.num_rows):
                if batch.column(1)[r].as_py() != digest:
                    raise ValueError("a block names another dictionary")
                base, payload = batch.column(0)[r].as_py(), batch.column(2)[r].as_buffer()
                doc_ids, offsets, counts, starts = (batch.column(k)[r].values for k in range(3, 7))
                off, view = offsets.to_numpy(), memoryview(payload)
                frames = [press.decompress(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                out = [doc_ids, pa.array(starts.to_numpy() + base), counts, pa.array([zlib.crc32(x) for x in frames], pa.int64())]
                if [len(x) // 4 for x in frames] != counts.to_pylist():
                    raise ValueError("a document has another length than its index says")
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts.to_numpy())]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(frames), "<i4"))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(decode, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id, reading only the blocks whose range holds it."""
    _, words = _load_dictionary(spark, path)
    press, out = _decompressor(words), []
    for r in spark.read.parquet(f"{path}/blocks").where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))).orderBy("shard", "block").collect():
        for k, x in enumerate(r["doc_ids"]):
            if x == doc_id:
                out.append(np.frombuffer(press.decompress(bytes(r["payload"][r["offsets"][k] : r["offsets"][k + 1]])), "<u4").tolist())
    return out
