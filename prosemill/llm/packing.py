"""Packing along a space-filling curve.

Each document's token ids are hashed into a count vector, projected to a few dimensions and given a Hilbert key. In
the order of (key, row), all documents form one stream, cut every `size` tokens: neighbours on the curve share sequences, and only the last
sequence of the whole corpus can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import docs, durable, small, stored
from .encoding import WordEncoder

VOCAB, EOS, SIZE = "word_bpe_49k.json", 2, 4096
BUCKETS, DIMS, BITS, SEED = 64, 4, 12, 20240


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indexes of integer points (n, dims), each below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= np.where(high, 0, t) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents by their token ids."""
    if not ids:
        return np.zeros(0, np.int64)
    counts = np.stack([np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26), minlength=BUCKETS) for x in ids]).astype(np.float64)
    counts /= np.maximum(np.linalg.norm(counts, axis=1), 1)[:, None]
    flat = (counts - 1 / np.sqrt(BUCKETS)) @ np.random.default_rng(SEED).normal(size=(BUCKETS, DIMS)) / np.sqrt(DIMS)
    return hilbert_keys(np.clip((flat + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def encoded(df: DataFrame, text: str = "text", key: str = "doc_id", vocab: str = VOCAB, eos: int | None = EOS) -> DataFrame:
    """Rows of key, curve (long), n_tokens and ids (binary, little-endian, of 2 or 4 bytes each), ids ending with eos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocab)
        width, end = encoder.dtype.itemsize, b"" if eos is None else np.array([eos], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [x + end for x in encoder.ids([t or "" for t in part.column(1).to_pylist()])]
                curve = curve_keys([np.frombuffer(x, encoder.dtype) for x in ids])
                yield pa.record_batch([part.column(0), pa.array(curve, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["key", "curve", "n_tokens", "width", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, curve long, n_tokens long, width int, ids binary")


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", vocab: str = VOCAB, eos: int | None = EOS, size: int = SIZE) -> DataFrame:
    """Pieces: key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text is an empty one and has the end id alone. Repeated rows and keys are packed each by itself. An empty table gives no pieces."""
    tokens = stored(encoded(df, text, key, vocab, eos).withColumn("row", F.monotonically_increasing_id()))
    order = durable(tokens.select("row", "curve", "n_tokens").filter("n_tokens > 0").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row").withColumn("part", F.spark_partition_id()))
    sums = order.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = small(durable(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("curve", "row")) - F.col("n_tokens")
    placed = order.withColumn("at", inside).join(parts, "part").select("row", (F.col("at") + F.col("base")).alias("at"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k, at, width, blob in zip(*[batch.column(c).to_pylist() for c in ("key", "at", "width", "ids")]):
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                lo = 0
                while lo < len(ids):
                    seq, offset = divmod(at + lo, size)
                    n = min(size - offset, len(ids) - lo)
                    rows.append((k, lo, n, ids[lo : lo + n].tobytes(), len(ids), seq, offset))
                    lo, held = lo + n, held + 4 * n
                    if held > 4 << 20:
                        yield emit(rows)
                        rows, held = [], 0
            if rows:
                yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    joined = tokens.select("row", "key", "width", "ids").join(placed, "row").drop("row")
    return joined.mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(docs(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
