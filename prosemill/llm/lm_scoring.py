"""Language-model scores by stupid backoff over the corpus's own n-grams.

Documents are gathered to blocks of bounded size and stored, so that a block is the same whenever it is read. The n-gram table has a row for
each block and hash bucket: the block's distinct n-grams of that bucket, as gaps of their sorted hashes, and their counts, packed. Grouped by bucket that is the count
table's partition, which sums all blocks' counts; joined back by block, each block's n-grams have their totals, from which the
document's own counts are taken off, so that no document vouches for itself, and the words' scores are summed per document.

A row for each document's n-gram would be the plainest form of these tables, yet one shuffle of the bigrams alone is 2.4 times the input;
packed rows hold the same columns. Empty ones are not sent, so there are never more rows than n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, stored
from .shingles import HASH_BITS, MASK, SPACE, mix, words

ORDER, ALPHA = 2, 0.4
BLOCK_BYTES = 6 << 20


def grams(h: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams ending at each word, for n of 1 to order; 0 where the text starts later."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [mix(h) & MASK]
    for n in range(1, order):
        g = out[-1].copy()
        g[1:] = mix(out[-1][:-1] * np.uint64(31) ^ mix(h[1:] + np.uint64(n))) & MASK if n > 1 else mix(h[:-1] ^ mix(h[1:] + np.uint64(n))) & MASK
        g[place < n] = 0
        out.append(g)
    return out


def own_counts(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each word's n-gram occurs in its own document."""
    out = np.zeros(len(g), np.int64)
    step = 1 << (63 - HASH_BITS)
    for d in range(0, int(doc[-1]) + 1 if len(doc) else 0, step):
        a, b = np.searchsorted(doc, [d, d + step])
        _, back, n = np.unique(((doc[a:b] - d).astype(np.uint64) << np.uint64(HASH_BITS)) | g[a:b], return_inverse=True, return_counts=True)
        out[a:b] = n[back]
    return out


def blocks(df: DataFrame, text: str, key: str, block_bytes: int) -> DataFrame:
    """Stored rows of block, keys, lengths (bytes of each text), n_words and blob (the texts, zstd). A text larger than block_bytes is a block of its own."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        raws: list[bytes] = []
        size = 0

        def emit(names: pa.Array) -> pa.RecordBatch:
            whole = b"".join(raws)
            n = sum(map(_count, raws))
            packed = pa.compress(whole, codec="zstd", asbytes=True)
            lengths = pa.array([list(map(len, raws))], pa.list_(pa.int64()))
            return pa.record_batch([pa.array([(part << 32) + made]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), lengths, pa.array([n]), pa.array([packed], pa.binary())], ["block", "keys", "lengths", "n_words", "blob"])

        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                if raws and size + len(raw) > block_bytes:
                    yield emit(pa.concat_arrays(keys))
                    keys, size, made = [], 0, made + 1
                    raws.clear()
                keys.append(batch.column(0).slice(i, 1))
                raws.append(raw)
                size += len(raw)
        if raws:
            yield emit(pa.concat_arrays(keys))

    return stored(df.select(key, text).mapInArrow(run, f"block long, keys array<{kind}>, lengths array<long>, n_words long, blob binary"))


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    n = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.reshape(-1).view("<u8")


def _count(raw: bytes) -> int:
    """Words of a text."""
    space = SPACE[np.frombuffer(raw, np.uint8)]
    return int((space[:-1] & ~space[1:]).sum() + (not space[0])) if raw else 0


def _texts(blob: bytes, lengths: list[int]) -> list[bytes]:
    whole, ends = pa.decompress(blob, decompressed_size=sum(lengths), codec="zstd", asbytes=True) if sum(lengths) else b"", np.cumsum([0, *lengths]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def score(df: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of df: key, n_words, n_backoff (words scored by less than the longest n-gram they could have) and score, the mean log of the words' scores.

    S(w | context) = c(context w) / c(context) if that n-gram occurs elsewhere, else alpha * S(w | shorter context); a word that occurs nowhere else counts 1 of
    all words. Words are runs of characters other than ASCII white space. A null text or one without words has a score of 0. Repeated rows are documents of their
    own. Other columns of df, whatever their names, are not read. An empty table gives an empty result."""
    kind = df.schema[key].dataType.simpleString()
    dealt = blocks(df, text, key, block_bytes)
    n_buckets, n_words = dealt.agg(F.count("*"), F.sum("n_words")).first()
    n_buckets, n_words = max(1, n_buckets), n_words or 0
    edges = np.array([(b << HASH_BITS) // n_buckets for b in range(n_buckets)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, blob in zip(*[batch.column(c).to_pylist() for c in ("block", "lengths", "blob")]):
                for n, g in enumerate(grams(*words(_texts(blob, lengths)), order)):
                    u, c = np.unique(g[g != 0] if n else g, return_counts=True)
                    bucket = np.searchsorted(edges, u, "right") - 1
                    at = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = np.append(at[1:], len(u))
                    gaps, c = np.diff(u, prepend=np.uint64(0)), c.astype("<u4")
                    gaps[at] = u[at] - edges[bucket[at]]
                    yield pa.record_batch([pa.array(bucket[at], pa.int64()), pa.array(np.full(len(at), n, np.int32)), pa.array(np.full(len(at), block)), pa.array([_narrow(gaps[a:b]) for a, b in zip(at, ends)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["bucket", "n", "block", "grams", "counts"])

    def total(table: pa.Table) -> pa.Table:
        edge = edges[table["bucket"][0].as_py()]
        parts = [edge + np.cumsum(_wide(x, len(c) // 4), dtype=np.uint64) for x, c in zip(table["grams"].to_pylist(), table["counts"].to_pylist())]
        ends = np.cumsum([len(p) for p in parts])
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        sums = np.bincount(back, weights=np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")).astype("<i8")[back]
        return pa.table({"block": table["block"], "n": table["n"], "bucket": table["bucket"], "totals": pa.array([sums[a:e].tobytes() for a, e in zip([0, *ends[:-1]], ends)], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left["keys"].combine_chunks().values
        h, counts = words(_texts(left["blob"][0].as_py(), left["lengths"][0].as_py()))
        right = right.sort_by([("n", "ascending"), ("bucket", "ascending")])
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        tables = []
        for n, g in enumerate(grams(h, counts, order)):
            u, inverse = np.unique(g[g != 0] if n else g, return_inverse=True)
            totals = np.frombuffer(b"".join(right.filter(pa.compute.equal(right["n"], n))["totals"].to_pylist()), "<i8") if len(u) else np.zeros(0, np.int64)
            c = np.zeros(len(h), np.int64)
            c[(g != 0) if n else np.ones(len(h), bool)] = totals[inverse]
            tables.append(c - own_counts(g, doc))
        value, done, back = np.zeros(len(h)), np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        longest = np.minimum(place, order - 1)
        for n in range(order - 1, 0, -1):
            context = np.concatenate([[0], tables[n - 1][:-1]])
            ok = ~done & (longest >= n) & (tables[n] > 0) & (context > 0)
            value[ok] += np.log(tables[n][ok] / context[ok])
            done |= ok
            miss = ~done & (longest >= n)
            value[miss] += math.log(alpha)
            back += miss & (longest == n)
        rest = np.maximum(1, n_words - np.repeat(counts, counts))
        value[~done] += np.log(np.maximum(tables[0], 1) / rest)[~done]
        sums, backs = np.bincount(doc, weights=value, minlength=len(counts)), np.bincount(doc, weights=back, minlength=len(counts))
        return pa.table({"key": keys, "n_words": pa.array(counts.astype(np.int64)), "n_backoff": pa.array(backs.astype(np.int64)), "score": pa.array(sums / np.maximum(counts, 1))})

    table = dealt.select("block", "lengths", "blob").mapInArrow(send, "bucket long, n int, block long, grams binary, counts binary")
    counted = table.groupBy("bucket", "n").applyInArrow(total, "block long, n int, bucket long, totals binary")
    out = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(finish, f"key {kind}, n_words long, n_backoff long, score double")
    return out.withColumnRenamed("key", key)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(docs(spark, sf_dir)).withColumn("score", F.round("score", 6))


OP4_SQL = f"""
WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
b AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
u AS (SELECT w, count(*) AS c FROM w GROUP BY 1), ud AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY 1, 2),
g AS (SELECT p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY 1, 2), gd AS (SELECT doc_id, p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS c FROM w), nd AS (SELECT doc_id, len(ws) AS c FROM l),
s AS (SELECT b.doc_id, b.p IS NOT NULL AND g.c - gd.c > 0 AND up.c - upd.c > 0 AS hit, b.p IS NULL AS start, (g.c - gd.c) / (up.c - upd.c) AS ratio,
    greatest(u.c - ud.c, 1) / greatest((SELECT c FROM n) - nd.c, 1) AS uni
  FROM b JOIN u USING (w) JOIN ud ON ud.doc_id = b.doc_id AND ud.w = b.w JOIN nd ON nd.doc_id = b.doc_id
  LEFT JOIN g ON g.p = b.p AND g.w = b.w LEFT JOIN gd ON gd.doc_id = b.doc_id AND gd.p = b.p AND gd.w = b.w
  LEFT JOIN u up ON up.w = b.p LEFT JOIN ud upd ON upd.doc_id = b.doc_id AND upd.w = b.p),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT start AND NOT hit) AS n_backoff, sum(CASE WHEN hit THEN ln(ratio) WHEN start THEN ln(uni) ELSE ln({ALPHA}) + ln(uni) END) AS v FROM s GROUP BY 1)
SELECT l.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(v / n_words, 0.0), 6) AS score FROM l LEFT JOIN t USING (doc_id)
"""
