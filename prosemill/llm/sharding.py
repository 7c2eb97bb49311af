"""Extendible hashing into shards under a byte limit; DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash: 32 bits of the key's and 28 of the text's. It grows from a
histogram by hash prefix, never from the rows: only buckets over the limit take another bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import docs, durable, small, stored

BITS, STEP = 60, 6
SHARD_BYTES = 8 << 20


def _hash(key: Column, text: Column) -> Column:
    part = lambda c, n: F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, n), 16, 10).cast("long")
    return F.shiftleft(part(key, 8), 28).bitwiseOR(part(text, 7))


def shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of df's key and the columns to carry with n_bytes, depth, prefix (the hash's first `depth` bits), page and shard.

    No shard holds more than `limit` bytes unless it is one row larger than that, which stays alone. A null text has 0 bytes, a null key
    hashes as an empty one. Rows alike in key and text can't be parted by bits; they go to numbered overflow pages of one bucket. An
    empty table gives an empty result."""
    rows = durable(df.select(*carry, F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), _hash(F.col(key), F.col(text)).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + STEP)
    done, open_rows, low = None, rows, 0
    leaves: list[DataFrame] = []
    while True:
        cell = F.shiftright("h", BITS - deep)
        cells = durable(open_rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        depths = F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth")
        prefix = F.expr(f"shiftright(cell, {deep} - depth)")
        each = cells.select("cell", "b", "n", depths).withColumn("prefix", prefix)
        fits = each.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).filter((F.col("b") <= limit) | (F.col("n") == 1)).select("depth", "prefix")
        leaf = durable(each.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth")))
        leaves.append(small(leaf).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)")) if deep else leaf.withColumn("prefix", F.lit(0).cast("long")))
        put = open_rows.withColumn("cell", cell).join(leaves[-1], "cell", "left").drop("cell")
        placed = put.filter(F.col("depth").isNotNull()).withColumn("page", F.lit(0).cast("long"))
        done = placed if done is None else done.unionByName(placed)
        if leaf.count() == cells.count():
            break
        open_rows = durable(put.filter(F.col("depth").isNull()).drop("depth", "prefix"))
        if deep == BITS:
            done = done.unionByName(_pages(open_rows, limit))
            break
        low, deep = deep + 1, min(BITS, deep + STEP)
    return done.select(*carry, key, "n_bytes", "depth", "prefix", "page", F.concat_ws("-", "depth", F.lpad(F.conv(F.col("prefix").cast("string"), 10, 16), 15, "0"), "page").alias("shard"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash on pages of the limit: counted by partition first, so that no task orders a whole group."""
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("h", "part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("m"))
    w = Window.partitionBy("h")
    before = sizes.select("h", "part", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("m").over(w), F.lit(1)))).alias("room"))
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("at")) - 1
    page = F.floor((F.col("before") + F.col("nth")) / F.col("room")).cast("long")
    return rows.withColumn("nth", nth).join(before, ["h", "part"]).withColumn("page", page).withColumn("depth", F.lit(BITS)).withColumn("prefix", F.col("h")).drop("at", "part", "nth", "before", "room")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """df written as Parquet folders shard=..., each within the limit, with its columns (but one named shard). Rows of equal key and text, which pages part, are told apart by their row."""
    names = [c for c in df.columns if c.lower() != "shard"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = stored(df.select(row, F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text")))
    put = shards(rows, "key", "text", limit, ("uid",)).select("uid", "shard")
    rows.select("row", "uid").join(put, "uid").select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(docs(spark, sf_dir))


OP3_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT << 28) | ('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT) AS h FROM documents),
s AS (SELECT d.depth, h >> ({BITS} - d.depth) AS prefix FROM r, (SELECT unnest(range(0, 33))::INTEGER AS depth) d GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
m AS (SELECT r.doc_id, r.n_bytes, r.h, min(s.depth) AS depth FROM r JOIN s ON s.prefix = r.h >> ({BITS} - s.depth) GROUP BY 1, 2, 3)
SELECT doc_id, n_bytes, depth, h >> ({BITS} - depth) AS prefix, 0::BIGINT AS page, depth || '-' || lpad(upper(to_hex(h >> ({BITS} - depth))), 15, '0') || '-0' AS shard FROM m
"""
