"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine >= c are at a squared distance of at most 2 - 2c. After one rotation that all share, the coordinates are split
into blocks; in one block at least, a pair of links keeps within that block's proportional share of the distance. Each block's
range join orders the vectors by the block's leading coordinate, packs them to bins of bounded size and meets only bins whose
intervals are within the block's radius; pairs of the bins within the budget over the whole block are verified exactly. A pair counts in the first block that
finds it, so links are counted once without gathering pairs.

A bin is one row, kept once in the shared folder. The join of bins with bins reads these rows where they are, so that nothing is shuffled for a pair of bins;
blocks are joined one after the other, and the bins of one are removed before those of the next are made. Disk so grows with the vectors, and only work with the pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, durable, made, released, stored, tidy
from .components import components

BLOCKS, BIN, TILE, SEED, SLACK = 4, 4096, 1024, 11, 1e-9
#: Distances and cosines within BAND of their bound are decided pair by pair, PAIRS at a time.
BAND, PAIRS = 1e-10, 1 << 16
#: Bytes of a bin's vectors in double precision, and of the vectors in a task's part of the bins; parts that a small table has at most; bins that a task keeps unpacked.
BIN_BYTES, PART_BYTES, PARTS, HELD = 8 << 20, 16 << 20, 8, 8


@functools.lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, blocks: int = BLOCKS) -> list[int]:
    n = min(blocks, dim)
    return [dim * i // n for i in range(n + 1)]


def precision(df: DataFrame, vec: str) -> str:
    """NumPy's name of the precision that holds the vectors as they are."""
    return "<f4" if df.schema[vec].dataType.simpleString() == "array<float>" else "<f8"


def units(raw: bytes, dim: int, code: str) -> np.ndarray:
    """Unit vectors of a bin; each the same bits in whatever bin it is."""
    x = np.frombuffer(raw, code).reshape(-1, dim).astype(np.float64)
    y = x / np.abs(x).max(1)[:, None]  # no overflow or underflow of the norm
    return y / np.sqrt((y * y).sum(1))[:, None]


def prepared(df: DataFrame, vec: str, key: str, blocks: int) -> DataFrame:
    """Rows of key, digest and dim (null: not to be linked), vector as bytes in its own precision, and the blocks' leading coordinates."""
    code = precision(df, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, dims, raws, leads = [], [], [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                if not len(x) or not np.isfinite(x).all() or top == 0:
                    digests.append(None), dims.append(None), raws.append(None), leads.append(None)
                    continue
                y = x / top  # no overflow or underflow of the norm
                r = y / np.sqrt(y @ y) @ rotation_of(len(y))
                x += 0.0
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest()), dims.append(len(x)), raws.append(x.astype(code).tobytes()), leads.append([float(r[c]) for c in cuts(len(x), blocks)[:-1]])
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(leads, pa.list_(pa.float64()))], ["key", "digest", "dim", "vec", "lead"])

    held: dict[int, np.ndarray] = {}

    def rotation_of(n: int) -> np.ndarray:
        if n not in held:
            held[n] = rotation(n)
        return held[n]

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vec).mapInArrow(run, f"key {kind}, digest binary, dim int, vec binary, lead array<double>")


def bins(groups: DataFrame, block: int, whole: float, blocks: int, n: int, size: int) -> DataFrame:
    """The block's bins, a row each: dim, bin, lo and hi (interval of the leading coordinate), reach (up to where the next bins meet it), keys, counts and vectors.

    groups: n rows with vectors of size bytes in all."""
    each = groups.filter(F.size("lead") > block).select("dim", F.col("lead")[block].alias("x"), "key", "n", "vec")
    parts = max(1, math.ceil(size / PART_BYTES), min(PARTS, math.ceil(n / BIN)))
    order = each.repartitionByRange(parts, "dim", "x", "key").sortWithinPartitions("dim", "x", "key").coalesce(parts)
    kind = groups.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, rows, dim, room = TaskContext.get().partitionId(), 0, [], 0, 0, 0

        def emit() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x, c, ends = t["x"].to_numpy(), cuts(dim, blocks), pa.array([0, t.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, t[name].combine_chunks()) for name in ("key", "n")]
            reach = x.max() + math.sqrt((whole + SLACK) * (c[block + 1] - c[block]) / dim) + SLACK
            one = [pa.array([dim], pa.int32()), pa.array([(part << 32) + made], pa.int64()), *[pa.array([float(v)]) for v in (x.min(), x.max(), reach)], *lists, pa.array([b"".join(t["vec"].to_pylist())], pa.binary())]
            return pa.record_batch(one, ["dim", "bin", "lo", "hi", "reach", "keys", "counts", "vecs"])

        for batch in batches:
            dims, at = batch.column(0).to_numpy(), 0
            while at < len(dims):
                if held and (dims[at] != dim or rows >= room):
                    yield emit()
                    held, rows, made = [], 0, made + 1
                dim = int(dims[at])
                room = max(1, min(BIN, BIN_BYTES // (8 * dim)))
                end = min(at + room - rows, at + int(np.argmax(np.append(dims[at:] != dim, True))))
                held.append(batch.slice(at, end - at))
                rows, at = rows + end - at, end
        if held:
            yield emit()

    return durable(order.mapInArrow(run, f"dim int, bin long, lo double, hi double, reach double, keys array<{kind}>, counts array<long>, vecs binary"))


def linked(placed: DataFrame, block: int, cosine: float, blocks: int, code: str) -> DataFrame:
    """(key, n_links, root): what each pair of the block's bins adds to a vector's links, and a vector that it is joined with there."""
    whole = 2 - 2 * cosine
    other = placed.select([F.col(c).alias("r_" + c) for c in placed.columns]).hint("shuffle_replicate_nl")  # parts are read again for each other part; nothing is shuffled
    meets = (F.col("dim") == F.col("r_dim")) & (F.col("bin") <= F.col("r_bin")) & (F.col("r_lo") <= F.col("reach")) & (F.col("lo") <= F.col("r_reach"))
    rows = placed.join(other, meets).select("dim", "bin", "r_bin", "keys", "r_keys", "counts", "r_counts", "vecs", "r_vecs")
    kind = placed.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple] = OrderedDict()

        def opened(name: int, dim: int, raw: bytes) -> tuple:
            """Unit vectors, and single-precision rows whose products with each other's turned rows are the block's squared distances times -1/2."""
            if name not in held:
                c, u = cuts(dim, blocks), units(raw, dim, code)
                z = u @ rotation(dim)[:, c[block] : c[block + 1]]
                half, one = (z * z).sum(1)[:, None] / -2, np.ones((len(z), 1))
                held[name] = u, np.hstack([z, half, one]).astype(np.float32), np.hstack([z, one, half]).astype(np.float32)
            held.move_to_end(name)
            while len(held) > HELD:
                held.popitem(last=False)
            return held[name]

        for batch in batches:
            cols = [batch.column(i) for i in range(9)]
            for k in range(batch.num_rows):
                dim, p, q = (cols[i][k].as_py() for i in range(3))
                sides = [(p, 3, 5, 7)] if p == q else [(p, 3, 5, 7), (q, 4, 6, 8)]
                keys = pa.concat_arrays([cols[i][k].values for _, i, _, _ in sides])
                n = np.concatenate([cols[i][k].values.to_numpy() for _, _, i, _ in sides])
                got = pairs(dim, n, [opened(name, dim, cols[i][k].as_buffer()) for name, _, _, i in sides])
                if got:
                    some, links, roots = got
                    yield pa.record_batch([keys.take(pa.array(some)), pa.array(links), keys.take(pa.array(roots))], ["key", "n_links", "root"])

    def pairs(dim: int, n: np.ndarray, sides: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Vectors with links, their links and roots; the vectors of both bins are counted through."""
        turn, c = rotation(dim), cuts(dim, blocks)
        budget = [(whole + SLACK) * (c[i + 1] - c[i]) / dim for i in range(len(c) - 1)]
        alone, first, total = len(sides) == 1, len(sides[0][0]), len(n)  # alone: a bin with itself
        u = sides[0][0] if alone else np.concatenate([x[0] for x in sides])
        left, right = sides[0][1], sides[-1][2]
        # rounding of a distance in single precision is less than 4e-7 for each coordinate
        least = np.float32(-(budget[block] + BAND + 4e-7 * (c[block + 1] - c[block] + 8)) / 2)
        links, parent = np.zeros(total, np.int64), np.arange(total)
        turned: list[np.ndarray] = []

        def z() -> np.ndarray:
            if not turned:
                turned.append(np.stack([x @ turn for x in u]))  # a row at a time: the same bits in every pair of bins
            return turned[0]

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def gaps(k: int, a: slice, b: slice) -> np.ndarray:
            x, y = z()[a, c[k] : c[k + 1]], z()[b, c[k] : c[k + 1]]
            return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)

        def linked_here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether pairs are links and this is their first block within budget; decides alike in whatever bins and order a pair comes."""
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), PAIRS):
                s = slice(at, at + PAIRS)
                ok = (u[i[s]] * u[j[s]]).sum(1) >= cosine
                if ok.any():
                    d = (z()[i[s]] - z()[j[s]]) ** 2
                    for k in range(block + 1):
                        near = d[:, c[k] : c[k + 1]].sum(1) <= budget[k]
                        ok &= near if k == block else ~near
                keep[s] = ok
            return keep

        for a0 in range(0, first, TILE):
            a = slice(a0, min(a0 + TILE, first))
            for b0 in range(a0 if alone else first, total, TILE):
                b = slice(b0, min(b0 + TILE, total))
                base = 0 if alone else first
                hit = left[a] @ right[b.start - base : b.stop - base].T >= least
                if alone and a0 == b0:
                    hit &= np.triu(np.ones(hit.shape, bool), 1)
                some = np.count_nonzero(hit)
                if not some:
                    continue
                sure = np.zeros_like(hit)
                if some > 0.02 * hit.size:  # dense: all of the tile at once, but for what is too close to call
                    own = gaps(block, a, b) - budget[block]
                    over = u[a] @ u[b].T - cosine
                    hit &= (own <= BAND) & (over >= -BAND)
                    sure = hit & (own < -BAND) & (over > BAND)
                    for k in range(block):
                        away = gaps(k, a, b) - budget[k]
                        hit &= away >= -BAND
                        sure &= away > BAND
                i, j = np.nonzero(hit & ~sure)
                keep = linked_here(i + a0, j + b0)
                i, j = (np.concatenate([x, y[keep]]) for x, y in zip(np.nonzero(sure), (i, j)))
                if not len(i):
                    continue
                i, j = i + a.start, j + b.start
                links += np.bincount(i, weights=n[j], minlength=total).astype(np.int64) + np.bincount(j, weights=n[i], minlength=total).astype(np.int64)
                # joins: of each vector only its first partner and, of each partner, its first vector are new for sure
                while len(i):
                    roots = np.array([find(k) for k in np.unique(np.concatenate([i, j]))])
                    at = dict(zip(np.unique(np.concatenate([i, j])).tolist(), roots.tolist()))
                    ri, rj = np.fromiter(map(at.__getitem__, i.tolist()), np.int64, len(i)), np.fromiter(map(at.__getitem__, j.tolist()), np.int64, len(j))
                    open_ = ri != rj
                    i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
                    if not len(i):
                        break
                    _, one = np.unique(ri, return_index=True)
                    for k in one:
                        p, q = find(int(ri[k])), find(int(rj[k]))
                        if p != q:
                            parent[max(p, q)] = min(p, q)
        some = np.flatnonzero(links)
        return (some, links[some], np.array([find(int(k)) for k in some], np.int64)) if len(some) else None

    return rows.mapInArrow(run, f"key {kind}, n_links long, root {kind}")


def embedding_dedup(df: DataFrame, vec: str = "embedding", key: str = "vec_id", cosine: float = 0.9, blocks: int = BLOCKS) -> DataFrame:
    """A row for each row of df: key, n_links, component_id, kept.

    Equal vectors are one group with its count; vectors of different dimensions are never linked. A vector that is null, empty or zero or
    has null or non-finite components has no links. Other columns of df are not read. Repeated rows are vectors of their own with a link to each other. An
    empty table gives an empty result."""
    spark, since, code = df.sparkSession, made(), precision(df, vec)
    whole = stored(prepared(df, vec, key, blocks))
    groups = stored(whole.filter("digest is not null").groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("lead").alias("lead")))
    rows = durable(whole.select("key", "digest"))
    released(spark, since)  # all but groups
    tidy(spark)  # lets go of the shuffled vectors, here and after each block
    n, size = groups.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0))).first()
    found = []
    for block in range(blocks):
        placed = bins(groups, block, 2 - 2 * cosine, blocks, n, size)
        found.append(durable(linked(placed, block, cosine, blocks, code)))
        dropped(placed)
        del placed
        tidy(spark)
    names = stored(groups.select("digest", "key", "n"))
    released(spark, since)  # all but names
    found = functools.reduce(DataFrame.unionByName, found)
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("key").agg(F.sum("n_links").alias("more"))
    told = names.join(sums, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    told = told.select("digest", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component_id")).filter("n_links > 0 or component_id is null")
    out = rows.select("key", "digest").join(told, "digest", "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"), (F.col("key") == F.coalesce("component_id", "key")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
