"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles of five words weigh their count times an inverse document frequency. Samples are drawn by consistent weighted sampling: each shingle is
dealt to one of SAMPLES bins and the least value of a bin is its sample; a shingle is dealt once each time it comes, in short texts several times. Bands of samples give candidates;
candidates are verified by exact weighted Jaccard similarity of whole texts, and classes are the links' connected components.

The document frequency's weight is damped: only shingles in more than RARE of all rows weigh less, and none less than FLOOR. With plain TF-IDF what
the members of a large group of near copies share would weigh next to nothing, and they would not be found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, compact, docs, durable, small, stored
from .components import components, forest
from .shingles import bags, batched, mix

WORDS, SIMILARITY = 5, 0.8
SAMPLES, ROWS = 100, 5
RARE, FLOOR = 0.005, 0.97
#: Draws dealt to the bins for each text at least; a repeated shingle is dealt for each of its places.
DEALT = 512
#: Members of a bucket up to which pairs of different classes are listed; those of a larger one are compared in tiles of TILE by TILE texts.
PAIRS, TILE, SLICE = 64, 512, 4096
#: Partners of a text that one task compares with it.
SHARE = 2000
CHUNK = 4_000_000


def frequent(df: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, document frequencies, rows): shingles in at least RARE of all rows.

    Chunks send the shingles that reach a sixteenth of RARE (two at least) among their own rows, so a frequency misses RARE / 16 of the rows,
    or one a chunk, at most. No more than the mean number of shingles / RARE can be found, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def emit() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = c >= max(2, RARE / 16 * rows)
            return pa.record_batch([pa.array(np.append(h[keep].astype(np.int64), -1)), pa.array(np.append(c[keep], rows).astype(np.int64))], ["h", "c"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in batched(texts):
                _, h, _ = bags(texts[s], n)
                held.append(h)
                size, rows = size + len(h), rows + s.stop - s.start
                if size > CHUNK:
                    yield emit()
                    held, size, rows = [], 0, 0
        yield emit()

    sums = durable(df.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    rows = next((r["c"] for r in sums.filter("h = -1").collect()), 0)
    got = sums.filter(F.col("h") >= 0).filter(F.col("c") >= F.lit(max(2.0, RARE * rows))).toArrow().sort_by("h")
    return got["h"].to_numpy().astype(np.uint64), got["c"].to_numpy(), rows


class Weights:
    """The weights of shingles by the frequent ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rows: int):
        self.hashes = hashes
        self.idf = np.clip(np.log(max(rows, 1) / np.maximum(counts, 1)) / np.log(1 / RARE), FLOOR, 1.0)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = count.astype(np.float64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            w *= np.where(self.hashes[at] == h, self.idf[at], 1.0)
        return w


def _uniform(x: np.ndarray, k: int) -> np.ndarray:
    return ((mix(x + np.uint64(0xD1342543DE82EF95 * k & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def samples(doc: np.ndarray, h: np.ndarray, count: np.ndarray, idf: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """(n, SAMPLES) sample ids, 0 where a bin is empty; level: by text, 2**level being about its weight.

    A shingle that comes `count` times is as many elements of weight idf, which leaves the weighted Jaccard similarity as it is; each is dealt as often as
    the level says, so that a text that repeats few shingles fills its bins too."""
    times = np.maximum(1, np.minimum(SAMPLES * 8, DEALT >> np.maximum(level, 0)))[doc] * count
    ends = np.cumsum(times)
    out, least = np.zeros(n * SAMPLES, np.uint64), np.full(n * SAMPLES, np.inf)
    for at in range(0, int(ends[-1]) if len(ends) else 0, 1 << 18):
        nth = np.arange(at, min(at + (1 << 18), ends[-1]))
        j = np.searchsorted(ends, nth, "right")
        k = (nth - (ends - times)[j]).astype(np.uint64)
        x = mix(h[j] + k * np.uint64(0x9FB21C651E98DF25))
        key = doc[j] * SAMPLES + (mix(x) >> np.uint64(32)).astype(np.int64) % SAMPLES
        r, c, beta = -np.log(_uniform(x, 1) * _uniform(x, 2)), -np.log(_uniform(x, 3) * _uniform(x, 4)), _uniform(x, 5)
        t = np.floor(np.log(idf[j]) / r + beta)
        a = np.log(c) - r * (t - beta) - r
        np.minimum.at(least, key, a)
        won = a == least[key]
        out[key[won]] = mix(x[won] ^ mix(t[won].astype(np.int64).view(np.uint64))) | np.uint64(1)
    return out.reshape(n, SAMPLES)


def band_keys(s: np.ndarray, level: np.ndarray) -> list[list[int]]:
    """Keys of the bands whose bins are all filled."""
    keys = np.broadcast_to(mix(level.astype(np.uint64) + np.uint64(77))[:, None] + np.arange(SAMPLES // ROWS, dtype=np.uint64)[None], (len(s), SAMPLES // ROWS)).copy()
    full = np.ones(keys.shape, bool)
    parts = s.reshape(len(s), SAMPLES // ROWS, ROWS)
    for k in range(ROWS):
        keys = mix(keys ^ parts[:, :, k]) + np.uint64(k)
        full &= parts[:, :, k] != 0
    keys = keys.view(np.int64)
    return [row[ok].tolist() for row, ok in zip(keys, full)]


def sketches(df: DataFrame, text: str, key: str, weights: Weights, n: int) -> DataFrame:
    """Rows of key, gid (md5 of the text, null if it has no word) and bands.

    A text draws samples at the level of its weight, and also one below if a similar text could be there."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for s in batched(texts):
                m = s.stop - s.start
                doc, h, count = bags(texts[s], n)
                idf = weights.of(h, np.ones(len(h), np.int64))
                whole = np.bincount(doc, weights=idf * count, minlength=m)
                level = np.floor(np.log2(np.maximum(whole, 1e-9))).astype(np.int64)
                bands = band_keys(samples(doc, h, count, idf, level, m), level)
                low = (whole > 0) & (np.floor(np.log2(np.maximum(whole * SIMILARITY, 1e-9) * (1 - 1e-9))) < level)
                if low.any():
                    at = np.flatnonzero(low)
                    place = np.cumsum(low) - 1
                    part = low[doc]
                    for i, more in zip(at, band_keys(samples(place[doc[part]], h[part], count[part], idf[part], level[at] - 1, len(at)), level[at] - 1)):
                        bands[i] = bands[i] + more
                gid = [g if x else None for g, x in zip(batch.column(1).slice(s.start, m).to_pylist(), whole > 0)]
                yield pa.record_batch([batch.column(0).slice(s.start, m), pa.array(gid, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["key", "gid", "bands"])

    return df.select(key, F.md5(text).alias("gid"), text).mapInArrow(run, f"key {kind}, gid string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard similarity reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None

        def bag(t: str) -> tuple[np.ndarray, np.ndarray]:
            _, h, c = bags([t], n)
            return h, weights.of(h, c)

        for batch in batches:
            ok = []
            for a, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "ta", "tb")]):
                if a != held:
                    held, own = a, bag(ta)
                (h, w), (h2, w2) = own, bag(tb)
                if len(h):
                    at = np.minimum(np.searchsorted(h, h2), len(h) - 1)
                    shared = np.minimum(w[at], w2)[h[at] == h2].sum()
                    ok.append(shared >= similarity * (w.sum() + w2.sum() - shared) - 1e-9)
                else:
                    ok.append(False)
            yield pa.record_batch([c.filter(pa.array(ok)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # only the texts of few pairs are dealt out
        ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        texts = texts.join(F.broadcast(ids), "rid", "left_semi")
    # a text with many partners, as the lead of a large bucket, is copied to several tasks, which share its partners
    shares = F.ceil(F.col("count") / SHARE).cast("int").alias("shares")
    hot = durable(pairs.groupBy("a").count().filter(F.col("count") > SHARE).select("a", shares))
    left, right, on = pairs, texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), ["a"]
    if not hot.isEmpty():
        of = F.coalesce("shares", F.lit(1))
        left = left.join(small(hot), "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), of).cast("int")).drop("shares")
        right = right.join(small(hot), "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0), of - 1))).drop("shares")
        on = ["a", "share"]
    with_b = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.join(right, on).select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def tiled(members: DataFrame, texts: DataFrame, weights: Weights, n: int, similarity: float) -> DataFrame:
    """Links (a, b) that join classes within large buckets, from members' bk, rid and cls.

    The members of a bucket outside its largest class are compared with all of its members, exactly and in tiles of bounded size; a tile
    sends links that connect what it links, not all pairs."""
    each = members.groupBy("bk", "cls").agg(F.count("*").alias("k"))
    sizes = each.groupBy("bk").agg(F.sum("k").alias("m"), F.max(F.struct("k", "cls")).alias("top")).filter("m > top.k")
    blocks = lambda c: F.ceil(c / TILE).cast("int")
    sizes = durable(sizes.select("bk", F.col("top.cls").alias("top"), blocks(F.col("m") - F.col("top.k")).alias("np"), blocks(F.col("m")).alias("nq")))
    rows = members.join(small(sizes), "bk")
    of = lambda c, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.col(c)).cast("int")
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = rows.filter("cls != top").select("bk", "rid", "cls", F.lit(0).alias("side"), of("np", 1).alias("p"), to("nq").alias("q"))
    every = rows.select("bk", "rid", "cls", F.lit(1).alias("side"), of("nq", 2).alias("q"), to("np").alias("p"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        rid, cls, first = table["rid"].to_numpy(), table["cls"].to_numpy(), int((table["side"].to_numpy() == 0).sum())
        bag, held = [], table["text"].to_pylist()
        for s in batched(held):
            doc, h, count = bags(held[s], n)
            bag.append((doc + s.start, h, count))
        doc, h, count = (np.concatenate(x) for x in zip(*bag))
        w = weights.of(h, np.ones(len(h), np.int64))
        whole = np.bincount(doc, weights=w * count, minlength=len(held))
        each = np.repeat(np.arange(len(h)), count)  # a shingle that comes twice is two elements
        nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        doc, w = doc[each], w[each]
        _, col = np.unique(mix(h[each] + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_inverse=True)
        left = doc < first
        both = (np.bincount(col[left], minlength=len(col)) > 0) & (np.bincount(col[~left], minlength=len(col)) > 0)
        doc, w, col = (x[both[col]] for x in (doc, w, (np.cumsum(both) - 1)[col]))
        order = np.argsort(col, kind="stable")
        doc, w, col = doc[order], w[order], col[order]
        shared = np.zeros((first, len(held) - first))
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, SLICE):
            d, v, c = (x[slice(*np.searchsorted(col, [at, at + SLICE]))] for x in (doc, w, col))
            x, y, own = np.zeros((first, SLICE)), np.zeros((len(held) - first, SLICE)), d < first
            x[d[own], c[own] - at] = v[own]
            y[d[~own] - first, c[~own] - at] = 1
            shared += x @ y.T
        hit = shared >= similarity * (whole[:first, None] + whole[None, first:] - shared) - 1e-9
        i, j = np.nonzero(hit & (cls[:first, None] != cls[None, first:]))
        _, place = np.unique(cls, return_inverse=True)
        kept = forest(place[i], place[j + first], len(cls))
        return pa.table({"a": pa.array(rid[i[kept]]), "b": pa.array(rid[j[kept] + first])})

    both = few.unionByName(every).join(texts, "rid")
    return compact(durable(both.groupBy("bk", "p", "q").applyInArrow(run, "a long, b long")))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of df: key, gid, class_id (the least key of its class; null only if all of its keys are) and kept (one row of each class).

    Texts are linked if their weighted Jaccard similarity is `similarity` or more; equal texts always. A text of one to four words is one shingle.
    Null texts and texts without words are classes of their own each. Of repeated rows of the least key one is kept. An empty table gives an empty result."""
    least = F.struct(F.col("key").isNull().alias("none"), "key", "uid")  # a null key only where a text has no other
    weights = Weights(*frequent(df, text, n))
    rows = stored(sketches(df, text, key, weights, n).withColumn("uid", F.monotonically_increasing_id()))
    first = durable(rows.filter("gid is not null").groupBy("gid").agg(F.min(least).alias("least"), F.first("bands").alias("bands")).withColumn("rid", F.monotonically_increasing_id()))
    each = first.select("rid", F.explode(F.array_distinct("bands")).alias("bk"))
    signed = F.when(F.col("bk") % 2 == 0, F.col("rid")).otherwise(-F.col("rid") - 1)  # two orders, so that bands differ in whom they compare with
    shared = each.groupBy("bk").agg(F.count("*").alias("m"), F.min(signed).alias("s")).filter("m > 1").select("bk", "m", F.expr("if(s < 0, -s - 1, s)").alias("lead"))
    buckets = compact(durable(each.join(shared, "bk").select("bk", "m", "lead", "rid")))
    need = compact(durable(buckets.select("rid").distinct().join(first.select("rid", "gid", F.col("least.key").alias("key")), "rid")))
    texts = df.select(F.md5(text).alias("gid"), F.col(key).alias("key"), F.col(text).alias("text"))
    need = need.withColumnsRenamed({"gid": "gid_", "key": "key_"})
    texts = stored(texts.join(small(need), (F.col("gid") == F.col("gid_")) & F.col("key").eqNullSafe(F.col("key_"))).groupBy("rid").agg(F.first("text").alias("text")))

    order = lambda p: p.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).filter("a != b").distinct()
    tested = compact(durable(order(buckets.select("rid", F.col("lead").alias("other")))))
    links = compact(durable(verified(tested, texts, weights, n, similarity)))
    joined = durable(components(links))

    def with_class(t: DataFrame, column: str) -> DataFrame:
        c = joined.select(F.col("node").alias(column), F.col("component").alias(f"{column}_c"))
        return t.join(c, column, "left").withColumn(f"{column}_c", F.coalesce(f"{column}_c", column))

    now = compact(durable(with_class(with_class(buckets, "rid"), "lead")))
    few = now.filter(F.col("m") <= PAIRS).select("bk", "rid", "rid_c")
    parts = [links, tiled(compact(durable(now.filter(F.col("m") > PAIRS).select("bk", "rid", F.col("rid_c").alias("cls")))), texts, weights, n, similarity)]
    odd = few.groupBy("bk").agg(F.min("rid_c").alias("lo"), F.max("rid_c").alias("hi")).filter("lo != hi").select("bk")
    few = compact(durable(few.join(odd, "bk", "left_semi")))
    across = few.join(few.select("bk", F.col("rid").alias("other"), F.col("rid_c").alias("other_c")), "bk").filter("rid < other and rid_c != other_c")
    pairs = compact(durable(order(across).join(tested, ["a", "b"], "left_anti")))
    parts.append(durable(verified(pairs, texts, weights, n, similarity)))
    joined = durable(components(reduce(DataFrame.unionByName, parts)))

    member = first.select("gid", "rid", "least").join(joined.withColumnRenamed("node", "rid"), "rid").select("gid", "component", "least")
    heads = member.groupBy("component").agg(F.min("least").alias("head"))
    member = member.join(heads, "component").select("gid", F.col("head").alias("top"))
    copies = rows.filter("gid is not null").groupBy("gid").agg(F.count("*").alias("n"), F.min(least).alias("least")).join(member, "gid", "left").filter("n > 1 or top is not null")
    told = durable(copies.select("gid", F.coalesce("top", "least").alias("top")))
    out = rows.select("key", "gid", "uid").join(told, "gid", "left")
    return out.select(F.col("key").alias(key), "gid", F.coalesce("top.key", "key").alias("class_id"), (F.col("top").isNull() | (F.col("top.uid") == F.col("uid"))).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(docs(spark, sf_dir)).select("doc_id", "class_id", "kept")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that classes() keeps, with their columns."""
    told = classes(df, text, key, n, similarity).filter("gid is not null")
    told = durable(told.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("_k"), F.col("gid").alias("_g")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).filter("not _kept or _n > 1"))
    rows = df.withColumns({"_k": F.coalesce(F.col(key).cast("string"), F.lit("\x00")), "_g": F.md5(text)})
    out = rows.join(small(told.select("_k", "_g")), ["_k", "_g"], "left_anti").select(*df.columns)
    repeated = told.filter("_kept")
    if repeated.isEmpty():
        return out
    twice = rows.join(small(repeated.select("_k", "_g")), ["_k", "_g"]).dropDuplicates(["_k", "_g"])
    return out.unionByName(twice.select(*df.columns))
