"""Language ID by a byte convolutional network in numpy.

Fixed-length windows of a text's UTF-8 bytes go through filters of several widths (on one-hot bytes), max pooling and a
softmax. Training fits the filters on a bounded sample of labelled windows on the driver; each executor scores whole texts
in batches of windows and averages the windows' probabilities by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs

LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: documents of each language (in expectation) and windows of each of these.
DOCS_PER_LANG, WINDOWS_PER_DOC = 500, 6
LETTER = regex.compile(r"\p{L}")
UND = "und"


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, LENGTH) bytes of the whole text, padded with 0, and the bytes that are text in each window."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = raw
    size = np.full(n, LENGTH)
    size[-1] = len(raw) - (n - 1) * LENGTH
    return out.reshape(n, LENGTH), size


class ByteCNN:
    """tables[w]: (w, 256, FILTERS), the filters of width w on one-hot bytes; dense: (len(WIDTHS) * FILTERS, classes)."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.pairs: dict[tuple[int, int], np.ndarray] | None = None

    def prepare(self) -> None:
        """Sums of two neighbouring bytes' weights, so that a filter takes half the look-ups."""
        self.pairs = {(w, j): (self.tables[w][j][:, None] + self.tables[w][j + 1][None]).reshape(65536, FILTERS) for w in WIDTHS for j in range(0, w - 1, 2)}

    def features(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled activations (n, filters of all widths), and the places of the maxima."""
        n, length = x.shape
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled, places = [], []
        for w in WIDTHS:
            m = length - w + 1
            out = np.take(self.pairs[w, 0], two[:, :m], axis=0)
            for j in range(2, w - 1, 2):
                out += np.take(self.pairs[w, j], two[:, j : j + m], axis=0)
            if w % 2:
                out += np.take(self.tables[w][w - 1], x[:, w - 1 :], axis=0)
            if where:
                places.append(out.argmax(axis=1))
            pooled.append(out.max(axis=1))
        return np.concatenate(pooled, axis=1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)))
        for at in range(0, len(x), 128):
            z = np.tanh(self.features(x[at : at + 128])[0]) @ self.dense + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 128] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the mean cross entropy, classes weighted to count alike."""
        rng = np.random.default_rng(seed)
        weight = len(y) / (len(self.classes) * np.maximum(np.bincount(y, minlength=len(self.classes)), 1))
        params = [*self.tables.values(), self.dense, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                xb, yb = x[i], y[i]
                self.prepare()
                f, places = self.features(xb, True)
                h = np.tanh(f)
                z = h @ self.dense + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                g = (p * weight[yb][:, None] / len(yb)).astype(np.float32)
                back = (g @ self.dense.T) * (1 - h * h)
                grads = []
                for k, w in enumerate(WIDTHS):
                    gt, gf = np.zeros_like(self.tables[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(gt[j], (np.take_along_axis(xb, places[k] + j, axis=1), np.arange(FILTERS)[None]), gf)
                    grads.append(gt)
                t += 1
                for q, grad, a, b in zip(params, [*grads, h.T @ g, g.sum(axis=0)], m, v):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        self.prepare()


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, windows: int = WINDOWS_PER_DOC) -> ByteCNN | None:
    """A network fitted on rows of df with a text and a language; None if there are none.

    About docs_per_lang rows of each language, by the hash of their key, send up to `windows` windows each, spread over the whole text."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string"), F.lit(9)).alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    bar = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, docs_per_lang / n) * 2**32))) for k, n in sorted(counts.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, raw = [], [], []
            for k, h, t in zip(*[c.to_pylist() for c in batch.columns]):
                x, size = windows_of(t)
                x = x[size >= min(LENGTH // 2, size[0])]
                if LETTER.search(t):
                    for i in np.unique(np.linspace(0, len(x) - 1, windows).astype(int)):
                        langs.append(k), hashes.append(h), raw.append(x[i].tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(raw, pa.binary())], ["lang", "h", "w"])

    sample = rows.filter(F.pmod("h", F.lit(2**32)) < bar).select("lang", "h", "text").mapInArrow(run, "lang string, h long, w binary")
    got = sorted((r["lang"], r["h"], bytes(r["w"])) for r in sample.collect())
    if not got:
        return None
    classes = sorted({k for k, _, _ in got})
    net = ByteCNN(classes)
    net.fit(np.frombuffer(b"".join(w for _, _, w in got), np.uint8).reshape(-1, LENGTH), np.array([classes.index(k) for k, _, _ in got]))
    return net


def predict(df: DataFrame, net: ByteCNN | None, text: str = "text", key: str = "doc_id", extra: Column | None = None) -> DataFrame:
    """Rows of key, extra, lang_pred, score. A text that is null or has no letter, or no network, gives `und` with score 0. Columns of df other than key and text are not read; an empty table gives an empty
    result."""
    extra = F.lit(None).cast("boolean") if extra is None else extra
    weights = None if net is None else (net.classes, net.tables, net.dense, net.bias)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if weights:
            own = ByteCNN(weights[0])
            own.classes, own.tables, own.dense, own.bias = weights
            own.prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                langs, scores = [UND] * part.num_rows, [0.0] * part.num_rows
                todo = [(i, *windows_of(t)) for i, t in enumerate(part.column(2).to_pylist()) if own and t and LETTER.search(t)]
                if todo:
                    p = own.probabilities(np.concatenate([x for _, x, _ in todo])) * np.concatenate([s for _, _, s in todo])[:, None]
                    starts = np.cumsum([0] + [len(x) for _, x, _ in todo[:-1]])
                    p = np.add.reduceat(p, starts, axis=0)
                    p /= p.sum(axis=1, keepdims=True)
                    for (i, _, _), best, row in zip(todo, p.argmax(axis=1), p):
                        langs[i], scores[i] = own.classes[best], float(min(1.0, row[best]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "extra", "lang_pred", "score"])

    rows = df.select(F.col(key).alias("key"), extra.alias("extra"), F.col(text))
    return rows.mapInArrow(run, f"key {kind}, extra boolean, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir)
    net = train(df.filter(~held_out()))
    return predict(df, net, extra=held_out()).withColumnRenamed("extra", "held_out").select("doc_id", "held_out", "lang_pred", "score")
