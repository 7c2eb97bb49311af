"""Token counts by offset-mapped attribution.

Each document is encoded once, whole. Its tokens' character spans are joined to the spans of its fields or sections as intervals; a token
that crosses a boundary goes whole to the section with most of its characters, of equal ones to the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import docs
from .encoding import SpanEncoder

VOCAB = "byte_bpe_50k.json"


def line_ends(text: str) -> np.ndarray:
    """Ends of the sections that are lines, each with its line feed."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(spans: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; sections tile the text up to `ends`."""
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.minimum(np.searchsorted(ends, start, "right"), len(ends) - 1)
    last = np.minimum(np.searchsorted(ends, end - 1, "right"), len(ends) - 1)
    own, cross = first.copy(), np.flatnonzero(first != last)
    for i in cross:
        k = np.arange(first[i], last[i] + 1)
        low = np.maximum(np.where(k > 0, ends[k - 1], 0), start[i])
        own[i] = k[np.argmax(np.minimum(ends[k], end[i]) - low)]
    n = len(ends)
    return np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n)


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", vocab: str = VOCAB, sections: Callable[[str], np.ndarray] = line_ends) -> DataFrame:
    """A row for each section of each row of df: key, section_id, start, end (code points), n_tokens, n_crossing.

    sections gives the ends of the sections that tile a text. A null or empty text has one empty section without tokens; the sections' tokens add up to the document's. Repeated rows are counted each by itself; an empty table gives an empty result."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, (t, spans) in enumerate(zip(texts, encoder.spans(texts))):
                    ends = sections(t)
                    n, cross = attribute(spans, ends)
                    for c, v in zip(cols, (np.full(len(ends), i), np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, n, cross)):
                        c.append(v)
                row, *rest = [np.concatenate(c) for c in cols]
                yield pa.record_batch([part.column(0).take(pa.array(row)), *[pa.array(c, pa.int64()) for c in rest]], ["key", "section_id", "start", "end", "n_tokens", "n_crossing"])

    out = df.select(key, text).mapInArrow(run, f"key {kind}, section_id long, start long, end long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("key", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(docs(spark, sf_dir))
