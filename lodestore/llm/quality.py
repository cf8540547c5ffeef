"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.shared import held_out, small_batches
from lodestore.llm.tokens import text_buffers

#: Labelled documents that training takes at most, over both classes.
SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_WEIGHT = 120, 4, 0.1, 64, 1.0, 5.0

STATISTICS = (
    "bytes", "words", "mean_word", "spread_word", "longest_word", "distinct_words", "top_word", "same_as_last", "distinct_pairs",
    "lines", "mean_line", "distinct_lines", "short_lines", "upper", "digits", "spaces", "above_ascii", "controls",
    "sentence_ends", "commas", "bars", "marks", "exclaims", "other_punctuation", "capital_words", "bare_words", "byte_entropy", "ends_closed",
)

_END = bytes(b".,;:!?\"')")


def statistics(text: bytes, counts: np.ndarray) -> list[float]:
    """The STATISTICS of one text; ``counts`` are those of its 256 byte values."""
    n = max(len(text), 1)
    share = counts / n
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    seen = share[share > 0]
    marks = share[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()
    punctuation = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(often) / m, (max(often.values()) if often else 0) / m, same / m, pairs / m,
        np.log1p(len(lines)), np.log1p(sizes.mean()), len(set(lines)) / len(lines), (sizes < 30).mean(), share[65:91].sum(), share[48:58].sum(), share[32], share[128:].sum(), share[:32].sum() - share[10],
        share[46] + share[63], share[44], share[124], marks, share[33], punctuation, sum(w[:1].isupper() for w in words) / m, sum(w.isalpha() for w in words) / m, -(seen * np.log2(seen)).sum(), float(text.rstrip()[-1:] in _END and len(text) > 0),
    ]


def table(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text of a column; a null is an empty text."""
    data, offsets = text_buffers(column)
    raw = data.tobytes()
    rows = [statistics(raw[a:b], np.bincount(data[a:b], minlength=256)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(STATISTICS))


@dataclass
class Trees:
    """Full binary trees as arrays: at node i go to 2i+1, or to 2i+2 if the feature is above the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for the logistic loss, grown level by level on histograms of at most BINS quantile bins."""
    total = weight.sum()
    share = float((weight * y).sum() / total) if total else 0.5
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    inner = 2**DEPTH - 1
    if not len(x) or share in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            node = at - first
            gain, best = np.zeros(n), np.full((n, 2), -1)
            for j, c in enumerate(cuts):
                key = node * BINS + binned[:, j]
                gs = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                got = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                got[(hs < LEAST_WEIGHT * 0.25) | (ht - hs < LEAST_WEIGHT * 0.25)] = 0
                got[:, len(c) :] = 0
                k = got.argmax(axis=1)
                value = got[np.arange(n), k]
                better = value > gain + 1e-12
                gain[better] = value[better]
                best[better] = np.stack([np.full(n, j), k], axis=1)[better]
            for i in range(n):
                if best[i, 0] >= 0:
                    feature[first + i], threshold[first + i] = best[i, 0], cuts[best[i, 0]][best[i, 1]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        where = at - inner
        leaf = -RATE * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + RIDGE)
        margin += leaf[where]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = table(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees taught by at most ``sample`` labelled documents outside the held-out fold, by the hash of doc_id."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # bounded by the sample's size, so this side may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(_measured, "y int, x array<double>").collect()
    rows = sorted((r["y"], tuple(r["x"])) for r in rows)
    x, y = np.array([r[1] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r[0] for r in rows], float)
    return boost(x, y, np.ones(len(y)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text)``; ``labels(doc_id, quality)`` teach the trees.

    The score is the chance of label 1 given the statistics of the whole text. Null and empty texts have the statistics
    of an empty text. Labels with nulls, without a document or of the held-out fold teach nothing; of repeated labels
    the largest counts. Without labels every score is 0.5, with one class it is next to that class. Repeated rows are
    scored alike, a null doc_id stays null, an empty table gives no rows.
    """
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.value.score(table(b.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
