"""Toxicity by compression distance: two trained zstandard dictionaries and calibrated thresholds."""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.shared import held_out, small_batches
from lodestore.llm.tokens import alnum_words

#: Labelled documents that training takes at most, and the longest text it takes (bytes).
TOXIC_SAMPLE, ORDINARY_SAMPLE, LONGEST_SAMPLE = 2000, 5000, 1 << 20
#: A term is typical of toxic text if it follows so many different words there and is so much rarer elsewhere.
LEAST_CONTEXTS, CONTRAST = 3, 20
#: zstandard level with an optimal parse: a window's length is then its cheapest cover by the dictionary.
LEVEL = 16
#: Gains (bytes that the toxic dictionary saves on a window) that are counted.
THRESHOLDS = (1, 2, 3, 5)
#: Windows whose gains a worker remembers.
REMEMBERED = 400_000

# Every byte becomes four fixed ones: a window of one short word is then long enough for its compressed length to show
# how it is covered; zstd's headers and its fallback to raw blocks would hide that otherwise.
_WIDE = np.random.Generator(np.random.PCG64(5)).integers(0, 256, (256, 4), dtype=np.uint8)


def widened(window: bytes) -> bytes:
    return _WIDE[np.frombuffer(window, np.uint8)].tobytes()


def _trained(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """A dictionary's bytes and whether it has zstd's header; too few samples make a plain one of their content."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8, False


def _typical(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Terms of toxic texts that recur there in differing contexts (so not in copies of one text) and hardly elsewhere."""
    before: dict[bytes, set[bytes]] = defaultdict(set)
    for text in toxic:
        last = b""
        for w in alnum_words(text):
            before[w].add(last)
            last = w
    often = {w: len(seen) for w, seen in before.items() if len(seen) >= LEAST_CONTEXTS}
    elsewhere = Counter(w for text in ordinary for w in often.keys() & set(alnum_words(text)))
    return {w for w, n in often.items() if n >= CONTRAST * elsewhere[w]}


@dataclass
class Model:
    """Two dictionaries, each with its kind, and the weights of the calibrated score."""

    ordinary: tuple[bytes, bool]
    toxic: tuple[bytes, bool]
    weights: np.ndarray
    window_words: int = 1

    def __post_init__(self):
        self._gains: dict = {}
        self._ready = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights, self.window_words

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights, self.window_words = state
        self.__post_init__()

    @staticmethod
    def _compressor(dictionary: tuple[bytes, bool]) -> zstandard.ZstdCompressor:
        content, full = dictionary
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        own.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=params)

    def gain(self, window: bytes) -> int:
        """Compressed length of a window under the ordinary dictionary minus that under the toxic one."""
        known = self._gains.get(window)
        if known is None:
            if self._ready is None:
                self._ready = self._compressor(self.ordinary).compress, self._compressor(self.toxic).compress
            if len(self._gains) >= REMEMBERED:
                self._gains.clear()
            text = widened(b" " + window + b" ")
            known = self._gains[window] = len(self._ready[0](text)) - len(self._ready[1](text))
        return known

    def features(self, text: bytes) -> list[float]:
        """log(1 + windows at or above each threshold), log(1 + windows), largest gain; all windows of the text count."""
        words, size = alnum_words(text), self.window_words
        if size > 1:
            words = [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        known, gain = self._gains, self.gain
        gains = np.fromiter((known[w] if w in known else gain(w) for w in words), np.int64, len(words))
        most = int(gains.max()) if len(words) else 0
        return [1.0, *(math.log1p(int((gains >= t).sum())) for t in THRESHOLDS), math.log1p(len(words)), min(max(most, 0), 12) / 4]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[tuple[bytes, int]], window_words: int = 1) -> Model:
    """A model of labelled texts: three quarters make the dictionaries, the others calibrate the score."""
    texts = list(dict.fromkeys(texts))
    learn = [x for i, x in enumerate(texts) if i % 4]
    toxic, ordinary = [t for t, y in learn if y], [t for t, y in learn if not y]
    terms = _typical(toxic, ordinary)
    marked = [b" ".join(w for w in alnum_words(t) if w in terms) for t in toxic]
    # a run of words from every so many, over whole texts, as zstd's trainer takes about 100 times a dictionary's size
    runs = sum(len(t) for t in ordinary) // 120 + 1
    every, plain = max(1, runs // 30_000), []
    for t in ordinary:
        words = alnum_words(t)
        plain += [widened(b" " + b" ".join(words[i : i + 20]) + b" ") for i in range(0, len(words), 20 * every)]
    model = Model(
        _trained(plain, 65536),
        _trained([widened(b" " + x + b" ") for x in marked if x], 16384),
        np.zeros(len(THRESHOLDS) + 3),
        window_words,
    )
    rest = [(t, y) for i, (t, y) in enumerate(texts) if i % 4 == 0] or texts
    y = np.array([y for _, y in rest], float)
    if not len(y) or y.min() == y.max():
        # one class or none: its share is all that can be said
        model.weights[0] = -30.0 if not len(y) or y[0] == 0 else 30.0
    else:
        model.weights = fit_logistic(np.array([model.features(t) for t, _ in rest]), y)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], longest: int = LONGEST_SAMPLE) -> DataFrame:
    """(doc_id, text, y) of a bounded sample outside the held-out fold, by the hash of doc_id; a doc_id is 1 if any row
    says so."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = []
    for y, n in sizes.items():
        ids += own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= longest)
    # the ids are bounded by the sample's size, so this side may be broadcast
    return texts.join(F.broadcast(chosen), "doc_id")


def _trained_model(sample: DataFrame, window_words: int) -> Model:
    """The model of a bounded sample, made by one task, so that its texts never reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)
        model = train([(t, y) for _, t, y in sorted(rows)], window_words)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], window_words)


def toxicity(docs: DataFrame, labels: DataFrame, window_words: int = 1) -> DataFrame:
    """(doc_id, score, n_windows) for each row of ``docs(doc_id, text)``; ``labels(doc_id, toxic)`` teach the model.

    Words (runs of [0-9a-z] and code points from U+0080, A-Z lower-cased) are cut into windows of ``window_words``.
    A window's gain is its compressed length under the ordinary dictionary less that under the toxic dictionary. The
    score is the calibrated chance of label 1 given how many windows reach each threshold.

    Null and empty texts have no windows and get the score of a text without toxic windows. Labels without a document,
    with nulls or of the held-out fold teach nothing. Without labels of class 1 every score is next to 0. Repeated rows
    are scored alike; an empty table gives no rows; a very long text is scored whole. At most TOXIC_SAMPLE and
    ORDINARY_SAMPLE texts of LONGEST_SAMPLE bytes or less teach, in one task; of the ordinary ones runs of 20 words at equal
    distances, about 30,000 in all, make the dictionary, and all of the toxic ones' typical terms theirs.
    """
    shared = _shared_model(docs, labels, window_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x)), pa.array(np.rint(np.expm1(x[:, -2])).astype(np.int64))], names=["doc_id", "score", "n_windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_windows long")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns, in one pass without a join."""
    shared, at = _shared_model(docs, labels, 1), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_features(shared.value, b.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _shared_model(docs: DataFrame, labels: DataFrame, window_words: int):
    small_batches(docs.sparkSession)
    model = _trained_model(labelled_sample(docs, labels, "toxic", {1: TOXIC_SAMPLE, 0: ORDINARY_SAMPLE}), window_words)
    return docs.sparkSession.sparkContext.broadcast(model)


def _features(model: Model, column: pa.Array) -> np.ndarray:
    rows = [model.features(t or b"") for t in column.cast(pa.binary()).to_pylist()]
    return np.array(rows, dtype=float).reshape(len(rows), len(model.weights))
