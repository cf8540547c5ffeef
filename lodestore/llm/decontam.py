"""Benchmark decontamination over a stored positional inverted index of the training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestore.llm.shared import small_batches, stash, without
from lodestore.llm.tokens import ALNUM, alnum_words, text_buffers, word_hashes

#: Benchmark text that one broadcast block holds at most; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 2 << 20

_INDEX = "segment string, doc_ids array<long>, bounds binary, terms binary, starts binary, postings binary"
_FOUND = "segment string, row int, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<long>"


class Segment:
    """The index of one run of documents: for each term its ascending word positions, counted over the whole run."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        self.name, self.doc_ids = row["segment"], row["doc_ids"]
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self._steps = np.frombuffer(unpack(row["postings"]), np.uint32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The places of terms in this segment's dictionary, -1 where absent."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def frequency(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < 0, 0, self.starts[place + 1] - self.starts[place])

    def positions(self, place: int) -> np.ndarray:
        return np.cumsum(self._steps[self.starts[place] : self.starts[place + 1]], dtype=np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1


def _packed(name: str, ids: pa.Array, column: pa.Array) -> dict:
    data, offsets = text_buffers(column)
    hashes, bounds, _ = word_hashes(data, offsets, ALNUM)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    pack = zstandard.ZstdCompressor(level=1).compress
    return {"segment": name, "doc_ids": ids.to_pylist(), "bounds": bounds.tobytes(), "terms": ranked[first].tobytes(), "starts": np.append(first, len(ranked)).astype(np.uint32).tobytes(), "postings": pack(steps.astype(np.uint32).tobytes())}


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    schema = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("postings", pa.binary())])
    for b in batches:
        _, offsets = text_buffers(b.column(1))
        i = 0
        while i < b.num_rows:
            # a segment holds about 4 MB of text, one longer text alone
            j = min(b.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + (4 << 20), side="right")) - 1))
            yield pa.RecordBatch.from_pylist([_packed(f"{part}-{n}", b.column(0).slice(i, j - i), b.column(1).slice(i, j - i))], schema)
            i, n = j, n + 1


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs(doc_id, text)``: a row for each run of documents, all postings of all their words."""
    small_batches(docs.sparkSession)
    return stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexed, _INDEX), "index")


class Phrases:
    """Windows of test items as term rows, grouped by length."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        owners: dict[tuple, set[int]] = {}
        for item, text in items:
            words = alnum_words((text or "").encode())
            size = min(width, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                owners.setdefault(tuple(words[k : k + size]), set()).add(item)
        vocabulary = {w: i for i, w in enumerate(sorted({w for p in owners for w in p}))}
        text = b" ".join(vocabulary)
        self.terms = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)[0]
        self.by_size: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in {len(p) for p in owners}:
            own = [p for p in owners if len(p) == size]
            self.by_size[size] = np.array([[vocabulary[w] for w in p] for p in own]), [sorted(owners[p]) for p in own]


def phrase_hits(seg: Segment, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, list[int]]]:
    """(start positions, length, items) of each phrase that occurs in the segment."""
    place = seg.find(phrases.terms)
    often = seg.frequency(place)
    lists: dict[int, np.ndarray] = {}
    for size, (rows, items) in phrases.by_size.items():
        for k in np.flatnonzero((often[rows] > 0).all(axis=1)):
            row = rows[k]
            at = None
            for off in np.argsort(often[row], kind="stable"):  # the rarest term first
                own = lists.get(row[off])
                if own is None:
                    own = lists[row[off]] = seg.positions(place[row[off]])
                if at is None:
                    at = own - off
                else:
                    near = np.searchsorted(own, at + off)
                    at = at[(near < len(own)) & (own[np.minimum(near, len(own) - 1)] == at + off)]
                if not len(at):
                    break
            at = at[at >= 0]
            at = at[seg.document(at) == seg.document(at + size - 1)]
            if len(at):
                yield at, size, items[k]


def _found(broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = broadcast.value
        for pdf in batches:
            for row in pdf.to_dict("records"):
                seg = Segment(row)
                n = len(seg.doc_ids)
                marked = np.zeros(int(seg.bounds[-1]) + 1, bool)
                pairs: list[set[int]] = [set() for _ in range(n)]
                for at, size, items in phrase_hits(seg, phrases):
                    marked[(at[:, None] + np.arange(size)).ravel()] = True
                    for d in np.unique(seg.document(at)):
                        pairs[d].update(items)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                hit = np.flatnonzero(marked)
                if len(hit):
                    own = seg.document(hit)
                    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(own) > 0)) + 1
                    for run_ in np.split(hit, cut):
                        d = int(seg.document(run_[:1])[0])
                        spans[d].append((int(run_[0] - seg.bounds[d]), int(run_[-1] + 1 - seg.bounds[d])))
                yield pd.DataFrame({"segment": seg.name, "row": np.arange(n, dtype=np.int32), "doc_id": pd.array([None if x is None or x != x else int(x) for x in seg.doc_ids], dtype="Int64"), "n_words": np.diff(seg.bounds), "spans": [[{"start": a, "stop": b} for a, b in s] for s in spans], "items": [sorted(p) for p in pairs]})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of ``docs(doc_id, text)`` against ``benchmark(item_id, text)``.

    Words are runs of [0-9a-z] and of code points from U+0080 after A-Z became a-z. Every run of ``width`` words of an
    item is a phrase (a shorter item is one phrase). ``spans`` are the merged word ranges [start, stop) that occurrences
    cover, ``n_hit`` their words, ``items`` the distinct items found, ascending.

    Null texts have no words. Items without words match nothing; rows with a null item_id are left out; repeated items
    and item_ids count once. Repeated documents each get a row, a null doc_id stays null. An empty benchmark gives
    every document without hits; empty documents give no rows. A very long text is a segment of its own. A benchmark above ``block_bytes`` is searched block by
    block against the same stored index.
    """
    spark = docs.sparkSession
    index = positional_index(docs)
    small_batches(spark, 4)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        phrases = spark.sparkContext.broadcast(Phrases([tuple(x) for x in own], width))
        part = stash(index.mapInPandas(_found(phrases), _FOUND), "found")
        found = part if found is None else found.union(part)
    small_batches(spark)
    if blocks > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("spans", F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) ->
            case when size(acc) > 0 and element_at(acc, -1).stop >= x.start
                 then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop)))
                 else concat(acc, array(x)) end)"""))
    return found.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)").alias("n_hit"), "items", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no hit; rows without a doc_id are kept."""
    return without(docs, contamination(docs, benchmark, width).where("n_hit > 0").select("doc_id"))


def proximity(index: DataFrame, phrases: list[Row] | list[tuple[int, str]], slop: int) -> DataFrame:
    """(doc_id, item_id, start, width): for each document and phrase of ``phrases(item_id, text)`` the first narrowest
    stretch that holds all its distinct words, in any order, if it is at most ``slop`` words longer than their number.

    ``index`` comes from ``positional_index``. Phrases without words match nothing.
    """
    spark = index.sparkSession
    small_batches(spark, 4)
    asked = []
    for item, text in phrases:
        words = sorted(set(alnum_words((text or "").encode())))
        joined = b" ".join(words)
        if words:
            asked.append((int(item), word_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM)[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                seg, out = Segment(row), []
                for item, terms in asked:
                    place = seg.find(terms)
                    if (place < 0).any():
                        continue
                    lists = [seg.positions(p) for p in place]
                    start = np.unique(np.concatenate(lists))
                    end = start.copy()
                    for own in lists:
                        k = np.searchsorted(own, start)
                        end = np.maximum(end, np.where(k < len(own), own[np.minimum(k, len(own) - 1)], 1 << 60))
                    doc, width = seg.document(start), end - start + 1
                    fits = (end < seg.bounds[doc + 1]) & (width <= len(terms) + slop)
                    best: dict[int, tuple[int, int]] = {}
                    for d, w, s in zip(doc[fits], width[fits], start[fits], strict=True):
                        best[d] = min(best.get(d, (1 << 60, 0)), (int(w), int(s - seg.bounds[d])))
                    out += [(seg.doc_ids[d], item, s, w) for d, (w, s) in best.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "width"])

    found = stash(index.mapInPandas(run, "doc_id long, item_id long, start long, width long"), "near-words")
    small_batches(spark)
    return found
