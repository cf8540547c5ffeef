"""MinHash near-duplicates: minima, banding, signature and full-set verification, components by two stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.components import components
from lodestore.llm.shared import small_batches, stash, without
from lodestore.llm.tokens import NONSPACE, hashed_texts, mix, shingles

#: 32 bands of 4 minima: a pair of similarity 0.8 meets in no band once in 20 million times.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Words of a shingle where a caller doesn't say otherwise.
SHINGLE = 5
#: A pair whose signatures agree in fewer places than this is below similarity 0.8 but for one case in 10 million.
LEAST_AGREEING = int(0.6 * HASHES)
#: Nodes of one side of a group that compares what the components leave open.
BLOCK = 128

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_SIGNED = "doc_id long, n_shingles long, node long, sig binary"


def _signature(items: np.ndarray) -> np.ndarray:
    """Minima of HASHES multiply-shift functions (universal over 64-bit items)."""
    low = np.full(HASHES, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(items), 1024):
        low = np.minimum(low, ((items[i : i + 1024, None] * _A + _B) >> _U(32)).astype(np.uint32).min(axis=0))
    return low


def _node(items: np.ndarray) -> np.uint64:
    """A 64-bit name of a set of shingles."""
    return mix(np.add.reduce(mix(items + _U(1)), keepdims=True) + _U(len(items)))[0]


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            count, node = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            sig: list[bytes | None] = [None] * n
            for row, words in hashed_texts(b.column(1), NONSPACE):
                items = np.unique(shingles(words, size))
                if len(items):
                    count[row] = len(items)
                    node[row] = _node(items)
                    sig[row] = _signature(items).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(node.view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "node", "sig"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), 1))
        for r in range(ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + sigs[:, :, r])
        node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, out = np.zeros(b.num_rows, np.uint64), [None] * b.num_rows
            for row, words in hashed_texts(b.column(1), NONSPACE):
                items = np.unique(shingles(words, size))
                if len(items):
                    node[row], out[row] = _node(items), items.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(out, pa.binary())], names=["node", "items"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures agree often enough."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for k in (2, 3))
        keep = pa.array((x == y).sum(axis=1) >= LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links, by signature first and then on the full sets."""
    sized = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su"), F.col("n_shingles").alias("nu")), "u")
    sized = sized.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv"), F.col("n_shingles").alias("nv")), "v")
    near = sized.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)").select("u", "v", "su", "sv").mapInArrow(_agreeing, "u long, v long")
    full = near.join(sets.select(F.col("node").alias("u"), F.col("items").alias("iu")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("iv")), "v")
    return full.select("u", "v", "iu", "iv").mapInArrow(_linked(percent), "u long, v long")


def _between(others: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the nodes ``others(main, node, comp)`` and those of their component ``main`` or of each other.

    Both sides are cut into blocks of about BLOCK nodes; each pair of blocks is one group, which counts shared items by
    an inverted list and returns one link for a node and component at most.
    """
    mains = others.select("main").distinct()
    inside = comp.join(mains, comp["component"] == mains["main"]).select("main", "node", F.col("main").alias("comp"))
    all_ = inside.union(mains.select("main", F.col("main").alias("node"), F.col("main").alias("comp"))).union(others).distinct()
    blocks = lambda n: F.ceil(F.count("*") / BLOCK).cast("int").alias(n)
    shape = others.groupBy("main").agg(blocks("rows")).join(all_.groupBy("main").agg(blocks("cols")), "main")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = others.join(shape, "main").select("main", "node", "comp", F.lit(True).alias("asks"), part("rows").alias("r"), each("cols").alias("c"))
    right = all_.join(shape, "main").select("main", "node", "comp", F.lit(False).alias("asks"), each("rows").alias("r"), part("cols").alias("c"))
    placed = left.union(right).join(sets, "node").select("main", "r", "c", "asks", "node", "comp", "items")

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        nodes, comps = table.column("node").to_numpy(), table.column("comp").to_numpy()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items").combine_chunks()]
        cols = np.flatnonzero(~asks)
        sizes = np.array([len(items[i]) for i in cols])
        every = np.concatenate([items[i] for i in cols]) if len(cols) else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(cols)), sizes)[order]
        found = []
        for i in np.flatnonzero(asks):
            x = items[i]
            lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
            hits = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
            shared = np.bincount(owner[at], minlength=len(cols))
            near = (100 * shared >= percent * (len(x) + sizes - shared)) & (comps[cols] != comps[i])
            _, first = np.unique(comps[cols][near], return_index=True)
            found += [(int(nodes[i]), int(nodes[cols[j]])) for j in np.flatnonzero(near)[first]]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return placed.groupBy("main", "r", "c").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets of ``shingle``-word shingles
    (A-Z lower-cased, words parted by white space; a shorter text is one shingle). A component's id is its smallest
    doc_id. Rows with equal sets are one node, so copies are never paired. In each band's bucket every node is first
    verified against one pivot, another one in each band; what the components so found don't join is then compared
    within the bucket, without a cap, so no pair that meets in a band is lost.

    Null or wordless texts: n_shingles 0, linked with nothing. A null doc_id: its text takes part, it is never a
    component's id unless no doc_id is there, then component_id is null and kept true. Repeated rows are linked by
    their equal texts; each row is returned. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(docs.mapInArrow(_signed(shingle), _SIGNED), "signed")
    filled = signed.where("n_shingles > 0")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = stash(nodes, "nodes", compact=True)

    banded = nodes.select("node", "sig").mapInArrow(_banded, "key long, node long")
    meets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("pivot")).where("n > 1")
    met = stash(banded.join(meets, "key"), "met", compact=True)

    # whole sets only of nodes that meet others, taken from one text each
    meeting = met.select("node").distinct().join(nodes.select("node", F.col("first_id").alias("doc_id")), "node")
    sets = _whole_sets(docs, meeting, shingle)
    tested = stash(met.where("node <> pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct(), "tested", compact=True)
    # whole sets are long rows: few to a batch
    small_batches(spark, 100)
    links = stash(_verified(tested, nodes, sets, percent), "verified", compact=True)

    # buckets of three and more that still hold several components: their other pairs
    comp = components(links)
    left = met.where("n > 2").select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    left = stash(left, "left", compact=True)
    most = left.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("comps > 1")
    others = stash(left.join(most, "key").where("comp <> main").select("main", "node", "comp").distinct(), "others", compact=True)
    more = stash(_between(others, comp, sets, percent), "between", compact=True)
    if more.limit(1).count():
        comp = components(links.union(more))

    comp = stash(comp, "components", compact=True)
    ids = comp.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    joined = comp.join(ids, "component").select("node", "component_id")
    own = nodes.join(joined, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    small_batches(spark)
    out = filled.select("doc_id", "n_shingles", "node").join(own, "node").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _whole_sets(docs: DataFrame, meeting: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the sorted shingle hashes of each meeting node."""
    own = meeting.select("doc_id").where("doc_id is not null").distinct()
    texts = docs.join(own, "doc_id", "left_semi").union(docs.where("doc_id is null"))
    # a text's own node tells the rows of a repeated or missing doc_id apart
    items = texts.mapInArrow(_sets(shingle), "node long, items binary").where("items is not null")
    return stash(items.join(meeting.select("node"), "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "sets", compact=True)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its group's component_id: one document of each group, and all others that
    are linked with nothing. Rows without a doc_id stay."""
    return without(docs, near_duplicates(docs, shingle, percent).where("not kept").select("doc_id"))
