"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore.llm.shared import BROADCAST_IDS, cell, small_batches, stash

#: Documents that one rounding group holds on average.
GROUP_ROWS = 2000
#: A document is taken so often at most.
MOST = 2


def shared_targets(totals: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Targets of all sources: ``share`` times all words by weight, none above ``most`` times its own words.

    Sources take the weights in turn, by code point, null last; what a stopped source leaves is reshared by weight.
    """
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, target = share * sum(totals.values()), list(order), dict.fromkeys(order, 0.0)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * totals[s]]
        for s in full:
            target[s] = float(most * totals[s])
            rest -= target[s]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        free = [s for s in free if s not in set(full)]
    return target


def tilts(sized: DataFrame, totals: dict[str | None, int], targets: dict[str | None, float], most: float = MOST, rounds: int = 60) -> dict[str | None, tuple[float, float]]:
    """(tilt, mean size): the dual solution of each source: rates min(most, exp(tilt * size / mean size)) meet its target.

    These rates are the closest to 1 in relative entropy under the token constraint and the cap; the dual is convex
    and one-dimensional per source. Each Newton round is one distributed sum over ``sized(source, size, n)``; a round
    that leaves the bracket known so far halves it. Infinite tilts stand for rates of ``most`` or 0 throughout.
    """
    spark = sized.sparkSession
    tilt: dict[str | None, float] = {}
    bracket: dict[str | None, list[float]] = {}
    for s, words_ in totals.items():
        if words_ == 0 or targets[s] >= most * words_:
            tilt[s] = math.inf
        elif targets[s] <= 0:
            tilt[s] = -math.inf
        else:
            tilt[s], bracket[s] = 0.0, [-math.inf, math.inf]
    means = {r["source"]: r["mean"] for r in sized.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    # decimals, as a sum of doubles depends on the order of the rows and reruns must agree
    total = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(rounds):
        if not bracket:
            break
        state = _per_source(spark, [(s, float(tilt[s]), float(means[s])) for s in bracket], "of string, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        words = F.col("size") * F.col("n")
        sums = (
            sized.join(state, sized["source"].eqNullSafe(state["of"]))
            .groupBy("source")
            .agg(total(words * F.least(rate, F.lit(float(most)))).alias("got"), total(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for r in sums:
            s, miss = r["source"], r["got"] - targets[r["source"]]
            low_high = bracket[s]
            low_high[miss > 0] = tilt[s]
            if abs(miss) <= 1e-9 * targets[s] or low_high[1] - low_high[0] < 1e-13:
                del bracket[s]
                continue
            step = tilt[s] - miss / r["slope"] if r["slope"] > 0 else math.nan
            low, high = low_high
            if not low < step < high:
                low = low if low > -math.inf else min(2 * tilt[s], tilt[s] - 1)
                high = high if high < math.inf else max(2 * tilt[s], tilt[s] + 1)
                step = (low + high) / 2
            tilt[s] = step
    return {s: (t, means.get(s, 1.0)) for s, t in tilt.items()}


def _rounded(rows: pa.Table) -> pa.Table:
    """Copies of one group: from the longest document on, each takes the neighbour of its rate that keeps the words
    taken so far closest to the words expected so far."""
    order = pc.sort_indices(rows, sort_keys=[("size", "descending"), ("doc_id", "ascending")], null_placement="at_end").to_numpy()
    sizes, rates = rows.column("size").to_numpy()[order], rows.column("rate").to_numpy()[order]
    copies, over = np.zeros(len(order), np.int64), 0.0
    for i, size, rate in zip(order.tolist(), sizes.tolist(), rates.tolist(), strict=True):
        low = math.floor(rate)
        down, up = over + (low - rate) * size, over + (low + 1 - rate) * size
        more = low < rate and abs(up) < abs(down)
        copies[i], over = low + more, up if more else down
    return rows.append_column("copies", pa.array(copies))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for each row of ``docs(doc_id, text, source)``.

    ``size`` counts the runs of characters other than space and U+0009 to U+000D. ``copies`` (0 to ``most``) says how
    often the mix takes the document; the copies of a source hold about ``target`` words.

    A null text has size 0; documents of size 0 get rate and copies of their source like others and take no words. A
    null source is a source of its own, the last. A very long text counts by its words like any other. Repeated rows are documents of their own. An empty table gives no
    rows. One row per source is held on the driver: sources are a dimension of the corpus, not its documents.
    """
    small_batches(docs.sparkSession)
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")), "sizes")
    state = _solved(sized, weights, share, most)
    rated = sized.join(state, sized["source"].eqNullSafe(state["of"])).select("doc_id", "source", "size", "source_size", "target", _rate(most).alias("rate"), _group("doc_id").alias("part"))
    kind = "doc_id long, source string, size long, source_size long, target double, rate double, part long, copies long"
    return rated.groupBy("source", "part").applyInArrow(_rounded, kind).drop("part")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = MOST) -> DataFrame:
    """``docs`` with all its columns and rows, and ``copies``: how often the mix of ``mix_sources`` takes each row.

    A column named copies is replaced; any other may have any name. Whole rows move once, in groups of about GROUP_ROWS
    documents.
    """
    small_batches(docs.sparkSession)
    sized = stash(docs.select("source", word_count("text").alias("size")), "sizes")
    state = _solved(sized, weights, share, most)
    own = [c for c in docs.columns if c != "copies"]
    rows = docs.select(F.struct(*map(cell, own)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    rated = rows.join(state, rows["source"].eqNullSafe(state["of"])).select("row", "doc_id", "source", "size", _rate(most).alias("rate"), _group("doc_id").alias("part"))
    kind = T.StructType([*rated.schema.fields, T.StructField("copies", T.LongType())])
    return rated.groupBy("source", "part").applyInArrow(_rounded, kind).select("row.*", "copies")


def _per_source(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """One row a source, to be broadcast: the documents' side of a join with it never moves, unless there are very many."""
    made = spark.createDataFrame(rows, kind)
    return F.broadcast(made) if len(rows) <= BROADCAST_IDS else made


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rate(most: float) -> Column:
    tilted = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return F.when(F.col("tilt") == math.inf, float(most)).when(F.col("tilt") == -math.inf, 0.0).otherwise(tilted)


def _group(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, "size"), F.col("groups"))


def _solved(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(of, source_size, target, tilt, mean, groups) of each source of ``sized(source, size)``."""
    counts = stash(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts", compact=True)
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("docs")).collect()
    totals = {r["source"]: r["total"] for r in per_source}
    targets = shared_targets(totals, weights, share, most)
    solved = tilts(counts, totals, targets, most)
    table = [(r["source"], r["total"], targets[r["source"]], *map(float, solved[r["source"]]), -(-r["docs"] // GROUP_ROWS)) for r in per_source]
    return _per_source(sized.sparkSession, table, "of string, source_size long, target double, tilt double, mean double, groups long")
