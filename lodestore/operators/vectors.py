"""Exact cosine search over vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.session import ship

#: Queries of one broadcast block of a batch search.
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def same_dimension(vector: Column, dimension: int) -> Column:
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.lit(f"a vector hasn't {dimension} components")))


def search(index: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(file_id, score): the ``k`` rows of ``index(file_id, vector)`` of the largest cosine, ties to the smaller id.

    Zero vectors are skipped, a zero query or k = 0 finds nothing. Only the k best of each task move.
    """
    if k <= 0 or not any(query):
        return index.limit(0).select("file_id", F.lit(0.0).alias("score"))
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = index.select("file_id", cosine(same_dimension(F.col("vector"), len(query)), asked).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "file_id").limit(k)


def search_batch(index: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, file_id, score) for ``queries(query_id, vector)``: a matrix product per block of queries.

    Queries are taken in blocks of bounded size; each task returns k rows per query, which a window merges.
    """
    spark = ship(index.sparkSession)
    n = queries.count()
    blocks = max(1, -(-n // block))
    found = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("vector").cast("array<double>")).collect()
        ids = [r["query_id"] for r in own]
        asked = np.array([r["vector"] for r in own], dtype=np.float64).reshape(len(own), -1)
        size = np.sqrt((asked * asked).sum(axis=1))
        usable = size > 0
        shared = spark.sparkContext.broadcast((np.array(ids)[usable], asked[usable] / size[usable, None]))

        def run(batches, shared=shared):
            qids, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(qids):
                    continue
                names = np.array(batch.column(0).to_pylist())
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), q.shape[1])
                length = np.sqrt((x * x).sum(axis=1))
                names, x = names[length > 0], x[length > 0] / length[length > 0, None]
                score = q @ x.T
                keep = min(k, score.shape[1])
                if not keep:
                    continue
                # all that reach a query's k-th score, in its order; of equal ones the smaller ids
                least = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
                i, j = np.nonzero(score >= least[:, None])
                order = np.lexsort((names[j], -score[i, j], i))
                i, j = i[order], j[order]
                chosen = np.arange(len(i)) - np.searchsorted(i, i) < keep
                i, j = i[chosen], j[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(names[j]), pa.array(score[i, j])], names=["query_id", "file_id", "score"])

        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, file_id {index.schema['file_id'].dataType.simpleString()}, score double"
        part = index.select("file_id", F.col("vector").cast("array<double>")).mapInArrow(run, kind)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "file_id", "score")


def attach(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """``vectors(file_id, space_id, vector)`` with the ``file_ord`` of the first file of that id; an id that ``files(file_id,
    file_ord)`` doesn't have is an error when the rows are read. Vectors may repeat; a null id is missing."""
    first = files.groupBy("file_id").agg(F.min("file_ord").alias("file_ord"))
    missing = F.raise_error(F.concat(F.lit("no file "), F.coalesce("file_id", F.lit("without an id"))))
    found = vectors.join(first, "file_id", "left")
    return found.select("file_id", F.when(F.col("file_ord").isNotNull(), F.col("file_ord")).otherwise(missing).alias("file_ord"), "space_id", "vector")


def to_json(index: DataFrame) -> DataFrame:
    """(json) one line per vector: a JSON index that reads back without holding the whole of it anywhere."""
    return index.select(F.to_json(F.struct("file_id", "vector")).alias("json"))


def from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", "file_id string, vector array<float>", {"mode": "FAILFAST"}).alias("x")).select("x.*")
