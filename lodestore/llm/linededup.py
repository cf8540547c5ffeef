"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.shared import cell, stash

#: A line on more than this part of a host's pages is boilerplate.
RATIO = 0.02
#: Standard deviations that a line's count of pages is taken lower, as few pages say little: 5 pages count as 0.5, 10 as
#: 3.7, 10,000 as 9,800. It is the same bound for hosts of every size.
DOUBT = 2.0
#: White space beside the line feed.
BLANK = " \t\x0b\x0c\r"


def boilerplate(pages: DataFrame, ratio: float = RATIO, doubt: float = DOUBT) -> DataFrame:
    """(host, h1, h2, n_pages, host_pages): the lines of ``pages(host, text)`` above the ratio, by their two hashes."""
    line = F.explode(F.array_distinct(F.split("text", "\n", -1)))
    lines = pages.select("host", line.alias("line")).where(F.translate("line", BLANK, "") != "")
    counts = lines.select("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")).groupBy("host", "h1", "h2").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("host_pages"))
    sure = F.col("n_pages") - F.lit(doubt) * F.sqrt("n_pages")
    found = counts.where(sure > 0)
    return found.join(totals, found["host"].eqNullSafe(totals["of"])).where(sure > F.lit(ratio) * F.col("host_pages")).drop("of")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, doubt: float = DOUBT, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and the columns ``counts``: lines of the text, and those dropped.

    A page's lines are its text split at U+000A. A line is boilerplate on a host if the host's pages that contain it,
    less ``doubt`` times the root of their number, exceed ``ratio`` of all its pages. Lines of white space are never
    dropped, nor is a carriage return cut off a line. A text of boilerplate alone becomes empty; its row stays. A very long
    text or line is treated like any other: lines are told apart by two hashes.

    A null text stays null, with 0 lines; its page counts for its host. A null host is one host. Repeated rows count as
    pages of their own. An empty table gives no rows. Columns named like ``counts`` are replaced; any
    other may have any name.

    Lines are counted with partial sums, so a hot host meets in no single task. The rows to change are found by joins
    on hashes; whole texts move once at most.
    """
    pages = docs.select(cell(host).alias("host"), "text")
    common = stash(boilerplate(pages, ratio, doubt).select(F.col("host").alias("of"), "h1", "h2"), "boilerplate", compact=True)
    split = F.split("text", "\n", -1)
    lines = pages.select("host", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), F.posexplode(split).alias("pos", "line"))
    lines = lines.select("host", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    hit = lines.join(common, lines["host"].eqNullSafe(common["of"]) & (lines["h1"] == common["h1"]) & (lines["h2"] == common["h2"]), "left_semi")
    # equal texts of a host lose the same lines: copies share one row
    drops = hit.groupBy("host", "t1", "t2").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("host", "of").withColumnRenamed("t1", "d1").withColumnRenamed("t2", "d2")
    own = [c for c in docs.columns if c not in counts]
    keyed = docs.select(F.struct(*map(cell, own)).alias("row"), cell(host).alias("host"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"))
    joined = keyed.join(drops, keyed["host"].eqNullSafe(drops["of"]) & (keyed["t1"] == drops["d1"]) & (keyed["t2"] == drops["d2"]), "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    count = lambda x: F.when(x.isNull(), 0).otherwise(F.size(x))
    cells = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own]
    return joined.select(*cells, count(split).alias(counts[0]), count(F.col("gone")).alias(counts[1]))
