"""URL filters by a temporal list join: list entries become validity intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: List intervals up to this number are broadcast; a longer list is joined by shuffling both sides.
BROADCAST_ROWS = 100_000

# A dated list of host patterns. An entry holds for a host and all hosts under it from its date on, until
# the pattern's next entry: "block" and "allow" decide, "drop" takes the pattern off the list.
LIST = (
    ("example.net", "allow", "2024-01-01"),
    ("tionsh.example.net", "block", "2024-03-10"),
    ("tionsh.example.net", "drop", "2024-06-01"),
    ("tionsh.example.net", "block", "2024-09-15"),
    ("ththan.example.net", "block", "2024-01-01"),
    ("ththan.example.net", "drop", "2024-02-01"),
    ("m.ththat.example.net", "block", "2024-05-05"),
    ("ththed.example.net", "block", "2024-02-20"),
    ("m.ththed.example.net", "allow", "2024-04-01"),
    ("example.com", "block", "2024-11-01"),
    ("tionble.example.com", "block", "2024-02-15"),
    ("blog.tionble.example.com", "allow", "2024-07-01"),
    ("blog.tionble.example.com", "drop", "2024-10-01"),
    ("ththon.example.com", "block", "2023-06-01"),
    ("m.tiontion.example.com", "block", "2024-08-08"),
    ("example.org", "block", "2024-12-01"),
    ("ththth.example.org", "block", "2024-04-04"),
    ("blog.ththre.example.org", "allow", "2024-01-15"),
    ("m.thther.example.org", "block", "2024-01-20"),
    ("m.thther.example.org", "drop", "2024-01-25"),
    ("m.thther.example.org", "block", "2025-01-01"),
)


def list_table(spark, entries=LIST) -> DataFrame:
    """The list as (pattern, action, since)."""
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("action", T.StringType()), T.StructField("day", T.StringType())])
    return spark.createDataFrame(list(entries), schema).select("pattern", "action", F.to_timestamp("day").alias("since"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): how long each entry of ``entries(pattern, action, since)`` holds.

    An entry holds up to the pattern's next one, the last for ever (null). Of entries of one moment the last by action
    holds ("drop" after "block" after "allow"). Entries with nulls are left out; "drop" leaves none of its own.
    """
    usable = entries.where("pattern is not null and action is not null and since is not null")
    at_once = usable.groupBy(F.lower("pattern").alias("pattern"), "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return at_once.withColumn("until", until).where("action <> 'drop'").select("pattern", "action", "since", "until")


def host_of(url: Column) -> Column:
    """The lower-cased host of an http or https URL without user, port and a closing dot; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.regexp_replace(host, r"\.$", "")


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, host, fetched, pattern, action, since, blocked) for each row of ``captures(page_id, url, fetched)``.

    Of the list entries active at ``fetched`` (since <= fetched < until) for the host or a parent domain, the one with
    the longest pattern decides; ``blocked`` says if its action is "block". Without one, pattern, action and since are
    null and blocked is false.

    A null or hostless URL, or a null fetch time, meets no entry. Repeated captures each get a row. An empty list blocks
    nothing, empty captures give no rows. Other columns are ignored.

    Captures are joined by the host's suffixes, an equality, so no pair is built that doesn't share a pattern. A capture
    is put together again by one row per distinct (host, fetch time), which also keeps a hot host from growing.
    """
    spark = captures.sparkSession
    own = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("timestamp").alias("fetched"))
    moments = own.where("host <> '' and fetched is not null").select("host", "fetched").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = moments.select("host", "fetched", F.explode(suffixes).alias("suffix"))
    held = intervals(entries)
    short = held.limit(broadcast_rows + 1).count() <= broadcast_rows
    held = F.broadcast(held) if short else held
    active = (F.col("suffix") == F.col("pattern")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    rule = F.struct("pattern", "action", "since")
    decided = asked.join(held, active).groupBy("host", "fetched").agg(F.max_by(rule, F.length("pattern")).alias("rule"))
    decided = decided.select(F.col("host").alias("h"), F.col("fetched").alias("f"), "rule")
    out = own.join(decided, (F.col("host") == F.col("h")) & (F.col("fetched") == F.col("f")), "left")
    return out.select("page_id", "host", "fetched", "rule.pattern", "rule.action", "rule.since", F.coalesce(F.col("rule.action") == "block", F.lit(False)).alias("blocked"))
