"""Queries op1 to op10 and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.ann import nearest
from lodestore.llm.decontam import contamination
from lodestore.llm.licenses import license_scan
from lodestore.llm.linededup import DOUBT, RATIO, drop_boilerplate
from lodestore.llm.mixing import mix_sources
from lodestore.llm.neardup import near_duplicates
from lodestore.llm.passages import repeated_passages
from lodestore.llm.quality import quality
from lodestore.llm.shared import held_out
from lodestore.llm.toxicity import toxicity
from lodestore.llm.urlfilter import LIST, filter_urls, list_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(_table(spark, sf_dir, "documents"), host="source")
    return out.select("doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages; as the table has no fetch time, page_id deals them out over the days of two years."""
    pages = _table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp '2023-10-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(page_id * 7919, 600) as int), cast(pmod(page_id, 24) as int))")
    out = filter_urls(pages.select("page_id", "url", fetched.alias("fetched")), list_table(spark))
    return out.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "pattern", "action", F.date_format("since", "yyyy-MM-dd").alias("since"), "blocked")


def op4_ann_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents"))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    added = F.transform("matches", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, added)).alias("labels"), score.alias("score"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with passages that others have too; all others give no row."""
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_dup_words", F.size("spans").cast("long").alias("n_spans"), F.array_distinct(F.transform("spans", lambda x: x["other"])).alias("others"), "copy_of")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_ann_collision_counting": op4_ann_collision_counting,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PARTS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_LINES = f"""with d as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
p as (select source, line, count(*) as n from (select source, unnest(list_distinct(lines)) as line from d) where translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '' group by source, line),
t as (select source, count(*) as total from documents group by source),
b as (select p.source, list(line) as bad from p join t on p.source is not distinct from t.source where n - {DOUBT}::double * sqrt(n) > {RATIO}::double * total group by p.source),
f as (select doc_id, d.source, text, lines, list_filter(lines, lambda x: not coalesce(list_contains(bad, x), false)) as kept from d left join b on d.source is not distinct from b.source)
select doc_id, source, coalesce(len(lines), 0)::bigint as n_lines, coalesce(len(lines) - len(kept), 0)::bigint as n_dropped,
case when text is not null then md5(coalesce(array_to_string(kept, chr(10)), '')) end as text_md5 from f"""

_ENTRIES = ", ".join(f"('{p}', '{a}', timestamp '{d} 00:00:00')" for p, a, d in LIST)
_URLS = f"""with e(pattern, action, since) as (values {_ENTRIES}),
i as (select *, lead(since) over (partition by pattern order by since) as until from e),
c as (select page_id, rtrim(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') as host,
timestamp '2023-10-01 00:00:00' + to_days((page_id * 7919 % 600)::integer) + to_hours((page_id % 24)::integer) as fetched from pages),
m as (select page_id, arg_max(struct_pack(pattern, action, since), length(pattern)) as rule from c join i on (host = pattern or ends_with(host, '.' || pattern))
and fetched >= since and (until is null or fetched < until) and action <> 'drop' group by page_id)
select c.page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') as fetched, rule.pattern as pattern, rule.action as action, strftime(rule.since, '%Y-%m-%d') as since,
coalesce(rule.action = 'block', false) as blocked from c left join m on c.page_id = m.page_id"""

_HITS = f"""with q as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
p as (select distinct item_id, list_slice(w, k, k + least(10, len(w)) - 1) as phrase from q, unnest(range(1, greatest(len(w) - 8, 2))) t(k) where len(w) > 0),
d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, k, n, list_slice(w, k, k + n - 1) as phrase from d, (select distinct len(phrase) as n from p) s, unnest(range(1, greatest(len(w) - n + 2, 1))) t(k)),
h as (select g.doc_id, k, n, item_id from g join p on g.phrase = p.phrase),
x as (select doc_id, count(distinct i) as n_hit from h, unnest(range(k, k + n)) t(i) group by doc_id),
y as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x on d.doc_id = x.doc_id left join y on d.doc_id = y.doc_id"""

_NEAR = f"""with recursive d as (select doc_id, {_PARTS} as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w] else list_transform(range(1, len(w)), lambda k: [w[k], w[k + 1]]) end)) as sh from d),
n as (select d.doc_id, count(sh) as size from d left join s on d.doc_id = s.doc_id group by d.doc_id),
c as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 80 * (x.size + y.size - common)),
e as (select u, v from l union select v, u from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.v from r join e on r.b = e.u)
select n.doc_id, size::bigint as n_shingles, min(b) as component_id, n.doc_id = min(b) as kept from n join r on r.a = n.doc_id group by n.doc_id, size"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": _LINES,
    "op3_url_filter": _URLS,
    "op5_decontamination": _HITS,
    "op8_minhash_neardup": _NEAR,
}
