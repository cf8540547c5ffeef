"""The engine's queries by name, each with equivalent SQL where SQL can express it.

``documents`` is the main archive: a file ``doc_<doc_id>`` per row, in doc_id order, whose bytes are the UTF-8 text.
Queries whose results depend on where content-defined cuts fall use whole files as chunks (a least size above any text),
which SQL can follow; the cuts themselves are checked by sums, round trips and a scalar version in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import columns as C
from lodestore.functions.chunking import chunk_files
from lodestore.functions.codecs import compress_udf, decompress_udf
from lodestore.operators import dedup, stats, vectors
from lodestore.operators.archive import Archive, pack
from lodestore.operators.blocks import block_offsets as offsets_of
from lodestore.operators.blocks import compared, plan_blocks
from lodestore.operators.sampling import DataLoaderCheckpoint, DeterministicSampler
from lodestore.session import ship
from lodestore.sources import files as sources
from lodestore.sources.container import Container, export
from lodestore.sources.files import with_file_ord
from lodestore.storage import scratch_folder, scratch_path
from lodestore.streaming.ingest import ingest_folder

WHOLE = 1 << 30
KEY, WRONG_KEY = b"\x42" * 32, b"\x00" * 32
BLOCK_64K = 64 << 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_id"), F.col("doc_id").alias("file_ord"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))


_packed: dict[tuple[str, str], str] = {}


def packed(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive of ``documents`` with whole files as chunks; packed once for all queries of an application."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _packed:
        files, path = documents(spark, sf_dir), scratch_path(spark, "archive")
        pack(files, path, limit=BLOCK_64K, chunked=chunk_files(files, least=WHOLE))
        _packed[at] = path
    return Archive(spark, _packed[at])


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).files.select("file_id", "file_ord", "original_size")


def whole(files: DataFrame) -> DataFrame:
    return chunk_files(files, with_data=False, least=WHOLE)


_FILES = "select 'doc_' || doc_id as file_id, doc_id as file_ord, strlen(text)::bigint as original_size from documents"


@query(_FILES)
def list_files(spark, sf_dir):
    return listed(spark, sf_dir)


@query(f"select original_size from ({_FILES}) where file_id = 'doc_7'")
def file_size(spark, sf_dir):
    return spark.createDataFrame([(packed(spark, sf_dir).file_size("doc_7"),)], "original_size long")


@query("select 'doc_' || doc_id as file_id, sha256(text) as sha256 from documents where doc_id = 42")
def lookup_file(spark, sf_dir):
    found = spark.createDataFrame([("doc_42", bytearray(packed(spark, sf_dir)["doc_42"]))], "file_id string, bytes binary")
    return found.select("file_id", F.sha2("bytes", 256).alias("sha256"))


@query(f"select file_id, file_ord, original_size from ({_FILES}) where file_ord >= 10 and file_ord < 100 and (file_ord - 10) % 7 = 0")
def slice_files(spark, sf_dir):
    return packed(spark, sf_dir).at(slice(10, 100, 7)).select("file_id", "file_ord", "original_size")


@query(f"select a.place, f.file_id from (values (0, 5), (1, 3), (2, 5), (3, 199), (4, 0)) a(place, i) join ({_FILES}) f on f.file_ord = a.i")
def select_indices(spark, sf_dir):
    found = packed(spark, sf_dir).select([5, 3, 5, 199, 0]).collect()
    return spark.createDataFrame([(k, r["file_id"]) for k, r in enumerate(found)], "place int, file_id string")


@query("select page_id, url from pages where ends_with(url, '.html') and not starts_with(split_part(url, '/', -1), '._')")
def filter_by_name(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").where(url.endswith(".html") & ~C.basename(url).startswith("._")).select("page_id", "url")


@query("select conv_id || '/' || turn || '_' || role as file_id, try_cast(turn as integer) as label from conversations")
def label_from_name(spark, sf_dir):
    name = F.concat_ws("_", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "role")
    return table(spark, sf_dir, "conversations").select(name.alias("file_id"), C.label_of(name).alias("label"))


@query("select page_id, url <> '' and not contains(url, '..') and not contains(url, '/') and not contains(url, chr(92)) as ok_url, host <> '' and not contains(host, '..') and not contains(host, '/') and not contains(host, chr(92)) as ok_host from (select page_id, url, split_part(url, '/', 3) as host from pages)")
def valid_names(spark, sf_dir):
    host = F.split_part(F.col("url"), F.lit("/"), F.lit(3))
    return table(spark, sf_dir, "pages").select("page_id", C.valid_archive_name(F.col("url")).alias("ok_url"), C.valid_archive_name(host).alias("ok_host"))


@query("select 'doc_' || doc_id as file_id, 0 as pos, strlen(text)::bigint as size, sha256(text) as hash from documents where strlen(text) > 0")
def file_chunks(spark, sf_dir):
    return whole(documents(spark, sf_dir)).select("file_id", "pos", "size", "hash")


_STATS = """with c as (select sha256(text) as hash, strlen(text) as size from documents where strlen(text) > 0),
u as (select hash, min(size) as size from c group by hash)
select (select count(*) from documents) as total_files, (select count(*) from c) as total_chunks, (select count(*) from u) as unique_chunks,
(select sum(size) from c)::bigint as input_bytes, (select sum(size) from u)::bigint as unique_bytes,
round(100 * (1 - (select count(*) from u)::double / (select count(*) from c)), 6) as dedup_percent,
round((select sum(size) from c)::double / (select sum(size) from u), 6) as dedup_ratio, round((select sum(size) from c) / 1e6, 6) as input_mb"""


@query(_STATS)
def file_dedup_stats(spark, sf_dir):
    files = documents(spark, sf_dir)
    return dedup.dedup_stats(whole(files), files)


@query()
def dedup_stats(spark, sf_dir):
    files = documents(spark, sf_dir)
    return dedup.dedup_stats(chunk_files(files, with_data=False), files)


_UNIQUE = "select sha256(text) as hash, min(strlen(text))::bigint as size, min(doc_id) as file_ord from documents where strlen(text) > 0 group by 1"


@query(f"select hash, size, file_ord, row_number() over (order by file_ord) - 1 as first_seen from ({_UNIQUE})")
def first_seen_chunks(spark, sf_dir):
    found = dedup.first_seen(whole(documents(spark, sf_dir)))
    return dedup.with_ordinal(found, "file_ord", ["pos"], "first_seen").select("hash", "size", "file_ord", F.col("first_seen").cast("long").alias("first_seen"))


@query("select 'doc_' || doc_id as file_id, strlen(text)::bigint as bytes, true as contiguous from documents where strlen(text) > 0")
def chunk_size_totals(spark, sf_dir):
    chunks = chunk_files(documents(spark, sf_dir), with_data=False)
    return chunks.groupBy("file_id").agg(F.sum("size").alias("bytes"), ((F.max(F.col("offset") + F.col("size")) == F.sum("size")) & (F.max("pos") + 1 == F.count("*"))).alias("contiguous"))


@query("select 'doc_' || doc_id as file_id, sha256(text) as sha256 from documents where strlen(text) > 0")
def roundtrip_integrity(spark, sf_dir):
    chunks = chunk_files(documents(spark, sf_dir))
    return chunks.groupBy("file_id").agg(F.sha2(F.expr("listagg(data) within group (order by pos)"), 256).alias("sha256"))


@query("select count(*) as passed, 0::bigint as failed, count(*) as total_files, sum(strlen(text))::bigint as original_bytes from documents")
def archive_verify(spark, sf_dir):
    files = documents(spark, sf_dir)
    archive = pack(files, scratch_path(spark, "archive"))
    return archive.verify(files).join(archive.info().select("total_files", "original_bytes"))


@query("select count(*) as total_files, (select count(distinct sha256(text)) from documents where strlen(text) > 0) as total_chunks, sum(strlen(text))::bigint as total_original_bytes, (select sum(strlen(text)) from (select distinct text from documents))::bigint as total_unique_bytes, false as encrypted from documents")
def archive_summary(spark, sf_dir):
    files = documents(spark, sf_dir)
    archive = pack(files, scratch_path(spark, "archive"), chunked=chunk_files(files, least=WHOLE))
    return archive.summary().select("total_files", "total_chunks", "total_original_bytes", "total_unique_bytes", "encrypted")


_FOLD = f"""with recursive u as (select hash, size, row_number() over (order by file_ord) - 1 as first_seen from ({_UNIQUE})),
f as (select first_seen, hash, size, 0::bigint as block_id, 0::bigint as inner_offset from u where first_seen = 0
union all select u.first_seen, u.hash, u.size, case when f.inner_offset + f.size >= {BLOCK_64K} then f.block_id + 1 else f.block_id end,
case when f.inner_offset + f.size >= {BLOCK_64K} then 0 else f.inner_offset + f.size end from f join u on u.first_seen = f.first_seen + 1)"""


def _planned(spark, sf_dir):
    unique = dedup.with_ordinal(dedup.first_seen(whole(documents(spark, sf_dir))), "file_ord", ["pos"], "first_seen")
    return plan_blocks(unique, BLOCK_64K)


@query(f"{_FOLD} select hash, block_id, inner_offset from f")
def block_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("hash", "block_id", "inner_offset")


@query(f"{_FOLD}, b as (select block_id, sum(size)::bigint as raw_size, count(*) as n_chunks from f group by block_id) select block_id, raw_size, n_chunks, (coalesce(sum(raw_size) over (order by block_id rows between unbounded preceding and 1 preceding), 0) + 32)::bigint as start from b")
def block_offsets(spark, sf_dir):
    blocks = _planned(spark, sf_dir).groupBy("block_id").agg(F.sum("size").alias("stored_size"), F.count("*").alias("n_chunks"))
    return offsets_of(blocks, 32).select("block_id", F.col("stored_size").alias("raw_size"), "n_chunks", F.col("offset").cast("long").alias("start"))


@query("select count(distinct sha256(text)) as new_chunks, count(distinct sha256(text)) filter (where doc_id % 10 = 4) as new_in_4 from documents where doc_id % 5 = 4 and strlen(text) > 0 and sha256(text) not in (select sha256(text) from documents where doc_id % 5 < 4)")
def append_new_chunks(spark, sf_dir):
    chunks = whole(documents(spark, sf_dir))
    known = chunks.where("file_ord % 5 < 4")
    new = lambda condition, name: dedup.new_chunks(chunks.where(condition), known).agg(F.count("*").alias(name))
    return new("file_ord % 5 = 4", "new_chunks").join(new("file_ord % 10 = 4", "new_in_4"))


@query("select 2::bigint as versions, count(*) as total_files, count(distinct sha256(text)) filter (where strlen(text) > 0) as total_chunks, sum(strlen(text))::bigint as total_original_bytes from documents")
def append_summary(spark, sf_dir):
    files = documents(spark, sf_dir)
    path = scratch_path(spark, "archive")
    old = files.where("file_ord % 5 < 4").withColumn("file_ord", F.expr("file_ord - file_ord div 5"))
    new = files.where("file_ord % 5 = 4").withColumn("file_ord", F.expr("file_ord div 5"))
    pack(old, path, chunked=chunk_files(old, least=WHOLE)).append(new, chunked=chunk_files(new, least=WHOLE))
    archive = Archive(spark, path)
    return archive.summary().select((F.col("version") + 1).cast("long").alias("versions"), "total_files", "total_chunks", "total_original_bytes")


@query("select 'doc_' || doc_id as file_id, sha256(coalesce(text, '')) as sha256 from documents")
def append_gaps(spark, sf_dir):
    """An archive whose positions have gaps, and an append whose positions have gaps too."""
    files = documents(spark, sf_dir)
    path = scratch_path(spark, "archive")
    pack(files.where("file_ord % 5 < 4"), path).append(files.where("file_ord % 5 = 4"))
    return Archive(spark, path).read().select("file_id", F.sha2("bytes", 256).alias("sha256"))


@query("select 'name_' || doc_id % 50 as file_id, sha256(coalesce(text, '')) as sha256 from documents")
def repeated_ids(spark, sf_dir):
    """Files that share names, in positions by name."""
    named = documents(spark, sf_dir).select(F.concat(F.lit("name_"), F.col("file_ord") % 50).alias("file_id"), "bytes")
    archive = pack(with_file_ord(named), scratch_path(spark, "archive"))
    return archive.read().select("file_id", F.sha2("bytes", 256).alias("sha256"))


@query("select distinct sha256(text) as hash from documents where source = 'src0' and strlen(text) > 0 and sha256(text) in (select sha256(text) from documents where source <> 'src0')")
def shared_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source")
    chunks = whole(documents(spark, sf_dir)).join(docs, F.col("doc_id") == F.col("file_ord"))
    return dedup.shared_chunks(chunks.where("source = 'src0'"), chunks.where("source <> 'src0'"))


_SHA = "select 'doc_' || doc_id as file_id, sha256(text) as sha256 from documents"


@query(_SHA)
def codec_roundtrip_zstd(spark, sf_dir):
    back = decompress_udf()(compress_udf("zstd")("bytes"))
    return documents(spark, sf_dir).select("file_id", F.sha2(back, 256).alias("sha256"))


@query(_SHA)
def codec_roundtrip_lz4(spark, sf_dir):
    back = decompress_udf()(compress_udf("lz4")("bytes"))
    return documents(spark, sf_dir).select("file_id", F.sha2(back, 256).alias("sha256"))


@query("select 'doc_' || doc_id as file_id, sha256(text) as sha256, 28 as overhead from documents")
def encrypt_roundtrip(spark, sf_dir):
    sealed = C.with_key(documents(spark, sf_dir), KEY).withColumn("sealed", C.encrypted(F.col("bytes"), F.col("key")))
    return sealed.select("file_id", F.sha2(C.decrypted(F.col("sealed"), F.col("key")), 256).alias("sha256"), (F.octet_length("sealed") - F.octet_length("bytes")).alias("overhead"))


@query("select count(*) as files, 0::bigint as opened from documents")
def wrong_key(spark, sf_dir):
    sealed = C.with_key(documents(spark, sf_dir), KEY).select(C.encrypted(F.col("bytes"), F.col("key")).alias("sealed"))
    opened = C.with_key(sealed, WRONG_KEY).select(C.try_decrypted(F.col("sealed"), F.col("key")).alias("opened"))
    return opened.agg(F.count("*").alias("files"), F.count("opened").alias("opened"))


@query("select doc_id, sha256(text) as hex, true as same from documents")
def hash_hex(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", C.hash_to_hex(C.hex_to_hash(h)).alias("hex"), (C.hex_to_hash(h) == F.unhex(h)).alias("same"))


@query("select doc_id, base64(encode(text)) as encoded from documents")
def base64_encode(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("file_ord").alias("doc_id"), F.replace(F.base64("bytes"), F.lit("\r\n"), F.lit("")).alias("encoded"))


@query()
def crc_check(spark, sf_dir):
    sums = documents(spark, sf_dir).withColumn("crc", F.crc32("bytes"))
    return sums.select("file_id", "crc", F.octet_length(C.verified(F.col("bytes"), F.col("crc"))).alias("checked"))


@query("select page_id, replace(url, '/', '_') as name, strlen(html)::bigint as size, count(*) over (partition by replace(url, '/', '_')) > 1 as collides from pages")
def mount_listing(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", C.flat_name(F.col("url")).alias("name"), F.octet_length("html").cast("long").alias("size"))
    return named.withColumn("collides", F.count("*").over(Window.partitionBy("name")) > 1)


@query("select 'doc_' || doc_id as file_id, lower(substring(hex(encode(text)), 21, 40)) as piece from documents")
def byte_range_read(spark, sf_dir):
    return documents(spark, sf_dir).select("file_id", C.hash_to_hex(F.substring("bytes", 11, 20)).alias("piece"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as p50, round(max(case when r = floor(c * 0.99) + 1 then value end), 6) as p99 from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as c from events where value is not null) group by event_type")
def latency_stats(spark, sf_dir):
    return stats.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("select source, sum(strlen(text))::bigint as bytes, count(*) as files from documents group by source")
def storage_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count("*").alias("files"))


def _index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"))


_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"select e.vec_id as file_id, round({_COS}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {_COS} desc, e.vec_id limit 10")
def vector_topk(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = index.where("file_id = 0").first()["vector"]
    return vectors.search(index, asked, 10).select("file_id", F.round("score", 6).alias("score"))


@query(f"select query_id, rank, file_id, score from (select q.vec_id as query_id, e.vec_id as file_id, round({_COS}, 6) as score, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id)::integer as rank from embeddings e, embeddings q) where rank <= 3")
def vector_topk_batch(spark, sf_dir):
    index = _index(spark, sf_dir)
    found = vectors.search_batch(index, index.withColumnRenamed("file_id", "query_id"), 3)
    return found.withColumn("score", F.round("score", 6))


@query(f"select e.vec_id as file_id, round({_COS}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where {_COS} >= 0.2")
def vector_threshold_scan(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = F.array(*(F.lit(float(x)) for x in index.where("file_id = 0").first()["vector"]))
    scored = index.select("file_id", vectors.cosine(F.col("vector"), asked).alias("score"))
    return scored.where("score >= 0.2").withColumn("score", F.round("score", 6))


_PERMUTED = """with recursive size as (select count(*)::bigint as n from documents),
z0 as (select i, (42::uhugeint + k::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as z from (select n - i as k, i from size, range(1, n) t(i))),
z1 as (select i, xor(z, z >> 30) * 13787848793156543929::uhugeint % 18446744073709551616::uhugeint as z from z0),
z2 as (select i, xor(z, z >> 27) * 10723151780598845931::uhugeint % 18446744073709551616::uhugeint as z from z1),
d as (select i, (xor(z, z >> 31) % (i + 1)::uhugeint)::bigint as j from z2),
p as (select n - 1 as i, range(0, n) as a from size
union all select p.i - 1, list_transform(p.a, lambda x, k: case when k = p.i + 1 then p.a[d.j + 1] when k = d.j + 1 then p.a[p.i + 1] else x end) from p join d on d.i = p.i),
o as (select unnest(a)::bigint as sample_index, generate_subscripts(a, 1)::bigint - 1 as position from p where i = 0)"""


def _sampler(spark, sf_dir):
    return DeterministicSampler(42, table(spark, sf_dir, "documents").count())


@query(f"{_PERMUTED} select position, sample_index from o")
def permutation(spark, sf_dir):
    sampler = _sampler(spark, sf_dir)
    return sampler.permutation(spark, 0)


@query(f"{_PERMUTED} select position, sample_index from o where position % 4 = 2")
def shard(spark, sf_dir):
    return _sampler(spark, sf_dir).shard(spark, 0, 2, 4)


@query(f"{_PERMUTED} select position, sample_index from o where position % 4 = 2 and position // 4 >= 96")
def resume(spark, sf_dir):
    size = _sampler(spark, sf_dir).size
    return DataLoaderCheckpoint(0, 3, 42, size, 4, 2).remaining(spark, 32)


@query("select range::bigint as sample_index, 1::bigint as times from range((select count(*) from documents))")
def shard_coverage(spark, sf_dir):
    sampler = _sampler(spark, sf_dir)
    shards = [sampler.shard(spark, 1, r, 4) for r in range(4)]
    every = shards[0].union(shards[1]).union(shards[2]).union(shards[3])
    return every.groupBy("sample_index").agg(F.count("*").alias("times"))


# archives, sources and streams, each through the whole engine

_BYTES = "select 'doc_' || doc_id as file_id, sha256(coalesce(text, '')) as sha256 from documents"


def _hashed(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.sha2("bytes", 256).alias("sha256"))


@query("select count(*) as total_files, sum(strlen(text))::bigint as original_bytes, count(*) filter (where strlen(text) > 0) as chunk_refs, count(distinct sha256(text)) filter (where strlen(text) > 0) as total_chunks, false as encrypted, false as has_dictionary from documents")
def archive_info(spark, sf_dir):
    return packed(spark, sf_dir).info().select("total_files", "original_bytes", "chunk_refs", "total_chunks", "encrypted", "has_dictionary")


@query("select replace(url, '/', '_') as name, strlen(coalesce(html, ''))::bigint as size, count(*) over (partition by replace(url, '/', '_')) > 1 as collides from pages")
def archive_listing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("file_id"), F.col("page_id").alias("file_ord"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("bytes"))
    return pack(pages, scratch_path(spark, "archive")).listing()


@query("select 'doc_' || doc_id as file_id, lower(substring(hex(encode(text)), 21, 40)) as piece from documents where doc_id in (0, 7, 42)")
def archive_byte_range(spark, sf_dir):
    archive = packed(spark, sf_dir)
    return spark.createDataFrame([(i, archive.byte_range(i, 10, 20).hex()) for i in ("doc_0", "doc_7", "doc_42")], "file_id string, piece string")


@query(_BYTES)
def dictionary_roundtrip(spark, sf_dir):
    return _hashed(pack(documents(spark, sf_dir), scratch_path(spark, "archive"), dictionary=True).read())


@query(f"{_BYTES} union all {_BYTES}")
def container_roundtrip(spark, sf_dir):
    """A container file with a JSON manifest and one with a MessagePack manifest, read by ranges."""
    folder, archive, back = scratch_folder(spark, "container"), packed(spark, sf_dir), []
    for kind in (False, True):
        export(archive, f"{folder}/{kind}.lds", packed=kind)
        back.append(_hashed(Container(spark, f"{folder}/{kind}.lds").read()))
    return back[0].union(back[1])


_PLACED = "select 'doc_' || doc_id as file_id, row_number() over (order by doc_id) - 1 as file_ord, sha256(coalesce(text, '')) as sha256 from documents"


def _stored(spark, sf_dir, kind: str) -> str:
    folder = scratch_folder(spark, kind)
    sources.write_archives(documents(spark, sf_dir), folder, kind, parts=4)
    return folder


@query(_PLACED)
def tar_source(spark, sf_dir):
    return sources.tar(spark, _stored(spark, sf_dir, "tar")).select("file_id", "file_ord", F.sha2("bytes", 256).alias("sha256"))


@query(_PLACED)
def zip_source(spark, sf_dir):
    return sources.zipped(spark, _stored(spark, sf_dir, "zip")).select("file_id", "file_ord", F.sha2("bytes", 256).alias("sha256"))


@query(_BYTES)
def upload_tar(spark, sf_dir):
    files = sources.uploaded(spark, _stored(spark, sf_dir, "tar"), "documents")
    return _hashed(pack(files, scratch_path(spark, "archive"), name="documents").read())


@query("select 'vec_' || vec_id as name, 'F32' as dtype, len(embedding)::bigint as n, 4 * len(embedding)::bigint as length from embeddings")
def tensor_list(spark, sf_dir):
    folder = scratch_folder(spark, "tensors")
    named = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    sources.write_tensors(named, folder, parts=3)
    return sources.tensors(spark, folder).select("name", "dtype", F.col("shape")[0].alias("n"), "length")


@query(_BYTES)
def stream_ingest(spark, sf_dir):
    """A folder that a stream packs in batches."""
    folder, path = scratch_folder(spark, "folder"), scratch_path(spark, "archive")
    n = packed(spark, sf_dir).unpack(folder)
    ingest_folder(spark, folder, path, scratch_path(spark, "stream"), files_per_batch=-(-n // 3)).awaitTermination()
    return _hashed(Archive(spark, path).read())


@query(f"{_FOLD} select max(block_id) + 1 as blocks_decompressed, sum(size)::bigint as bytes_written from f")
def metrics_snapshot(spark, sf_dir):
    metrics = stats.Metrics(spark)
    packed(spark, sf_dir).read(metrics=metrics).write.format("noop").mode("overwrite").save()
    found = metrics.snapshot()
    return spark.createDataFrame([(found["blocks_decompressed"], found["bytes_written"])], "blocks_decompressed long, bytes_written long")


@query("select 'doc_' || (vec_id % 100) as file_id, vec_id % 100 as file_ord, 'space_' || label as space_id, len(embedding)::bigint as n from embeddings")
def attach_vectors(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), (F.col("vec_id") % 100).cast("string")).alias("file_id"), F.concat(F.lit("space_"), F.col("label").cast("string")).alias("space_id"), F.col("embedding").alias("vector"))
    return vectors.attach(packed(spark, sf_dir).files, own).select("file_id", "file_ord", "space_id", F.size("vector").cast("long").alias("n"))


@query("select m as mode, sum(strlen(text))::bigint as original_bytes, true as smaller from documents, (values ('per_file'), ('solid')) t(m) group by m")
def codec_comparison(spark, sf_dir):
    return compared(documents(spark, sf_dir)).select("mode", "original_bytes", (F.col("stored_bytes") < F.col("original_bytes")).alias("smaller"))


@query(f"{_PERMUTED} select position, 'doc_' || sample_index as file_id from o where position < 100")
def needle_sample(spark, sf_dir):
    archive = packed(spark, sf_dir)
    sample = DeterministicSampler(42, len(archive)).needles(spark, 100)
    return sample.join(archive.placed(), F.col("sample_index") == F.col("place")).select("position", "file_id")


@query("select event_type, sum(strlen(props))::bigint as bytes, round(sum(strlen(props)) / 1e6 / sum(value), 6) as mb_s from events where value is not null and props is not null group by event_type")
def throughput_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("size", F.octet_length("props"))
    return stats.throughput(events, "event_type", "size", "value")
