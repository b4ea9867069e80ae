"""The ten operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, fixity, langid, mixing, neardup, packing, sharding, token_file, topk, toxicity
from .common import table
from .tokens import tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, window=2048)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, by the law that shards hold near equal bytes; the slot map is stored and read back."""
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of all pages as WARC records against a stored replica: records of pages with page_id mod 97 = 13 have one
    byte changed, those with page_id mod 20000 = 200 are lost, and behind those with page_id mod 20000 = 120 stands one
    more record."""
    records = fixity.records(table(spark, sf_dir, "pages"))
    index = fixity.indexed(records)
    page = F.col("page_id")
    where = index.select(F.col("page_id").alias("_page"), F.col("sha256").alias("_sha"), "file", "offset").dropDuplicates(["_page", "_sha"])
    put = records.join(where, page.eqNullSafe(F.col("_page")) & (F.sha2("record", 256) == F.col("_sha")))
    rotten = F.when(page % 97 == 13, F.overlay("record", F.lit("X").cast("binary"), F.lit(12), F.lit(1))).otherwise(F.col("record"))
    lost = F.coalesce(page % 20000 == 200, F.lit(False))
    kept = put.where(~lost).select("file", F.struct(F.col("offset"), F.lit(0).alias("more")).alias("place"), rotten.alias("record"))
    more = put.where(page % 20000 == 120).select("file", F.struct(F.col("offset"), F.lit(1).alias("more")).alias("place"), fixity.warc_record(-page - 1, F.lit("urn:more"), F.lit("more")).alias("record"))
    replica = fixity.written(kept.unionByName(more), "replica")
    return fixity.audit(index, fixity.read(replica))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as stored audio, and its features."""
    return audio.digests(audio.store(table(spark, sf_dir, "documents")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose vec_id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the token file holds it."""
    blocks = token_file.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_file.read_documents(blocks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_sharding, op4_mixing, op5_toxicity, op6_fixity, op7_audio, op8_topk, op9_near_duplicates, op10_token_file)}


def oracle_sql() -> dict[str, str]:
    """DuckDB's form of the queries that SQL can express."""
    return {
        "op6_fixity": """
with r as (
  select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages),
h as (select page_id, record, cast(octet_length(encode(record)) as bigint) as n_bytes, sha256(record) as sha256 from r),
g as (select *, cast(sum(n_bytes) over (order by page_id, sha256 rows unbounded preceding) - n_bytes as bigint) as start from h),
f as (select *, start // 67108864 as file from g),
e as (select *, start - min(start) over (partition by file) as "offset" from f),
p as (
  select file, start, 0 as more, page_id, case when page_id % 97 = 13 then substr(record, 1, 11) || 'X' || substr(record, 13) else record end as record
  from e where page_id % 20000 <> 200
  union all
  select file, start, 1, -page_id - 1, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || (-page_id - 1) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: urn:more'
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: 4'
    || chr(13) || chr(10) || chr(13) || chr(10) || 'more' || chr(13) || chr(10) || chr(13) || chr(10)
  from e where page_id % 20000 = 120),
q as (
  select file, page_id, sha256(record) as sha256, cast(octet_length(encode(record)) as bigint) as n_bytes,
    cast(sum(octet_length(encode(record))) over (partition by file order by start, more rows unbounded preceding) - octet_length(encode(record)) as bigint) as found_offset
  from p)
select coalesce(e.page_id, q.page_id) as page_id, cast(coalesce(e.file, q.file) as bigint) as file, coalesce(e."offset", q.found_offset) as "offset",
  coalesce(e.n_bytes, q.n_bytes) as n_bytes, coalesce(e.sha256, q.sha256) as sha256, q.found_offset,
  case when q.page_id is null then 'missing' when e.page_id is null then 'extra' when e.sha256 <> q.sha256 then 'corrupt'
    when e."offset" = q.found_offset then 'ok' else 'moved' end as status
from e full join q on e.page_id = q.page_id and e.file = q.file""",
        "op8_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from k where rank <= 20""",
    }
