"""The queries opN_<name> of this folder's operators, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .encode import vocabulary


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, held_out, score, train

    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import files

    out = files(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), size=1024, end_id=0)
    length = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import histogram

    return histogram(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, scan

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    out = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return out.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: DuckDB's SQL for lower-casing A-Z only, and for the words of a text.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
      from (select distinct * from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

OP8_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
b as (select cast(item_id as varchar) as item_id, coalesce({_WORDS.format("text")}, []) as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram, least(len(w), 10) as size
       from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (select r, i, size, array_to_string(w[i : i + size - 1], ' ') as gram
       from (select *, unnest(range(1, len(w) - size + 2)) as i from d cross join sizes where len(w) >= size)),
hit as (select distinct r, i, dw.size, item_id from dw join bw using (gram, size)),
marked as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hit) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join marked using (r) left join items using (r)
"""


def oracle_sql() -> dict[str, str]:
    from .licenses import sql

    return {"op3_topk": OP3_SQL, "op4_licenses": sql(_WORDS), "op8_decontamination": OP8_SQL}
