"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import exact_dedup, fingerprint, line_dedup, mixing, ngram_join, quality, repeats, secret_scan, sentencepiece_bpe, simhash, token_alignment, warc, whitening
from docweave.llm.common import documents, text_or_empty


#: Domains of the mix and the parts of all tokens that they shall have.
TARGETS = {"good": 0.9, "poor": 0.06, "toxic": 0.04}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text"), labelled_domains(spark, sf_dir), TARGETS)
    shares = [F.round(F.col("posterior")[i], 6).alias(f"p_{name}") for i, name in enumerate(TARGETS)]
    return out.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), k=3, percent=90).drop("text_key", "first")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), "lossless")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.crawl_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "url", "refers_to", "status", F.array_join(entries, "\n").alias("headers"))


OP6_SQL = r"""
with bare as (select page_id, md5(coalesce(html, '')) as tag, regexp_replace(trim(url), '#.*$', '') as u from pages),
cut as (select page_id, tag,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as rest from bare),
named as (select page_id, tag, host || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') ||
    case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end as url
  from (select *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x : x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as p from cut)),
visits as (select page_id, url, tag, page_id * 10 + case when page_id % 3 = 0 then -5 else 5 end as seen,
    case when page_id % 7 = 0 then 'other' else tag end as told from named),
found as (select v.*, r.page_id as base, r.tag as base_tag from visits v asof left join
    (select page_id, url, tag, page_id * 10 as at from named) r on v.url = r.url and v.seen > r.at)
select 'v' || page_id as record_id, url, 'r' || base as refers_to,
  case when base is null then 'unresolved' when told = base_tag then 'resolved' else 'changed' end as status,
  case when base is not null and told = base_tag
    then 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || seen || chr(10) || 'etag: W/' || tag
    else 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || seen || chr(10) || 'etag: ' || case when told = 'other' then 'other' else 'W/' || tag end end as headers
from found
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP8_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind_no"] < len(secret_scan.BASE_KINDS))
    of_kind = lambda name: F.size(F.filter("found", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [of_kind(name) for name in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align(documents(spark, sf_dir))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_fingerprints": op2_fingerprints,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_ngram_join": op4_ngram_join,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_line_dedup": op7_line_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality": op9_quality,
        "op10_secret_scan": op10_secret_scan,
        "op11_whitening": op11_whitening,
        "op12_simhash": op12_simhash,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": OP6_SQL, "op8_exact_dedup": OP8_SQL}
