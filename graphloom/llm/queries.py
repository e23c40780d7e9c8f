"""The queries of the training-data operators, one ``op<N>_<name>`` each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import code_compression, embedding_dedup, fingerprint, language, language_model, mixing, near_dedup, pipeline, quality, segmentation, spelling, token_counts, toxicity, url_filter
from graphloom.llm.sql import SPELLING_SQL, code_compression_sql
from graphloom.session import scratch, table

#: Fixed values of the rules that op1 applies: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites whose pages are listed (the site label is the first after www., m. or blog.).
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages``; the list is the distinct canonical URLs of the listed sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    site = F.regexp_extract(url_filter.url_host(F.col("url")), r"^(www\.|m\.|blog\.)?([^.]+)", 2)
    listed = pages.where(site.isin(LISTED_SITES)).select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    return url_filter.filter_urls(pages, listed, RULES).drop("bloom_hit")


OP1_SQL = r"""
with u as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
    regexp_replace(regexp_replace('&' || coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), ''), '&(utm_[^=&]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') asked
  from pages),
c as (select *, case when host = '' then '' else regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || case when asked = '' then '' else '?' || asked end end canonical from u),
l as (select distinct canonical from c where regexp_extract(host, '^(www\.|m\.|blog\.)?([^.]+)', 2) in ('ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm')),
r(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b as (select page_id, c.url, rh || rp as rule, verdict from (select distinct page_id, url, host, path from c) c join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
  qualify row_number() over (partition by page_id, c.url order by length(rh || rp) desc, verdict desc, rh || rp) = 1)
select c.page_id, c.host, c.path, c.canonical, b.rule, coalesce(b.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict, l.canonical is not null as listed
from c left join b on c.page_id = b.page_id and c.url = b.url left join l on c.canonical = l.canonical and c.canonical <> ''
"""


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 over the sources, 150 % of all words, at most twice each, dealt to 16 shards."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).withColumn("shards", F.expr("cast(size(array_distinct(transform(slices, x -> x.shard))) as int)")).drop("slices")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text: their sizes, scores, digests and ids, each decoded again."""
    return segmentation.segment(table(spark, sf_dir, "documents"), k=2)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def having(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``; up to 2,000,000 ids (counted first) are broadcast, more are shuffled with the texts."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= 2_000_000 else ids, key, "left_semi")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents; poor ones (quality 0) revised to single spaces;
    toxic ones deleted. The second batch is sent twice and counts once."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels")
    store = token_counts.TokenRollup(spark, scratch(spark, "rollup"))
    store.commit("load", token_counts.insert(docs))
    poor = having(docs, labels.where("quality = 0 and toxic = 0"))
    revised = token_counts.delete(poor).unionByName(token_counts.insert(poor.withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))))
    for _ in range(2):
        store.commit("revise", revised)
    store.commit("drop", token_counts.delete(having(docs, labels.where("toxic = 1"))))
    return store.totals()


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, with the number of spans and of languages among them."""
    r = language.identify(table(spark, sf_dir, "documents"))
    return r.withColumn("n_spans", F.size("spans")).withColumn("n_langs", F.expr("size(array_distinct(transform(spans, x -> x.lang)))")).drop("spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(table(spark, sf_dir, "documents"), quality.ratings_of(table(spark, sf_dir, "labels")))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(table(spark, sf_dir, "embeddings"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts, one run in 97 spoiled, with their forms and roots."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_fingerprint, op3_mixing, op4_toxicity, op5_segmentation, op6_near_dedup, op7_token_counts, op8_embedding_dedup, op9_language, op10_quality, op11_code_compression, op12_language_model, op13_spelling)}
QUERIES["pipeline"] = pipeline.run
ORACLE = {"op1_url_filter": OP1_SQL, "op11_code_compression": code_compression_sql(code_compression.ROUNDS), "op13_spelling": SPELLING_SQL}
