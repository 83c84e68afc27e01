"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import alignment, conversations, jaccard, langid, linededup, media, mixing, packing, pieces, quality, sharding, urls, warc
from deckloom.llm.common import table

N_SHARDS = 40


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_kept", "n_exact", "n_near", F.crc32(text.cast("binary")).alias("kept_crc32"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.balanced_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(damaged, keep=table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every page's html, in order."""
    parts = media.interleaved(table(spark, sf_dir, "pages"), "html", ("page_id",))
    return parts.select("page_id", F.explode_outer("parts").alias("p")).select("page_id", "p.pos", "p.kind", "p.text", "p.ref", "p.caption")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_line_dedup, op3_ngram_join, op4_url_filter, op5_warc, op6_language, op7_media, op8_pieces, op9_shards, op10_quality, op11_repair, op12_packing, op13_alignment, interleaved_pages)
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op1_mix": rf"""
WITH d AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
    -ln(((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / (0.1 + 0.9 * (1.0 - least(1.0, 20.0 * (len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE)))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap0,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS weight0 FROM w),
t AS (SELECT source, source_size, least(cap, max((budget - cap0) / (all_weight - weight0)) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5::DOUBLE) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS into FROM d)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target + 0.5::DOUBLE)::BIGINT - epochs * source_size - into)))::BIGINT AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source""".replace("AS into", "AS before_words").replace("- into)", "- before_words)"),
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM (SELECT DISTINCT * FROM p) p LEFT JOIN rules ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND prefix(p.path, rpath))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p JOIN fit ON p.page_id IS NOT DISTINCT FROM fit.page_id AND p.host = fit.host AND p.path = fit.path AND fit.n = 1""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
}
