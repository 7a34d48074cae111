"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bagminhash, bpe, exact, hard_negatives, language, merkle, mixing, quality_rules, shards, site_quality, speculative_bpe, urls, warc
from cohortlens.llm.rows import about, small_batches
from cohortlens.session import materialized, shared_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{d}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, d, "documents"), path, public_tokenizers.PATTERN)


def op2_ring_shards(spark: SparkSession, d: str) -> DataFrame:
    """All documents in eight shards by a ring with bounded loads; counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    columns = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))}
    out = shards.ring_shards(table(spark, d, "documents"), "doc_id", columns, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the one that stays of those with equal normalised text."""
    classes = exact.dedup(exact.located(table(spark, d, "documents")))
    return classes.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)"""


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every page's URL by the site rules and the vocabulary."""
    return urls.judged(table(spark, d, "pages"))


def _standing_alone(term: str) -> str:
    return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"


def _op4_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    a, z = urls.UPPER, urls.LOWER
    return f"""
WITH parts AS (SELECT page_id, coalesce(translate(url, '{a}', '{z}'), '') AS u,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{a}', '{z}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hits AS (SELECT *, {" + ".join(map(_standing_alone, urls.STRICT_TERMS))} AS strict_terms,
  {" + ".join(map(_standing_alone, urls.SOFT_TERMS))} AS soft_terms FROM parts)
SELECT page_id, host, path, {rule} AS rule,
  {says} WHEN strict_terms > 0 OR soft_terms >= {urls.SOFT} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(strict_terms AS INTEGER) AS strict_terms, CAST(soft_terms AS INTEGER) AS soft_terms FROM hits"""


#: About so many labelled documents, chosen by hash, are the trusted target of the quality rules.
TRUSTED = 20_000


def trusted(spark: SparkSession, d: str, rows: int = TRUSTED) -> DataFrame:
    """(doc_id, trusted): good and not toxic documents, all or about ``rows``."""
    good = table(spark, d, "labels").where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    good = materialized(good)
    return about(good, "doc_id", rows, good.count()).withColumn("trusted", F.lit(True))


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the base rules and by its n-grams' likelihood ratio."""
    docs = table(spark, d, "documents").select("doc_id", "text")  # other columns may be called as those that are added
    return quality_rules.judged(docs.join(F.broadcast(trusted(spark, d)), "doc_id", "left"), F.col("trusted"))


def op6_site_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every document's quality; its source is its host, and its language there its path."""
    docs = table(spark, d, "documents")
    return site_quality.classified(docs, table(spark, d, "labels"), F.col("source"), F.col("lang"))


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them."""
    return language.identified(table(spark, d, "documents"))


def op8_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of near-duplicates, of which the smallest doc_id stays."""
    classes = bagminhash.near_duplicates(exact.located(table(spark, d, "documents")))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.read_archives(spark, warc.write_archives(table(spark, d, "pages"), folder), folder)
    return rows.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


def op10_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mixing.mixed(table(spark, d, "documents"))


def op11_speculative_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text encoded by proposed and verified tokens, and decoded again."""
    import public_tokenizers

    out = speculative_bpe.packed(table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    n = (F.octet_length("data") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("data", 256).alias("ids_sha256"), F.sha2(F.col("back").cast("binary"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its positives; some labels are changed first."""
    rows = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
neg AS (SELECT pos.*, other_id AS negative_id, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""


#: The values of a document that its leaf covers, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A proof for every document against one root; some documents are altered after the manifest was built."""
    docs = table(spark, d, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = merkle.proved(docs, LEAF, altered={"n_chars": F.col("n_chars") + 1}, where=hit)
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _leaf_sql(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda x: 0::BIGINT)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""
_ABOVE_SQL = "list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], '')))"
_BESIDE_SQL = "hs[xor(place >> l, 1) + 1]"
_SIBLING_SQL = f"CASE WHEN {_BESIDE_SQL} IS NULL THEN '' WHEN (place >> l) % 2 = 1 THEN 'L' || {_BESIDE_SQL} ELSE 'R' || {_BESIDE_SQL} END"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC32_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS start,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents),
g AS (SELECT tree, 0 AS l, list(leaf ORDER BY place) AS hs FROM d GROUP BY tree UNION ALL SELECT tree, l + 1, {_ABOVE_SQL} FROM g WHERE len(hs) > 1),
s AS (SELECT tree, hs[1] AS subroot FROM g WHERE len(hs) = 1),
r AS (SELECT 0 AS l, list(subroot ORDER BY tree) AS hs FROM s UNION ALL SELECT l + 1, {_ABOVE_SQL} FROM r WHERE len(hs) > 1),
low AS (SELECT doc_id, list({_SIBLING_SQL} ORDER BY l) AS sibs FROM d JOIN g USING (tree) WHERE len(hs) > 1 GROUP BY doc_id),
high AS (SELECT tree, list({_SIBLING_SQL} ORDER BY l) AS sibs FROM (SELECT tree, tree AS place FROM s) CROSS JOIN r WHERE len(hs) > 1 GROUP BY tree),
p AS (SELECT doc_id, leaf, start, subroot, (SELECT hs[1] FROM r WHERE len(hs) = 1) AS root, list_concat(coalesce(low.sibs, []), coalesce(high.sibs, [])) AS sibs
  FROM d JOIN s USING (tree) LEFT JOIN low USING (doc_id) LEFT JOIN high USING (tree)),
f AS (SELECT *, 1 AS k, start AS h FROM p UNION ALL
  SELECT * EXCLUDE (k, h), k + 1, CASE WHEN sibs[k] = '' THEN sha256(h) WHEN sibs[k][1] = 'L' THEN sha256(sibs[k][2:] || h) ELSE sha256(h || sibs[k][2:]) END FROM f WHERE k <= len(sibs))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sibs, lambda x: x[2:]), '')) AS proof_sha256, h AS folded_root, h = root AS verified FROM f WHERE k = len(sibs) + 1"""


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_ring_shards, op3_exact_dedup, op4_url_filter, op5_quality_rules, op6_site_quality, op7_language_id, op8_near_dedup, op9_warc, op10_source_mix, op11_speculative_bpe, op12_hard_negatives, op13_merkle_manifest)}
SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_url_filter": _op4_sql(), "op9_warc": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
