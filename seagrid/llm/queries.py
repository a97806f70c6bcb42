"""The registered queries of this subpackage, each over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm import exact_dedup, hilbert, isolation, merkle, mixing, packing, passages, scan_encode, simhash, token_counts, token_files, url_filter, whitening
from seagrid.llm.common import materialise, table

#: Fixed values of the URL contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
N_SHARDS = 24


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"), N_SHARDS)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return materialise(counts, "steps").drop("steps")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = scan_encode.encode(table(spark, sf_dir, "documents"), model)
    same = F.xxhash64(scan_encode.decode("ids", model)) == F.col("text_hash")
    return rows.select("doc_id", "n_tokens", "n_chunks", "ids", same.alias("round_trip"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the contract; listed are the canonical URLs that more than one page has, that is, those fetched again in another form."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame([(rule, verdict) for verdict, rule in URL_RULES], "rule string, verdict string")
    return url_filter.url_verdicts(pages, rules, materialise(url_filter.repeated_urls(pages), "listed"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), shown={"text": merkle.tampered_text()})


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) = 1 AS kept,
       text_sha256
FROM n
"""

_RULES_SQL = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in URL_RULES)
OP10_SQL = rf"""
WITH rules AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp
  FROM (VALUES {_RULES_SQL}) t(verdict, rule)),
u AS (
  SELECT page_id, row_number() OVER () AS nth,
         translate(coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '') AS p,
         coalesce(strpos(url, '://'), 0) > 0 AS ok
  FROM pages),
v AS (SELECT page_id, nth, CASE WHEN ok THEN h ELSE '' END AS host, CASE WHEN ok THEN p ELSE '' END AS path FROM u),
c AS (
  SELECT nth, regexp_replace(regexp_replace(host, '^(www|m)[.]', ''), ':(80|443)$', '') || regexp_replace(path, '(/|[.]html)$', '') AS url
  FROM v WHERE host <> ''),
l AS (SELECT url FROM c GROUP BY url HAVING count(*) > 1),
m AS (
  SELECT v.nth, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) AS best
  FROM v JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY v.nth)
SELECT page_id, host, path, m.best.rule AS rule, 
       coalesce(m.best.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN m USING (nth) LEFT JOIN c USING (nth) LEFT JOIN l ON c.url = l.url
"""


def _op13_sql(levels: int = 8, upper: int = 4) -> str:
    """The trees level by level, for up to 8**levels rows of a language and 8**upper languages."""

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda a, b: list_reduce(range(0, 8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, *, CASE WHEN {crc} % 3 = 0 THEN {lowered} ELSE text END AS shown_text FROM documents)",
        f"o AS (SELECT r, doc_id, lang, {digest('text')} AS leaf, {digest('shown_text')} AS shown FROM d)",
        "q AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM o)",
        "t0 AS (SELECT g, i, leaf AS h FROM q)",
        "p0 AS (SELECT r, g, i, shown AS f, '' AS sib FROM q)",
    ]

    def climb(t: str, p: str, n: int) -> None:
        for k in range(n):
            parts.append(
                f"{t}r{k} AS (SELECT g, i // 8 AS j, m, list(h ORDER BY i) AS kids FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {t}{k}) GROUP BY g, i // 8, m)"
            )
            parts.append(f"{t}{k + 1} AS (SELECT g, j AS i, CASE WHEN m = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM {t}r{k})")
            around = "array_to_string(kids[:i % 8], '')", "array_to_string(kids[i % 8 + 2:], '')"
            parts.append(
                f"{p}{k + 1} AS (SELECT r, g, j AS i, CASE WHEN m = 1 THEN f ELSE sha256({around[0]} || f || {around[1]}) END AS f, CASE WHEN m = 1 THEN sib ELSE sib || {around[0]} || {around[1]} END AS sib"
                f" FROM {p}{k} JOIN (SELECT g AS rg, j, m, kids FROM {t}r{k}) ON g = rg AND i // 8 = j)"
            )

    climb("t", "p", levels)
    parts.append(f"u0 AS (SELECT 0 AS g, g AS i, h FROM t{levels})")
    parts.append(f"w0 AS (SELECT r, 0 AS g, g AS i, f, sib FROM p{levels})")
    climb("u", "w", upper)
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = u.h AS verified
FROM q JOIN w{upper} w USING (r) JOIN t{levels} t ON t.g = q.g, u{upper} u"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_paragraph_minhash": op1,
        "op2_hilbert_shards": op2,
        "op3_pivotal_mix": op3,
        "op4_elias_fano_ids": op4,
        "op5_isolation_rules": op5,
        "op6_prefix_token_counts": op6,
        "op7_scan_sentencepiece": op7,
        "op8_heavy_exact_dedup": op8,
        "op9_simhash_pigeonhole": op9,
        "op10_bloom_urls": op10,
        "op11_match_packing": op11,
        "op12_block_whitening": op12,
        "op13_merkle_climb": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_heavy_exact_dedup": OP8_SQL, "op10_bloom_urls": OP10_SQL, "op13_merkle_climb": OP13_SQL}
