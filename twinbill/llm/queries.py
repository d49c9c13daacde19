"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from .ann import nearest_neighbours
from .benchmark import contamination
from .bpe import digests
from .chunks import substring_dedup
from .language_id import languages
from .line_dedup import line_dedup
from .lm import lm_scores
from .near_dup import NearDup, near_duplicates
from .ranked_search import ranked_search
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import Rule, canonical, host, judge, path
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The public vocabulary file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), byte_bpe())


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(width=2))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """has_repeats: the document repeats a passage of an earlier one."""
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.col("removed_bytes") > 0).alias("has_repeats"),
        "n_chunks",
        "repeated_chunks",
        "removed_bytes",
        F.sha2("text", 256).alias("text_sha256"),
    )


URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Labels in hosts whose pages make up the block list of the query.
UNWANTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    listed = pages.where(host(url).rlike(rf"(^|\.)({'|'.join(UNWANTED_HOSTS)})\.")).select(
        canonical(host(url), path(url)).alias("canonical")
    )
    return judge(pages, listed, URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("text_sha256")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe())


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index_hashing": op1_multi_index_hashing,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_minhash_near_dup": op5_minhash_near_dup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_line_dedup": op8_line_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_token_counts": op10_token_counts,
        "op11_language_id": op11_language_id,
        "op12_ranked_lexical_search": op12_ranked_lexical_search,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


_HOST = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)"
_PATH = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"

URL_FILTER_SQL = f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce({_HOST}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce({_PATH}, '') AS path
  FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parsed
), listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE regexp_matches(host, '(^|\\.)({'|'.join(UNWANTED_HOSTS)})\\.')
), rules(verdict, rule_host, rule_path) AS (
  VALUES {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}
), fits AS (
  SELECT n.*, l.canonical IS NOT NULL AS listed, r.verdict AS rule_verdict, rule_host || rule_path AS rule
  FROM named n
  LEFT JOIN listed l ON l.canonical = n.canonical
  LEFT JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(rule_verdict, length(rule)), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict,
       listed
FROM fits GROUP BY page_id, host, path, listed
"""


NEAR_DUP_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words
    ELSE list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) END AS shingles
  FROM split
), sizes AS (
  SELECT doc_id, len(shingles) AS n FROM sets
), items AS (
  SELECT doc_id, unnest(shingles) AS item FROM sets
), links AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * shared >= 80 * (s.n + t.n - shared)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_TERMS = r"""regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED_SEARCH_SQL = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL
), terms AS (
  SELECT row, doc_id, unnest({_TERMS}) AS term FROM numbered
), asked AS (
  SELECT item_id, term, count(*) AS uses
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), sizes AS (
  SELECT row, count(*) AS n FROM terms GROUP BY row
), totals AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes
), norms AS (
  SELECT row, 75 + ((25 * n * documents) // all_terms) AS m FROM sizes, totals
), counts AS (
  SELECT row, doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
), scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
         CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM counts JOIN norms USING (row) JOIN weights USING (term) JOIN asked USING (term)
  GROUP BY item_id, row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dup": NEAR_DUP_SQL, "op7_url_filter": URL_FILTER_SQL, "op12_ranked_lexical_search": RANKED_SEARCH_SQL}
