"""The registered queries of the training-data operators, one per operator, and their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, jaccard, language_model, mtree, packing, pii, simhash, spelling, substring_dedup, suffix_dedup, toxicity, url_filter
from .store import table

#: The configured URL rules: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pseudonyms' key in these queries, which are for checks only; a deployment takes its own from a secret store.
PSEUDONYM_KEY = "example key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY, count_col="n_replaced")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score_texts(docs, model).select("doc_id", held_out, "score", "predicted", F.size("segments").alias("n_segments"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), within=True)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), mtree.scaled(F.col("embedding")).alias("vector"))
    found = mtree.top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_pseudonyms": op1_pii_pseudonyms,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_url_filters": op4_url_filters,
        "op5_toxicity": op5_toxicity,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_bpe_encode_decode": op8_bpe_encode_decode,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_token_alignment": op11_token_alignment,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    return {
        "op4_url_filters": f"""
WITH rules(r_host, r_path, action) AS (VALUES {rules}),
base AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT b.page_id, b.host, b.path, r.r_host || r.r_path AS rule, r.action,
         row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.r_host) DESC NULLS LAST, length(r.r_path) DESC) AS k
  FROM base b LEFT JOIN rules r
    ON (b.host = r.r_host OR ends_with(b.host, '.' || r.r_host)) AND starts_with(b.path, r.r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best WHERE k = 1
""",
        "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
        "op10_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(reach) AS least FROM r GROUP BY 1) m USING (doc_id)
""",
    }
