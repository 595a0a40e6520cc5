"""The subpackage's registered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perispark.llm import alignment, block_search, byte_pairs, containment, fm_dedup, importance, license_join, lsh_forest, quality, secret_scan, suffix_tree, text_density, toxicity
from perispark.llm.common import held_out, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return (
        scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "toxicity.score", "toxicity.predicted",
        "toxicity.offending"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"))


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return block_search.nearest(vectors.filter("vec_id % 100 = 0"), vectors)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(read(spark, sf_dir, "documents")).drop("blocks")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_density.extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("text")


def op9_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_pairs.read_vocabulary(tokenizer_path())
    return (
        byte_pairs.digest(
        byte_pairs.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded_col="decoded")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "quality.score", "quality.predicted")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        second = f.read()
    return alignment.align(read(spark, sf_dir, "documents"), byte_pairs.read_vocabulary(tokenizer_path()), second)


QUERIES = {f.__name__: f for f in (
    op1_suffix_tree_score, op2_secret_scan, op3_toxicity, op4_near_dedup, op5_block_search,
    op6_license_scan, op7_main_text, op8_substring_dedup, op9_byte_pairs, op10_decontamination,
    op11_importance_resampling, op12_quality, op13_alignment,
)}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(k: int, table: str, key: str) -> str:
    """Rows (key, g) of the distinct k-word shingles."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g
    FROM (SELECT {key}, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL)"""


def _licenses(containment: float = 0.85) -> str:
    """SQL of the license scan: every run of words is held against every template."""
    templates = []
    for label, text in license_join.TEMPLATES:
        own = sorted(set(text.lower().split()))
        width, need = math.ceil(len(text.split()) / containment), math.ceil(containment * len(own) - 1e-9)
        templates.append(f"('{label}', {own}, {width}, {need})")
    base = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) AS place, '{label}' "
            f"AS label FROM d"
        for p, label in license_join.PHRASES
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, own, width, need) AS (VALUES {", ".join(templates)}),
near AS (SELECT doc_id, label, own, width, need, w, unnest(range(1, len(w) + 1)) AS i FROM d JOIN t ON len(list_intersect(own, w)) >= need),
found AS (SELECT doc_id, label, max(len(list_intersect(own, w[i:i + width - 1]))) AS k, any_value(need) AS need, any_value(len(own)) AS n
  FROM near GROUP BY doc_id, label HAVING k >= any_value(need)),
m AS (SELECT doc_id, list(label) AS labels, max(k / CAST(n AS DOUBLE)) AS score FROM found GROUP BY doc_id),
b AS ({base}),
s AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(label) AS labels FROM b GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(s.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(s.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(m.score, 0) END AS score
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _resampled(buckets: int = 10_000, share: int = 25, seed: int = 7) -> str:
    """SQL of the importance resampling, with CRC32 bit by bit."""
    words = f"regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"
    return f"""
WITH w AS (SELECT true AS raw, doc_id AS id, {words} FROM documents UNION ALL SELECT false, item_id, {words} FROM benchmark),
f AS (SELECT raw, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
c AS (SELECT g, xor(list_reduce(list_transform(range(octet_length(encode(g))),
    lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)), lambda c, x: list_reduce(range(8),
    lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x)), 4294967295), 4294967295) % {buckets} AS b
  FROM (SELECT DISTINCT g FROM f)),
h AS (SELECT b, CAST(count(*) FILTER (WHERE raw) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE NOT raw) AS DOUBLE) AS t
  FROM f JOIN c USING (g) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (total_s + {buckets}) / ((s + 1) * (total_t + {buckets})))) AS BIGINT) AS gain
  FROM h, (SELECT sum(s) AS total_s, sum(t) AS total_t FROM h)),
m AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
  FROM f JOIN c USING (g) JOIN gains USING (b) WHERE raw GROUP BY id),
e AS (SELECT id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
    / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN m USING (id) WHERE raw),
r AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, id) AS place, count(*) FILTER (WHERE enough) OVER () AS n FROM e)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN enough AND place <= {share} * n // 100 THEN place END AS rank FROM r"""


ORACLE_SQL = {
    "op4_near_dedup": f"""
WITH RECURSIVE sets AS ({_sets(3, "documents", "doc_id")}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(reach.r) AS component_id, min(reach.r) = d.doc_id AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id""",
    "op5_block_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op6_license_scan": _licenses(),
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
firsts AS (SELECT g, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS p FROM win JOIN firsts USING (g)
  WHERE {'d': doc_id, 'i': i} > f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, j: p IS NULL OR NOT list_contains(p, j)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op11_importance_resampling": _resampled(),
    "op10_decontamination": f"""
WITH sets AS ({_sets(5, "documents", "doc_id")}), items AS ({_sets(5, "benchmark", "item_id")}),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / CAST(n AS DOUBLE) AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM sets JOIN items USING (g) GROUP BY ALL) JOIN sizes USING (item_id)
WHERE n_shared >= 0.8 * n - 1e-9""",
}
