"""Queries of the training-data operators: thin bindings to the tables, by the contract of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of each document."""
    from .near_duplicates import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90, counted=True)
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


def remainder(of: int):
    """crc32 of the id as text, modulo ``of``."""
    from pyspark.sql import functions as F

    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s FROM w, unnest(range(1, len(w) - least(len(w), 3) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON d.doc_id = m.a
"""

ORACLES["op2_ngram_jaccard_links"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s FROM w, unnest(range(1, len(w) - least(len(w), 3) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n, 0) AS n_links, m.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON d.doc_id = k.a JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON d.doc_id = m.a
"""

ORACLES["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM b, unnest(range(1, len(w) - k + 2)) t(i)),
h AS (SELECT x.doc_id, x.i, x.k, g.item FROM (SELECT doc_id, i, z.k, array_to_string(w[i : i + z.k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM g) z, unnest(range(1, len(w) - z.k + 2)) t(i)) x JOIN g ON x.g = g.g AND x.k = g.k),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, k)) t(j) GROUP BY 1),
e AS (SELECT doc_id, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(e.n, 0) AS n_items, coalesce(e.s, sha256('')) AS items_sha256,
       coalesce(c.n_hit > 0 AND 20 * c.n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_languages, languages

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, remainder(3) != 1)
    return languages(docs, model, remainder(3) == 1)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import through_archives

    return through_archives(table(spark, sf_dir, "pages"))


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@query
def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    from pyspark.sql import functions as F

    from .chat import preference_pairs

    conv = F.col("conv_id")
    return preference_pairs(table(spark, sf_dir, "conversations"), F.shiftright(conv, 1).cast("long"), F.pmod(conv, F.lit(2)) == 0)


ORACLES["op5_preference_pairs"] = """
WITH t AS (
  SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, conv_id % 2 = 0 AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
differ AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k
  FROM (SELECT * FROM t WHERE c) a FULL JOIN (SELECT * FROM t WHERE NOT c) b ON a.pair_id = b.pair_id AND a.k = b.k
  WHERE a.role IS NULL OR b.role IS NULL OR a.role <> b.role OR a.text <> b.text),
p AS (
  SELECT t.pair_id, coalesce(min(d.k) - 1, max(t.k)) AS n FROM t LEFT JOIN differ d ON t.pair_id = d.pair_id GROUP BY t.pair_id),
r AS (
  SELECT t.*, p.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s,
         coalesce(sum(CASE WHEN k > n THEN length(role) + length(text) + 24 END) OVER (PARTITION BY t.pair_id, c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM t JOIN p ON t.pair_id = p.pair_id),
m AS (
  SELECT *, CAST(pos + 13 + length(role) AS BIGINT) || ':' || CAST(pos + 23 + length(role) + length(text) AS BIGINT) AS span FROM r)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE c AND k <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE c AND k > n), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE NOT c AND k > n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE c AND k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (WHERE NOT c AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return quality_scores(docs, model, remainder(4) == 2)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
