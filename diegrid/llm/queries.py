"""The registered queries of the ten operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diegrid.llm import collocations, decontaminate, hard_negatives, language, licenses, mixing, ngram_join, packing, pii, secrets, space_curves, token_count, token_files
from diegrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its containment."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs.where("doc_id is not null"), items, ["doc_id"])


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space_curves.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (declared: lang, host: source) and all pages (declared: markup, address), each with the
    priors of its own table; doc_id is null for pages, page_id for documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.fit(docs.select(F.col("lang").alias("label"), "text"))
    of_docs = language.languages(language.documents_as_rows(docs, ["doc_id", "text"]), model, ["doc_id"])
    of_pages = language.languages(language.pages_as_rows(pages), model, ["page_id"])
    return (of_docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "language", "confidence", "keep")
            .union(of_pages.select(F.lit(None).cast("long"), "page_id", "language", "confidence", "keep")))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = ngram_join.components(docs, width=4, num=17, den=20)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.quantised(table(spark, sf_dir, "embeddings")))


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op10_ngram_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                              ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.c + ny.c - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) m ON m.node = d.doc_id
"""

SQL["op11_hard_negatives"] = """
WITH r AS MATERIALIZED (
    SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.id AS anchor, b.id, a.label = b.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM r a JOIN r b ON a.id % 100 = 0 AND b.id <> a.id),
p AS MATERIALIZED (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

SQL["op13_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT doc, lang, generate_subscripts(ps, 1) AS piece, unnest(ps) AS t FROM d),
w AS (SELECT doc, lang, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p)),
g AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, piece ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM g GROUP BY 1, 2),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1),
cuts AS (
    SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, 1 AS k, b.f AS a, x.f AS l, y.f AS r FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1
        JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2 WHERE b.f >= 10 AND NOT EXISTS (
            SELECT 1 FROM f3 t WHERE t.lang = b.lang AND ((t.w1 = b.w1 AND t.w2 = b.w2) OR (t.w2 = b.w1 AND t.w3 = b.w2)) AND 100 * t.f >= 50 * b.f)
    UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1
        JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
        JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
