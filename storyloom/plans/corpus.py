"""The story tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Everything is arithmetic on keys, so that both engines agree. `{array(...)}` places are filled per dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-01 00:00:00"

_STORIES = """
SELECT d.doc_id AS story_id, trim(replace(substr(d.text, 1, 40), chr(10), ' ')) AS title, d.doc_id % 97 AS author_id,
  concat('Author', CAST(d.doc_id % 97 AS STRING)) AS author_name, d.text AS summary, d.doc_id % 19 = 0 AS is_crossover,
  CASE d.doc_id % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'K+' WHEN 2 THEN 'T' WHEN 3 THEN 'M' END AS rating, d.lang AS language,
  CASE d.doc_id % 8 WHEN 0 THEN A['Romance'] WHEN 1 THEN A['Hurt/Comfort', 'Adventure'] WHEN 2 THEN A['Humor', 'Parody']
    WHEN 3 THEN A['Sci-Fi'] WHEN 4 THEN A['Drama', 'Romance'] WHEN 5 THEN A['Horror'] WHEN 6 THEN A['Mystery', 'Angst'] ELSE E[] END AS genres,
  CASE d.doc_id % 7 WHEN 0 THEN A['Harry P.', 'Ginny W.', 'Neville L.'] WHEN 1 THEN A['Draco M.', 'Percy J.', 'Anthony G.', 'OC']
    WHEN 2 THEN A['Harry P.', 'Ginny W.', 'Ron W.', 'Hermione G.'] WHEN 3 THEN A['OC'] WHEN 4 THEN A['Sebastian M.', 'Ciel P.']
    WHEN 5 THEN A['Crowley', 'Aziraphale'] ELSE E[] END AS characters,
  CASE d.doc_id % 7 WHEN 0 THEN A[A['Harry P.', 'Ginny W.']] WHEN 1 THEN A[A['Draco M.', 'Percy J.']]
    WHEN 2 THEN A[A['Harry P.', 'Ginny W.'], A['Ron W.', 'Hermione G.']] WHEN 5 THEN A[A['Crowley', 'Aziraphale', 'Crowley']] ELSE EE[] END AS ships,
  CAST(d.doc_id % 31 + 1 AS INT) AS chapter_count,
  CASE WHEN d.doc_id % 41 = 0 THEN NULL WHEN d.doc_id % 43 = 0 THEN 0 ELSE CAST(d.n_chars * 3 AS INT) END AS word_count,
  CAST((d.doc_id * 104729) % 300 AS INT) AS review_count, CAST((d.doc_id * 7919) % 500 AS INT) AS favorite_count,
  CAST((d.doc_id * 31) % 250 AS INT) AS follow_count, CASE WHEN d.doc_id % 3 = 0 THEN 'complete' ELSE 'in_progress' END AS status,
  CAST(DATE '2015-01-01' + CAST(d.doc_id % 3300 AS INT) AS TIMESTAMP) AS published_at,
  CASE WHEN d.doc_id % 37 <> 0 THEN CAST(DATE '2015-01-01' + CAST(d.doc_id % 3300 + d.doc_id % 400 AS INT) AS TIMESTAMP) END AS updated_at,
  CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id + 1000 END AS cover_image_id,
  CAST(DATE '2020-01-01' AS TIMESTAMP) AS first_seen_at, CAST(DATE '2024-06-01' - CAST(d.doc_id % 365 AS INT) AS TIMESTAMP) AS last_seen_at,
  CASE WHEN d.doc_id % 29 = 0 THEN CAST(DATE '2024-01-01' AS TIMESTAMP) END AS deleted_at
FROM documents d
"""

TABLES = {
    "stories_base": _STORIES,
    "stories": "SELECT b.*, e.embedding AS summary_embedding FROM stories_base b LEFT JOIN embeddings e ON e.vec_id = b.story_id",
    "live": "SELECT * FROM stories_base WHERE deleted_at IS NULL",
    "fandoms": """
SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, concat('Fandom ', substr(source, 4)) AS name,
  CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'anime' WHEN 2 THEN 'game' END AS section_slug,
  CASE WHEN CAST(substr(source, 4) AS INT) % 4 <> 3 THEN concat('Fandom-', substr(source, 4)) END AS fandom_slug,
  100 + CAST(substr(source, 4) AS INT) AS category_id,
  CASE WHEN CAST(substr(source, 4) AS INT) % 5 <> 0 THEN CAST(substr(source, 4) AS INT) * 37 % 11 END AS story_count
FROM documents""",
    "story_fandoms": """
SELECT doc_id AS story_id, CAST(substr(source, 4) AS INT) AS fandom_id FROM documents
UNION ALL SELECT doc_id, (CAST(substr(source, 4) AS INT) + 1) % 20 FROM documents WHERE doc_id % 19 = 0""",
    "pairs": """
SELECT DISTINCT least(100 + s, 100 + (s + 1 + k) % 20) AS fandom_id_a, greatest(100 + s, 100 + (s + 1 + k) % 20) AS fandom_id_b,
  CAST(NULL AS STRING) AS slug_a, concat('stored-', CAST(greatest(s, (s + 1 + k) % 20) AS STRING)) AS slug_b
FROM (SELECT CAST(substr(source, 4) AS INT) AS s, CAST(doc_id % 3 AS INT) AS k FROM documents WHERE doc_id % 19 = 0) x WHERE s < 20""",
    "crawl_state": """
SELECT concat('browse:', section_slug, '/', fandom_slug) AS surface_key, id % 7 AS last_page, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_exhausted,
  CAST(id * 25 AS BIGINT) AS rows_ingested, CASE WHEN id % 6 = 1 THEN 'blocked' END AS last_error FROM fandoms WHERE section_slug IS NOT NULL AND id % 8 <> 5
UNION ALL SELECT concat('crossover:', CAST(fandom_id_a AS STRING), '/', CAST(fandom_id_b AS STRING)), 1, fandom_id_a % 2 = 0, CAST(10 AS BIGINT), NULL FROM pairs WHERE fandom_id_a % 4 <> 3""",
}
#: Tables that each one's SQL reads.
NEEDS = {
    "stories_base": ("documents",), "stories": ("stories_base", "embeddings"), "live": ("stories_base",), "fandoms": ("documents",),
    "story_fandoms": ("documents",), "pairs": ("documents",), "crawl_state": ("fandoms", "pairs"),
}
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spark_sql(text: str) -> str:
    """The arrays' Spark form: A[...] literals, E[] and EE[] empty arrays of strings and of arrays."""
    text = text.replace("EE[]", "CAST(array() AS ARRAY<ARRAY<STRING>>)").replace("E[]", "CAST(array() AS ARRAY<STRING>)")
    while re.search(r"\bA\[[^\[\]]*\]", text):
        text = re.sub(r"\bA\[([^\[\]]*)\]", r"array(\1)", text)
    return text


def duck_sql(text: str) -> str:
    text = re.sub(r"\bEE\[\]", "CAST([] AS VARCHAR[][])", re.sub(r"\bE\[\]", "CAST([] AS VARCHAR[])", text))
    return re.sub(r"\bA\[", "[", text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one derived from them."""
    if name in DRIVER:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = spark_sql(TABLES[name])
    args = {n: load(spark, sf_dir, n) for n in NEEDS[name]}
    for n in args:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **args)


def oracle(text: str) -> str:
    """A DuckDB query over the derived tables that it names, as one statement."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in NEEDS and name not in wanted:
            for n in NEEDS[name]:
                need(n)
            wanted.append(name)

    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            need(name)
    heads = ", ".join(f"{n} AS ({duck_sql(TABLES[n])})" for n in wanted)
    body = duck_sql(text).strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}" if heads else body
    return f"WITH {heads} {body}" if heads else body
