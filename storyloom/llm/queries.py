"""One query per operator, with production parameters over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, centroids, html, metricjoin, neardup, packing, periodic, quality, secrets, substring, urls, warc


def _vocab() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated passage; documents without one have no row."""
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), _vocab(), with_ids=False).drop("ids")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, and the segments: spans in milliseconds, and a digest of their tensors."""
    found = audio.audio_features(_table(spark, sf_dir, "documents"), with_media=False)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start_ms"].cast("string"), x["end_ms"].cast("string"))), ",")
    tensors = F.sha2(F.array_join(F.transform(F.flatten("patches"), lambda x: x.cast("string")), ","), 256)
    return found.withColumns({"n_segments": F.size("spans").cast("long"), "spans": spans, "patches_sha256": tensors}).drop("patches")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality label under its id."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return urls.judge(_table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    kinds = F.transform("findings", lambda x: x["kind"])
    others = [F.size(F.array_remove(kinds, k)) for k in secrets.BASE]
    count = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(secrets.BASE, others, strict=True)]
    base = F.sha2(secrets.joined(F.col("findings"), secrets.BASE), 256).alias("base_sha256")
    return found.select("doc_id", *count, base, secrets.joined(F.col("findings")).alias("spans"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("score")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocab()).drop("ids")


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted repetitions: the words of a tenth of the ids repeat from some place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = words[a : a + p]
    return words[:a] + (own * -(-(n - a) // p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equally long runs the first is told, then that with the smallest period."""
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), change=periodic_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    longest = found.withColumn("best", best).select("*", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"))
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_warc, op4_audio, op5_url_filter, op6_secrets, op7_html_extract, op8_quality, op9_near_dedup, op10_packing, op11_jaccard_join, op12_periodic_runs, op13_centroids)}

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


_TWO = f"regexp_matches(host, '{urls.TWO_LEVELS}')"


def _rules_sql() -> tuple[str, str]:
    cases = [(f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'", h + p, v) for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
    return tuple("CASE " + " ".join(f"WHEN {test} THEN '{x[k]}'" for test, *x in cases) + " END" for k in (0, 1))


def _level_sql(name: str, counts: str, key: str, parent: str, parent_key: str) -> str:
    """One level of shrinkage as two CTEs."""
    return f"""{name}_p AS (SELECT c.{key} AS key, c.n, c.good, p.mean AS prior FROM {counts} c JOIN {parent} p ON p.key = c.{parent_key}),
{name}_m AS (SELECT sum(n * pow(good / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS noise, sum((n - 1) * prior * (1 - prior)) AS room FROM {name}_p WHERE n > 1),
{name}_s AS (SELECT CASE WHEN room > 0 THEN least({urls.MOST}, greatest({urls.LEAST}, (1 - greatest(1e-9, (spread - noise) / room)) / greatest(1e-9, (spread - noise) / room))) ELSE {urls.MOST} END AS strength FROM {name}_m),
{name} AS (SELECT key, good + strength * prior AS a, n - good + strength * (1 - prior) AS b, (good + strength * prior) / (n + strength) AS mean FROM {name}_p, {name}_s)"""


def _urls_sql() -> str:
    rule, verdict = _rules_sql()
    return f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
m AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[CASE WHEN {_TWO} THEN -3 ELSE -2 END:], '.') AS domain, array_to_string(string_split(host, '.')[CASE WHEN {_TWO} THEN -2 ELSE -1 END:], '.') AS suffix, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM p LEFT JOIN m USING (page_id) GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, '' AS root, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
root AS (SELECT '' AS key, (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM suffixes),
{_level_sql("by_suffix", "suffixes", "suffix", "root", "root")}, {_level_sql("by_domain", "domains", "domain", "by_suffix", "suffix")}, {_level_sql("by_host", "hosts", "host", "by_domain", "domain")}
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN host <> '' AND mean + {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN by_host h ON h.key = p.host"""


def _components_sql(size: int, percent: int) -> str:
    """Documents with the smallest id that links reach; the caller adds columns and _COMPONENTS_FROM."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN s sa ON sa.doc_id = a.doc_id JOIN s sb ON sb.doc_id = b.doc_id
GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(len(sa.sh)) + any_value(len(sb.sh)) - count(*))),
r AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id"""


_COMPONENTS_FROM = " FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.sh)"


def _centroids_sql() -> str:
    """All rounds of k-means, each assignment (a) and each set of centroids (c) as a CTE."""
    c = centroids
    parts = [
        f"vec AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {c.WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.WIDTH})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v FROM (SELECT sha256(concat('{c.SEED}:', CAST(vec_id AS VARCHAR))) AS h, v FROM vec ORDER BY h LIMIT {c.CLUSTERS}) x)",
    ]
    for r in range(c.ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (SELECT vec_id, vec.v, j, CAST(list_sum(list_transform(list_zip(vec.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM vec, c{r}) x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if r < c.ROUNDS:
            sums = f"SELECT j, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) y GROUP BY j, p"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM ({sums}) z GROUP BY j) m ON m.j = c{r}.j)")
    last = c.ROUNDS
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a{last}.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON c{last}.j = a{last}.j"""


#: The article's markup as the tables have it: b is inline, every other tag parts blocks.
_TAGS_OUT = "regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: DuckDB SQL by query. The others rest on hashes, merges, signals or packing that SQL cannot express; tests/llm compares
#: those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN bytes >= {warc.LEAST} AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages) x""",
    "op5_url_filter": _urls_sql(),
    "op7_html_extract": f"""SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TAGS_OUT},
'&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '{_WHITE}+', ' ', 'g')) AS text FROM pages) x""",
    "op9_near_dedup": _components_sql(neardup.SHINGLE, neardup.PERCENT) + ", s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept" + _COMPONENTS_FROM,
    "op11_jaccard_join": _components_sql(metricjoin.SHINGLE, metricjoin.PERCENT) + _COMPONENTS_FROM,
    "op13_centroids": _centroids_sql(),
}
