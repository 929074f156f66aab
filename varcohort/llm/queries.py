"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster
from .common import shared_dir, table
from .decontaminate import contamination
from .filters import audit
from .html_text import extract
from .neighbours import nearest
from .packing import pack
from .pii import find_personal_data
from .repeats import remove_repeats
from .secrets import scan_into
from .sharding import reshard
from .simhash import near_duplicates
from .tokens import token_counts
from .toxicity import toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"  # a ledger of this run's own: whoever keeps one passes its path to scan_into
    return scan_into(versions, ledger).withColumnRenamed("path", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), factor=1.05)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")  # by now in twelve shards by source, of which one may hold a third of all
    return reshard(docs, F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 12)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_suffix_dedup, op3_secret_scans, op4_token_counts, op5_toxicity, op6_packing, op7_personal_data, op8_main_text, op9_simhash, op10_neighbours,
        op11_filter_audit, op12_resharding, op13_centroids,
    )
}

#: Spans as DuckDB finds them: what lies between the matches and the matches themselves, summed up.
SPANS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
r(kind, rank, pattern, counted) AS (VALUES {rules}),
m AS (SELECT doc_id, kind, rank, counted, pattern, regexp_extract_all(x, pattern) AS hits, regexp_split_to_array(x, pattern) AS gaps
      FROM t, r WHERE regexp_matches(x, pattern)),
u AS (SELECT doc_id, kind, rank, counted, pattern, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
f AS (SELECT doc_id, kind, rank, counted, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, hit FROM e WHERE {test}),
g AS (SELECT doc_id, {counts},
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) FILTER (counted) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}) AS spans
      FROM f GROUP BY doc_id)
SELECT t.doc_id, {outer}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


def spans_sql(rules: list[tuple[str, str, bool]], test: str, order: str) -> str:
    quoted = ", ".join("('{}', {}, '{}', {})".format(k, i, p.replace("'", "''"), str(base).lower()) for i, (k, p, base) in enumerate(rules))
    base = [k for k, _, b in rules if b]
    return SPANS.format(
        rules=quoted, test=test, order=order,
        counts=", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base),
        outer=", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base),
    )


#: Every document's mask, then each order and step over all masks, without prefixes.
AUDIT = r"""
WITH RECURSIVE letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o, n) AS (SELECT '', 0 UNION ALL SELECT o || l, n + 1 FROM orders, letters WHERE n < 5 AND NOT contains(o, l)),
steps AS (
  SELECT o AS filter_order, step, (SELECT bit FROM letters WHERE l = o[step]) AS bit, coalesce((SELECT CAST(sum(bit) AS INT) FROM letters WHERE contains(o[:step - 1], l)), 0) AS before
  FROM orders, range(1, 6) r(step) WHERE n = 5),
words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, [s FOR s IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF s <> ''] AS w FROM documents),
masks AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS INT) + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS INT) AS mask
  FROM words),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
counted AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
         CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""


def centroids_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out, over every component of every vector."""
    near = """near{r} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d
        FROM (SELECT i, c, sum((v.q - m.q) * (v.q - m.q)) AS d FROM parts v JOIN mid{r} m USING (j) GROUP BY i, c) GROUP BY i)"""
    mean = """mid{s} AS MATERIALIZED (SELECT c, j, coalesce(u.q, m.q) AS q FROM mid{r} m
        LEFT JOIN (SELECT c, j, CAST(floor(sum(q)::DOUBLE / count(*)) AS BIGINT) AS q FROM near{r} JOIN parts USING (i) GROUP BY c, j) u USING (c, j))"""
    steps = ",\n".join(f"{near.format(r=r)},\n{mean.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS i, vec_id, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT i, unnest(q) AS q, generate_subscripts(q, 1) AS j FROM kept),
chosen AS (SELECT i, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c FROM kept QUALIFY c < {k}),
mid0 AS MATERIALIZED (SELECT c, j, q FROM chosen JOIN parts USING (i)),
{steps},
{near.format(r=rounds)},
names AS (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY j)) AS sha FROM mid{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM near{rounds} JOIN kept USING (i) JOIN names USING (c)
"""


ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ORACLES: dict[str, str] = {
    "op3_secret_scans": spans_sql(
        [
            ("assign", ASSIGN, True), ("access", "AKIA[A-Z0-9]{16,}", True), ("hex", "[0-9a-f]{24,}", True),
            ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", False), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
        ],
        "kind <> 'assign' OR length(regexp_extract(hit, pattern, 1)) >= 6",
        "start, rank",
    ),
    "op11_filter_audit": AUDIT,
    "op13_centroids": centroids_sql(),
}
