"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collision_lsh, decontamination, fingerprints, language_id, lexical_search, merge_dropout, mixing, pii, secret_scan, sharding, simhash_dedup, token_alignment, url_filter, words
from .url_filter import DEFAULT, RULES


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, embeddings, benchmark = _table("documents"), _table("pages"), _table("embeddings"), _table("benchmark")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir), pages(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(pages(spark, sf_dir))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_lsh.nearest(embeddings(spark, sf_dir))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.duplicate_report(documents(spark, sf_dir))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_report(documents(spark, sf_dir))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_column(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_secret_scan,
        op3_url_filter,
        op4_nearest_neighbours,
        op5_simhash_dedup,
        op6_pii_pseudonyms,
        op7_merge_dropout,
        op8_sharding,
        op9_source_mix,
        op10_minhash_fingerprints,
        op11_token_alignment,
        op12_decontamination,
        op13_lexical_search,
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

_URL_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
numbered AS (SELECT *, row_number() OVER () AS n FROM parsed),
ranked AS (
  SELECT n, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC) AS k
  FROM numbered JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '{DEFAULT}') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (n)
"""

_CRC_SQL = """CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT)"""

_SHARD_SQL = f"""
WITH crc AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
base AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + {sharding.RECORD_OVERHEAD} AS size,
    {_CRC_SQL} AS text_crc32,
    md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n,
    count(*) OVER () AS total FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / (2 * n), source NULLS LAST, r) - 1 AS p FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * {sharding.SHARDS} // total AS INTEGER) AS shard,
  CAST(p - ((p * {sharding.SHARDS} // total) * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

_MIX_SQL = f"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h, row_number() OVER () AS id
  FROM documents),
sources AS (
  SELECT source, source_size, {mixing.EPOCHS} * CAST(source_size AS DOUBLE) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(mixing.WEIGHTS))} END::DOUBLE AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source)),
filled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, (SELECT arg_min(level, cap / weight) FROM filled WHERE level * weight <= cap) * weight) END AS target FROM filled),
queue AS (
  SELECT b.*, t.source_size, t.weight, t.target, t.budget,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id NULLS FIRST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    row_number() OVER (ORDER BY b.source NULLS LAST, b.h, b.doc_id NULLS FIRST, b.size) AS place
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT id, size, budget, place, CAST(upto + e * source_size AS DOUBLE) / weight AS finish FROM queue, range({mixing.EPOCHS}) r(e) WHERE size > 0),
served AS (SELECT id, size, budget, sum(size) OVER (ORDER BY finish, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM copies),
taken AS (SELECT id, CAST(sum(size) AS BIGINT) AS taken FROM served WHERE words <= budget GROUP BY id)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken FROM queue LEFT JOIN taken USING (id)
"""

#: Kinds as ``secret_scan.RULES`` has them: the whole, the lead before the counted part, and its least length.
_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?""", "[A-Za-z0-9+/_.=-]+", 6),
    ("access", "", "AKIA[A-Z0-9]+", 20),
    ("hex", "", "[0-9a-f]+", 24),
    ("github", "", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "", "xox[abeoprs]-[A-Za-z0-9-]+", 15),
    ("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
    ("pem", "", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
)


def _spans_sql(order: int, kind: str, lead: str, body: str, least: int) -> str:
    """Matches stand between the pieces that they split a text into, which gives their places."""
    counted = f"length(regexp_replace(m, '^{lead}', ''))" if lead else "length(m)"
    return f"""SELECT id, {order} AS k, '{kind}' AS kind, pos AS a, pos + length(m) AS b FROM (
    SELECT id, m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS pos FROM (
      SELECT id, p, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT id, regexp_split_to_array(text, '{lead}{body}') AS p, regexp_extract_all(text, '{lead}{body}') AS ms FROM texts))) WHERE {counted} >= {least}"""


_SECRET_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_spans_sql(i, *rule) for i, rule in enumerate(_SECRETS))}),
listed AS (SELECT id, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans, string_agg(CASE WHEN k < 3 THEN kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) END, ',' ORDER BY a, k) AS base,
    count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) AS n_secrets FROM found GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_secrets, 0) AS n_secrets
FROM texts LEFT JOIN listed USING (id)
"""

#: Exact neighbours. The search is exact too on tables of up to ``FLOOR`` + k vectors, as at scale 0.01; beyond, recall is tested.
_NEAREST_SQL = """
WITH fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scored AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id, list_reduce(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y) AS score
  FROM fine q JOIN fine c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '{words.PATTERN}')"

_LEAK_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {decontamination.WINDOW - 1}], ' ') AS gram, least(len(w), {decontamination.WINDOW}) AS m
  FROM items, range(1, greatest(len(w) - {decontamination.WINDOW - 2}, 2)) r(i) WHERE len(w) > 0),
grams AS (SELECT d, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM docs, (SELECT DISTINCT m FROM windows), range(1, len(w) - m + 2) r(i)),
hits AS (SELECT DISTINCT d, i, m, item_id FROM grams JOIN windows USING (gram, m)),
hit AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT d, i, m FROM hits), range(i, i + m) r(p) GROUP BY d),
named AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (d) LEFT JOIN named USING (d)
"""

_SEARCH_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs),
counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term),
asked AS (SELECT DISTINCT b, item_id, term FROM (SELECT row_number() OVER () AS b, item_id, unnest({_TERMS}) AS term FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS wt FROM counts, totals GROUP BY term, n),
scored AS (
  SELECT b, item_id, doc_id, d, CAST(sum(wt * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * len(w) * n // l)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (d), totals GROUP BY b, item_id, doc_id, d),
placed AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS FIRST, d) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM placed WHERE r <= {lexical_search.K}
"""

ORACLE: dict[str, str] = {"op12_decontamination": _LEAK_SQL, "op13_lexical_search": _SEARCH_SQL, "op4_nearest_neighbours": _NEAREST_SQL, "op2_secret_scan": _SECRET_SQL, "op3_url_filter": _URL_SQL, "op8_sharding": _SHARD_SQL, "op9_source_mix": _MIX_SQL}
