"""URL filters: host-suffix and path-prefix expressions against a rule table, by hash prefix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import T, join_groups

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Bytes of a digest that join; the whole digest confirms.
PREFIX_BYTES = 4


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rule_host, rule_path, rule_verdict`` of rules; a table of any size with these columns serves as well."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def match_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit, the longest
    (host and path together) wins, then the host that sorts first, then ``block``. No rule: ``default``.

    Every distinct (host, path) is expanded into its host suffixes times its path prefixes, no more of either than the
    rules have labels, path pieces and odd path lengths. A prefix of the SHA-256 of each expression equi-joins with the rules';
    the whole digest, then host and path themselves, confirm. Spark broadcasts the rules if their known size
    allows it, else it shuffles both sides and splits hot prefixes. One fold of a key's few matches remains, and
    its result joins back to the pages (``join_groups``): a URL with any share of all rows, or no URL, is expanded once, and its rows stay spread.

    Null and odd URLs have an empty host and path, which no rule fits. Repeated pages give repeated rows. Columns
    named ``host, path, rule, verdict`` are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    cut = F.size(F.split("rule_path", "/"))
    rules = rules.dropDuplicates()
    odd = F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))
    bounds = rules.agg(F.max(F.size(F.split("rule_host", "\\."))).alias("labels"), F.max(cut).alias("pieces"), F.sort_array(F.collect_set(odd)).alias("lengths")).first()
    labels, pieces, lengths = bounds["labels"] or 0, bounds["pieces"] or 0, bounds["lengths"] or []

    keys = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias(f"{T}n"))
    # substring_index with a negative count gives the last labels of a host; a count beyond its labels gives it whole
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, labels + 1))))
    whole = [F.when(F.size(F.split("path", "/")) > k, F.concat(F.substring_index("path", "/", k), F.lit("/"))) for k in range(1, pieces)]
    odds = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    prefixes = F.array_distinct(F.array_compact(F.array(*whole, *odds))) if whole or odds else F.array().cast("array<string>")
    asked = keys.where(F.col("host") != "").withColumn(f"{T}h", F.explode(suffixes)).withColumn(f"{T}p", F.explode(prefixes)).withColumn(f"{T}digest", _expression(F.col(f"{T}h"), F.col(f"{T}p")))
    asked = asked.withColumn(f"{T}key", F.substring(f"{T}digest", 1, 2 * PREFIX_BYTES))
    known = rules.withColumn(f"{T}rule_digest", _expression(F.col("rule_host"), F.col("rule_path"))).withColumn(f"{T}rule_key", F.substring(f"{T}rule_digest", 1, 2 * PREFIX_BYTES))
    near = asked.join(known, F.col(f"{T}key") == F.col(f"{T}rule_key"))
    fits = near.where((F.col(f"{T}digest") == F.col(f"{T}rule_digest")) & (F.col(f"{T}h") == F.col("rule_host")) & (F.col(f"{T}p") == F.col("rule_path")))
    rank = F.struct((-F.length(f"{T}h") - F.length(f"{T}p")).alias("length"), F.col(f"{T}h").alias("h"), F.when(F.col("rule_verdict") == "block", 0).otherwise(1).alias("kind"), F.concat(f"{T}h", f"{T}p").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.min(rank).alias(f"{T}best"))
    known_keys = keys.join(best, ["host", "path"], "left").select(F.col("host").alias(f"{T}host"), F.col("path").alias(f"{T}path"), f"{T}n", f"{T}best")
    joined = join_groups(parsed, known_keys, {"host": f"{T}host", "path": f"{T}path"}, f"{T}n")
    return joined.select(*keep, "host", "path", F.col(f"{T}best.rule").alias("rule"), F.coalesce(F.col(f"{T}best.verdict"), F.lit(default)).alias("verdict"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page, by ``RULES``."""
    return match_urls(pages.select("page_id", "url"), rule_table(pages.sparkSession)).drop("url")
