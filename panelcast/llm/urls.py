"""URL filters: rules on host suffixes and path prefixes, found by hash joins.

A url is expanded into every pair of a host suffix and a leading directory of its path, as far as any
rule has labels and directories. A rule is filed under its host and the directory of its path. Pairs meet
on four bytes of their SHA-256, the whole digest and the whole path prefix are then confirmed, and the
longest rule that fits decides.

Defined results: a null url, or one without ``://``, has an empty host and path and fits only a rule
without host; rules of one length that fit alike do not exist (they would be the same rule; of repeated
rules ``block`` wins); repeated pages come back as often as they came in; columns that the operator adds replace columns of the
same name, others stay as they are.

Every distinct host and path is judged once. What was found comes back to the pages by host and path; where a host and
path has over ``HOT`` pages, its pages are dealt by the hash of the whole page into ``SALTS`` parts first, so that null and
very common urls are spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.components import HOT, SALTS
from panelcast.llm.text import hidden
from panelcast.sources.stage import stage

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Bytes of filed rules that are sent to every task; a rule has about ``FILED_BYTES`` besides twice its text.
RULE_BYTES = 8 << 20
FILED_BYTES = 256


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``."""
    split = lambda group: F.coalesce(
        F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return pages.withColumn("host", lower_ascii(split(1))).withColumn("path", split(2))


def directory(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filed(rules: DataFrame) -> DataFrame:
    """Rules with the full digest of host and directory, and its first four bytes."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    full = digest(F.col("host"), directory(F.col("path")))
    return one.select(
        F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), "verdict",
        full.alias("rule_digest"), F.substring(full, 1, 8).alias("short"))


def expanded(urls: DataFrame, most_labels: int, most_directories: int) -> DataFrame:
    """Rows of ``host``, ``path``, and the digest of each pair of suffix and directory that a rule could have."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(1, most_labels)), F.size(labels))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."))
    steps = F.split("path", "/", most_directories + 1)  # as far as rules go; what follows stays in one piece
    deepest = F.least(F.lit(most_directories), F.size(F.split("path", "/", -1)) - 1)
    directories = F.transform(
        F.sequence(F.lit(0), deepest),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))))
    pairs = urls.withColumn("_suffix", F.explode(suffixes)).withColumn("_directory", F.explode(directories))
    full = digest(F.col("_suffix"), F.col("_directory"))
    return pairs.select("host", "path", full.alias("digest"), F.substring(full, 1, 8).alias("short"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, hot: int = HOT) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to pages with a ``url``."""
    rows, own = hidden(pages.drop("host", "path", "rule", "verdict"), ("url",))
    parts = with_parts(rows)
    reach = rules.agg(
        F.max(F.size(F.split("host", r"\.", -1))), F.max(F.size(F.split("path", "/", -1)) - 1),
        F.sum(FILED_BYTES + 2 * F.coalesce(F.octet_length(F.concat("host", "path")), F.lit(0)))).first()
    places = stage(parts.groupBy("host", "path").agg(F.count("*").alias("n")), "url_places")
    pairs = expanded(places.select("host", "path"), reach[0] or 1, reach[1] or 0)
    if (reach[2] or 0) <= RULE_BYTES:
        met = pairs.join(F.broadcast(filed(rules)), "short")
    else:
        met = pairs.hint("merge").join(filed(rules), "short")
    fits = met.where(
        (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("best"))
    key = ["host", "path"]
    if (places.agg(F.max("n")).first()[0] or 0) > hot:
        hashable = [c for c, t in rows.dtypes if "map<" not in t and t != "variant"]
        parts = parts.withColumn("salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
        best = parts.groupBy(*key, "salt").agg(F.lit(1).alias("one")).drop("one").join(best, key)
        key = [*key, "salt"]
    judged = parts.join(best, key, "left")
    return judged.select(
        *own, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url")
    return judge(rows, rule_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
