"""URL filters: pattern rules, indexed by their rarest literal token.

Each rule becomes a regular expression and is filed under one token that any matching URL must hold:
the one that fewest URLs hold. The tokens of a URL fetch its candidate rules by an equi-join, and only
those run their expression. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, table

#: The rules that the query applies: verdict, then host/path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: What a URL gets that no rule fits.
DEFAULT = "allow"
#: The index is broadcast up to so many rules (a rule takes some hundred bytes); larger ones are joined by shuffle.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(fold(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _tokens(host: Column, path: Column) -> Column:
    """Host labels and closed path segments, each marked as what it is."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(labels, segments))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table: rule is host/path, the path a prefix."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add host, path, rule and verdict to a table of URLs; columns of these names are replaced.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path. The longest
    fitting rule wins; between rules of one length, the smaller text, then the smaller verdict. Where no
    rule fits, rule is null and the verdict is the default. A null URL or one without :// has an empty
    host and path. Rows are judged once per distinct (host, path), so repeated URLs, however many, fold
    in partial aggregates before any shuffle; every input row comes back.
    """
    held = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    sites = held.select("host", "path").distinct()
    tokens = sites.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))

    rules = rules.select("verdict", "rule").where(F.col("rule").isNotNull()).distinct()
    own_host, own_path = F.substring_index("rule", "/", 1), F.expr("substring(rule, instr(rule, '/'))")
    rules = rules.withColumns({"pattern": F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(own_host), _quoted(own_path)), "token": F.explode(_tokens(own_host, own_path))})
    small = rules.select("rule").distinct().count() <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    seen = tokens.join(hint(rules.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = Window.partitionBy("rule", "verdict").orderBy(F.coalesce("urls", F.lit(0)), "token")
    index = rules.join(seen, "token", "left").withColumn("nth", F.row_number().over(rarest)).where("nth = 1").select("token", "rule", "verdict", "pattern")

    fits = tokens.join(hint(index), "token").where(F.expr("regexp_like(concat(host, path), pattern)"))
    judged = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    return (
        held.drop("rule", "verdict")
        .join(judged, ["host", "path"], "left")
        .withColumn("rule", F.col("best.rule"))
        .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
        .drop("best")
    )


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, rule) AS (
  VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')
), r2 AS (SELECT *, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r),
m AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM s) JOIN r2
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.host = m.host AND s.path = m.path
"""
