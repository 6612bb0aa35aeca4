"""URL rules with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains where the path starts
with its own, the longest rule wins. Rules are a table of any size: a url's host suffixes and the
prefix lengths in use per rule host turn matching into equi-joins.

Urls that redirect to each other, or name each other as canonical link, are aliases: connected
components over those edges. A url without a rule of its own is allowed if a rule allows one of its
aliases explicitly, else blocked if a rule blocks one of them, else allowed. Aliases are whole urls
with their query strings (scheme and fragment do not tell pages apart); rules see host and path.

Defined results: a null url, or one without ://, has an empty host and path, no rule and is
allowed; a null html has no links; repeated rows stay repeated; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.session import written

from .components import connected_components

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tail(url: Column) -> Column:
    """The query string with its question mark, or nothing."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*(\?[^#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    """(verdict, rule) pairs, the rule being host + path, as a rule table (host, path, rule, verdict)."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def match(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """keys (host, path: distinct) -> those that a rule fits, with rule and verdict of the longest."""
    rules = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "rule", "verdict")
    lengths = rules.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lens"))  # distinct lengths of one host's rules
    parts = F.split("host", r"\.")
    suffixes = F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> array_join(slice(split(host, '\\.'), i, size(split(host, '\\.'))), '.'))")
    tried = keys.where(parts.isNotNull() & (F.col("host") != "")).select("host", "path", F.explode(suffixes).alias("rh"))
    tried = tried.join(lengths, "rh").select("host", "path", "rh", F.explode("lens").alias("n")).where(F.length("path") >= F.col("n"))
    found = tried.withColumn("rp", F.expr("substring(path, 1, n)")).join(rules, ["rh", "rp"])
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rh"), "rule"))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges that pages state, every one of them: canonical links and immediate redirects, as (host, path, tail, to_host, to_path, to_tail)."""
    attr = r"""\s*=\s*["']?([^"'>\s]+)"""
    rel, equiv = r"""\brel\s*=\s*["']?canonical\b""", r"""\bhttp-equiv\s*=\s*["']?refresh\b"""
    text = F.coalesce(F.col(html), F.lit(""))
    found = [
        rf"(?i)<link\b[^>]*{rel}[^>]*\bhref{attr}",
        rf"(?i)<link\b[^>]*\bhref{attr}[^>]*{rel}",
        rf"(?i)<meta\b[^>]*{equiv}[^>]*\burl{attr}",
        rf"(?i)<meta\b[^>]*\burl{attr}[^>]*{equiv}",
    ]
    every = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(x), F.lit(1)) for x in found]))
    own = [f(F.col(url)).alias(n) for f, n in ((host, "host"), (path, "path"), (tail, "tail"))]
    df = pages.select(*own, F.explode(F.filter(every, lambda x: x != "")).alias("to")).withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    absolute = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(F.lit("http://"), F.col("host"), F.col("to")))
        .when(F.col("to").startswith("?"), F.concat(F.lit("http://"), F.col("host"), F.col("path"), F.col("to")))
        .otherwise(F.concat(F.lit("http://"), F.col("host"), F.regexp_extract("path", "^(.*/)", 1), F.col("to")))
    )
    return df.where("host <> ''").select("host", "path", "tail", host(absolute).alias("to_host"), path(absolute).alias("to_path"), tail(absolute).alias("to_tail"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict. redirects: more edges (from_url, to_url)."""
    own = pages.select(F.col(id_col), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), tail(F.col(url)).alias("tail"))
    edges = links(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(*[f(F.col(c)).alias(n) for c, p in (("from_url", ""), ("to_url", "to_")) for f, n in ((host, p + "host"), (path, p + "path"), (tail, p + "tail"))])
        edges = more if edges is None else edges.unionByName(more)
    keys = own.select("host", "path")
    component = None
    if edges is not None:
        edges = written(edges.distinct(), "links")
        ends = edges.select("host", "path", "tail").unionAll(edges.select("to_host", "to_path", "to_tail"))
        if edges.limit(1).count():
            ids = written(ends.distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
            a, b = ids.toDF("host", "path", "tail", "a"), ids.toDF("to_host", "to_path", "to_tail", "b")
            comp = connected_components(edges.join(a, ["host", "path", "tail"]).join(b, ["to_host", "to_path", "to_tail"]).select("a", "b"))
            component = ids.join(comp, "node").select("host", "path", "tail", "root")
            keys = keys.unionAll(ends.select("host", "path"))
    ruled = match(keys.distinct(), rules)
    if component is not None:
        ruled = written(ruled, "ruled")
        votes = component.join(ruled, ["host", "path"]).groupBy("root").agg(
            F.max(F.expr("verdict = 'allow'")).alias("allowed"), F.max(F.expr("verdict = 'block'")).alias("blocked")
        )
        spread = component.join(votes, "root").where("blocked and not allowed").select("host", "path", "tail", F.lit("block").alias("alias"))
        out = own.join(ruled, ["host", "path"], "left").join(spread, ["host", "path", "tail"], "left")
    else:
        out = own.join(ruled, ["host", "path"], "left").withColumn("alias", F.lit(None).cast("string"))
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rule, verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
f AS (SELECT page_id, rule, verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""
