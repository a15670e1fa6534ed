"""URL filters with redirect equivalence.

A rule allows or blocks a host with its subdomains under a path; the longest fitting rule
decides.  Addresses that redirect or name a canonical address are aliases: connected
components over those edges carry a block to every alias without a rule of its own,
unless a rule explicitly allows an address of the component.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import keep, local

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are one expression; more are a join.
MOST_IN_EXPRESSION = 200
#: A joined list of up to so many rules is broadcast.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: what names a resource, whatever the scheme; null without ``://``."""
    query = F.regexp_extract(url, "(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


def _ranked(rules: list[Rule]) -> list[Rule]:
    """Longest first; of equally long ones those that allow, then by text."""
    return sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "allow", r.text))


def with_rule(df: DataFrame, rules: list[Rule], host: str, path: str) -> DataFrame:
    """``df`` with ``rule`` and ``rule_verdict``, null where none fits."""
    ranked = _ranked(rules)
    if len(ranked) <= MOST_IN_EXPRESSION:
        found = F.lit(None).cast("struct<t:string,v:string>")
        for r in reversed(ranked):
            fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
            found = F.when(fits, F.struct(F.lit(r.text).alias("t"), F.lit(r.verdict).alias("v"))).otherwise(found)
        return df.withColumn("__rule", found).select(*df.columns, F.col("__rule.t").alias("rule"), F.col("__rule.v").alias("rule_verdict"))
    table = local(df.sparkSession, [(r.host, r.path, i, r.text, r.verdict) for i, r in enumerate(ranked)], "__host string, __path string, __rank int, __t string, __v string")
    table = F.broadcast(table) if len(ranked) <= MOST_BROADCAST else table
    labels = F.split(F.col(host), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = df.select(host, path).distinct()
    met = pairs.select("*", F.explode(suffixes).alias("__host")).join(table, "__host").where(F.col(path).startswith(F.col("__path")))
    best = met.groupBy(host, path).agg(F.min(F.struct("__rank", "__t", "__v")).alias("b")).select(host, path, F.col("b.__t").alias("rule"), F.col("b.__v").alias("rule_verdict"))
    return df.join(best, [host, path], "left").select(*df.columns, "rule", "rule_verdict")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): addresses of pages and where their canonical link or refresh redirect leads.
    Relative references are resolved against the page."""
    page, html = F.col(url_col), F.col(html_col)
    canonical = F.regexp_extract(html, "(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>", 0)
    canonical = F.regexp_extract(canonical, "(?is)\\bhref\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)", 1)
    refresh = F.regexp_extract(html, "(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>", 0)
    refresh = F.regexp_extract(refresh, "(?is)\\burl\\s*=\\s*[\"']?\\s*([^\"'\\s>;]+)", 1)
    refs = pages.select(page.alias("u"), F.explode(F.array(canonical, refresh)).alias("r")).where("r <> '' and u is not null").withColumn("r", F.replace("r", F.lit("&amp;"), F.lit("&")))
    u, r = F.col("u"), F.col("r")
    folder = F.regexp_extract(path_of(u), "(?s)^(.*/)", 1)
    full = (
        F.when(r.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), r)
        .when(r.startswith("//"), F.concat(F.lit("http:"), r))
        .when(r.startswith("/"), F.concat(F.lit("http://"), host_of(u), r))
        .otherwise(F.concat(F.lit("http://"), host_of(u), F.when(folder == "", "/").otherwise(folder), r))
    )
    return refs.select(address_of(u).alias("a"), address_of(full).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, component) for each row of ``pages``.

    ``redirects`` (a, b) are further addresses known to lead to one another.  The verdict is
    that of the longest rule; without one, block if a rule blocks an alias and none allows
    one, else allow.  A null url, or one without ``://``, has empty parts and no
    aliases; repeated rows are judged each; an empty table gives an empty result."""
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    edges = keep(edges, "aliases")
    own = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), address_of(F.col(url_col)).alias("__address"))
    own = with_rule(own, rules, "host", "path")
    if edges.isEmpty():
        own = own.withColumn("component", F.lit(None).cast("string")).withColumn("__alias", F.lit(None).cast("string"))
    else:
        comp = keep(connected_components(edges), "components")
        at = F.concat(F.lit("://"), F.col("node"))
        nodes = with_rule(comp.withColumn("host", host_of(at)).withColumn("path", path_of(at)), rules, "host", "path")
        decided = nodes.groupBy("component").agg(F.max(F.expr("rule_verdict = 'allow'")).alias("allowed"), F.max(F.expr("rule_verdict = 'block'")).alias("blocked"))
        decided = decided.select("component", F.expr("case when allowed then 'allow' when blocked then 'block' end").alias("__alias"))
        table = keep(comp.join(keep(decided, "decided"), "component"), "alias-verdicts")
        own = own.join(table.withColumnRenamed("node", "__address"), "__address", "left")
    verdict = F.coalesce("rule_verdict", "__alias", F.lit("allow"))
    return own.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "component")
