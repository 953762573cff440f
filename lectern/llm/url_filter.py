"""Operator 5: URL rules whose block decisions reach aliases.

A rule fits a host and its subdomains where the path starts with the rule's; the longest rule wins.
Canonical links and redirects (of the pages themselves, or a table of them) join addresses into
components, which are found by distributed contraction. An address that no rule fits is blocked if
a rule blocks any address of its component. A rule that allows an address always wins for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .components import components

_TAG = r"(?is)<{0}\b[^>]*{1}[^>]*>"
_LINK = _TAG.format("link", r"\brel\s*=\s*[\"']?canonical\b")
_META = _TAG.format("meta", r"\bhttp-equiv\s*=\s*[\"']?refresh\b")
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (host/path, action) that fits, as a struct of the rule and its action, else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for rule, action in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The address without its fragment, scheme and host in lower case; null if it has no scheme."""
    plain = F.regexp_replace(url, r"(?s)#.*", "")
    scheme = F.lower(F.regexp_extract(plain, r"(?s)^(.*?)://", 1))
    return F.when(F.length(scheme) > 0, F.concat(scheme, F.lit("://"), host_of(plain), F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*(.*)", 1)))


def resolved(url: Column, link: Column) -> Column:
    """A link as an address, as seen from url."""
    scheme, start = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(start, link)).otherwise(F.concat(start, F.when(folder == "", "/").otherwise(folder), link))


def links_of(pages: DataFrame) -> DataFrame:
    """(src, dst): the canonical links and immediate redirects that pages (url, html) declare."""
    html = F.col("html")
    some = pages.where("url is not null and html is not null").where(html.rlike(r"(?i)canonical|http-equiv"))
    found = F.array(F.regexp_extract(F.regexp_extract("html", _LINK, 0), _HREF, 1), F.regexp_extract(F.regexp_extract("html", _META, 0), _URL, 1))
    return some.select(F.col("url").alias("src"), F.explode(F.filter(found, lambda x: F.length(x) > 0)).alias("link")).select("src", resolved(F.col("src"), F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))).alias("dst"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_block) for each row of pages (page_id, url, html; other columns are ignored).

    rules are (host/path, "allow" or "block") and are compiled into one expression, so there should be some
    hundred at most. redirects (src, dst: addresses) adds edges. verdict is the longest rule's action, else
    block if an address of the same component is blocked by its own rule, else allow; alias_block tells
    the former. Addresses are compared without fragments. A null url, or one without ://, has an empty
    host and path, fits no rule and is allowed. Repeated rows give repeated rows, no rows none. Nodes are
    64-bit hashes of addresses. Runs jobs at once and keeps intermediate tables in spark.checkpoint.dir.
    """
    tables = Tables(pages.sparkSession, "urls")
    edges = links_of(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = tables.keep(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> dst"), "edges")
    comps = components(edges.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")), tables, "urls")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    blocked = ends.where(best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["action"] == "block").select(F.xxhash64("node").alias("node"))
    comps = tables.keep(comps, "components")
    bad = comps.join(blocked, "node", "left_semi").select("comp").distinct()
    # Addresses that a block reaches.
    reached = tables.keep(comps.join(bad, "comp", "left_semi").select(F.col("node").alias("id"), F.lit(True).alias("hit")), "reached")

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    rows = rows.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.xxhash64(node_of(F.col("url"))).alias("id"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).join(reached, "id", "left")
    alias = F.col("best").isNull() & F.coalesce(F.col("hit"), F.lit(False)) & (F.col("host") != "")
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias_block"))
