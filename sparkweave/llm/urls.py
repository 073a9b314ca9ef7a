"""URL rules, and block decisions carried to redirect and canonical aliases.

A page's own rule decides first: of the rules whose host is the page's or a parent domain of it and
whose path starts the page's path, the longest. Other pages get the decision of their group: URLs that
are one but for scheme, fragment, tracking parameters or a last slash are one node, and nodes are
joined by the edges that pages state (canonical links, og:url, meta refresh). A distributed search for
connected components finds the groups. A group with an explicitly allowed member is allowed,
else one with a blocked member is blocked, else it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import stage
from sparkweave.llm.components import components

Rule = tuple[str, str, str]
#: Rules up to this number are an expression; more are joined by host.
INLINE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name another page.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path from a slash on, its segments . and .. taken out (RFC 3986, 5.2.4)."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))))
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    plain = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(F.size(walked) > 0, ends).otherwise(""))
    return F.when(path.rlike(r"^(/|.*/)\.\.?(/|$)") & path.startswith("/"), plain).otherwise(path)


def node(url: Column) -> Column:
    """What names the page whatever the scheme, its usual port, fragment, tracking parameters, dot segments and last slash; null for null or without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), rf"&{TRACKING}(?:=[^&]*)?(?=&|$)", ""), "^&+", "")
    usual = F.when(url.rlike("^(?i:http):"), ":(80)?$").when(url.rlike("^(?i:https):"), ":(443)?$").otherwise(":$")
    plain = F.concat(F.regexp_replace(host(url), usual, F.lit("")), F.regexp_replace(_without_dots(path(url)), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, plain)


def _text(rule: Rule) -> str:
    return rule[1].lower() + rule[2]


def _judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df (host, path) with rule and ruled: the longest fitting rule's text and verdict, else null."""
    ordered = sorted({(v, h.lower(), p) for v, h, p in rules}, key=lambda r: (-len(_text(r)), _text(r), r[0]))
    if len(ordered) <= INLINE:
        rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, h, p in reversed(ordered):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
        return df.withColumns({"rule": rule, "ruled": ruled})
    table = df.sparkSession.createDataFrame(ordered, "ruled string, of_host string, of_path string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = df.select("host").distinct().select("host", F.explode(suffixes).alias("of_host")).join(table, "of_host")
    paths = df.select("host", "path").distinct().join(hosts, "host").where(F.col("path").startswith(F.col("of_path")))
    rule = F.concat("of_host", "of_path")
    best = paths.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "ruled")).alias("best"))
    return df.join(best.select("host", "path", "best.rule", "best.ruled"), ["host", "path"], "left")


def _targets(html: Column) -> Column:
    """The addresses, as written, that a page names as its own or sends readers to."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)

    def of(tag: Column) -> Column:
        return (
            F.when(tag.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), value(tag, "href"))
            .when(tag.rlike(r"(?i)\bproperty\s*=\s*[\"']?og:url\b"), value(tag, "content"))
            .when(tag.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
        )

    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), of), lambda t: t.isNotNull() & (t != ""))


def _absolute(target: Column, url: Column) -> Column:
    """A target as written on a page, resolved against the page's address (RFC 3986, 5.2); null if it names no page or the page itself."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    own, rest = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.lit(None))
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
    )


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, via) for every row; rules are (allow or block, host, path).

    rule is the fitting rule's text, else null; via says what decided: rule, alias or default. A null
    url, or one without ://, has an empty host and path, no rule and no aliases: it is allowed. A null
    html states no edges; one of any length is read whole. Of fitting rules of equal length, allow wins.
    Repeated rows stay repeated. An empty table gives an empty one.
    """
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"), node(url).alias("node"), _targets(F.col(html_col)).alias("targets"))
    own = stage(_judged(read, rules), "pages")
    links = own.where("node is not null and size(targets) > 0").select("url", "node", F.explode("targets").alias("target")).select("node", _absolute(F.col("target"), F.col("url")).alias("to"))
    links = stage(links.select("node", "to", node(F.col("to")).alias("to_node")).where("to_node is not null"), "links")
    named = _judged(links.select(host(F.col("to")).alias("host"), path(F.col("to")).alias("path"), F.col("to_node").alias("node")).distinct(), rules)
    marks = own.select("node", "ruled").unionByName(named.select("node", "ruled")).where("node is not null and ruled is not null")
    by_node = marks.groupBy("node").agg(F.max(F.col("ruled") == "allow").alias("allow"), F.max(F.col("ruled") == "block").alias("block"))
    groups = components(links.where("node <> to_node").select(F.col("node").alias("u"), F.col("to_node").alias("v")))
    groups = stage(groups.select(F.col("node").alias("of_node"), "component"), "groups")
    placed = by_node.join(groups, F.col("node") == F.col("of_node"), "left").select(F.coalesce("component", "node").alias("component"), "allow", "block")
    blocked = placed.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block")).where("block and not allow").select("component")
    members = groups.join(blocked, "component").select("of_node").unionByName(blocked.select(F.col("component").alias("of_node"))).distinct().withColumn("is_blocked", F.lit(True))
    out = own.join(members, F.col("node") == F.col("of_node"), "left")
    alias = F.col("is_blocked").isNotNull()
    verdict = F.coalesce("ruled", F.when(alias, "block").otherwise("allow"))
    via = F.when(F.col("ruled").isNotNull(), "rule").when(alias, "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))
