"""URL filter with redirect equivalence, in DataFrame operations alone.

Rules name a host and a path; a rule fits its host and all subdomains where the
url's path starts with the rule's, and the longest fitting rule decides.  Urls
tied by a redirect (meta refresh) or a canonical link name the same page: they
form connected components, and a url without a rule of its own is blocked where
a rule blocks any of its aliases.  A url's own rule, such as an explicit allow,
always comes before that.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carried, quoted
from .graph import components

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
HOSTS = 100_000  # hosts with a rule up to which their lists are broadcast (some tens of MB)
SALT = 32
_ATTRIBUTE = r"""(?i)\b{}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _after_scheme(url):
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url):
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url):
    """The name of a page among aliases: the url without its fragment, scheme and host lower-cased."""
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    return F.concat(F.translate(head, ascii_uppercase, ascii_lowercase), F.substring(whole, F.length(head) + 1, F.length(whole)))


def _attribute(tag, name):
    value = F.regexp_extract(tag, _ATTRIBUTE.format(name), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"""^["']|["']$""", ""), "&amp;", "&"))


def canonical_link(html):
    return _attribute(F.regexp_extract(html, r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0), "href")


def refresh_link(html):
    content = _attribute(F.regexp_extract(html, r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0), "content")
    return F.trim(F.regexp_replace(F.regexp_extract(content, r"(?i)\burl\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""))


def resolved(link, url):
    """A link seen on the page ``url`` as a full url; null where it is empty or the url has no host."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    site = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    full = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(
        link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, link))
    return F.when((F.length(link) > 0) & (F.length(scheme) > 0), full)


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses tied by a canonical link or a redirect of a page."""
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.array(canonical_link(F.col("html")), refresh_link(F.col("html")))).alias("link"))
    return links.select(address(F.col("url")).alias("a"), address(resolved(F.col("link"), F.col("url"))).alias("b")).where("a <> b")


def _rule_table(pages: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    rows = [(v, r, *r.partition("/")[::2]) for v, r in rules]
    table = pages.sparkSession.createDataFrame([(v, r, h.lower(), f"/{p}") for v, r, h, p in rows], "verdict string, rule string, rule_host string, rule_path string")
    return table.dropDuplicates(["rule"])


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path and others) with the longest fitting rule as ``found`` (rule, verdict), null without one.

    Each distinct host meets the rules of itself and of its parents once; pages
    only meet their host's short list.  Hosts with a rule are counted: up to
    ``HOSTS`` they are broadcast, beyond they are copied to ``SALT`` parts of
    each host, dealt by path, so that no host's pages meet in one task.
    """
    hosts = urls.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    lists = ends.join(rules, "rule_host").groupBy("host").agg(F.collect_list(F.struct(
        F.length("rule").alias("size"), "rule", "verdict", "rule_path")).alias("rules"))
    lists = cut(lists)
    fitting = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    if lists.count() <= HOSTS:
        return urls.join(F.broadcast(lists), "host", "left").withColumn("found", fitting).drop("rules")
    dealt = urls.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)))
    copies = lists.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return dealt.join(copies, ["host", "salt"], "left").withColumn("found", fitting).drop("rules", "salt")


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` (url, html and others) with host, path, rule, verdict and alias_blocked.

    ``rules`` are (``allow`` or ``block``, ``host/path``).  rule is the longest
    that fits the page's url, else null, and verdict that rule's; without one a
    page is blocked if a rule blocks the url of any alias (alias_blocked), else
    allowed.  Aliases are found over all pages, whatever the number of steps.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed; null html holds no links.  Repeated urls and rows are judged
    alike, an empty table gives an empty table, and a column of the input that
    has the name of an added one is replaced.
    """
    table = _rule_table(pages, rules)
    own = ["host", "path", "rule", "verdict", "alias_blocked"]
    groups = cut(components(alias_links(pages)))
    blocked = with_rule(groups.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), table).where(
        "found.verdict = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component").select(F.col("node").alias("address"), F.lit(True).alias("alias_blocked"))
    rest = carried(pages, "html", "url")
    rows = pages.select(rest.alias("rest"), "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rule(rows, table).withColumn("address", address(F.col("url"))).join(aliases, "address", "left")
    kept = [F.col(c) if c in ("url", "html") else F.col(f"rest.{quoted(c)}") for c in pages.columns if c not in own]
    return judged.select(
        *kept, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"), F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"))


#: The same for DuckDB, aliases by a recursive walk.
SQL = r"""
WITH RECURSIVE raw AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
tags AS (
  SELECT url, unnest([
    trim(replace(trim(regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i'), '\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'i'), '"'''), '&amp;', '&')),
    trim(trim(regexp_extract(regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i'), '\bcontent\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'i'), '\burl\s*=\s*([^"]*)', 1, 'i'), '"'''))]) AS link
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (
  SELECT regexp_replace(url, '#.*$', '') AS a, regexp_replace(CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^[^/]*:') || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^[^/]*://[^/?#]*') || link
    ELSE regexp_extract(regexp_extract(url, '^[^?#]*'), '^.*/') || link END, '#.*$', '') AS b
  FROM tags WHERE link <> ''),
rules(verdict, rule, host, path) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
walk(start, node) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT w.start, l.b FROM walk w JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = w.node),
urls AS (
  SELECT address, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT DISTINCT node AS address, CASE WHEN instr(node, '://') > 0 THEN substr(node, instr(node, '://') + 3) ELSE '' END AS after FROM walk)),
blocked AS (
  SELECT DISTINCT w.start FROM walk w JOIN (
    SELECT u.address, arg_max(r.verdict, length(r.rule)) AS verdict FROM urls u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.address) d ON d.address = w.node WHERE d.verdict = 'block'),
judged AS (
  SELECT raw.page_id, raw.url, coalesce(translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path FROM raw)
SELECT j.page_id, j.host, j.path,
  (SELECT arg_max(r.rule, length(r.rule)) FROM rules r WHERE (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.rule)) FROM rules r WHERE (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)),
    CASE WHEN b.start IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN blocked b ON b.start = regexp_replace(j.url, '#.*$', '')
"""
