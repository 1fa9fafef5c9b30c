"""URL filter whose block decisions reach aliases over redirects and canonical links.

A rule fits a host and its subdomains where the path starts with the rule's; the longest rule
wins. Urls that redirect to each other, or name each other as canonical, are one resource:
the connected components over these edges are computed on the cluster, and a url that no
rule fits takes the decision of its component: allowed if a rule explicitly allows an alias,
else blocked if a rule blocks one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import materialise
from retentio.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "://([^/?#]*)([^?#]*)"
#: Comments (one that does not end goes to the end), and the tags that name other urls. A tag holds no ``<``, so a page is cut in one pass.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"(?i)(<(?:link|meta|base)\s[^<>]*>)"
CANONICAL = r"""(?is)^<link\s(?:[^>]*[\s"'])?rel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?is)^<meta\s(?:[^>]*[\s"'])?http-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)[\s"']href\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+(?:;[^"'\s>;]+)*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def redirect_target(url: Column) -> Column:
    """Where servers redirect by convention: https, the bare host, no fragment, no tracking parameters, no final slash."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, r"(?<=[?&])utm_[^&]*(&|$)", "")  # also neighbouring ones: the separator before is not consumed
    u = F.regexp_replace(u, "[?&]+$", "")
    u = F.regexp_replace(u, "(?i)^https?://(www\\.|m\\.)?", "https://")
    return F.regexp_replace(u, "/$", "")


def without_dots(url: Column) -> Column:
    """A full url whose path has no ``.`` and ``..`` segments."""
    path = F.regexp_replace(F.regexp_extract(url, "^[^?#]*?://[^/?#]*/([^?#]*)", 1), r"(^|/)(\.\.?)$", "$1$2/")
    segments = F.reverse(F.split(path, "/"))
    state = lambda skip, out: F.struct(skip.alias("skip"), out.alias("out"))

    def step(acc: Column, s: Column) -> Column:  # from the last segment: ".." takes the next one that is no dot
        return (F.when(s == "..", state(acc["skip"] + 1, acc["out"])).when(s == ".", acc)
                .when(acc["skip"] > 0, state(acc["skip"] - 1, acc["out"])).otherwise(state(acc["skip"], F.concat(F.lit("/"), s, acc["out"]))))

    out = F.aggregate(segments, state(F.lit(0), F.lit("")), step, lambda acc: acc["out"])
    out = F.when(out == "", F.lit("/")).otherwise(out)
    found = F.concat(F.regexp_extract(url, "^([^?#]*?://[^/?#]*)", 1), out, F.regexp_extract(url, "(?s)^[^?#]*(.*)$", 1))
    return F.when(url.rlike(r"^[^?#]*?://[^/?#]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), found).otherwise(url)


def absolute(href: Column, base: Column) -> Column:
    """A link of the page ``base`` as a full url."""
    scheme = F.regexp_extract(base, "^([^:/?#]+):", 1)
    root = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), folder).otherwise(F.concat(root, F.lit("/")))
    full = (F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href))
            .otherwise(F.concat(folder, href)))
    return without_dots(full)


def attribute(tag: Column, pattern: str) -> Column:
    """A link in a tag, character references of ``&`` decoded; empty without one."""
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), "(?i)&(?:amp|#38|#x26);", "&")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): conventional redirects, refreshes and canonical links of pages with a full url.

    Tags inside comments do not count; relative links start from the page's first ``<base href>``, if it has one.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("src"), F.col(html_col).cast("string").alias("html")).filter(F.col("src").contains("://"))
    named = rows.filter(F.col("html").rlike("(?i)canonical|refresh"))
    tags = named.select("src", F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(TAG)).alias("tags"))
    first = F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base\\s") & (attribute(t, HREF) != "")), F.lit(0))
    based = tags.withColumn("base", F.when(first.isNotNull(), absolute(attribute(first, HREF), F.col("src"))).otherwise(F.col("src")))
    each = based.select("src", "base", F.explode("tags").alias("tag"))
    href = F.when(F.col("tag").rlike(CANONICAL), attribute(F.col("tag"), HREF)).when(F.col("tag").rlike(REFRESH), attribute(F.col("tag"), REFRESH_URL))
    found = each.select("src", "base", href.alias("href")).filter("href <> ''").select("src", absolute(F.col("href"), F.col("base")).alias("dst"))
    usual = rows.select("src", redirect_target(F.col("src")).alias("dst"))
    linked = found.unionByName(found.select(F.col("dst").alias("src"), redirect_target(F.col("dst")).alias("dst")))
    return usual.unionByName(linked).filter("src <> dst").distinct()


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the longest rule that fits each distinct ``url``; urls that none fits are left out.

    ``rules`` has host, path and verdict (allow or block). Of rules with equal host and path,
    allow counts. Only as many host suffixes are looked up as rule hosts have labels.
    """
    own = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), (F.col("verdict") == "allow").alias("r_allow"))
    own = own.filter("r_host is not null").groupBy("r_host", "r_path").agg(F.max("r_allow").alias("r_allow"))
    deepest = int(own.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 1)
    labels = F.split("host", r"\.")
    last = F.slice("labels", F.greatest(F.size("labels") - F.lit(deepest - 1), F.lit(1)), F.lit(deepest))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("last")), lambda i: F.array_join(F.slice("last", i, F.size("last")), "."))
    tried = (urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("labels", labels)
             .withColumn("last", last).select("url", "path", F.explode(suffixes).alias("suffix")))
    fits = tried.join(own, F.col("suffix") == F.col("r_host")).filter(F.col("path").startswith(F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule), F.length("r_host"), F.col("r_allow").alias("allow"), rule.alias("rule"))).alias("best"))
    return best.select("url", F.col("best.rule").alias("rule"), F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, edges: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    edges   (src, dst) urls that are aliases; null ends are ignored
    rules   host, path, verdict
    A null url, or one without ``://``, has empty host and path, no rule and no aliases: allow.
    Repeated rows keep their rows, null ids stay null, other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    full = lambda c: F.col(c).contains("://")
    ends = edges.filter(full("src") & full("dst")).select("src", "dst")
    nodes = rows.select("url").filter(full("url")).unionByName(ends.select(F.col("src").alias("url"))).unionByName(ends.select(F.col("dst").alias("url"))).distinct()
    ruled = materialise(best_rules(nodes, rules), "ruled")
    members = connected_components(ends, "src", "dst")
    # the decision of each component that a rule decides: one row each, whatever its size
    decided = (members.join(ruled, F.col("node") == F.col("url")).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
               .select(F.col("component").alias("c"), F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited")))
    inherited = members.join(decided, F.col("component") == F.col("c")).select("node", "inherited")
    known = (ruled.join(inherited, F.col("url") == F.col("node"), "full")
             .select(F.coalesce("url", "node").alias("known"), "rule", F.coalesce("verdict", "inherited").alias("verdict")))
    return (rows.join(known, F.col("url") == F.col("known"), "left")
            .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")))
