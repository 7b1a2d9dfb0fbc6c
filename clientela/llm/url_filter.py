"""URL rules with redirect equivalence: pages that redirect to each other or name each other as
canonical are one class, and a block decision reaches all of it unless something in it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.components import components
from clientela.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: what is no markup, and characters that HTML names
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title|iframe|xmp)\b.*?(?:</\1|\z)"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
# rules sent to every task; beyond, they are joined by host
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What names a page: host, path (``/`` for none) and query; null without a host."""
    path = path_of(url)
    query = F.regexp_extract(url, r"://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'[^']*'|[^\s\"'>]+)", 1)
    single = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(quoted != "", quoted).when(single != "", single).otherwise(bare)


def _unescaped(text: Column) -> Column:
    """Character references by number, and the five of XML by name, as the characters that they stand for."""
    parts = F.regexp_extract_all(text, F.lit(r"&#[xX][0-9a-fA-F]{1,6};?|&#[0-9]{1,7};?|&[a-zA-Z]+;|&|[^&]+"), F.lit(0))

    def character(number: Column) -> Column:
        """Of a code point in hexadecimal; the replacement character for none and for halves of pairs."""
        code = F.conv(number, 16, 10).cast("long")
        wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.when(wrong, "FFFD").otherwise(number), 8, "0")), "UTF-32")

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        named = F.lit(None).cast("string")
        for name, meant in NAMED.items():
            named = F.when(F.lower(x) == name, meant).otherwise(named)
        return F.when(x.rlike("^&#[xX]"), character(digits)).when(x.rlike("^&#[0-9]"), character(F.conv(digits, 10, 16))).otherwise(F.coalesce(named, x))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def targets_of(html: Column) -> Column:
    """References of canonical links and of refreshes in a page, without character references.

    ``rel`` is a set of words; markup in comments, scripts and styles is none.
    """
    seen = F.regexp_replace(html, F.lit(UNSEEN), F.lit(" "))

    def tags(name: str, keep) -> Column:
        return F.filter(F.regexp_extract_all(seen, F.lit(rf"(?i)<{name}\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0)), keep)

    links = tags("link", lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = tags("meta", lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    canonical = F.transform(links, lambda t: _attribute(t, "href"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1))
    found = F.transform(F.concat(canonical, refresh), lambda x: F.regexp_replace(_unescaped(x), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    found = F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x != "")
    return F.when(html.rlike("(?i)canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``, the latter with the segment before them."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")

    def step(kept: Column, part: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", shorter).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """A reference on a page as a whole URL; null for one of another kind of scheme, such as ``mailto:``.

    Only a scheme at its start makes a reference absolute, whatever its query holds.
    """
    base = F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    whole = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path, target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(base, F.regexp_replace(path, "[^/]*$", ""), target))
    )
    head = F.regexp_extract(whole, "^([^:]*://[^/?#]*)", 1)
    rest = F.regexp_extract(whole, "^[^:]*://[^/?#]*[^?#]*(.*)$", 1)
    return F.when(target.startswith("#"), whole).otherwise(F.concat(head, without_dots(path_of(whole)), rest))


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add (rule, verdict) of the longest rule (host, path, verdict) that fits host and path, else nulls.

    Expects columns ``host`` and ``path``; every host meets the rules of each of its parent domains.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    hosts = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = hosts.withColumn("rule_host", F.explode(parents)).join(rules, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    best = best.select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))
    return urls.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) of every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Without one, a page takes what its redirect class says: allow if
    a rule allows any address of the class, else block if a rule blocks any, else allow. Classes
    are connected components over canonical links and refreshes of the pages and ``redirects``
    (source, target); addresses leave out scheme and fragment. ``reason`` is rule, alias or none. A
    null url has an empty host and path, no rule and no class; null html has no links; of equally long
    rules an allowing one wins. Rows that repeat come out as often, an empty table gives none.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "address": address_of(F.col("url"))})
    links = rows.filter("html IS NOT NULL").select("url", F.explode(targets_of(F.col("html"))).alias("target"))
    edges = links.select("url", resolved(F.col("target"), F.col("url")).alias("other"))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    edges = stored(edges.select("url", "other", address_of(F.col("url")).alias("u"), address_of(F.col("other")).alias("v")).filter("u <> v"))
    judged = with_rule(rows.select("page_id", "host", "path", "address"), rules)
    if edges.isEmpty():
        alias = F.lit(None).cast("string")
    else:
        classes = components(edges.select("u", "v"))
        ends = edges.select(F.explode(F.array(F.struct(F.col("url").alias("url"), F.col("u").alias("node")), F.struct(F.col("other").alias("url"), F.col("v").alias("node")))).alias("e")).select("e.*")
        ends = ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
        said = with_rule(ends, rules).join(classes, "node")
        verdicts = said.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
        verdicts = classes.join(verdicts, "component").select(F.col("node").alias("address"), F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("alias"))
        judged = judged.join(stored(verdicts), "address", "left")
        alias = F.col("alias")
    reason = F.when(F.col("verdict").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("none")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", alias, F.lit("allow")).alias("verdict"), reason.alias("reason"))
