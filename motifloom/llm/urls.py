"""URL filtering with verdicts that reach aliases, in DataFrame functions only.

A rule names a host and a path prefix; it fits the host and its subdomains and
the longest fitting rule decides. Pages also declare aliases: a canonical link
or an immediate redirect in their markup, or rows of an edge table. Connected
components over those edges are classes of one resource: if any address of a
class is blocked by a rule, its other addresses are blocked as well, but an
address that a rule of its own allows stays allowed.

A null address, or one without ``://``, has empty host and path, fits no rule
and has no alias.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.operators.components import components
from motifloom.session import scratch, store


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Rules up to this many are tried in each row; more are joined on host suffixes.
INLINE_RULES = 200


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A[^/?#]*", 0), _ASCII_UPPER, _ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _rank(verdict: Column, host: Column, path: Column) -> Column:
    """Orders fitting rules: longest first, then allow before block."""
    rule = F.concat(host, path)
    return F.struct(F.length(rule).alias("n"), (verdict == "allow").cast("int").alias("allow"), rule.alias("rule"), verdict.alias("verdict"))


def judge(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null without a fitting rule) to ``urls(host, path, ...)``."""
    checked = [Rule(*r) for r in rules]
    if bad := [r for r in checked if r.verdict not in ("allow", "block")]:
        raise ValueError(f"verdicts are allow or block: {bad}")
    if len(checked) <= INLINE_RULES:
        tried = [
            F.when(_fits(F.col("host"), F.col("path"), F.lit(r.host), F.lit(r.path)), _rank(F.lit(r.verdict), F.lit(r.host), F.lit(r.path)))
            for r in checked
        ]
        best = F.array_max(F.array(*tried)) if tried else F.lit(None).cast("struct<rule:string,verdict:string>")
        return urls.withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
    table = urls.sparkSession.createDataFrame(checked, "verdict string, rhost string, rpath string")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    hits = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rhost")).join(table, "rhost").where(F.expr("startswith(path, rpath)"))
    best = hits.groupBy("host", "path").agg(F.max(_rank(F.col("verdict"), F.col("rhost"), F.col("rpath"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def address(url: Column) -> Column:
    """What aliases are matched by: the address with a lower-case host and no fragment; null without a scheme."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def _resolved(base: Column, href: Column) -> Column:
    scheme, host = F.substring_index(base, "://", 1), host_of(base)
    folder = F.regexp_extract(path_of(base), r"\A(.*/)?", 0)
    return (
        F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host, href))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), href))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)`` addresses that ``pages(url, html)`` declare equal: canonical links and redirects."""
    canonical = F.when(F.col("html").rlike("(?i)canonical"), F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0))
    redirect = F.when(F.col("html").rlike("(?i)http-equiv"), F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0))
    targets = F.array(
        F.regexp_extract(canonical, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(redirect, r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    declared = pages.where("instr(url, '://') > 0").select("url", F.explode(targets).alias("href")).where("href <> ''")
    return declared.select(address(F.col("url")).alias("u"), address(_resolved(F.col("url"), F.col("href"))).alias("v")).where("u is not null and v is not null and u <> v")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, key: str = "page_id", default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict, address)`` for each of ``pages(key, url, html)``.

    ``edges(u, v)`` adds redirects known from elsewhere. Rules decide first; an
    address without a rule takes ``block`` from its class, else ``default``.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.union(edges.select(address(F.col("u")), address(F.col("v"))).where("u is not null and v is not null"))
    with scratch(pages.sparkSession):
        classes = store(components(found), "url-classes").keep()
    classes = classes.read()
    named = classes.select("component", F.col("node").alias("address"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    blocked = judge(named, rules).where("rule_verdict = 'block'").select("component").distinct()
    tainted = classes.join(blocked, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("tainted"))
    rows = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    judged = judge(rows, rules).join(tainted, "address", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), "block"), F.lit(default))
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), "address")
