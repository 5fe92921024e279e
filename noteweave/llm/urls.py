"""URL filters: pattern rules behind an index by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that every URL it
matches must hold as whole tokens. The index has each rule under that one of its tokens which is
rarest among the URLs at hand; rules without a token are candidates of every URL. A URL's own tokens
fetch its candidate rules from a hash table, and only those run their expressions, each compiled once
for a worker. Only the URL goes to Python; no shuffle but the small count of the rules' tokens, by a join
with them, and nothing that grows with the URLs on the driver. Rules and index are the caller's list,
broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.common import read


@dataclass(frozen=True)
class Rule:
    """``on``: "site" matches host and path put together, "url" the lower-cased URL.
    Of the rules that match, site rules go before others and longer names before shorter."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    on: str = "url"


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that start with ``path``."""
    literal = lambda s: re.sub(r"([^0-9A-Za-z/])", r"\\\1", s)
    # the path's last literal run may go on in the URL's token; only runs that a slash closes count
    tokens = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=/)[a-z0-9]+(?=/)", path)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{literal(host)}{literal(path)}", tuple(dict.fromkeys(tokens)), "site")


SITE_RULES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
)

#: Patterns of pages that a crawl for text doesn't want.
PATTERN_RULES = (
    Rule("feed-tracking", "block", r"[?&]utm_source=feed(?:[&#]|$)", ("utm", "source", "feed")),
    Rule("session-id", "block", r"[?&]sessionid=", ("sessionid",)),
    Rule("login", "block", r"/(?:wp-)?login\.php", ("login", "php")),
    Rule("cgi", "block", r"/cgi-bin/", ("cgi", "bin")),
    Rule("tag-page", "block", r"/tag/[^/?#]+/page/[0-9]+", ("tag", "page")),
    Rule("casino", "block", r"(?:^|[^a-z0-9])casino(?:[^a-z0-9]|$)", ("casino",)),
    Rule("program", "block", r"\.exe(?:[?#]|$)", ("exe",)),
    Rule("ad-server", "block", r"://(?:[^/?#]*\.)?adserver\.", ("adserver",)),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(url), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, str]:
    """Each rule's literal token that the fewest URLs hold, by the rule's name. Counts only the rules' own
    tokens, so what comes to the driver is no more than those."""
    known = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    held = urls.select(F.explode(_tokens(F.col(url_col))).alias("token")).join(F.broadcast(known), "token")  # the caller's rules' tokens
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) for r in rules if r.tokens}


class Index:
    """Rules by their rarest token; expressions are compiled at their first use."""

    def __init__(self, rules: tuple[Rule, ...], rarest: dict[str, str]):
        self.rules = rules
        self.under: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.under.setdefault(rarest.get(r.name, ""), []).append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return {**self.__dict__, "compiled": {}}

    def judge(self, url: str, site: str) -> tuple[int, int]:
        """The rule that decides (-1 for none), and how many expressions ran. ``url`` is lower-cased."""
        found = [i for t in {"", *re.split("[^a-z0-9]+", url)} for i in self.under.get(t, ())]
        best, at = None, -1
        for i in found:
            r = self.rules[i]
            if i not in self.compiled:
                self.compiled[i] = re.compile(r.pattern)
            if self.compiled[i].search(site if r.on == "site" else url):
                rank = r.on == "site", len(r.name), r.name
                if best is None or rank > best:
                    best, at = rank, i
        return at, len(found)


def filter_urls(urls: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (the name of the rule that decides, else null),
    ``rule_on``, ``verdict`` and ``n_candidates`` (rules whose expression ran).

    A null URL, or one without ``://``, has empty host and path; site rules can't fit it. Without rules
    every verdict is the default. An empty table gives an empty result; repeated rows are judged alike, each
    on its own; URLs of any length are judged whole. Columns of the input with the names of results are
    replaced.
    """
    index = urls.sparkSession.sparkContext.broadcast(Index(tuple(rules), rarest_tokens(urls, url_col, tuple(rules)) if rules else {}))

    @F.pandas_udf("rule string, rule_on string, verdict string, n_candidates int")
    def judged(url: pd.Series, site: pd.Series) -> pd.DataFrame:
        own, rows = index.value, []
        for u, s in zip(url, site, strict=True):
            i, n = own.judge(u, s)
            r = own.rules[i] if i >= 0 else None
            rows.append((r.name, r.on, r.verdict, n) if r else (None, None, default, n))
        return pd.DataFrame(rows, columns=["rule", "rule_on", "verdict", "n_candidates"])

    host, path = host_and_path(F.col(url_col))
    low = ascii_lower(F.coalesce(F.col(url_col), F.lit("")))
    own = urls.drop(*({"host", "path", "rule", "rule_on", "verdict", "n_candidates", "_urls_best"} - {url_col}))
    out = own.withColumns({"host": host, "path": path}).withColumn("_urls_best", judged(low, F.concat("host", "path")))
    return out.withColumns({c: F.col(f"_urls_best.{c}") for c in ("rule", "rule_on", "verdict", "n_candidates")}).drop("_urls_best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, the site rule that fits it, and the verdict."""
    out = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", F.when(F.col("rule_on") == "site", F.col("rule")).alias("rule"), "verdict")


def oracle() -> str:
    lowered = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    blocked = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERN_RULES)
    return f"""
    WITH rest AS (
      SELECT page_id, coalesce({lowered}, '') AS low,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after
      FROM pages),
    cut AS (
      SELECT page_id, low,
             translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
      FROM rest),
    ruled AS (
      SELECT *, CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/'
                     WHEN {fits('example.com', '/de/')} THEN 'example.com/de/'
                     WHEN {fits('org', '/fr/')} THEN 'org/fr/'
                     WHEN {fits('net', '/')} THEN 'net/' END AS rule
      FROM cut)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
                WHEN rule IS NOT NULL THEN 'block'
                WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled"""
