"""URL rules found through their rarest literal token.

A rule is written in the notation of public block lists: ``||`` stands for the start of a host label,
``*`` for any run of characters (of the host's, in a rule that begins with ``||``), ``^`` for a character that ends a name or the end of the url. The
words of a rule that stand between such ends must be tokens of every url that it fits; the one that
the fewest urls have is its place in the index. A url fetches the rules of its own tokens, and only
those run their regular expression. Rules without such a word run for every url.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, ascii_lower, table

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str

    @property
    def regex(self) -> str:
        body, head = (self.pattern[2:], r"^(?:[^/?#]*\.)?") if self.pattern.startswith("||") else (self.pattern, "")
        ends = {"*": ".*" if not head else "[^/?#]*", "^": r"(?:[^a-z0-9_.%-]|$)"}
        return head + "".join(ends.get(c) or re.escape(c) for c in body)

    @property
    def literals(self) -> set[str]:
        """Words that are whole tokens of each url the rule fits."""
        closed = self.pattern if self.pattern.startswith("||") else f"*{self.pattern}"
        return set(re.findall(rf"(?<![a-z0-9*]){TOKEN}(?=[^a-z0-9*])", closed))


#: The host and path rules that hold before all others; the longest that fits wins.
SITE_RULES = [Rule("||net/", "block"), Rule("||example.net/en/", "allow"), Rule("||example.com/de/", "block"), Rule("||org/fr/", "allow")]
#: What the method itself blocks: shops, gambling, adult pages, link farms, trackers, pages without prose.
PATTERN_RULES = [
    Rule("||cheap-pills.", "block"), Rule("||*-pills.", "block"), Rule("||casino-*.", "block"), Rule("||*casino.", "block"),
    Rule("||free-bets.", "block"), Rule("||*-bets.", "block"), Rule("||adult-*.", "block"), Rule("||porn.", "block"), Rule("||porn-*.", "block"),
    Rule("||spam-farm.", "block"), Rule("||link-farm.", "block"), Rule("||ads-track.", "block"), Rule("||ads.", "block"),
    Rule("||tracking.", "block"), Rule("||doubleclick.", "block"), Rule("/wp-login.php^", "block"), Rule("/cgi-bin/", "block"),
    Rule("/cart/checkout^", "block"), Rule("/user/login^", "block"), Rule("/account/signup^", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first ``://`` in lower case, and the path up to ``?`` or ``#``; else empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, parts, 1)), F.regexp_extract(whole, parts, 2)


def rarest_literals(urls: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """Token -> numbers of the rules kept there; the empty token has those that run for every url.

    How many of all urls have a word is counted for the rules' words only, so what comes to the driver
    is bounded by the rule list.
    """
    words = sorted(set().union(*(r.literals for r in rules)))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1))
    counts = urls.select(F.explode(tokens).alias("token")).filter(F.col("token").isin(words)).groupBy("token").count()
    seen = dict.fromkeys(words, 0) | {r["token"]: r["count"] for r in counts.collect()}
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        index.setdefault(min(rule.literals, key=lambda w: (seen[w], w), default=""), []).append(k)
    return index


def judge_urls(pages: DataFrame, site_rules: list[Rule] = SITE_RULES, pattern_rules: list[Rule] = PATTERN_RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of ``pages``, without a shuffle of them.

    A site rule that fits decides (the longest, the first of equals); else any pattern rule that
    blocks; else the url is allowed. Null urls and those without ``://`` have empty parts and are allowed.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules, n_site = [*site_rules, *pattern_rules], len(site_rules)
    index = rarest_literals(urls, rules) if rules else {}
    kind = pages.schema[id_col].dataType
    arrow = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string())])

    def judge(rows):
        regexes = [re.compile(r.regex, re.S) for r in rules]
        everywhere = index.get("", [])
        for batch in rows:
            found, verdicts, patterns = [], [], []
            for own_host, own_path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                url = own_host + own_path
                fetched = {k for t in re.findall(TOKEN, url.lower()) for k in index.get(t, ())}
                fits = [k for k in sorted(fetched.union(everywhere)) if regexes[k].search(url)]
                site = max((k for k in fits if k < n_site), key=lambda k: (len(rules[k].pattern), -k), default=None)
                own = next((k for k in fits if k >= n_site and rules[k].verdict == "block"), None)
                found.append(None if site is None else rules[site].pattern.removeprefix("||"))
                verdicts.append(rules[site].verdict if site is not None else "allow" if own is None else "block")
                patterns.append(None if own is None else rules[own].pattern)
            out = arrow_rows(arrow, [batch.column("host"), batch.column("path"), found, verdicts, patterns])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *out.columns], names=["page_id", *arrow.names])

    return urls.mapInArrow(judge, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string, pattern string")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = {"op3_url_filters": r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'UPPER', 'LOWER') AS host,
                      regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  (SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS site,
  regexp_matches(host, '(^|\.)(cheap-pills|free-bets|porn|spam-farm|link-farm|ads-track|ads|tracking|doubleclick|casino-[^/?#]*|adult-[^/?#]*|porn-[^/?#]*)\.')
  OR regexp_matches(host, '(-pills|casino|-bets)\.')
  OR regexp_matches(host || path, '(/wp-login\.php|/cart/checkout|/user/login|/account/signup)([^a-z0-9_.%-]|$)|/cgi-bin/') AS junk FROM parts)
SELECT page_id, host, path, rule, coalesce(site, CASE WHEN junk THEN 'block' ELSE 'allow' END) AS verdict FROM judged
""".replace("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").replace("LOWER", "abcdefghijklmnopqrstuvwxyz")}
