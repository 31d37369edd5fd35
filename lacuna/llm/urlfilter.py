"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z, 0-9) that every URL it fits must
hold. Token frequencies over all URLs choose each rule's rarest token, and the index maps that token to
its rules. A URL is cut into tokens, those fetch the candidate rules, and only the candidates'
expressions run. Rules without tokens are candidates for every URL.

Two kinds of rules are judged. Site rules (host and path prefix, the longest that fits wins) come
first; where none fits, the pattern rules decide: an allowing one beats blocking ones, and without
either the URL is allowed. Rules are a configuration of bounded size (``MAX_RULES``), so the index is
sent to the tasks; counts of tokens that no rule holds aren't kept.

A null URL or one without ``://`` has an empty host and an empty path; tokens are then those of the
whole text, and only pattern rules may fit it. Long URLs are judged whole. Equal rows get equal rows;
an empty table gives an empty table. The input's other columns aren't returned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import lean

MAX_RULES = 100_000
TOKEN = re.compile("[a-z0-9]+")
#: host, path, verdict
SITES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Patterns in the way of ad lists: || starts at a host label, ^ is a separator or the end, * anything, @@ allows.
PATTERNS = ("||spam-farm.", "^casino^", "/adserver/", "^xxx^", "||click.*^track^", "?affiliate=*&campaign=", "@@||*.example.org/robots.txt")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]
    #: length of a site rule's name; 0 for patterns
    weight: int


def _tokens_of(literals: str, whole_start: bool, whole_end: bool) -> list[str]:
    """Tokens of a literal piece that are whole tokens of any URL which holds the piece."""
    found = list(TOKEN.finditer(literals))
    return [m[0] for m in found if (m.start() > 0 or whole_start) and (m.end() < len(literals) or whole_end)]


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains if the URL's path starts with ``path``. Judged on host + path."""
    expression = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    tokens = _tokens_of(host, True, True) + _tokens_of(path, True, False)
    return Rule(host + path, verdict, expression, tuple(dict.fromkeys(tokens)), len(host + path))


def pattern_rule(pattern: str) -> Rule:
    """Judged on the whole URL, lower-cased."""
    verdict, body = ("allow", pattern[2:]) if pattern.startswith("@@") else ("block", pattern)
    head, body = (r"^[^:/?#]*://(?:[^/?#]*\.)?", body[2:]) if body.startswith("||") else ("", body)
    body = body.lower()
    pieces = re.split(r"([*^])", body)
    expression, tokens = head, []
    for k, piece in enumerate(pieces):
        if piece == "*":
            expression += ".*"
        elif piece == "^":
            expression += r"(?:[^a-z0-9_.%-]|$)" if expression != "" else r"(?:^|[^a-z0-9_.%-])"
        elif piece:
            expression += re.escape(piece)
            tokens += _tokens_of(piece, pieces[k - 1] == "^" if k else bool(head), k + 1 < len(pieces) and pieces[k + 1] == "^")
    return Rule(pattern, verdict, expression, tuple(dict.fromkeys(tokens)), 0)


def rules_of(sites=SITES, patterns=PATTERNS) -> list[Rule]:
    rules = [site_rule(*x) for x in sites] + [pattern_rule(x) for x in patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    return rules


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token (ties: the longer, then the smaller); those without any under ''."""
    index: dict[str, list[int]] = defaultdict(list)
    for k, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")].append(k)
    return dict(index)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


class Judge:
    def __init__(self, rules: list[Rule], index: dict[str, list[int]]):
        self.rules, self.index = rules, index
        self.compiled = [re.compile(r.expression, re.DOTALL) for r in rules]

    def candidates(self, text: str) -> list[int]:
        tokens = {"", *TOKEN.findall(text)}
        return [k for t in tokens if t in self.index for k in self.index[t]]

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        whole = (url or "").lower()
        place = host + path
        best, blocked, allowed = None, False, False
        for k in self.candidates(f"{whole} {place}"):
            rule = self.rules[k]
            if rule.weight:
                if host and self.compiled[k].match(place) and (best is None or (rule.weight, rule.name) > (best.weight, best.name)):
                    best = rule
            elif self.compiled[k].search(whole):
                allowed |= rule.verdict == "allow"
                blocked |= rule.verdict == "block"
        if best:
            return host, path, best.name, best.verdict
        return host, path, None, "block" if blocked and not allowed else "allow"


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; at most one row a token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1))
    known = F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted])) if wanted else F.array().cast("array<string>")
    return {r["token"]: r["n"] for r in pages.select(F.explode(known).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url)."""
    rules = rules if rules is not None else rules_of()
    index = build_index(rules, token_counts(pages, rules))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verdict_of = Judge(rules, index)
        for part in parts:
            found = [verdict_of(u if isinstance(u, str) else None) for u in part["url"]]
            out = pd.DataFrame(found, columns=["host", "path", "rule", "verdict"], dtype=object)
            out.insert(0, "page_id", part["page_id"].array)
            yield out

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url").mapInPandas(lean(run), f"page_id {kind}, host string, path string, rule string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, url, lower(COALESCE(url, '')) AS whole,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN host = '' THEN NULL
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(whole, '^[^:/?#]*://([^/?#]*\.)?.*\.example\.org/robots\.txt') THEN 'allow'
    WHEN regexp_matches(whole, '^[^:/?#]*://([^/?#]*\.)?spam-farm\.')
      OR regexp_matches(whole, '(^|[^a-z0-9_.%-])(casino|xxx)([^a-z0-9_.%-]|$)')
      OR contains(whole, '/adserver/')
      OR regexp_matches(whole, '^[^:/?#]*://([^/?#]*\.)?click\..*([^a-z0-9_.%-]|$)track([^a-z0-9_.%-]|$)')
      OR regexp_matches(whole, '\?affiliate=.*&campaign=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
