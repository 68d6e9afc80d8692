"""URL filters: host rules by longest match, then pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression. From it are read the literal tokens,
runs of letters and digits, that each of its matches contains as whole tokens;
it is filed under that of them which is rarest among the URLs at hand. The
tokens of a URL fetch the rules filed under them, and only those run their
expressions. Rules without a whole token run on each URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Verdict, host with subdomains, path prefix. Fixed values.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _parts(pattern: str) -> Iterator[str]:
    """Atoms of a pattern with their quantifiers: ``x`` for one literal character, else as written."""
    atom = r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:[^()\\\[]|\\.|\[(?:\\.|[^\]\\])*\])*\)|."
    return (m.group() for m in re.finditer(rf"(?:{atom})(?:[*+?]|\{{\d*,?\d*\}})?\??", pattern, re.S))


def _is_gap(part: str) -> bool:
    """Whether the atom is an anchor, or characters that are in no token, at least one of them."""
    if part in ("^", "$", r"\b", r"\A", r"\Z"):
        return True
    if part[0] == "(":
        group = re.fullmatch(r"\((?:\?:)?([^()]*)\)", part)
        return bool(group) and all(len(x) and all(map(_is_gap, _parts(x))) for x in group[1].split("|"))
    body, often = re.fullmatch(r"(.*?)([*+?]|\{\d*,?\d*\})?\??", part, re.S).groups() if len(part) > 1 and part[0] not in "\\[" else (part, None)
    if part[0] in "\\[":
        end = 2 if part[0] == "\\" else part.rindex("]") + 1
        body, often = part[:end], part[end:]
    if often and (often[0] in "*?" or re.match(r"\{0?,", often) or often.startswith("{0")):
        return False
    if body[0] == "[":
        inner = re.sub(r"\\([^A-Za-z0-9])", r"\1", body[1:-1])
        return inner[:1] != "^" and not re.search(r"[A-Za-z0-9\\]|(?<=.)-(?=.)", inner, re.S)
    return bool(re.fullmatch(r"\\[^A-Za-z0-9]|[^A-Za-z0-9\\.()|?*+{}\[\]]", body))


def whole_tokens(pattern: str) -> tuple[str, ...]:
    """Runs of a-z and 0-9 that stand as whole tokens in whatever lower-case text ``pattern`` matches; none where that can't be read off."""
    found, run, after_gap = [], "", False
    parts = list(_parts(pattern))
    if "|" in parts:
        return ()
    for part in parts:
        if re.fullmatch("[a-z0-9]", part):
            run += part
            continue
        gap = _is_gap(part)
        if run and after_gap and gap:
            found.append(run)
        run, after_gap = "", gap
    return tuple(dict.fromkeys(found))  # a run at the end may go on


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return whole_tokens(self.pattern)


def read_rules(lines: Iterable[str]) -> tuple[PatternRule, ...]:
    """Rules from lines of a verdict and a pattern; blank lines and those that begin with # are left out."""
    parts = (line.split(None, 1) for line in lines if line.strip() and not line.startswith("#"))
    return tuple(PatternRule(verdict, pattern.strip()) for verdict, pattern in parts)


#: The rules of the query, tried in this order.
PATTERN_RULES = read_rules(
    r"""
allow ^[a-z]+://docs\.
block [/.]ads[/.]
block /wp-login\.php
block \bcasino\b
block [?&]ref=x\b
block \?page=[0-9]+&ref=
block /tracker\.gif
block (?:^|[/.])xxx(?:[/.]|$)
block ^[a-z]+://m\..*\.html$
""".splitlines()
)
_TOKEN = re.compile("[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


class UrlFilter:
    def __init__(self, token_counts: dict[str, int], rules=PATTERN_RULES, host_rules=HOST_RULES) -> None:
        self.hosts: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in host_rules:
            self.hosts.setdefault(host, []).append((verdict, path, host + path))
        self.index: dict[str | None, list[tuple[int, str, re.Pattern]]] = {}
        for i, rule in enumerate(rules):
            rarest = min(rule.tokens, key=lambda t: (token_counts.get(t, 0), t), default=None)
            self.index.setdefault(rarest, []).append((i, rule.verdict, re.compile(rule.pattern)))

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and name of the longest rule for the host or one of its parents that the path starts with."""
        best, at = None, host
        while at:
            for verdict, prefix, name in self.hosts.get(at, ()):
                if path.startswith(prefix) and (best is None or len(name) > len(best[1])):
                    best = verdict, name
            at = at.partition(".")[2]
        return best

    def candidates(self, low: str) -> list[tuple[int, str, re.Pattern]]:
        """The rules whose expressions are run on a URL in lower case, in their order."""
        tokens = {None, *_TOKEN.findall(low)}
        return sorted((rule for token in tokens & self.index.keys() for rule in self.index[token]), key=itemgetter(0))

    def verdict(self, url: str | None) -> str:
        """That of the first pattern rule that matches; allow where none does."""
        low = (url or "").lower()
        return next((verdict for _, verdict, pattern in self.candidates(low) if pattern.search(low)), "allow")


def rule_token_counts(urls: DataFrame, rules=PATTERN_RULES) -> dict[str, int]:
    """How many URLs hold each token of the rules, over all ``urls`` (url). To the driver: a row for each token of the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1))
    kept = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    return {r.token: r["n"] for r in urls.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules=PATTERN_RULES, host_rules=HOST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url; other columns are ignored).

    A host rule decides alone; else the pattern rules do. Null urls, and those
    without ``://``, have an empty host and path and no host rule. Null ids and
    repeated rows come back as they are, and an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    counts = rule_token_counts(pages, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = UrlFilter(counts, rules, host_rules)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                by_host = found.host_rule(host, path)
                row = (host, path, by_host and by_host[1], by_host[0] if by_host else found.verdict(url))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each row of ``pages``; what ``filter_urls`` says of nulls, repeats and empty tables holds."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
