"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix. Its literal tokens are its host labels and the whole segments of its path; it is filed
under the one that fewest rules hold (then the longer, then the first in order). A URL's tokens fetch candidate rules from
that index, and only those run their regular expressions. Of the rules that fit, the longest wins; among equally long
ones that with the longer host, then a block.

Rules are given as a list, which the driver holds and tasks get: MAX_RULES bounds one broadcast, and a longer list is applied
in blocks of that many, one pass over the URLs for each, the winner so far carried along.

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default verdict. Repeated rows
give repeated rows; very long urls are taken whole. Every other column is dropped unless named in ``keep``; a kept one that is named
like a result (host, path, rule, verdict) comes back with underscores before its name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, arrow_map

#: Rules that one pass sends to every task (about 100 bytes each).
MAX_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        *whole, _ = self.path.split("/")  # the last piece of a prefix may be part of a segment
        return [x for x in self.host.split(".") + ["/" + x for x in whole] if x.strip("/")]

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """Of the whole host and of the path's beginning: apart, as a host may hold any sign but those that end it."""
        return re.compile(rf"(?:.*\.)?{re.escape(self.host)}", re.S), re.compile(re.escape(self.path))

    def rank(self) -> tuple:
        return len(self.name), len(self.host), self.verdict == "block", self.name


class RuleIndex:
    def __init__(self, rules: list[Rule]):
        held = Counter(t for r in rules for t in set(r.tokens()))
        self.by_token: dict[str, list[tuple[Rule, re.Pattern, re.Pattern]]] = defaultdict(list)
        for r in rules:
            rarest = min(r.tokens(), key=lambda t: (held[t], -len(t)))
            self.by_token[rarest].append((r, *r.patterns()))

    def winner(self, host: str, path: str, best: Rule | None = None) -> Rule | None:
        get = self.by_token.get
        for token in {*host.split("."), *("/" + x for x in path.split("/"))}:
            for rule, of_host, of_path in get(token, ()):
                if (best is None or rule.rank() > best.rank()) and of_path.match(path) and of_host.fullmatch(host):
                    best = rule
        return best


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path by the text after the first ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def judge(df: DataFrame, rules: list[tuple[str, str, str]], keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """rules: (verdict, host, path prefix). The columns of ``keep`` with host, path, rule (null if none fits) and verdict."""
    columns, keep = apart(df, keep, "host", "path", "rule", "verdict", "won", "url")
    df = df.select(*columns, F.col(f"`{url}`").cast("string").alias("url"))
    types = dict(df.dtypes)
    listed = list(dict.fromkeys(Rule(v, h.lower(), p) for v, h, p in rules))
    if any(not r.tokens() for r in listed):
        raise ValueError("a rule needs a literal token")
    out = host_and_path(df).select(*keep, "host", "path", F.lit(None).cast("array<string>").alias("won"))
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["host string, path string, won array<string>"])
    for i in range(0, len(listed), MAX_RULES):
        block = df.sparkSession.sparkContext.broadcast(listed[i : i + MAX_RULES])

        def make(block=block):
            index = RuleIndex(block.value)

            def work(*columns):
                *kept, hosts, paths, won = columns
                new = [index.winner(h, p, Rule(*w) if w else None) for h, p, w in zip(hosts, paths, won)]
                return [*kept, hosts, paths, [list(r) if r else None for r in new]]

            return work

        out = arrow_map(out, [*keep, "host", "path", "won"], schema, make)
    return out.select(*keep, "host", "path", F.concat(F.col("won")[1], F.col("won")[2]).alias("rule"), F.coalesce(F.col("won")[0], F.lit(default)).alias("verdict"))
