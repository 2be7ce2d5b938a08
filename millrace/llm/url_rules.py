"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is ``host/path``; it fits its host and every subdomain if the url's path starts with the rule's path.
Of the rules that fit, the longest text wins; equal lengths prefer the longer host, then ``block``.

Cases: a null url or one without ``://`` has an empty host and path and gets the default verdict; an empty
host matches no rule; empty rule lists give the default everywhere; extra columns are not read; repeated
rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns

#: Rules are configuration, broadcast to every worker; more text than this is refused rather than shipped.
MAX_RULE_BYTES = 64 << 20

_UPPER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


class RuleTrie:
    """host labels from the right -> path segments -> (verdict, rule text); unfinished last segments are kept as tails."""

    def __init__(self, block: Iterable[str], allow: Iterable[str]):
        self.root: dict = {}
        for verdict, rules in (("block", block), ("allow", allow)):
            for rule in rules:
                self._add(rule, verdict)

    def _add(self, rule: str, verdict: str) -> None:
        host, slash, path = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.setdefault("hosts", {}).setdefault(label, {})
        *whole, tail = (slash + path).split("/")
        node = node.setdefault("paths", {})
        for segment in whole:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        known = node.setdefault("tails", {}).get(tail)
        if known is None or verdict == "block":
            node["tails"][tail] = (verdict, rule)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest fitting rule, or None."""
        if not host:
            return None
        best, rank = None, (-1, -1)
        node, used = self.root, 0
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            used += len(label) + 1
            here, segments = node.get("paths"), path.split("/")
            for i, segment in enumerate(segments):
                if here is None:
                    break
                for tail, found in here.get("tails", {}).items():
                    if segment.startswith(tail) and (r := (len(found[1]), used)) > rank:
                        best, rank = found, r
                if i + 1 < len(segments):
                    here = here.get("segments", {}).get(segment)
        return best


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def judge(df: DataFrame, block: list[str], allow: list[str], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict of each row. No shuffle: one Arrow-batched pass over the url column alone."""
    if sum(map(len, [*block, *allow])) > MAX_RULE_BYTES:
        raise ValueError("the rule lists are too large to broadcast")
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(block, allow))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def look(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            found = trie.value.match(host, path)
            rows.append((host, path, found[1] if found else None, found[0] if found else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return columns(df, key, url).select(F.col(key), look(F.col(url)).alias("r")).select(key, "r.host", "r.path", "r.rule", "r.verdict")
