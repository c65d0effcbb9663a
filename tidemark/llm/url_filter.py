"""URL filters: a trie over reversed host labels and then path segments, sent to the executors, longest match first.

A rule is (host, path, verdict). It fits its host and all subdomains whose path starts with the rule's path. Of the rules
that fit, the one whose host has more labels wins, then the one with the longer path; of equal rules ``block`` wins. A URL
that no rule fits is allowed. A trie holds ``MAX_RULES`` rules at most, which bounds its broadcast; a longer list takes one
trie after the other, each of which keeps the best rule so far where it has no better one.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
``#`` or the end. Null URLs and those without ``://`` have an empty host and path, and are allowed. Repeated rows give
repeated results; an empty table an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, written

DEFAULT_VERDICT = "allow"
#: The trie is broadcast; 200,000 rules take about 100 MB.
MAX_RULES = 200_000
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_AT = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = _AT.search(rest)
    host = rest[: cut.start()] if cut else rest
    path = _PATH_END.split(rest[len(host) :], maxsplit=1)[0]
    return host.translate(_LOWER), path


def _segments(path: str) -> tuple[list[str], str]:
    """Whole segments, each with its slash, and what follows the last slash."""
    *whole, rest = path.split("/")
    return [s + "/" for s in whole], rest


class RuleTrie:
    """Nodes are dictionaries; ``hosts`` has a child per label from the right, ``paths`` one per segment of its rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            whole, rest = _segments(path)
            node = node.setdefault("rules", {})
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("", ""))[1] != "block":
                host = host.translate(_LOWER)
                ends[rest] = (host + path, verdict, host.count(".") << 32 | len(path) << 1 | (verdict == "block"))
                if len(rest) not in (lengths := node.setdefault("lengths", [])):
                    lengths.append(len(rest))
                    lengths.sort(reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str, int] | None:
        """(rule, verdict, rank) of the longest rule that fits; a rule with a higher rank goes before one with a lower."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            best = self._by_path(node.get("rules"), path) or best
        return best

    @staticmethod
    def _by_path(node: dict | None, path: str) -> tuple[str, str, int] | None:
        best, start = None, 0
        while node is not None:
            slash = path.find("/", start)
            last = len(path) if slash < 0 else slash  # what follows a rule's last slash holds none
            for length in node.get("lengths", ()):
                if start + length <= last and (found := node["ends"].get(path[start : start + length])):
                    best = found
                    break
            if slash < 0:
                break
            node, start = node.get("paths", {}).get(path[start : slash + 1]), slash + 1
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT, most: int = MAX_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    spark, rules = pages.sparkSession, list(rules)
    schema = "key long, host string, path string, rule string, verdict string, rank long"
    found = None
    for start in range(0, max(1, len(rules)), most):
        sent = spark.sparkContext.broadcast(RuleTrie(rules[start : start + most]))

        def first(columns: dict[str, list], _: object, sent=sent) -> dict[str, list]:
            parts = [split_url(u) for u in columns["url"]]
            matches = [sent.value.match(*p) or (None, default, -1) for p in parts]
            return {"key": columns["key"], "host": [p[0] for p in parts], "path": [p[1] for p in parts], **{n: [m[i] for m in matches] for i, n in enumerate(("rule", "verdict", "rank"))}}

        def better(columns: dict[str, list], _: object, sent=sent) -> dict[str, list]:
            so_far = zip(*(columns[n] for n in ("rule", "verdict", "rank")), strict=True)
            matches = [max(s, sent.value.match(h, p) or s, key=lambda m: m[2]) for s, h, p in zip(so_far, columns["host"], columns["path"], strict=True)]
            return {n: columns[n] for n in ("key", "host", "path")} | {n: [m[i] for m in matches] for i, n in enumerate(("rule", "verdict", "rank"))}

        if found is None:
            found = map_batches(pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url")), first, schema)
        else:
            found = map_batches(written(spark, found, "url-rules"), better, schema)  # written: one trie is held at a time
            last.destroy()
        last = sent
    return found.drop("rank")


def op8(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, RULES).withColumnRenamed("key", "page_id")


ORACLE_SQL = r"""
with parts as (
  select page_id, coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, '') as rest from pages
), cut as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from parts
), split as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path
  from cut
), judged as (
  select page_id, host, path,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' end as rule
  from split
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from judged
"""
