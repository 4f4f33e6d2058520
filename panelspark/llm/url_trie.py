"""URL filter: a trie over reversed host labels and path segments, with the longest rule winning.

A rule is (verdict, host, path). It fits its host and all subdomains where the url's path
starts with the rule's path. Of several that fit, the one with most host labels wins, then the
one with the longest path; of an allow and a block entry for one place, block wins. Where none fits, the
verdict is ``default``.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Rows are
independent; the input's columns stay, and one named like an output is replaced. The trie
goes to the tasks with the function; ``MAX_RULES`` bounds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_with, texts, with_column

MAX_RULES = 1_000_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

Rule = tuple[str, str, str]


class Trie:
    """Host labels from the right lead to nodes; from each, complete path segments lead on.

    A rule's last path piece need not be a complete segment: it stands at its node as a tail
    that the url's next segment must start with.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *segments, tail = path.split("/")
            node = node.setdefault("paths", {})
            for s in segments:
                node = node.setdefault("next", {}).setdefault(s, {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("", "allow"))[1] == "allow":
                tails[tail] = (host + path, verdict)

    def look_up(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._in_path(node["paths"], path) or best
        return best

    @staticmethod
    def _in_path(node: dict, path: str) -> tuple[str, str] | None:
        best, start = None, 0
        while node is not None:
            end = path.find("/", start)
            segment = path[start:] if end < 0 else path[start:end]
            for tail in sorted(node.get("tails", ()), key=len, reverse=True):
                if segment.startswith(tail):
                    best = node["tails"][tail]
                    break
            if end < 0:
                break
            node, start = node.get("next", {}).get(segment), end + 1
        return best


def parts(url: str) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    m = _URL.search(url)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    trie = Trie(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u) for u in texts(batch, url)]
            found = [trie.look_up(*p) for p in split]
            yield with_column(
                batch,
                host=pa.array([h for h, _ in split], pa.string()),
                path=pa.array([p for _, p in split], pa.string()),
                rule=pa.array([f and f[0] for f in found], pa.string()),
                verdict=pa.array([f[1] if f else default for f in found], pa.string()),
            )

    return pages.mapInArrow(run, schema_with(pages, "host string", "path string", "rule string", "verdict string"))
