"""URL filters: a trie over reversed host labels and path segments, the longest fitting entry decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie is sent to every executor; a larger list is refused.
MOST_RULES = 500_000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].encode().lower().decode(), path[:stop]


class UrlTrie:
    """Allow and block entries ``host/path``, under host labels from the right, then path segments from the left.

    A node's ``ends`` are entries whose last, perhaps unfinished, segment must
    begin the url's next one.  The longest entry wins, then the longer host.
    Entries given twice count once; the same entry as allow and block is refused.
    """

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} entries; the trie is broadcast and holds {MOST_RULES} at most")
        self.root: dict = {}
        said: dict[str, str] = {}
        for verdict, rule in rules:
            if said.setdefault(rule, verdict) != verdict:
                raise ValueError(f"{rule} is both allowed and blocked")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            if not slash:
                node["any"] = (len(rule), len(host), rule, verdict)
                continue
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", []).append((last, (len(rule), len(host), rule, verdict)))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits, if any does."""
        best = None
        segments = path[1:].split("/") if path.startswith("/") else []
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            if at is None:
                continue
            if "any" in at:
                best = max(best, at["any"]) if best else at["any"]
            for segment in segments:
                for last, entry in at.get("ends", ()):
                    if segment.startswith(last):
                        best = max(best, entry) if best else entry
                at = at.get("segments", {}).get(segment)
                if at is None:
                    break
        return best[2:] if best else None


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` and ``verdict`` for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no entry
    and gets ``default``, as does any url no entry fits.  Repeated rows are each
    judged; an empty table gives an empty result; other columns are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(tuple(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.value.match(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                    pa.array([f[0] if f else None for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string")
