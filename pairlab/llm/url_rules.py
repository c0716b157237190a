"""Allow and block lists of URLs: a trie over reversed host labels and path
segments, with the longest match deciding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, pick

DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased) and path (from there up to ``?``, ``#`` or the end); both empty
    for null and for texts without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (
        F.coalesce(F.translate(host, upper, lower), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


@dataclass
class Node:
    """Children by label or by whole path segment; rules that end here, by what
    the next segment must start with."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)


class Trie:
    """Rules ``(verdict, host, path)``. A rule fits its host and all subdomains if
    the path starts with the rule's. More host labels win, then the longer path;
    of equal rules block wins. A rule without a host fits every host."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".") if host else []):
                node = node.labels.setdefault(label, Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            if node.ends.get(rest, ("", ""))[1] != "block":
                node.ends[rest] = host + path, verdict

    @staticmethod
    def _longest(node: Node, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for segment in segments:
            if node.ends:
                for n in range(len(segment), -1, -1):
                    if segment[:n] in node.ends:
                        found = node.ends[segment[:n]]
                        break
            node = node.segments.get(segment)
            if node is None:
                break
        return found

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides and its verdict."""
        segments = path.split("/")
        node, found = self.root, self._longest(self.root, segments)
        for label in reversed(host.split(".") if host else []):
            node = node.labels.get(label)
            if node is None:
                break
            found = self._longest(node, segments) or found
        return found


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str):
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(
                batch.column("host").to_pylist(),
                batch.column("path").to_pylist(),
                strict=True,
            )
            found = [trie.value.judge(*pair) or (None, default) for pair in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.string()),
                ],
                [*batch.schema.names, "rule", "verdict"],
            )

    schema = "page_id bigint, host string, path string, rule string, verdict string"
    return urls.mapInArrow(work, schema)


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rules beyond a broadcast: every distinct (host,
    path) meets the rules of each of its host suffixes and whole-segment
    prefixes by equality; what is left of a rule's path is compared as text."""
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(0), F.size(labels)),
        lambda n: F.struct(
            n.alias("depth"),
            F.when(n == 0, F.lit(""))
            .otherwise(F.array_join(F.slice(labels, -n, n), "."))
            .alias("suffix"),
        ),
    )
    segments = F.split("path", "/")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda n: F.when(n == 1, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(segments, 1, n - 1), "/"), F.lit("/"))
        ),
    )
    keyed = (
        pairs.withColumn("s", F.explode(suffixes))
        .select("host", "path", "s.*")
        .withColumn("head", F.explode(heads))
    )
    sides = rules.select(
        F.col("host").alias("suffix"),
        F.regexp_extract("path", "(?s)^(.*/|)", 1).alias("head"),
        F.col("path").alias("rule_path"),
        "verdict",
    )
    best = F.max_by(
        F.struct(F.concat("suffix", "rule_path").alias("rule"), "verdict"),
        F.struct("depth", F.length("rule_path"), "verdict"),
    )
    judged = (
        keyed.join(sides, ["suffix", "head"])
        .where(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(best.alias("best"))
    )
    return urls.join(judged, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] | DataFrame,
    default: str = DEFAULT,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null where none fits) and
    ``verdict`` (the rule's, else ``default``) of every row of ``pages``.

    ``rules`` are (verdict, host, path), listed or as a table of these columns; a
    table is measured, and up to ``limit`` bytes of rules become a trie that is
    broadcast. Larger tables are joined instead, with the same result. Null urls
    have an empty host and path; repeated rows are judged each; an empty table
    gives an empty result; only ``page_id`` and ``url`` are read.
    """
    host, path = split_url(F.col("url"))
    urls = pick(pages, page_id="page_id", url="url").select(
        F.col("page_id").cast("bigint").alias("page_id"),
        host.alias("host"),
        path.alias("path"),
    )
    if isinstance(rules, DataFrame):
        table = pick(rules, verdict="verdict", host="host", path="path").fillna("")
        width = F.octet_length("host") + F.octet_length("path") + F.lit(200)
        if (table.agg(F.sum(width)).head()[0] or 0) > limit:
            return _by_join(urls, table, default)
        rules = [tuple(row) for row in table.collect()]
    return _by_trie(urls, list(rules), default)
