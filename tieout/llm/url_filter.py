"""URL allow/block rules by a sort-merge range join.

A host is turned round (``www.example.com`` -> ``com.example.www.``), so a rule's host and all its
subdomains are one interval of keys: those that start with the rule's key. Rules and urls are
sorted together on that key by range partitioning and swept once; a stack holds the rules whose
interval is still open, nested hosts on top of each other. A partition starts with the rules that are
open at its first key: the ancestors of that key, found by an equi-join, so no task sees other partitions
and a host with a third of all urls is spread over many partitions (the sort key goes on with path and
a row hash).

Memory of a task: the rules of the hosts on the stack (one chain of nested hosts), never the rule list.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict. Rules with a null host, path or verdict are ignored; of equal rules with different verdicts
``block`` wins. The longest rule (host and path together) wins, on a tie the longer host. Rows are carried
through, never joined back, so repeated rows and null ids stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower

_CARRIED, _RULE, _URL = -1, 0, 1


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot: a domain's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ancestors(key: Column) -> Column:
    """Keys of the host itself and of every parent domain."""
    labels = F.split(F.regexp_replace(key, r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


class _Stack:
    """Open rules: one level for each nested host, each with its paths."""

    def __init__(self) -> None:
        self.levels: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close_before(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}, []))
        paths, lengths = self.levels[-1][1:]
        if path not in paths or verdict == "block":
            paths[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        for _, paths, lengths in reversed(self.levels):  # longer hosts first, so they keep ties
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if best[0] is None or len(hit[0]) > len(best[0]):
                        best = hit
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, part = _Stack(), None
    for batch in batches:
        rules: list[str | None] = []
        verdicts: list[str | None] = []
        cols = [batch.column(c).to_pylist() for c in ("part", "kind", "key", "path", "rule", "verdict")]
        for p, kind, key, path, rule, verdict in zip(*cols, strict=True):
            if p != part:
                stack, part = _Stack(), p
            stack.close_before(key)
            if kind != _URL:
                stack.open(key, path, rule, verdict)
                continue
            found = stack.longest(path)
            rules.append(found[0])
            verdicts.append(found[1])
        urls = batch.filter(pa.array([k == _URL for k in cols[1]], pa.bool_()))
        if urls.num_rows:
            yield pa.RecordBatch.from_arrays(
                [urls.column("row"), urls.column("host"), urls.column("path"), pa.array(rules, pa.string()),
                 pa.array(verdicts, pa.string())], names=["row", "host", "path", "rule", "verdict"])


def apply_url_rules(rows: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None,
                    default: str = "allow") -> DataFrame:
    """``rules``: columns host, path, verdict (``allow`` / ``block``). Returns the ``keep`` columns of ``rows``
    (all by default) in the struct ``row``, then host, path, rule (host + path, or null) and verdict."""
    keep = rows.columns if keep is None else keep
    urls = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), url_host(F.col(f"`{url}`")).alias("host"),
                       url_path(F.col(f"`{url}`")).alias("path"))
    urls = urls.select("row", "host", "path", F.when(F.col("host") == "", "").otherwise(host_key(F.col("host"))).alias("key"),
                       F.lit(_URL).alias("kind"), F.lit(None).cast("string").alias("rule"),
                       F.lit(None).cast("string").alias("verdict"))
    host = ascii_lower(F.col("host"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).filter("host <> ''").select(
        host.alias("host"), "path", host_key(host).alias("key"), F.lit(_RULE).alias("kind"),
        F.concat(host, F.col("path")).alias("rule"), "verdict").distinct()
    empty_row = F.lit(None).cast(urls.schema["row"].dataType).alias("row")
    events = urls.unionByName(rules.select("*", empty_row))
    events = cut_lineage(events.repartitionByRange("key", "kind", "path", F.xxhash64("row"))
                         .withColumn("part", F.spark_partition_id()))
    firsts = events.groupBy("part").agg(F.min("key").alias("first")).select("part", F.explode(_ancestors(F.col("first"))).alias("key"))
    carried = firsts.join(rules.drop("kind"), "key").select(
        "host", "path", "key", F.lit(_CARRIED).alias("kind"), "rule", "verdict", empty_row, "part")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = (events.unionByName(carried).repartitionByRange(n, "part")
             .sortWithinPartitions("part", F.col("kind") != _CARRIED, "key", "kind", "path"))
    out = swept.mapInArrow(_sweep, urls.select("row", "host", "path", "rule", "verdict").schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
