"""URL filters: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search.

A rule is a host and a path prefix; it fits its host and all subdomains. The rule's string (host and path) is hashed with
xxHash64; the sorted keys, the strings and the verdicts form one file that the driver hands to the executors, which map
it. A URL's candidates are its host's suffixes at label borders, each with every path length that some rule has. Hits in
the key array are confirmed against the stored string, through all rows of an equal key; the longest rule wins, of equal
lengths the one with the longer host.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; URLs that fit none get
DEFAULT; an empty rule list is allowed; repeated rows give equal rows; an empty table gives an empty result. Only page_id
and url are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import ascii_lower, put_file

#: Rules of the contract: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"
HEAD = "<QQ"


def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index file: counts, sorted keys, string offsets, host lengths, verdicts (1: block), path lengths in use, strings."""
    import xxhash

    rows = sorted({(xxhash.xxh64_intdigest(host + path), host + path, len(host), verdict == "block") for verdict, host, path in rules})
    strings = [r[1].encode() for r in rows]
    lengths = sorted({len(r[1]) - r[2] for r in rows})
    parts = [
        np.array([r[0] for r in rows], "<u8"),
        np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype("<u8"),
        np.array([r[2] for r in rows], "<u8"),
        np.array([r[3] for r in rows], "<u8"),
        np.array(lengths, "<u8"),
    ]
    return struct.pack(HEAD, len(rows), len(lengths)) + b"".join(p.tobytes() for p in parts) + b"".join(strings)


class Index:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, m = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
        data = np.memmap(path, np.uint8, "r")
        at = struct.calcsize(HEAD)
        self.n = n
        views = []
        for size in (n, n + 1, n, n, m):
            views.append(data[at : at + 8 * size].view("<u8"))
            at += 8 * size
        self.keys, self.offsets, self.hosts, self.blocks, self.lengths = views
        self.strings = data[at:]
        self.longest_host = int(self.hosts.max()) if n else 0

    def string(self, row: int) -> str:
        return self.strings[int(self.offsets[row]) : int(self.offsets[row + 1])].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """(rule, verdict) of each host and path."""
        import xxhash

        found: list[tuple[int, int, int] | None] = [None] * len(hosts)
        lengths = self.lengths.tolist()
        owner, texts = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            # No rule's host is longer than longest_host, so a host of any length has few suffixes to try.
            suffix = host[-self.longest_host - 1 :] if len(host) > self.longest_host else host
            if len(host) > self.longest_host:
                suffix = suffix.partition(".")[2]
            while suffix:
                for k in lengths:
                    if k > len(path):
                        break
                    owner.append(i)
                    texts.append(suffix + path[:k])
                suffix = suffix.partition(".")[2]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, keys)
        for c in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, max(self.n - 1, 0))] == keys) if self.n else []):
            row = int(at[c])
            while row < self.n and self.keys[row] == keys[c]:
                if self.string(row) == texts[c]:
                    rank = (len(texts[c]), int(self.hosts[row]), row)
                    if found[owner[c]] is None or rank > found[owner[c]]:
                        found[owner[c]] = rank
                row += 1
        return [(None, DEFAULT) if r is None else (self.string(r[2]), "block" if self.blocks[r[2]] else "allow") for r in found]


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """The index file's name, once it is on its way to the executors. Equal rules share one file."""
    data = pack(rules)
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    spark.sparkContext.addFile(put_file(spark, name, data))
    return name


def split_url() -> list:
    """Host and path by built-in functions: after the first ://, up to / ? # or the end; then up to ? or #."""
    rest = F.when(F.contains(F.col("url"), F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [ascii_lower(F.coalesce(host, F.lit(""))).alias("host"), F.coalesce(path, F.lit("")).alias("path")]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``."""
    name = ship(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        index = Index(SparkFiles.get(name))
        for batch in batches:
            judged = index.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", *split_url()).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
