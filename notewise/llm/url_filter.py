"""URL filters: allow and block rules looked up in a sorted digest array.

A rule is (host, path, verdict); it fits a URL if the URL's host is the rule's
or a subdomain of it and the URL's path starts with the rule's. The longest
fitting rule (host plus path, then host) decides; a URL that no rule fits is
allowed, as it is in no list.

A list is two sorted arrays of 64-bit xxHash keys, one of the rules' hosts
(with the path lengths that occur under each) and one of host + path, in
memory-mapped files beside the full strings. URLs are probed by batch: the
digests of all host suffixes by one binary search; for the suffixes that are
listed, the digests of host + path prefix by another; each hit is confirmed
against the stored string, so a digest collision decides nothing.

The index is sent to the executors only if it is no larger than
``max_index_bytes``; each worker process maps one copy. A larger list is
joined instead, on digest and full string, as a shuffled join.

Cases: a null URL or one without ``://`` has an empty host and path and is
allowed; rules without a host are left out; equal rules with both verdicts
block; repeated rows are judged one by one; an empty list allows all; other
columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.staging import staged

SEED = 42  # fixed value: the seed of Spark's xxhash64, so that both sides agree
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def with_host_and_path(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path: host is lower-cased (A-Z) and ends at /, ? or #; path ends at ? or #."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path), block over allow."""
    r = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"),
                     F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
    return (r.where("host is not null and host <> ''").groupBy("host", "path")
            .agg(F.max(F.col("verdict") == BLOCK).alias("block")))


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, SEED)


class DigestIndex:
    """The two sorted key arrays and the strings behind them, in mapped files of one folder."""

    def __init__(self, folder: str):
        def load(name):
            path = os.path.join(folder, name + ".npy")
            a = np.load(path)
            return np.load(path, mmap_mode="r") if a.size else a  # an empty file can't be mapped
        self.host_keys, self.host_lengths, self.host_first = load("host_keys"), load("host_lengths"), load("host_first")
        self.keys, self.split, self.block, self.first = load("keys"), load("split"), load("block"), load("first")
        self.blob, self.host_blob = load("blob"), load("host_blob")
        self.host_at = load("host_at")

    @staticmethod
    def arrays(rows) -> dict[str, np.ndarray]:
        """The arrays of a list of (host, path, block)."""
        by_host: dict[bytes, set] = {}
        full = []
        for host, path, block in rows:
            h, p = host.encode(), path.encode()
            by_host.setdefault(h, set()).add(len(p))
            full.append((digest(h + p), h + p, len(h), bool(block)))
        full.sort()
        hosts = sorted((digest(h), h, sorted(n)) for h, n in by_host.items())
        ends = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs], dtype=np.int64)]).astype(np.int64)
        return {
            "keys": np.array([f[0] for f in full], dtype=np.uint64), "first": ends([f[1] for f in full]),
            "blob": np.frombuffer(b"".join(f[1] for f in full), dtype=np.uint8),
            "split": np.array([f[2] for f in full], dtype=np.int32), "block": np.array([f[3] for f in full], dtype=bool),
            "host_keys": np.array([h[0] for h in hosts], dtype=np.uint64), "host_at": ends([h[1] for h in hosts]),
            "host_blob": np.frombuffer(b"".join(h[1] for h in hosts), dtype=np.uint8),
            "host_first": ends([h[2] for h in hosts]),
            "host_lengths": np.array([n for h in hosts for n in h[2]], dtype=np.int32)}

    @staticmethod
    def write(folder: str, arrays: dict[str, np.ndarray]) -> None:
        for name, a in arrays.items():
            np.save(os.path.join(folder, name + ".npy"), a)

    @staticmethod
    def _find(keys, first, blob, probes: list[bytes]) -> list[int]:
        """Row of each probe, or -1: binary search over the digests, then the strings of equal digests."""
        if not len(keys) or not probes:
            return [-1] * len(probes)
        d = np.array([digest(p) for p in probes], dtype=np.uint64)
        left, right = np.searchsorted(keys, d, "left"), np.searchsorted(keys, d, "right")
        found = [-1] * len(probes)
        for i in np.flatnonzero(right > left).tolist():
            for r in range(left[i], right[i]):
                if blob[first[r]:first[r + 1]].tobytes() == probes[i]:
                    found[i] = r
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """Rule (or None) and verdict of each URL."""
        distinct = list(dict.fromkeys(hosts))
        suffixes = {h: [h.encode()] + [h[i + 1:].encode() for i, c in enumerate(h) if c == "." and i + 1 < len(h)]
                    for h in distinct}
        probes = list(dict.fromkeys(s for h in distinct for s in suffixes[h] if s))
        row_of = dict(zip(probes, self._find(self.host_keys, self.host_at, self.host_blob, probes)))
        wanted = {}
        for h in distinct:
            options = [(len(s) + int(n), len(s), s, int(n)) for s in dict.fromkeys(suffixes[h]) if row_of.get(s, -1) >= 0
                       for n in self.host_lengths[self.host_first[row_of[s]]:self.host_first[row_of[s] + 1]]]
            wanted[h] = sorted(options, reverse=True)
        keys, owner = [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            if wanted[h]:
                raw = p.encode()
                for _, _, s, n in wanted[h]:
                    if n <= len(raw):
                        keys.append(s + raw[:n])
                        owner.append(i)
        rule, verdict = [None] * len(hosts), [ALLOW] * len(hosts)
        for i, r, key in zip(owner, self._find(self.keys, self.first, self.blob, keys), keys):
            if r >= 0 and rule[i] is None:
                rule[i], verdict[i] = key.decode("utf-8", "replace"), BLOCK if self.block[r] else ALLOW
        return rule, verdict


_OPEN: dict[str, DigestIndex] = {}


def _index(token: str, arrays) -> DigestIndex:
    """This process's index for a token; the files go as soon as they are mapped."""
    if token not in _OPEN:
        with tempfile.TemporaryDirectory() as folder:
            DigestIndex.write(folder, arrays)
            _OPEN.clear()
            _OPEN[token] = DigestIndex(folder)
    return _OPEN[token]


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                max_index_bytes: int = 64 << 20) -> DataFrame:
    """id, host, path, rule, verdict of each row of ``pages``; ``rules`` has host, path, verdict."""
    urls = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")),
                              "url").drop("url")
    rules = staged(clean_rules(rules), "url-rules")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0))).first()[0]
    return _probe(urls, rules) if size <= max_index_bytes else join_rules(urls, rules)


def _probe(urls: DataFrame, rules: DataFrame) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(DigestIndex.arrays(
        (r.host, r.path, r.block) for r in rules.toLocalIterator()))
    token = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            rule, verdict = _index(token, shared.value).judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()),
                                              pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same result as a join, for lists of any size: suffixes of the distinct
    hosts meet the listed hosts, then host + path prefixes meet the rules."""
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.expr("transform(sequence(1, size(split(host, '\\\\.'))), "
                              "i -> array_join(slice(split(host, '\\\\.'), i, size(split(host, '\\\\.'))), '.'))"))
    listed = rules.groupBy("host").agg(F.collect_set(F.octet_length("path")).alias("lengths")).withColumnRenamed(
        "host", "suffix")
    hosts = (pairs.select("host").distinct().where(F.size(labels) > 0).select("host", suffix.alias("suffix"))
             .join(listed, "suffix").select("host", "suffix", F.explode("lengths").alias("n")))
    raw = F.col("path").cast("binary")
    tries = (pairs.join(hosts, "host").where(F.octet_length("path") >= F.col("n"))
             .select("host", "path", "suffix", F.substring(raw, F.lit(1), F.col("n")).alias("start")))
    tries = tries.withColumn("key", F.xxhash64(F.concat(F.col("suffix").cast("binary"), F.col("start"))))
    table = rules.select(F.xxhash64(F.concat(F.col("host").cast("binary"), F.col("path").cast("binary"))).alias("key"),
                         F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "block",
                         F.col("path").cast("binary").alias("start"))
    hits = tries.join(table, ["key", "suffix", "start"])
    order = F.struct(F.octet_length("suffix") + F.octet_length("rule_path"), F.octet_length("suffix"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), "block"),
                                                     order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.block"), BLOCK).otherwise(ALLOW).alias("verdict"))
