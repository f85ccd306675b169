"""URL rules by sorted digest arrays: memory-mapped 64-bit keys, vectorised binary search, stored strings confirm.

A rule names a host and the beginning of a path. The index holds two arrays of sorted xxhash64 keys, of rule hosts (with
the lengths of the paths that they come with) and of rules. A url's host and its parent domains are looked up among the
hosts, and then each with the beginnings of the url's path that are as long as its rules have them. Equal keys count only
where the stored strings are equal too.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.files import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Rules in a file, about; the driver holds those of one file at a time.
SHARD = 1_000_000
SEED = 42


def host_of(url: Column) -> Column:
    """From after the first :// up to a slash, question mark, hash or the end; A-Z lowered; null and others: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def digests(keys: Iterable[bytes], bits: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64) & np.uint64((1 << bits) - 1)


def sorted_digests(keys: list[bytes], bits: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of a lookup of these distinct keys, and the order in which they stand in it."""
    d = digests(keys, bits)
    order = np.argsort(d, kind="stable")
    d, kept = d[order], [keys[i] for i in order.tolist()]
    ends = np.cumsum([0, *map(len, kept)]).astype(np.int64)
    run = int(np.unique(d, return_counts=True)[1].max()) if len(d) else 0
    return {"digest": d, "ends": ends, "text": np.frombuffer(b"".join(kept), np.uint8), "run": np.array([run, bits], np.int64)}, order


class Lookup:
    """Where keys stand among sorted digests."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.digest, self.ends, self.text = (arrays[f"{name}.{x}"] for x in ("digest", "ends", "text"))
        self.run, self.bits = arrays[f"{name}.run"].tolist()

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, -1 where it isn't stored: search by digest, then confirm by the stored bytes."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(self.digest):
            return out
        d = digests(keys, self.bits)
        first = np.searchsorted(self.digest, d)
        for k in range(self.run):  # keys of one digest stand next to each other
            at = first + k
            same = (at < len(self.digest)) & (self.digest[np.minimum(at, len(self.digest) - 1)] == d) & (out < 0)
            for i in np.flatnonzero(same).tolist():
                if self.text[self.ends[at[i]] : self.ends[at[i] + 1]].tobytes() == keys[i]:
                    out[i] = at[i]
        return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the length of its head, the head (JSON: type, place and size of each array), the arrays."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    said = json.dumps(head).encode()
    said += b" " * (-len(said) % 8)
    return b"".join([len(said).to_bytes(8, "little"), said, *body])


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, mapped into memory: workers of one machine share its pages."""
    raw = np.memmap(path, np.uint8, "r")
    start = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, at, n) in json.loads(raw[8:start].tobytes()).items():
        out[name] = raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind)
    return out


def shard_arrays(rules: list[tuple[str, str, str]], bits: int) -> dict[str, np.ndarray]:
    """The file's arrays for distinct rules (host, path, verdict)."""
    hosts: dict[str, set[int]] = {}
    for h, p, _ in rules:
        hosts.setdefault(h, set()).add(len(p))
    names = list(hosts)
    of_hosts, order = sorted_digests([h.encode() for h in names], bits)
    sizes = [sorted(hosts[names[i]]) for i in order.tolist()]
    of_rules, order = sorted_digests([f"{h}\0{p}".encode() for h, p, _ in rules], bits)
    verdicts = sorted({v for _, _, v in rules})
    out = {f"host.{k}": v for k, v in of_hosts.items()} | {f"rule.{k}": v for k, v in of_rules.items()}
    out["path_ends"] = np.cumsum([0, *map(len, sizes)]).astype(np.int64)
    out["path_sizes"] = np.array([n for s in sizes for n in s], np.int64)
    out["verdict"] = np.array([verdicts.index(rules[i][2]) for i in order.tolist()], np.int64)
    out["verdicts"] = np.frombuffer(json.dumps(verdicts).encode(), np.uint8)
    out["longest"] = np.array([max(map(len, names), default=0)], np.int64)
    return out


class Rules:
    """One file of the index."""

    def __init__(self, path: str):
        a = mapped(path)
        self.hosts, self.rules = Lookup(a, "host"), Lookup(a, "rule")
        self.ends, self.sizes, self.verdict = a["path_ends"], a["path_sizes"], a["verdict"]
        self.verdicts, self.longest = json.loads(a["verdicts"].tobytes()), int(a["longest"][0])

    def parents(self, host: str) -> list[str]:
        """The host and its parent domains, as far as they are no longer than a rule's host can be."""
        out = [host] if len(host) <= self.longest else []
        at = host.find(".", max(0, len(host) - self.longest - 1))
        while at >= 0:
            out.append(host[at + 1 :])
            at = host.find(".", at + 1)
        return out

    def best(self, hosts: pa.Array, paths: list[str], found: list) -> None:
        """Put (length, length of the host, rule, verdict) of the longest fitting rule of each row into found, if it is longer."""
        coded = hosts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        parents = [(i, x) for i, h in enumerate(names) for x in self.parents(h)]
        of: list[list] = [[] for _ in names]
        for (i, x), at in zip(parents, self.hosts.find([x.encode() for _, x in parents]).tolist(), strict=True):
            if at >= 0:
                of[i].append((x, self.sizes[self.ends[at] : self.ends[at + 1]].tolist()))
        tried = [(row, x, path[:n]) for row, (i, path) in enumerate(zip(coded.indices.to_pylist(), paths, strict=True)) for x, sizes in of[i] for n in sizes if n <= len(path)]
        for (row, x, p), at in zip(tried, self.rules.find([f"{x}\0{p}".encode() for _, x, p in tried]).tolist(), strict=True):
            if at >= 0:
                one = (len(x) + len(p), len(x), x + p, self.verdicts[int(self.verdict[at])])
                if found[row] is None or one > found[row]:
                    found[row] = one


@functools.lru_cache(maxsize=64)
def opened(name: str) -> Rules:
    return Rules(SparkFiles.get(name))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one file to any folder that Spark can write to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for i in range(0, len(content), 1 << 22):
        out.write(bytearray(content[i : i + (1 << 22)]))
    out.close()


def index(rules: DataFrame, shard: int = SHARD, bits: int = 64) -> list[str]:
    """Names of the index files of rules (host, path, verdict), which every executor fetches once from the shared folder.

    Rules are dealt to files by a hash, about `shard` to a file; only one file's are on the driver at a time.
    """
    spark = rules.sparkSession
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = rules.where("host is not null and path is not null and verdict is not null").groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    kept = materialize(kept.withColumn("h", F.xxhash64("host", "path")), "rules")
    files = -(-kept.count() // shard)
    names = []
    for k in range(files):
        part = kept.where(F.pmod("h", F.lit(files)) == k).select("host", "path", "verdict").toArrow()
        name = f"rules-{uuid.uuid4().hex}.bin"
        put(spark, f"{shared_dir(spark)}/{name}", packed(shard_arrays(list(zip(*[c.to_pylist() for c in part.columns], strict=True)), bits)))
        spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
        names.append(name)
    return names


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow", shard: int = SHARD, bits: int = 64) -> DataFrame:
    """(key, host, path, rule, verdict) of every page: the longest rule that fits its url, else null and `otherwise`.

    A rule fits its host and all subdomains of it where the url's path starts with the rule's. Of rules of one length the
    one with the longer host wins, of one rule with several verdicts the last in the alphabet (block, not allow). Rules
    with a null are none. Null urls and such without :// have empty host and path. Repeated rows and null keys keep a row
    each; other columns are not looked at; an empty table gives an empty one. No row is shuffled. bits: of a digest that count.
    """
    names = index(rules, shard, bits)
    address = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.col(key), host_of(address).alias("host"), path_of(address).alias("path"))

    def run(batches):
        for b in batches:
            found: list = [None] * b.num_rows
            paths = b.column(2).to_pylist()
            for name in names:
                opened(name).best(b.column(1), paths, found)
            said = [pa.array([f and f[2] for f in found], pa.string()), pa.array([f[3] if f else otherwise for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *said], names=[*b.schema.names, "rule", "verdict"])

    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")
