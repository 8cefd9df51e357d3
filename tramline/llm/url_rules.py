"""URL rules in a sorted digest array.

Rules (a host, a path prefix, a verdict) are written as sorted arrays of 64-bit xxhash keys
next to the full rule strings, in one file for each range of keys.  A task maps the files into
memory, hashes every (host suffix, path prefix) that could be a rule, finds the keys by
vectorised binary search and confirms the stored strings, so colliding keys do no harm.

A null url, or one without ``://``, has an empty host and path and fits no rule.  Rule hosts are
lower-cased as urls' are; a rule with a null part counts for nothing; one given twice keeps its smallest verdict.  Of the rules that fit, the longest string wins, then the
longest host; two rules cannot tie further.  No rules, or no rows, give no match.  Columns other
than the id and the url are not read.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.shared import filesystem, work_path

#: Rules in one file at most; about 80 bytes each.
FILE_RULES = 5_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build_rules(rules: DataFrame, files: int | None = None) -> str:
    """Write ``rules`` (host, path, verdict: strings) as digest arrays; returns the folder.

    Tasks write files under temporary names and rename them; a manifest that names the files is
    written last, so that a reader never sees half an index.
    """
    spark = rules.sparkSession
    folder = work_path(spark, "url-rules")
    files = files or max(1, -(-rules.count() // FILE_RULES))
    whole = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").withColumn("host", _lower(F.col("host")))
    distinct = whole.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    named = distinct.select(F.concat(F.length("host").cast("string"), F.lit(":"), "host", "path").alias("rule"), F.length("path").alias("n"), "verdict")
    keyed = named.withColumn("key", F.xxhash64("rule"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        part = pd.concat(rows)
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        pairs = zip((r.encode() for r in part["rule"].to_numpy()[order]), (v.encode() for v in part["verdict"].to_numpy()[order]), strict=True)
        texts = [len(v).to_bytes(4, "little") + v + r for r, v in pairs]
        ends = np.cumsum([len(t) for t in texts], dtype=np.uint64)
        body = np.uint64(len(texts)).tobytes() + keys[order].tobytes() + ends.tobytes() + b"".join(texts)
        name = f"{int(keys.min()):016x}.keys"
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        temp = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
        with system.open_output_stream(temp) as out:
            out.write(body)
        system.move(temp, f"{path}/{name}")
        lens = sorted(set(part["n"].tolist()))
        yield pd.DataFrame({"name": [name], "lens": [json.dumps(lens)]})

    made = keyed.repartitionByRange(files, "key").mapInPandas(write, "name string, lens string").collect()
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    body = {"files": sorted(r.name for r in made), "path_lengths": sorted({n for r in made for n in json.loads(r.lens)})}
    with system.open_output_stream(f"{path}/.manifest") as out:
        out.write(json.dumps(body).encode())
    system.move(f"{path}/.manifest", f"{path}/manifest.json")
    return folder


class DigestArray:
    """The files of one folder, mapped into memory."""

    def __init__(self, folder: str) -> None:
        system, path = filesystem(folder)
        with system.open_input_file(f"{path}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.path_lengths = manifest["path_lengths"]
        self.maps = [self._mapped(system, f"{path}/{name}") for name in manifest["files"]]

    @staticmethod
    def _mapped(system, path: str) -> tuple[np.ndarray, np.ndarray, memoryview]:
        if os.path.exists(path):  # the shared folder is mounted here
            with open(path, "rb") as f:
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:  # a store without mounts: the bytes in an anonymous map, no file
            with system.open_input_file(path) as source:
                whole = mmap.mmap(-1, source.size())
                while block := source.read(1 << 20):
                    whole.write(block)
        n = int(np.frombuffer(whole, np.uint64, 1)[0])
        return np.frombuffer(whole, np.uint64, n, 8), np.frombuffer(whole, np.uint64, n, 8 + 8 * n), memoryview(whole)[8 + 16 * n :]

    def verdicts(self, texts: list[bytes]) -> list[str | None]:
        """For each candidate rule string its verdict, or None if it is no rule."""
        keys = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))
        found: list[str | None] = [None] * len(texts)
        for sorted_keys, ends, body in self.maps:
            low, high = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):  # more than one only for colliding keys
                    stored = bytes(body[int(ends[j - 1]) if j else 0 : int(ends[j])])
                    n = 4 + int.from_bytes(stored[:4], "little")
                    if stored[n:] == texts[i]:
                        found[i] = stored[4:n].decode()
        return found


def _candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """Every (host suffix, path prefix) that could be a rule, the longest first, then by host."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    pairs = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return sorted(pairs, key=lambda p: (-len(p[0]) - len(p[1]), -len(p[0])))


def apply_rules(urls: DataFrame, folder: str, id_col: str, url_col: str, default: str = "allow") -> DataFrame:
    """Per row: id, host, path, the rule that decides (host and path joined, else null), verdict."""
    host, path = host_and_path(F.col(url_col))
    split = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    kind = dict(split.dtypes)[id_col]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(folder)
        for b in batches:
            pairs = [_candidates(h, p, array.path_lengths) for h, p in zip(b["host"], b["path"], strict=True)]
            distinct = {c: None for own in pairs for c in own}
            known = dict(zip(distinct, array.verdicts([f"{len(h)}:{h}{p}".encode() for h, p in distinct]), strict=True))
            wins = [next((c for c in own if known[c] is not None), None) for own in pairs]
            b["rule"] = [None if w is None else w[0] + w[1] for w in wins]
            b["verdict"] = [default if w is None else known[w] for w in wins]
            yield b

    return split.mapInPandas(probe, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
