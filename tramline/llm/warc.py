"""Deterministic sharded WARC archives.

Pages are laid out in order of their ids: splitters from exact running bytes give each shard
the same bytes but for one page, rows are sorted within their shard, and a shard rolls to a new file when
its compressed size is reached.  Headers and digests are made anew from the payload.  Files are
written under temporary names and renamed; a manifest written last names what belongs to the
archive.  The same table gives the same bytes, however tasks were run or repeated.

Null html is an empty payload.  Of equal payloads of at least ``least`` bytes the smallest id is
the response and the others revisit it; null ids come last.  Rows that repeat an id and payload
are responses together where that id is smallest.  Rows with one id, or none, may lie in several shards.  Empty tables give an empty manifest; columns
other than id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.shared import filesystem, json_literal, let, work_path, written

#: Ranges for each shard, in which the running bytes are summed.
RANGES = 4
EPOCH = "1970-01-01T00:00:00Z"
#: What orders pages: null ids last, and payloads of one id by their digest, so that no id is too large for a shard.
PLACE = "struct<none:boolean,id:bigint,tie:bigint>"


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("tie"))


def _splitters(sized: DataFrame, shards: int) -> list[dict]:
    """Places at which new shards begin: where the running bytes of all rows in order cross k / shards of the whole.

    Sampled quantiles deal the rows (place, n) into ranges of about equal rows; the ranges' exact bytes, and the
    running bytes inside each, say for every row what lies before it.  So the cuts are exact whatever the sample
    was, and only one place a shard reaches the driver.
    """
    if shards < 2:
        return []
    rows = written(sized.repartitionByRange(RANGES * shards, "place").withColumn("part", F.spark_partition_id()), "warc-sizes")
    sums = rows.groupBy("part").agg(F.sum("n").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    upto = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("upto"), F.sum("bytes").over(Window.partitionBy()).alias("whole"))
    inside = Window.partitionBy("part").orderBy("place", "n").rowsBetween(Window.unboundedPreceding, 0)
    start = rows.join(upto, "part").withColumn("start", F.col("upto") + F.sum("n").over(inside) - F.col("n"))
    shard = F.least(F.lit(shards - 1), F.expr(f"start * {shards} div greatest(whole, 1)"))
    firsts = start.groupBy(shard.alias("shard")).agg(F.min("place").alias("place")).filter("shard > 0").orderBy("shard").collect()
    return [r.place.asDict() for r in firsts]


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record; its headers depend on nothing but the page."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if kind == "revisit" else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(record: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + np.array([zlib.crc32(record), len(record) & 0xFFFFFFFF], "<u4").tobytes()


def plan_records(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The digests that repeat with their smallest id, and the pages with digest and size."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    return first, rows


def write_archive(pages: DataFrame, shards: int, roll_bytes: int = 64 << 20, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write the archive; returns its folder in the shared storage."""
    spark = pages.sparkSession
    folder = work_path(spark, "warc")
    first, rows = plan_records(pages, least, id_col, url_col, html_col)
    cuts = _splitters(rows.select(_place().alias("place"), F.col("size").alias("n")), shards)
    at = json_literal(cuts, f"array<{PLACE}>")
    steps = F.array(*(F.lit(1 << s) for s in range(max(1, len(cuts).bit_length()) - 1, -1, -1)))
    search = lambda key: F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= len(cuts)) & (F.get(at, low + s - 1) <= key), low + s).otherwise(low))
    shard = let(_place(), search)
    # A narrow join finds who revisits whom; its marks meet the pages in the writer's one sorted shuffle.
    marks = rows.filter(F.col("size") >= least).select("id", "digest").join(first, F.col("digest") == F.col("d")).filter("NOT (id <=> first)").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    nothing = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).cast("long").alias("size")]
    placed = rows.select(shard.alias("shard"), "id", "digest", F.lit(1).alias("page"), "url", "html", "size", F.lit(None).cast("long").alias("refers_to")).unionByName(
        marks.select(shard.alias("shard"), "id", "digest", F.lit(0).alias("page"), *nothing, "refers_to")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        out = name = temp = None
        shard_now, seq, size, records = None, 0, 0, 0
        check = hashlib.sha256()
        mark = (None, None, None)

        def close() -> pd.DataFrame:
            out.close()
            system.move(temp, f"{path}/{name}")
            return pd.DataFrame({"name": [name], "bytes": [size], "records": [records], "sha256": [check.hexdigest()]})

        for b in batches:
            for s, page, is_page, url, html, digest, n, refers in zip(b["shard"], b["id"], b["page"], b["url"], b["html"], b["digest"], b["size"], b["refers_to"], strict=True):
                page = None if pd.isna(page) else int(page)
                if not is_page:
                    mark = (page, digest, int(refers))
                    continue
                if out is not None and (s != shard_now or size >= roll_bytes):
                    yield close()
                    out = None
                    seq += 1
                if s != shard_now:
                    shard_now, seq = s, 0
                if out is None:
                    name = f"part-{s:06d}-{seq:06d}.warc.gz"
                    temp = f"{path}/.{name}-{os.urandom(6).hex()}"
                    out, size, records, check = system.open_output_stream(temp, compression=None), 0, 0, hashlib.sha256()
                refers = mark[2] if mark[:2] == (page, digest) else None
                packed = _packed(_record("response" if refers is None else "revisit", page, url, html.encode(), digest, int(n), refers))
                out.write(packed)
                check.update(packed)
                size, records = size + len(packed), records + 1
        if out is not None:
            yield close()

    files = (
        placed.repartitionById(max(shards, 1), F.col("shard"))
        .sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "digest", "page", "url")
        .mapInPandas(write, "name string, bytes long, records long, sha256 string")
        .collect()
    )
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    manifest = sorted((r.asDict() for r in files), key=lambda r: r["name"])
    with system.open_output_stream(f"{path}/.manifest") as out:
        out.write(json.dumps({"files": manifest}).encode())
    system.move(f"{path}/.manifest", f"{path}/manifest.json")
    return folder


def parse_record(record: bytes) -> dict:
    """Headers and payload of one unpacked record; raises where a digest doesn't hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    page, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
    size = int(http.rpartition(b"Content-Length: ")[2])
    return {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload if kind == "response" else None}


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; memory holds one record."""
    z, parts = None, []
    while block := stream.read(1 << 20):
        while block:
            z = z or zlib.decompressobj(31)
            parts.append(z.decompress(block))
            block = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = None, []
    if z is not None:
        raise ValueError("the last record is cut off")


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files that the manifest names, checked against their digests.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload
    (binary, null for revisits) if asked for.
    """
    system, path = filesystem(folder)
    with system.open_input_file(f"{path}/manifest.json") as f:
        names = [r["name"] for r in json.loads(f.read())["files"]]
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        for b in batches:
            for name in b["name"]:
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for record in members(stream):
                        rows.append(parse_record(record))
                        held += len(record)
                        if held > 16 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows, columns)

    listed = spark.createDataFrame([(n,) for n in names], "name string")
    return listed.repartition(max(1, len(names))).mapInPandas(read, schema)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def unpack(data: bytes) -> bytes:
    """Any gzip tool reads the archives; this is the standard library's."""
    return gzip.decompress(data)
