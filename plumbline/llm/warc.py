"""Deterministic sharded WARC writer and its reader.

Records are sorted by id over range shards, each shard rolls its files by compressed size, headers and digests are made anew, and
files are committed by renaming them from temporary names once a manifest of the successful attempts is on the shared disk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import filesystem, shared_folder, table, text_or_empty, write_manifest

#: compressed bytes after which a file is closed
ROLL_BYTES = 64 << 20
#: bytes of records aimed at per shard; shards are ranges of ids
SHARD_BYTES = 64 << 20
#: equal-width cells of the id range in which bytes are counted to place the shard bounds
CELLS = 4_096
#: fixed, so that equal input gives equal bytes
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def range_shards(rows: DataFrame, id_col: str, weight: Column, shard_bytes: int = SHARD_BYTES, cells: int = CELLS) -> list[int]:
    """Lower bounds (all but the first) of id ranges of about ``shard_bytes`` each.

    Two passes: the id range, then the bytes in ``cells`` equal cells of it; only the cells come to the driver. The result depends on the rows alone, not on
    partitions or samples. An id that many rows repeat stays in one shard."""
    lo, hi = rows.agg(F.min(id_col), F.max(id_col)).first()
    if lo is None:
        return []
    width = (hi - lo) // cells + 1
    per = {r["c"]: r["b"] for r in rows.filter(F.col(id_col).isNotNull()).groupBy(F.floor((F.col(id_col) - lo) / width).cast("long").alias("c")).agg(F.sum(weight).alias("b")).collect()}
    bounds, full = [], 0
    for c in sorted(per):
        if full and full + per[c] > shard_bytes:
            bounds.append(lo + c * width)
            full = 0
        full += per[c]
    return bounds


def sharded(rows: DataFrame, id_col: str, bounds: list[int], *then: str) -> DataFrame:
    """Rows with their ``shard``, whole shards to a task, sorted by shard, id and the columns of ``then``. Null ids come first, in shard 0.
    The shard is found by a binary search in nested conditions."""
    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(id_col) >= bounds[mid], cut(mid + 1, hi)).otherwise(cut(lo, mid))

    shard = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(cut(0, len(bounds)))
    return rows.withColumn("shard", shard.cast("int")).repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", id_col, *then)


def block_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first: int | None, digest: str, size: int) -> bytes:
    """One record: a response with its payload, or a revisit (``first`` is the page that holds the payload) without."""
    named = lambda k: f"<urn:uuid:{uuid.uuid5(SPACE, f'page/{k}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if first is not None else http + payload
    uri = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", named(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{block_digest(body)}")]
    if first is not None:
        head += [("WARC-Refers-To", named(first)), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(first))]
    head += [("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(id, sha1, first) of the rows whose payload, of at least ``least`` bytes, has a holder of smaller id.

    Only ids and digests are shuffled. The aggregate has one row per payload and is combined before its shuffle; hot payloads are cut by the adaptive join."""
    keys = rows.select("id", "sha1", "size").filter(F.col("size") >= least)
    holders = keys.groupBy("sha1", "size").agg(F.min("id").alias("first")).filter("first is not null")
    return keys.join(holders, ["sha1", "size"]).filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha1", "first").distinct()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write one record per row below ``folder`` and return the manifest (name, shard, part, records, bytes, sha256).

    Of equal payloads (at least ``least`` bytes) the smallest id is the response, others revisit it. Null html is an empty payload; a null id
    is written first and holds no payload for others unless all ids of its payload are null; rows that repeat the smallest id are all
    responses. A lost task writes under new temporary names; only files named in the manifest are renamed, so leftovers of lost tasks are never read."""
    payload = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    bounds = range_shards(rows, "id", F.col("size") + 400, shard_bytes)
    # payloads are shuffled once: a revisit is told by a row that sorts just before the record it belongs to
    told = revisits(rows, least).select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha1", F.lit(0).cast("long").alias("size"), "first")
    rows = rows.select("*", F.lit(None).cast("long").alias("first")).unionByName(told)
    rows = sharded(rows.withColumn("told", F.col("first").isNull()), "id", bounds, "sha1", "told")

    def write(batches):
        store, root = filesystem(folder)
        store.create_dir(root)
        out, told = None, None
        done = []

        def close():
            if out:
                out["file"].close()
                done.append((out["temp"], f"shard-{out['shard']:06d}-{out['part']:05d}.warc.gz", out["shard"], out["part"], out["records"], out["bytes"], out["hash"].hexdigest()))

        for pdf in batches:
            for i, url, data, first, sha, size, shard in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["first"], pdf["sha1"], pdf["size"], pdf["shard"]):
                i = None if pd.isna(i) else int(i)
                if not pd.isna(first):
                    told = (i, sha, int(first))
                    continue
                first = told[2] if told and told[:2] == (i, sha) else None
                if out is None or out["shard"] != shard or out["bytes"] >= roll:
                    close()
                    part = out["part"] + 1 if out and out["shard"] == shard else 0
                    temp = f"_temp-{uuid.uuid4().hex}"
                    out = {"temp": temp, "file": store.open_output_stream(f"{root}/{temp}", compression=None), "shard": int(shard), "part": part, "records": 0, "bytes": 0, "hash": hashlib.sha256()}
                member = gzip_member(record(i, url, data, first, base64.b32encode(bytes.fromhex(sha)).decode(), size))
                out["file"].write(member)
                out["hash"].update(member)
                out["bytes"] += len(member)
                out["records"] += 1
        close()
        yield pd.DataFrame(done, columns=["temp", "name", "shard", "part", "records", "bytes", "sha256"])

    schema = "temp string, name string, shard int, part int, records long, bytes long, sha256 string"
    rows.mapInPandas(write, schema).write.parquet(f"{folder}/_attempts")
    return write_manifest(pages.sparkSession.read.parquet(f"{folder}/_attempts"), folder)


def parse_records(stream):
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def read_warc(spark: SparkSession, folder: str, roots: int | None = None) -> DataFrame:
    """One row per record of a committed folder: (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to).

    Files of the manifest are dealt to tasks; digests of records with a payload are computed anew and must agree with their headers. A folder
    without a manifest is refused."""
    import gzip
    import io

    files = spark.read.parquet(f"{folder}/manifest").select("name", "bytes")
    n = max(1, files.count())

    def read(batches):
        store, root = filesystem(folder)
        for pdf in batches:
            for name in pdf["name"]:
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f, gzip.GzipFile(fileobj=io.BufferedReader(f, 1 << 20)) as z:
                    for head, block in parse_records(z):
                        revisit = head["warc-type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else block_digest(payload)
                        if not revisit and head["warc-payload-digest"] != f"sha1:{digest}" or head["warc-block-digest"] != f"sha1:{block_digest(block)}":
                            raise ValueError(f"digest mismatch in {name}, record {head['warc-record-id']}")
                        size = int(head["x-payload-length"]) if revisit else len(payload)
                        page, first = head["x-page-id"], head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head["warc-target-uri"], head["warc-type"], payload, size, digest, int(first) if first else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    def frame(rows):
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        pdf = pd.DataFrame(rows, columns=names)
        return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return files.repartition(n, "name").mapInPandas(read, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql() -> str:
    digit = lambda k: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST(concat('0x', substr(h, {k // 4 * 5 + 1}, 5)) AS INTEGER) >> {15 - k % 4 * 5}) & 31) + 1, 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), q AS (SELECT page_id, sha1(t) AS h, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, {' || '.join(digit(k) for k in range(32))} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


ORACLES = {"op8_warc": _sql()}
QUERIES = {"op8_warc": op8_warc}
