"""Legacy ARC archives to WARC: their records parsed by version and declared length, and written as equivalent WARC records.

Files are compressed record by record, as such archives are. An ARC file becomes one WARC file; its place gives both names, so
that a task that runs again replaces what it wrote. A file holds some megabytes (one record at least): one task reads it whole.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import load, save, scratch, spread_join, written

FILE_BYTES, FILES_AT_ONCE = 8 << 20, 16
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 100
#: The fields of an ARC header line by version: fixed values of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}


@dataclass
class Record:
    """A record of either kind: its header's fields in lower case, and its block."""

    fields: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The fields of an HTTP message's head, in lower case, and its body."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _member(data: bytes) -> bytes:
    own = zlib.compressobj(4, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def plain(data: bytes) -> bytes:
    """The bytes of a file, compressed or not."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def arc_uri(url: str | None) -> str:
    """A URL without white space and controls, which would end a field; a null or empty one becomes urn:none."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\"<>\\-._") if url else "urn:none"


def arc_file(name: str, version: int, date: str, records: list[tuple[str, bytes]]) -> bytes:
    """A compressed ARC file of records (uri, HTTP message)."""
    about = f"{version} 0 termloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    more = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}

    def line(uri: str, kind: str, length: int) -> bytes:
        own = more | {"URL": uri, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Archive-length": str(length)}
        return (" ".join(own[k] for k in ARC_FIELDS[version]) + "\n").encode()

    out = [_member(line(f"filedesc://{name}", "text/plain", len(about)) + about)]
    out += [_member(line(uri, "text/html", len(block)) + block + b"\n") for uri, block in records]
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[Record]:
    """The records of an ARC file. The first one's block names the version and the fields of all header lines after it."""
    data, at, fields = plain(data), 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError("an ARC record is shorter than its header line declares")
        if fields is None:
            fields = ARC_FIELDS.get(int(block.split(b" ", 1)[0])) or block.split(b"\n")[1].decode().split(" ")
        else:
            if len(values) != len(fields):
                raise ValueError(f"an ARC header line has {len(values)} fields, not {len(fields)}")
            yield Record({k.lower(): v for k, v in zip(fields, values, strict=True)}, block)
        at = end + 1 + length


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return _member(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n")


def warc_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, by their declared lengths."""
    data, at = plain(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        if at > len(data):
            raise ValueError("a WARC record is shorter than it declares")
        yield Record(fields, data[end + 4 : at])
        at += 4


def record_id(*of: object) -> str:
    """A WARC-Record-ID that is the same whenever the same record is converted."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(of).encode()).digest()[:16], version=5)}>"


def warc_date(arc: str) -> str:
    return f"{arc[:4]}-{arc[4:6]}-{arc[6:8]}T{arc[8:10]}:{arc[10:12]}:{arc[12:14]}Z"


def _page(http: dict[str, str]) -> int | None:
    return int(http["x-page-id"]) if "x-page-id" in http else None


def write_arcs(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Writes pages (page_id, url, html) to ARC files, of version 1 and 2 in turn; returns a row per file."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, records, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"part-{part:06d}-{seq:06d}.arc.gz"
            save(folder, name, arc_file(name, 1 + (part + seq) % 2, date, records))
            return pd.DataFrame({"name": [name], "records": [len(records)]})

        for frame in frames:
            for page_id, null, url, html in zip(frame["page_id"], frame["page_id"].isna(), frame["url"], frame["html"], strict=True):
                body = (html or "").encode("utf-8")
                named = "" if null else f"X-Page-Id: {int(page_id)}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body)}\r\n\r\n"
                records.append((arc_uri(url), head.encode() + body))
                size += len(body)
                if size >= FILE_BYTES:
                    yield flush()
                    records, size, seq = [], 0, seq + 1
        if records:
            yield flush()

    return written(pages.select("page_id", "url", "html").mapInPandas(write, "name string, records int"), "arcs")


def _files(spark: SparkSession, folder: str, kind: str, of: str = "content") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), of)


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each ARC record: name (its file), no (its place there), page_id, id, uri, date, n_bytes and digest of its payload."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["name"], frame["content"], strict=True):
                rows = []
                for no, r in enumerate(arc_records(data)):
                    http, body = r.http()
                    digest = hashlib.sha256(body).hexdigest()
                    rows.append((name, no, _page(http), record_id(name, no, r.fields["url"], digest), r.fields["url"], r.fields["archive-date"], len(body), digest))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    schema = "name string, no int, page_id long, id string, uri string, date string, n_bytes long, digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    return _files(spark, folder, "arc").mapInPandas(read, schema)


def revisits(index: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Of records with equal payloads of `least` bytes or more, all but the one with the smallest page_id (null last, then by
    place): name, no, and to, that one's id, uri and date."""
    large = index.where(F.col("n_bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "name", "no", "id", "uri", "date")
    first = large.groupBy("digest").agg(F.min(order).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = spread_join(large.select("name", "no", "digest"), first, ["digest"], F.struct("name", "no"), how="inner")
    return dealt.where((F.col("to.name") != F.col("name")) | (F.col("to.no") != F.col("no"))).select("name", "no", F.struct("to.id", "to.uri", "to.date").alias("to"))


def convert(spark: SparkSession, arcs: str, warcs: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a WARC file for each ARC file, with a warcinfo record and one response or revisit per record; returns a row per file.

    Only names of files and short lists of their revisits move between tasks; each task opens its files itself."""
    of = revisits(written(arc_index(spark, arcs), "index"), least)
    of = of.groupBy("name").agg(F.collect_list(F.struct("no", "to.*")).alias("to"))  # as many as a file has records

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, name, to in zip(frame["path"], frame["name"], frame["to"], strict=True):
                data = load(path)
                known = {x["no"]: x for x in (to if to is not None else [])}
                info = f"software: termloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
                out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)]
                for no, r in enumerate(arc_records(data)):
                    body = r.http()[1]
                    digest, uri = hashlib.sha256(body).hexdigest(), r.fields["url"]
                    own = [("WARC-Record-ID", record_id(name, no, uri, digest)), ("WARC-Date", warc_date(r.fields["archive-date"])), ("WARC-Target-URI", uri), ("WARC-IP-Address", r.fields["ip-address"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                    block = r.block
                    if to := known.get(no):
                        block = block[: len(block) - len(body)]  # the head alone
                        own = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", to["id"]), ("WARC-Refers-To-Target-URI", to["uri"]), ("WARC-Refers-To-Date", warc_date(to["date"])), *own]
                    else:
                        own = [("WARC-Type", "response"), *own]
                    own.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
                    out.append(warc_record(own, block))
                save(warcs, name.replace(".arc", ".warc"), b"".join(out))
                yield pd.DataFrame({"name": [name], "records": [len(out) - 1]})

    files = _files(spark, arcs, "arc", "path").join(of, "name", "left").select("path", "name", "to")
    tasks = max(spark.sparkContext.defaultParallelism, files.count() // FILES_AT_ONCE)
    return written(files.repartition(tasks, "name").mapInPandas(write, "name string, records int"), "warcs")


def warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each response or revisit: page_id, id, type, payload_bytes and payload_digest of the full payload, refers_to
    (the id of the response, if a revisit). A response's payload and block must have the digests that its header states."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = []
                for r in warc_records(data):
                    f = r.fields
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, body = r.http()
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    if f["warc-type"] == "response" and hashlib.sha256(body).hexdigest() != digest or hashlib.sha256(r.block).hexdigest() != f["warc-block-digest"].removeprefix("sha256:"):
                        raise ValueError(f"{f['warc-record-id']} doesn't have the digests that it states")
                    size = len(body) if f["warc-type"] == "response" else int(http["content-length"])
                    rows.append((_page(http), f["warc-record-id"], f["warc-type"], size, digest, f.get("warc-refers-to")))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    schema = "page_id long, id string, type string, payload_bytes long, payload_digest string, refers_to string"
    names = [x.split()[0] for x in schema.split(", ")]
    return _files(spark, folder, "warc").mapInPandas(read, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read from the WARC files. Repeated rows have a record each; null html is an empty payload."""
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    if write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    convert(spark, arcs, warcs)
    found = written(warc_index(spark, warcs), "records")
    wanted = found.where("refers_to is not null").select(F.col("refers_to").alias("id")).distinct()
    names = found.where("type = 'response'").select("id", F.col("page_id").alias("_first")).join(wanted, "id").withColumnRenamed("id", "refers_to")
    again = spread_join(found.where("refers_to is not null"), names, ["refers_to"], F.col("id"))
    once = found.where("refers_to is null").withColumn("_first", F.lit(None).cast("long"))
    return once.unionByName(again).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("_first").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""
