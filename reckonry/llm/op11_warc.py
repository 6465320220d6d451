"""WARC archives with an index, and coalesced range reads of selected records.

Writing: each task lays its records one after another into an archive of its own, every record a gzip member, and
returns one index line a record: where it lies, how long it is, URL and digest. Index lines go through Spark's
writer, so only those of tasks that ended count; an archive that a lost task left behind is named by no line and is
never read. Records of equal payloads of ``LEAST`` bytes or more are written once as a response, the others
as revisits that name it.

Reading: the wanted index lines are sorted by archive and offset, dealt out by ranges of them, and neighbours within
``GAP`` bytes of each other are read by one request of up to ``RUN`` bytes. Nothing but the selected ranges is read.

The archives lie in the shared folder, which tasks reach through pyarrow's file systems (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reckonry.llm.batches import slices
from reckonry.llm.keys import written_keys
from reckonry.plans.staging import stage, stage_path

#: Payloads below so many bytes are never revisits.
LEAST = 100
GAP, RUN, LEVEL = 64 << 10, 8 << 20, 4
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, url string, record_id string, record_type string, refers_to string, payload_digest string, "
         "payload_bytes long, file string, offset long, length long")
RECORD = "page_id long, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark spells it, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# ---------------------------------------------------------------- records

def record(kind: str, record_id: str, url: str, date: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record: header lines, then the HTTP answer; a revisit has the answer's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block + END


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(header, head of the HTTP answer, payload) of one record; a record that does not end where it says raises."""
    head, _, rest = data.partition(END)
    header = _fields(head)
    size = int(header["content-length"])
    if rest[size:] != END:
        raise ValueError(f"record {header.get('warc-record-id')} does not end after {size} bytes")
    http, _, payload = rest[:size].partition(END)
    return header, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def gzipped(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of its own, the same bytes for the same record."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_name(page_id: int | None, digest: str, own: str = "") -> str:
    return f"urn:page:{'none' if page_id is None else page_id}:{digest}" + (f":{own}" if own else "")


def page_of(record_id: str | None) -> int | None:
    """The page_id in a record's name."""
    name = record_id.strip("<>").split(":")[2] if record_id else "none"
    return None if name == "none" else int(name)


def _target(url: str | None, record_id: str) -> str:
    """A header line can hold no control characters or blanks; a page without URL is named by its record."""
    return record_id if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


# ---------------------------------------------------------------- writing

def planned(pages: DataFrame) -> DataFrame:
    """One row a record: page_id, url, html (null for a revisit), payload_digest, payload_bytes, record_type, lead (page_id of the response), leads.

    Of rows with equal payloads of ``LEAST`` bytes or more that with the smallest page_id is the response, a null page_id
    last; of rows that repeat this page_id as well, one with the least URL. A null html is an empty payload. Rows
    whose payload no other row has stay where they are if the shared digests are few, else they meet these by a join.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    by_page = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    shared = by_page.groupBy("payload_digest").agg(
        F.sum("n").alias("total"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("lead")).where("total > 1")
    shared = written_keys(shared.select("payload_digest", F.col("lead.page_id").alias("lead"), F.col("lead.n").alias("lead_rows"),
                                        F.lit(True).alias("shared")), "shared-payloads")
    met = rows.join(shared, "payload_digest", "left").withColumn("leads", F.coalesce(F.col("shared"), F.lit(False)) & F.col("page_id").eqNullSafe(F.col("lead")))
    alone = met.where(~F.col("leads") | (F.col("lead_rows") == 1)).withColumn(
        "record_type", F.when(F.col("shared").isNull() | F.col("leads"), "response").otherwise("revisit"))
    # rows that repeat the response's page_id fold into counted ones; the first of the least URL is the response
    folded = met.where(F.col("leads") & (F.col("lead_rows") > 1)).groupBy("payload_digest", "payload_bytes", "page_id", "url", "lead").agg(
        F.count("*").alias("n"), F.min("html").alias("html"))
    url = F.struct(F.col("url").isNull().alias("none"), F.coalesce("url", F.lit("")).alias("url"))
    least = folded.groupBy("payload_digest").agg(F.min(url).alias("least"))  # of one page_id, the response's
    first = folded.join(least, "payload_digest").withColumn("first", url == F.col("least"))
    repeated = first.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).withColumn("leads", F.col("first") & (F.col("k") == 1)).withColumn(
        "record_type", F.when(F.col("leads"), "response").otherwise("revisit"))
    names = ["page_id", "url", F.when(F.col("record_type") == "response", F.col("html")).alias("html"), "payload_digest", "payload_bytes", "record_type", "lead", "leads"]
    return alone.select(*names).unionByName(repeated.select(*names))


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the index, as read back.

    Archives go to ``folder``, one a task, or to a new one in the shared folder. Other columns are not read. Every row gets its
    record, rows that repeat a page_id too; no row, no archive.
    """
    spark = pages.sparkSession
    folder = folder or stage_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at, number = None, 0, 0
        try:
            for batch in batches:
                for part in slices(batch, column="html"):
                    lines = []
                    for row in part.to_pylist():
                        if out is None:
                            store.create_dir(base, recursive=True)
                            out = store.open_output_stream(f"{base}/{name}", compression=None)  # members are packed one by one
                            about = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: {date}\r\nContent-Length: 0".encode()
                            head = gzipped(about + END + END)
                            out.write(head)
                            at = len(head)
                        number += 1
                        digest, size = row["payload_digest"], row["payload_bytes"]
                        record_id = record_name(row["page_id"], digest, "" if row["leads"] else f"{name[:-8]}-{number}")
                        refers_to = record_name(row["lead"], digest) if row["record_type"] == "revisit" else None
                        payload = (row["html"] or "").encode()
                        data = gzipped(record(row["record_type"], record_id, _target(row["url"], record_id), date, digest, size, payload, refers_to))
                        out.write(data)
                        lines.append((row["page_id"], row["url"], record_id, row["record_type"], refers_to, digest, size, name, at, len(data)))
                        at += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = stage(planned(pages).mapInArrow(work, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


# ---------------------------------------------------------------- reading

def runs(lines: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = RUN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, from, until, ranges) for sorted (file, offset, length): neighbours up to ``gap`` apart in one read.

    A read grows up to ``most`` bytes; a longer record is read alone. Ranges that repeat share a read.
    """
    now: tuple | None = None
    for file, offset, length in lines:
        if now and now[0] == file and offset - now[2] <= gap and offset + length - now[1] <= most:
            now = (file, now[1], max(now[2], offset + length), [*now[3], (offset, length)])
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(wanted: DataFrame) -> DataFrame:
    """The records of some index lines: page_id, record_type, refers_to (a page_id), payload, payload_digest, payload_bytes.

    The last two come from the record's own head and are those of the whole payload, for a revisit too, whose
    payload is null. A record that is cut or not of its stated length raises.
    """
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
        name, source = None, None
        for file, low, high, ranges in runs(lines):
            if file != name:
                store, path = opened(file)
                name, source = file, store.open_input_file(path)
            data = source.read_at(high - low, low)
            out, held = [], 0
            for offset, length in ranges:
                header, http, payload = parsed(zlib.decompress(memoryview(data)[offset - low:offset - low + length], 31))
                revisit = header["warc-type"] == "revisit"
                out.append((page_of(header["warc-record-id"]), header["warc-type"], page_of(header.get("warc-refers-to")) if revisit else None,
                            None if revisit else payload, header["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])))
                held += len(payload)
                if held > RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    sorted_lines = wanted.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return sorted_lines.mapInArrow(work, RECORD)


def payloads(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, url, payload) of some index lines, a revisit's taken from the response that it names. Each response is read once."""
    asked = wanted.select("page_id", "url", F.coalesce("refers_to", "record_id").alias("source"), "payload_digest")
    sources = index.join(asked.select(F.col("source").alias("record_id")).distinct(), "record_id", "left_semi")
    # responses of equal digests have equal payloads, small ones too
    found = read_records(sources).groupBy("payload_digest").agg(F.min("payload").alias("payload"))
    return asked.join(found, "payload_digest").select("page_id", "url", "payload")


def op11_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages, read every record back; size and digest of a response follow from the payload that was read."""
    index = write_archives(spark.read.parquet(f"{folder}/pages.parquet"))
    return read_records(index).select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


QUERY = op11_warc_archives
SQL = """
with p as (select page_id, url, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages),
k as (select *, payload_bytes < 100 or row_number() over (partition by payload_digest order by page_id nulls last, url nulls last) = 1 as first,
  min(page_id) over (partition by payload_digest) as lead from p)
select page_id, payload_bytes, payload_digest, if(first, 'response', 'revisit') as record_type, if(first, null, lead) as refers_to from k
"""
