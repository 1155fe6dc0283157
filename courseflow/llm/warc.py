"""WARC archives written with their index first in mind, and read back by coalesced byte ranges.

``write_archives`` writes one gzip member a record, so any record can be read alone, and returns the
index: shard, offset, length, url and digest of each record. ``read_records`` takes selected index rows,
deals them by shard and stretch, sorts them by offset and joins neighbouring ranges into one read of at
most ``MOST_READ`` bytes; it never opens a shard that has no selected record.

Equal payloads: the row of the largest page_id is the response, rows with a smaller one are revisits of
it without a payload; payloads under ``min_bytes`` are all responses. Defined cases: null html is an
empty payload; a null page_id takes part with an empty id and is a response unless the payload has a row
with an id; a null url is left out of the record; repeated rows with the largest page_id are all
responses; an empty table gives no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courseflow.llm import textblock as tb
from courseflow.llm.files import open_ranges, write_whole
from courseflow.llm.shared import STRETCH, materialise, scratch, tasks_for, text_batches

MOST_GAP, MOST_READ = 64 << 10, 8 << 20
_INDEX = "page_id long, url string, digest string, record_type string, shard string, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with the hex SHA-1 of the payload and ``refers_to``: the response's page_id for revisits.

    Only one row a payload is joined back; the adaptive join splits a payload that many pages share."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha1"))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"))
    refers = F.when((F.octet_length("html") >= min_bytes) & F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.col("last"))
    return rows.join(last, "sha1").select("page_id", "url", "html", refers.alias("refers_to"))


def _record(page_id, url, html: str, refers_to) -> tuple[bytes, str]:
    payload = html.encode()
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), digest


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives under ``path``; returns the index. A task that runs again writes a shard of a
    new name and only its own index rows, so a lost executor leaves no wrong entry behind."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        found: list[pa.RecordBatch] = []

        def members():
            at = 0
            for batch in batches:
                for part in tb.parts(batch, "html"):
                    rows = []
                    for row in zip(*[c.to_pylist() for c in part.columns]):
                        raw, digest = _record(*row)
                        rows.append((digest, "response" if row[3] is None else "revisit", at, len(raw)))
                        at += len(raw)
                        yield raw
                    digest, kind, offset, length = zip(*rows)
                    found.append(pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()), pa.array(digest), pa.array(kind), pa.array([shard] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["page_id", "url", "digest", "record_type", "shard", "offset", "length"]))

        source = members()
        first = next(source, None)
        if first is not None:
            write_whole(f"{path}/{shard}", (x for s in ([first], source) for x in s))
        yield from found

    return materialise(text_batches(decided(pages, min_bytes)).mapInArrow(write, _INDEX), "warc-index")


def _parse(member: bytes) -> tuple:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    body = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base32_sha1(body) != digest:
        raise ValueError("payload and digest differ")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, number("WARC-Refers-To"), int(fields["X-Payload-Length"]), digest, body.decode() if kind == "response" else None


def read_records(spark: SparkSession, path: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` rows point to; a revisit has no html of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, start, raw = None, None, 0, b""
        for batch in batches:
            spans = list(zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")]))
            rows = []
            for i, (name, offset, length) in enumerate(spans):
                if name != shard:
                    shard, file, start, raw = name, open_ranges(f"{path}/{name}"), 0, b""
                if not start <= offset <= offset + length <= start + len(raw):
                    end = offset + length
                    for other, at, more in spans[i + 1 :]:
                        if other != shard or at > end + MOST_GAP or at + more > offset + MOST_READ:
                            break
                        end = max(end, at + more)
                    start, raw = offset, file.read_at(end - offset, offset)
                row = _parse(raw[offset - start : offset - start + length])
                rows.append(row if payloads else (*row[:6], None))
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + 500]], schema)

    names = [f.split()[0] for f in _RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes") else pa.string()) for n in names])
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = index.select("shard", "offset", "length").repartition(tasks_for(spark, size), "shard", F.expr(f"offset div {STRETCH}")).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(read, _RECORD)


def warc_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes all pages as WARC records and reads every record back."""
    path = path or scratch(pages.sparkSession, "warc")
    index = write_archives(pages, path, min_bytes)
    return read_records(pages.sparkSession, path, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
