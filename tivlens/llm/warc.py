"""WARC archives as a chunked record table.

Writing: every page becomes one record; payloads beyond ``chunk_chars`` are split into WARC
segments (one row per record identifier and chunk number), each carrying the digest of the
payload so far. Rows are record texts, written by Spark's text writer with the WARC record
end as separator, so files appear only when their task has committed. Reading streams the
files through a small state machine that holds one segment at a time, continues the digest
from segment to segment and checks it against the stored one.

Records of equal payloads (same SHA-1 and length) of at least ``min_revisit`` bytes: the one
with the largest page id is the response, the others are revisits of it. Digests meet in
narrow pre-aggregated rows; the join back is one whose hot digests Spark splits. Rows that
repeat page id and payload are numbered, by URL; the first one has the record that revisits
refer to, the others are records of their own.

Files are UTF-8 text compressed as one gzip member each; the payload of a response follows a
minimal HTTP header. Custom fields: ``X-Page-ID`` and ``X-Running-Digest``.

Defined cases: a null payload is empty; a null page id is kept as null and never revisits or
is revisited, and every row without one is a record; rows that repeat page id, URL and payload
are one record, or with ``every_row`` one each; URLs are percent-encoded
where they hold spaces or control characters, a null URL has no field.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.common import stored

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
DATE = "1970-01-01T00:00:00Z"  # a fixed capture time keeps archives reproducible
SEGMENT = 1 << 20
OUT_ROWS = 64


def _record_id(page: str | None, digest: str, repeat: int = 0) -> str:
    """Of the row numbered ``repeat`` among those of the page id and payload; pages without an id have a number each."""
    name = f"null {digest} {repeat}" if page is None else f"{page}|{digest}" + (f"|{repeat}" if repeat else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _labelled(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def _header(kind: str, record: str, length: int, fields: list[tuple[str, str | None]]) -> str:
    rows = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", DATE), *fields,
            ("Content-Length", str(length))]
    return "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in rows if v is not None) + END


def records(page: str | None, url: str | None, body: str, digest: str, keeper: str | None,
            chunk_chars: int, repeat: int = 0) -> Iterator[str]:
    """The texts of a page's record and, for oversized payloads, of its continuation segments."""
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    own = [("WARC-Target-URI", uri), ("X-Page-ID", page), ("WARC-Payload-Digest", _labelled(digest))]
    record = _record_id(page, digest, repeat)
    if keeper is not None:
        yield _header("revisit", record, 0, [
            *own, ("WARC-Refers-To", _record_id(keeper, digest)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")])
        return
    running, total, many = hashlib.sha1(), 0, len(body) > chunk_chars
    for k, at in enumerate(range(0, max(len(body), 1), chunk_chars)):
        chunk = body[at:at + chunk_chars]
        data = chunk.encode()
        running.update(data)
        total += len(data)
        head = "" if k else HTTP
        block = head + chunk
        fields = [("WARC-Segment-Number", str(k + 1) if many else None),
                  ("X-Running-Digest", _labelled(running.hexdigest()))]
        if at + chunk_chars >= len(body) and many:
            fields.append(("WARC-Segment-Total-Length", str(total + len(HTTP))))
        if k:
            fields.append(("WARC-Segment-Origin-ID", record))
        yield _header("continuation" if k else "response", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record}{k}')}>"
                      if k else record, len(head) + len(data), fields if k else [*own, *fields]) + block


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  body_col: str = "html", min_revisit: int = 1000, chunk_chars: int = SEGMENT,
                  every_row: bool = False) -> None:
    """Write one record per page into WARC files below ``folder``; with ``every_row`` equal rows have one each."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"),
                        F.sha1(body).alias("digest"), F.octet_length(body).alias("size"),
                        F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("own"))
    rows = rows.withColumn("place", F.coalesce(F.col("own").cast("string"), "digest"))
    large = rows.where((F.col("size") >= min_revisit) & F.col("id").isNotNull()).select("id", "digest", "size")
    keepers = (large.groupBy("digest", "size").agg(F.max("id").alias("keeper"), F.min("id").alias("least"))
               .where("least < keeper").drop("least"))
    keepers = stored(keepers, "keepers")  # a plain table, so that Spark can split hot digests in the join
    revisits = (large.join(keepers, ["digest", "size"]).where("id < keeper")
                .select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "keeper").distinct())
    # payloads move once: the join keeps this partitioning, which also brings repeated rows together;
    # those without an id are spread by a number of their own
    marked = rows.repartition("id", "place").join(revisits, (F.col("id") == F.col("rid")) & (F.col("place") == F.col("rdigest")), "left")
    sent = marked.select(F.col("id").cast("string").alias("page"), "url",
                         F.when(F.col("keeper").isNull(), F.col("body")).otherwise("").alias("body"), "digest",
                         F.col("keeper").cast("string").alias("keeper"), "own")
    sent = sent.sortWithinPartitions("page", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, url_before, repeat = None, None, 0
        for batch in batches:
            out: list[str] = []
            for k in range(batch.num_rows):
                page, url, text, digest, keeper, own = (batch.column(c)[k].as_py() for c in range(6))
                if own is not None:
                    number = own
                elif (page, digest) != before:
                    number = repeat = 0
                elif url != url_before or every_row:
                    number = repeat = repeat + 1
                else:
                    continue
                before, url_before = (page, digest), url
                for record in records(page, url, text, digest, keeper, chunk_chars, number):
                    out.append(record)
                    if len(out) >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    (sent.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").text(folder))


CHUNKS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("chunk_no", T.IntegerType()),
    T.StructField("last", T.BooleanType()), T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.StringType()), T.StructField("refers_to_record", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("running_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("intact", T.BooleanType()),
    T.StructField("payload", T.BinaryType())])


class _Reader:
    """Takes the pieces between record ends, in order, and gives chunk rows."""

    def __init__(self, with_payload: bool) -> None:
        self.with_payload = with_payload
        self.fields: dict[str, str] | None = None
        self.buffer = bytearray()
        self.record: dict[str, str] = {}
        self.digest, self.size, self.chunk = hashlib.sha1(), 0, 0

    def take(self, piece: str) -> Iterator[tuple]:
        self.buffer += piece.encode() + END.encode()
        while True:
            if self.fields is None:
                if (at := self.buffer.find(END.encode())) < 0:
                    return
                self.fields = dict(x.split(": ", 1) for x in self.buffer[:at].decode().split("\r\n")[1:])
                del self.buffer[:at + len(END)]
            size = int(self.fields["Content-Length"])
            if len(self.buffer) < size + len(END):
                return
            data = bytes(self.buffer[:size])
            del self.buffer[:size + len(END)]
            fields, self.fields = self.fields, None
            yield self._chunk(fields, data)

    def _chunk(self, fields: dict[str, str], data: bytes) -> tuple:
        if fields["WARC-Type"] != "continuation":
            self.record, self.digest, self.size, self.chunk = fields, hashlib.sha1(), 0, 0
            data = data.removeprefix(HTTP.encode())
        elif fields["WARC-Segment-Origin-ID"] != self.record.get("WARC-Record-ID"):
            raise ValueError(f"segment without its record: {fields['WARC-Segment-Origin-ID']}")
        self.digest.update(data)
        self.size += len(data)
        self.chunk += 1
        kind, stored = self.record["WARC-Type"], _hex(self.record["WARC-Payload-Digest"])
        last = "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields
        running = self.digest.hexdigest()
        intact = kind == "revisit" or (running == _hex(fields["X-Running-Digest"]) and (not last or running == stored))
        return (self.record["WARC-Record-ID"], self.chunk, last, kind, self.record.get("X-Page-ID"),
                self.record.get("WARC-Refers-To"), stored, running, self.size, intact,
                data if self.with_payload else None)


def read_chunks(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The chunked record table: one row per record and chunk number, sizes and digests so far included.

    ``intact`` tells whether the digest continued so far equals the stored one.
    """
    lines = (spark.read.option("lineSep", END).text(folder)
             .select("value", F.col("_metadata.file_path").alias("file")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, _Reader(with_payload)
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                if (at := batch.column(1)[k].as_py()) != file:
                    file, reader = at, _Reader(with_payload)
                for row in reader.take(batch.column(0)[k].as_py()):
                    out.append(row)
                    if with_payload and len(out) >= OUT_ROWS:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return lines.mapInArrow(run, CHUNKS)


_ARROW = pa.schema([
    ("record_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("record_type", pa.string()),
    ("page_id", pa.string()), ("refers_to_record", pa.string()), ("payload_digest", pa.string()),
    ("running_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)],
                                      schema=_ARROW)


def read_records(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    A revisit has the size of the response it refers to; without that response it isn't intact.
    """
    ends = read_chunks(spark, folder, with_payload=False).where("last").drop("payload")
    page: Column = F.col("page_id").cast(id_type)
    revisits = ends.where("record_type = 'revisit'").select(
        page.alias("page_id"), "payload_digest", "record_type", F.col("refers_to_record").alias("record_id"))
    plain = ends.where("record_type = 'response'")
    targets = plain.select("record_id", page.alias("refers_to"), "payload_bytes", F.col("intact").alias("found"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    found = revisits.join(targets, "record_id", "left").withColumn("intact", F.coalesce("found", F.lit(False)))
    return plain.withColumn("page_id", page).withColumn(
        "refers_to", F.lit(None).cast(id_type)).select(columns).unionByName(found.select(columns))
