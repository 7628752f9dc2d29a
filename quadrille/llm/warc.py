"""WARC archives: records of pages, large ones in segments with chunked framing, and their reassembly."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import new_path, save

#: A record block holds at most SEGMENT bytes, and a file at most FILE_RECORDS records, so a file stays under about 80 MB.
SEGMENT, FILE_RECORDS = 16_384, 4096
CHUNK = 4096
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
RECORD_FIELDS = "record_id string, kind string, page_id long, origin string, number int, total long, refers string, block binary"


def record_id(page_id: int, payload: bytes, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{part}:'.encode() + hashlib.sha256(payload).digest()).digest()[:16])}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [f"{len(body[i : i + size]):x}\r\n".encode() + body[i : i + size] + b"\r\n" for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing, chunk extensions and trailers skipped; an error if it is cut short."""
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        size = int(framed[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def payload_of(http: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, _, body = http.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]+", " ", str(v)).encode("utf-8", "replace")
    return b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + clean(v) + b"\r\n" for k, v in fields if v is not None) + b"\r\n"


def page_records(page_id: int, url: str | None, payload: bytes, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without their closing blank lines: a revisit, a response, or a response and its continuations."""
    own, digest = record_id(page_id, payload), "sha1:" + hashlib.sha1(payload).hexdigest()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id)]
    if refers:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", refers), ("WARC-Payload-Digest", digest), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
        return [_header(fields) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for i, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", own if i == 1 else record_id(page_id, payload, i)), *common]
        if i == 1:
            fields += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", i)]
            fields += [("WARC-Segment-Origin-ID", own)] if i > 1 else []
            fields += [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        out.append(_header([*fields, ("Content-Length", len(part))]) + part)
    return out


def member(record: bytes, most: int = 8 << 20) -> bytes:
    """A record and its closing blank lines as one gzip member (of a record above `most` bytes, several)."""
    whole = record + b"\r\n\r\n"
    return b"".join(gzip.compress(whole[i : i + most], 6, mtime=0) for i in range(0, len(whole), most))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes page_id, url, html as WARC files under path, a gzip member a record. Of equal payloads of at least REVISIT_FROM bytes the one with the largest
    page_id is the response, and the others revisit it. Rows with a null page_id are left out; null html is an empty payload."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    pages = pages.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_FROM, F.sha2("payload", 256)))
    first = pages.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least")).where("least < response").select("digest", "response")
    judged = pages.join(first, "digest", "left")

    def run(batches):
        for batch in batches:
            out = []
            for page, url, payload, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "response")), strict=True):
                refers = record_id(response, payload) if response is not None and response != page else None
                out += page_records(page, url, payload, refers, segment)
            for i in range(0, len(out), 500):
                # A member ends with its length, of which the last byte is 0 below 16 MiB: the writer adds it.
                yield pa.RecordBatch.from_arrays([pa.array([member(x)[:-1] for x in out[i : i + 500]], pa.binary())], ["record"])

    records = judged.select("page_id", "url", "payload", "response").mapInArrow(run, "record binary")
    # The cast keeps bytes as they are, and the text writer ends each row with a byte of 0, so a file is its members and no more.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unzipped(body: bytes) -> bytes:
    """All members of a gzip file. Read as a stream, since gzip.decompress copies what is left of the file for each member."""
    return gzip.GzipFile(fileobj=io.BytesIO(body)).read()


def parse(content: bytes):
    """The records of an archive: header fields (names in lower case) and block."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(content):
            raise ValueError("record is cut short")
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size
        while content[at : at + 2] == b"\r\n":
            at += 2


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path: RECORD_FIELDS."""

    def run(batches):
        names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                body = content.as_py()
                for f, block in parse(unzipped(body) if body[:2] == b"\x1f\x8b" else body):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), int(f["warc-page-id"]) if "warc-page-id" in f else None, f.get("warc-segment-origin-id"), number and int(number), total and int(total), f.get("warc-refers-to"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_FIELDS)


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, kind, page_id, refers, http of whole records: segments are grouped by the identifier of their origin, ordered by their
    number, and checked for gaps and against the total length; a record that fails a check raises an error. Repeated segments count once."""
    whole = records.where("number is null").select("record_id", "kind", "page_id", "refers", F.col("block").alias("http"))
    cut = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    grouped = cut.groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("kind"))).alias("kind"), F.max("page_id").alias("page_id"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"),
    )

    def run(batches):
        for batch in batches:
            for origin, kind, page, total, parts in zip(*(batch.column(c).to_pylist() for c in ("origin", "kind", "page_id", "total", "parts")), strict=True):
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or kind is None:
                    raise ValueError(f"segments of {origin} are missing")
                http = b"".join(p["block"] for p in parts)
                if len(http) != total:
                    raise ValueError(f"{origin} has {len(http)} bytes of {total}")
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([kind]), pa.array([page], pa.int64()), pa.array([None], pa.string()), pa.array([http], pa.binary())], ["record_id", "kind", "page_id", "refers", "http"])

    joined = grouped.select("origin", "kind", "page_id", "total", "parts").mapInArrow(run, "record_id string, kind string, page_id long, refers string, http binary")
    return whole.unionByName(joined)


def payload_facts(whole: DataFrame) -> DataFrame:
    """record_id, kind, page_id, refers, payload_bytes and payload_digest (SHA-1) of the decoded payload; null for revisits."""

    def run(batches):
        for batch in batches:
            size, digest = [], []
            for kind, http in zip(batch.column("kind").to_pylist(), batch.column("http"), strict=True):
                body = payload_of(http.as_py()) if kind == "response" else None
                size.append(None if body is None else len(body))
                digest.append(None if body is None else hashlib.sha1(body).hexdigest())
            names = ["record_id", "kind", "page_id", "refers"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(size, pa.int64()), pa.array(digest, pa.string())], [*names, "payload_bytes", "payload_digest"])

    return whole.mapInArrow(run, "record_id string, kind string, page_id long, refers string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes all pages as WARC, reads the archives back and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    Rows that repeat a page_id and html are one page; a repeated page_id with other html is a page of its own. An empty table gives an
    empty result. Extra columns are ignored; control characters in a url become spaces.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, segment)
    facts = save(payload_facts(reassemble(read_records(spark, path))).dropDuplicates(["record_id"]), "payloads")
    responses = facts.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    source = facts.where("kind = 'response'").select(F.col("record_id").alias("refers"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    revisits = facts.where("kind = 'revisit'").select("page_id", "refers").join(source, "refers").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.union(revisits)
