"""WARC archives: pages written as records in segments, read back by segment reassembly.

Writing: a payload that several pages share is kept once, by the page with the greatest id; the others are revisit
records that refer to it. A response's block is an HTTP message whose body is in chunked transfer framing; a block longer
than a segment is written as a first record and continuation records. Reading: the records of all archives are parsed,
segments are grouped by the identifier of their origin record, put in order by segment number, checked against the total
length and joined, and the chunked framing is undone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

SEGMENT, CHUNK, PIECE = 16_384, 4_096, 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, sha1: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{sha1}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; a ValueError where the framing is broken or cut short."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("WARC: a chunk size is missing")
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        body = data[end + 2 : end + 2 + size]
        if len(body) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("WARC: a chunk is cut short")
        out.append(body)
        at = end + 4 + size


def _record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def write_page(page: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response's first segment and its continuations."""
    sha1 = digest(payload)
    name = record_id(page, sha1) if not copy else record_id(page, sha1)[:-1] + f":{copy}>"
    fields = {"WARC-Date": DATE, "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Page-ID": None if page is None else str(page), "WARC-Payload-Digest": f"sha1:{sha1}"}
    kind = {"Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": name, **fields, "WARC-Refers-To": record_id(refers_to, sha1), "WARC-Refers-To-Page": str(refers_to), "WARC-Profile": PROFILE, **kind}, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record({"WARC-Type": "response", "WARC-Record-ID": name, **fields, **kind}, block)
        return
    count = -(-len(block) // SEGMENT)
    for i in range(count):
        part = block[i * SEGMENT : (i + 1) * SEGMENT]
        if not i:
            yield _record({"WARC-Type": "response", "WARC-Record-ID": name, **fields, "WARC-Segment-Number": "1", **kind}, part)
        else:
            total = str(len(block)) if i == count - 1 else None
            yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:segment:{i + 1}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": str(i + 1), "WARC-Segment-Total-Length": total}, part)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a run of whole records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("WARC: a record doesn't start where it should")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("WARC: a record is cut short")
        yield fields, block
        at = end + 8 + size


def find_revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to): for payloads of at least least_bytes that several pages share, the page they revisit."""
    keyed = pages.select(F.col(id_col).alias("page_id"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")).where(F.col("page_id").isNotNull()).distinct()
    keyed = materialize(keyed, "warc-digests")
    owners = keyed.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("pages")).where("pages > 1").select(F.col("sha1").alias("o_sha1"), "owner")
    return keyed.join(owners, keyed["sha1"] == owners["o_sha1"]).where("page_id <> owner").select("page_id", "sha1", F.col("owner").alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, piece, content): archives as runs of whole records, pieces of about 1 MB, in a table in the shared folder.

    Null htmls are empty payloads. Pages with a null id are responses of their own that nothing refers to. Of equal rows
    each is a record; of rows with one id and one payload all are of one kind. Columns other than these three are ignored.
    """
    small_batches(pages.sparkSession)
    revisits = find_revisits(pages, id_col, html_col).withColumnsRenamed({"page_id": "r_page", "sha1": "r_sha1"})
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.join(revisits, (rows["page_id"] == revisits["r_page"]) & (F.sha1(F.encode("html", "UTF-8")) == revisits["r_sha1"]), "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        from pyspark import TaskContext

        archive, piece, content, held, copies = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                for page, url, html, refers in zip(*(part.column(i).to_pylist() for i in range(4))):
                    copies += 1
                    for record in write_page(page, url, html.encode(), refers, archive << 40 | copies):
                        content.append(record)
                        held += len(record)
                        if held >= PIECE:
                            yield _piece(archive, piece, b"".join(content))
                            piece, content, held = piece + 1, [], 0
        if content:
            yield _piece(archive, piece, b"".join(content))

    return materialize(rows.mapInArrow(run, "archive bigint, piece bigint, content binary"), "warc-archives")


def _piece(archive: int, piece: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([piece]), pa.array([content], pa.binary())], ["archive", "piece", "content"])


RECORD = "origin string, segment int, total bigint, kind string, page_id bigint, url string, payload_digest string, refers_to bigint, block binary"


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record or segment; origin is the identifier that a continuation shares with its first segment."""

    def run(batches):
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda f, k: int(f[k]) if k in f else None
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse_records(content.as_py()):
                    digest_field = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), f["warc-type"], number(f, "warc-page-id"), f.get("warc-target-uri"), digest_field, number(f, "warc-refers-to-page"), block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select("content").mapInArrow(run, RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, kind, payload_digest, refers_to, payload) of every page record; payload is null for revisits.

    Only segmented records are shuffled: they are grouped by origin, ordered by segment number and joined. Missing or
    repeated segment numbers, a wrong total length, broken chunked framing or a payload that its digest doesn't fit are
    errors that name the record.
    """
    records = read_records(archives)
    whole = records.where("segment IS NULL").select("origin", "kind", "page_id", "url", "payload_digest", "refers_to", F.array("block").alias("blocks"))
    parts = records.where("segment IS NOT NULL").groupBy("origin").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "url", "payload_digest", "refers_to")],
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"), F.max("total").alias("total"),
    )
    in_order = F.transform("segments", lambda s: s["segment"]) == F.sequence(F.lit(1), F.size("segments"))
    length = F.aggregate("segments", F.lit(0).cast("bigint"), lambda n, s: n + F.octet_length(s["block"]))
    bad = F.when(~in_order | F.col("total").isNull() | (length != F.col("total")), F.raise_error(F.concat(F.lit("WARC: segments don't make up "), "origin")))
    blocks = F.coalesce(bad.cast("array<binary>"), F.transform("segments", lambda s: s["block"]))
    joined = whole.unionByName(parts.select("origin", "kind", "page_id", "url", "payload_digest", "refers_to", blocks.alias("blocks")))

    def run(batches):
        for batch in batches:
            payloads = []
            for origin, kind, want, blocks in zip(*(batch.column(c).to_pylist() for c in ("origin", "kind", "payload_digest", "blocks"))):
                head, _, body = b"".join(blocks).partition(b"\r\n\r\n")
                payload = None
                if kind == "response":
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if want is not None and digest(payload) != want:
                        raise ValueError(f"WARC: the payload of {origin} doesn't fit its digest")
                payloads.append(payload)
            kept = [batch.column(c) for c in ("page_id", "url", "kind", "payload_digest", "refers_to")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary())], ["page_id", "url", "kind", "payload_digest", "refers_to", "payload"])

    return joined.mapInArrow(run, "page_id bigint, url string, kind string, payload_digest string, refers_to bigint, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, kind, refers_to): sizes of revisits come from the responses they refer to."""
    sized = materialize(records.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "kind", "refers_to"), "warc-read")
    responses = sized.where("kind = 'response'")
    by_page = responses.select(F.col("page_id").alias("o_page"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).distinct()
    revisits = sized.where("kind = 'revisit'").drop("payload_bytes").join(by_page, (F.col("refers_to") == F.col("o_page")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").unionByName(revisits.select("page_id", F.col("o_bytes").alias("payload_bytes"), "payload_digest", "kind", "refers_to"))
