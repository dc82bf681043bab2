"""WARC archives of pages: writing, and reading back with segment reassembly.

Records are text (headers in ASCII, payloads in UTF-8), so that Spark's own text writer puts them into gzip files on any file
system, with the record terminator as line separator; a lost task is written again and committed once.  A page is an HTTP
response with chunked transfer framing.  A block longer than a segment goes on in continuation records.  Equal payloads are
stored once, in the record of the largest page id; the others revisit it.

The reader inflates files as streams, groups continuation records by origin id, orders them by segment number, verifies the
total length and removes the chunked framing.  Records of one segment are read where they lie; only segments are shuffled.  A
revisit is looked up: its length and digest are those of the response that was read, and a response that is lost is noticed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_known, written

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: str, size: int) -> str:
    """Chunked transfer framing, cut between characters: chunks of at most ``size`` code points."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; raises if it is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n, at = int(body[at:line].split(b";")[0], 16), line + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += n + 2


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *headers, ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n" + block


def page_records(page_id, url: str, html: str, refers_to, digest: str, record_id: str, segment: int, chunk: int) -> Iterator[str]:
    """The records of a page: one, or a first and its continuations."""
    own = [("WARC-Target-URI", "".join(url.split()) or "about:blank"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Length", str(len(html.encode())))]
        yield record("revisit", record_id, own + profile, HTTP.replace("Transfer-Encoding: chunked\r\n", ""))
        return
    block = HTTP + chunked(html, chunk)
    if len(block) <= segment:
        yield record("response", record_id, own, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    total = str(len(block.encode()))
    yield record("response", record_id, [*own, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(i))]
        more += [("WARC-Segment-Total-Length", total)] if i == len(parts) else []
        yield record("continuation", str(uuid.uuid5(uuid.UUID(record_id), str(i))), more, part)


def with_revisits(pages: DataFrame, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, digest, refers_to``: of equal payloads of ``least`` bytes or more, all but those of the largest
    page id refer to it.

    Digests meet without the html; a page is moved by its own id and digest at most, so that a common page makes no hot task.
    """
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    narrow = written(rows.filter(F.col("bytes") >= least).select("page_id", "digest", "bytes"), "payload-digests")
    heads = narrow.groupBy("digest", "bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("k")).filter("k > 1")
    found = join_known(narrow, written(heads, "payload-heads"), ["digest", "bytes"])
    others = found.filter(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))).select("page_id", "digest", F.col("head").alias("refers_to")).distinct()
    others = written(others.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to"), "revisits")
    large = rows.filter(F.col("bytes") >= least).join(others, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    small = rows.filter(F.col("bytes") < least).withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "url", "html", "digest", "refers_to"]
    return large.select(*names).union(small.select(*names))


def write_archives(pages: DataFrame, path: str, segment: int = 65_536, chunk: int = 16_384, records_per_file: int = 4000, **columns) -> None:
    """Writes ``pages`` as WARC files under ``path``.  Null html is empty; repeated rows get records of their own."""
    rows = with_revisits(pages, **columns)
    kind = pa.schema([("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, n = uuid.uuid5(uuid.NAMESPACE_URL, f"part-{TaskContext.get().partitionId()}"), 0
        for big in batches:
            for at in range(0, big.num_rows, 256):
                out: list[str] = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in big.slice(at, 256).columns)):
                    n += 1
                    out += page_records(page_id, url, html, refers_to, digest, str(uuid.uuid5(space, f"{page_id}-{n}")), segment, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=kind)

    records = rows.mapInArrow(run, "record string")
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in parts; other bytes as they are.  Raises if it is cut short."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        d = zlib.decompressobj(31)
        while not d.eof:
            if d.unconsumed_tail:
                fed = d.unconsumed_tail
            else:
                fed, at = bytes(view[at : at + size]), at + size
            if not fed:
                raise ValueError("a compressed file is cut short")
            yield d.decompress(fed, 4 * size)
        at = min(at, len(view)) - len(d.unused_data)


def parse_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records of a file that comes in parts; raises if the file is broken.

    One record and one part are held.
    """
    buffer, at, parts = b"", 0, iter(parts)

    def more(n: int) -> bool:
        """Makes ``n`` bytes from ``at`` on available, if the file has them."""
        nonlocal buffer, at
        if len(buffer) - at < n:
            held = [buffer[at:]]
            have = len(held[0])
            while have < n and (part := next(parts, None)) is not None:
                held.append(part)
                have += len(part)
            buffer, at = b"".join(held), 0
        return len(buffer) - at >= n

    while more(1):
        more(5)
        if buffer[at : at + 5] != b"WARC/":
            raise ValueError("no record where one should begin")
        want = 1024
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(want):
                end = buffer.find(b"\r\n\r\n", at)
                break
            want *= 2
        if end < 0:
            raise ValueError("the headers of a record do not end")
        lines = buffer[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n, head = int(headers["content-length"]), end + 4 - at
        more(head + n + 4)
        block = buffer[at + head : at + head + n]
        if len(block) != n or buffer[at + head + n : at + head + n + 4] != b"\r\n\r\n":
            raise ValueError("a record of the wrong length")
        yield headers, block
        at += head + n + 4


FIELDS = "origin string, segment long, total long, page_id long, kind string, refers_to long, told_digest string, payload_bytes long, payload_digest string, block binary, payload binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
OUT_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _finished(block: bytes, told: str | None) -> tuple[int, str, bytes]:
    """Length, digest and content of the payload of a response; raises if the digest is not the told one."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    digest = hashlib.sha1(payload).hexdigest()
    if told and digest != told:
        raise ValueError("a payload does not have its digest")
    return len(payload), digest, payload


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(zip(NAMES, KINDS)))
    number = lambda v: int(v) if v else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)], schema=schema)

    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for h, block in parse_records(inflated(content.as_py())):
                told = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                row = [origin, number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), number(h.get("x-page-id")), h["warc-type"], number(h.get("x-refers-to-page-id")), told, None, None, None, None]
                if row[4] == "revisit":
                    row[7] = number(h.get("x-payload-length"))
                elif row[1] is None:
                    row[7], row[8], row[10] = _finished(block, told)
                else:
                    row[9] = block
                rows.append(row)
                held += len(block)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Origin records with all their segments as whole responses."""
    schema = pa.schema(list(zip([f.split()[0] for f in OUT.split(", ")], OUT_KINDS)))
    for b in batches:
        for i in range(b.num_rows):
            origin, page_id, told, parts = (c[0] for c in (x.to_pylist() for x in b.slice(i, 1).columns))
            parts.sort(key=lambda p: p["segment"])
            whole = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(whole):
                raise ValueError(f"segments of {origin} are missing")
            size, digest, payload = _finished(whole, told)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((page_id, size, digest, "response", None, payload), OUT_KINDS)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page record under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Digests are of the payload as read; a revisit's are those of the response that it refers to.  ``payload`` is the decoded
    payload, null for revisits.  Repeated records give repeated rows; a folder without records gives none.  Raises on missing
    segments, wrong total lengths, broken framing, digests that do not fit, and revisits whose response is not there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    records = written(files.mapInArrow(_scan, FIELDS), "records")
    names = [f.split()[0] for f in OUT.split(", ")]
    single = records.filter("kind = 'response' and segment is null").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "payload")
    first = lambda c: F.max(c).alias(c)  # noqa: E731  continuations have null
    segments = records.filter("segment is not null").groupBy("origin").agg(first("page_id"), first("told_digest"), F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    segmented = segments.mapInArrow(_reassemble, OUT)
    responses = single.union(segmented)
    revisits = records.filter("kind = 'revisit'").select("page_id", "refers_to", "told_digest", F.col("payload_bytes").alias("_told"))
    wanted = revisits.groupBy("refers_to", "told_digest").agg(F.count("*").alias("k"))
    there = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told_digest"), "payload_bytes").distinct()
    known = written(wanted.join(there, ["refers_to", "told_digest"]), "revisited")
    looked = join_known(revisits, known, ["refers_to", "told_digest"])
    ok = F.col("payload_bytes").isNotNull() & F.coalesce(F.col("_told") == F.col("payload_bytes"), F.lit(True))
    size = F.when(ok, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("the response of a revisit is missing: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("none")))).cast("long"))
    again = looked.select("page_id", size.alias("payload_bytes"), F.col("told_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.lit(None).cast("binary").alias("payload"))
    return responses.select(*names).union(again.select(*names))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` into the shared folder and reads the archives back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
