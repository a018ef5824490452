"""WARC archives: a writer with revisit records, and a salvage reader that resumes after damage."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from propago.llm.arrow import append_columns
from propago.session import shared_dir

#: Bytes of one archive file at most, but for a single longer record: a reader's task holds one file at a time.
FILE_BYTES = 32 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, level: int = 1) -> bytes:
    """One gzip member, always the same for the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: The text writer ends each record with its separator; an empty gzip member is one that every reader skips.
EMPTY_MEMBER = _member(b"")


def _record(kind: str, ident: int | None, uri: str | None, digest: str, length: int, block: bytes, refers: int | None = None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if ident is None else ident}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Length: {length}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri:
        head.insert(3, "WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    if kind == "revisit":
        head.insert(4, f"WARC-Refers-To: <urn:x-page:{refers}>")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + END + block + END


def _response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + END + payload


def write(df: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write one gzip member a row to archives in ``path``, with Spark's own writer, so to any store that Spark reaches.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are response records, others
    revisit them; smaller ones are all response. A null payload is empty; a null id is smaller than any; repeated rows
    with the largest id are response each. An empty table writes no record. Each task numbers its files, ``file=0`` and
    so on, and begins a new one before it would pass ``file_bytes``; a longer record has a file to itself.
    """

    def make():
        def fn(ids, uris, payloads):
            digests, sizes, members = [], [], []
            for ident, uri, p in zip(ids, uris, payloads):
                p = p or b""
                digests.append(digest32(p))
                sizes.append(len(p))
                members.append(_member(_record("response", ident, uri, digests[-1], len(p), _response(p))))
            return pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())

        return fn

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("uri"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    fields = [StructField("digest", StringType()), StructField("size", LongType()), StructField("member", BinaryType())]
    made = append_columns(source, {"id": "long", "uri": "string", "payload": "binary"}, fields, make).drop("payload")
    slim = source.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload")).filter(F.col("size") >= least)
    first = slim.groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("hex"), "largest")
    hexed = made.withColumn("hex", F.lower(_hex_of_base32("digest")))
    joined = hexed.join(first, "hex", "left")
    revisits = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))

    def make_revisits():
        file, filled = 0, 0

        def fn(ids, uris, digests, sizes, largest, again, members):
            nonlocal file, filled
            rows = [_member(_record("revisit", i, u, d, s, b"", r)) if a else m for i, u, d, s, r, a, m in zip(ids, uris, digests, sizes, largest, again, members)]
            files = []
            for row in rows:
                size = len(row) + len(EMPTY_MEMBER)
                if filled and filled + size > file_bytes:
                    file, filled = file + 1, 0
                filled += size
                files.append(file)
            return pa.array(rows, pa.binary()), pa.array(files, pa.int32())

        return fn

    inputs = {"id": "long", "uri": "string", "digest": "string", "size": "long", "largest": "long", "again": "boolean", "member": "binary"}
    records = append_columns(joined.withColumn("again", revisits), inputs, [StructField("value", BinaryType()), StructField("file", IntegerType())], make_revisits)
    text = records.select(F.col("value").cast("string"), "file")
    text.write.partitionBy("file").options(lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1").text(path)


def _hex_of_base32(column: str):
    """Hex digits of a base32 string of 32 characters: each four are twenty bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    value = lambda i: F.position(F.substring(column, i, 1), alphabet) - 1
    parts = []
    for i in range(1, 33, 4):
        n = F.lit(0)
        for j in range(4):
            n = n * 32 + value(i + j)
        parts.append(F.lpad(F.hex(n.cast("long")), 5, "0"))
    return F.concat(*parts)


class _Places:
    """The next place of a pattern from a place that only grows; each search goes on where the last one of it ended."""

    def __init__(self, data: bytes) -> None:
        self.data, self.found = data, {}

    def find(self, pattern: bytes, at: int) -> int:
        known = self.found.get(pattern)
        if known is None or (0 <= known[1] < at) or at < known[0]:
            known = self.found[pattern] = at, self.data.find(pattern, at)
        return known[1]


def _parse(data: bytes, at: int, places: _Places | None = None) -> tuple[dict, int]:
    """The record at ``at`` of plain bytes and where it ends. Raises ValueError with the failed check."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    stop = (places or data).find(END, at)
    if stop < 0:
        raise ValueError("headers without end")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdecimal() or "warc-type" not in head:
        raise ValueError("no length or type")
    start = stop + len(END)
    end = start + int(head["content-length"])
    if end + len(END) > len(data):
        raise ValueError("block is cut off")
    if data[end : end + len(END)] != END:
        raise ValueError("no end after block")
    block = data[start:end]
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:].upper() != digest32(block):
        raise ValueError("block digest differs")
    payload = block.partition(END)[2] if head.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/") else block
    told = head.get("warc-payload-digest", "")
    if head["warc-type"] != "revisit" and told.startswith("sha1:") and told[5:].upper() != digest32(payload):
        raise ValueError("payload digest differs")
    return {"head": head, "payload": payload}, end + len(END)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The plain bytes of the member at ``at``, where what was read ends, and what is wrong with it; then all bytes before the damage."""
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not z.eof:  # by pieces: zlib copies what follows the member in the last one
            out.append(z.decompress(data[end : end + (1 << 14)]))
            end = min(end + (1 << 14), len(data))
        return b"".join(out), end - len(z.unused_data), None if z.eof else "gzip member is cut off"
    except zlib.error as e:
        why = f"bad gzip member: {e}"
    z, out, step = zlib.decompressobj(31), [], 1 << 14
    while step and at < len(data) and not z.eof:  # a failed call gives nothing, so its piece is read again by halves
        before = z.copy()
        try:
            out.append(z.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            z, step = before, step // 2
    return b"".join(out), min(at, len(data)), why


def _within(plain: bytes) -> Iterator[dict]:
    """The valid records of a member's plain bytes and, as {"error"}, the gaps between them."""
    at, bad, why, places = 0, None, "", _Places(plain)
    gap = lambda end: {"error": f"{why} (plain bytes {bad} to {end} of the member)", "why": why}
    while at < len(plain):
        if bad is None and plain.startswith(b"\r\n", at):
            at += 2
            continue
        try:
            record, end = _parse(plain, at, places)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = places.find(b"\n" + VERSION, at) + 1 or len(plain)
            continue
        if bad is not None:
            yield gap(at)
            bad = None
        yield {"record": record}
        at = end
    if bad is not None:
        yield gap(len(plain))


def _next(data: bytes, at: int, places: _Places) -> int:
    """The next place from ``at`` where a member or a version line may start."""
    member = places.find(GZIP, at)
    line = at if data.startswith(VERSION, at) and (at == 0 or data[at - 1 : at] == b"\n") else places.find(b"\n" + VERSION, max(0, at - 1)) + 1 or -1
    return min((x for x in (member, line) if x >= at), default=len(data))


def salvage(data: bytes) -> Iterator[dict]:
    """Every valid record of an archive, and the gaps between them.

    Yields {"start", "end", "record"} or, for quarantined bytes, {"start", "end", "error"} in order of the bytes. After
    a failed check the search goes on one byte later for the next gzip member or version line that holds a valid record.
    Gaps that touch are one. Plain and gzipped records may be mixed; blank lines and empty members are no gaps. A member
    may hold several records: valid ones are yielded, and gaps between them, with the bytes of the member, also of what
    was inflated before damage; the bytes of a damaged member are a gap too.
    """
    at, bad, why, read, places = 0, None, "", 0, _Places(data)
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                plain, end, damage = _inflate(data, at)
                found = list(_within(plain))
                if not any("record" in x for x in found) and (found or damage):
                    raise ValueError(damage or found[0]["why"])
                if damage and found[-1:] and "record" not in found[-1]:
                    found.pop()  # the damage itself
            elif data[at : at + 2] == b"\r\n" and bad is None:
                at += 2
                continue
            else:
                record, end = _parse(data, at, places)
                if at < read:
                    raise ValueError("inside a damaged member")
                found, damage = [{"record": record}], None
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next(data, at + 1, places)
            continue
        if bad is not None and found:
            yield {"start": bad, "end": at, "error": why}
            bad = None
        for x in found:
            yield {"start": at, "end": end} | ({"record": x["record"]} if "record" in x else {"error": x["error"]})
        if damage:
            bad, why, read = at, damage, end
            at = _next(data, at + 1, places)
        else:
            at = end
    if bad is not None:
        yield {"start": bad, "end": len(data), "error": why}


_SCHEMA = "file string, start long, end long, error string, record_type string, id long, uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _page(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdecimal() else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each valid record and each quarantined gap (``error`` not null) of the archives in ``path``.

    Digest and length are those of the payload read; a revisit has none and states those of the record it refers to.
    """

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for x in salvage(data.as_py()):
                    row = {"file": file, "start": x["start"], "end": x["end"], "error": x.get("error")}
                    if "record" in x:
                        head, payload = x["record"]["head"], x["record"]["payload"]
                        again = head["warc-type"] == "revisit"
                        told = head.get("warc-payload-length", "")
                        row |= {
                            "record_type": head["warc-type"], "id": _page(head.get("warc-record-id")), "uri": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to")) if again else None,
                            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if again else digest32(payload),
                            "payload_bytes": int(told) if again and told.isdecimal() else None if again else len(payload),
                            "payload": payload if payloads and not again else None,
                        }
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema([("file", text), ("start", number), ("end", number), ("error", text), ("record_type", text), ("id", number), ("uri", text), ("refers_to", number), ("payload_digest", text), ("payload_bytes", number), ("payload", pa.binary())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMA)


def whole(records: DataFrame) -> DataFrame:
    """The records, failing the job at the first quarantined gap: for archives that must not have any."""
    said = F.concat_ws(" ", F.lit("damaged archive"), "file", F.lit("bytes"), "start", F.lit("to"), "end", "error")
    return records.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def log_gaps(records: DataFrame, path: str) -> None:
    """Write the quarantined byte gaps of ``records`` as JSON lines (file, start, end, error)."""
    records.filter("error IS NOT NULL").select("file", "start", "end", "error").write.json(path)


def archive(df: DataFrame, **columns) -> str:
    """Write ``df`` to a new folder of archives in the shared folder and return its path."""
    path = f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(df, path, **columns)
    return path
