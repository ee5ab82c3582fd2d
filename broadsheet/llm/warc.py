"""WARC archives: a writer with revisit records, and a reader that salvages what is left of damaged files.

Writer: every row becomes one record in a compressed member of its own. Of equal payloads the row with the largest key
holds the payload (response), the others refer to it (revisit); payloads shorter than `min_revisit` are all written out.
Tasks write files of about `file_bytes` under a new name in the shared folder, so a repeated task never touches another
attempt's file; only files named by the finished attempt's manifest rows count.

Reader: files are read in byte ranges; a range yields the records that start in it. At each position a record is checked
in full (member checksum, header lines, Content-Length, end mark, payload digest). When a check fails the reader goes on
at the next member magic or version line that passes all checks, whatever the file's name or first bytes. A member may hold
several records, which share its place. Bytes that belong to no valid record, and members with an invalid one, are logged
as gaps with the reason of the first failed check in them.

Defined cases: a null payload is the empty payload; a null key is written as such and ranks below every other; rows equal
in key and payload have the same role; an empty table gives no files, no records and no gaps; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, shared_folder
from broadsheet.session import cut

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
STEP = 1 << 16
END = b"\r\n\r\n"
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "path string, offset long, end long, record_id string, record_type string, target string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, target: str, payload: bytes, refers_to: str | None, compress: bool = True, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit (refers_to given) has the response's HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:key:{quote(key, safe='')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(target, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: <urn:key:{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode() + END + block + END
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(
    pages: DataFrame,
    key_col: str = "page_id",
    target_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 0,
    file_bytes: int = 32 << 20,
    folder: str | None = None,
) -> DataFrame:
    """Write the archives now and return their manifest: path, bytes, records."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key_col).alias("key"), F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("target"), payload.alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    owners = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("sha").agg(F.max("key").alias("owner"))
    roles = rows.join(owners, "sha", "left").select(
        F.col("key").cast("string").alias("key"),
        "target",
        "payload",
        F.when(~F.col("key").eqNullSafe(F.col("owner")), F.col("owner").cast("string")).alias("refers_to"),
    )

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        out, done = None, []

        def close():
            nonlocal out
            if out:
                f, path, n = out
                size = f.tell()
                f.close()
                os.rename(path + ".open", path)
                done.append((path, size, n))
                out = None

        for batch in batches:
            for key, target, body, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = [open(path + ".open", "wb"), path, 0]  # noqa: SIM115
                out[0].write(record("" if key is None else key, target, body, refers))
                out[2] += 1
                if out[0].tell() >= file_bytes:
                    close()
        close()
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return cut(map_arrow(roles, run, "path string, bytes long, records long"))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of a folder's files (path, bytes); contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    return files.withColumn("path", F.url_decode(F.regexp_replace("path", "^file:/+", "/")))


class Source:
    """Reads a file by position, keeping one window of it."""

    def __init__(self, path: str):
        self.f, self.at, self.held = open(path, "rb"), 0, b""  # noqa: SIM115
        self.size = os.fstat(self.f.fileno()).st_size

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, 16 * STEP))
        return self.held[at - self.at : at - self.at + n]

    def find(self, mark: re.Pattern | bytes, at: int, stop: int) -> int:
        """The first place of the mark, of no more bytes than VERSION, that starts in [at, stop), or -1."""
        while at < stop:
            piece = self.get(at, STEP)
            found = re.search(mark, piece)
            if found:
                return at + found.start() if at + found.start() < stop else -1
            if len(piece) < STEP:
                return -1
            at += STEP - len(VERSION) + 1
        return -1


def parsed(raw: bytes) -> tuple:
    """Fields of a record's bytes without its end mark; ValueError names the failed check."""
    head, sep, block = raw.partition(END)
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise ValueError("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or int(fields["content-length"]) != len(block):
        raise ValueError("content length")
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, size = block, len(block)
    if "application/http" in fields.get("content-type", ""):
        http, sep, payload = block.partition(END)
        if not sep:
            raise ValueError("no end of the HTTP head")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(said[1]) if said and kind == "revisit" else len(payload)
    if kind != "revisit":
        if digest and sha1_base32(payload) != digest:
            raise ValueError("payload digest")
        digest = digest or sha1_base32(payload)
    key = lambda name: fields.get(name, "").removeprefix("<").removesuffix(">").removeprefix("urn:key:")
    refers = unquote(key("warc-refers-to")) if "warc-refers-to" in fields else None
    return unquote(key("warc-record-id")), kind, fields.get("warc-target-uri", ""), refers, size, digest, payload if kind != "revisit" else None


def member_at(src: Source, at: int) -> tuple[int, list[tuple], str | None]:
    """End of the compressed member at a place, fields of its valid records, and the first failed check in it."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        piece = src.get(pos, STEP)
        if not piece:
            raise ValueError("cut short")
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise ValueError(f"member: {e}") from e
        pos += len(piece)
    raw, records, problem, start = b"".join(out), [], None, 0
    while 0 <= start < len(raw):
        try:
            end = record_end(raw, start)
            records.append(parsed(raw[start:end]))
            start = end + len(END)
        except ValueError as e:
            problem = problem or str(e)
            start = raw.find(VERSION, start + 1)
    if not records:
        raise ValueError(problem or "no version line")
    return pos - len(z.unused_data), records, problem


def record_end(raw: bytes, start: int) -> int:
    """Where the end mark of the record at a place stands."""
    if not raw.startswith(VERSION, start):
        raise ValueError("no version line")
    stop = raw.find(END, start)
    if stop < 0:
        raise ValueError("no end of the header")
    n = LENGTH.search(raw[start:stop])
    if not n:
        raise ValueError("content length")
    end = stop + len(END) + int(n[1])
    if raw[end : end + len(END)] != END:
        raise ValueError("no end mark")
    return end


def plain_at(src: Source, at: int) -> tuple[int, list[tuple], str | None]:
    """End and fields of the uncompressed record at a place, as of a member."""
    if src.get(at, len(VERSION)) != VERSION:
        raise ValueError("no version line")
    stop = src.find(END, at, src.size)
    if stop < 0:
        raise ValueError("no end of the header")
    n = LENGTH.search(src.get(at, stop - at))
    if not n:
        raise ValueError("content length")
    body = stop + len(END)
    end = body + int(n[1])
    if end + len(END) > src.size or src.get(end, len(END)) != END:
        raise ValueError("no end mark")
    return end + len(END), [parsed(src.get(at, end - at))], None


def records_in(path: str, lo: int, hi: int):
    """Rows of RECORD_SCHEMA for records that start in [lo, hi), and a row with a problem for each failed place."""
    src = Source(path)
    nothing = [None] * 7
    at, hi, sure = lo, min(hi, src.size), lo == 0
    while at < hi:
        try:
            end, records, problem = (member_at if src.get(at, len(MAGIC)) == MAGIC else plain_at)(src, at)
            for fields in records:
                yield (path, at, end, *fields, None)
            if problem:
                yield (path, at, end, *nothing, problem)
            at, sure = end, True
            continue
        except ValueError as e:
            if sure:
                yield (path, at, at, *nothing, str(e))
            sure = False
        at = src.find(MARK, at + 1, hi)
        if at < 0:
            return


def read_archives(manifest: DataFrame, range_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined gaps (path, offset, end, reason) of the files that a manifest names.

    Compressed files are split into ranges; an uncompressed one, whose payloads may hold version lines, is read by one
    task. A record found inside another (a stored archive as payload, met by a range that starts in it) is left out.
    """
    step = F.when(F.col("path").endswith(".warc"), F.greatest(F.col("bytes"), F.lit(1))).otherwise(F.lit(range_bytes))
    starts = manifest.filter(F.col("bytes") > 0).select("path", "bytes", step.alias("step"), F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, step)).alias("lo"))
    ranges = starts.select("path", "lo", (F.col("lo") + F.col("step")).alias("hi")).repartition(F.col("path"), F.col("lo"))

    def run(batches):
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, held = [], 0
                for row in records_in(path, lo, hi):
                    rows.append(row)
                    held += len(row[9] or b"")
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    found = map_arrow(ranges, run, RECORD_SCHEMA)
    earlier = Window.partitionBy("path").orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("path").orderBy("offset").rangeBetween(Window.unboundedPreceding, -1)  # records of one member share its place
    valid = found.filter("problem is null").withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    records = valid.filter(F.col("offset") >= F.col("covered")).drop("covered", "problem")
    ends = manifest.select("path", F.col("bytes").alias("offset"), F.col("bytes").alias("end"), F.lit(None).cast("string").alias("problem"))
    marked = found.select("path", "offset", "end", "problem").unionByName(ends)
    marked = marked.withColumn("covered", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    invalid = found.filter("problem is not null and end > offset").select("path", "offset", "end", F.col("problem").alias("reason"))
    gaps = (
        marked.withColumn("reason", F.last("problem", ignorenulls=True).over(earlier))
        .filter(F.col("problem").isNull() & (F.col("offset") > F.col("covered")))
        .select("path", F.col("covered").alias("offset"), F.col("offset").alias("end"), F.coalesce("reason", F.lit("unreadable")).alias("reason"))
    )
    return records, gaps.unionByName(invalid)
