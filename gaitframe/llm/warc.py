"""WARC archives: a writer that stores equal payloads once, and a salvaging reader.

The writer makes one record a page and lets Spark's text writer put them into files of
bounded length (JVM side, so any file system and the usual commit protocol). Equal
payloads of at least ``least`` bytes become revisit records of the one with the smallest
page_id; the digests are compared with salted keys, so that a payload that a third of
the pages share is no single group.

The reader takes whole archive files, plain or in gzip members of one or more records. A
record counts if its version line, its headers (folded lines too), its length, its end
and its payload digest hold. The digest is in hex or base32 of the algorithm that its
label names, over the record block or the HTTP payload; one that cannot be checked
(another algorithm, another size) fails no record. Records and gaps of one gzip member
carry the member's range. Members are unpacked as a stream, whatever they hold, and as
far as they go: a damaged one gives its records before the damage, and the rest is a gap.
When a check fails the reader goes on at the next gzip member or version line from which
a record can be read, and lists the bytes between as quarantined. Headers are read line
by line and end at the first bad one, and each mark is searched for once, so an archive
of nothing but damage takes linear time. A file has to fit a task and Spark's 2 GiB for a
binary value; a longer one is an error and not a gap. A record of over ``MOST_RECORD``
bytes, or with a header line of over ``MOST_LINE``, is listed as a gap.

Null html is an empty payload. Pages that share the smallest page_id of a payload are
all written whole. A null page_id is written whole and read back as null. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm.shared import MOST_BROADCAST, settle

SALTS = 16
#: Bytes of a record's block and of one header line; beyond them it is no value of a row, and quarantined.
MOST_RECORD, MOST_LINE = 1 << 30, 64 << 20
#: Bytes of an unpacked member that are held at once, besides one record.
HELD = 64 << 20
VERSION = b"WARC/1.1\r\n"
HEADS = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([!-9;-~]+)[ \t]*:")
MARKS = (b"WARC/1.", b"\x1f\x8b\x08")
RECORDS = "file string, start long, end long, kind string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Digest, size, type and target of every page's record, with its payload.

    Only digests and ids are shuffled. Payloads stay where they are as long as those that
    several pages share are few enough to be broadcast; beyond that they move once, to
    their digest and one of SALTS places, so that no payload is a single group.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    p = p.withColumns({"payload_digest": F.sha2(F.col("body").cast("binary"), 256), "payload_bytes": F.octet_length("body").cast("long")})
    seen = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = settle(seen.where("last > first").select(F.col("payload_digest").alias("_digest"), "first"), "firsts")
    same = F.col("payload_digest") == F.col("_digest")
    if firsts.count() <= MOST_BROADCAST:
        out = p.join(F.broadcast(firsts), same, "left")
    else:
        firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(firsts, same & (F.col("salt") == F.col("_salt")), "left")
    out = out.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return out.select("page_id", "url", "body", "payload_digest", "payload_bytes", "refers_to", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"))


def record_text(planned: DataFrame) -> DataFrame:
    """A WARC record a row, without its last line end (the text writer adds it)."""
    line = "\r\n"
    payload = F.when(F.col("record_type") == "response", F.col("body")).otherwise("")
    head = F.concat_ws(
        line,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7f]", "%20")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(F.col("record_type") == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return planned.select(F.concat(head, F.lit(line * 2), payload, F.lit(line)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 100, records_per_file: int = 2_000) -> None:
    """Write the pages' records to ``path``; a file holds at most ``records_per_file`` records."""
    records = record_text(plan_records(pages, least))
    records.write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member of its own, as in .warc.gz files."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _unchunked(body: bytes) -> bytes | None:
    """What a chunked HTTP body holds, None if it is not one."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return None


def _differs(digest: str, body: bytes, whole: bool = False) -> bool:
    """Whether a digest (sha256 if it has no label) fits neither the block nor, unless ``whole``, its HTTP payload."""
    label, sep, value = digest.rpartition(":")
    name = label.strip().lower().replace("-", "") if sep else "sha256"
    value = value.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return False
    size = hashlib.new(name).digest_size
    try:
        want = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return bool(re.fullmatch("[^=]{%d}" % (2 * size), value))
    if len(want) != size:
        return False
    forms = [body]
    if body.startswith(b"HTTP/") and not whole:
        head, end, payload = body.partition(b"\r\n\r\n")
        if end:
            forms.append(payload)
            if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) and (whole := _unchunked(payload)) is not None:
                forms.append(whole)
    return all(hashlib.new(name, x).digest() != want for x in forms)


class _Plain:
    """Bytes that are there as a whole."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def get(self, at: int, end: int) -> bytes:
        return self.raw[at:end]

    def seek(self, mark: bytes, at: int) -> int:
        return self.raw.find(mark, at, at + MOST_LINE)


class _Member:
    """What a gzip member holds, unpacked as it is read, as far as it goes.

    At its end ``end`` is where its bytes end in the file, and ``reason`` says how it is
    damaged, if it is. A damaged member gives all that comes before the damage.
    """

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at, self.width = memoryview(raw), at, 1 << 16
        self.unpack, self.pending = zlib.decompressobj(31), b""
        self.held, self.base = bytearray(), 0
        self.end, self.reason = -1, ""

    def _more(self) -> bool:
        """Unpack some more; False if there is none."""
        while self.end < 0:
            if not self.pending:
                self.pending = bytes(self.raw[self.at : self.at + (1 << 16)])
                self.at += len(self.pending)
                if not self.pending:
                    self.end, self.reason = len(self.raw), "member does not end"
                    break
            part, rest = self.pending[: self.width], self.pending[self.width :]
            before = self.unpack.copy()
            try:
                out = self.unpack.decompress(part, 1 << 20)
            except zlib.error as e:
                if len(part) > 1:  # by halves, up to the damage
                    self.unpack, self.width = before, len(part) // 2
                    continue
                self.end, self.reason = self.at - len(rest), f"bad member: {e}"
                break
            self.pending = self.unpack.unconsumed_tail + rest
            self.held += out
            if self.unpack.eof:
                self.end = self.at - len(rest) - len(self.unpack.unused_data)
            if out:
                return True
        return False

    def get(self, at: int, end: int) -> bytes:
        while self.base + len(self.held) < end and self._more():
            pass
        return bytes(self.held[at - self.base : end - self.base])

    def seek(self, mark: bytes, at: int) -> int:
        """Where ``mark`` stands next; what lies before stays."""
        seen = at
        while (i := self.held.find(mark, seen - self.base)) < 0:
            seen = max(at, self.base + len(self.held) - len(mark) + 1)
            if seen - at > MOST_LINE or not self._more():
                return -1
        return self.base + i

    def find(self, mark: bytes, at: int) -> int:
        """Where ``mark`` stands next; what lies before is given away."""
        while (i := self.held.find(mark, at - self.base)) < 0:
            at = max(at, self.base + len(self.held) - len(mark) + 1)
            self.forget(at)
            if not self._more():
                return -1
        return self.base + i

    def forget(self, at: int) -> None:
        if at - self.base > 1 << 20:
            del self.held[: at - self.base]
            self.base = at

    def close(self) -> None:
        """Read what is left, and keep nothing of it."""
        while self._more():
            self.base += len(self.held)
            self.held.clear()


class _Bad(ValueError):
    """A record that can't be read, and how far no record can start inside it."""

    def __init__(self, reason: str, clear: int):
        super().__init__(reason)
        self.clear = clear


def _parse(src: _Plain | _Member, at: int) -> tuple[int, dict]:
    """The record at ``at``: its end and fields. _Bad if a check fails.

    Headers are read line by line. A version line within them could only be a part of a
    value, and would meet the same lines, so the search for the next record starts behind them.
    """
    if not HEADS.match(src.get(at, at + 10)):
        raise _Bad("no version line", at + 1)
    fields: dict[str, str] = {}
    name, line = "", at + 10
    while True:
        # most lines are short; a long one is looked for further on
        stop = src.get(line, line + 512).find(b"\r\n")
        if stop < 0:
            if not FIELD.match(src.get(line, line + 512)):
                raise _Bad("bad header line", max(at + 1, line))
            stop = src.seek(b"\r\n", line)
            if stop < 0:
                raise _Bad("headers do not end", max(at + 1, line))
            stop -= line
        row = src.get(line, line + stop)
        if not row:
            break
        if row[:1] in b" \t" and name:
            fields[name] = f"{fields[name]} {row.strip().decode('utf-8', 'replace')}".strip()
        else:
            m = FIELD.match(row)
            if not m:
                raise _Bad("bad header line", max(at + 1, line))
            name = m[1].lower().decode("latin-1")
            fields[name] = row[m.end() :].strip().decode("utf-8", "replace")
        line += stop + 2
    start = line + 2
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        raise _Bad("no length", start)
    size = int(fields["content-length"])
    if size > MOST_RECORD:
        raise _Bad("record is longer than Spark's values", start)
    end = start + size
    if src.get(end, end + 4) != b"\r\n\r\n":
        raise _Bad("no end of record", start)
    body = src.get(start, end)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields.get("warc-type") == "response" and _differs(digest, body):
        raise _Bad("digest differs", start)
    if _differs(fields.get("warc-block-digest", "none:"), body, whole=True):
        raise _Bad("block digest differs", start)
    return end + 4, fields | {"body": body, "digest": digest}


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def _inside(member: _Member):
    """(fields or None, reason) of the records and gaps of a gzip member, in order."""
    at, reason = 0, ""
    while member.get(at, at + 1):
        try:
            end, fields = _parse(member, at)
        except _Bad as e:
            reason = reason or str(e)
            at = member.find(MARKS[0], e.clear)
            if at < 0:
                break
            continue
        if reason:
            yield None, reason
        yield fields, ""
        at, reason = end, ""
        member.forget(at)
    member.close()
    if member.reason or reason:
        yield None, member.reason or reason


def salvage(raw: bytes):
    """Yield (start, end, fields or None, reason): records and quarantined gaps, in order, without holes.

    What one gzip member holds has the member's start and end; the end of a damaged one is
    where it breaks off.
    """
    src = _Plain(raw)
    at = bad = 0
    reason = ""
    ahead = {mark: -1 for mark in MARKS}  # where each mark stands next

    def next_mark(after: int) -> int:
        for mark, i in ahead.items():
            if i < after:
                i = raw.find(mark, after)
                ahead[mark] = len(raw) if i < 0 else i
        return min(ahead.values())

    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            member = _Member(raw, at)
            member.get(0, HELD)
            if member.end < 0:  # a long one is read to its end, and then again record by record
                member.close()
            end, damage = member.end, member.reason
            found, first = False, ""
            for fields, said in _inside(member if not member.base else _Member(raw, at)):
                if not found and fields is None:
                    first = said
                    continue
                if not found:
                    if bad < at:
                        yield bad, at, None, reason
                    if first:
                        yield at, end, None, first
                found = True
                yield at, end, fields, said
            if found:
                at = bad = end
                reason = ""
            else:
                reason = reason or first or damage or "empty member"
                at = next_mark(at + 1)
            continue
        try:
            end, fields = _parse(src, at)
        except _Bad as e:
            reason = reason or str(e)
            at = next_mark(e.clear)
            continue
        if bad < at:
            yield bad, at, None, reason
        yield at, end, fields, ""
        at = bad = end
        reason = ""
    if bad < len(raw):
        yield bad, len(raw), None, reason


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives under ``path`` (see RECORDS).

    A file is read whole, so it has to fit a task (the writer's files do).
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]

    def rows(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out: list[tuple] = []
                for start, end, f, reason in salvage(raw.as_py()):
                    if f is None:
                        out.append((file, start, end, "gap", None, None, None, None, None, None, None, reason))
                    else:
                        size = f.get("x-payload-length", "")
                        n = int(size) if size.isdigit() else len(f["body"])
                        out.append((file, start, end, "record", _id(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), n, f["digest"], _id(f.get("warc-refers-to")), f["body"] if payloads else None, None))
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(rows, RECORDS)


def gaps(records: DataFrame) -> DataFrame:
    """The log of what was quarantined: file, byte range and the first failed check."""
    return records.where("kind = 'gap'").select("file", "start", "end", "reason")


def whole(records: DataFrame) -> DataFrame:
    """The records; a quarantined gap among them is an error that names its place."""
    said = F.concat_ws(" ", F.lit("quarantined:"), "file", "start", "end", "reason")
    return records.where(F.when(F.col("kind") == "gap", F.raise_error(said)).otherwise(F.lit(True)))
