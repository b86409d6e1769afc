"""Members of long plain tar archives, listed by many tasks.

A task that starts within an archive can't know whether a block that looks like a header
is one, or data of a member (an archive in an archive). So:

1. Every byte range finds all blocks with a header's checksum, and follows each one's
   chain of members to the first header behind the range. Chains soon meet, so a range
   gives its most common way out, and the few places that have another.
2. One pass over the ranges in order (a row a range) finds where the true chain enters
   each of them.
3. Each range lists the members from there; ordinals are sums of the ranges' counts.

The listing is that of a reader which goes through the archive from its start; it ends at
the first block that is no header.
"""

from __future__ import annotations

import tarfile
from collections import Counter
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
END = -1


def opened(uri: str) -> BinaryIO:
    """A file that a task can seek in: local ones as they are, others by their file system."""
    from urllib.parse import unquote

    from pyarrow import fs

    if uri.startswith("file:"):
        return open(unquote(uri.removeprefix("file:")), "rb")
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def is_plain(raw: BinaryIO) -> bool:
    """Whether a file is no compressed one: it starts with a header block, or without the marks of gzip, bzip2, xz and zstd."""
    raw.seek(0)
    head = raw.read(BLOCK)
    return bool(len(headers(np.frombuffer(head, np.uint8)))) or head[:2] not in (b"\x1f\x8b", b"BZ", b"\xfd7", b"(\xb5")


def headers(data: np.ndarray) -> np.ndarray:
    """Numbers of the blocks whose checksum is right."""
    blocks = data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)
    field = blocks[:, 148:156].astype(np.int64)
    digit = (field >= 48) & (field < 56)
    total = np.zeros(len(blocks), np.int64)
    for i in range(8):
        total = np.where(digit[:, i], total * 8 + field[:, i] - 48, total)
    sums = blocks.sum(1, dtype=np.int64) - field.sum(1) + 256
    high = (blocks > 127).sum(1, dtype=np.int64) * 256 - (field > 127).sum(1) * 256  # old writers summed signed bytes
    return np.flatnonzero(digit.any(1) & ((sums == total) | (sums - high == total)))


def follow(raw: BinaryIO, at: int):
    """(start, next start, member) of the members from ``at`` on; a last member has END as its next start."""
    raw.seek(at)
    try:
        tar = tarfile.open(fileobj=raw, mode="r:")
    except tarfile.TarError:
        return
    member = tar.next()
    while member is not None:
        ahead = tar.offset
        try:
            later = tar.next()
        except tarfile.TarError:
            later = None
        tar.members = []
        yield at, ahead if later is not None else END, member
        at, member = ahead, later


def ways_out(raw: BinaryIO, lo: int, hi: int) -> tuple[int, dict[int, int]]:
    """Where chains leave a range of an archive: the most common way out, and that of the places which have another."""
    raw.seek(lo)
    found = [lo + int(b) * BLOCK for b in headers(np.frombuffer(raw.read(hi - lo), np.uint8))]
    out: dict[int, int] = {}
    for p in found:
        if p in out:
            continue
        chain, end = [], END
        for at, ahead, _ in follow(raw, p):
            chain.append(at)
            end = ahead
            if ahead == END or ahead >= hi:
                break
            if ahead in out:
                end = out[ahead]
                break
        out.update(dict.fromkeys(chain or [p], end))
    usual = Counter(out.values()).most_common(1)[0][0] if out else END
    return usual, {p: e for p, e in out.items() if e != usual}


def _ranges(files: DataFrame, size: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long")))
    cut = files.select("path", "length", starts.alias("lo")).withColumn("hi", F.least(F.col("lo") + size, F.col("length")))
    return cut.repartition(files.sparkSession.sparkContext.defaultParallelism * 4).select("path", "lo", "hi")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def list_ranges(files: DataFrame, size: int = 64 << 20) -> DataFrame:
    """(ordinal, member, size) of plain tar files (path, length), each read in ranges of ``size`` bytes."""
    if size % BLOCK:
        raise ValueError(f"a range is a whole number of {BLOCK}-byte blocks")
    pair = pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))
    ways = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("usual", pa.int64()), ("others", pair)])
    entry = pa.schema([("path", pa.string()), ("at", pa.int64()), ("hi", pa.int64())])
    listed = pa.schema([("path", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("member", pa.string()), ("size", pa.int64()), ("is_file", pa.bool_())])

    def leave(batches):
        for b in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with opened(path) as raw:
                    usual, others = ways_out(raw, lo, hi)
                yield _batch([(path, lo, hi, usual, [{"at": p, "to": e} for p, e in others.items()])], ways)

    def enter(batches):
        now, at = None, 0
        for b in batches:
            rows = []
            for path, lo, hi, usual, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != now:
                    now, at = path, 0
                if lo <= at < hi:
                    rows.append((path, at, hi))
                    at = next((x["to"] for x in others if x["at"] == at), usual)
            yield _batch(rows, entry)

    def members(batches):
        for b in batches:
            for path, start, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                with opened(path) as raw:
                    for nth, (_, ahead, m) in enumerate(follow(raw, start)):
                        rows.append((path, start, nth, m.name, m.size, m.isfile()))
                        if len(rows) == 10_000:
                            yield _batch(rows, listed)
                            rows = []
                        if ahead >= hi:
                            break
                yield _batch(rows, listed)

    out = _ranges(files, size).mapInArrow(leave, "path string, lo long, hi long, usual long, others array<struct<at:long,to:long>>")
    entries = out.repartition("path").sortWithinPartitions("path", "lo").mapInArrow(enter, "path string, at long, hi long")
    rows = entries.repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(members, "path string, at long, nth long, member string, size long, is_file boolean")
    rows = rows.checkpoint() if files.sparkSession.sparkContext.getCheckpointDir() else rows
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n")).select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a range
    return rows.join(counts, ["path", "at"]).where("is_file").select((F.col("first") + F.col("nth")).alias("ordinal"), "member", "size")
