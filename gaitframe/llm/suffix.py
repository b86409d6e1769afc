"""Exact removal of repeated byte strings, by refining buckets of q-grams on later buckets.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else in
the corpus. The order of all suffixes is not needed for that, only which positions share
a bucket at depth ``width``. Bucket-pointer refinement finds those: a position's bucket
at depth h + s is its bucket at depth h together with the bucket, at depth h, of the
position s later (s at most h), so each round's buckets are the next round's keys
(``refine``: q, 2q, ... up to ``width``). A position that is alone in its bucket is done.

Not every position has to carry a bucket through Spark:

1. Of the ``q``-grams in each ``width``-byte window the one with the smallest hash is its
   anchor. Equal windows have equal anchors at equal places, so the first buckets are
   those of the anchors' q-grams (about one position in seventy).
2. An anchor's bucket is refined by what lies around it: the hull, which is all bytes of
   the windows that the anchor stands for. Anchors with the same refined bucket share
   all their windows; those are settled without looking at single positions.
3. From each refined bucket of a first bucket that did split, one anchor goes on with the
   bytes of its hull. All positions of these hulls carry buckets, which are refined by
   the buckets at later offsets. A first bucket with up to ``MEET`` kinds of hulls meets
   in one task. A larger one takes its last round in Spark: positions are counted by their
   bucket at depth width / 2 and that of the position width / 2 later.

Buckets are named and counted by 64-bit hashes, so a string that every document has is
nowhere a single large group; what many share goes back to its documents by joins with
written tables that Spark may broadcast or split. A text is named by its 64-bit hash, and
equal texts lose the same bytes.

Null text is empty. Matches never cross documents. Repeated rows are separate documents
(each covers the other). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.shared import Hashes, byte_slices, list_array, mix, settle, signed

ANCHORS = "text_key long, anchor long, hull long, first int, windows int"
#: Kinds of hulls of a bucket that meet in one task, each of under 2 * width bytes.
MEET = 4096
#: Parts that the anchors of a refined bucket are dealt over.
SALTS = 4
SLICE = 1 << 18
_LOW = np.uint64(0xFFFFFF)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by running minima of blocks to both sides."""
    n = len(key)
    m = -(-n // width) * width
    a = np.full(m, np.uint64(2**64 - 1))
    a[:n] = key
    a = a.reshape(-1, width)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, off: np.ndarray, width: int, q: int):
    """row, anchor hash, hull hash, first window, number of windows of each anchor of a run."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width or not (np.diff(off) >= width).any():
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    parts = []
    h = Hashes(data)
    grams = h.windows(q)
    ok_row = np.diff(off) >= width
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, off[:-1][ok_row], 1)
    np.add.at(inside, off[1:][ok_row] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    step = 1 << 23  # positions fit 24 bits
    for a in range(0, n - width + 1, step):
        b = min(n - width + 1, a + step)
        g = grams[a : b + width - q]
        key = (mix(g) & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        least = sliding_min(key, width - q + 1)
        mine = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
        parts.append((mine, a + (least[mine - a] & _LOW).astype(np.int64)))
    s, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(off, s, "right") - 1
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
    lo, hi, at = s[new], s[np.r_[new[1:], len(s)] - 1], p[new]
    hull = mix(h.of(lo, hi + width) + mix(((at - lo) * 65536 + (hi - lo)).astype(np.uint64)))
    return row[new], mix(grams[at]), hull, lo - off[row[new]], hi - lo + 1


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of ranges."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def _anchors(docs: DataFrame, width: int, q: int) -> DataFrame:
    def rows(batches):
        for b in batches:
            for lo, _, data, off in byte_slices(b.column(1), SLICE):
                row, anchor, hull, first, windows = anchors_of(data, off, width, q)
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array(signed(anchor)), pa.array(signed(hull)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))], ["text_key", "anchor", "hull", "first", "windows"])

    return docs.select("text_key", "text").mapInArrow(rows, ANCHORS)


def _hulls(docs: DataFrame, width: int) -> DataFrame:
    """The bytes of listed hulls: docs has text_key, text and asked (anchor, first, windows)."""
    schema = "anchor long, text_key long, first int, windows int, hull binary"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def rows(batches):
        for b in batches:
            keys, asked = b.column(0).to_pylist(), b.column(2)
            texts = b.column(1).cast(pa.large_binary())
            for at in range(0, b.num_rows, 64):
                out = []
                for i in range(at, min(at + 64, b.num_rows)):
                    raw = texts[i].as_py()
                    for x in asked[i].as_py():
                        out.append((x["anchor"], keys[i], x["first"], x["windows"], raw[x["first"] : x["first"] + x["windows"] - 1 + width]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "text_key", "first", "windows", "hull"])

    return docs.select("text_key", "text", "asked").mapInArrow(rows, schema)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers of equal keys, -1 for those that are alone or have a key of -1."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(order)])
    out = np.empty(len(order), np.int64)
    out[order] = np.where(np.repeat(size, size) > 1, np.repeat(np.arange(len(first)), size), -1)
    for k in keys:
        out[k < 0] = -1
    return out


def refine(bucket: np.ndarray, later: np.ndarray, q: int, width: int) -> np.ndarray:
    """Buckets at depth ``width`` from those at depth ``q``.

    Positions are numbered text after text; ``later`` is how many positions of the same text
    follow. A position without one to be refined by, or alone in its bucket, has -1.
    """
    h = q
    while h < width:
        step = min(h, width - h)
        ahead = np.full(len(bucket), -1, np.int64)
        can = np.flatnonzero((later >= step) & (bucket >= 0))
        ahead[can] = bucket[can + step]
        live = np.flatnonzero(ahead >= 0)
        finer = np.full(len(bucket), -1, np.int64)
        finer[live] = _rank(bucket[live], ahead[live])
        bucket, h = finer, h + step
    return bucket


def _positions(hulls: pa.RecordBatch, q: int):
    """For every q-gram of some hulls: the hull's number, the place in it, how many follow, its hash."""
    for lo, _, data, off in byte_slices(hulls.column(4), SLICE):
        count = np.diff(off) - q + 1
        each = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        yield lo + each, place, count[each] - 1 - place, mix(Hashes(data).windows(q)[off[each] + place])


RANGES = "text_key long, start int, end int"


def _meet(hulls: DataFrame, width: int, q: int) -> DataFrame:
    """Ranges that the repeated windows of each bucket's hulls cover; a bucket meets in one task."""

    def settled(held):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        hull, place, later, gram = (np.concatenate(x) for x in zip(*_positions(t, q), strict=True))
        anchor = np.unique(t.column(0).to_numpy(), return_inverse=True)[1]
        first = _rank(anchor[hull], (gram >> np.uint64(1)).astype(np.int64))
        again = np.flatnonzero(refine(first, later, q, width) >= 0)
        hull, place = hull[again], place[again]  # still by hull, then place
        if not len(hull):
            return None
        new = np.flatnonzero(np.r_[True, (hull[1:] != hull[:-1]) | (place[1:] != place[:-1] + 1)])
        last = np.r_[new[1:], len(hull)] - 1
        at = t.column(2).to_numpy()[hull[new]]
        return pa.RecordBatch.from_arrays([t.column(1).take(pa.array(hull[new])), pa.array((at + place[new]).astype(np.int32)), pa.array((at + place[last] + width).astype(np.int32))], ["text_key", "start", "end"])

    def rows(batches):
        held, size = [], 0
        for b in batches:
            keys = b.column(0).to_numpy()
            at = 0
            for cut in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1)[::50], b.num_rows]:
                if held and at < b.num_rows and size > 1 << 20 and keys[at] != held[-1].column(0)[-1].as_py():
                    if (out := settled(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(b.slice(at, cut - at))
                size += held[-1].nbytes
                at = cut
        if held and sum(len(x) for x in held) and (out := settled(held)) is not None:
            yield out

    return hulls.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(rows, RANGES)


def _last_round(hulls: DataFrame, width: int) -> DataFrame:
    """The same for buckets of any size: the last round, as counts over all positions of their hulls."""
    half = -(-width // 2)

    def rows(batches):
        for b in batches:
            if b.num_rows:
                for hull, place, later, bucket in _positions(b, half):
                    at = np.flatnonzero(later >= width - half)
                    keep = pa.array(hull[at])
                    start = (b.column(2).to_numpy()[hull[at]] + place[at]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array(signed(bucket[at])), pa.array(signed(bucket[at + width - half])), b.column(1).take(keep), pa.array(start)], ["anchor", "bucket", "later", "text_key", "start"])

    w = hulls.mapInArrow(rows, "anchor long, bucket long, later long, text_key long, start int")
    keys = ["anchor", "bucket", "later"]
    again = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # one query with the rest, so that the texts are shuffled once
    return w.join(again, keys, "left_semi").select("text_key", "start", (F.col("start") + width).cast("int").alias("end"))


def _cut(docs: DataFrame) -> DataFrame:
    """What is left of each document: docs has doc_id, text and ranges (null or start and end)."""

    def rows(batches):
        for b in batches:
            n = b.num_rows
            size, gone, runs, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            kept: list[tuple[list, list]] = [([], [])] * n
            ranges = b.column(2)
            for lo, hi, data, off in byte_slices(b.column(1), 1 << 20):
                raw = data.tobytes()
                for i in range(hi - lo):
                    text = raw[off[i] : off[i + 1]]
                    size[lo + i] = len(text)
                    r = ranges[lo + i].as_py() if ranges[lo + i].is_valid else None
                    if r:
                        s, e = merge(np.array([x["start"] for x in r]), np.array([x["end"] for x in r]))
                        gone[lo + i], runs[lo + i] = (e - s).sum(), len(s)
                        kept[lo + i] = (s.tolist(), e.tolist())
                        text = b"".join(text[a:z] for a, z in zip([0, *e], [*s, len(text)], strict=True))
                    digest[lo + i] = hashlib.sha256(text).hexdigest()
            counts = np.array([len(x[0]) for x in kept])
            lists = [list_array(np.array([v for x in kept for v in x[k]], np.int64), counts, pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (size, gone, runs)), pa.array(digest, pa.string()), *lists], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return docs.select("doc_id", "text", "ranges").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, width: int = 200, q: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the removed runs (starts, ends)."""
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    a = _anchors(laid, width, q)
    # written first, so that the join below has plain exchanges on both sides and Spark can split a common anchor
    seen = settle(a.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "seen")
    live = settle(a.join(seen, "anchor", "left_semi"), "anchors")
    hulls = live.groupBy("anchor", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "first", "windows")).alias("one"))
    # written first, like the counts of their kinds, for the joins below
    hulls = settle(hulls, "hulls")
    kinds = settle(hulls.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    # refined buckets of more than one anchor: all their windows repeat
    # salted, as a string that very many documents have is one of them; sorted and merged at every size
    again = hulls.where("n > 1").select("anchor", "hull", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = live.withColumn("salt", F.pmod(F.hash("text_key"), F.lit(SALTS)))
    whole = dealt.join(again.hint("merge"), ["anchor", "hull", "salt"], "left_semi")
    whole = whole.select("text_key", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + width).cast("int").alias("end"))
    # one anchor of each refined bucket of a bucket that split goes on with one document of its text
    ask = hulls.join(kinds.hint("merge"), "anchor").select(F.col("one.text_key").alias("text_key"), (F.col("kinds") > MEET).alias("large"), F.struct("anchor", "one.first", "one.windows").alias("x"))
    ask = settle(ask.groupBy("text_key", "large").agg(F.collect_list("x").alias("asked")), "asked")
    id_or_least = F.coalesce("doc_id", F.lit(-(2**63)))
    named = laid.groupBy("text_key").agg(F.min(id_or_least).alias("one_doc"))
    any_large = not ask.where("large").isEmpty()
    ask = ask.join(named, "text_key")
    # the texts are shuffled once: both joins by text_key read the same exchange
    asked = laid.join(ask, "text_key").where(id_or_least == F.col("one_doc"))
    ranges = whole.unionByName(_meet(_hulls(asked.where("NOT large"), width), width, q))
    if any_large:
        ranges = ranges.unionByName(_last_round(_hulls(asked.where("large"), width), width))
    ranges = ranges.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    out = _cut(laid.join(ranges, "text_key", "left"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends")
