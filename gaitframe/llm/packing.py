"""Best-fit packing of token sequences, planned over a histogram of lengths.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the input)
reaches the driver. Best-fit decreasing runs there over counts: all bins of the same
fill are one group, and a length takes whole groups at a time. Pieces then take the
planned slots by a join on their rank within their length.

A tokenizer whose normaliser and pattern never look across ASCII white space gives a text
the ids of its words in a row, so words are encoded once and looked up by 64-bit hash (two
words with one hash would share ids: one chance in 2**64 a pair). Any other tokenizer
encodes whole texts.

Null text is an empty document (one end token). Repeated rows and repeated ids are
separate documents. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.llm.charmodel import Index
from gaitframe.llm.shared import MOST_BROADCAST, SPACE, Hashes, byte_slices, lowered, mix, settle

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, spot long"
#: Words, and tokens of them, that a worker remembers before it starts afresh: some 60 MB.
REMEMBER, REMEMBER_IDS = 1_200_000, 8_000_000
#: The normaliser and the pattern of tokenizers whose words can be looked up.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_state: dict[str, object] = {}


def by_words(path: str) -> bool:
    """Whether a tokenizer file lower-cases and splits as NORMALIZER and PATTERN say."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    added = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not any(map(str.isspace, t["content"])) for t in spec.get("added_tokens") or [])
    plain = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
    return added and plain and spec.get("normalizer") == {"type": "Sequence", "normalizers": NORMALIZER} and spec.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [split, level]}


def word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes to encode, and start, end and row of each word in them.

    A-Z are in lower case and a full stop or comma after a letter and before white space is a
    word of its own, but for rows with ``<|``, where special tokens would appear.
    """
    n = len(data)
    low = lowered(data)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    plain = np.ones(n, bool)
    if len(special):
        marked = np.zeros(len(off) - 1, bool)
        marked[row_of[special]] = True
        plain = ~marked[row_of]
        low = np.where(plain, low, data)
    solid = ~SPACE[data]
    same = np.r_[False, row_of[1:] == row_of[:-1]]
    before = np.r_[False, solid[:-1]] & same
    split = np.zeros(n, bool)
    dot = np.flatnonzero(((low == 44) | (low == 46)) & plain)
    dot = dot[(dot > 0) & (dot < n - 1)]
    dot = dot[(low[dot - 1] >= 97) & (low[dot - 1] <= 122) & same[dot] & same[dot + 1] & SPACE[data[dot + 1]]]
    split[dot] = True
    start = np.flatnonzero(solid & (~before | split))
    # a word ends where the next starts, or where white space or the row's end comes first
    stop = np.flatnonzero(np.r_[before & (~solid | split) | ~same & np.r_[False, solid[:-1]], n > 0 and solid[-1]])
    return low, start, stop, row_of[start]


class _Words:
    """Token ids of words, by hash; the first entry of ``ids`` is the end token."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(path)
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.index = Index(np.zeros(0, np.uint64))
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.array([self.end_id], "<u4")

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        alone = [i for i, w in enumerate(words) if b"|" in w or len(w) > 1000]
        skip = set(alone)
        rest = [i for i in range(len(words)) if i not in skip]
        # many words in a text, with bars between them: cheaper than a text a word
        parts = [rest[at : at + 512] for at in range(0, len(rest), 512)]
        texts = [b" | ".join([words[i] for i in p]).decode("utf-8", "replace") for p in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else [], strict=True):
            ids = np.array(got.ids, "<u4")
            cut = np.flatnonzero(ids == self.bar[0]) if len(self.bar) == 1 else np.zeros(0, np.int64)
            if len(cut) != len(part) - 1:
                alone += part
                continue
            for i, a, z in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                out[i] = ids[a:z]
        for i in alone:
            out[i] = np.array(self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of rows, each with its end token, and the number of each row's ids."""
        rows = len(off) - 1
        if not self.by_words:
            raw = data.tobytes()
            got = self.tokenizer.encode_batch_fast([raw[a:z].decode("utf-8", "replace") for a, z in zip(off, off[1:], strict=False)], add_special_tokens=False)
            parts = [np.array([*g.ids, self.end_id], "<u4") for g in got]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        low, start, stop, row = word_places(data, off)
        h = mix(Hashes(low).of(start, stop) + (stop - start).astype(np.uint64))
        at, hit = self.index.find(h)
        if not hit.all():
            if len(self.index.keys) > REMEMBER or len(self.ids) > REMEMBER_IDS:
                self.clear()
                hit[:] = False
            new = np.flatnonzero(~hit)
            u, first = np.unique(h[new], return_index=True)
            raw = low.tobytes()
            got = self.encode([raw[a:z] for a, z in zip(start[new[first]].tolist(), stop[new[first]].tolist(), strict=True)])
            size = np.array([len(g) for g in got], np.int64)
            every = np.concatenate([self.index.keys, u])
            order = np.argsort(every, kind="stable")
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, *got])
            self.index = Index(every[order])
            at, _ = self.index.find(h)
        # after the words of each row comes the end token
        ends = np.searchsorted(row, np.arange(rows), "right")
        first = np.insert(self.first[at], ends, 0)
        size = np.insert(self.size[at], ends, 1)
        whose = np.insert(row, ends, np.arange(rows))
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(first - before, size) + np.arange(size.sum())]
        return ids, np.bincount(whose, size, minlength=rows).astype(np.int64)


def _known(path: str, end_id: int) -> _Words:
    if _state.get("of") != (path, end_id):
        _state.update(of=(path, end_id), words=_Words(path, end_id))
    return _state["words"]  # type: ignore[return-value]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, and a number of its own."""

    def cut(batches):
        known = _known(tokenizer_path, end_id)
        task, given = TaskContext.get().partitionId(), 0
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for lo, _, data, off in byte_slices(b.column(1), 1 << 20):
                ids, n = known.texts(data, off)
                raw, per = memoryview(ids.tobytes()), -(-n // capacity)
                row = np.repeat(np.arange(len(n)), per)
                k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                size = np.minimum(n[row] - k * capacity, capacity)
                at = (np.repeat(np.cumsum(n) - n, per) + k * capacity) * 4
                crc += [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
                doc.append(b.column(0).take(pa.array(lo + row)))
                piece.append(k), start.append(k * capacity), length.append(size)
            if doc:
                spot = mix(np.arange(given, given + len(crc), dtype=np.uint64) + (np.uint64(task) << np.uint64(40)))
                given += len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(doc), pa.array(np.concatenate(piece).astype(np.int32)), pa.array(np.concatenate(start)), pa.array(np.concatenate(length).astype(np.int32)), pa.array(crc, pa.int64()), pa.array(spot.view(np.int64))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "spot"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Gives (length, first rank, end rank, first bin, pieces per bin, first offset): the
    piece of that length and of rank r goes to bin ``first bin + (r - first rank) //
    per`` at ``first offset + (r - first rank) % per * length``. Bins of equal free
    space form lists of consecutive numbers. Each length uses up every group that it
    enters but the last, so the plan's size depends on the lengths, not on the counts.
    """
    free: list[int] = []  # sorted free spaces that groups have
    groups: dict[int, list[tuple[int, int]]] = {}  # free space: (first bin, bins)
    plan, bins = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in groups:
                bisect.insort(free, space)
                groups[space] = []
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(at)
            else:
                space, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            per = space // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - space))
                rank, left = rank + full * per, left - full * per
                put(space - per * length, first, full)
            if full < n and left:
                plan.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                full, left = full + 1, 0
            put(space, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (see PIECES).

    A piece's place in its bucket follows from its own number, so repeated rows spread too.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    plan = plan_slots({r["length"]: r["count"] for r in rows}, capacity)
    total = sum(r["count"] for r in rows)
    buckets = max(64, total // 200_000)
    dealt = pieces.withColumn("bucket", F.pmod("spot", F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").count()
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("spot")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("nth") - 1)
    slots = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 1, 0)],
        "length int, first_rank long, end_rank long, first_bin long, per long, first_offset long",
    )
    # the plan grows with the number of lengths, not with the documents; groups split by binary parts of counts add to it
    slots = slots.withColumnRenamed("length", "slot_length")
    p = F.broadcast(slots) if len(plan) <= MOST_BROADCAST else slots
    at = F.col("rank") - F.col("first_rank")
    joined = ranked.join(p, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return joined.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_bin") + F.expr("(rank - first_rank) div per")).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(settle(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
