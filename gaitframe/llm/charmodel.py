"""Kneser-Ney models of character n-grams, counted and smoothed by Spark.

Characters are the text's own code points (white space is one character, digits are one,
NUL is U+0001; letters in lower case if asked). Models have an ``order``; a text starts after order - 1 spaces.

1. ``count_ngrams``: how often each n-gram of ``order`` characters stands in the texts of a key.
2. ``levels``: shorter n-grams count the different characters that stand before them.
3. ``resolve``: discounts from counts of counts, back-off weights by context, and the
   interpolated probability of every n-gram that the texts to be scored hold, all by
   aggregates and joins on the n-gram. Nothing is capped: the tables follow the corpus.
4. ``Slices``: probabilities as sorted arrays of 64-bit hashes beside their values, in
   slices of at most SLICE bytes. One slice at a time reaches the driver and is broadcast;
   a model of several slices takes a pass over the texts for each, and sums. ``release``
   takes slices back from the executors once what used them is written.

Two n-grams with one hash would share a value (one chance in 2**64 a pair).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.shared import byte_slices, few, mix, settle, sums_by_row

ORDER = 4
#: Bytes of n-grams and values that are broadcast at once.
SLICE = 48 << 20
#: Distinct n-grams that a counting task holds before it gives them away.
HELD = 400_000
_CHUNK = 1 << 19
_MUL = np.random.default_rng(23).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _folding(lower: bool) -> np.ndarray:
    """Code points below 65,536 as the models see them."""
    t = np.arange(1 << 16, dtype=np.uint32)
    t[0] = 1
    t[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 32
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isdecimal():
            t[i] = 48
        elif lower and len(low := c.lower()) == 1:
            t[i] = ord(low)
    return t


def symbols(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of rows, and the rows' offsets among them."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
        length = sums_by_row((data & 0xC0) != 0x80, off)
    except UnicodeDecodeError:
        rows = [raw[a:z].decode("utf-8", "replace") for a, z in zip(off, off[1:], strict=False)]
        text, length = "".join(rows), np.array([len(x) for x in rows], np.int64)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _folding(lower)
    out = table[np.minimum(cp, 0xFFFF)]
    far = cp > 0xFFFF
    if far.any():
        out[far] = cp[far]
    chars = np.zeros(len(off), np.int64)
    np.cumsum(length, out=chars[1:])
    return out, chars


def grams(sym: np.ndarray, chars: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of places: the row of each place, the hash of the n-gram that ends there, and where it ends in the last array.

    The last array holds the texts' characters with order - 1 spaces before each text.
    """
    every = np.repeat(np.arange(len(chars) - 1), np.diff(chars))
    end = np.arange(len(sym)) + (order - 1) * (every + 1)
    laid = np.full(len(sym) + (order - 1) * (len(chars) - 1), 32, np.uint32)
    laid[end] = sym
    for a in range(0, len(sym), _CHUNK):
        z = min(len(sym), a + _CHUNK)
        lo, hi = end[a], end[z - 1] + 1
        code = laid[lo:hi] * _MUL[0]
        for k in range(1, order):
            code += laid[lo - k : hi - k] * _MUL[k]
        yield every[a:z], mix(code[end[a:z] - lo]), end[a:z], laid


class Index:
    """A sorted array of hashes, with the place where each leading bit pattern starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there (the place is 0 if not)."""
        if not len(self.keys):
            return np.zeros(len(code), np.int32), np.zeros(len(code), bool)
        head = (code >> self.shift).astype(np.int64)
        at = self.start[head]
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == code
        left = np.flatnonzero(~hit)
        place, stop = at[left], self.start[head[left] + 1]
        while len(left):
            place = place + 1
            go = place < stop
            left, place, stop = left[go], place[go], stop[go]
            same = self.keys[place] == code[left]
            at[left[same]] = place[same]
            hit[left[same]] = True
            left, place, stop = left[~same], place[~same], stop[~same]
        at[~hit] = 0
        return at, hit


def hashes_of(strings: pa.Array, order: int = ORDER) -> np.ndarray:
    """The same hashes for n-grams given as strings of ``order`` characters."""
    cp = np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, order)
    code = np.zeros(len(cp), np.uint64)
    for k in range(order):
        code += cp[:, order - 1 - k].astype(np.uint64) * _MUL[k]
    return mix(code)


def salt_of(key: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little"))


class _Counter:
    """Counts of one task: hashes in rising order, their counts, keys and characters."""

    def __init__(self, order: int):
        self.order = order
        self.clear()

    def clear(self) -> None:
        self.index, self.n = Index(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        self.key, self.cp = np.zeros(0, np.int32), np.zeros((0, self.order), "<u4")

    def add(self, sym: np.ndarray, chars: np.ndarray, keys: np.ndarray, salts: np.ndarray) -> None:
        for row, code, end, laid in grams(sym, chars, self.order):
            code = mix(code + salts[row])
            at, hit = self.index.find(code)
            if len(self.n):
                self.n += np.bincount(at[hit], minlength=len(self.n))
            new = np.flatnonzero(~hit)
            if not len(new):
                continue
            u, first, n = np.unique(code[new], return_index=True, return_counts=True)
            place = new[first]
            cp = np.stack([laid[end[place] - k] for k in range(self.order - 1, -1, -1)], 1).astype("<u4")
            every = np.concatenate([self.index.keys, u])
            order = np.argsort(every, kind="stable")
            self.index = Index(every[order])
            self.n = np.concatenate([self.n, n])[order]
            self.key = np.concatenate([self.key, keys[row[place]]])[order]
            self.cp = np.concatenate([self.cp, cp])[order]


def count_ngrams(docs: DataFrame, lower: bool = False, order: int = ORDER) -> DataFrame:
    """(key, gram, n) of docs (key, text), as a written table; texts of a null key count under a null key."""

    def count(batches):
        held, names = _Counter(order), {}

        def give():
            label = np.array(list(names), object)
            for at in range(0, len(held.n), 20_000):
                part = slice(at, at + 20_000)
                text = np.ascontiguousarray(held.cp[part]).view(f"<U{order}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(label[held.key[part]], pa.string()), pa.array(text, pa.string()), pa.array(held.n[part])], ["key", "gram", "n"])
            held.clear()
            names.clear()

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi, data, off in byte_slices(b.column(1)):
                mine = np.array([names.setdefault(k, len(names)) for k in keys[lo:hi]], np.int32)
                salts = np.array([salt_of("\x01" if k is None else "\x02" + k) for k in keys[lo:hi]], np.uint64)
                held.add(*symbols(data, off, lower), mine, salts)
                if len(held.n) > HELD:
                    yield from give()
        yield from give()

    rows = docs.select(F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counted = rows.mapInArrow(count, "key string, gram string, n long")
    return settle(counted.groupBy("key", "gram").agg(F.sum("n").alias("n")), "ngrams")


def levels(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, k, gram, n) of every length k: counts of n-grams of ``order``, and for shorter ones the number of characters before them."""
    full = counts.where("key IS NOT NULL")
    ends = [F.struct(F.lit(k).alias("k"), F.substring("gram", order - k + 1, k).alias("gram"), F.substring("gram", order - k, 1).alias("before")) for k in range(1, order)]
    less = full.select("key", F.explode(F.array(*ends)).alias("e")).select("key", "e.*").distinct()
    less = less.groupBy("key", "k", "gram").agg(F.count(F.lit(1)).alias("n"))
    return settle(full.select("key", F.lit(order).alias("k"), "gram", "n").unionByName(less), "levels")


def _discounts(lev: DataFrame, modified: bool, order: int) -> DataFrame:
    """(key, d): by length, what is taken from n-grams seen once, twice, and more often. One row a key."""
    c = [F.count_if(F.col("n") == i).cast("double") for i in range(1, 5)]
    d = lev.where("n <= 4").groupBy("key", "k").agg(*[x.alias(f"n{i}") for i, x in enumerate(c, 1)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def held(x: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    if modified:
        d1 = held(F.when(F.col("n1") > 0, 1 - 2 * y * F.try_divide("n2", "n1")).otherwise(0.5), 0.1, 0.95)
        d2 = held(F.when(F.col("n2") > 0, 2 - 3 * y * F.try_divide("n3", "n2")).otherwise(1.0), 0.1, 1.9)
        d3 = held(F.when(F.col("n3") > 0, 3 - 4 * y * F.try_divide("n4", "n3")).otherwise(1.5), 0.1, 2.9)
    else:
        d1 = d2 = d3 = held(y, 0.1, 0.9)
    d = d.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", F.array(d1, d2, d3)))).alias("d"))
    plain = F.array(*([F.lit(0.5), F.lit(1.0), F.lit(1.5)] if modified else [F.lit(0.5)] * 3))
    every = lev.select("key").distinct().join(d, "key", "left")
    return every.select("key", *[F.coalesce(F.col("d")[F.lit(k)], plain).alias(f"d{k}") for k in range(1, order + 1)])


def resolve(asked: DataFrame, lev: DataFrame, modified: bool, order: int = ORDER) -> DataFrame:
    """(key, gram, logp): the interpolated probability of the last character of each asked n-gram (key, gram).

    asked: distinct rows, as a written table. A key without a model gives every character
    the same probability.
    """
    d = few(_discounts(lev, modified, order))
    alphabet = max(lev.where("k = 1").select("gram").distinct().count(), 1) + 1
    below = None
    for k in range(1, order + 1):
        taken = F.col(f"d{k}")[F.least("n", F.lit(3)).cast("int") - 1]
        mine = lev.where(F.col("k") == k).join(d, "key").select("key", "gram", F.substring("gram", 1, k - 1).alias("context"), F.col("n").cast("double").alias("n"), taken.alias("taken"))
        context = mine.groupBy("key", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
        want = asked if k == order else asked.select("key", F.substring("gram", order - k + 1, k).alias("gram")).distinct()
        want = want.select("key", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        out = want.join(mine.select("key", "gram", (F.col("n") - F.col("taken")).alias("rest")), ["key", "gram"], "left").join(context, ["key", "context"], "left")
        if below is None:
            out = out.withColumn("p0", F.lit(1.0 / alphabet))
        else:
            out = out.join(below.select("key", F.col("gram").alias("suffix"), F.col("p").alias("p0")), ["key", "suffix"])
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("left") * F.col("p0")) / F.col("total"))
        below = out.select("key", "gram", p.alias("p"))
    return below.select("key", "gram", F.log("p").cast("float").alias("logp"))


class Slices:
    """Resolved n-grams as sorted hash arrays with ``width`` values each, slice by slice.

    table: (salt, gram, col, logp) with salt (a string, empty for none) and col below width.
    """

    def __init__(self, table: DataFrame, width: int, order: int = ORDER):
        def hashed(batches):
            for b in batches:
                if b.num_rows:
                    salts, which = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
                    add = np.array([salt_of(s) for s in salts], np.uint64)[which]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(hashes_of(b.column(1), order) + add).view(np.int64)), b.column(2), b.column(3)], ["code", "col", "logp"])

        self.width, self.shared = width, []
        self.table = settle(table.select("salt", "gram", "col", "logp").mapInArrow(hashed, "code long, col int, logp float"), "model")
        self.count = max(1, -(-self.table.count() * (8 // width + 4) // SLICE))

    def broadcast(self, i: int):
        """The i-th slice; SLICE bytes or little more, as hashes are even."""
        t = self.table.where(F.pmod("code", F.lit(self.count)) == i).toArrow()
        code = t.column("code").to_numpy().view(np.uint64)
        by = np.lexsort((t.column("col").to_numpy(), code))
        values = t.column("logp").to_numpy()[by].reshape(-1, self.width)
        self.shared.append(self.table.sparkSession.sparkContext.broadcast((Index(code[by][:: self.width].copy()), values)))
        return self.shared[-1]

    def release(self) -> None:
        for x in self.shared:
            x.unpersist()

    def over(self, docs: DataFrame, make: Callable, schema: str, sums: str) -> DataFrame:
        """``docs`` through ``make(slice, first)``, an Arrow function that gives the columns of ``schema``.

        With several slices the texts are written once with a row number ``rid``; the passes
        but the first give null for all columns but ``rid`` and ``sums`` (an array).
        """
        if self.count == 1:
            return docs.withColumn("rid", F.lit(None).cast("long")).mapInArrow(make(self.broadcast(0), True), "rid long, " + schema).drop("rid")
        laid = settle(docs.withColumn("rid", F.monotonically_increasing_id()), "laid")
        parts = [laid.mapInArrow(make(self.broadcast(i), i == 0), "rid long, " + schema) for i in range(self.count)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        names = [c for c in every.columns if c != "rid"]
        total = F.array(*[F.sum(F.col(sums)[j]) for j in range(self.width)])
        return every.groupBy("rid").agg(*[total.alias(c) if c == sums else F.any_value(c, True).alias(c) for c in names]).drop("rid")


def score(slice_: tuple[Index, np.ndarray], sym: np.ndarray, chars: np.ndarray, salts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Log probabilities that a slice gives to the rows of a run, a column a value."""
    index, values = slice_
    out = np.zeros((len(chars) - 1, values.shape[1]))
    for row, code, _, _ in grams(sym, chars, order):
        at, hit = index.find(mix(code + salts[row]))
        if not hit.all():
            at, row = at[hit], row[hit]
        for j in range(values.shape[1]):
            out[:, j] += np.bincount(row, values[at, j], minlength=len(out))
    return out
