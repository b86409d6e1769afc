"""Near-duplicates by b-bit MinHash over word shingles, confirmed on the full sets.

1. Every text gives its set of shingle hashes, 64 minima, 16 band keys of four minima,
   and a signature of the minima's four low bits packed into 32 bytes.
2. Equal sets are one class; one of its texts stands for it.
3. Classes that share a band key are candidates. In a bucket of up to MEET classes those
   whose signatures suggest a link are joined; a larger bucket is linked to its smallest
   member whatever the signatures say. The connected components of those links are
   candidate groups, and no link can lead out of one (but for pairs that share no band:
   1 in 100,000 at 0.85). Sharing a band alone joins nothing else, so texts that chain by
   shared passages do not grow into one group.
4. A group meets in one task, or, when it is large, in chunks that share four pivots.
   There signatures give a similarity by counting equal fields, less chance agreement;
   pairs far below the threshold go, the others are confirmed on the full sets. A pair
   that is already connected is not compared again.
5. In a large group, what is then outside its largest part is compared with all the rest
   of the group, chunk by chunk, so that no link between parts is lost.

Null and empty texts, and texts without words, have an empty set and link with nothing.
Fewer words than a shingle: the whole sequence is one shingle. A class is one node,
whatever ids its rows have: null ids and repeated ids link no texts. A component is named
by its smallest doc_id; where no row has one its name is null and the text with the
smallest key is kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.graph import components
from gaitframe.llm.shared import Hashes, byte_slices, list_array, lowered, mix, settle, signed, words_of

MINIMA, ROWS, BITS = 64, 4, 4
BANDS = MINIMA // ROWS
#: Members of a group that meet in one task, and members of a bucket whose signatures do.
CHUNK, MEET = 256, 2048
DIGEST = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, packed binary"
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64)
_NIBBLES = np.uint64(0x1111111111111111)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of rows, in rising order in each row, and their counts by row."""
    n = len(off) - 1
    low = lowered(data)
    start, end, row = words_of(low, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    wh = mix(Hashes(low).of(start, end) + (end - start).astype(np.uint64))
    per = np.bincount(row, minlength=n)
    k = max(len(wh) - words + 1, 0)
    v = np.zeros(k, np.uint64)
    for j in range(words):
        v = v * np.uint64(0x100000001B3) + wh[j : j + k]
    whole = row[:k] == row[len(row) - k :]
    sh, of = v[whole], row[:k][whole]
    short = np.flatnonzero((per > 0) & (per < words))
    if len(short):
        first = np.searchsorted(row, short)
        u = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            more = per[short] > j
            u[more] = u[more] * np.uint64(0x100000001B3) + wh[first[more] + j]
        sh, of = np.r_[sh, u + per[short].astype(np.uint64)], np.r_[of, short]
    sh = mix(sh)
    order = np.lexsort((sh, of))
    sh, of = sh[order], of[order]
    new = np.r_[True, (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])]
    return sh[new], np.bincount(of[new], minlength=n)


def digests(docs: DataFrame, words: int) -> DataFrame:
    """Set size, set hash, band keys and packed signature of every text."""

    def rows(batches):
        for b in batches:
            for lo, hi, data, off in byte_slices(b.column(2)):
                sets, counts = shingle_sets(data, off, words)
                n = hi - lo
                full = np.flatnonzero(counts)
                at = np.r_[0, np.cumsum(counts[full])[:-1]].astype(np.int64)
                keys = np.zeros((n, 2), np.uint64)
                minima = np.zeros((len(full), MINIMA), np.uint64)
                if len(full):
                    keys[full, 0] = np.add.reduceat(sets, at)
                    keys[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for i in range(MINIMA):
                        minima[:, i] = np.minimum.reduceat(sets * _MUL[i] + _ADD[i], at)
                bands = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + minima[:, r::ROWS]) + np.arange(1, BANDS + 1, dtype=np.uint64)
                nib = (minima & np.uint64(15)).astype(np.uint8)
                packed = nib[:, 0::2] | (nib[:, 1::2] << 4)
                sig = [None] * n
                for i, f in enumerate(full):
                    sig[f] = packed[i].tobytes()
                per = np.where(counts > 0, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(counts), pa.array(signed(keys[:, 0].copy())), pa.array(signed(keys[:, 1].copy())), list_array(signed(bands.ravel()), per, pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "packed"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, DIGEST)


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity that packed signatures suggest: share of equal fields, less the share by chance."""
    x = one ^ many
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES
    equal = 1 - np.bitwise_count(x).sum(-1) / MINIMA
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for arrays of distinct values."""
    c = np.sort(np.concatenate([a, b]))
    both = int((c[1:] == c[:-1]).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _link(ids, labels, packed, sets, left, right, percent, margin):
    """Confirmed links between ``left`` and ``right`` members that join different labels."""
    labels = labels.copy()
    size = np.array([len(s) for s in sets])
    for i in left:
        others = right[(labels[right] != labels[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        others = others[others != i]
        if not len(others):
            continue
        guess = agreement(packed[i], packed[others])
        near = guess >= percent / 100 - margin
        others, guess = others[near], guess[near]
        for j in others[np.argsort(-guess, kind="stable")]:
            if labels[j] != labels[i] and similar(sets[i], sets[j], percent):
                labels[labels == labels[j]] = labels[i]
                yield ids[i], ids[j]


def _compare(rows: DataFrame, words: int, percent: int, margin: float) -> DataFrame:
    """Links (a, b) from rows (block, side, id, label, packed, text), a block at a time.

    Sides: 0 meets 0; 1 meets 0 only.
    """

    def compare(batches):
        held: list[tuple] = []
        block = None

        def done():
            ids = np.array([r[1] for r in held])
            side = np.array([r[0] for r in held])
            packed = np.stack([np.frombuffer(r[3], np.uint64) for r in held])
            sets = []
            for _, _, data, off in byte_slices(pa.array([r[4] for r in held], pa.large_binary())):
                s, c = shingle_sets(data, off, words)
                sets += np.split(s, np.cumsum(c)[:-1])
            labels = np.unique(np.array([r[2] for r in held]), return_inverse=True)[1]
            zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = list(_link(ids, labels, packed, sets, one if len(one) else zero, zero, percent, margin))
            cols = list(zip(*found, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            texts = b.column(5).cast(pa.large_binary())
            for i, key in enumerate(cols[0]):
                if key != block:
                    if len(held) > 1:
                        yield done()
                    block, held = key, []
                held.append((cols[1][i], cols[2][i], cols[3][i], cols[4][i], texts[i].as_py()))
        if len(held) > 1:
            yield done()

    laid = rows.select("block", "side", "id", "label", "packed", "text").repartition("block").sortWithinPartitions("block", "side", "id")
    return laid.mapInArrow(compare, "a long, b long")


def classes_of(d: DataFrame) -> DataFrame:
    """One row per distinct set: its smallest doc_id (null if none has one), the key of that text, size, bands, signature."""
    top = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "bands", "packed")).alias("top")
    return d.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(top).select("set_a", "set_b", "n_shingles", "top.doc_id", "top.text_key", "top.bands", "top.packed")


def _suggested(rows: DataFrame, percent: int, margin: float) -> DataFrame:
    """Links (a, b) that join what the signatures of a bucket suggest: rows (key, id, n_shingles, packed)."""

    def chance(sig, size, i, j):
        near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        return near & (agreement(sig[i], sig[j]) >= percent / 100 - margin)

    def join(t):
        key, ids, size = (t.column(i).to_numpy() for i in range(3))
        sig = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[cut, len(key)])
        two = cut[count == 2]
        ok = two[chance(sig, size, two, two + 1)]
        a, b = [ids[ok]], [ids[ok + 1]]
        for at, n in zip(cut[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            label = np.arange(n)
            for i in range(n - 1):
                rest = np.flatnonzero(label != label[i])
                if not len(rest):
                    break
                rest = rest[rest > i]
                rest = rest[chance(sig, size, at + i, at + rest)]
                if len(rest):
                    label[np.isin(label, label[rest])] = label[i]
                    a.append(np.full(len(rest), ids[at + i])), b.append(ids[at + rest])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def links(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if last or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                whole = [*held, b.slice(0, last)] if last else held
                yield join(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
                held = []
            held.append(b.slice(last))
        if held:
            yield join(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    laid = rows.select("key", "id", "n_shingles", "packed").repartition("key").sortWithinPartitions("key", "id")
    return laid.mapInArrow(links, "a long, b long")


def _groups(classes: DataFrame, percent: int, margin: float) -> DataFrame:
    """(node, group) of the classes that may have a link."""
    banded = classes.select("id", F.explode("bands").alias("key"))
    # written first, so that Spark can split a large bucket in the join after it
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members"))
    heads = settle(heads.where("members > 1"), "heads")
    live = settle(banded.join(heads, "key"), "live")
    star = live.where((F.col("members") > MEET) & (F.col("id") != F.col("head"))).select(F.col("id").alias("a"), F.col("head").alias("b"))
    some = live.where(F.col("members") <= MEET).select("key", "id").join(classes.select("id", "n_shingles", "packed"), "id")
    return components(star.union(_suggested(some, percent, margin))).withColumnRenamed("root", "group")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, margin: float = 0.3) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every document."""
    d = settle(digests(docs, words), "minhash")
    # a class is a node by a number of its own, fixed by the written table; ids name the components at the end only
    classes = settle(classes_of(d).withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = settle(_groups(classes, percent, margin), "groups")
    no_id = F.lit(2**63 - 1)  # only to find a text: the key of the text is compared as well
    seeds = range(1, 5)
    pick = [F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), F.col("node").alias("id")))["id"] for s in seeds]
    sizes = settle(groups.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.array_distinct(F.array(*pick)).alias("pivots")), "sizes")
    members = classes.select("id", F.coalesce("doc_id", no_id).alias("of"), "text_key", "packed").join(groups.withColumnRenamed("node", "id"), "id").join(sizes, "group")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("of"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    full = settle(text.join(members, ["of", "text_key"]).dropDuplicates(["id"]).drop("of"), "members")
    chunks = F.ceil(F.col("members") / CHUNK)
    deal = F.pmod(F.xxhash64("id", F.lit(99)), chunks)
    pivot = (F.col("members") > CHUNK) & F.array_contains("pivots", F.col("id"))
    place = F.when(pivot, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(deal))
    first = full.withColumn("chunk", F.explode(place)).withColumn("block", F.xxhash64("group", "chunk"))
    links = settle(_compare(first.withColumns({"side": F.lit(0), "label": F.col("id")}), words, percent, margin), "links")
    # large groups: what is outside the largest part meets the whole group
    large = full.where(F.col("members") > CHUNK)
    if not large.isEmpty():
        part = components(links)
        large = large.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id"))
        large = settle(large.drop("root", "pivots"), "large")
        parts = large.groupBy("group", "label").count()
        main = parts.groupBy("group").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
        rest = large.join(main, "group").where("label <> main")
        count = rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n_rest"))
        left = rest.join(count, "group").withColumns({"r": F.pmod(F.xxhash64("id", F.lit(7)), F.col("n_rest")), "c": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)), "side": F.lit(1)})
        right = large.join(count, "group").withColumns({"c": deal, "r": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1)), "side": F.lit(0)})
        meet = left.select("group", "r", "c", "side", "id", "label", "packed", "text").unionByName(right.select("group", "r", "c", "side", "id", "label", "packed", "text"))
        more = _compare(meet.withColumn("block", F.xxhash64("group", "r", "c")), words, percent, margin)
        links = settle(links.union(more), "links")
    root = components(links).withColumnRenamed("node", "id").join(classes.select("id", "doc_id", "text_key"), "id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least")
    # written first, so that Spark can split a large component in the join after it
    least = settle(root.groupBy("root").agg(least).select("root", F.col("least.doc_id").alias("least_id"), F.col("least.text_key").alias("least_key")), "least")
    root = root.select("id", "root").join(least, "root").select("id", "least_id", "least_key")
    named = classes.select("set_a", "set_b", "n_shingles", "id", "doc_id", "text_key").join(root, "id", "left")
    named = named.select("set_a", "set_b", "n_shingles", F.coalesce("least_id", "doc_id").alias("component"), F.coalesce("least_key", "text_key").alias("key"))
    out = d.select("doc_id", "text_key", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    one = F.col("component").isNotNull() | F.col("key").isNull() | (F.col("text_key") == F.col("key"))
    return out.select("doc_id", "text_key", "n_shingles", comp.alias("component_id"), (F.col("doc_id").eqNullSafe(comp) & one).alias("kept"))
