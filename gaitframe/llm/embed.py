"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut into two halves. Each half has a codebook of
its own (k-means on a bounded sample of some ``SAMPLE`` distinct vectors); a vector's
two nearest codewords are its cell in the product grid. A query visits cells in the
order of the sum of its halves' distances to the cell's codewords (multi-sequence
order); how many follows from vectors at exactly the threshold's angle from the sample's:
so many that ``recall`` of them would be found. Vectors in visited cells are verified in
double precision. All vectors are indexed, and all are queries. Vectors of each dimension
have a grid of their own.

Equal vectors are one class and one node that counts its members, whatever ids its rows
have: rows that share a vec_id are separate vectors. n_links counts every member of every
linked class. A pair counts if either of the two visits the other. A component is named by
its smallest vec_id.

Vectors that are null, zero, empty, or hold null or non-finite components link with
nothing. A sound vector with a null id is linked like others and counts as a link; it
names no component, so a component of null ids only has a null name. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.graph import components
from gaitframe.llm.shared import few, mix, settle

#: Vectors that the codebooks are fitted on, about.
SAMPLE = 20_000
#: Members of a grid row that one task holds.
HELD = 4096
#: Codewords of a half, at most: a fifth of the sample's vectors each have one of their own.
MOST_WORDS = SAMPLE // 5
CELLED = "id long, n long, dim int, k int, v array<double>, i int, cell int, visits array<int>"
UNIT = "vec_id long, dim int, h1 long, h2 long, v array<double>"


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row, some rows at a time."""
    step = max(1, (1 << 22) // max(len(c), 1))
    return np.concatenate([_distances(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _near(x, c)
        order = np.argsort(near, kind="stable")
        u, first, n = np.unique(near[order], return_index=True, return_counts=True)
        c = c.copy()
        c[u] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


class Grid:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        half = max(sample.shape[1] // 2, 1)
        k = int(min(len(sample), MOST_WORDS, max(1, np.ceil(np.sqrt(n) / 4))))
        self.half, self.k = half, k
        self.books = [_kmeans(sample[:, :half], k, rng), _kmeans(sample[:, half:], k, rng) if sample.shape[1] > half else np.zeros((k, 0))]
        x = sample[rng.permutation(len(sample))[:2000]]
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(1)[:, None] * x
        other /= np.maximum(np.linalg.norm(other, axis=1), 1e-300)[:, None]
        y = threshold * x + np.sqrt(1 - threshold**2) * other
        home = [_near(p, b) for p, b in zip(self.halves(y), self.books, strict=True)]
        rank = np.zeros(len(x))
        for i in range(len(x)):
            d = [_distances(p[i : i + 1], b)[0] for p, b in zip(self.halves(x), self.books, strict=True)]
            reach = d[0][home[0][i]] + d[1][home[1][i]] + 1e-12
            rank[i] = np.searchsorted(np.sort(d[1]), reach - d[0], "right").sum()
        self.visits = int(np.quantile(rank, recall)) if len(rank) else 1
        self.visits = max(1, min(self.visits, k * k))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and the cells that it visits: the first of the multi-sequence order.

        The pair of the a-th and b-th nearest codewords can be among the first T only if
        (a + 1) * (b + 1) <= T, so only such pairs are summed.
        """
        t, k = self.visits, self.k
        d = [_distances(p, b) for p, b in zip(self.halves(x), self.books, strict=True)]
        order = [np.argsort(z, axis=1, kind="stable") for z in d]
        near = [np.take_along_axis(z, o, 1) for z, o in zip(d, order, strict=True)]
        a, b = np.meshgrid(np.arange(min(k, t)), np.arange(min(k, t)), indexing="ij")
        can = (a + 1) * (b + 1) <= t
        a, b = a[can], b[can]
        sums = near[0][:, a] + near[1][:, b]
        first = np.argpartition(sums, t - 1, axis=1)[:, :t] if t < sums.shape[1] else np.tile(np.arange(sums.shape[1]), (len(x), 1))
        cells = np.take_along_axis(order[0], a[first], 1) * k + np.take_along_axis(order[1], b[first], 1)
        return order[0][:, 0] * k + order[1][:, 0], cells


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(table: DataFrame) -> DataFrame:
    """Vectors of length one with two hashes (see UNIT); dim 0 and no vector for those that link with nothing."""
    mul = np.random.default_rng(31).integers(1, 2**63, (2, 1 << 12), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashed(x: np.ndarray, which: int) -> np.ndarray:
        out = np.full(len(x), x.shape[1], np.uint64)
        for at in range(0, x.shape[1], 1 << 12):
            part = mix(np.ascontiguousarray(x[:, at : at + (1 << 12)]).view(np.uint64) + np.uint64(which))
            out = mix(out + (part * mul[which, : part.shape[1]]).sum(1, dtype=np.uint64))
        return out

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids, lists = part.column(0), part.column(1)
                size = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                full = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                first = np.cumsum(full) - full
                dim, keys, unit = np.zeros(part.num_rows, np.int32), np.zeros((part.num_rows, 2), np.uint64), [None] * part.num_rows
                for d in np.unique(size[size > 0]):
                    r = np.flatnonzero(size == d)
                    x = flat[first[r][:, None] + np.arange(d)] + 0.0
                    top = np.abs(x).max(1)
                    good = np.isfinite(x).all(1) & (top > 0)
                    r, x = r[good], x[good] / top[good][:, None]  # so that squares neither over- nor underflow
                    x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0
                    dim[r] = d
                    for w in (0, 1):
                        keys[r, w] = hashed(x, w)
                    for i, v in zip(r, x, strict=True):
                        unit[i] = v
                yield pa.RecordBatch.from_arrays([ids, pa.array(dim), *(pa.array(keys[:, w].copy().view(np.int64)) for w in (0, 1)), pa.array(unit, pa.list_(pa.float64()))], ["vec_id", "dim", "h1", "h2", "v"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(rows, UNIT)


def _place(vectors: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(grids)  # at most 2 * MOST_WORDS codewords a dimension

    def rows(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                mine = b.take(pa.array(np.flatnonzero(dims == d)))
                grid = shared.value.get(int(d))
                for at in range(0, mine.num_rows, 512):
                    part = mine.slice(at, 512)
                    own, cells, k = np.zeros(part.num_rows, np.int64), np.zeros((part.num_rows, 1), np.int64), 1
                    if grid is not None:
                        (own, cells), k = grid.traverse(_matrix(part.column(3))), grid.k
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(np.sort(cells, 1).ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(part.num_rows, k, np.int32)), part.column(3), pa.array(own // k, pa.int32()), pa.array(own, pa.int32()), lists], ["id", "n", "dim", "k", "v", "i", "cell", "visits"])

    return vectors.select("id", "n", "dim", "v").mapInArrow(rows, CELLED)


def _joined(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids that connect what a block of links connects."""
    q, m = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(q):
        return []
    block, far = links[np.ix_(q, m)], np.int64(2**63 - 1)
    one, two = left[q].copy(), right[m].copy()
    while True:
        new = np.minimum(one, np.where(block, two[None, :], far).min(1))
        two2 = np.minimum(two, np.where(block, new[:, None], far).min(0))
        if (new == one).all() and (two2 == two).all():
            break
        one, two = new, two2
    return [(int(a), int(b)) for a, b in zip([*left[q], *right[m]], [*one, *two], strict=True) if a != b]


def _verify(laid: DataFrame, threshold: float) -> DataFrame:
    """Per task, (id, links found, null) and (id, null, id that it is connected with).

    laid: (block, side, id, n, v, cell, visits), a block's members (side 0) before its queries.
    A member has all cells that it visits; a query has those of the block's grid row.
    """

    def rows(batches):
        block, members, done = None, [], None

        def flush(counts, edges):
            ids = list(counts)
            pairs = sorted(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids + [p[0] for p in pairs], pa.int64()), pa.array([counts[i] for i in ids] + [None] * len(pairs), pa.int64()), pa.array([None] * len(ids) + [p[1] for p in pairs], pa.int64())],
                ["id", "links", "other"],
            )

        def meet(table, queries, counts, edges):
            ids, n, v, cells, visits, order = table
            qid = queries.column(2).to_numpy()
            qn, qv, qcell = queries.column(3).to_numpy(), _matrix(queries.column(4)), queries.column(5).to_numpy()
            asked = np.repeat(np.arange(queries.num_rows), pa.compute.list_value_length(queries.column(6)).to_numpy())
            want = queries.column(6).flatten().to_numpy()
            by_cell = np.argsort(want, kind="stable")
            want, asked = want[by_cell], asked[by_cell]
            for cell in np.unique(cells):
                lo, hi = np.searchsorted(cells, cell), np.searchsorted(cells, cell, "right")
                ask = asked[np.searchsorted(want, cell) : np.searchsorted(want, cell, "right")]
                if not len(ask):
                    continue
                link = (qv[ask] @ v[lo:hi].T >= threshold) & (qid[ask][:, None] != ids[lo:hi][None, :])
                if not link.any():
                    continue
                hit = np.flatnonzero(link.any(1))
                ask, link = ask[hit], link[hit]
                for x, c in zip(qid[ask], link @ n[lo:hi], strict=True):
                    counts[x] = counts.get(x, 0) + int(c)
                # members that do not visit the query's cell have not seen the pair themselves
                homes, which = np.unique(qcell[ask], return_inverse=True)
                seen = np.stack([(visits[lo:hi] == h).any(1) for h in homes])[which]
                for y, c in zip(ids[lo:hi], ((link & ~seen) * qn[ask][:, None]).sum(0), strict=True):
                    if c:
                        counts[y] = counts.get(y, 0) + int(c)
                edges.update(_joined(link, qid[ask], ids[lo:hi]))

        def table_of(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            b = t.to_batches()[0]
            order = np.argsort(b.column(5).to_numpy(), kind="stable")
            return tuple(x[order] for x in (b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4)), b.column(5).to_numpy(), _matrix(b.column(6)))) + (order,)

        counts, edges = {}, set()
        for b in batches:
            keys, sides = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])]) if len(keys) else []
            for at, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[at] != block:
                    block, members, done = keys[at], [], None
                    if counts or edges:
                        yield from flush(counts, edges)
                        counts, edges = {}, set()
                if sides[at] == 0:
                    members.append(b.slice(at, end - at))
                elif members:
                    done = done or table_of(members)
                    for q in range(at, end, 1024):
                        meet(done, b.slice(q, min(1024, end - q)), counts, edges)
        if counts or edges:
            yield from flush(counts, edges)

    return laid.mapInArrow(rows, "id long, links long, other long")


def near_vectors(table: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    units = _units(table)
    keyed = settle(units.drop("v"), "vectors")
    same = units.where("dim > 0").groupBy("dim", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    # a class is a node by a number of its own, fixed by the written table
    one = settle(same.withColumn("id", F.monotonically_increasing_id()), "distinct")
    grids = {}
    for r in one.groupBy("dim").count().where("count > 1").collect():  # a row a dimension
        mine = one.where(F.col("dim") == r["dim"]).where(F.pmod(F.xxhash64("h1"), F.lit(r["count"] // SAMPLE + 1)) == 0)
        sample = mine.select("v").toArrow().column(0).combine_chunks()
        if len(sample) > 1:
            grids[r["dim"]] = Grid(_matrix(sample), r["count"], threshold, recall)
    placed = settle(_place(one, grids), "cells")
    per_row = few(placed.groupBy("dim", "i").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("subs")))  # a row a codeword
    member = placed.join(per_row, ["dim", "i"]).withColumns({"sub": F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"), "side": F.lit(0)})
    row_of = F.transform("visits", lambda c: F.floor(c / F.col("k")).cast("int"))
    goes = placed.withColumn("i", F.explode(F.array_distinct(row_of)))
    goes = goes.withColumn("visits", F.filter("visits", lambda c: F.floor(c / F.col("k")) == F.col("i")))
    goes = goes.join(per_row, ["dim", "i"]).withColumns({"sub": F.explode(F.sequence(F.lit(0), F.col("subs") - 1)), "side": F.lit(1)})
    # 22 bits for the dimension, 14 for the row, 27 for the part of it
    block = F.shiftleft(F.col("dim").cast("long"), 41) + F.shiftleft(F.col("i").cast("long"), 27) + F.col("sub")
    cols = [block.alias("block"), "side", "id", "n", "v", "cell", "visits"]
    laid = member.select(*cols).unionByName(goes.select(*cols)).repartition("block").sortWithinPartitions("block", "side", "id")
    found = settle(_verify(laid, threshold), "found")
    links = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("far"))
    root = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    # written first, so that Spark can split a large component in the join after it
    name = settle(root.join(one.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("name")), "names")
    named = one.select("id", "dim", "h1", "h2", "n", "least").join(links, "id", "left").join(root.join(name, "root").drop("root"), "id", "left")
    named = named.select("dim", "h1", "h2", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("name"))
    out = keyed.join(settle(named, "named"), ["dim", "h1", "h2"], "left")
    comp = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))
