"""The nearest other shot of every shot, exactly, without comparing all pairs.

1. Shots with one vector are one point, which keeps its two smallest ids: a shot with an
   equal one is answered at once, and copies are never compared with each other.
2. Points are dealt to the nearest of some pivots (points themselves, about six square
   roots of the points, at most ``MOST_PIVOTS``). A cell keeps the range of its distances
   to the pivot and the box around its points; large cells are cut into blocks by a hash.
3. A shot meets its own block first. The nearest found there, or the nearest pivot, is an
   upper bound: a cell that the triangle inequality or the box puts beyond it is skipped.
   Bounds are loosened by rounding errors, so that ties still go to the smaller id.

What is broadcast is one row of pivots and one of cells, both bounded by ``MOST_PIVOTS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.schema import METRIC_NAMES

#: Points that one block holds.
BLOCK = 512
MOST_PIVOTS = 2048
#: Parts that the shots of one vector are dealt over.
SALTS = 8
_EPS = 1e-9


def far(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, local where the session has no folder for it: what joins meet is one evaluation's values."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _points(shots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (v, one, two: the two smallest different ids), and the shots with their point's."""
    dealt = shots.withColumn("_salt", F.pmod(F.hash("shot_id"), F.lit(SALTS)))
    me = F.struct(F.col("shot_id").alias("id"), F.col("shot_type").alias("type"))
    firsts = shots.groupBy("v").agg(F.min(me).alias("one"))
    seconds = dealt.join(_salted(firsts), ["v", "_salt"]).where(F.col("shot_id") != F.col("one.id")).groupBy("v").agg(F.min(me).alias("two"))
    points = kept(firsts.join(seconds, "v", "left"))
    return points, dealt.join(_salted(points), ["v", "_salt"]).drop("_salt")


def _visits(points: DataFrame, asks: DataFrame, dims: int, block: int, most: int) -> DataFrame:
    """(shot_id, shot_type, best, compared): the best of each block that a shot meets."""
    n = points.count()
    k = max(1, min(most, int(6 * n**0.5) + 1))
    pivots = points.orderBy(F.xxhash64("one.id"), "v").limit(k).agg(F.sort_array(F.collect_list(F.struct("v", F.col("one.id").alias("one"), F.col("two.id").alias("two")))).alias("pivots"))

    def placed(df: DataFrame) -> DataFrame:
        d = df.join(F.broadcast(pivots)).withColumn("d", F.transform("pivots", lambda p: far(p["v"], F.col("v"))))  # one row
        return d.withColumn("near", F.array_min("d")).withColumn("cell", F.array_position("d", F.col("near")).cast("int") - 1)

    at = kept(placed(points).select("v", "one", "two", "near", "cell"))
    box = [F.array(*[f(F.col("v")[i]) for i in range(dims)]).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = at.groupBy("cell").agg(F.min("near").alias("inner"), F.max("near").alias("outer"), *box, F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    row = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "inner", "outer", "lo", "hi", "parts"))).alias("cells"))  # one row
    parts = F.broadcast(row.select(F.explode("cells").alias("c")).select("c.cell", "c.parts"))
    part = lambda name: F.pmod(F.xxhash64(name), F.col("parts")).cast("int")
    members = at.join(parts, "cell").groupBy("cell", part("one.id").alias("part")).agg(F.collect_list(F.struct("v", "one", "two")).alias("members"))

    # ids in a member may be the shot's own, where shots of different vectors share an id
    def best(q: str) -> Column:
        other = lambda m: F.when(m["one"]["id"] != F.col(q), m["one"]).otherwise(m["two"])
        found = F.transform("members", lambda m: F.when(m["v"] != F.col("v"), F.struct(far(m["v"], F.col("v")).alias("distance"), other(m)["id"].alias("id"), other(m)["type"].alias("type"))))
        return F.array_min(F.filter(found, lambda x: x["id"].isNotNull()))

    own = placed(asks).join(parts, "cell").select("shot_id", "shot_type", "v", "cell", part("shot_id").alias("part"))
    own = own.join(members, ["cell", "part"]).select("shot_id", "shot_type", "v", "cell", "part", best("shot_id").alias("best"), F.size("members").alias("compared"))
    again = own.join(F.broadcast(pivots)).join(F.broadcast(row)).withColumn("d", F.transform("pivots", lambda p: far(p["v"], F.col("v"))))  # one row each
    # a pivot of another vector is a neighbour too, unless its only id is the shot's
    other = F.filter("pivots", lambda p: (p["v"] != F.col("v")) & ((p["one"] != F.col("shot_id")) | p["two"].isNotNull()))
    bound = F.least("best.distance", F.array_min(F.transform(other, lambda p: far(p["v"], F.col("v")))))
    bound = F.coalesce(bound, F.lit(float("inf")))

    def beyond(c: Column) -> Column:
        d = F.get("d", c["cell"])
        gaps = F.zip_with(F.zip_with(c["lo"], F.col("v"), lambda lo, x: F.greatest(lo - x, F.lit(0.0))), F.zip_with(c["hi"], F.col("v"), lambda hi, x: F.greatest(x - hi, F.lit(0.0))), lambda a, b: a + b)
        outside = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))
        least = F.greatest(d - c["outer"], c["inner"] - d, outside)
        return least - _EPS * (least + d + c["outer"]) > F.col("bound")

    # the shot's own block is among them, and stands for what it gave: so the shots pass here once
    again = again.withColumn("bound", bound).select("shot_id", "shot_type", "v", F.col("best").alias("_best"), F.col("compared").alias("_compared"), F.col("part").alias("_part"), F.col("cell").alias("_own"), F.explode(F.filter("cells", lambda c: (c["cell"] == F.col("cell")) | ~beyond(c))).alias("c"))
    again = again.select("shot_id", "shot_type", "v", "_best", "_compared", "_part", "_own", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)).alias("part"))
    mine = (F.col("cell") == F.col("_own")) & (F.col("part") == F.col("_part"))
    met = again.join(members, ["cell", "part"])
    return met.select("shot_id", "shot_type", F.when(mine, F.col("_best")).otherwise(best("shot_id")).alias("best"), F.when(mine, F.col("_compared") + k).otherwise(F.size("members")).alias("compared"))


def nearest(points: DataFrame, columns: tuple[str, ...] = METRIC_NAMES, block: int = BLOCK, pivots: int = MOST_PIVOTS) -> DataFrame:
    """Every shot's nearest other shot by Euclidean distance, the smaller shot_id on ties, and how many points it was compared with."""
    have = [c for c in columns if c in points.columns]
    v = F.array(*[F.col(c).cast("double") + 0.0 for c in have]).cast("array<double>")
    # vectors are join keys: the last digits of one that is computed again may differ, and its shot would be lost
    shots = kept(points.where("shot_id IS NOT NULL").select("shot_id", "shot_type", v.alias("v")))
    known, shots = _points(shots)
    twin = F.when(F.col("one.id") != F.col("shot_id"), F.col("one")).otherwise(F.col("two"))
    shots = shots.select("shot_id", "shot_type", "v", twin.alias("twin"))
    equal = shots.where("twin IS NOT NULL").select("shot_id", "shot_type", F.struct(F.lit(0.0).alias("distance"), "twin.id", "twin.type").alias("best"), F.lit(0).alias("compared"))
    met = _visits(known, shots.where("twin IS NULL").drop("twin"), len(have), block, pivots)
    found = equal.unionByName(met).groupBy("shot_id", F.col("shot_type").alias("true_shot_type")).agg(F.min("best").alias("m"), F.sum("compared").alias("compared"))
    return found.where("m IS NOT NULL").select("shot_id", "true_shot_type", F.col("m.type").alias("predicted_shot_type"), F.col("m.id").alias("nearest_neighbor_shot_id"), F.col("m.distance").alias("distance"), "compared")
