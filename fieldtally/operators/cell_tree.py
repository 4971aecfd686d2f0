"""Nearest points by a descent through two cell trees, one over the positions and one over the stations.

Space is a cube of 2^24 metres around the globe (no seam, no pole), split by eight along each axis from level
to level, down to cells of a metre. A tree has one row for each occupied cell of a level: how many points it
holds and the box around them. Pairs of a position cell and a station cell start at the deepest level where
one cell holds all stations. In each round the least of the greatest distances between a position cell's box
and its station cells' boxes bounds how far the nearest station of any position inside can be; station cells
that begin beyond it go. What is left is replaced by occupied children: a station cell is split until it
holds ``CAPACITY`` stations or fewer, a position cell until its station cells are small and few. Rounds end
when nothing is open, so their number follows the density of the data, not the size of the globe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.geo import EARTH_RADIUS_M, rounded_m
from fieldtally.session import written

CAPACITY = 16
BITS = 3            # a cell is split by 2 ** BITS along each axis
DEPTH = 8           # levels of cells; the cells of the last one are a metre wide
PARTS = 1024        # a crowded cell of the last level is split by a hash of its points
ROUNDING_M = 2.0    # distances are compared in whole metres, so a station this much farther can still tie
AXES = "xyz"
CELL = ["level", "cx", "cy", "cz", "part"]


def _space(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Points with their place in space and their finest cell; points without a place go."""
    known = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))
    phi, lam = F.radians(lat), F.radians(lon)
    placed = known.withColumns({"x": F.cos(phi) * F.cos(lam) * EARTH_RADIUS_M, "y": F.cos(phi) * F.sin(lam) * EARTH_RADIUS_M, "z": F.sin(phi) * EARTH_RADIUS_M})
    return placed.withColumns({f"f{a}": F.floor(F.col(a) + (1 << 23)).cast("bigint") for a in AXES})


def _at_level(level: Column, axis: str) -> Column:
    """Cell of a level along an axis; below the last level cells are no smaller, only their parts are."""
    return F.call_function("shiftright", F.col(f"f{axis}"), BITS * (DEPTH - F.least(level, F.lit(DEPTH))))


def _leveled(points: DataFrame, levels: list[int], lat: str, lon: str) -> DataFrame:
    """One row a point and level, with the cell's key."""
    rows = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    part = F.when(F.col("level") > DEPTH, F.pmod(F.xxhash64(lat, lon), F.lit(PARTS))).otherwise(0)
    return rows.withColumns({**{f"c{a}": _at_level(F.col("level"), a) for a in AXES}, "part": part})


def _cells(points: DataFrame, levels: list[int], lat: str, lon: str) -> DataFrame:
    """Occupied cells: key, number of points, and the box around them."""
    box = [f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("lo", F.min), ("hi", F.max))]
    return _leveled(points, levels, lat, lon).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *box)


SIDE = [*CELL, "n", *(f"{end}_{a}" for a in AXES for end in ("lo", "hi"))]
P_SIDE, S_SIDE = [f"p_{c}" for c in SIDE], [f"s_{c}" for c in (*SIDE, "leaf")]


def _renamed(cells: DataFrame, side: str, *more: str) -> DataFrame:
    return cells.selectExpr(*[f"{c} AS {side}_{c}" for c in (*SIDE, *more)])


def _up(side: str, child: bool) -> list[str]:
    """A cell's key as a parent, or a child's parent's; the parts of a cell of the last level have that cell as their parent."""
    return [f"if({side}_level > {DEPTH}, {side}_c{a}, shiftright({side}_c{a}, {BITS})) AS up_{a}" if child else f"{side}_c{a} AS up_{a}" for a in AXES]


def _judged(pairs: DataFrame, max_m: float | None, last: int) -> DataFrame:
    """Pairs that can still hold a nearest station, and whether their position cell is ``done``."""
    own = "OVER (PARTITION BY " + ", ".join(f"p_{c}" for c in CELL) + ")"
    gap = " + ".join(f"pow(greatest(0D, p_lo_{a} - s_hi_{a}, s_lo_{a} - p_hi_{a}), 2)" for a in AXES)
    span = " + ".join(f"pow(greatest(p_hi_{a} - s_lo_{a}, s_hi_{a} - p_lo_{a}), 2)" for a in AXES)
    # The pairs of a position cell are bounded: what a round leaves, times the children of a cell.
    near = pairs.selectExpr("*", f"sqrt({gap}) AS least", f"min(sqrt({span})) {own} AS bound")
    near = near.filter(f"least <= bound + {ROUNDING_M}" + ("" if max_m is None else f" AND least <= {max_m + ROUNDING_M}"))
    few = f"sum(s_n) {own} <= {4 * CAPACITY} OR p_n <= 1 OR p_level > max(s_level) {own} OR p_level >= {last}"
    return near.selectExpr(*P_SIDE, *S_SIDE, f"min(int(s_leaf)) {own} = 1 AND ({few}) AS done")


def _descended(still: DataFrame, tree: DataFrame, grounds: DataFrame, level: int, last: int) -> DataFrame:
    """Open pairs of a level, both cells replaced by their occupied children. A station cell that needn't be split
    stands in for its children, and so does a position cell at the last level."""
    below, up = F.col("level") == level + 1, [f"up_{a}" for a in AXES]
    children = _renamed(tree.filter(below), "s", "leaf").selectExpr(*S_SIDE, *_up("s", True))
    split = still.filter("NOT s_leaf").selectExpr(*P_SIDE, *_up("s", False)).join(children, up)
    pairs = split.select(*P_SIDE, *S_SIDE).union(still.filter("s_leaf").select(*P_SIDE, *S_SIDE))
    if level >= last:
        return pairs
    grown = _renamed(grounds.filter(below), "p").selectExpr(*P_SIDE, *_up("p", True))
    return pairs.selectExpr(*S_SIDE, *_up("p", False)).join(grown, up).select(*P_SIDE, *S_SIDE)


def candidates(positions: DataFrame, stations: DataFrame, max_m: float | None = None) -> DataFrame | None:
    """(lat, lon, near array<struct<lat, lon, station_id>>): rows that together hold every station that can be the nearest
    of a position, in groups of ``CAPACITY`` or so. ``positions`` and ``stations`` have distinct places; None without stations.
    """
    placed = _space(stations, "s_lat", "s_lon")
    every = list(range(DEPTH + 2))
    tree = written(_cells(placed, every, "s_lat", "s_lon").withColumn("leaf", (F.col("n") <= CAPACITY) | (F.col("level") > DEPTH)), "station-cells")
    # One row a level: how many cells, and whether any has to be split. Levels below the last split are of no use.
    levels = {r.level: r for r in tree.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.min(F.col("leaf").cast("int")).alias("leaf")).collect()}
    if not levels:
        return None
    deepest = min((k for k in every if levels[k].leaf), default=DEPTH + 1)
    top = min(max((k for k in every if levels[k].cells == 1), default=0), deepest, DEPTH)
    last = min(deepest + 1, DEPTH)
    spots = _space(positions, "lat", "lon")
    grounds = written(_cells(spots, list(range(top, last + 1)), "lat", "lon"), "position-cells")

    root = _renamed(tree.filter(F.col("level") == top), "s", "leaf").first()  # one cell holds all stations
    pairs = _renamed(grounds.filter(F.col("level") == top), "p").withColumns({c: F.lit(v) for c, v in root.asDict().items()})
    judged, level = _judged(pairs, max_m, last), top
    done, ended = [], set()
    while True:
        # Two levels a round: what the first one settles passes through the second.
        below = _judged(_descended(judged.filter("NOT done"), tree, grounds, level, last), max_m, last)
        judged = written(judged.filter("done").union(below), "cell-pairs")
        state = judged.groupBy("done").agg(F.collect_set("p_level").alias("levels")).collect()
        for found in state:
            if found["done"]:
                done.append(judged.filter("done"))
                ended.update(found["levels"])
        if all(found["done"] for found in state):
            break
        judged, level = _judged(_descended(judged.filter("NOT done"), tree, grounds, level + 1, last), max_m, last), level + 2
    if not done:
        return None
    settled = reduce(DataFrame.unionByName, done).select(*[f"p_{c}" for c in CELL], *[f"s_{c}" for c in CELL])
    # Stations meet the leaves that hold them, at the levels where leaves were reached.
    leaves = settled.select(*[F.col(f"s_{c}").alias(c) for c in CELL]).distinct()
    held = _leveled(placed, [k for k in every if top <= k <= deepest], "s_lat", "s_lon").join(leaves, CELL).groupBy(*CELL).agg(
        F.collect_list(F.struct(F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), F.col("n_station_id").alias("station_id"))).alias("near"))
    near = settled.join(held.select(*[F.col(c).alias(f"s_{c}") for c in CELL], "near"), [f"s_{c}" for c in CELL])
    at = _leveled(spots, sorted(ended), "lat", "lon").select("lat", "lon", *[F.col(c).alias(f"p_{c}") for c in CELL])
    return at.join(near, [f"p_{c}" for c in CELL]).select("lat", "lon", "near")


def nearest_places(positions: DataFrame, stations: DataFrame, max_m: float | None = None) -> DataFrame | None:
    """(lat, lon, best struct<d, station_id>) of each distinct position with a place: the least rounded distance, ties to the lowest id."""
    found = candidates(positions, stations, max_m)
    if found is None:
        return None
    # One row a station and position, reduced where it arises: plain columns stay in generated code, a fold over the array would not.
    pairs = found.select("lat", "lon", F.explode("near").alias("s"))
    best = pairs.groupBy("lat", "lon").agg(F.min(F.struct(rounded_m("lat", "lon", "s.lat", "s.lon").alias("d"), F.col("s.station_id").alias("station_id"))).alias("best"))
    return best if max_m is None else best.filter(F.col("best.d") <= max_m)
