"""Density clusters in the plane, with noise.

A point is core when at least ``min_points`` points, itself included, lie
within ``eps``. Core points within ``eps`` of each other share a cluster;
everything else, and every cluster under ``min_cluster_size`` points, is noise.
This is the level ``eps`` of the density hierarchy of Campello et al. (2013),
found exactly without comparing all points of a crowded spot:

* the plane is cut into cells whose diagonal is ``eps``, so a cell's points are
  all neighbours, and a cell of ``min_points`` points is core throughout;
* only the points of thinner cells look for neighbours, each cell having less
  than ``min_points`` of them;
* whether two cells touch is settled on bounding boxes, split again and again
  only where the boxes leave it open, and on the points of small boxes;
* clusters are connected components of cells, not of points.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.operators.ids import assign_dense_id
from segmill.operators.skew import SLICES, is_hot, join_totals
from segmill.session import materialize

NOISE = -1
# Other cells that can hold a point within eps of a point of cell (0, 0).
NEAR_CELLS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if 0 < abs(dx) + abs(dy) < 4]
# One of each pair of opposite directions.
FORWARD_CELLS = [(dx, dy) for dx, dy in NEAR_CELLS if (dx, dy) > (0, 0)]
# A slice of a hot cell has at least this many points.
SLICE_POINTS = 10_000
# A box is cut into SPLIT x SPLIT smaller ones per round.
SPLIT = 4
# Open pairs of boxes with no more pairs of places than this are compared place by place.
COMPARED = 4096


def _with_cells(points: DataFrame, eps: float) -> DataFrame:
    side = eps / sqrt(2)
    return points.select(
        "id_client",
        "x",
        "y",
        F.floor(F.col("x") / side).alias("cx"),
        F.floor(F.col("y") / side).alias("cy"),
    )


def _shifted(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(
        F.array(*[F.struct((F.col("cx") + dx).alias("tx"), (F.col("cy") + dy).alias("ty")) for dx, dy in offsets])
    )


def density_core_points(
    points: DataFrame, eps: float, min_points: int = 10, slice_points: int = SLICE_POINTS
) -> DataFrame:
    """``id_client, x, y, cx, cy, is_core`` from stored ``id_client, x, y``.

    A hot cell is searched in slices of at least ``slice_points`` points.
    """
    n_points = points.count()
    placed = _with_cells(points, eps)
    cells = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    counted = materialize(join_totals(placed, cells, ["cx", "cy"], ["n"], n_rows=n_points), "cells")

    crowded = counted.where(F.col("n") >= min_points)
    thin = counted.where(F.col("n") < min_points)
    # The points of a hot cell are cut into slices, each about 1/SLICES of all
    # points, and a probe goes to each slice: at most 2 * SLICES slices in all.
    per_slice = max(slice_points, -(-n_points // SLICES))
    slices = F.ceil(F.col("n") / per_slice).cast("int").alias("_slices")
    hot = F.broadcast(
        cells.where(is_hot(F.lit(n_points)) & (F.col("n") > per_slice)).select(
            F.col("cx").alias("tx"), F.col("cy").alias("ty"), slices
        )
    )
    targets = (
        counted.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("id_client").alias("_q"))
        .join(hot, ["tx", "ty"], "left")
        .withColumn("slice", F.pmod(F.xxhash64("_q"), F.coalesce("_slices", F.lit(1))).cast("int"))
        .drop("_q", "_slices")
    )
    probes = (
        thin.select("id_client", "x", "y", _shifted(NEAR_CELLS).alias("t"))
        .select("id_client", "x", "y", "t.tx", "t.ty")
        .join(hot, ["tx", "ty"], "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    found = (
        probes.join(targets, ["tx", "ty", "slice"])
        .where(dx * dx + dy * dy <= eps * eps)
        .groupBy("id_client")
        .agg(F.count("*").alias("found"))
    )
    columns = ["id_client", "x", "y", "cx", "cy"]
    # the points of its own cell are all neighbours
    enough = F.col("n") + F.coalesce("found", F.lit(0)) >= min_points
    searched = thin.join(found, "id_client", "left").select(*columns, enough.alias("is_core"))
    return crowded.select(*columns, F.lit(True).alias("is_core")).unionAll(searched)


def _with_sub_cells(places: DataFrame, side: float, level: int) -> DataFrame:
    """Places with the index of their sub-cell, ``level`` splits below the cell."""
    steps = SPLIT**level
    return places.withColumns(
        {f"s{c}": F.floor((F.col(c) / side - F.col(f"c{c}")) * steps) for c in "xy"}
    )


def _boxes(placed: DataFrame) -> DataFrame:
    """Bounding box and number of the places in each sub-cell."""
    return placed.groupBy("cx", "cy", "sx", "sy").agg(
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.count("*").alias("n"),
    )


def _box_state(eps: float) -> Column:
    """True: some pair is within eps; False: none is; null: not settled by the boxes."""

    def gap(low_a, high_a, low_b, high_b):
        return F.greatest(F.lit(0.0), F.col(low_b) - F.col(high_a), F.col(low_a) - F.col(high_b))

    def span(low_a, high_a, low_b, high_b):
        return F.greatest(F.col(high_b) - F.col(low_a), F.col(high_a) - F.col(low_b))

    x, y = ("a_x0", "a_x1", "b_x0", "b_x1"), ("a_y0", "a_y1", "b_y0", "b_y1")
    nearest = gap(*x) * gap(*x) + gap(*y) * gap(*y)
    farthest = span(*x) * span(*x) + span(*y) * span(*y)
    return F.when(farthest <= eps * eps, True).when(nearest > eps * eps, False)


PAIR = ["a_cx", "a_cy", "b_cx", "b_cy"]
BOX = ["cx", "cy", "sx", "sy"]


def _prefixed(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select([F.col(c).alias(prefix + c) for c in boxes.columns])


def _cells_of(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The cells or boxes on either side of some pairs."""
    sides = [pairs.select(*[F.col(f"{side}_{c}").alias(c) for c in columns]) for side in "ab"]
    return sides[0].unionAll(sides[1]).distinct()


def _compared(placed: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Those of some pairs of small boxes that have places within ``eps`` of each other."""
    wanted = placed.join(_cells_of(pairs, BOX), BOX, "left_semi")
    keys = {side: [f"{side}_{c}" for c in BOX] for side in "ab"}
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return (
        pairs.select(*keys["a"], *keys["b"])
        .join(_prefixed(wanted, "a_"), keys["a"])
        .join(_prefixed(wanted, "b_"), keys["b"])
        .where(dx * dx + dy * dy <= eps * eps)
        .select(*PAIR)
    )


def _touching_cells(core: DataFrame, eps: float) -> DataFrame:
    """Pairs of different cells with core points within ``eps`` of each other.

    Places that no split tells apart are few, so in the end every pair of boxes is
    settled or small.
    """
    side = eps / sqrt(2)
    state = _box_state(eps)
    small = F.col("a_n") * F.col("b_n") <= COMPARED
    # copies settle nothing
    places = materialize(core.select("cx", "cy", "x", "y").distinct(), "places")
    placed = _with_sub_cells(places, side, 0)
    boxes = _boxes(placed)
    near = boxes.select("*", _shifted(FORWARD_CELLS).alias("t")).select(
        *[F.col(c).alias(f"a_{c}") for c in boxes.columns],
        F.col("t.tx").alias("b_cx"),
        F.col("t.ty").alias("b_cy"),
    )
    pairs = near.join(_prefixed(boxes, "b_"), ["b_cx", "b_cy"])
    touching, level = [], 0
    while True:
        settled = materialize(pairs.withColumn("state", state).where(F.coalesce("state", F.lit(True))), "pairs")
        still_open = settled.where("state is null")
        compared = _compared(placed, still_open.where(small), eps)
        found = materialize(settled.where("state").select(*PAIR).unionAll(compared).distinct(), "touching")
        touching.append(found)
        still_open = still_open.where(~small).join(found, PAIR, "left_anti")
        if still_open.isEmpty():
            return reduce(DataFrame.unionAll, touching).distinct()
        level += 1
        # only the cells of open pairs are split further; every child carries its parent's index
        open_places = places.join(_cells_of(still_open, ["cx", "cy"]), ["cx", "cy"], "left_semi")
        placed = _with_sub_cells(open_places, side, level)
        children = _boxes(placed).withColumns({f"p{c}": F.floor(F.col(f"s{c}") / SPLIT) for c in "xy"})
        parents = still_open.select(
            *PAIR,
            *[F.col(f"{s}_s{axis}").alias(f"{s}_p{axis}") for s in "ab" for axis in "xy"],
        )
        pairs = parents.join(_prefixed(children, "a_"), ["a_cx", "a_cy", "a_px", "a_py"]).join(
            _prefixed(children, "b_"), ["b_cx", "b_cy", "b_px", "b_py"]
        )


def _weighed_boxes(placed: DataFrame) -> DataFrame:
    """Bounding box, places and points of each sub-cell; ``m`` points share a place."""
    return placed.groupBy(*BOX).agg(
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.count("*").alias("places"),
        F.sum("m").alias("n"),
    )


def neighbour_counts(points: DataFrame, eps: float) -> DataFrame:
    """``id_client, x, y, neighbours``: how many points, itself included, lie within ``eps`` of each.

    Pairs of boxes are settled from the cells down. Where even the farthest corners of two
    boxes lie within ``eps``, the points of one count for the other as a number; where the
    nearest do not, they don't count at all. Only what the circle's border cuts is split
    further, and compared place by place once it is small, so a crowded cell costs its
    border and not its square. Points at one place are one place with their number.
    """
    side = eps / sqrt(2)
    state = _box_state(eps)
    small = F.col("a_places") * F.col("b_places") <= COMPARED
    placed_points = materialize(_with_cells(points, eps), "points")
    place = ["cx", "cy", "x", "y"]
    places = materialize(placed_points.groupBy(*place).agg(F.count("*").alias("m")), "places")
    n_places = places.count()

    placed = _with_sub_cells(places, side, 0)
    boxes = _weighed_boxes(placed)
    near = boxes.select("*", _shifted([(0, 0), *NEAR_CELLS]).alias("t")).select(
        *[F.col(c).alias(f"a_{c}") for c in boxes.columns],
        F.col("t.tx").alias("b_cx"),
        F.col("t.ty").alias("b_cy"),
    )
    pairs = near.join(_prefixed(boxes, "b_"), ["b_cx", "b_cy"])
    counted, level = [], 0
    while True:
        settled = materialize(pairs.withColumn("state", state).where(F.coalesce("state", F.lit(True))), "pairs")
        whole = settled.where("state").groupBy(*[F.col(f"a_{c}").alias(c) for c in BOX])
        whole = whole.agg(F.sum("b_n").alias("more"), F.max("a_places").alias("n"))
        more = join_totals(placed, whole, BOX, ["more"], n_rows=n_places)
        counted.append(more.where("more is not null").select(*place, "more"))
        still_open = settled.where("state is null")
        counted.append(_counted_pairs(placed, still_open.where(small), eps))
        still_open = still_open.where(~small)
        if still_open.isEmpty():
            break
        level += 1
        open_places = places.join(_cells_of(still_open, ["cx", "cy"]), ["cx", "cy"], "left_semi")
        placed = _with_sub_cells(open_places, side, level)
        children = _weighed_boxes(placed).withColumns({f"p{c}": F.floor(F.col(f"s{c}") / SPLIT) for c in "xy"})
        parents = still_open.select(
            *PAIR, *[F.col(f"{s}_s{axis}").alias(f"{s}_p{axis}") for s in "ab" for axis in "xy"]
        )
        pairs = parents.join(_prefixed(children, "a_"), ["a_cx", "a_cy", "a_px", "a_py"]).join(
            _prefixed(children, "b_"), ["b_cx", "b_cy", "b_px", "b_py"]
        )
    totals = reduce(DataFrame.unionAll, counted).groupBy(*place).agg(F.sum("more").alias("neighbours"))
    totals = materialize(totals.join(places.withColumnRenamed("m", "n"), place), "neighbours")
    found = join_totals(placed_points, totals, place, ["neighbours"], n_rows=placed_points.count())
    return found.select("id_client", "x", "y", "neighbours")


def _counted_pairs(placed: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Per place of small boxes: the points within ``eps`` of it in the boxes they are paired with."""
    wanted = placed.join(_cells_of(pairs, BOX), BOX, "left_semi")
    keys = {side: [f"{side}_{c}" for c in BOX] for side in "ab"}
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return (
        pairs.select(*keys["a"], *keys["b"])
        .join(_prefixed(wanted, "a_"), keys["a"])
        .join(_prefixed(wanted, "b_"), keys["b"])
        .where(dx * dx + dy * dy <= eps * eps)
        .groupBy(*[F.col(f"a_{c}").alias(c) for c in ("cx", "cy", "x", "y")])
        .agg(F.sum("b_m").alias("more"))
    )


def density_neighbours(points: DataFrame, eps: float, min_points: int = 10) -> DataFrame:
    """``id_client, x, y, neighbours, is_core`` of every point, the count exact."""
    return neighbour_counts(points, eps).withColumn("is_core", F.col("neighbours") >= min_points)


# A point's cell holds this many times k places on average when the search begins.
SEARCHED = 8


def k_distances(points: DataFrame, k: int, slice_points: int = SLICE_POINTS) -> DataFrame:
    """``id_client, x, y, k_distance``: how far the ``k``-th nearest point is, itself counted as the first.

    Rings of cells grow around what is still open: all places within a cell's width lie in
    the ring of cells around it, so a place that finds ``k`` points within that width is
    done, and the others look again in cells twice as wide. The search begins with cells
    that hold some ``k`` places for most points. A cell with very many places is searched
    in slices, and of what a place finds only ``k`` go on. Null where there are under ``k`` points.
    """
    stored = materialize(points.select("id_client", "x", "y"), "points")
    places = materialize(stored.groupBy("x", "y").agg(F.count("*").alias("m")), "places")
    ends = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum("m"), F.count("*")).first()
    n_points, n_places = ends[4] or 0, ends[5]
    # with a place for each k points and no others, distances are zero
    done = [places.where(F.col("m") >= k).select("x", "y", F.lit(0.0).alias("k_distance"))]
    pending = places.where(F.col("m") < k)
    if n_points < k:
        done, pending = [places.select("x", "y", F.lit(None).cast("double").alias("k_distance"))], pending.limit(0)
    width = max(ends[1] - ends[0], ends[3] - ends[2]) or 1.0 if n_points else 1.0
    side = _first_side(places, width, k)
    per_slice = max(slice_points, -(-n_places // SLICES))
    nearest = Window.partitionBy("x", "y").orderBy("d2", "qx", "qy")
    while not pending.isEmpty():
        cells = {f"t{c}": F.floor(F.col(c) / side) for c in "xy"}
        placed = places.withColumns(cells)
        held = placed.groupBy("tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") > per_slice)
        slices = F.broadcast(held.select("tx", "ty", F.ceil(F.col("n") / per_slice).cast("int").alias("_slices")))
        targets = (
            placed.select("tx", "ty", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("m").alias("qm"))
            .join(slices, ["tx", "ty"], "left")
            .withColumn("slice", F.pmod(F.xxhash64("qx", "qy"), F.coalesce("_slices", F.lit(1))).cast("int"))
            .drop("_slices")
        )
        around = F.explode(
            F.array(
                *[
                    F.struct((cells["tx"] + dx).alias("tx"), (cells["ty"] + dy).alias("ty"))
                    for dx in (-1, 0, 1)
                    for dy in (-1, 0, 1)
                ]
            )
        )
        probes = (
            pending.select("x", "y", around.alias("t"))
            .select("x", "y", "t.*")
            .join(slices, ["tx", "ty"], "left")
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
            .drop("_slices")
        )
        dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
        met = probes.join(targets, ["tx", "ty", "slice"]).withColumn("d2", dx * dx + dy * dy)
        # every place is a point at least, so the k nearest places hold the k-th point
        few = met.where(F.col("d2") <= side * side).withColumn("nth", F.row_number().over(nearest))
        upto = F.sum("qm").over(nearest.rowsBetween(Window.unboundedPreceding, 0))
        reached = few.where(F.col("nth") <= k).withColumn("upto", upto).where(F.col("upto") >= k)
        found = reached.groupBy("x", "y").agg(F.sqrt(F.min("d2")).alias("k_distance"))
        found = materialize(found, "distances")
        done.append(found)
        pending = materialize(pending.join(found, ["x", "y"], "left_anti"), "pending")
        side *= 2
    totals = reduce(DataFrame.unionAll, done).join(places.withColumnRenamed("m", "n"), ["x", "y"])
    totals = materialize(totals, "distances")
    joined = join_totals(stored, totals, ["x", "y"], ["k_distance"], n_rows=n_points)
    return joined.select("id_client", "x", "y", "k_distance")


def _first_side(places: DataFrame, width: float, k: int, rungs: int = 24) -> float:
    """The widest of a halving ladder of cells that hold few places, as a place sees them on average."""
    tried = [width / 2**i for i in range(rungs)]
    cell = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")
                )
                for i, side in enumerate(tried)
            ]
        )
    )
    counts = places.select(cell.alias("c")).groupBy("c").agg(F.count("*").cast("double").alias("n"))
    seen = counts.groupBy("c.i").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("seen"))
    few = [row["i"] for row in seen.where(F.col("seen") <= SEARCHED * k).collect()]
    return tried[min(few)] if few else tried[-1]


def eps_by_k_distance(points: DataFrame, min_points: int = 10, share: float = 0.9, accuracy: int = 10_000) -> float:
    """The radius within which ``share`` of the points have ``min_points`` neighbours.

    A percentile of the k-distances by a mergeable quantile sketch, good to 1/``accuracy`` of the ranks.
    """
    distances = k_distances(points, min_points)
    found = distances.agg(F.percentile_approx("k_distance", share, accuracy)).first()[0]
    if not found:
        raise ValueError(f"no radius makes {share:.0%} of the points core with {min_points} neighbours")
    return found


def _components(edges: DataFrame) -> DataFrame:
    """``node, component`` by alternating large-star and small-star (Kiveris et al. 2014).

    The component is its smallest node. Rounds grow with the logarithm of the
    size, also on long chains; a centre that gathers very many edges is sliced
    by ``join_totals``.
    """

    def with_least(neighbours: DataFrame, n_rows: int) -> DataFrame:
        least = neighbours.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        joined = join_totals(neighbours, least, ["u"], ["m"], n_rows=n_rows)
        return joined.withColumn("m", F.least("u", "m"))

    def links_and_open_nodes(links: DataFrame) -> tuple[int, int]:
        """How many links, and how many nodes are neither a centre nor a node with one link to a centre."""
        upper = links.select(F.col("u").alias("node"), F.lit(True).alias("is_upper"))
        lower = links.select(F.col("v").alias("node"), F.lit(False).alias("is_upper"))
        ends = upper.unionAll(lower).groupBy("node")
        ends = ends.agg(F.count_if("is_upper").alias("up"), F.count_if(~F.col("is_upper")).alias("down"))
        is_open = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
        row = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(is_open)).first()
        return row[0], row[1]

    current = materialize(edges.distinct(), "edges")
    while True:
        n_links, n_open = links_and_open_nodes(current)
        if not n_open:
            break
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * n_links).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        # large-star gives no more links than it was given
        starred = with_least(large, n_links)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            starred.select("u", F.col("m").alias("v"))
        )
        current = materialize(small.where("u <> v").distinct(), "edges")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def _node(x: str, y: str) -> Column:
    """A cell as one value, ordered by cx, then cy."""
    return F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"))


def density_clusters(
    points: DataFrame, eps: float, min_points: int = 10, min_cluster_size: int = 10
) -> DataFrame:
    """``id_client, x, y, label``; labels run from the largest cluster, -1 is noise."""
    found = materialize(density_core_points(points, eps, min_points), "core")
    core = found.where("is_core")
    cells = core.groupBy("cx", "cy").agg(F.count("*").alias("n")).select("cx", "cy", "n", _node("cx", "cy").alias("node"))
    edges = _touching_cells(core, eps).select(
        F.greatest(_node("a_cx", "a_cy"), _node("b_cx", "b_cy")).alias("u"),
        F.least(_node("a_cx", "a_cy"), _node("b_cx", "b_cy")).alias("v"),
    )
    members = cells.join(_components(edges), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    members = materialize(members, "members")
    sizes = members.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster_size)
    numbered = assign_dense_id(sizes.withColumn("_order", -F.col("size")), ["_order", "component"], "label")
    cell_labels = members.join(numbered.select("component", "label"), "component", "left").select(
        "cx", "cy", "n", F.col("label").cast("int").alias("cell_label")
    )
    labelled = join_totals(found, cell_labels, ["cx", "cy"], ["cell_label"], n_rows=found.count())
    label = F.when(F.col("is_core"), F.coalesce("cell_label", F.lit(NOISE))).otherwise(NOISE)
    return labelled.select("id_client", "x", "y", label.alias("label"))


def suggest_eps(points: DataFrame, min_points: int = 10, share: float = 0.9, rungs: int = 16) -> float:
    """The smallest of a halving ladder of radii that makes ``share`` of the points certainly core.

    Starts from the width of the points and looks at cell counts only, ``rungs`` radii
    in one pass. Finer cells lie within coarser ones, so the first radius that does not
    fit ends the ladder, or the precision of the coordinates. Raises where none fits.
    """
    ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if any(end is None for end in ends):
        raise ValueError("no points to choose a radius from")
    width = max(ends[1] - ends[0], ends[3] - ends[2]) or 1.0
    finest = max(abs(end) for end in ends) * 2.0**-52
    ladder = [width]
    while ladder[-1] / 2 > max(finest, width * 2.0**-60):
        ladder.append(ladder[-1] / 2)
    fitting = 0
    while fitting < len(ladder):
        tried = ladder[fitting : fitting + rungs]
        shares = _certain_shares(points, tried, min_points)
        good = sum(found >= share for found in shares)
        fitting += good
        if good < len(tried):
            break
    if not fitting:
        raise ValueError(f"no radius makes {share:.0%} of the points core with {min_points} neighbours")
    return ladder[fitting - 1]


def _certain_shares(points: DataFrame, radii: list[float], min_points: int) -> list[float]:
    """Per radius, the share of points in cells of at least ``min_points``."""
    tried = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.floor(F.col("x") / (eps / sqrt(2))).alias("cx"),
                    F.floor(F.col("y") / (eps / sqrt(2))).alias("cy"),
                )
                for i, eps in enumerate(radii)
            ]
        )
    )
    cells = points.select(tried.alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    certain = F.sum(F.when(F.col("n") >= min_points, F.col("n")).otherwise(0)) / F.sum("n")
    return [row["share"] for row in cells.groupBy("c.i").agg(certain.alias("share")).orderBy("i").collect()]


def density_noise_share(labels: DataFrame) -> DataFrame:
    """Points and their share per label, noise included."""
    counts = materialize(labels.groupBy("label").agg(F.count("*").alias("n_points")), "counts")
    whole = counts.agg(F.sum("n_points")).first()[0] or 1
    return counts.withColumn("share", F.col("n_points") / whole)
