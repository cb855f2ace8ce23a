"""Nearest places by a grid, and trees of places of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.steps import written


def nearest_by_grid(points: DataFrame, places: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """(key, place_id): for each point (key, lat, lng) the place (id, lat, lng) nearest by squared degrees, the smaller id of equals.

    Points and places meet in the point's cell and the eight around it, as a join of cells. A
    point is done when the nearest of them is no further than the edge of those nine, beyond
    which nothing nearer can be. The others go on with cells of twice the size, until nine
    cells hold every place; so a point far from all places takes a few rounds more, and
    nothing is broadcast. What is at one and the same spot is one point, and one place by its
    smallest id, so crowded spots do not meet in pairs; and the first cells are no larger than
    a few spots each take up on average. Degrees are plane: the date line is an edge, and a place across it
    is 360 degrees away. Points or places with nulls are left out; without places no point has
    a row.
    """
    known = written(places.select(F.col("id").alias("place_id"), F.col("lat").cast("double").alias("p_lat"), F.col("lng").cast("double").alias("p_lng")).filter("place_id is not null and p_lat is not null and p_lng is not null").groupBy("p_lat", "p_lng").agg(F.min("place_id").alias("place_id")))
    asking = points.select(key, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).filter(f"{key} is not null and lat is not null and lng is not null")
    bounds = [F.max(F.greatest(F.abs("p_lat"), F.abs("p_lng"))).alias("far")]
    far = known.agg(*bounds).first()["far"]
    if far is None:
        return asking.select(key, F.lit(None).cast(dict(known.dtypes)["place_id"]).alias("place_id")).filter("false")
    far = max(far, asking.agg(F.max(F.greatest(F.abs("lat"), F.abs("lng")))).first()[0] or 0.0)
    left, done = written(asking.select("lat", "lng").distinct()), None

    def square(c: Column) -> Column:
        return F.floor(c / size).cast("bigint")

    size = min(cell, max(far, cell) * 4 / known.count() ** 0.5)
    while True:
        every = size > far  # all there is lies in the four cells around zero, and each point sees those
        around = lambda c: F.explode(F.sequence(square(F.col(c)) - 1, square(F.col(c)) + 1))
        asked = left.select("*", around("lat").alias("row")).select("*", around("lng").alias("column"))
        held = known.select("*", square(F.col("p_lat")).alias("row"), square(F.col("p_lng")).alias("column"))
        d = F.pow(F.col("p_lat") - F.col("lat"), 2) + F.pow(F.col("p_lng") - F.col("lng"), 2)
        best = asked.join(held, ["row", "column"]).groupBy("lat", "lng").agg(F.min(F.struct(d.alias("d"), "place_id")).alias("best"))
        edge = lambda c: F.least(F.col(c) - (square(F.col(c)) - 1) * size, (square(F.col(c)) + 2) * size - F.col(c))
        # At the edge itself another place may be as near, with a smaller id.
        sure = F.lit(True) if every else F.col("best.d") < F.pow(F.least(edge("lat"), edge("lng")), 2)
        found = written(best.filter(sure).select("lat", "lng", F.col("best.place_id").alias("place_id")))
        done = found if done is None else done.unionByName(found)
        if not every:
            left = written(left.join(found.select("lat", "lng"), ["lat", "lng"], "left_anti"))
        if every or left.isEmpty():
            return asking.distinct().join(done, ["lat", "lng"]).select(key, "place_id")
        size *= 2


def _climbed(rows: DataFrame, rounds: int, carried: bool) -> DataFrame:
    """(id, name, parent_id, up, top, steps, lost, way): how far each row got in doubling rounds; ``up`` is null at a root.

    ``lost`` rows came to an id that is not there. ``way`` has the names from the row up, if they
    are to be ``carried``.
    """
    way = F.array("name") if carried else F.array().cast("array<string>")
    state = written(rows.select("id", "name", "parent_id", F.col("parent_id").alias("up"), F.col("id").alias("top"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("lost"), way.alias("way")))
    goes = F.col("up").isNotNull() & ~F.col("lost")
    for _ in range(rounds):
        if state.filter(goes).isEmpty():
            break
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("top").alias("next_top"), F.col("steps").alias("more"), F.col("lost").alias("lost_there"), F.col("way").alias("way_on"), F.lit(True).alias("there"))
        lost = F.col("lost") | (goes & (F.col("there").isNull() | F.coalesce("lost_there", F.lit(False))))
        on = goes & ~lost
        # The step to the row above is one of its own.
        state = written(
            state.join(ahead, "up", "left").select(
                "id",
                "name",
                "parent_id",
                F.when(on, F.col("next")).otherwise(F.when(~goes, F.col("up"))).alias("up"),
                F.when(on, F.col("next_top")).otherwise(F.col("top")).alias("top"),
                F.when(on, F.col("steps") + F.lit(1) + F.col("more")).otherwise(F.col("steps")).alias("steps"),
                lost.alias("lost"),
                F.when(on, F.concat("way", "way_on")).otherwise(F.col("way")).alias("way"),
            )
        )
    return state


def tree_paths(rows: DataFrame, by: str = " > ") -> DataFrame:
    """(id, name, parent_id, root_id, depth, path, status) of rows (id, name, parent_id) of a tree of any depth.

    A row without a parent is a root of depth 0. status is ok, orphan where the way up ends at
    an id that is not there, or cycle where it does not end; the latter two have no root, depth
    and path. Each round doubles the steps that a row has taken, so there are as many rounds as
    the depth has binary digits; what still goes up after as many as the number of rows has
    goes round. Names are carried by the rows that are known to end only. ids are unique.
    """
    climbed = _climbed(rows, rows.count().bit_length() + 1, False)
    status = F.when(F.col("lost"), "orphan").when(F.col("up").isNotNull(), "cycle").otherwise("ok")
    judged = written(climbed.select("id", "name", "parent_id", F.col("top").alias("root_id"), F.col("steps").alias("depth"), status.alias("status")))
    ok = judged.filter("status = 'ok'")
    deepest = ok.agg(F.max("depth")).first()[0] or 0
    named = _climbed(ok.select("id", "name", "parent_id"), deepest.bit_length() + 1, True).select("id", F.array_join(F.reverse("way"), by).alias("path"))
    whole = F.col("status") == "ok"
    return judged.join(named, "id", "left").select("id", "name", "parent_id", F.when(whole, F.col("root_id")).alias("root_id"), F.when(whole, F.col("depth").cast("int")).alias("depth"), "path", "status")
