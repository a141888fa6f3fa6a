"""Places on a map: projection, bounds, thinning, clusters, bins."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import ranges
from tallyspark.plans.lineage import checkpointed


def projected(rows: DataFrame, lon: str, lat: str, lon0: float, lat0: float, scale: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Map x, y by an equirectangular projection around a point; places outside the bounds go, as do repeated ones."""
    x = (F.col(lon) - lon0) * math.cos(math.radians(lat0)) * scale
    y = (F.lit(lat0) - F.col(lat)) * scale
    low_x, low_y, high_x, high_y = bounds
    return rows.withColumns({"x": x, "y": y}).filter(F.col("x").between(low_x, high_x) & F.col("y").between(low_y, high_y)).dropDuplicates(["x", "y"])


def thinned(points: DataFrame, ring: str, order: str, tolerance: float) -> DataFrame:
    """Rings (ring, order, x, y) without the points within a tolerance of the line between those kept."""

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order).reset_index(drop=True)
        keep, spans = {0, len(frame) - 1}, [(0, len(frame) - 1)]
        xs, ys = frame["x"].to_numpy(), frame["y"].to_numpy()
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            dx, dy = xs[b] - xs[a], ys[b] - ys[a]
            size = math.hypot(dx, dy)
            px, py = xs[a + 1 : b] - xs[a], ys[a + 1 : b] - ys[a]
            away = abs(px * dy - py * dx) / size if size else (px**2 + py**2) ** 0.5
            far = int(away.argmax()) + a + 1
            if away[far - a - 1] > tolerance:
                keep.add(far)
                spans += [(a, far), (far, b)]
        return frame.loc[sorted(keep)]

    return points.groupBy(ring).applyInPandas(thin, points.schema)


def apart(points: DataFrame, group: str, axis: str, radius: float) -> DataFrame:
    """points with _of, a number of the band of an axis they are in: bands of a group are more than the radius from each other."""
    return ranges.parts(points.withColumn("_end", F.col(axis)), [group], [axis], "_end", F.lit(radius)).drop("_end")


def clustered(points: DataFrame, group: str, key: str, radius: float) -> DataFrame:
    """(group, key, cluster, x, y): points of a group, in order of key, join the first cluster whose running centre is near, else start one.

    A centre lies among its points, so points more than the radius apart along an axis can't share a cluster, nor can what
    lies between: a group is cut into bands by x, and those by y, that are gathered each on its own. Clusters are numbered from 0 by the
    order of their first points within the group, by ranges of it. x and y are the centre. Points without both coordinates are left out.
    """
    banded = apart(points.dropna(subset=["x", "y"]), group, "x", radius).withColumn("_band", F.struct(F.col(group).alias("g"), F.col("_of").alias("n"))).drop("_of")
    banded = apart(banded, "_band", "y", radius)

    def gather(keys: list, xs: list, ys: list) -> pd.DataFrame:
        sums, first, of = np.zeros((0, 3)), [], []
        for k, x, y in zip(keys, xs, ys, strict=True):
            near = np.flatnonzero(np.hypot(sums[:, 0] / sums[:, 2] - x, sums[:, 1] / sums[:, 2] - y) <= radius) if len(sums) else []
            if not len(near):
                sums, first = np.r_[sums, [[0.0, 0.0, 0.0]]], [*first, k]
            at = int(near[0]) if len(near) else len(sums) - 1
            sums[at] += (x, y, 1)
            of.append(at)
        centre = sums[of, :2] / sums[of, 2:]
        return pd.DataFrame({key: keys, "_first": [first[i] for i in of], "_x": centre[:, 0], "_y": centre[:, 1]})

    def gathered(frames):
        """Frames of rows by part and key; a part's rows wait until it ends."""
        part, held = None, []
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False, name=None):
                if row[0] != part:
                    if held:
                        done.append(gather(*map(list, zip(*held, strict=True))).assign(_group=part))
                    part, held = row[0], []
                held.append(row[1:])
            if done:
                yield pd.concat(done)
        if held:
            yield gather(*map(list, zip(*held, strict=True))).assign(_group=part)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    named = F.to_json(F.struct(F.col("_band").alias("band"), F.col("_of").alias("of")))
    sorted_ = banded.select(named.alias("_group"), key, "x", "y").repartition("_group").sortWithinPartitions("_group", key)
    made = sorted_.mapInPandas(gathered, f"{key} {kinds[key]}, _first {kinds[key]}, _x double, _y double, _group string")
    made = checkpointed(made.select(F.from_json("_group", f"band struct<g: {kinds[group]}>")["band"]["g"].alias(group), key, "_first", F.col("_x").alias("x"), F.col("_y").alias("y")))
    numbered = ranges.numbered(made.filter(F.col(key) == F.col("_first")), [group], [key], "cluster").select(F.col(group).alias("_g"), F.col(key).alias("_k"), (F.col("cluster") - 1).cast("int").alias("cluster"))
    return made.join(numbered, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_first") == F.col("_k"))).select(group, key, "cluster", "x", "y")


def shade(value: Column, thresholds: list[float]) -> Column:
    """Class of a value: 0 if not positive, else 1 and up by the first threshold above it."""
    out = F.lit(len(thresholds) + 1)
    for i, t in reversed(list(enumerate(thresholds))):
        out = F.when(value < t, i + 1).otherwise(out)
    return F.when(value.isNotNull(), F.when(value <= 0, 0).otherwise(out))


def shade_signed(value: Column, thresholds: list[float]) -> Column:
    """Classes to both sides of 0."""
    return F.signum(value).cast("int") * shade(F.abs(value), thresholds)


def packed_lanes(rows: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """Each span in the lowest lane that is free at its start; greedy within a group, in order of start and key.

    Where a span starts at or after the end of all before it every lane is free, so a group is cut there and its parts are packed
    each on its own: what one task holds is a run of spans without such a gap, and not a group. An end of null is open; a span without a start is left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    far = {"date": F.lit("9999-12-31").cast("date"), "timestamp": F.lit("9999-12-31").cast("timestamp"), "timestamp_ntz": F.lit("9999-12-31").cast("timestamp_ntz"), "int": F.lit(2**31 - 1), "bigint": F.lit(2**63 - 1)}
    until = F.coalesce(F.col(end), far.get(kinds[end], F.lit(float("inf")))) if kinds[end] in far or kinds[end] in ("double", "float") else F.col(end)
    some = rows.filter(F.col(start).isNotNull()).select(group, key, F.col(start).alias("_start"), until.alias("_end"))

    def pack(frames):
        """Frames of rows by part, start and key; only the lanes of one part are held."""
        part, free, taken = None, [], []  # lanes that are free, the lowest first; (end, lane), the earliest first
        for frame in frames:
            lanes = []
            for of, a, b in zip(frame["_group"], frame["_start"], frame["_end"], strict=True):
                if of != part:
                    part, free, taken = of, [], []
                while taken and taken[0][0] <= a:
                    heapq.heappush(free, heapq.heappop(taken)[1])
                lane = heapq.heappop(free) if free else len(taken)
                heapq.heappush(taken, (b, lane))
                lanes.append(lane)
            yield frame[["_group", key]].assign(lane=lanes)

    cut = ranges.parts(some, [group], ["_start", key], "_end").withColumn("_group", F.to_json(F.struct(F.col(group).alias("g"), F.col("_of").alias("of"))))
    packed = cut.select("_group", key, "_start", "_end").repartition("_group").sortWithinPartitions("_group", "_start", key).mapInPandas(pack, f"_group string, {key} {kinds[key]}, lane int")
    return packed.select(F.from_json("_group", f"g {kinds[group]}")["g"].alias(group), key, "lane")
