"""Operators on heatmaps and keypoints.

A heatmap is an ARRAY<DOUBLE> of width x height values in row order, one row per
(crop, kp_idx); work on one heatmap stays inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.arrays import argmax
from framewise.functions.geometry import eig2_max, gaussian_2d, lround
from framewise.functions.skeletons import DEPTH_SIGMA_MAX, depth_sigma
from framewise.operators.aggregate import quantile_index
from framewise.operators.neighbours import components
from framewise.operators.scale import join_on
from framewise.operators.spatial import neighbourhood

# Segmentation classes, table is the first that can hide a joint.
PERSON_CLASS, TABLE_CLASS = 14, 8
# Joint slots.
ANKLES = (15, 16)
SHOULDERS, HIPS = (5, 6), (11, 12)


def heatmap_peaks(df: DataFrame, hm: str, w: int, h: int, threshold: float = 0.30) -> DataFrame:
    """Adds conf, px, py and the peak x, y moved a quarter towards the larger neighbour.

    Rows whose maximum does not exceed ``threshold`` get conf 0 and no position.
    """
    rows = df.withColumn("_at", argmax(F.col(hm)).cast("int")).withColumn("_top", F.array_max(hm))
    at = F.col("_at")
    px, py = at % w, F.floor(at / w).cast("int")
    inner = (px > 1) & (px < w - 1) & (py > 1) & (py < h - 1)

    def side(step: int) -> Column:
        d = F.get(hm, at + step) - F.get(hm, at - step)
        return F.when(inner, F.signum(d)).otherwise(F.lit(0.0))

    ok = F.col("_top") > threshold
    return (
        rows.withColumn("conf", F.when(ok, F.col("_top")).otherwise(F.lit(0.0)))
        .withColumn("px", F.when(ok, px))
        .withColumn("py", F.when(ok, py))
        .withColumn("x", F.when(ok, px + side(1) * 0.25))
        .withColumn("y", F.when(ok, py + side(w) * 0.25))
        .drop("_at", "_top")
    )


def peak_covariance(
    peaks: DataFrame, hm: str, w: int, h: int, scale_x: Column, scale_y: Column,
    env: int = 15, threshold: float = 0.05,
) -> DataFrame:
    """Second moments about the peak over values above ``threshold`` within ``env`` cells."""
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("xx", "yy", "xy", "n")))

    def add(acc: Column, cell: Column) -> Column:
        u, v, val = cell["i"] % w, F.floor(cell["i"] / w), cell["v"]
        used = (
            (val > threshold)
            & (F.abs(u - F.col("px")) <= env)
            & (F.abs(v - F.col("py")) <= env)
        )
        dx, dy = u - F.col("x"), v - F.col("y")
        return F.when(
            used,
            F.struct(
                (acc["xx"] + val * dx * dx).alias("xx"), (acc["yy"] + val * dy * dy).alias("yy"),
                (acc["xy"] + val * dx * dy).alias("xy"), (acc["n"] + 1.0).alias("n"),
            ),
        ).otherwise(acc)

    cells = F.transform(hm, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    rows = peaks.withColumn("_m", F.when(F.col("conf") > 0, F.aggregate(cells, zero, add)))
    norm = F.col("conf") * F.col("_m.n")
    return (
        rows.withColumn("cov_xx", F.try_divide(F.col("_m.xx"), norm) * scale_x * scale_x)
        .withColumn("cov_xy", F.try_divide(F.col("_m.xy"), norm) * scale_x * scale_y)
        .withColumn("cov_yy", F.try_divide(F.col("_m.yy"), norm) * scale_y * scale_y)
        .drop("_m")
    )


def person_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hull, mean confidence and number of accepted keypoints, from one row per keypoint."""
    ok = F.col("conf") > 0

    def of(name: str) -> Column:
        return F.when(ok, F.col(name))

    return df.groupBy(*keys).agg(
        F.min(of("x")).alias("xmin"), F.min(of("y")).alias("ymin"),
        F.max(of("x")).alias("xmax"), F.max(of("y")).alias("ymax"),
        F.coalesce(F.avg(of("conf")), F.lit(0.0)).alias("conf"), F.count_if(ok).alias("n_valid"),
    )


def blend_joints(
    a: DataFrame, b: DataFrame, on: Sequence[str], part_threshold: float, score_threshold: float
) -> DataFrame:
    """Joints of two sources (on, kp_idx, x, y, score) blended by score, and ``counted``.

    A joint stays when one score exceeds ``part_threshold``; it counts for the person's
    score when one exceeds ``score_threshold``. A feedback joint at (0, 0) is invalid.
    """
    fb = b.select(*on, "kp_idx", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("score").alias("_s"))
    rows = a.join(fb, [*on, "kp_idx"], "left")
    valid = F.coalesce((F.col("_x") != 0) | (F.col("_y") != 0), F.lit(False))
    s, f = F.col("score"), F.when(valid, F.col("_s")).otherwise(F.lit(0.0))
    mean = F.when(f > 0, (s + f) / 2.0).otherwise(s)
    kept = rows.filter((s > part_threshold) | (f > part_threshold))

    def mix(own: str, other: str) -> Column:
        return (s * F.col(own) + f * F.coalesce(other, F.lit(0.0))) / (s + f)

    return kept.select(
        *on, "kp_idx", mix("x", "_x").alias("x"), mix("y", "_y").alias("y"), mean.alias("score"),
        ((s > score_threshold) | (f > score_threshold)).alias("counted"),
    )


def mean_score(blended: DataFrame, on: Sequence[str]) -> DataFrame:
    return blended.groupBy(*on).agg(
        F.coalesce(F.avg(F.when(F.col("counted"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.count(F.lit(1)).alias("n_joints"),
    )


def swap_detect(
    df: DataFrame, pairs: Sequence[tuple[int, int]], w: int, h: int, hm: str = "hm",
    min_dist: tuple[int, int] = (2, 4), max_env: int = 2,
) -> DataFrame:
    """Per (crop, pair): whether both sides prefer the other channel.

    Rows are (crop, kp_idx, hm, mu_x, mu_y) with the predicted centre of the joint.
    """
    spark = df.sparkSession
    # the pair list is given by the caller: a handful of rows
    dim = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "l int, r int")
    side = ("mu_x", "mu_y", hm)
    left = df.select("crop", F.col("kp_idx").alias("l"), *(F.col(c).alias(f"l_{c}") for c in side))
    right = df.select("crop", F.col("kp_idx").alias("r"), *(F.col(c).alias(f"r_{c}") for c in side))
    rows = left.join(F.broadcast(dim), "l").join(right, ["crop", "r"])
    lx, ly, rx, ry = (F.col(c) for c in ("l_mu_x", "l_mu_y", "r_mu_x", "r_mu_y"))
    dist = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
    near = F.when(F.col("l") <= 9, F.lit(min_dist[0])).otherwise(F.lit(min_dist[1]))
    env = F.least(F.lit(max_env), F.floor((dist - near) * 0.5).cast("int"))
    rows = rows.withColumn("_env", env)
    e = F.col("_env")

    def outside(x: Column, y: Column) -> Column:
        return (x - e >= w) | (y - e >= h) | (x + e + 1 < 0) | (y + e + 1 < 0)

    def window_sum(channel: str, x: Column, y: Column) -> Column:
        cells = F.transform(channel, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
        return F.aggregate(
            cells, F.lit(0.0),
            lambda acc, c: acc
            + F.when(
                (F.abs(c["i"] % w - x) <= e) & (F.abs(F.floor(c["i"] / w) - y) <= e), c["v"]
            ).otherwise(F.lit(0.0)),
        )

    checked = (e > 0) & ~outside(lx, ly) & ~outside(rx, ry)
    swap = (window_sum(f"l_{hm}", lx, ly) < window_sum(f"r_{hm}", lx, ly)) & (
        window_sum(f"r_{hm}", rx, ry) < window_sum(f"l_{hm}", rx, ry)
    )
    return rows.select("crop", "l", "r", F.when(checked, swap).otherwise(F.lit(False)).alias("swap"))


def apply_swaps(df: DataFrame, swaps: DataFrame) -> DataFrame:
    """Exchange the channel numbers of the swapped pairs."""
    hit = swaps.filter("swap")
    both = hit.select("crop", F.col("l").alias("kp_idx"), F.col("r").alias("_new")).unionByName(
        hit.select("crop", F.col("r").alias("kp_idx"), F.col("l").alias("_new"))
    )
    return join_on(df, both, ["crop", "kp_idx"]).withColumn(
        "kp_idx", F.coalesce("_new", "kp_idx")
    ).drop("_new")


def render_heatmap(
    kps: DataFrame, keys: Sequence[str], W: int, H: int, amplitude: float = 1.5,
    sigma_max: float = 10.0, noise: float = 0.0,
) -> DataFrame:
    """Cells of a W x H map around each joint: a Gaussian with the joint's covariance.

    Rows need x, y, conf, cov_* and the crop box xmin, ymin, xmax, ymax. The box drawn
    reaches ceil(3 sigma) around the rounded centre; rows out are keys, u, v, val.
    """
    sx = (F.col("xmax") - F.col("xmin")) / W
    sy = (F.col("ymax") - F.col("ymin")) / H
    rows = kps.filter((F.col("conf") != 0) & (sx != 0) & (sy != 0))
    rows = rows.select(
        *keys, ((F.col("x") - F.col("xmin")) / sx).alias("_mx"),
        ((F.col("y") - F.col("ymin")) / sy).alias("_my"),
        (F.col("cov_xx") / (sx * sx) + noise).alias("_cxx"),
        (F.col("cov_xy") / (sx * sy) + noise).alias("_cxy"),
        (F.col("cov_yy") / (sy * sy) + noise).alias("_cyy"),
    )
    rows = rows.withColumn(
        "_sigma",
        F.least(F.lit(sigma_max), F.sqrt(eig2_max(F.col("_cxx"), F.col("_cxy"), F.col("_cyy")))),
    )
    size = F.ceil(F.col("_sigma") * 3.0)
    rows = rows.withColumns(
        {"_size": size, "_cu": lround(F.col("_mx")), "_cv": lround(F.col("_my"))}
    )

    def span(center: str, limit: int) -> Column:
        low = F.greatest(F.col(center) - F.col("_size"), F.lit(0))
        high = F.least(F.col(center) + F.col("_size"), F.lit(limit - 1))
        return F.when(high >= low, F.sequence(low, high))

    cells = rows.withColumn("u", F.explode(span("_cu", W))).withColumn("v", F.explode(span("_cv", H)))
    value = gaussian_2d(
        F.col("u") - F.col("_mx"), F.col("v") - F.col("_my"),
        F.col("_cxx"), F.col("_cyy"), F.col("_cxy"),
    )
    return cells.select(*keys, "u", "v", (value * (amplitude / F.col("_sigma"))).alias("val"))


def joint_depth(
    kps: DataFrame, depth: DataFrame, on: Sequence[str], joint: Sequence[str], r: int = 2,
    low: int = 300, high: int = 10000, scale: float = 1000.0,
) -> DataFrame:
    """Depth in metres and its sigma per joint, from valid pixels within +-r.

    ``kps`` rows need u, v, kp_idx, conf, person_conf; ``depth`` rows on, gu, gv, d with
    one depth per pixel. The lower third of the sorted depths counts, at the ankles a
    farther one. Joints without a valid pixel are left out.
    """
    valid = depth.filter((F.col("d") > low) & (F.col("d") < high))
    near = neighbourhood(kps, valid, on, joint, r)
    # at most (2 r + 1)^2 depths per joint
    listed = near.groupBy(*on, *joint).agg(F.sort_array(F.collect_list("d")).alias("_d"))
    rows = kps.join(listed, [*on, *joint])
    n = F.size("_d")
    at = F.when(F.col("kp_idx").isin(*ANKLES), quantile_index(n, "far")).otherwise(
        quantile_index(n, "third")
    )
    return rows.withColumns(
        {
            "depth_idx": at.cast("long"),
            "depth": F.get("_d", at.cast("int")) / scale,
            "sigma": depth_sigma(F.col("conf"), F.col("person_conf")),
        }
    ).drop("_d")


def occlusion_check(
    joints: DataFrame, background: DataFrame, on: Sequence[str], joint: Sequence[str],
    segm_class: str = "segm_class", r: int = 2, low: int = 300, high: int = 10000,
    margin: float = 0.2, scale: float = 1000.0,
) -> DataFrame:
    """Marks joints hidden by furniture.

    A joint on a class from table upwards other than person is hidden unless the
    background depth there is unknown or more than ``margin`` metres behind it.
    ``joints`` comes from `joint_depth`; ``background`` rows are on, gu, gv, d.
    """
    covering = (F.col(segm_class) != PERSON_CLASS) & (F.col(segm_class) >= TABLE_CLASS)
    rows = joints.withColumn("_covering", F.coalesce(covering, F.lit(False)))
    valid = background.filter((F.col("d") > low) & (F.col("d") < high))
    near = neighbourhood(rows.filter("_covering"), valid, on, joint, r)
    listed = near.groupBy(*on, *joint).agg(F.sort_array(F.collect_list("d")).alias("_d"))
    rows = rows.join(listed, [*on, *joint], "left")
    at = F.least(F.col("depth_idx"), F.size("_d") - 1).cast("int")
    behind = F.get("_d", at) / scale
    free = behind.isNull() | (behind - F.col("depth") > margin)
    return rows.withColumn("occluded", F.col("_covering") & ~free).drop("_covering", "_d")


def _torso(depth: str) -> Column:
    """Depth of the torso from shoulders and hips, NULL when none is known."""
    def mean(slots: Sequence[int]) -> Column:
        known = F.filter(
            F.array(*(F.get(depth, F.lit(i)) for i in slots)), lambda d: d.isNotNull() & (d > 0)
        )
        return F.try_divide(
            F.aggregate(known, F.lit(0.0), lambda acc, d: acc + d), F.size(known).cast("double")
        )

    def pair(a: Column, b: Column, gap: float) -> Column:
        return F.when(F.abs(a - b) > gap, F.greatest(a, b)).otherwise((a + b) / 2.0)

    left, right = mean((SHOULDERS[0], HIPS[0])), mean((SHOULDERS[1], HIPS[1]))
    top, bottom = mean(SHOULDERS), mean(HIPS)
    return (
        F.when(left.isNotNull() & right.isNotNull(), pair(left, right, 0.5))
        .when(top.isNotNull() & bottom.isNotNull(), pair(top, bottom, 0.7))
        .otherwise(mean((*SHOULDERS, *HIPS)))
    )


def repair_depth(df: DataFrame, depth: str = "depth", sigma: str = "sigma", limit: float = 0.75):
    """Joints too far from the torso take its depth and the largest sigma.

    ``depth`` and ``sigma`` are arrays over the joints; 0 or NULL means unknown.
    """
    rows = df.withColumn("torso", _torso(depth))
    t = F.col("torso")

    def far(d: Column) -> Column:
        return F.coalesce((t > 0) & (d > 0) & (F.abs(d - t) > limit), F.lit(False))

    both = F.zip_with(depth, sigma, lambda d, s: F.when(far(d), F.lit(DEPTH_SIGMA_MAX)).otherwise(s))
    return rows.withColumn(sigma, both).withColumn(
        depth, F.transform(depth, lambda d: F.when(far(d), t).otherwise(d))
    )


def merge_parts(pairs: DataFrame, frame: str = "frame") -> DataFrame:
    """Persons from part pairs (frame, part_a, part_b): pairs that share a part belong together.

    Rows: frame, part, person (the smallest part of the person).
    """
    parts = components(pairs.select(frame, "part_a", "part_b"), [frame], "part_a", "part_b")
    return parts.select(frame, F.col("vertex").alias("part"), F.col("component").alias("person"))
