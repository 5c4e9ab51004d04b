"""Artifact names, paths, shapes, boxes and sampling grids as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from voxelmetry.functions.expr import col

# fixed value: the published pattern of a prediction's name (scan stamp, run, model, level, threshold)
PREDICTION_NAME = r"^(\d+)-surface-(\d+)-(.+?)-L(\d+)-th([0-9.]+)\.zarr$"
RESOLUTION = r"-([0-9.]+)um-"


def parse_prediction(name: Column | str) -> Column:
    """struct(ct, run, model, level, threshold); NULL for names that do not follow the pattern."""
    c = col(name)
    part = lambda i: F.regexp_extract(c, PREDICTION_NAME, i)
    return F.when(
        c.rlike(PREDICTION_NAME),
        F.struct(
            part(1).alias("ct"),
            part(2).alias("run"),
            part(3).alias("model"),
            F.try_to_number(part(4), F.lit("99")).cast("int").alias("level"),
            part(5).try_cast("double").alias("threshold"),
        ),
    )


def resolution_um(name: Column | str) -> Column:
    return F.regexp_extract(col(name), RESOLUTION, 1).try_cast("double")


def stamp_time(stamp: Column | str) -> Column:
    """14 digits to a timestamp; NULL if they are none."""
    return F.try_to_timestamp(col(stamp), F.lit("yyyyMMddHHmmss"))


def normalise_path(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(normalise_path(path), F.lit("/")), "/", -1)


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def without_top_folder(path: Column | str) -> Column:
    p = normalise_path(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"^[^/]*/", "")).otherwise(p)


def child_prefix(key: Column | str, prefix: str) -> Column:
    """The next path step below ``prefix``, NULL for keys elsewhere."""
    c = col(key)
    rest = F.substr(c, F.lit(len(prefix) + 1))
    return F.when(c.startswith(prefix) & F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1))


def parse_box(text: Column | str) -> Column:
    """'z0:z1,y0:y1,x0:x1' to a struct of six integers."""
    parts = F.split(col(text), "[:,]")
    return F.struct(*[F.get(parts, i).cast("int").alias(n) for i, n in enumerate(("z0", "z1", "y0", "y1", "x0", "x1"))])


def format_box(box: Column | str) -> Column:
    b = col(box)
    return F.concat_ws(",", *[F.concat_ws(":", b[f"{a}0"].cast("string"), b[f"{a}1"].cast("string")) for a in "zyx"])


def in_box(box: Column | str, margin: int = 0) -> Column:
    """Voxel (z, y, x) lies in the box, at least ``margin`` inside each face."""
    b = col(box)
    ok = F.lit(True)
    for a in "zyx":
        ok = ok & (F.col(a) >= b[f"{a}0"] + margin) & (F.col(a) < b[f"{a}1"] - margin)
    return ok


def shape_product(shape: Column | str) -> Column:
    return F.aggregate(col(shape), F.lit(1).cast("long"), lambda a, s: a * s.cast("long"))


def window_starts(size: Column | str, patch: int, step: float) -> Column:
    """Window origins spread evenly over the axis; the last window ends at the border."""
    s = col(size)
    n = F.ceil((s - patch) / F.lit(patch * step)).cast("int") + 1
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (s - patch) / (n - 1).cast("double")).cast("int"))
    return F.when(s <= patch, F.array(F.lit(0))).otherwise(even)


@F.udtf(returnType="start INT")
class WindowStarts:
    """``window_starts`` as a table function, for lateral joins in SQL text: window_starts(size, patch, step)."""

    def eval(self, size: int, patch: int, step: float):
        if size is None:
            return
        if size <= patch:
            yield (0,)
            return
        n = math.ceil((size - patch) / (patch * step)) + 1
        for i in range(n):
            yield (round(i * (size - patch) / (n - 1)),)


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("window_starts", WindowStarts)


def morton(z: Column | str, y: Column | str, x: Column | str) -> Column:
    """Z-order key: the bits of the three indices interleaved, z highest. Fails for indices outside 0..2^21-1."""
    inside = lambda c: F.when(c.between(0, 0x1FFFFF) | c.isNull(), c).otherwise(F.raise_error(F.lit("a Morton index must have at most 21 bits")))
    spread = [_spread(inside(col(c).cast("long"))) for c in (z, y, x)]
    return F.shiftleft(spread[0], 2).bitwiseOR(F.shiftleft(spread[1], 1)).bitwiseOR(spread[2])


# fixed values: shift and mask of each doubling step that spaces 21 bits three apart
_SPREAD_STEPS = [
    (32, 0x1F00000000FFFF),
    (16, 0x1F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
]


def _spread(c: Column) -> Column:
    # a fold over the step table keeps the expression small, unlike nesting it by hand
    steps = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(m).alias("mask")) for s, m in _SPREAD_STEPS])
    return F.aggregate(
        steps,
        c,
        lambda v, s: v.bitwiseOR(F.call_function("shiftleft", v, s["shift"])).bitwiseAND(s["mask"]),
    )
