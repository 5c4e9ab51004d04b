"""Reading and writing metric records, catalogues and probability tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the status that tells the row variants of a metric record apart
STATUSES = ["ok", "no_sheet", "no_sheet_in_region", "too_small", "shape_mismatch", "predict_failed", "blend_failed", "error"]

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("sample", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("sheet_fraction", T.DoubleType()),
        T.StructField("sheet_components", T.LongType()),
        T.StructField("sheet_components_lost", T.LongType()),
        T.StructField("recall_by_threshold", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "local_missed_vs_found",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField(n, T.DoubleType()) for n in ("missed_median", "found_median", "delta_z")]),
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("scroll", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("ct_volume", T.StringType()),
        T.StructField("pred_shape", T.ArrayType(T.IntegerType())),
        T.StructField("ct_shape", T.ArrayType(T.IntegerType())),
        T.StructField("declared_level", T.IntegerType()),
        T.StructField("actual_level", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, glob: str = "*.json") -> DataFrame:
    """All records in files ``glob`` below ``path``, with a declared schema; the file name fills a missing sample."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.withColumn("sample", F.coalesce("sample", stem))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file: one JSON array of artifact rows."""
    return spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path)


def rescale_probability(df: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Brings 0-255 maps to [0, 1], deciding per volume by its maximum.

    The maximum is a small aggregate joined back, so a large volume is never gathered in one window.
    """
    top = df.groupBy(*by).agg(F.max(p).alias("_top"))
    scaled = F.when(F.col("_top") > 1.5, F.col(p) / 255.0).otherwise(F.col(p))
    return df.join(top, list(by)).withColumn(p, scaled).drop("_top")


def decode_properties(text: Column, schema: str | T.StructType) -> Column:
    """JSON text to a struct; bad text gives NULL instead of an error."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def pair_by_name(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one pairing of two listings; ``side`` tells complete pairs from orphans."""
    l = left.withColumn("_l", F.lit(True))  # noqa: E741
    r = right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return l.join(r, key, "full_outer").withColumn("side", side).drop("_l", "_r")


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """Fails the job if a key occurs twice, naming it; otherwise passes one row per key through."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in key])
    bad = F.raise_error(F.concat(F.lit(f"duplicate {what}: "), F.concat_ws("/", *[F.col(k).cast("string") for k in key])))
    return n.withColumn("_ok", F.when(F.col("_n") > 1, bad).otherwise(F.lit(1))).where("_ok = 1").drop("_ok", "_n")


def require_digest(df: DataFrame, content: str, expected: str) -> DataFrame:
    """Refuses binary content whose SHA-256 differs from the pinned one."""
    same = F.assert_true(F.sha2(F.col(content), 256) == expected, F.lit("content digest differs from the pinned one"))
    return df.withColumn("_ok", same).where(F.col("_ok").isNull()).drop("_ok")


def split_by_integrity(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows; a NULL verdict is quarantined."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def missing_indices(present: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Indices of [start, stop) that ``present`` does not hold."""
    spark = present.sparkSession
    return spark.range(start, stop).withColumnRenamed("id", key).join(present.select(key), key, "left_anti")


def pending(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities that still need work: resume without redoing."""
    return todo.join(done.select(*key), list(key), "left_anti")


def write_reports(df: DataFrame, path: str, by: str, fmt: str = "json") -> None:
    """One folder per entity group, appended."""
    df.write.mode("append").partitionBy(by).format(fmt).save(path)


def write_ranking(
    ranking: DataFrame, path: str, columns: Sequence[str], sidecar: dict | None = None, order: Sequence[str] = (), model: dict | None = None, skipped: DataFrame | None = None
) -> None:
    """Ranking as CSV in a fixed column order, with the run's parameters as JSON beside it.

    Files in the order of their names hold the rows sorted by ``order`` (the columns themselves unless given). The
    sidecar has the parameters, the number of ranked and skipped rows and, with a ``model``, its record and digest.
    ``skipped`` rows, which grow with the input, are a table of their own beside it.
    """
    import hashlib
    import json

    ranking.select(*columns).orderBy(*(order or columns)).write.mode("overwrite").option("header", True).csv(f"{path}/ranking")
    if skipped is not None:
        skipped.write.mode("overwrite").json(f"{path}/skipped")
    if sidecar is not None:
        record = {**sidecar, "n_ranked": ranking.count(), "n_skipped": 0 if skipped is None else skipped.count()}
        if model is not None:
            text = json.dumps(model, sort_keys=True)
            record["model"] = {**model, "sha256": hashlib.sha256(text.encode()).hexdigest()}
        spark = ranking.sparkSession
        spark.range(0, 1, 1, 1).select(F.lit(json.dumps(record, sort_keys=True)).alias("value")).write.mode("overwrite").text(f"{path}/sidecar")


def write_probabilities(df: DataFrame, path: str, p: str = "p") -> None:
    """Probability cache in single precision (Spark has no half precision)."""
    df.withColumn(p, F.col(p).cast("float")).write.mode("overwrite").parquet(path)


def write_labels(labels: DataFrame, path: str, by: str) -> DataFrame:
    """Rewritten label voxels, stored as bytes, plus class counts per volume."""
    labels.withColumn("label", F.col("label").cast("tinyint")).write.mode("overwrite").partitionBy(by).parquet(path)
    spark = labels.sparkSession
    return spark.read.parquet(path).groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
