"""Reading slides, outcomes and feature lists from files; writing feature lists, tables and reports."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.arrays import half_even
from ravelin.functions.keys import subject_key
from ravelin.runtime import ready, small
from ravelin.sources.workbooks import columns_of, register, sheet_rows


def keep_cortex(objects: DataFrame, flag: str = "In Medulla", drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose flag is 0, if there is such a column; absent columns of ``drop`` are no error."""
    if flag in objects.columns:
        objects = objects.where(F.col(f"`{flag}`") == 0)
    return objects.drop(*drop)


def _located(objects: DataFrame, marker: str) -> DataFrame:
    parts = F.split("path", "/")
    out = objects.withColumn("slide", F.element_at(parts, -2)).where(F.col("slide").contains(marker))
    return out.withColumn("subject", subject_key(F.col("slide"))).drop("path")


def load_slides(spark: SparkSession, base: str, kind: str = "parquet", schema: str | None = None, marker: str = "PAS", drop: tuple[str, ...] = ()) -> DataFrame:
    """Objects of all slide folders ``base/<folder>/`` whose name holds ``marker``; parquet, csv or xlsx files of one schema.

    Folders without a file of that kind are passed over. NaN becomes null, so that means skip it.
    """
    ready(spark)
    where = f"{base}/*{marker}*/"
    if kind == "xlsx":
        if schema is None:
            raise ValueError("workbooks need a schema")
        # The marker is in the pattern of folders: other folders' workbooks are not listed, read or parsed.
        register(spark)
        objects = spark.read.format("workbooks").schema(f"{schema}, path string").option("marker", marker).load(base)
    else:
        reader = spark.read.option("pathGlobFilter", f"*.{kind}")
        reader = reader.schema(schema) if schema else reader
        objects = (reader.option("header", "true").csv(where) if kind == "csv" else reader.option("mergeSchema", "true").parquet(where)).withColumn("path", F.col("_metadata.file_path"))
    objects = objects.withColumn("path", F.url_decode("path"))
    reals = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in objects.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return keep_cortex(_located(objects.withColumns(reals), marker), drop=drop)


def read_workbooks(files: DataFrame, schema: str) -> DataFrame:
    """One row for each sheet row of each file (path, content), for stores that only Spark opens; columns absent from a sheet are null."""
    kinds = T.StructType.fromDDL(schema)
    whole = T.StructType([*kinds, T.StructField("path", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns)):
                found = ([*r, path] for r in sheet_rows(BytesIO(content), kinds.fieldNames()))
                while part := list(itertools.islice(found, 10_000)):
                    yield columns_of(part, whole)

    return files.select("path", "content").mapInArrow(rows, whole)


def load_outcomes(spark: SparkSession, path: str, name: str, value: str) -> DataFrame:
    """Outcome rows in file order: name, y and their place."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(F.col(f"`{name}`").alias("name"), F.col(f"`{value}`").try_cast("double").alias("y"), F.monotonically_increasing_id().alias("place"))


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature names with their ordinals; blank lines are none."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda s: s != "")))
    return lines.select(F.col("pos").alias("j"), F.col("col").alias("name"))


def save_features(features: DataFrame, path: str) -> None:
    """One name on each line, by ordinal. A feature list is as long as a table is wide."""
    features.repartition(1).sortWithinPartitions("j").select("name").write.mode("overwrite").text(path)


def save_correlations(pairs: DataFrame, names: list[str], path: str) -> None:
    """A square CSV with four decimals from pairs (f1, f2, r) of both orders."""
    square = pairs.groupBy("f1").pivot("f2", names).agg(F.first("r"))
    square.select(F.col("f1").alias("feature"), *(F.coalesce(half_even(F.col(f"`{n}`"), 4), F.lit(1.0)).alias(n) for n in names)).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def missing_settings(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Settings of the grid without results."""
    return grid.select(*keys).distinct().join(small(results.select(*keys).distinct()), keys, "left_anti")


def save_results(results: DataFrame, path: str, setting: list[str]) -> None:
    """Long results of a study (setting columns, rep, estimator, metric, value), a folder for each setting: those of the results are replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*setting).parquet(path)


def run_missing(spark: SparkSession, path: str, grid: DataFrame, setting: list[str], study: Callable[[DataFrame], DataFrame]) -> int:
    """Run a study for the settings of a grid that have no stored results, and add its results to them: how many settings were run."""
    lacking = grid.select(*setting).distinct() if not _exists(spark, path) else load_results(spark, path, grid, setting)[1]
    n = lacking.count()
    if n:
        save_results(study(lacking), path, setting)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:  # no folder yet, or none with results
        return False


def load_results(spark: SparkSession, path: str, grid: DataFrame, setting: list[str]) -> tuple[DataFrame, DataFrame]:
    """Results of the settings of a grid, and the settings that have none."""
    results = spark.read.parquet(path)
    return results.join(grid.select(*setting).distinct(), setting, "left_semi"), missing_settings(grid, results, setting)


def settings_summary(results: DataFrame, setting: list[str]) -> DataFrame:
    """Mean and median of each metric by setting and estimator, numbers only."""
    from ravelin.operators.selection import metric_summary

    return metric_summary(results, [*setting, "estimator", "metric"])


def save_tensors(tensors: DataFrame, path: str) -> None:
    """Packed tensors (subject, x), or labelled objects, as Parquet; read them back with load_tensors."""
    tensors.write.mode("overwrite").parquet(path)


def load_tensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def feature_places(features: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordinals (j, name) of wanted names, and the names that the list lacks, for a warning. Both are as long as a table is wide."""
    return features.join(wanted.select("name").distinct(), "name", "left_semi").select("j", "name"), wanted.select("name").distinct().join(features, "name", "left_anti")


def screening_report(pairs: DataFrame, below: float = 0.8, most: int = 10) -> DataFrame:
    """Features by rank with whether they are candidates and among the most independent: the report of a screening as a table."""
    from ravelin.operators.features import ranked

    return ranked(pairs).withColumns({"candidate": F.col("max_abs_corr") < below, "among_first": F.col("rank") <= most})
