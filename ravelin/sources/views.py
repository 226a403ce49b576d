"""The shared tables seen as subjects, slides and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.runtime import table

#: Features of the dense view, in their order.
DENSE = ("quantity", "price", "discount", "tax")


def dense_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: supplier > line status > item; returned items play the excluded tissue; a fixed rule gives the cluster."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("subject"), F.col("l_linestatus").alias("slide"), (F.col("l_returnflag") == "A").cast("int").alias("excluded"),
        F.when(F.col("l_quantity") <= 25, 1).otherwise(2).alias("label"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def dense_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_acctbal").alias("y"))


def sparse_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: customer > parity of the year > order; many customers have one slide only, many slides an empty cluster."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("subject"), (F.year("o_orderdate") % 2).cast("string").alias("slide"), F.lit(0).alias("excluded"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("label"), F.col("o_totalprice").alias("total"))


def sparse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("y"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one column for each component, with three made to depend on others so that pruning has work."""
    e = table(spark, sf_dir, "embeddings")
    v = [F.get("embedding", i).cast("double").alias(f"e{i:02d}") for i in range(64)]
    w = e.select(F.col("vec_id").alias("subject"), "label", *v)
    return w.withColumns({"x1": F.col("e00") * 2 + F.col("e01") * 0.1, "x2": F.col("e00") - F.col("e02") * 0.05, "x3": -F.col("e10") + F.col("e11") * 0.2})
