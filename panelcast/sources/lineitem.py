"""Binding of the star-schema tables to the shape of a fact table.

Supplier stands for the parameter set, line number for the simulation, ship date for the day.
Covariates depend on the supplier alone, so they stay in a table of one row per supplier and meet
the rows only after these are aggregated to windows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec

EPOCH = datetime.date(1995, 1, 1)

# The columns read, with their stored types.
LINEITEM_COLUMNS = (
    "l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
)
SUPPLIER_COLUMNS = "s_suppkey bigint, s_nationkey int, s_acctbal double"
NATION_COLUMNS = "n_nationkey int, n_regionkey int"

LINEITEM_SPEC = PanelSpec(
    prevalence_counts=("returned_qty", "total_qty"),
    cases_counts=("returned_lines", "total_qty"),
    statics=("s_acctbal", "s_nationkey", "n_regionkey"),
    gated=("n_regionkey",),
    min_prevalence=0.2,
    min_cases=12.0,
    burn_in=728,
    intervention=1456,
    window=28,
    cyclic_time=True,
    lookback=13,
    batch_size=64,
    seed=42,
)
#: For the operators that sample: four of a supplier's seven line numbers.
SAMPLED_SPEC = LINEITEM_SPEC.with_(sims_per_param=4)


def lineitem_facts(spark: SparkSession, sf_dir: str, spec: PanelSpec = LINEITEM_SPEC,
                   after_burn_in: bool = False) -> DataFrame:
    """Order lines as daily facts.

    ``after_burn_in`` adds the burn-in bound on the stored date, which the Parquet scan can use;
    the bound on the derived day number cannot be pushed down.
    """
    lines = spark.read.schema(LINEITEM_COLUMNS).parquet(f"{sf_dir}/lineitem.parquet")
    if after_burn_in:
        first = datetime.datetime.combine(EPOCH, datetime.time()) + datetime.timedelta(spec.burn_in)
        lines = lines.filter(F.col("l_shipdate") >= F.lit(first.isoformat(" ")).cast("timestamp_ntz"))
    returned = F.col("l_returnflag") == "R"
    return lines.select(
        F.col("l_suppkey").alias(spec.param),
        F.col("l_linenumber").cast("bigint").alias(spec.sim),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias(spec.global_id),
        F.datediff("l_shipdate", F.lit(EPOCH)).cast("bigint").alias(spec.day),
        F.when(returned, F.col("l_quantity")).otherwise(0.0).alias("returned_qty"),
        F.when(returned, 1.0).otherwise(0.0).alias("returned_lines"),
        F.col("l_quantity").alias("total_qty"),
    )


def supplier_statics(spark: SparkSession, sf_dir: str, spec: PanelSpec = LINEITEM_SPEC) -> DataFrame:
    """Covariates, one row per supplier."""
    suppliers = spark.read.schema(SUPPLIER_COLUMNS).parquet(f"{sf_dir}/supplier.parquet")
    nations = spark.read.schema(NATION_COLUMNS).parquet(f"{sf_dir}/nation.parquet")
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        F.col("s_suppkey").alias(spec.param),
        "s_acctbal",
        F.col("s_nationkey").cast("double").alias("s_nationkey"),
        F.col("n_regionkey").cast("double").alias("n_regionkey"),
    )
