"""Sources of Lexis cells: micro-data, wide matrices and simulation grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import cohort_index

AGES, PERIODS, PER_AGE = 10, 14, 2
COHORTS = PER_AGE * (AGES - 1) + PERIODS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_from_events(events: DataFrame, age: Column, period: Column, is_case: Column, by: dict[str, Column] | None = None, n_ages: int = AGES, per_age: int = PER_AGE) -> DataFrame:
    """Count micro-data into (series, age, period) cells; one partial and one final aggregation."""
    keys = [c.alias(k) for k, c in (by or {}).items()]
    rows = events.select(*keys, age.cast("int").alias("age_idx"), period.cast("int").alias("period_idx"), is_case.alias("_case"))
    out = rows.groupBy(*(by or {}), "age_idx", "period_idx").agg(F.count("*").alias("population"), F.count(F.when(F.col("_case"), 1)).alias("cases"))
    return out.withColumn("cohort_idx", cohort_index("age_idx", "period_idx", n_ages, per_age))


def shipment_cells(spark: SparkSession, sf_dir: str, by: dict[str, Column] | None = None) -> DataFrame:
    """Returned line items by size group of the part (age) and half-year of shipping (period)."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    rows = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    period = (F.year("l_shipdate") - 1995) * 2 + F.when(F.month("l_shipdate") > 6, 2).otherwise(1)
    return cells_from_events(rows, F.floor((F.col("p_size") - 1) / 5) + 1, period, F.col("l_returnflag") == "R", by)


def cells_from_matrices(spark: SparkSession, cases: list[list[int]], population: list[list[int]], per_age: int, series_id: str = "all") -> DataFrame:
    """Long cells from periods x ages matrices (rows are periods)."""
    if len(cases) != len(population) or any(len(a) != len(b) for a, b in zip(cases, population)):
        raise ValueError("cases and population differ in shape")
    n_ages = len(cases[0])
    rows = [(series_id, i + 1, j + 1, (n_ages - i - 1) * per_age + j + 1, int(population[j][i]), int(cases[j][i])) for j in range(len(cases)) for i in range(n_ages)]
    return spark.createDataFrame(rows, "series_id string, age_idx int, period_idx int, cohort_idx int, population bigint, cases bigint")


def matrix(cells: DataFrame, value: str, n_ages: int, by_period: bool = True) -> DataFrame:
    """A wide table of ``value``: a row a period and a column an age group (a1, a2, ...), or a row an age group and columns p1, p2, ..."""
    row, column, letter = ("period_idx", "age_idx", "a") if by_period else ("age_idx", "period_idx", "p")
    n = range(1, n_ages + 1) if by_period else sorted(r[0] for r in cells.select("period_idx").distinct().collect())
    return cells.groupBy(row).agg(*[F.max(F.when(F.col(column) == k, F.col(value))).alias(f"{letter}{k}") for k in n])


def grid(spark: SparkSession, n_ages: int, n_periods: int, per_age: int) -> DataFrame:
    """All (age, period) cells of a Lexis diagram."""
    ages = spark.range(1, n_ages + 1).select(F.col("id").cast("int").alias("age_idx"))
    out = ages.withColumn("period_idx", F.explode(F.sequence(F.lit(1), F.lit(n_periods))))
    return out.withColumn("cohort_idx", cohort_index("age_idx", "period_idx", n_ages, per_age))


def densify(cells: DataFrame, n_ages: int, n_periods: int, per_age: int) -> DataFrame:
    """Every cell of the diagram, missing ones with population and cases 0."""
    full = grid(cells.sparkSession, n_ages, n_periods, per_age)
    have = cells.select("age_idx", "period_idx", "population", "cases")
    return full.join(have, ["age_idx", "period_idx"], "left").na.fill(0, ["population", "cases"])


def validate(cells: DataFrame, n_ages: int, n_periods: int, per_age: int) -> DataFrame:
    """Counts of rule violations (all 0 for a valid table), in one aggregation."""
    y, n = F.col("cases"), F.col("population")
    outside = ~(F.col("age_idx").between(1, n_ages) & F.col("period_idx").between(1, n_periods))
    bad = {
        "n_null": y.isNull() | n.isNull() | F.col("age_idx").isNull() | F.col("period_idx").isNull(),
        "n_negative": (y < 0) | (n < 0),
        "n_more_cases": y > n,
        "n_outside": outside,
    }
    return cells.agg(
        *[F.count(F.when(c, 1)).alias(k) for k, c in bad.items()],
        (F.lit(n_ages * n_periods) - F.count_distinct(F.when(~outside, F.struct("age_idx", "period_idx")))).cast("long").alias("n_missing"),
        (F.count("*") - F.count_distinct("age_idx", "period_idx")).cast("long").alias("n_repeated"),
    )
