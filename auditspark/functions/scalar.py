"""Column expressions: time parts, amounts, keys, guards and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.config import DAY

MISSING = "nan"


def day(t: Column) -> Column:
    """Days since the origin of second counts."""
    return F.floor(t / DAY).cast("int")


def hour(t: Column) -> Column:
    return (F.pmod(F.floor(t / 3600), F.lit(24))).cast("int")


def weekday(t: Column) -> Column:
    return F.pmod(day(t), F.lit(7)).cast("int")


def with_time_and_amount(df: DataFrame, t: str = "t", amount: str = "amount") -> DataFrame:
    """Adds day, hour, dow, odd_hour, log_amt, amt_cents and amt_is_round."""
    cents = F.pmod(F.round(F.col(amount) * 100).cast("long"), F.lit(100)).cast("double")
    return df.withColumns(
        {
            "day": day(F.col(t)),
            "hour": hour(F.col(t)),
            "dow": weekday(F.col(t)),
            "odd_hour": ((hour(F.col(t)) < 6) | (hour(F.col(t)) >= 22)).cast("int"),
            "log_amt": F.log1p(F.col(amount)),
            "amt_cents": cents,
            "amt_is_round": (cents == 0).cast("int"),
        }
    )


def text_or_missing(c: Column) -> Column:
    """A missing value is a category of its own."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def composite_key(*columns: Column, sep: str = "_", missing: str = MISSING) -> Column:
    """Never null: missing parts are named."""
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit(missing)) for c in columns))


def null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total.cast("int")


def null_mask(columns: Sequence[str]) -> Column:
    """Bit i is set where ``columns[i]`` is null; more than 63 columns take a list of masks."""
    if len(columns) > 63:
        return F.array(*(null_mask(columns[i : i + 63]) for i in range(0, len(columns), 63)))
    mask = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        mask = mask.bitwiseOR(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return mask


def first_day_key(t: Column, age: Column) -> Column:
    """The day an entity was first seen, from a row's day and its age in days."""
    return F.floor(t / DAY) - age


def rounded_first_day_key(t: Column, age: Column) -> Column:
    return F.bround(F.floor(t / DAY) - age)


def block_key(recipe: Sequence[Column], row_id: Column) -> Column:
    """The recipe's parts joined; a row missing any part is a block of its own."""
    missing = F.lit(False)
    for c in recipe:
        missing = missing | c.isNull()
    joined = F.concat_ws("|", *(c.cast("string") for c in recipe))
    return F.when(missing, F.concat(F.lit("__solo_"), row_id.cast("string"))).otherwise(joined)


def close_to(a: Column, b: Column) -> Column:
    """Equality within 1e-8 plus 1e-5 of b."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def renamed(df: DataFrame) -> DataFrame:
    """Column names with ``_`` for ``-``."""
    return df.toDF(*(c.replace("-", "_") for c in df.columns))


def factorized(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Codes by first appearance in row order; null is -1.

    The distinct values are ranked by their first rows, range by range; the rows join
    them by value, broadcast only if Spark finds them small.
    """
    from auditspark.operators.protocol import exact_rank

    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first"))
    codes = exact_rank(first, F.col("_first")).select(column, F.col("rank").cast("int").alias(out))
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def matrix(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``row_id`` and these columns as numbers: text and times as codes by first appearance (-1 for null), truth values as 0 and 1, infinities null."""
    out = df.select(row_id, *columns)
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        if kind in ("string", "timestamp", "timestamp_ntz", "date"):
            out = factorized(out, c, row_id, f"_code_{c}").drop(c).withColumnRenamed(f"_code_{c}", c)
    return out.select(row_id, *(finite_or_null(F.col(c).cast("double")).alias(c) for c in columns))


def family(c: Column) -> Column:
    """The feature family of a column name."""
    def numbered(letter: str) -> Column:
        return c.rlike(f"^{letter}[0-9]+$")

    return (
        F.when(c.startswith("risk_") | c.startswith("riskn_"), "association_risk")
        .when(c.startswith("mem_"), "entity_memory")
        .when(c.startswith("vel_"), "velocity")
        .when(c.startswith("miss_") | c.isin("nan_count", "regime", "miss_density"), "missingness")
        .when(c.startswith("card") | c.startswith("addr") | c.isin("bin_proxy", "ProductCD_card4"), "identity_proxy")
        .when(numbered("D"), "D_columns")
        .when(numbered("C"), "C_columns")
        .when(numbered("V"), "V_columns")
        .when(numbered("M"), "M_columns")
        .when(c.startswith("id_") | c.isin("DeviceType", "DeviceInfo"), "id_columns")
        .otherwise("behaviour")
    )


def forbidden_features(columns: Sequence[str]) -> list[str]:
    """Columns that identify entities or labels and may never be features."""
    banned = {"entity", "uid", "D1n", "D15n", "true_entity", "isFraud", "y", "is_index"}
    return sorted(banned & set(columns))


def assert_label_free(df: DataFrame) -> None:
    if found := forbidden_features(df.columns):
        raise ValueError(f"columns that may not be features: {', '.join(found)}")
