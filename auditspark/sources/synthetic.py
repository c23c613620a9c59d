"""Synthetic transactions with known entities, index events, counters and missingness.

Distributions and invariants are what matters: day - D1 is constant for an entity,
counters never fall, labels stay positive after the index event, services' columns are
missing together, and identity data covers a minority of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.config import DAY
from auditspark.operators.protocol import exact_rank

#: Columns V1.. of each service; a regime is the set of services without data.
SERVICES = (11, 23, 18, 22, 20, 16)
REGIMES = (0b000000, 0b000001, 0b000110, 0b011000, 0b111000)
FIRST_ID = 2_987_000


def _u(*salt) -> F.Column:
    """Uniform in [0, 1) from a hash, so that any task gives the same rows again."""
    return F.pmod(F.xxhash64(*salt), F.lit(1 << 40)) / float(1 << 40)


def generate(spark: SparkSession, entities: int = 3000, days: int = 180, compromised: float = 0.06, identity_share: float = 0.24, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transaction, identity, truth)."""
    e = spark.range(entities).withColumnRenamed("id", "true_entity")

    def u(name: str, *more: str) -> F.Column:
        return _u("true_entity", *more, F.lit(name), F.lit(seed))

    e = e.withColumns({
        "first": F.floor(u("first") * days * 0.7), "n": (1 + F.floor(-F.log(1 - u("n")) * 4)).cast("int"),
        "base": F.exp(3.5 + u("base") * 2), "fraudulent": u("fraud") < compromised, "regime": F.floor(u("regime") * len(REGIMES)).cast("int"),
        "card1": (1000 + F.floor(u("card1") * 17000)).cast("int"), "card2": 100.0 + F.floor(u("card2") * 500), "card3": F.lit(150.0),
        "card4": F.element_at(F.array(*map(F.lit, ("visa", "mastercard", "discover"))), (1 + F.floor(u("card4") * 3)).cast("int")),
        "card5": 100.0 + F.floor(u("card5") * 137), "card6": F.when(u("card6") < 0.7, "debit").otherwise("credit"),
        "addr1": 100.0 + F.floor(u("addr1") * 440), "addr2": F.lit(87.0), "dist1": F.floor(u("dist1") * 300) + 0.0,
        "P_emaildomain": F.concat(F.lit("mail"), F.floor(u("mail") * 12).cast("string"), F.lit(".example")),
    })
    x = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    v = lambda name: u(name, "k")
    x = x.withColumn("TransactionDT", (F.least(F.col("first") + F.when(F.col("k") == 0, 0).otherwise(F.floor(v("day") * days * 0.3)), F.lit(days - 1)) * DAY + F.floor(v("second") * DAY)).cast("long"))
    order = Window.partitionBy("true_entity").orderBy("TransactionDT", "k")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"within": (F.row_number().over(order) - 1).cast("int"), "TransactionAmt": F.round(F.col("base") * F.exp(v("amt") - 0.5), 2), "day": F.floor(F.col("TransactionDT") / DAY).cast("int")})
    x = x.withColumn("index_at", F.floor(u("index") * F.col("n")).cast("int"))
    fraud = F.col("fraudulent") & (F.col("within") >= F.col("index_at"))
    x = x.withColumns({
        "isFraud": fraud.cast("int"), "is_index": F.col("fraudulent") & (F.col("within") == F.col("index_at")),
        "D1": (F.col("day") - F.min("day").over(Window.partitionBy("true_entity"))).cast("double"),
        "D3": (F.col("day") - F.lag("day").over(order)).cast("double"),
        "R_emaildomain": F.when(v("remail") >= 0.7, F.col("P_emaildomain")), "ProductCD": F.element_at(F.array(*map(F.lit, "WCRHS")), (1 + F.floor(v("product") * 5)).cast("int")),
    })
    x = x.withColumns({"D2": F.when(F.col("D1") != 0, F.col("D1")), "D15": F.col("D1"), **{f"C{i}": F.sum(F.when(v(f"c{i}") < 0.5 + i / 40, 1).otherwise(0)).over(running).cast("double") for i in range(1, 15)}, **{f"M{i}": F.when(v(f"m{i}") >= 0.25, F.when(v(f"mv{i}") < 0.5, "T").otherwise("F")) for i in range(1, 10)}})
    mask = F.element_at(F.array(*map(F.lit, REGIMES)), F.col("regime") + 1)
    columns, at = {}, 0
    for s, size in enumerate(SERVICES):
        for _ in range(size):
            at += 1
            columns[f"V{at}"] = F.when(mask.bitwiseAND(F.lit(1 << s)) == 0, F.round(v(f"v{at}") * 10, 3))
    x = x.withColumns(columns)
    x = exact_rank(x, F.col("TransactionDT"), F.col("true_entity"), F.col("k")).withColumn("TransactionID", FIRST_ID + 1 + F.col("rank"))
    txn = x.select("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "dist1", "P_emaildomain", "R_emaildomain", "D1", "D2", "D3", "D15", *(f"C{i}" for i in range(1, 15)), *(f"M{i}" for i in range(1, 10)), *columns)
    ident = x.where(v("identity") < identity_share).select(
        "TransactionID", (v("id1") * -100).alias("id_01"), (v("id2") * 1e5).alias("id_02"), F.concat(F.lit("os"), F.floor(u("id30") * 6).cast("string")).alias("id_30"),
        F.concat(F.lit("browser"), F.floor(u("id31") * 9).cast("string")).alias("id_31"), F.concat(F.lit("screen"), F.floor(u("id33") * 7).cast("string")).alias("id_33"),
        F.when(u("device") < 0.6, "desktop").otherwise("mobile").alias("DeviceType"), F.concat(F.lit("device"), F.floor(u("info") * 40).cast("string")).alias("DeviceInfo"),
    )
    truth = x.select("TransactionID", "true_entity", "is_index", F.col("regime").alias("true_regime"), "within")
    return txn, ident, truth


def invariants(txn: DataFrame, ident: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sizes, and how often an invariant of the generator is broken (never)."""
    x = txn.join(truth, "TransactionID")
    per = x.groupBy("true_entity").agg(F.count_distinct(F.floor(F.col("TransactionDT") / DAY) - F.col("D1")).alias("keys"))
    chain = Window.partitionBy("true_entity").orderBy("within")
    steps = x.select("isFraud", F.lag("isFraud").over(chain).alias("before"), *(F.col(f"C{i}") for i in (1, 14)), *(F.lag(f"C{i}").over(chain).alias(f"b{i}") for i in (1, 14)))
    falls = steps.agg(F.coalesce(F.sum((F.col("isFraud") < F.col("before")).cast("long")), F.lit(0)).alias("label_falls"), F.coalesce(F.sum(((F.col("C1") < F.col("b1")) | (F.col("C14") < F.col("b14"))).cast("long")), F.lit(0)).alias("counter_falls"))
    sizes = x.agg(F.count("*").alias("n_rows"), F.count_distinct("true_entity").alias("n_entities"), F.avg(F.col("isFraud").cast("double")).alias("fraud_rate"))
    some = ident.agg(F.count("*").alias("n_identity"))
    broken = per.agg(F.sum((F.col("keys") != 1).cast("long")).alias("day_key_breaks"))
    return sizes.crossJoin(some).crossJoin(broken).crossJoin(falls).select("*", (F.col("n_identity") / F.col("n_rows")).alias("identity_coverage"))  # single rows


def write(spark: SparkSession, folder: str, **parameters) -> DataFrame:
    """Writes the three frames as CSV; returns their summary."""
    frames = generate(spark, **parameters)
    for name, df in zip(("train_transaction", "train_identity", "truth"), frames, strict=True):
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    return invariants(*frames)
