"""The tables of a star schema in the roles of recordings: who plays patients, sessions, annotations, windows, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["quantity", "price", "discount", "tax"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CLASSES = ("a", "n", "r")
#: Line numbers and flags stand for electrode pairs and metrics.
PAIRS = ["Fp1-F7_entropy", "F7-T3_entropy", "C3-Cz_entropy", "Pz-O2_entropy"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def patients(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("patient_num_id"), (F.col("c_acctbal") / 100).alias("age"), (c % 3 + 1).cast("int").alias("gender"), (c % 4 - 1).cast("int").alias("split_final"))


PATIENTS = "(select c_custkey patient_num_id, c_acctbal/100 age, cast(c_custkey % 3 + 1 as int) gender, cast(c_custkey % 4 - 1 as int) split_final from customer)"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rate = F.substring("o_orderpriority", 1, 1).cast("int") * 128
    return table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 10 + 15).cast("int").alias("n_channels"), rate.alias("sfreq"), F.col("o_orderstatus").alias("config_type"))


SESSIONS = "(select o_custkey patient_id, cast(o_orderkey % 10 + 15 as int) n_channels, cast(substr(o_orderpriority,1,1) as int)*128 sfreq, o_orderstatus config_type from orders)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("file_path"), F.col("user_id").alias("patient_id"), F.col("event_id").alias("line_no"), start.alias("start_time"), (start + F.col("value") * 3600).alias("stop_time"), F.upper("event_type").alias("label")
    )


ANNOTATIONS = "(select cast(user_id as varchar) file_path, user_id patient_id, event_id line_no, epoch_us(ts)/1e6 start_time, epoch_us(ts)/1e6 + value*3600 stop_time, event_type as label from events)"
MAPPING = {"click": "focal", "view": "focal", "error": "generalized"}


def windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        *ROW, F.col("l_suppkey").alias("patient_id"), F.concat(F.lit(" "), F.col("l_returnflag")).alias("label"), F.lower("l_returnflag").alias("macro_class"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


WINDOWS = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey patient_id, lower(l_returnflag) macro_class, l_quantity quantity, l_extendedprice price, l_discount discount, l_tax tax from lineitem)"


#: Derived columns of a window, some with gaps, as SQL that both engines read.
WIDE = {
    "w00": "quantity", "w01": "price", "w02": "discount", "w03": "tax", "w04": "price * discount", "w05": "price * tax", "w06": "price * (1 - discount)", "w07": "quantity * discount",
    "w08": "quantity * tax", "w09": "price / quantity", "w10": "sqrt(price)", "w11": "ln(price)", "w12": "quantity * quantity", "w13": "discount * tax", "w14": "cast(l_linenumber as double)",
    "w15": "cast(l_partkey % 97 as double)", "w16": "cast(l_suppkey % 89 as double)", "w17": "cast(l_orderkey % 101 as double)", "w18": "price + 100000000.0", "w19": "quantity - l_linenumber",
    "w20": "case when l_orderkey % 7 <> 0 then quantity end", "w21": "case when l_linenumber % 3 <> 0 then price end", "w22": "case when l_orderkey % 11 = 0 then tax end", "w23": "case when discount > 0.02 then discount end",
}


def wide_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).select("macro_class", *[F.expr(x).cast("double").alias(n) for n, x in WIDE.items()])


WIDE_WINDOWS = "(select macro_class, " + ", ".join(f"cast({x} as double) {n}" for n, x in WIDE.items()) + f" from {WINDOWS})"


def montage_windows(spark: SparkSession, d: str) -> DataFrame:
    values = [F.col("quantity"), F.col("price") / 1000, F.col("quantity") * F.col("discount"), F.col("price") * F.col("tax") / 1000]
    return windows(spark, d).select("macro_class", *[v.alias(n) for v, n in zip(values, PAIRS)])


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is a recording file's channel: eight vectors a file, 64 samples at 8 Hz."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample_index", "x"))
    return v.select(
        F.floor(F.col("vec_id") / 8).cast("string").alias("file_path"), F.concat(F.lit("EEG "), F.element_at(F.array(*map(F.lit, ("FP1", "C3", "CZ", "C4", "O1", "O2", "T3", "T4"))), (F.col("vec_id") % 8 + 1).cast("int")), F.lit("-REF")).alias("channel"),
        (F.col("vec_id") % 8).cast("int").alias("channel_no"), F.col("sample_index").cast("long").alias("sample_index"), (F.col("sample_index") / 8.0).alias("t"), F.col("x").cast("double").alias("value"),
    )


SIGNALS = """(select cast(vec_id // 8 as varchar) file_path, ['FP1','C3','CZ','C4','O1','O2','T3','T4'][cast(vec_id % 8 + 1 as int)] name, cast(vec_id % 8 as int) channel_no, i sample_index, i/8.0 t, cast(embedding[i+1] as double) value
 from (select vec_id, embedding, unnest(range(0, len(embedding))) i from embeddings))"""
