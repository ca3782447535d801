"""The driver tables and the roles they play for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import dealt


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df

    # -- entity roles ---------------------------------------------------------------------------------------------
    def objects(self) -> DataFrame:
        """Suppliers as observed objects with a derived position; ids below 9 are the ones without measurements."""
        key = F.col("s_suppkey")
        return self.supplier.select(
            key.alias("seq"),
            F.col("s_name").alias("objid"),
            F.pmod(key * 37, F.lit(360)).cast("double").alias("ra"),
            (F.pmod(key * 17, F.lit(180)) - 90).cast("double").alias("dec"),
            "s_nationkey",
            "s_acctbal",
        )

    def papers(self) -> DataFrame:
        return self.part.select(refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"), "*")

    def edge_keys(self) -> DataFrame:
        """Distinct (s_suppkey, p_partkey) pairs of all line items: the object-paper edges on the raw keys."""
        pairs = self.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
        return dealt(pairs, "p_partkey", "s_suppkey").distinct()

    def edges(self) -> DataFrame:
        """(objid, refcode) edges."""
        return (
            self.edge_keys()
            .join(self.part.select("p_partkey", "p_brand"), "p_partkey")
            .join(self.supplier.select("s_suppkey", F.col("s_name").alias("objid")), "s_suppkey")
            .select("objid", refcode(F.col("p_partkey"), F.col("p_brand")).alias("refcode"))
        )

    def bands(self) -> DataFrame:
        """Seven bands with gaps, from the first seven components of a vector."""
        cols = [
            F.when(F.pmod(F.col("vec_id") + i, F.lit(3)) != 0, F.get("embedding", F.lit(i)).cast("double")).alias(b)
            for i, b in enumerate(BANDS)
        ]
        return self.embeddings.select("vec_id", *cols)

    def measures(self) -> DataFrame:
        """Line items with a tax that is missing on every seventh order."""
        return self.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            F.when(F.pmod("l_orderkey", F.lit(7)) != 0, F.col("l_tax")).alias("l_tax"),
        )

    def ab(self) -> DataFrame:
        """(experiment, variant, value): ten experiments by user, every event in the variant that its number gives."""
        return self.events.select(
            F.pmod("user_id", F.lit(10)).alias("experiment"),
            F.when(F.pmod("event_id", F.lit(2)) == 0, "A").otherwise("B").alias("variant"),
            "event_id",
            "value",
        )


# Tables whose rows are costly to work on.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a text table that fits into fewer files than there are cores one partition per core; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def in_order(df: DataFrame, key: str) -> DataFrame:
    """The rows in ranges of the key, one per core at least: what is derived from a row stays in its range."""
    spark = df.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(ranges, key)


BANDS = ["u", "b", "v", "g", "r", "i", "z"]


def refcode(partkey: Column, brand: Column) -> Column:
    return F.concat(F.lpad(partkey.cast("string"), 8, "0"), brand)


# SQL forms of the same roles, for the twins.
SQL_OBJECTS = """(select s_suppkey as seq, s_name as objid, ((s_suppkey*37) % 360)::double as ra,
 (((s_suppkey*17) % 180) - 90)::double as "dec", s_nationkey, s_acctbal from supplier)"""
SQL_EDGE_KEYS = "(select distinct l_suppkey as s_suppkey, l_partkey as p_partkey from lineitem)"
SQL_REFCODE = "lpad(p_partkey::varchar, 8, '0') || p_brand"
SQL_EDGES = f"""(select s_name as objid, {SQL_REFCODE} as refcode from {SQL_EDGE_KEYS} k
 join part using (p_partkey) join supplier using (s_suppkey))"""
SQL_BANDS = (
    "(select vec_id, "
    + ", ".join(f"case when (vec_id + {i}) % 3 <> 0 then embedding[{i + 1}]::double end as {b}" for i, b in enumerate(BANDS))
    + " from embeddings)"
)
SQL_MEASURES = """(select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount,
 case when l_orderkey % 7 <> 0 then l_tax end as l_tax from lineitem)"""
SQL_AB = """(select user_id % 10 as experiment, case when event_id % 2 = 0 then 'A' else 'B' end as variant,
 event_id, value from events)"""
