"""Driver tables and the ``receivables`` view built on them.

One row per ``lineitem``.  The two large joins (lineitem-orders, then
customer / part / supplier) are left to Catalyst + AQE; only the geography
tables (nation x region, 25 rows by definition of the schema) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears import constants as K
from arrears.session import ensure_parallelism

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """What names the tables' present state: application, folder, and each entry's size and
    time, so results kept for a folder are not used for new data in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir.rstrip("/"))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"),
            *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", "n_name", F.col("r_name")))


def receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoice table (reference names in brackets in FIXTURES.md §2)."""
    li = ensure_parallelism(table(spark, sf_dir, "lineitem"))
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer")
    supp = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    geo = F.broadcast(geography(spark, sf_dir))  # 25 rows: fixed by schema
    cgeo = geo.select(F.col("n_nationkey").alias("c_nk"), F.col("n_name").alias("c_nation"),
                      F.col("r_name").alias("c_region"))
    sgeo = geo.select(F.col("n_nationkey").alias("s_nk"), F.col("r_name").alias("s_region"))

    # customers meet the orders, a quarter of the rows, before the lines do
    sold = (orders.join(cust, F.col("o_custkey") == cust.c_custkey)
            .join(cgeo, F.col("c_nationkey") == F.col("c_nk")))
    j = (li.join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(supp, F.col("l_suppkey") == supp.s_suppkey)
         .join(sgeo, F.col("s_nationkey") == F.col("s_nk"))
         .join(part, F.col("l_partkey") == part.p_partkey))
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).alias("age_days"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("balance"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.when(F.col("c_mktsegment") == K.FIXTURE_NON_GROUP_SEGMENT, F.lit(K.NON_GROUP))
         .otherwise(F.col("c_mktsegment")).alias("customer_group"),
        F.col("s_name").alias("salesperson"),
        F.col("p_brand").alias("division"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("SIZE-"), F.col("p_size").cast("string")).alias("subcategory"),
        F.col("s_region").alias("branch"),
        F.col("c_region").alias("province"),
        F.col("c_nation").alias("city"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("c_nation"), F.lit("-"),
                             (F.col("c_custkey") % 7).cast("string"))).alias("district"),
        F.lit(None).cast("string").alias("subdistrict"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("remark"),
    )
