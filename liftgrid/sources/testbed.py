"""A randomized experiment derived from the star-schema test tables.

One unit per line item. Treatment and outcomes come from digests of the unit key, so any engine
derives the same rows. The true effect is 0 except where ``f0 > 40``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftgrid.spec import ExperimentSpec

SPEC = ExperimentSpec(features=tuple(f"f{i}" for i in range(8)))

EXPERIMENT_SQL = """
SELECT md5(k) AS unit_id, treatment,
  CASE WHEN substr(md5(k || ':v'),1,8) < CASE WHEN treatment = 1 AND f0 > 40 THEN '26666666' ELSE '0f5c28f5' END THEN 1 ELSE 0 END AS visit,
  CASE WHEN substr(md5(k || ':c'),1,8) < CASE WHEN treatment = 1 AND f0 > 40 THEN '0f5c28f5' ELSE '051eb851' END THEN 1 ELSE 0 END AS conversion,
  CASE WHEN treatment = 1 AND substr(md5(k || ':e'),1,8) < '08000000' THEN 1 ELSE 0 END AS exposure,
  f0, f1, f2, f3, f4, f5, f6, f7
FROM (
  SELECT b.*, CASE WHEN substr(md5(k || ':t'),1,8) < 'd9999999' THEN 1 ELSE 0 END AS treatment
  FROM (
    SELECT CAST(l.l_orderkey AS VARCHAR(20)) || ':' || CAST(l.l_linenumber AS VARCHAR(20)) || ':' ||
           CAST(l.l_partkey AS VARCHAR(20)) || ':' || CAST(l.l_suppkey AS VARCHAR(20)) || ':' ||
           CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)) AS k,
           l.l_quantity AS f0, l.l_extendedprice AS f1, l.l_discount AS f2, l.l_tax AS f3,
           o.o_totalprice AS f4, CAST(p.p_size AS DOUBLE) AS f5, p.p_retailprice AS f6, c.c_acctbal AS f7
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN customer c ON o.o_custkey = c.c_custkey
  ) b
) t
"""


#: Orders beyond which their customers are joined first. Large joins shuffle both sides, so line items, the widest and longest,
#: then shuffle twice and not three times. Fewer orders are joined in the written order, which keeps the layout of small tables.
FEW_ORDERS = 1_000_000


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def experiment(spark: SparkSession, folder: str) -> DataFrame:
    """The experiment frame over the tables in ``folder``."""
    bound = read_tables(spark, folder, "lineitem", "orders", "part", "customer")
    cores = spark.sparkContext.defaultParallelism
    if bound["lineitem"].rdd.getNumPartitions() < cores:
        # A table in few files would leave the digests of all units to few tasks.
        bound["lineitem"] = bound["lineitem"].repartition(cores)
    text = EXPERIMENT_SQL
    if bound["orders"].count() > FEW_ORDERS:
        orders, customer = bound["orders"], bound.pop("customer")
        known = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        bound["orders"] = known.select("o_orderkey", "o_totalprice", "c_acctbal")
        text = text.replace("    JOIN customer c ON o.o_custkey = c.c_custkey\n", "").replace("c.c_acctbal", "o.c_acctbal")
    for n in bound:
        text = text.replace(f" {n} ", f" {{{n}}} ")
    return spark.sql(text, **bound)
