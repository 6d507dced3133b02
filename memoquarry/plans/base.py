"""Query registration, table access and the derived utterances that exercise the text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that its result is held against."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Deal the rows of a few row groups to all cores, ahead of work on texts that costs far more than to move them.

    A scan with two splits or more for each core, as large tables have, stays as it is and is not shuffled.  ``scan``: what ``rows`` were
    chosen from, where that is more.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if (rows if scan is None else scan).rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores)


def r6(x: Column) -> Column:
    return F.round(x, 6)


#: One sentence for each row of a star table, its template chosen by key; portable SQL.
UTTERANCES = """
SELECT p_partkey * 10 + 1 AS utt_id, 'part' AS ns, CASE p_partkey % 4
  WHEN 0 THEN concat('We decided to adopt ', p_brand, ' for the new pipeline')
  WHEN 1 THEN concat('Maybe later we choose ', p_brand, ', not sure yet')
  WHEN 2 THEN concat('I prefer ', p_brand, ' and recommend it over ', p_name)
  ELSE concat('Service', CAST(p_partkey AS STRING), ' depends on Store', CAST(p_size AS STRING)) END AS text FROM {part}
UNION ALL SELECT s_suppkey * 10 + 2, 'supplier', CASE s_suppkey % 3
  WHEN 0 THEN concat('Actually that is wrong, the port: ', CAST(1000 + s_suppkey % 9000 AS STRING), ' is right')
  WHEN 1 THEN concat('Gateway', CAST(s_suppkey AS STRING), ' runs on Node', CAST(s_nationkey AS STRING))
  ELSE concat('from Old', CAST(s_suppkey AS STRING), ' migrate to New', CAST(s_nationkey AS STRING)) END FROM {supplier}
UNION ALL SELECT c_custkey * 10 + 3, 'customer', concat('Remember: ', c_name, ' is at 10.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 200 AS STRING), '.7, mail c', CAST(c_custkey AS STRING), '@example.com') FROM {customer}
UNION ALL SELECT o_orderkey * 10 + 4, 'orders', CASE o_orderkey % 4
  WHEN 0 THEN concat('We need to ship order ', CAST(o_orderkey AS STRING), ' by friday')
  WHEN 1 THEN concat('docker run --rm -d app', CAST(o_orderkey AS STRING), ' -f conf.yaml | tee out.sh')
  WHEN 2 THEN concat('what is the state of order ', CAST(o_orderkey AS STRING), '?')
  ELSE concat('how did it fail? because the disk of order ', CAST(o_orderkey AS STRING), ' was full') END FROM {orders}
UNION ALL SELECT n_nationkey * 10 + 5, 'nation', CASE n_nationkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN ' thanks ' WHEN 2 THEN 'hi there' WHEN 3 THEN '我们决定使用数据库 Redis，以后再说怎么部署' ELSE '記録を覚えて 3 GB' END FROM {nation}
UNION ALL SELECT (l_orderkey * 8 + l_linenumber) * 10 + 6, 'lineitem', CASE l_linenumber % 5
  WHEN 0 THEN concat('Revenue was $', CAST(l_partkey AS STRING), ' with 12% margin, audit the account and the risk report')
  WHEN 1 THEN concat('The contract clause ', CAST(l_suppkey AS STRING), ' binds the party, evidence within 30 days')
  WHEN 2 THEN concat('Dose 50 mg for the chronic disease, blood pressure 120/80, bed ', CAST(l_suppkey AS STRING))
  WHEN 3 THEN concat('The client wants a quote for deal ', CAST(l_partkey AS STRING), ', follow up with a demo')
  ELSE concat('The hero and his rival meet in the village, scene ', CAST(l_partkey AS STRING)) END FROM {lineitem}
"""
STARS = ("part", "supplier", "customer", "orders", "nation", "lineitem")
UTTERANCES_SQL = UTTERANCES.format(**{t: t for t in STARS})


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, ns, text)."""
    return spread(spark.sql(UTTERANCES, **{t: read(spark, sf_dir, t) for t in STARS}))
