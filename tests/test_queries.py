"""Every query of the catalogue against its SQL at the smallest scale, and hand-computed cases."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memoquarry import catalogue
from memoquarry.functions import text as T
from memoquarry.operators import decay, graph, replay

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(getattr(v, "item", lambda v=v: v)()) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())


def one(spark, text, column):
    df, p = T.Parts.of(spark.createDataFrame([(text,)], "text string"))
    return df.select(column(p)).first()[0]


@pytest.mark.parametrize("text, score", [("hi", 0.0), ("  thanks ", 0.0), ("hi there", 0.0)])
def test_noise_has_no_importance(spark, text, score):
    assert one(spark, text, T.importance) == score


def test_importance_of_a_decision(spark):
    # one intent of 1.5 counts 2/3 of 0.25; no facts, no request, no action; the rest is density
    text = "we decided to adopt kafka"
    assert one(spark, text, T.importance) == pytest.approx(0.25 / 1.5 + 0.15 * one(spark, text, T.density))


def test_tokens_of_mixed_scripts(spark):  # both characters of the first word are stop words
    assert one(spark, "我们 use PostgreSQL a 数据库", lambda p: p.tokens) == ["use", "postgresql", "数", "据", "库"]


def test_cosine_of_a_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(T.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


@pytest.mark.parametrize("seconds, power", [(29, 0), (30, 1), (61, 2)])
def test_cold_start(spark, seconds, power):
    assert spark.range(1).select(decay.cold_start(F.lit(1.0), F.lit(seconds))).first()[0] == pytest.approx(0.95**power)


def test_decay_equals_a_step_loop(spark):
    times = [0.0, 5.0, 7.0, 30.0]
    df = spark.createDataFrame([(1, i, t, i == 0) for i, t in enumerate(times)], "slot int, i int, t double, touch boolean")
    got = [r.activation for r in decay.trajectories(df, "slot", "i", "t", "touch", 0.9, 60.0).orderBy("i").collect()]
    a, want = 1.0, [1.0]
    for t in times[1:]:
        a *= 0.9 * 2 ** (-t / (60.0 * 1.5))
        want.append(a)
    assert got == pytest.approx(want)


def test_search_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1)], "src string, dst string, weight int")
    edges = edges.withColumn("type", F.lit("t"))
    found = graph.neighbourhood(edges, spark.createDataFrame([("a",)], "node string"), 3).filter("type <> ''")
    assert sorted(map(tuple, found.select("node", "depth").collect())) == [("b", 1), ("c", 2)]
    paths = graph.shortest_paths(edges, spark.createDataFrame([("a", "c"), ("a", "a"), ("c", "a")], "start string, goal string"))
    assert sorted((r.start, r.goal, r.length) for r in paths.collect()) == [("a", "a", 0), ("a", "c", 2)]


def test_a_full_state_rejects_and_a_weak_slot_is_replaced():
    slots = replay.empty_slots(1)
    assert replay.step(slots, "first", 0.9, False, ["a"])[:2] == ("new", 0)
    assert replay.step(slots, "second", 0.9, False, ["b"])[:2] == ("reject", -1)
    slots[0]["a"] = 0.5
    assert replay.step(slots, "third", 0.9, False, ["c"])[:2] == ("overwrite", 0)


def test_stream_equals_batch(spark):
    batch, stream = (catalogue.QUERIES[n](spark, SF).toPandas() for n in ("state_replay", "stream_replay"))
    assert rows(batch) == rows(stream)
