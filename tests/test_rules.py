"""Literal cases of the rules, with values worked out by hand from their definitions, and the storage, plug-in and learning surface."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoquarry import config
from memoquarry.functions import lexicons as L
from memoquarry.functions import plugins
from memoquarry.functions import text as T
from memoquarry.operators import graph, learned, recall, store


def parts(spark, texts, *columns):
    df, p = T.Parts.of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    return [tuple(r)[1:] for r in df.select("i", *(c(p).alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]


CASES = [  # text, decision, preference, correction, explicit, action
    ("we PICK redis", 1, 0, 0, 0, 0),
    ("我们改用 Redis", 1, 0, 0, 0, 0),
    ("採用する", 1, 0, 0, 0, 0),
    ("변경했다", 1, 0, 0, 0, 0),
    ("I'd suggest  using tabs", 0, 1, 0, 0, 0),
    ("おすすめ", 0, 1, 0, 0, 0),
    ("not the first but the last", 0, 0, 1, 0, 0),
    ("sorry, I meant that", 0, 0, 1, 0, 0),
    ("for future reference", 0, 0, 0, 1, 0),
    ("千万别忘", 0, 0, 0, 1, 0),
    ("HACK around it by monday", 0, 0, 0, 0, 1),
    ("计划是", 0, 0, 0, 0, 1),
]


def test_families(spark):
    families = [lambda p, x=x: T.has(p.low, x).cast("int") for x in (L.DECISION, L.PREFERENCE, L.CORRECTION, L.EXPLICIT, L.ACTION)]
    assert parts(spark, [c[0] for c in CASES], *families) == [c[1:] for c in CASES]


def test_facts_are_counted(spark):
    texts = ["10.0.0.1 端口：5432", "postgres://u@h/db and a@b.io", "100 req/min, daily backup at 3am", "sudo reboot", "nothing"]
    assert [r[0] for r in parts(spark, texts, lambda p: T.fact_hits(p.low))] == [2, 2, 4, 1, 0]


def test_noise(spark):
    texts = ["ok", "  Thanks ", "回见", "oh hi there you", "think", "これはデータ"]
    assert [r[0] for r in parts(spark, texts, lambda p: p.noise)] == [True, True, True, True, True, False]


def test_questions(spark):
    texts = ["どこですか", "왜 그래", "怎样部署", "is there a plan", "whatever", "port? port 80", "port 80 ok?", "The answer: 5?"]
    got = parts(spark, texts, *(lambda p, i=i: T.question_features(p)[i].cast("int") for i in range(3)))
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 1)]


def test_relevance(spark):
    df = spark.createDataFrame([("redis port", "the redis port is 6379"), ("部署数据库", "数据库的部署"), ("a long query", "long"), ("x", ""), ("alpha beta", "beta gamma")], "q string, t string")
    for c in "qt":
        df = df.withColumn(f"{c}l", F.lower(c)).withColumn(f"{c}k", T.tokenize(F.col(f"{c}l"))).withColumn(f"{c}g", F.array_distinct(T.ngrams(F.col(f"{c}l"), F.col(f"{c}k")))).withColumn(f"{c}d", F.array_distinct(f"{c}k"))
    got = [r[0] for r in df.select(T.relevance(*(F.col(c) for c in ("ql", "tl", "qg", "tg", "qd", "td")))).collect()]
    # contained: 0.7 + 0.3 * min(5 * 10 / 22, 1); bigrams 部署 署数 数据 据库 against 数据 据库 库部 部署; inside out; empty; one of two words
    # (all five characters are shared, which counts 0.6; 3 of 4 bigrams would count 0.525)
    assert got == pytest.approx([1.0, 0.6, 0.6, 0.0, 0.35])


def test_compression(spark):
    df = spark.createDataFrame([(["a: one", None, "b: two"], []), (["a: x"], ["use redis", "y" * 20, "set z"])], "lines array<string>, facts array<string>")
    assert [r[0] for r in df.select(T.compress(F.col("lines"), F.col("facts"), 20)).collect()] == ["a: one | b: two", "use redis"]


def test_json(spark):
    texts = ['{"k": 1}', 'so ```json\n{"k": 2}\n``` end', 'see {"k": 3} there', '"k": 4}', "", "[1, 2]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.json_text(F.col("t"))).collect()] == ['{"k": 1}', '{"k": 2}', '{"k": 3}', "{}", "{}", "[1, 2]"]


def test_relations_need_both_names_and_a_known_one(spark):
    rows = spark.createDataFrame([(1, "App depends on Redis"), (2, "from Old migrate to New"), (3, "A runs on Box"), (4, "no relation")], "id int, t string")
    got = sorted(map(tuple, graph.extract_relations(rows, "id", "t").collect()))
    assert got == [(1, "App", "depends_on", "Redis"), (2, "New", "replaces", "Old")]
    known = spark.createDataFrame([("Redis",)], "name string")
    assert [r.id for r in graph.extract_relations(rows, "id", "t", known).collect()] == [1]
    assert set(L.RELATION_TYPES) >= {r[0] for r in L.RELATIONS} and len(L.RELATION_TYPES) == 10


def test_neighbourhood_reports_one_hop_on_and_filters_types(spark):
    edges = spark.createDataFrame([("a", "b", "x", 1), ("b", "c", "y", 1), ("c", "d", "x", 1), ("c", "a", "x", 1)], "src string, dst string, type string, weight int")
    start = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.node, r.type, r.via, r.depth) for r in graph.neighbourhood(edges, start, 2).collect())
    assert got == [("b", "", "a", 1), ("b", "x", "a", 1), ("c", "", "b", 2), ("c", "y", "b", 2), ("d", "x", "c", 3)]
    assert [r.node for r in graph.neighbourhood(edges, start, 2, types=["x"]).filter("type <> ''").collect()] == ["b"]


def test_decisions_at_the_bounds(spark):
    rows = [(1, 0.20, 0.0, False, False, []), (2, 0.19, 0.0, False, False, []), (3, 0.5, 0.70, False, False, [4, 5, 6, 7]), (4, 0.5, 0.91, False, False, [4]), (5, 0.5, 0.95, False, True, [4]), (6, 0.1, 0.8, False, False, [4]), (7, 0.0, 0.1, True, False, [9, 8, 7, 6]), (8, 0.0, 0.9, True, False, [9, 8])]
    df = spark.createDataFrame(rows, "i int, importance double, similarity double, explicit boolean, correction boolean, slots array<int>")
    got = [tuple(r) for r in recall.decide(df).orderBy("i").select("decision", "strength", "target", "co_activations").collect()]
    assert got == [("new", 0.4, None, []), ("reject", 0.0, None, []), ("update", 0.5, 4, [5, 6, 7]), ("merge", 0.5, 4, []), ("overwrite", 0.5, 4, []), ("reject", 0.0, None, []), ("new", 0.4, None, [9, 8, 7]), ("update", 0.4, 9, [9, 8])]


def test_context_features(spark):
    turns = [(1, 1, "redis server port"), (1, 2, "redis server down"), (1, 3, "hm"), (1, 4, "redis again")]
    got = {r.turn: list(r.context) for r in learned.with_context(spark.createDataFrame(turns, "conv_id int, turn int, text string")).collect()}
    assert got[1] == [0.0] * 8
    assert got[2] == pytest.approx([2 / 3, 2 / 3, 0, 1 / 3, 1 / 20, 0, 3 / 50, 0])
    assert got[4] == pytest.approx([0.5, 0.5, 0, 2 / 3, 2 / 20, 0.5, 4 / 50, 0])  # "hm" is no topic; "again" counts as a word


def test_network_learns_online_and_is_saved(tmp_path):
    net, x = learned.Network.seeded(72), np.linspace(-1, 1, 72)
    before = float(net.forward(x[None])[0])
    for _ in range(20):
        net.learn_online(x, 1.0)
    after = float(net.forward(x[None])[0])
    assert after > before
    net.learn_feedback(x, recalled=False)
    assert float(net.forward(x[None])[0]) < after
    net.save(tmp_path / "net.json")
    assert learned.Network.load(tmp_path / "net.json").forward(x[None]) == pytest.approx(net.forward(x[None]))
    (tmp_path / "old.json").write_text(json.dumps({"version": 1}))
    assert learned.Network.load(tmp_path / "old.json") is None


def test_configuration(tmp_path):
    c = config.preset("legal")
    assert (c.l1.window_size, c.l2.slot_count, c.l2.time_decay_halflife, c.namespace, c.compression_model) == (8, 128, 259200.0, "legal", "none")
    path = config.save(c, tmp_path / "a" / "config.json")
    assert config.load(path, {}) == c
    assert config.load(path, {"MEMOQUARRY_SLOTS": "7", "MEMOQUARRY_DECAY_RATE": "0.5", "MEMOQUARRY_EMBEDDING": "hash"}).l2.slot_count == 7
    assert config.load(tmp_path / "none", {}) == config.Config()
    assert config.from_dict({"l2": {"slot_count": 3, "unknown": 1}, "other": 2}).l2.slot_count == 3


def test_store(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/s", "a").open().open()
    other = store.ParquetStore(spark, f"file://{tmp_path}/s", "b")
    schema = "id string, content string, entities array<string>, importance double, embedding array<float>"
    s.save(spark.createDataFrame([("1", "old", ["x"], 0.5, None), ("2", "two", [], 0.9, [1.0])], schema), 1)
    s.save(spark.createDataFrame([("1", "new", ["x", "y"], 0.6, None)], schema), 2)
    other.save(spark.createDataFrame([("1", "theirs", [], 0.1, None)], schema), 1)
    one = s.get("1").first()
    assert (one.content, one.entities, one.archived, one.load_count, one.source) == ("new", ["x", "y"], False, 0, None)
    s.mark_loaded(spark.createDataFrame([("1",), ("1",)], "id string"))
    s.archive(spark.createDataFrame([("2", "1")], "id string, superseded_by string"))
    got = {r.id: r for r in s.records().collect()}
    assert got["1"].load_count == 2 and got["2"].archived and got["2"].superseded_by == "1"
    assert [r.content for r in other.records().collect()] == ["theirs"]
    slots = spark.createDataFrame([(0, "t0", 0.8), (1, "t1", 0.4)], "slot int, topic string, activation double")
    assert not s.checkpoint(slots, 0, 5) and not s.checkpoint(slots, 7, 5) and s.checkpoint(slots, 10, 5)
    s.save_snapshot(slots.filter("slot = 0"), 20)
    back = store.restore(s.load_snapshot(), "slots_json", "topic string, activation double", 60.0, slots=2).orderBy("slot_id").collect()
    assert [(r.step_count, r.topic) for r in back] == [(20, "t0"), (20, None)] and back[0].activation == pytest.approx(0.8 * 0.95**2)
    s.export(slots, f"{tmp_path}/out", most=1)
    assert [r.id for r in spark.read.json(f"{tmp_path}/out/records").collect()] == ["1"]
    assert spark.read.json(f"{tmp_path}/out/status").first().used_slots == 2
    s.close()


def test_older_files_lack_a_column(spark, tmp_path):
    """A column that came with version 2 is null in rows of version 1."""
    s = store.ParquetStore(spark, f"file://{tmp_path}/s", "a")
    old = ", ".join(c for c in store.TABLES["records"].split(", ") if not c.startswith("source "))
    spark.createDataFrame([("1", "a", "c", None, None, 0.5, "[]", None, 0, None, 1)], old).write.partitionBy("namespace").parquet(f"{tmp_path}/s/records")
    assert s.open().get("1").first().source is None


PUTS = "/tmp/memoquarry-test-puts"


def test_key_value_sink(spark):
    import os

    if os.path.exists(PUTS):
        os.remove(PUTS)
    path = PUTS

    def connect():
        class C:
            def hset(self, key, field, value):
                with open(path, "a") as f:
                    f.write(f"{key} {field} {value}\n")

        return C()

    store.KeyValueMirror(connect, "p")(spark.createDataFrame([("n", 1, "s1"), ("m", 2, "s2")], "namespace string, slot_id int, state string"), 0)
    assert sorted(open(PUTS).read().splitlines()) == ["p:m:slots 2 s2", "p:n:slots 1 s1"]
    os.remove(PUTS)


def test_plug_ins(spark):
    df = spark.createDataFrame([("ab", "x"), (None, "y"), ("cde", "z")], "t string, u string")
    plugins.register("lengths", lambda texts: [[float(len(t))] for t in texts])
    assert [r[0] for r in plugins.embedded(df, "t", "lengths").select("embedding").collect()] == [[2.0], None, [3.0]]
    assert len(plugins.embedded(df, "t", "auto", 8).filter("t = 'ab'").first().embedding) == 8

    def broken(texts):
        raise OSError("no network")

    plugins.register("broken", broken)
    assert [r[0] for r in plugins.embedded(df, "t", "broken").select("embedding").collect()] == [None] * 3
    del plugins.PROVIDERS["lengths"], plugins.PROVIDERS["broken"]
    assert [r[0] for r in df.select(plugins.merged(df, "u", "t", lambda both: [b.upper() for b in both])).collect()] == ["X\nAB", None, "Z\nCDE"]
    assert df.select(plugins.merged(df, "u", "t", broken)).first()[0] == "x\nab"


def test_hash_embedding_has_a_period(spark):
    df = T.with_hash_embedding(spark.createDataFrame([("a",), (None,)], "t string"), "t", 64)
    v, none = (r.embedding for r in df.collect())
    assert v[:32] == v[32:] and math.isclose(sum(x * x for x in v), 1.0) and none is None
