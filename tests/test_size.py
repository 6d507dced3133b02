"""Work that must not multiply with the rows: counted in records that are shuffled or in rows that the rules see."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from memoquarry import catalogue
from memoquarry.functions import text as T
from memoquarry.operators import graph, recall


def shuffled(spark, job) -> int:
    """Records that all stages of ``job`` wrote for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("reverse", [False, True])
def test_paths_do_not_multiply_at_a_hub(spark, reverse):
    """Each of 300 starts meets 1,000 leaves behind the hub, and only one way on; reversed, the goals are many and the start is one."""
    pairs = [(f"s{i}", "hub") for i in range(300)] + [("hub", f"leaf{i}") for i in range(1000)] + [("hub", "goal")]
    turn = (lambda a, b: (b, a)) if reverse else (lambda a, b: (a, b))
    edges = spark.createDataFrame([(*turn(a, b), "t") for a, b in pairs], "src string, dst string, type string")
    asked = spark.createDataFrame([turn(f"s{i}", "goal") for i in range(300)], "start string, goal string")
    got = []
    assert shuffled(spark, lambda: got.extend(graph.shortest_paths(edges, asked).collect())) < 50_000
    assert sorted((r.start, r.goal, r.length, r.path) for r in got) == sorted((*turn(f"s{i}", "goal"), 2, "; ".join(" t ".join(turn(*e)) for e in (lambda w: w[::-1] if reverse else w)([(f"s{i}", "hub"), ("hub", "goal")]))) for i in range(300))


@pytest.mark.parametrize("starts, goals", [("abcdefgh", "hg"), ("ab", "abcdefgh")])
def test_paths_from_either_side_are_the_first_in_name_order(spark, starts, goals):
    rng = random.Random(len(starts))
    pairs = sorted(e for e in itertools.permutations("abcdefgh", 2) if rng.random() < 0.25)
    follow = {n: [b for a, b in pairs if a == n] for n in "abcdefgh"}

    def paths(walk):
        yield walk
        if len(walk) <= 4:
            for n in follow[walk[-1]]:
                if n not in walk:
                    yield from paths(walk + n)

    want = {}
    for s, g in itertools.product(starts, goals):
        if found := [w for w in paths(s) if w[-1] == g]:
            best = min(found, key=lambda w: (len(w), w))
            want[s, g] = (len(best) - 1, "; ".join(f"{a} t {b}" for a, b in itertools.pairwise(best)))
    edges = spark.createDataFrame([(a, b, t) for a, b in pairs for t in "tu"], "src string, dst string, type string")
    asked = spark.createDataFrame(list(itertools.product(starts, goals)), "start string, goal string")
    assert {(r.start, r.goal): (r.length, r.path) for r in graph.shortest_paths(edges, asked).collect()} == want


def test_a_record_that_many_queries_name_is_scored_once(spark, tmp_path, monkeypatch):
    """40 queries name the entity of the same 50 documents: 50 scores for them, and one for each of the 5 nearest of a query."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(100 * i, t, "user", f"Zebra {'asks' if t else 'says'} {i}") for i in range(40) for t in range(2)], "conv_id long, turn long, role string, text string", "conversations")
    write([(i, f"Zebra number {i}") for i in range(50)], "doc_id long, text string", "documents")
    write([(i, [float((i * j) % 7 - 3) for j in range(64)]) for i in range(50)], "vec_id long, embedding array<float>", "embeddings")
    seen = spark.sparkContext.accumulator(0)

    def counted(df, text, name):
        @F.udf("double")
        def score(t):
            seen.add(1)
            return 0.5 + int(t.split()[-1]) / 1000

        return df.withColumn(name, score(text))

    monkeypatch.setattr(T, "with_importance", counted)
    got = catalogue.QUERIES["recall_federated"](spark, str(tmp_path)).collect()
    assert seen.value <= 50 + 5 * 40
    assert len(got) == 5 * 40 and {r.query_id for r in got} == {100 * i for i in range(40)}


def test_nearest_rows_with_many_ties_and_bad_numbers(spark):
    """Ties at the k-th place go to smaller ids, whatever the order of the rows; a vector that holds no number is never near."""
    rows = [(i, [1.0, 0.0]) for i in range(99, 9, -1)] + [(5, [0.0, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.001])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = recall.nearest(frame.filter("vec_id in (5, 20)"), frame, 3).orderBy("query_id", F.desc("score"), "vec_id").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(5, 7), (5, 10), (5, 11), (20, 10), (20, 11), (20, 12)]
    few = frame.filter("vec_id in (5, 6, 7)")
    assert {(r.query_id, r.vec_id) for r in recall.nearest(few.filter("vec_id = 5"), few, 3).collect()} == {(5, 7)}


@pytest.mark.parametrize("sent", [recall.SENT_IDS, 0])
def test_every_conversation_asks(spark, tmp_path, monkeypatch, sent):
    """Whatever its id, a conversation asks; held against the SQL with records that are met by id and by name, a name of many records, and texts that are long, empty or missing."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    turns = [(i, t, "user", f"{'Zebra' if i % 3 else 'Emu'} {t} we decided to ask record {i}") for i in range(1, 31) for t in range(3)]
    write([*turns, (31, 0, "user", ""), (200, 0, "user", "Zebra")], "conv_id long, turn long, role string, text string", "conversations")
    write([*((i, f"{'Zebra' if i % 2 else 'Emu'} number {i} must use kafka " + "long " * 2000) for i in range(40)), (40, None), (41, "")], "doc_id long, text string", "documents")
    write([(i, [float((i * j) % 7 - 3) for j in range(64)]) for i in range(1, 45)], "vec_id long, embedding array<float>", "embeddings")
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = lambda rows: sorted((*map(str, r[:4]), round(r[4], 5), r[5]) for r in rows)
    monkeypatch.setattr(recall, "SENT_IDS", sent)
    out = catalogue.QUERIES["recall_federated"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in out} == {*range(1, 32), 200}
    assert got(map(tuple, out)) == got(con.sql(catalogue.ORACLES["recall_federated"]).fetchall())
