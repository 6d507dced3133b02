"""Scoring, nearest records and federated ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.functions import text as T
from memoquarry.shipping import ship

#: Bytes of query vectors that are sent to every executor at once.
QUERY_BYTES = 32 << 20
#: Scores of queries and rows that a task holds at once (8 bytes each, in a few copies).
HELD_SCORES = 1 << 21
#: Ids that are sent to every executor for a join at most.
SENT_IDS = 1 << 20


def sent(ids: DataFrame, most: int) -> DataFrame:
    """``ids`` marked to be sent to the other side of a join, if they are known to be at most ``most`` and that is few."""
    return F.broadcast(ids) if most <= SENT_IDS else ids


def top(rows: DataFrame, query: str, item: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(rows: DataFrame, size) -> Iterator[list]:
    """Rows streamed to the driver in blocks of at most ``QUERY_BYTES`` by ``size``; one block is held at a time."""
    block, used = [], 0
    for r in rows.toLocalIterator():
        n = size(r)
        if block and used + n > QUERY_BYTES:
            yield block
            block, used = [], 0
        block.append(r)
        used += n
    if block:
        yield block


def nearest(queries: DataFrame, rows: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, vec_id, score): the k rows of highest cosine for each query, ties to smaller ids.

    Queries are sent in blocks of bounded size; every task multiplies its rows with a block and
    keeps k for each query, so k rows a task and query are shuffled.
    """
    return search(queries, rows, k, lambda q, r: r["score"], [], digits).select("query_id", "vec_id", "score")


def search(queries: DataFrame, rows: DataFrame, k: int, score, extra: list[str], digits: int | None = None, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, score): the k rows with the best ``score(query columns, row columns)`` for each query, without the row of its own id (unless ``itself``).

    ``score`` gets numpy columns: of the queries (n, 1) and of the rows (1, m), ``extra`` ones by name, and r["score"], the cosines (n, m).
    """
    spark = rows.sparkSession
    ship(spark)
    found = []

    def scan(shared):
        def run(batches):
            ids, matrix, *columns = shared.value
            matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            asked = {name: c[:, None] for name, c in zip(extra, columns)}
            best: dict[int, list] = {i: [] for i in range(len(ids))}
            for b in batches:
                own = b.column(0).to_numpy()
                if not len(own):
                    continue
                x = np.array(b.column(1).to_pylist(), np.float64)
                unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                held = {name: b.column(2 + i).to_numpy()[None, :] for i, name in enumerate(extra)}
                step = max(1, HELD_SCORES // len(own))
                for a in range(0, len(ids), step):
                    scores = np.asarray(score({name: c[a : a + step] for name, c in asked.items()}, {"score": matrix[a : a + step] @ unit, **held}))
                    keys = np.round(scores, digits) if digits is not None else scores
                    keys = -(keys if itself else np.where(own[None, :] == ids[a : a + step, None], -np.inf, keys))
                    # the k best and what ties with the last of them; not a number comes last
                    last = np.partition(keys, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1, None]
                    for i, (row, near) in enumerate(zip(keys, ~(keys > last))):
                        at = np.flatnonzero(near)
                        at = at[np.lexsort((own[at], row[at]))[:k]]
                        best[a + i] = sorted([*best[a + i], *((row[j], int(own[j]), float(scores[i, j])) for j in at if row[j] < np.inf)])[:k]
            out = [(int(ids[i]), v, -s, x) for i, found in best.items() for s, v, x in found]
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "vec_id", "key", "score"])

        return rows.select("vec_id", "embedding", *extra).mapInArrow(run, "query_id long, vec_id long, key double, score double")

    for block in blocks(queries.select("vec_id", "embedding", *extra), lambda r: 8 * len(r[1]) + 64):
        ids, vectors, *columns = zip(*block)
        found.append(scan(spark.sparkContext.broadcast((np.array(ids), np.array(vectors, np.float64), *map(np.array, columns)))))
    if not found:
        return rows.filter("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("key")


class Passages:
    """Query texts with an inverted index of their n-grams and tokens."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        self.size = [np.array([len(r[c]) for r in rows], np.float64) for c in (2, 3)]
        self.postings: list[dict[str, list[int]]] = [{}, {}]
        for i, r in enumerate(rows):
            for held, terms in zip(self.postings, r[2:4]):
                for t in terms:
                    held.setdefault(t, []).append(i)
        self.lengths = np.array([len(t) for t in self.texts])

    def scores(self, text: str, grams: list[str], tokens: list[str]) -> np.ndarray:
        """TX6 of every passage for a text; containment is tried where the shared n-grams allow it."""
        if not text:
            return np.zeros(len(self.ids))
        shared = [np.zeros(len(self.ids)), np.zeros(len(self.ids))]
        for out, held, terms in zip(shared, self.postings, (grams, tokens)):
            hit = [p for t in terms if (p := held.get(t))]
            if hit:
                out += np.bincount(np.concatenate(hit), minlength=len(out))
        part = [np.divide(s, n, out=np.zeros_like(s), where=n > 0) for s, n in zip(shared, self.size)]
        best = np.maximum(0.7 * part[0], 0.6 * part[1])
        # a passage inside a text shares all of its words but the outer two
        for i in np.flatnonzero((shared[1] >= self.size[1] - 2) & (self.lengths > 0)).tolist():
            if self.texts[i] in text:
                best[i] = max(best[i], 0.7 + 0.3 * min(5 * len(self.texts[i]) / len(text), 1))
        for i in np.flatnonzero((self.lengths >= len(text)) & (best < 0.6)).tolist():
            if text in self.texts[i]:
                best[i] = 0.6
        return np.where(self.lengths > 0, best, 0.0)


def most_relevant(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): for each query the k texts of highest relevance above 0, ties to smaller ids.

    Both have id, text (lower-cased), grams and tokens.  Queries are sent in blocks of bounded size, and a task keeps k for each.
    """
    spark = texts.sparkSession
    ship(spark)
    found = []

    def scan(shared):
        def run(batches):
            passages, best = None, {}
            for b in batches:
                passages = passages or Passages(shared.value)
                rows = [(i, t, g, w) for i, t, g, w in zip(*(c.to_pylist() for c in b.columns)) if t is not None]
                if not rows:
                    continue
                scores = np.round(np.stack([passages.scores(t, g, w) for _, t, g, w in rows], 1), 6)
                ids = np.array([r[0] for r in rows])
                for q in np.flatnonzero((scores > 0).any(axis=1)).tolist():
                    at = np.lexsort((ids, -scores[q]))[:k]
                    best[q] = sorted([*best.get(q, []), *((-float(scores[q, j]), int(ids[j])) for j in at if scores[q, j] > 0)])[:k]
            out = [(int(passages.ids[q]), i, -s) for q, found in best.items() for s, i in found]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

        return texts.select("id", "text", "grams", "tokens").mapInArrow(run, "query_id long, id long, score double")

    for block in blocks(queries.filter("text is not null").select("id", "text", "grams", "tokens"), lambda r: 8 * len(r[1]) + 256):
        found.append(scan(spark.sparkContext.broadcast([tuple(r) for r in block])))
    if not found:
        return texts.filter("false").select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("rank"), "id", F.lit(0.0).alias("score"))
    return top(reduce(DataFrame.unionByName, found), "query_id", "id", k).withColumn("rank", F.col("rank").cast("long"))


def slot_score(cosine, activation, age, shared, required):
    """0.6 cosine + 0.15 activation + 0.15 recency, and up to 0.2 for required entities; numbers or numpy arrays."""
    bonus = np.where(required > 0, 0.2 * shared / np.maximum(required, 1), 0.0)
    return 0.6 * np.maximum(cosine, 0) + 0.15 * activation + 0.15 / (1 + 0.1 * np.maximum(age, 1)) + bonus


def decide(rows: DataFrame) -> DataFrame:
    """The admission table on importance, similarity, explicit and correction, and ``slots`` by falling similarity; the first row that holds decides.

    Adds decision, strength, target (of an update) and co_activations.
    """
    imp, sim, slots = F.col("importance"), F.col("similarity"), F.col("slots")
    novel = sim < 0.7
    decision = (
        F.when(F.col("explicit"), F.when(novel, "new").otherwise("update"))
        .when((imp < 0.2) & ~novel, "reject")
        .when(novel & (imp >= 0.25), "new")
        .when(sim >= 0.7, F.when(F.col("correction"), "overwrite").when(sim > 0.9, "merge").otherwise("update"))
        .when(novel & (imp >= 0.2), "new")
        .otherwise("reject")
    )
    rows = rows.withColumn("decision", decision)
    rejected, stored = F.col("decision") == "reject", F.col("explicit") | novel
    strength = F.when(rejected, 0.0).when(stored, F.greatest(imp, F.lit(0.4))).otherwise(F.greatest(imp, F.lit(0.3)))
    target = F.when(F.col("decision").isin("update", "merge", "overwrite"), F.try_element_at(slots, F.lit(1)))
    others = F.when(rejected, F.slice(slots, 1, 0)).when(stored, F.slice(slots, 1, 3)).otherwise(F.slice(slots, 2, 3))
    return rows.withColumns({"strength": strength, "target": target, "co_activations": others})


def by_id(x: Column) -> Column:
    return F.concat(F.lit("#"), x.cast("string"))


def by_name(x: Column) -> Column:
    return F.concat(F.lit("="), x)


def headed(rows: DataFrame) -> DataFrame:
    """``rows`` with head and tokens of their text in its place; a federated recall needs no more of it, and so copies no text for each query."""
    return rows.withColumns({"key": F.substring("text", 1, 100), "tokens": T.token_estimate(F.col("text"))}).drop("text")


def known(records: DataFrame, k: int, score) -> DataFrame:
    """(by, id, key, tokens, imp): every record (id, name, text) by its id, and by each name the k of highest importance, ties to smaller ids.

    ``score``: adds ``imp`` to records.  Neither depends on who asks, and both come from one pass: a record is scored once, however many queries meet it.
    """
    rows = headed(score(records).withColumn("same", F.xxhash64("text")))
    rows = rows.select(F.explode(F.array(F.struct(by_id(F.col("id")).alias("by"), "same"), F.struct(by_name(F.col("name")).alias("by"), F.lit(0).cast("long").alias("same")))).alias("as"), "id", "key", "tokens", "imp")
    # by an id there are only copies of one record
    order = Window.partitionBy("by", "same").orderBy(F.desc(F.round("imp", 6)), "id")
    best = rows.select("as.*", "id", "key", "tokens", "imp").filter("by is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.drop("same", "rank")


def hits(rows: DataFrame, by: Column, name: str, branch: int, score: Column, weight: float = 1.0) -> DataFrame:
    """What a branch of a federated recall takes of ``known`` records; a null ``score`` stands for their importance by ``weight``."""
    return rows.select("query_id", F.lit(name).alias("layer"), F.lit(branch).alias("branch"), by.alias("by"), score.cast("double").alias("score"), F.lit(weight).alias("weight"))


def layer(rows: DataFrame, name: Column, branch: Column) -> DataFrame:
    """Items (query_id, key, tokens, score, n) of a federated recall with their layer and branch."""
    return rows.select("query_id", name.alias("layer"), branch.alias("branch"), "key", "tokens", F.col("score").cast("double").alias("score"), F.col("n").cast("long").alias("n"))


def federate(layers: list[DataFrame], k: int, wanted: tuple[str, ...] = ("l1", "l2", "l3")) -> DataFrame:
    """Branches as one ranking, of the wanted layers only; of texts with one head (``key``) the first branch's best is kept."""
    both = reduce(DataFrame.unionByName, layers).filter(F.col("layer").isin(*wanted))
    score = F.desc(F.round("score", 6))
    first = both.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("branch", score, "n"))).filter("first = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "branch", "key")).cast("long")).filter(F.col("rank") <= k)
