"""The learned gate: a small network over text features, trained by seeded mini-batches."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.functions import text as T

#: Version of saved networks.
VERSION = 2
#: Rows at most that the driver trains on.
TRAIN_ROWS = 20_000


@dataclass
class Network:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def seeded(cls, inputs: int, hidden: int = 16, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, (2 / inputs) ** 0.5, (inputs, hidden)), np.zeros(hidden), r.normal(0, (2 / hidden) ** 0.5, hidden), 0.0)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2, -500, 500)))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, decay: float = 0.001) -> None:
        """One gradient step of cross-entropy with an L2 term."""
        h = np.maximum(x @ self.w1 + self.b1, 0)
        err = (self.forward(x) - y) / len(x)
        back = np.outer(err, self.w2) * (h > 0)
        self.w2 -= rate * (h.T @ err + decay * self.w2)
        self.b2 -= rate * err.sum()
        self.w1 -= rate * (x.T @ back + decay * self.w1)
        self.b1 -= rate * back.sum(axis=0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.3, batch: int = 64, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                self.step(x[at], y[at], rate)
        return self

    def learn_online(self, x: np.ndarray, y: float, rate: float = 0.02) -> Network:
        """One update on one sample, after feedback or a correction (a correction is a sample with the right label)."""
        self.step(np.atleast_2d(x), np.array([y]), rate)
        return self

    def learn_feedback(self, x: np.ndarray, recalled: bool, rate: float = 0.02) -> Network:
        """A recalled text was worth storing; an evicted one that nobody recalled was not, which counts 0.3 times."""
        return self.learn_online(x, float(recalled), rate if recalled else 0.3 * rate)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"version": VERSION, "w1": self.w1.tolist(), "b1": self.b1.tolist(), "w2": self.w2.tolist(), "b2": float(self.b2)}))

    @classmethod
    def load(cls, path: str) -> Network | None:
        """None for a file of another version."""
        data = json.loads(Path(path).read_text())
        if data.get("version", 0) < VERSION:
            return None
        return cls(np.array(data["w1"]), np.array(data["b1"]), np.array(data["w2"]), data["b2"])

    def column(self, features: list[Column]) -> Column:
        """The forward pass as a Column expression, inside whole-stage code."""
        hidden = [F.greatest(sum((f * float(w) for f, w in zip(features, self.w1[:, j])), F.lit(float(self.b1[j]))), F.lit(0.0)) for j in range(len(self.b1))]
        z = sum((h * float(w) for h, w in zip(hidden, self.w2)), F.lit(float(self.b2)))
        return 1 / (1 + F.exp(-z))


#: Topics that a turn is held against, and the shortest text that is a topic (in characters, exclusive).
TOPICS, TOPIC_CHARS = 20, 5


def ensemble(importance: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """Rule score and network confidence as one score: agreement and sure networks take the network's, the rest the mean."""
    store = confidence >= threshold
    own = F.when(store, confidence).otherwise(0.3 * confidence)
    return F.when(store == (importance >= 0.2), own).when(confidence > 0.9, own).when((confidence < 0.3) & (importance > 0.3), own).otherwise((importance + own) / 2)


def untrained(importance: Column) -> Column:
    """Whether a text is stored while there is no network."""
    return importance >= 0.2


def with_context(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, text) with ``context``: eight features against the topics before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    topic = F.when(F.char_length("text") > TOPIC_CHARS, F.col("tokens"))
    rows = turns.withColumn("tokens", T.tokenize(F.lower("text"))).withColumn("distinct", F.array_distinct("tokens"))
    # the window holds the tokens of the turns before, newest last; turns that are no topic are left out by collect_list
    rows = rows.withColumn("before", F.count(topic).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("topics", F.collect_list(topic).over(w.rowsBetween(-2 * TOPICS, -1)))
    rows = rows.withColumn("last3", F.slice("topics", F.greatest(F.size("topics") - 2, F.lit(1)), F.lit(3))).withColumn("last5", F.flatten(F.slice("topics", F.greatest(F.size("topics") - 4, F.lit(1)), F.lit(5))))
    size = F.size("distinct")
    rows = rows.withColumn("overlaps", F.transform("last3", lambda x: F.size(F.array_intersect("distinct", x)) / F.greatest(F.size("distinct"), F.lit(1))))
    rows = rows.withColumn("seen", F.transform("distinct", lambda t: F.size(F.filter("last5", lambda x: x == t))))
    mean = F.when(F.size("overlaps") > 0, F.aggregate("overlaps", F.lit(0.0), lambda s, x: s + x) / F.size("overlaps")).otherwise(0.0)
    rows = rows.withColumn("mean", mean)
    bare = (size == 0) | (F.col("before") == 0)
    many = lambda n: F.size(F.filter("seen", lambda x: x >= n))
    features = [
        F.element_at("overlaps", -1), F.col("mean"), T.flag(F.round("mean", 9) < 0.1), F.least(F.size(F.filter("overlaps", lambda x: x > 0.3)) / 3.0, F.lit(1.0)),
        F.least(F.col("before") / float(TOPICS), F.lit(1.0)), many(2) / size, F.least(F.size(F.array_distinct("last5")) / 50.0, F.lit(1.0)), T.flag(many(3) > 0),
    ]
    zeros = F.array(*[F.lit(0.0)] * 8)
    return rows.withColumn("context", F.when(bare, zeros).otherwise(F.array(*features))).drop("distinct", "before", "topics", "last3", "last5", "overlaps", "seen", "mean")


def full_features(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``features``: the 72 inputs of the network.

    34 of the text, 24 of its hash embedding, 8 of its context and 6 of the profile that all user turns make.
    """
    keys = ["conv_id", "turn"]
    rows, p = T.Parts.of(with_context(turns))
    rows = rows.withColumn("_rules", F.array(*[f.cast("double") for f in T.text_features(p)])).drop("_low", "_body", "_noise", "_tokens", "_words", "tokens")
    rows = T.with_semantic_features(T.with_hash_embedding(rows, "text", 64, "_vector"), "_vector", name="_semantic")
    tokens = turns.select(*keys, "role", F.array_distinct(T.tokenize(F.lower("text"))).alias("t"))
    profile = profile_features(tokens, affinity(tokens.filter("role = 'user'").select("t")), keys)
    rows = rows.join(profile, keys, "left")
    six = F.array(*(F.coalesce(f"f{i}", F.lit(0.0)) for i in range(6)))
    return rows.select(*keys, "role", "text", F.concat("_rules", "_semantic", "context", six).alias("features"))


def affinity(recalled: DataFrame) -> DataFrame:
    """(w, n) of every token of the recalled texts (``t``: distinct tokens)."""
    return recalled.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def profile_features(texts: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """f0 to f5 of every text (``keys``, role, t) against the affinity table; recalls are the texts of users."""
    best = tokens.orderBy(F.desc("n"), "w").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "w")))  # ten rows
    whole = texts.agg(F.count_if(F.col("role") == "user").alias("recalls")).crossJoin(best.agg(F.sum(F.when(F.col("rank") <= 5, F.col("n"))).alias("top5"))).crossJoin(tokens.agg(F.sum("n").alias("total")))  # one row
    e = texts.select(*keys, F.explode("t").alias("w"), F.size("t").alias("size")).join(tokens, "w", "left").join(F.broadcast(best.select("w", "rank")), "w", "left")
    n = F.coalesce("n", F.lit(0))
    sums = e.groupBy(*keys).agg(F.max(n).alias("most"), F.sum(n).alias("sum"), F.max("size").alias("size"), F.count_if(n >= 2).alias("known"), F.count("rank").alias("top"))
    sums = sums.crossJoin(F.broadcast(whole))
    cut = lambda c: F.least(c, F.lit(1.0))
    return sums.select(*keys, cut(F.col("most") / 10.0).alias("f0"), cut(F.col("sum") / F.col("size") / 5).alias("f1"), (F.col("known") / F.col("size")).alias("f2"), (F.col("top") / F.col("size")).alias("f3"), cut(F.col("recalls") / 100.0).alias("f4"), (F.col("top5") / F.col("total")).alias("f5"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label, features) of labelled documents, the first by a hash of their id; without a session, context and profile are 0."""
    picked = labels.select("doc_id", F.col("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows, p = T.Parts.of(docs.select("doc_id", "text").join(picked, "doc_id"))
    rows = rows.withColumn("_rules", F.array(*[f.cast("double") for f in T.text_features(p)]))
    rows = T.with_semantic_features(T.with_hash_embedding(rows, "text", 64, "_vector"), "_vector", name="_semantic")
    return rows.select("doc_id", "label", F.concat("_rules", "_semantic", F.array(*[F.lit(0.0)] * 14)).alias("features"))
