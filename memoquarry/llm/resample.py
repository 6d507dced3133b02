"""Operator 3, quality selection by importance resampling.

Counts of words, word pairs, and their shapes (case, digits, punctuation, repetition), hashed to ``BUCKETS`` buckets, give two generative models: of raw text,
counted over every document, and of target text, counted over a bounded sample of documents
labelled as good (``TARGET`` rows at most, the first by a hash of their id, none of the held-out fifth).  A document's log
weight is the log of the ratio of the two models' probabilities of it: the sum of the log ratios of its n-grams.
Adding Gumbel noise and keeping the largest keys draws documents without replacement in proportion to
that ratio.  The noise is a hash of the row, so a task that runs again draws the same.

The raw counts are summed per task before they are shuffled.  The k-th key is found by
counting key ranges, narrower each time, so no task sorts all keys.

Defined results: null, empty and wordless texts have log weight 0 (the models say nothing of them); null ids
are drawn like others; texts are read whole, however long; repeated rows have equal keys, and ties at the k-th key are all kept;
without target rows all weights are 0; labels of absent documents and null labels teach nothing; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Hashes, Scratch, binaries, mix, tune

BUCKETS = 1 << 16
TARGET = 4000
SMOOTHING = 1.0
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)
AGAIN = np.uint64(11)
#: Share of documents that the registered query keeps.
KEEP = 0.85


class Shapes(Hashes):
    """word -> hash of its shape: runs of capitals, small letters, digits and other bytes as one sign each, punctuation as it is."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(b"shape" + RUNS.sub(rb"\1", word.translate(SHAPE)))
        return value


def buckets_of(text: bytes | None, hashes: tuple[Hashes, Shapes]) -> np.ndarray:
    """Buckets of a text's words, word pairs, shapes and shape pairs; a word that repeats the last has a shape of its own."""
    split = (text or b"").split()
    words, shapes = hashes[0].array(split), hashes[1].array(split)
    if len(words) > 1:
        shapes[1:][words[1:] == words[:-1]] = AGAIN
    pair = lambda x: mix(x[:-1] * np.uint64(3) + x[1:]) if len(x) > 1 else x[:0]
    return (np.concatenate((words, pair(words), mix(shapes), pair(shapes))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counts(docs: DataFrame) -> np.ndarray:
    """n-grams of all rows by bucket."""
    tune(docs.sparkSession)

    def run(batches):
        hashes, total = (Hashes(), Shapes()), np.zeros(BUCKETS, np.int64)
        for b in batches:
            got = [buckets_of(t, hashes) for t in binaries(b.column(0))]
            if got:
                total += np.bincount(np.concatenate(got), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def fold() -> F.Column:
    """Of five parts of all ids; part 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, target: int = TARGET) -> np.ndarray:
    """Log ratio of target to raw probability by bucket."""
    good = labels.filter((F.col("quality") == 1) & (fold() != 0)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target)
    wanted = counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))  # at most ``target`` ids
    raw = counts(docs)
    if not wanted.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c + SMOOTHING * raw / max(raw.sum(), 1) * BUCKETS + 1e-9) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(share(wanted)) - np.log(share(raw))


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, key): key = log weight + Gumbel noise."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        hashes, table = (Hashes(), Shapes()), shared.value
        for b in batches:
            got = [buckets_of(t, hashes) for t in binaries(b.column(1))]
            weight = np.array([float(table[x].sum()) for x in got])
            u = (mix(b.column(2).to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
            noise = -np.log(-np.log(np.clip(u, 1e-16, 1 - 1e-16)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight, pa.float64()), pa.array(weight + noise, pa.float64())], names=["doc_id", "log_weight", "key"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(7), "doc_id", "text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value, by counting ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    while True:
        part = df.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= abs(high) * 1e-15 or high == low:
            return low
        found = part.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).orderBy(F.desc("bin")).collect()
        for _, n, least, most in found:
            if n >= k:
                break
            k -= n
        else:
            return found[-1][2]
        if n <= 10_000:
            return sorted((r[0] for r in df.filter(F.col(column).between(least, most)).select(column).collect()), reverse=True)[min(k, n) - 1] if least < most else least
        if (least, most) == (low, high):
            return least
        low, high = least, most


def select(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, log_weight, key, kept."""
    scored = Scratch(docs.sparkSession, "resample").write(weigh(docs, fit(docs, labels)), "keys")
    n = scored.count()
    least = kth_largest(scored, "key", min(n, round(keep * n)))
    return scored.withColumn("kept", F.col("key") >= F.lit(least))
