"""Operator 4, toxicity by nearest labelled examples.

The examples are a bounded sample of labelled documents (``TOXIC`` and ``CLEAN`` rows at most, the first
by a hash of their id).  A text's terms are its whole words and the ``GRAMS``-character n-grams of its
words, their ends marked by a space, over the entire text (unspaced scripts are read by their n-grams, pairs too).
Of these the vocabulary keeps the terms whose rate among toxic and among other examples differs by
``LIFT`` times and significantly (``SURE``, a log-likelihood ratio), ``TERMS`` at most, the most
telling first.  Texts are matched against all of them in one pass (Aho-Corasick).

Examples are held as TF-IDF vectors in a block-max inverted index: postings by term and block of
examples, with each term's largest weight in each block.  A text's bound for a block is the sum of
those maxima; the blocks with the best bounds are scored exactly, then all whose bound reaches the
k-th cosine so far, so the k nearest examples are exact.  Their votes, weighted by squared cosine,
become a score through a logistic curve fitted on leave-one-out votes of the examples, with each class
weighted back to its share among all labelled rows; the curve is the steeper the nearer the neighbours are.  An example with the very same text does not vote,
so that no labelled row is judged by its own label.

Terms are counted on the executors; the driver holds the chosen terms and the examples' few terms of
these.  Scoring is one narrow pass over whole texts with the index broadcast; its size is bounded by
the parameters.  Every score comes with its evidence (ids and cosines of the nearest examples).

Defined results: null, empty and wordless texts, and texts that share no term with an example,
score the share of toxic rows among those labelled; without labels of both kinds every score is that
share (0 without labels); null labels and labels of absent documents teach nothing; a document labelled twice counts
as toxic if one label says so; repeated documents are scored row by row; rows with a null doc_id are scored and not
held out; texts are read whole, however long; ties in cosine go to the example placed first in the index; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Scratch, lean, ragged, tune

TOXIC, CLEAN = 4000, 8000
GRAMS = (2, 4, 6)
TERMS = 8192
LIFT, SURE = 3.0, 15.0
NEAREST = 20
#: Nearest examples that a row names as its evidence.
EVIDENCE = 3
BLOCK = 64
HEAD = 0.05
#: Examples whose leave-one-out votes fit the curve.
CURVE = 3000
FIRST_BLOCKS = 8

BETWEEN = re.compile(r"[\W_]+")


def spaced(text: str | None) -> str:
    """Lower-cased words between single spaces."""
    return f" {BETWEEN.sub(' ', (text or '').lower()).strip()} "


def digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


class Terms:
    """The vocabulary, and a matcher that counts its terms in a text."""

    def __init__(self, names: list[str]):
        self.names, self._matcher = names, None

    def __getstate__(self):
        return {"names": self.names, "_matcher": None}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, ascending; how often each occurs)."""
        if not self.names or not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._matcher is None:
            import ahocorasick

            self._matcher = ahocorasick.Automaton()
            for i, name in enumerate(self.names):
                self._matcher.add_word(name, i)
            self._matcher.make_automaton()
        found = Counter(i for _, i in self._matcher.iter(spaced(text)))
        term = np.array(sorted(found), np.int64)
        return term, np.array([found[t] for t in term.tolist()], np.int64)


class BlockMaxIndex:
    """Exact k nearest examples by TF-IDF cosine.

    Terms in over ``HEAD`` of the examples are kept as dense columns, since their postings would
    reach almost every block; the others are postings by term and block.
    """

    def __init__(self, ids: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int):
        df = np.bincount(np.concatenate([t for t, _ in bags] or [np.zeros(0, np.int64)]), minlength=terms)
        by = np.argsort(-df, kind="stable")  # frequent terms first
        self.place = np.empty(terms, np.int64)
        self.place[by] = np.arange(terms)
        self.heads = int((df > HEAD * len(bags)).sum())
        self.idf = np.log(max(len(bags), 1) / np.maximum(df[by], 1))
        rows = [self.vector(bag) for bag in bags]
        # examples with the same label and heaviest term side by side: tighter block maxima
        order = sorted(range(len(bags)), key=lambda i: (int(labels[i]), int(rows[i][0][rows[i][1].argmax()]) if len(rows[i][0]) else -1, int(ids[i])))
        n, self.blocks = len(order), -(-len(order) // BLOCK)
        self.order = np.array(order, np.int64)
        self.ids, self.labels = ids[order], labels[order].astype(np.float64)
        term = np.concatenate([rows[i][0] for i in order] or [np.zeros(0, np.int64)])
        value = np.concatenate([rows[i][1] for i in order] or [np.zeros(0)])
        doc = np.repeat(np.arange(n), [len(rows[i][0]) for i in order])
        self.dense = np.zeros((self.heads, self.blocks * BLOCK), np.float32)
        head = term < self.heads
        self.dense[term[head], doc[head]] = value[head]
        term, value, doc = term[~head] - self.heads, value[~head], doc[~head]
        tails = terms - self.heads
        cell = term * self.blocks + doc // BLOCK
        at = np.lexsort((doc, cell))
        self.doc, self.value = doc[at].astype(np.int32), value[at].astype(np.float32)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=tails * self.blocks)))).astype(np.int32)
        self.top = np.zeros(tails * self.blocks, np.float32)
        np.maximum.at(self.top, cell, value.astype(np.float32))
        self.top = self.top.reshape(tails, self.blocks)

    def vector(self, bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        term = self.place[bag[0]]
        value = (1 + np.log(bag[1])) * self.idf[term]
        return term, value / max(float(np.sqrt((value**2).sum())), 1e-12)

    def _exact(self, term: np.ndarray, weight: np.ndarray, blocks: np.ndarray, scores: np.ndarray) -> None:
        cell = (term[:, None] * self.blocks + blocks[None, :]).ravel()
        n = self.start[cell + 1] - self.start[cell]
        some = np.flatnonzero(n)
        at = ragged(self.start[cell[some]], n[some])
        scores += np.bincount(self.doc[at], np.repeat(weight[some // len(blocks)], n[some]) * self.value[at], len(scores))

    def nearest(self, bags: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, without: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each bag, places and cosines of its k nearest examples with a positive cosine; ``without``: places that do not count."""
        vectors = [self.vector(bag) for bag in bags]
        queries = np.zeros((len(bags), self.heads), np.float32)
        for row, (term, weight) in zip(queries, vectors):
            row[term[term < self.heads]] = weight[term < self.heads]
        common = queries @ self.dense
        out = []
        for i, (term, weight) in enumerate(vectors):
            scores = common[i].astype(np.float64)
            left_out = without[i] if without is not None else np.zeros(0, np.int64)
            tail = term >= self.heads
            if tail.any():
                term, weight = term[tail] - self.heads, weight[tail]
                bound = scores.reshape(-1, BLOCK).max(axis=1) + weight @ self.top[term]
                order = np.argsort(-bound, kind="stable")
                self._exact(term, weight, np.sort(order[:FIRST_BLOCKS]), scores)
                need = k + len(left_out)  # as many may fall away
                least = np.partition(scores, -need)[-need] if len(scores) > need else 0.0
                rest = np.sort(order[FIRST_BLOCKS:])
                rest = rest[bound[rest] >= least - 1e-5]
                if len(rest):
                    self._exact(term, weight, rest, scores)
            scores = scores[: len(self.ids)]
            scores[left_out] = 0
            least = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
            some = np.flatnonzero((scores >= least) & (scores > 1e-9))
            best = some[np.lexsort((some, -scores[some]))][:k]
            out.append((best, scores[best]))
        return out


class Scorer:
    """Scores of texts.  ``weights``: what an example of class 0 and of class 1 counts for in the curve; ``share``: of toxic rows among those labelled."""

    def __init__(self, terms: Terms, ids: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], digests: list[bytes], labels: np.ndarray, weights: tuple[float, float], share: float, k: int = NEAREST):
        self.terms, self.k, self.share = terms, k, share
        self.usable = 0 < labels.sum() < len(labels)
        if not self.usable:
            return
        self.index = BlockMaxIndex(ids, bags, labels, len(terms.names))
        self.same: dict[bytes, list[int]] = {}
        for place, i in enumerate(self.index.order.tolist()):
            self.same.setdefault(digests[i], []).append(place)
        some = list(range(0, len(ids), max(1, len(ids) // CURVE)))
        votes = []
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            votes += [self.vote(*x) for x in self.index.nearest([bags[j] for j in part], k, [np.array(self.same[digests[j]]) for j in part])]
        found = np.array([v is not None for v in votes])
        inputs = np.array([v for v in votes if v is not None]).reshape(-1, 2)
        self.curve = logistic(inputs, labels[some][found].astype(float), np.where(labels[some][found] == 1, weights[1], weights[0]))

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> tuple[float, float] | None:
        """The log odds of the weighted votes, and these times the mean cosine; nothing without neighbours."""
        if not len(best):
            return None
        w = cosine**2
        v = np.clip((w * self.index.labels[best]).sum() / w.sum(), 0.01, 0.99)
        odds = float(np.log(v / (1 - v)))
        return odds, odds * float(cosine.mean())

    def __call__(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, ids of the nearest examples, their cosines) of each text."""
        none = np.zeros(0, np.int64)
        if not self.usable:
            return [(self.share, none, np.zeros(0))] * len(texts)
        out = []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            without = [np.array(self.same.get(digest(t), none), np.int64) for t in part]
            for best, cosine in self.index.nearest([self.terms(t) for t in part], self.k, without):
                inputs = self.vote(best, cosine)
                out.append((self.share if inputs is None else float(1 / (1 + np.exp(-np.dot(self.curve, [*inputs, 1.0])))), self.index.ids[best], cosine))
        return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps: a coefficient for each input, and the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    a = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, ridge), 1e-9]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (w * (p - y)) + pull * a)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a -= step
        if np.abs(step).max() < 1e-8:
            break
    return a


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many examples of each class a word occurs.  Input: text, toxic."""

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label].update(set(spaced(text).split()))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield frame(seen)
                seen = (Counter(), Counter())
        yield frame(seen)

    def frame(seen):
        words = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return rows.mapInArrow(lean(run), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(words: DataFrame, most: int = TERMS) -> list[str]:
    """The telling terms of a table of word counts, at most ``most``."""
    sums = words.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (float(x or 0) for x in sums)
    if not toxic or not clean:
        return []
    s = F.concat(F.lit(" "), "word", F.lit(" "))
    cut = lambda n: F.when(F.length("s") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - (n - 1), F.lit(1))), lambda i: F.substring("s", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = words.select(s.alias("s"), "toxic", "clean").select(F.explode(F.array_distinct(F.concat(F.array("s"), *(cut(n) for n in GRAMS)))).alias("term"), "toxic", "clean")
    grams = grams.filter((F.length("term") > min(GRAMS)) | F.regexp_like("term", F.lit(r"[\x{2E80}-\x{10FFFF}]")))  # pairs: of unspaced scripts only
    counts = grams.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    part = lambda x, total: F.when(x > 0, x * F.log(x * (toxic + clean) / (n * total))).otherwise(0.0)
    lift = ((a + 0.5) / toxic) / ((b + 0.5) / clean)
    sure = 2 * (part(a, toxic) + part(b, clean))
    chosen = counts.withColumn("sure", sure).filter((F.greatest(lift, 1 / lift) >= LIFT) & (F.col("sure") >= SURE)).orderBy(F.desc("sure"), "term").limit(most)
    return [r[0] for r in chosen.select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Scorer:
    """Learn from labelled rows outside the held-out fifth."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label, most in ((1, toxic), (0, clean)):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most toxic + clean ids
    rows = scratch.write(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "examples")
    words = scratch.write(_word_counts(rows.select("text", "toxic")), "words")
    terms = Terms(choose_terms(words))
    scratch.drop("words")

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            bags = [terms(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array([digest(t) for t in texts], pa.binary()), pa.array([t for t, _ in bags], pa.list_(pa.int64())), pa.array([n for _, n in bags], pa.list_(pa.int64()))], names=["doc_id", "toxic", "digest", "term", "n"])

    got = rows.mapInArrow(lean(run), "doc_id long, toxic int, digest binary, term array<long>, n array<long>").groupBy("doc_id").agg(F.min(F.struct("digest", "toxic", "term", "n")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")  # one text for an id
    scratch.drop("examples")
    ids, y = (got.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
    bags = list(zip((np.array(t, np.int64) for t in got.column("term").to_pylist()), (np.array(n, np.int64) for n in got.column("n").to_pylist())))
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    weights = tuple(counts.get(c, 0) / max(int((y == c).sum()), 1) for c in (0, 1))
    return Scorer(terms, ids, bags, got.column("digest").to_pylist(), y, weights, share)


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def score(docs: DataFrame, scorer: Scorer, evidence: int = 0) -> DataFrame:
    """``docs`` with score (and the nearest examples: ids and cosines)."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    extra = "score double" + (", nearest array<struct<doc_id:long,cosine:double>>" if evidence else "")
    names = [c for c in docs.columns if c not in ("score", "nearest")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches):
        judge = shared.value
        for b in batches:
            out = judge(b.column(b.schema.get_field_index("text")).to_pylist())
            cols = [*b.columns, pa.array([s for s, _, _ in out], pa.float64())]
            if evidence:
                cols.append(pa.array([[{"doc_id": int(d), "cosine": float(c)} for d, c in zip(ds[:evidence], cs)] for _, ds, cs in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "score", *(["nearest"] if evidence else [])])

    from pyspark.sql.types import StructType

    return kept.mapInArrow(lean(run), StructType([*kept.schema.fields, *StructType.fromDDL(extra).fields]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the nearest examples."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), EVIDENCE)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")
