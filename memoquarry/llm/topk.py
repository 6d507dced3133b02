"""Operator 1, exact top-k inner-product search in a forest of M-trees.

Vectors become integers, floor(256 * x).  Each shard of at most ``SHARD`` vectors is bulk-loaded
into an M-tree: pages hold routing objects with their covering radius, leaves hold
entries, and both store the distance to their parent object.  Queries go best-first through
the pages.  For a routing object c with radius r, no vector below scores more than
q.c + |q| r; and before q.c is known, q.p + |q| (d(c, p) + r) from the parent p bounds it, so most
inner products are never computed.  Entries are skipped by their stored parent distance alike.

A task builds the tree of one shard once and streams the queries of its vectors' length past it in
batches, so it holds one shard and one batch, and only k + 1 rows for each query and shard are shuffled to the final ranking.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids;
vectors are compared with those of their own length, empty ones with empty ones; ties go to the smaller id; fewer rows
than k give all.  Every row of the queries is a query of its own: a repeated query row is answered once for each
time it is there.  A query leaves out its own row: one row, if there is any, of its id and vector; other rows
with its id stay.  An empty table gives an empty result; other columns, whatever their names, are ignored.
Components must stay under 2^20 in size for exact sums.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.llm.common import Scratch, keyed, tune

SHARD = 16384
PAGE = 256
SLACK = 1e-6


class MTree:
    """Bulk-loaded M-tree over integer vectors; pages are numpy arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order].astype(np.float64)
        self.page, self.nodes = page, []
        self.centre = self.x.mean(axis=0).round() if len(ids) else None
        self.root = self._load(np.arange(len(ids)), self.centre) if len(ids) else -1
        self._lay_out()

    def _load(self, rows: np.ndarray, parent: np.ndarray) -> int:
        """A page for these rows; returns its number.  Distances are to the parent object."""
        if len(rows) <= self.page:
            self.nodes.append((True, rows, np.linalg.norm(self.x[rows] - parent, axis=1), None, None))
            return len(self.nodes) - 1
        want = min(self.page, -(-len(rows) // (self.page // 2)))
        x = self.x[rows]
        # objects far apart: each next one is the farthest from those chosen
        near, chosen = np.full(len(rows), np.inf), [int(np.linalg.norm(x - parent, axis=1).argmax())]
        for _ in range(want - 1):
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
            far = int(near.argmax())
            if near[far] <= 0:
                break
            chosen.append(far)
        if len(chosen) == 1:  # equal vectors: any cut serves
            groups = np.array_split(np.arange(len(rows)), want)
            centers = [x[0]] * len(groups)
        else:
            near_to = np.argmin(((x**2).sum(1)[:, None] - 2 * x @ x[chosen].T + (x[chosen] ** 2).sum(1)[None, :]), axis=1)
            groups = [np.flatnonzero(near_to == k) for k in range(len(chosen))]
            groups, centers = [g for g in groups if len(g)], [x[chosen[k]] for k, g in enumerate(groups) if len(g)]
        if len(groups) == 1:
            groups = np.array_split(groups[0], 2)
            centers = [x[g[0]] for g in groups]
        children = np.array([self._load(rows[g], c) for g, c in zip(groups, centers)])
        radii = np.array([np.linalg.norm(x[g] - c, axis=1).max() for g, c in zip(groups, centers)])
        c = np.array(centers)
        self.nodes.append((False, children, np.linalg.norm(c - parent, axis=1), radii, c))
        return len(self.nodes) - 1

    def _lay_out(self) -> None:
        """Put each leaf's vectors side by side; a leaf then holds the bounds of its rows."""
        leaves = [i for i, node in enumerate(self.nodes) if node[0]]
        order, at = [], 0
        for i in leaves:
            _, rows, to_parent, _, _ = self.nodes[i]
            far = np.argsort(-to_parent, kind="stable")  # farthest first: the bound keeps a head of the page
            order.append(rows[far])
            self.nodes[i] = (True, (at, at + len(rows)), to_parent[far], None, None)
            at += len(rows)
        if order:
            order = np.concatenate(order)
            self.ids, self.x = self.ids[order], np.ascontiguousarray(self.x[order])

    def search(self, query: np.ndarray, k: int, counts: dict | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, place), best first; ties to smaller ids."""
        if self.root < 0:
            return []
        q = query.astype(np.float64)
        length = float(np.linalg.norm(q))
        best: list[tuple[float, int, int]] = []  # a heap of (score, -id, -place): its least is the k-th
        queue = [(-np.inf, self.root, float(q @ self.centre))]
        while queue:
            bound, page, at_parent = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k else -np.inf
            if -bound < floor - SLACK:
                break
            leaf, below, to_parent, radii, objects = self.nodes[page]
            if leaf:
                begin, end = below
                if floor > -np.inf:
                    end = begin + int(np.searchsorted(-to_parent, (at_parent - floor + SLACK) / max(length, 1e-300), side="right"))
                if counts is not None:
                    counts["seen"] = counts.get("seen", 0) + end - begin
                scores = self.x[begin:end] @ q  # whole numbers below 2^53: exact
                near = np.flatnonzero(scores >= floor) if floor > -np.inf else np.arange(end - begin)
                for score, i, at in zip(scores[near].tolist(), self.ids[begin:end][near].tolist(), (near + begin).tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i, -at))
                    elif (score, -i, -at) > best[0]:
                        heapq.heapreplace(best, (score, -i, -at))
            else:
                live = at_parent + length * (to_parent + radii) >= floor - SLACK
                dots = objects[live] @ q
                tops = dots + length * radii[live]
                for top, child, dot in zip(tops.tolist(), below[live].tolist(), dots.tolist()):
                    if top >= floor - SLACK:
                        heapq.heappush(queue, (-top, child, dot))
        return [(int(s), -i, -at) for s, i, at in sorted(best, key=lambda b: (-b[0], -b[1], -b[2]))]


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256))
    ok = F.coalesce(F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return df.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vector_col).alias("dim"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries`` against all of ``rows``."""
    spark = rows.sparkSession
    tune(spark)
    scratch = Scratch(spark, "topk")
    data = keyed(integers(rows, id_col, vector_col), scratch, "rows")
    asked = keyed(integers(queries, id_col, vector_col), scratch, "queries")
    shards = max(1, -(-data.count() // shard))
    columns = ["dim", "shard", "query", "rid", "vec_id", "v"]
    stored = data.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).withColumn("query", F.lit(0))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query", F.lit(1))
    met = stored.select(columns).unionByName(sent.select(columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query")

    def search(batches):
        at, tree, held = None, None, []  # the shard, and its vectors until the first query comes
        for b in batches:
            dims, shard_of, query = (b.column(i).to_numpy() for i in range(3))
            ids, values = b.column(4).to_numpy(), b.column(5)
            flat, ends = values.flatten().to_numpy(), np.cumsum(dims)
            out: list[tuple] = []
            edges = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (shard_of[1:] != shard_of[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), len(dims)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if (dims[s], shard_of[s]) != at:
                    at, tree, held = (dims[s], shard_of[s]), None, []
                x = flat[ends[s] - dims[s] : ends[e - 1]].reshape(e - s, int(dims[s]))
                if not query[s]:
                    held.append((ids[s:e].copy(), x.copy()))
                    continue
                if tree is None:
                    tree = MTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])) if held else MTree(np.zeros(0, np.int64), x[:0])
                    held = []
                for rid, q, v in zip(b.column(3).to_pylist()[s:e], ids[s:e].tolist(), x):
                    out += [(rid, q, i, score, i == q and bool((tree.x[place] == v).all())) for score, i, place in tree.search(v, k + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["rid", "query_id", "vec_id", "score", "own"])

    found = met.mapInArrow(search, "rid long, query_id long, vec_id long, score long, own boolean")
    order = [F.desc("score"), F.col("vec_id"), F.desc("own")]
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).filter(F.col("place") <= k + 1)
    others = ranked.withColumn("nth", F.count(F.when(F.col("own"), 1)).over(Window.partitionBy("rid").orderBy("place"))).filter(~(F.col("own") & (F.col("nth") == 1)))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("place"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
