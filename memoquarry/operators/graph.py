"""Entity graph: extraction, upserts as aggregates, neighbours, bounded breadth-first search, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.functions import lexicons as L


def _edge(kind: str):
    return lambda x: F.struct(x["a"].alias("src"), F.lit(kind).alias("type"), x["b"].alias("dst"))


def _pairs(text: Column, kind: str, pattern: str, swap: bool = False) -> Column:
    p = F.lit("(?iu)" + pattern)
    a, b = F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2))
    if swap:
        a, b = b, a
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), _edge(kind))


def extract_relations(rows: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """(key, src, type, dst) of every match; names of two characters or more, one of them ``known`` (name) if that is given.

    A pattern runs only on texts that hold its verb.
    """
    low, none = F.col("_low"), F.array().cast("array<struct<src:string,type:string,dst:string>>")
    rows = rows.select(key, text, F.lower(text).alias("_low")).filter(F.regexp_like("_low", F.lit("|".join(L.RELATION_CUES))))
    found = [F.when(F.regexp_like(low, F.lit(cue)), _pairs(F.col(text), *relation)).otherwise(none) for relation, cue in zip(L.RELATIONS, L.RELATION_CUES)]
    return _named(rows.select(key, F.explode(F.concat(*found)).alias("e")).select(key, "e.*"), known)


def extract_preset_relations(rows: DataFrame, key: str, text: str, preset: str, known: DataFrame | None = None) -> DataFrame:
    """The same with a domain's patterns; those with a single group name no pair."""
    found = [_pairs(F.col(text), kind, pattern) for pattern, kind in L.PRESET_RELATIONS[preset] if pattern.replace("(?:", "").count("(") == 2]
    return _named(rows.select(key, F.explode(F.concat(*found)).alias("e")).select(key, "e.*"), known)


def _named(each: DataFrame, known: DataFrame | None) -> DataFrame:
    each = each.filter((F.char_length("src") >= 2) & (F.char_length("dst") >= 2))
    if known is None:
        return each
    names = known.select("name").distinct()
    either = each.withColumn("row", F.monotonically_increasing_id()).withColumn("name", F.explode(F.array("src", "dst"))).join(names, "name", "left_semi")
    return either.dropDuplicates(["row"]).drop("row", "name")


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """Mentions (name, type, description, seq): counts add up, the first type and the last non-null description stay."""
    return mentions.groupBy("name").agg(F.min_by("type", "seq").alias("type"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"), F.count(F.lit(1)).alias("mention_count"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"))


def upsert_edges(events: DataFrame) -> DataFrame:
    return events.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"), F.max("seq").alias("last_seen"))


def comention_edges(tags: DataFrame, key: str, tag: str, typed: DataFrame | None = None) -> DataFrame:
    """Both directions of every pair of tags of one source row, and the ``typed`` edges (src, dst, type); the tags of a row are few by nature."""
    lists = tags.groupBy(key).agg(F.collect_set(tag).alias("tags"))
    pairs = lists.select(F.explode("tags").alias("src"), "tags").select("src", F.explode("tags").alias("dst")).filter("src <> dst").withColumn("type", F.lit("co_mentioned"))
    each = pairs if typed is None else pairs.unionByName(typed.select("src", "dst", "type"))
    return each.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("weight"))


def neighbours(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    known = edges.join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi")
    return known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int, fan: int = 50, types: list[str] | None = None) -> DataFrame:
    """(start, node, type, via, depth): breadth first over the ``fan`` heaviest edges of each node.

    Every edge from a node that is reached within ``hops`` edges to one that is not reached sooner, with the depth of its end (so those from the
    outermost nodes have depth hops + 1), and a row without type for each node that was expanded.  Of nodes of one depth all count as
    expanded together.  ``types``: only these edges are followed.
    """
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "type")
    near = edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fan)
    near = (near if types is None else near.filter(F.col("type").isin(types))).select("src", "dst", "type")
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    front, out = seen, None
    for depth in range(hops + 1):
        met = front.join(near, front["node"] == near["src"]).select("start", F.col("dst").alias("node"), "type", F.col("src").alias("via"), F.lit(depth + 1).alias("depth"))
        met = met.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        out = met if out is None else out.unionByName(met)
        if depth < hops:
            first = met.groupBy("start", "node").agg(F.min("via").alias("via"))
            front = first.select("start", "node", F.lit(depth + 1).alias("depth"))
            seen = seen.unionByName(front)
            out = out.unionByName(first.select("start", "node", F.lit("").alias("type"), "via", F.lit(depth + 1).alias("depth")))
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """(start, goal, length, path): the first shortest path in name order, as triples node, type, node; a start that is its goal has length 0.

    The search begins at the side with fewer distinct ends (backwards from the goals if these are as few) and keeps one path for each of them and
    each node that is met, so neither the pairs nor the edges that lead away from them multiply.
    """
    first = edges.groupBy("src", "dst").agg(F.min("type").alias("type"))
    pairs = pairs.select("start", "goal").distinct()
    ends = pairs.agg(F.count_distinct("start").alias("starts"), F.count_distinct("goal").alias("goals")).first()
    back = ends["goals"] <= ends["starts"]
    root, near, far = ("goal", "dst", "src") if back else ("start", "src", "dst")
    met = F.array(F.col(far)), F.array(F.concat_ws(" ", "src", "type", "dst"))
    grown = [F.concat(*((new, old) if back else (old, new))).alias(name) for name, old, new in zip(("nodes", "path"), ("nodes", "path"), met)]
    front = pairs.select(F.col(root).alias("root")).distinct().select("root", F.col("root").alias("node"), F.array("root").alias("nodes"), F.array().cast("array<string>").alias("path"))
    found = front
    for _ in range(hops):
        step = front.join(first, front["node"] == first[near]).filter(~F.array_contains("nodes", F.col(far))).select("root", F.col(far).alias("node"), *grown)
        # one way from a root to a node is enough
        front = step.groupBy("root", "node").agg(F.min(F.struct("nodes", "path")).alias("x")).select("root", "node", "x.*")
        found = found.unionByName(front)
    found = found.select(F.col("root").alias(root), F.col("node").alias("start" if back else "goal"), "nodes", "path").join(pairs, ["start", "goal"])
    best = Window.partitionBy("start", "goal").orderBy(F.size("path"), "nodes")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").select("start", "goal", F.size("path").cast("long").alias("length"), F.array_join("path", "; ").alias("path"))


def contexts(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(name, context) of each node: its name, its description, and its relations among the k heaviest, co-mentions left out."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "type")
    top = edges.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("type") != "co_mentioned"))
    said = top.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "type", "dst").alias("x")))).alias("said"))
    rows = nodes.join(said, "name", "left")
    about = F.when(F.col("description").isNotNull() & (F.col("description") != ""), F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise("")
    links = F.when(F.size("said") > 0, F.concat(F.lit(" → "), F.array_join(F.transform("said", lambda x: x["x"]), ", "))).otherwise("")
    return rows.select("name", F.concat("name", about, links).alias("context"))
