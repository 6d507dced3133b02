"""Knowledge graph queries (KG*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from memoquarry.functions import lexicons as L
from memoquarry.operators import graph
from memoquarry.plans.base import UTTERANCES_SQL, query, read, utterances
from memoquarry.plans.text_queries import lit

EDGES = """
SELECT concat('S', s_suppkey) AS src, concat('N', s_nationkey) AS dst, 'located_in' AS type, CAST(s_suppkey % 7 + 1 AS BIGINT) AS weight FROM {supplier}
UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 'is_part_of', CAST(5 AS BIGINT) FROM {nation}
UNION ALL SELECT concat('R', n_regionkey), concat('N', n_nationkey), 'contains', CAST(n_nationkey % 3 + 1 AS BIGINT) FROM {nation}
UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'serves', CAST(c_custkey % 11 + 1 AS BIGINT) FROM {customer}
"""
EDGES_SQL = EDGES.format(supplier="supplier", nation="nation", customer="customer")


def edges(spark, d):
    return spark.sql(EDGES, **{t: read(spark, d, t) for t in ("supplier", "nation", "customer")})


def relation_sql(kind: str, pattern: str, swap: bool) -> str:
    p = lit("(?i)" + pattern)
    a, b = f"regexp_extract_all(text, {p}, 1)", f"regexp_extract_all(text, {p}, 2)"
    a, b = (b, a) if swap else (a, b)
    return f"SELECT utt_id, unnest({a}) AS src, '{kind}' AS type, unnest({b}) AS dst FROM u"


EXTRACT_SQL = f"WITH u AS ({UTTERANCES_SQL}), e AS ({' UNION ALL '.join(relation_sql(*r) for r in L.RELATIONS)}) SELECT * FROM e WHERE length(src) >= 2 AND length(dst) >= 2"


@query("kg_extract", EXTRACT_SQL)
def kg_extract(spark, d):
    """KG2."""
    return graph.extract_relations(utterances(spark, d), "utt_id", "text")


@query("kg_extract_known", f"SELECT r.utt_id, src, type, dst FROM ({EXTRACT_SQL}) r WHERE src IN (SELECT concat('Node', n_nationkey) FROM nation) OR dst IN (SELECT concat('Node', n_nationkey) FROM nation)")
def kg_extract_known(spark, d):
    """KG2 with a set of known names."""
    known = read(spark, d, "nation").select(F.concat(F.lit("Node"), "n_nationkey").alias("name"))
    return graph.extract_relations(utterances(spark, d), "utt_id", "text", known)


RELATION_TYPES_SQL = f"SELECT unnest([{','.join(lit(t) for t in L.RELATION_TYPES)}]) AS type"


@query("kg_relation_types", f"WITH t AS ({RELATION_TYPES_SQL}), e AS ({EXTRACT_SQL}) SELECT t.type, count(e.type) AS n FROM t LEFT JOIN e USING (type) GROUP BY t.type")
def kg_relation_types(spark, d):
    """KG1: the closed set of relation types, and how often each is extracted."""
    types = spark.createDataFrame([(t,) for t in L.RELATION_TYPES], "type string")
    return types.join(kg_extract(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


#: A sentence of each domain for every supplier.
DOMAINS = """SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN concat('Supplier', s_suppkey, ' loves Nation', s_nationkey, '. Hero killed Dragon', s_suppkey) WHEN 1 THEN concat('Fund', s_suppkey, ' transferred to Bank', s_nationkey, ' and Auditor reviewed Bank', s_nationkey)
  WHEN 2 THEN concat('Counsel', s_suppkey, ' represents Client', s_nationkey, '; Client', s_nationkey, ' sued Rival', s_suppkey) WHEN 3 THEN concat('Patient', s_suppkey, ' allergic to Drug', s_nationkey, ', prescribed Pill', s_suppkey, ' for pain')
  ELSE concat('Agent', s_suppkey, ' contacted Buyer', s_nationkey, ' who quoted to Desk', s_suppkey, ', 林月爱上了江风') END AS text FROM {supplier}"""


def preset_relations_sql(preset: str) -> str:
    pairs = [(p, kind) for p, kind in L.PRESET_RELATIONS[preset] if p.replace("(?:", "").count("(") == 2]
    return " UNION ALL ".join(f"SELECT id, '{preset}' AS preset, unnest(regexp_extract_all(text, {lit('(?i)' + p)}, 1)) AS src, '{kind}' AS type, unnest(regexp_extract_all(text, {lit('(?i)' + p)}, 2)) AS dst FROM s" for p, kind in pairs)


@query("kg_preset_relations", f"WITH s AS ({DOMAINS.format(supplier='supplier')}), e AS ({' UNION ALL '.join(map(preset_relations_sql, L.PRESET_RELATIONS))}) SELECT * FROM e WHERE length(src) >= 2 AND length(dst) >= 2")
def kg_preset_relations(spark, d):
    """KG13: every domain's patterns over the same sentences."""
    rows = spark.sql(DOMAINS, supplier=read(spark, d, "supplier"))
    found = [graph.extract_preset_relations(rows, "id", "text", p).withColumn("preset", F.lit(p)) for p in L.PRESET_RELATIONS]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("kg_preset_types", "SELECT * FROM (VALUES " + ", ".join(f"({lit(p)}, {lit(what)}, {lit(t)})" for what, table in (("entity", L.PRESET_ENTITIES), ("relation", L.PRESET_RELATION_TYPES)) for p, ts in table.items() for t in ts) + ") AS t(preset, kind, type)")
def kg_preset_types(spark, d):
    """KG13: entity and relation types of the domains."""
    return spark.createDataFrame([(p, what, t) for what, table in (("entity", L.PRESET_ENTITIES), ("relation", L.PRESET_RELATION_TYPES)) for p, ts in table.items() for t in ts], "preset string, kind string, type string")


MENTIONS = "SELECT concat('U', user_id) AS name, event_type AS type, CASE WHEN event_id % 3 = 0 THEN concat('seen ', event_id) END AS description, event_id AS seq FROM {events}"


@query("kg_upsert_nodes", f"WITH m AS ({MENTIONS.format(events='events')}) SELECT name, arg_min(type, seq) AS type, min(seq) AS first_seen, max(seq) AS last_seen, count(*) AS mention_count, arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS description FROM m GROUP BY name")
def kg_upsert_nodes(spark, d):
    """KG3, KG6."""
    return graph.upsert_nodes(spark.sql(MENTIONS, events=read(spark, d, "events")))


@query("kg_upsert_edges", "SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS type, sum(l_quantity) AS weight, max(l_orderkey) AS last_seen FROM lineitem GROUP BY 1, 2, 3")
def kg_upsert_edges(spark, d):
    """KG4."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("seq"))
    return graph.upsert_edges(rows)


@query("kg_node", f"WITH m AS ({MENTIONS.format(events='events')}) SELECT name, count(*) AS mention_count FROM m WHERE name = 'U7' GROUP BY name")
def kg_node(spark, d):
    """KG6: one node by its exact name (the filter goes before the aggregate)."""
    return graph.upsert_nodes(spark.sql(MENTIONS, events=read(spark, d, "events"))).filter("name = 'U7'").select("name", "mention_count")


@query("kg_comention", "WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey::VARCHAR AS src, b.l_suppkey::VARCHAR AS dst, 'co_mentioned' AS type FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey UNION ALL SELECT src, dst, type FROM (" + EXTRACT_SQL + ")) SELECT src, dst, type, count(*) AS weight FROM e GROUP BY ALL")
def kg_comention(spark, d):
    """KG5: co-mentions of the suppliers of an order, and the typed relations of the sentences."""
    tags = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("l_suppkey"))
    return graph.comention_edges(tags, "l_orderkey", "l_suppkey", kg_extract(spark, d)).select("src", "dst", "type", "weight")


@query("kg_neighbors", f"WITH e AS ({EDGES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM e WHERE dst LIKE 'N%' OR dst LIKE 'C%') SELECT src, dst, type, weight FROM r WHERE rank <= 5")
def kg_neighbors(spark, d):
    """KG7."""
    e = edges(spark, d)
    nodes = e.select(F.col("dst").alias("name")).distinct().filter("name like 'N%' or name like 'C%'")
    return graph.neighbours(e, nodes, 5).select("src", "dst", "type", "weight")


KHOP_SQL = f"""WITH e AS ({EDGES_SQL}), f AS (SELECT src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, type) AS r FROM e) WHERE r <= 50),
d0 AS (SELECT DISTINCT src AS start, src AS node FROM e WHERE src LIKE 'S%'),
m1 AS (SELECT start, f.dst AS node, f.type, f.src AS via FROM d0 JOIN f ON f.src = d0.node WHERE f.dst <> start), d1 AS (SELECT start, node, min(via) AS via FROM m1 GROUP BY 1, 2),
m2 AS (SELECT d1.start, f.dst AS node, f.type, f.src AS via FROM d1 JOIN f ON f.src = d1.node WHERE f.dst <> d1.start AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d1.start AND x.node = f.dst)), d2 AS (SELECT start, node, min(via) AS via FROM m2 GROUP BY 1, 2),
m3 AS (SELECT d2.start, f.dst AS node, f.type, f.src AS via FROM d2 JOIN f ON f.src = d2.node WHERE f.dst <> d2.start AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d2.start AND x.node = f.dst) AND NOT EXISTS (SELECT 1 FROM d2 x WHERE x.start = d2.start AND x.node = f.dst)),
k AS (SELECT start, node, type, via, 1 AS depth FROM m1 UNION ALL SELECT start, node, '', via, 1 FROM d1 UNION ALL SELECT start, node, type, via, 2 FROM m2 UNION ALL SELECT start, node, '', via, 2 FROM d2 UNION ALL SELECT start, node, type, via, 3 FROM m3)"""


def _hops(spark, d, types=None):
    e = edges(spark, d)
    return graph.neighbourhood(e, e.filter("src like 'S%'").select(F.col("src").alias("node")).distinct(), 2, types=types)


@query("kg_khop", KHOP_SQL + " SELECT * FROM k")
def kg_khop(spark, d):
    """KG8: two hops, with marker rows and the edges that lead one hop on."""
    return _hops(spark, d)


@query("kg_khop_typed", f"WITH e AS ({EDGES_SQL}) SELECT DISTINCT src AS start, dst AS node, 'located_in' AS type, src AS via, 1 AS depth FROM e WHERE type = 'located_in' UNION ALL SELECT DISTINCT src, dst, '', src, 1 FROM e WHERE type = 'located_in'")
def kg_khop_typed(spark, d):
    """KG8 with a type filter: nothing leads on from a nation."""
    return _hops(spark, d, ["located_in"])


@query("kg_indirect", KHOP_SQL + " SELECT start, node, concat('indirect_', CASE WHEN type = '' THEN 'related' ELSE type END) AS type, concat_ws('>', start, via, node) AS path FROM k WHERE depth >= 2")
def kg_indirect(spark, d):
    """KG10."""
    kind = F.concat(F.lit("indirect_"), F.when(F.col("type") == "", "related").otherwise(F.col("type")))
    return _hops(spark, d).filter("depth >= 2").select("start", "node", kind.alias("type"), F.concat_ws(">", "start", "via", "node").alias("path"))


@query("kg_path", f"""WITH RECURSIVE e AS (SELECT src, dst, min(type) AS type FROM ({EDGES_SQL}) GROUP BY 1, 2),
p(start, node, nodes, path) AS (SELECT DISTINCT src, src, [src], []::VARCHAR[] FROM e WHERE src LIKE 'S%' UNION ALL SELECT p.start, e.dst, list_append(p.nodes, e.dst), list_append(p.path, concat_ws(' ', e.src, e.type, e.dst)) FROM p JOIN e ON e.src = p.node WHERE len(p.path) < 4 AND p.node <> 'R0' AND NOT list_contains(p.nodes, e.dst) AND e.dst NOT LIKE 'C%'),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path), nodes) AS k FROM p WHERE node = 'R0') SELECT start, 'R0' AS goal, len(path)::BIGINT AS length, array_to_string(path, '; ') AS path FROM r WHERE k = 1""")
def kg_path(spark, d):
    """KG9: from each supplier to a region in four edges at most (customers lead nowhere)."""
    e = edges(spark, d)
    pairs = e.filter("src like 'S%'").select(F.col("src").alias("start"), F.lit("R0").alias("goal")).distinct()
    return graph.shortest_paths(e, pairs)


CONTEXT_NODES = "SELECT concat('N', n_nationkey) AS name, concat('nation ', n_name) AS description FROM {nation} UNION ALL SELECT concat('R', r_regionkey), NULL FROM {region} UNION ALL SELECT concat('X', r_regionkey), 'apart' FROM {region}"
CO_MENTIONS = "SELECT concat('N', n_nationkey) AS src, concat('N', (n_nationkey + 1) % 25) AS dst, 'co_mentioned' AS type, CAST(12 AS BIGINT) AS weight FROM {nation}"


@query("kg_context", f"WITH e AS ({EDGES_SQL} UNION ALL {CO_MENTIONS.format(nation='nation')}), n AS ({CONTEXT_NODES.format(nation='nation', region='region')}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, type) AS rank FROM e), s AS (SELECT src, string_agg(type || ' ' || dst, ', ' ORDER BY rank) AS said FROM r WHERE rank <= 5 AND type <> 'co_mentioned' GROUP BY src) SELECT name, concat(name, CASE WHEN coalesce(description, '') <> '' THEN ' (' || description || ')' ELSE '' END, CASE WHEN said IS NULL THEN '' ELSE ' → ' || said END) AS context FROM n LEFT JOIN s ON src = name")
def kg_context(spark, d):
    """KG11: name, description, and the relations among the five heaviest that are no co-mentions."""
    names = {t: read(spark, d, t) for t in ("nation", "region")}
    both = edges(spark, d).unionByName(spark.sql(CO_MENTIONS, nation=names["nation"]))
    return graph.contexts(both, spark.sql(CONTEXT_NODES, **names))
