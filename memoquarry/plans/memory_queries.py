"""Session, state, store and recall queries (L1*, G11-G14, ST*, IO*, PF*, RC*, EM*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.functions import text as T
from memoquarry.operators import decay, recall, session, store
from memoquarry.plans.base import query, r6, read, spread
from memoquarry.plans.text_queries import facts, flag, found, grams, has, importance, relevance, spans, tokens, with_grams
from memoquarry.functions import lexicons as L

K, M = 3, 2


# ---- session ------------------------------------------------------------------------------------------------------
@query("l1_tiers", "SELECT conv_id, turn, CASE WHEN r <= 3 THEN 'window' WHEN r <= 5 THEN 'segment' ELSE 'overflow' END AS tier, later AS overflowed_at FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, lead(turn, 5) OVER (PARTITION BY conv_id ORDER BY turn) AS later FROM conversations)")
def l1_tiers(spark, d):
    """L1a, L1c, L1g, IO1, IO2."""
    return session.tiers(read(spark, d, "conversations"), K, M).select("conv_id", "turn", "tier", "overflowed_at")


@query("l1_recent", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def l1_recent(spark, d):
    """L1b."""
    return session.recent(read(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


@query("l1_budget_context", "WITH t AS (SELECT conv_id, turn, trunc(0.25 * length(text))::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), s AS (SELECT *, CASE WHEN r <= 3 THEN 'window' ELSE 'segment' END AS tier FROM t WHERE r <= 5), g AS (SELECT *, coalesce(sum(tokens) FILTER (WHERE tier = 'segment') OVER (PARTITION BY conv_id ORDER BY turn), 0) AS used_s FROM s), b AS (SELECT conv_id, coalesce(max(used_s) FILTER (WHERE tier = 'segment' AND used_s <= 100), 0) AS base FROM g GROUP BY conv_id), w AS (SELECT g.*, b.base + coalesce(sum(tokens) FILTER (WHERE tier = 'window') OVER (PARTITION BY g.conv_id ORDER BY turn), 0) AS used_w FROM g JOIN b USING (conv_id)) SELECT conv_id, count(*)::BIGINT AS n_items, sum(tokens)::BIGINT AS tokens FROM w WHERE CASE WHEN tier = 'segment' THEN used_s <= 100 ELSE used_w <= 100 END GROUP BY conv_id")
def l1_budget_context(spark, d):
    """L1d, L1f: each tier stops at its first item that exceeds the budget."""
    rows = session.tiers(read(spark, d, "conversations"), K, M).withColumn("tokens", T.token_estimate(F.col("text")))
    return session.budget_context(rows, 100).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens"))


@query("l1_segment_merge", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), s AS (SELECT *, {spans('text')} AS e FROM t WHERE r > 3),
n AS (SELECT conv_id, string_agg(w, ',' ORDER BY w) AS entities FROM (SELECT DISTINCT conv_id, w FROM (SELECT conv_id, unnest(e) AS w FROM s UNION ALL SELECT conv_id, role FROM s)) GROUP BY conv_id)
SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, least(sum(trunc(0.25 * length(text))::BIGINT), 200)::BIGINT AS tokens, any_value(entities) AS entities FROM s JOIN n USING (conv_id) GROUP BY conv_id""")
def l1_segment_merge(spark, d):
    """L1h, L1j: range, count, tokens up to 200, and the union of entities and tags (the role stands for a tag)."""
    rows = session.tiers(read(spark, d, "conversations"), K, M).filter("tier <> 'window'")
    return session.merge_segments(T.with_entities(rows, "text").withColumn("tokens", T.token_estimate(F.col("text"))).withColumn("tags", F.array("role")))


@query("l1_total_tokens", "SELECT conv_id, sum(trunc(0.25 * length(text))::BIGINT)::BIGINT AS tokens, count(*) AS held FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id")
def l1_total_tokens(spark, d):
    """L1f: what a session holds; L1e leaves nothing of it."""
    rows = session.tiers(read(spark, d, "conversations"), K, M).filter("tier <> 'overflow'").withColumn("tokens", T.token_estimate(F.col("text")))
    return rows.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("held"))


@query("l1_recall", f"""WITH t AS (SELECT conv_id, turn, lower(text) AS t, {tokens('text')} AS tl, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
g AS (SELECT *, list_distinct(tl) AS tt, list_distinct({grams('tl')}) AS tg FROM t), q AS (SELECT conv_id, t AS q, tt AS qt, tg AS qg FROM g WHERE r = 1),
x AS (SELECT conv_id, turn, r, {relevance('q', 't', 'qg', 'tg', 'qt', 'tt')} AS raw FROM g JOIN q USING (conv_id) WHERE r BETWEEN 2 AND 5)
SELECT conv_id, turn, round(raw * CASE WHEN r <= 3 THEN 0.8 ELSE 0.6 END, 6) AS score FROM x WHERE raw > 0.05""")
def l1_recall(spark, d):
    """L1k, RC13, PF6: the newest turn asks, the others of the session answer by relevance, weighted by tier."""
    rows = session.tiers(read(spark, d, "conversations"), K, M).filter("tier <> 'overflow'")
    return session.recall(rows).select("conv_id", "turn", r6(F.col("score")).alias("score"))


# ---- gate on vectors ----------------------------------------------------------------------------------------------
ASKED = "vec_id % 100 = 0"  # the query set; it meets all rows but itself


@query("gate_novelty", f"SELECT q.vec_id AS query_id, round(max(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[])), 5) AS top_similarity, max(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[])) < 0.7 AS novel FROM embeddings q, embeddings s WHERE q.{ASKED} AND s.vec_id <> q.vec_id GROUP BY q.vec_id")
def gate_novelty(spark, d):
    """G1, G11."""
    e = read(spark, d, "embeddings")
    best = recall.nearest(e.filter(ASKED), e, 1)
    return best.select("query_id", F.round("score", 5).alias("top_similarity"), (F.col("score") < 0.7).alias("novel"))


#: SQL of a hash embedding of ``dim`` numbers, before it is given unit length (a cosine does not need that).
def hash_sql(x: str, dim: int) -> str:
    return f"list_transform(range(0, {dim}), lambda i: (('0x' || substr(sha256({x}), ((i % 32) * 2 + 1)::INTEGER, 2))::INTEGER)::DOUBLE / 255 * 2 - 1)"


@query("gate_decision", f"""WITH t AS (SELECT conv_id, turn, {importance('text')} AS imp, {has('text', L.EXPLICIT)} AS explicit, {has('text', L.CORRECTION)} AS correction, {hash_sql('text', 8)} AS v FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS slot, list_cosine_similarity(a.v, b.v) AS sim FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn < a.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(sim, 9) DESC, slot) AS k FROM p),
s AS (SELECT conv_id, turn, max(sim) AS sim, list(slot ORDER BY k) AS slots FROM r GROUP BY conv_id, turn),
y AS (SELECT t.*, coalesce(s.sim, 0) AS sim, coalesce(slots, []) AS slots, coalesce(s.sim, 0) < 0.7 AS novel FROM t LEFT JOIN s USING (conv_id, turn)),
z AS (SELECT *, CASE WHEN explicit THEN CASE WHEN novel THEN 'new' ELSE 'update' END WHEN imp < 0.2 AND NOT novel THEN 'reject' WHEN novel AND imp >= 0.25 THEN 'new' WHEN sim >= 0.7 THEN CASE WHEN correction THEN 'overwrite' WHEN sim > 0.9 THEN 'merge' ELSE 'update' END WHEN novel AND imp >= 0.2 THEN 'new' ELSE 'reject' END AS decision FROM y)
SELECT conv_id, turn, decision, CASE WHEN decision IN ('update', 'merge', 'overwrite') THEN slots[1] END AS target,
  round(CASE WHEN decision = 'reject' THEN 0 WHEN explicit OR novel THEN greatest(imp, 0.4) ELSE greatest(imp, 0.3) END, 6) AS strength,
  array_to_string(CASE WHEN decision = 'reject' THEN [] WHEN explicit OR novel THEN slots[1:3] ELSE slots[2:4] END, ',') AS co_activations FROM z""")
def gate_decision(spark, d):
    """G12, G13: every turn against the turns before it in its conversation, which stand for slots."""
    turns = T.with_importance(T.with_hash_embedding(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", 8, "v"))
    turns = turns.withColumn("low", F.lower("text")).select("conv_id", "turn", "v", "importance", T.has(F.col("low"), L.EXPLICIT).alias("explicit"), T.has(F.col("low"), L.CORRECTION).alias("correction"))
    slots = turns.select("conv_id", F.col("turn").alias("slot"), F.col("v").alias("s"))
    near = turns.select("conv_id", "turn", "v").join(slots, "conv_id").filter("slot < turn").withColumn("sim", T.cosine(F.col("v"), F.col("s")))  # turns of one conversation
    ranked = near.groupBy("conv_id", "turn").agg(F.max("sim").alias("similarity"), F.sort_array(F.collect_list(F.struct((-F.round("sim", 9)).alias("k"), "slot"))).alias("ranked"))
    rows = turns.join(ranked, ["conv_id", "turn"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).withColumn("slots", F.coalesce(F.transform("ranked", lambda x: x["slot"]), F.array().cast("array<long>")))
    return recall.decide(rows).select("conv_id", "turn", "decision", "target", r6(F.col("strength")).alias("strength"), F.array_join("co_activations", ",").alias("co_activations"))


@query("gate_free_slot", "WITH s AS (SELECT user_id AS ns, event_id % 8 AS slot, count(*) FILTER (WHERE event_type <> 'error') AS n, max(value) / 120 AS a FROM events GROUP BY 1, 2), f AS (SELECT ns, min(slot) FILTER (WHERE n = 0) AS empty, min(a) AS least, arg_min(slot, a * 1000000 + slot / 1000.0) AS weakest FROM s GROUP BY ns) SELECT ns, coalesce(empty, CASE WHEN least > 0.6 THEN -1 ELSE weakest END)::BIGINT AS free_slot FROM f")
def gate_free_slot(spark, d):
    """G14, ST17: the first empty slot, else the weakest, else none when saturated."""
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("ns"), (F.col("event_id") % 8).alias("slot")).agg(F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("n"), (F.max("value") / 120).alias("a"))
    f = s.groupBy("ns").agg(F.min(F.when(F.col("n") == 0, F.col("slot"))).alias("empty"), F.min("a").alias("least"), F.min_by("slot", F.struct("a", "slot")).alias("weakest"))
    return f.select("ns", F.coalesce("empty", F.when(F.col("least") > 0.6, -1).otherwise(F.col("weakest"))).cast("long").alias("free_slot"))


# ---- decay and state ----------------------------------------------------------------------------------------------
@query("decay_trajectory", "WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, event_type = 'purchase' AS touch FROM events), s AS (SELECT *, sum(CASE WHEN touch THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM e), b AS (SELECT *, min(t) OVER (PARTITION BY user_id, seg) AS t0, row_number() OVER (PARTITION BY user_id, seg ORDER BY event_id) - 1 AS n FROM s WHERE seg > 0), c AS (SELECT *, sum(t - t0) OVER (PARTITION BY user_id, seg ORDER BY event_id) AS elapsed FROM b) SELECT user_id, event_id, seg::BIGINT AS rehearsals, round(pow(0.95::DOUBLE, n) * pow(2::DOUBLE, -elapsed / (3600 * 1000 * (1 + 0.5 * seg))), 6) AS activation FROM c")
def decay_trajectory(spark, d):
    """ST6, ST7: between touches, step decay and the compounding time decay in closed form."""
    e = read(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") == "purchase").alias("touch"))
    return decay.trajectories(e, "user_id", "event_id", "t", "touch", rate=0.95, half_life=3600.0 * 1000).select("user_id", "event_id", "rehearsals", r6(F.col("activation")).alias("activation"))


@query("decay_cold_start", "SELECT event_id, round(value / 100 * pow(0.95::DOUBLE, floor((event_id % 4000) / 30.0)), 6) AS activation FROM events")
def decay_cold_start(spark, d):
    """ST8."""
    return read(spark, d, "events").select("event_id", r6(decay.cold_start(F.col("value") / 100, F.col("event_id") % 4000)).alias("activation"))


SLOT_STATE = "SELECT user_id AS slot, least(1.0, sum(value) / 1000) AS activation, max(event_id) AS last_step, count(*) AS writes FROM {events} GROUP BY user_id"
SLOT_SQL = SLOT_STATE.format(events="events")


def slots(spark, d):
    """A slot for each user: the snapshot that state queries act on."""
    return spark.sql(SLOT_STATE, events=read(spark, d, "events"))


@query("state_co_activation", f"WITH s AS ({SLOT_SQL}), c AS (SELECT DISTINCT (user_id + 1) % 150 AS slot FROM events WHERE event_type = 'purchase') SELECT s.slot, round(CASE WHEN c.slot IS NULL THEN activation ELSE least(1.0, activation * (1 + 0.1 * 0.5)) END, 6) AS activation FROM s LEFT JOIN c USING (slot)")
def state_co_activation(spark, d):
    """ST10, ST14, ST15."""
    touched = read(spark, d, "events").filter("event_type = 'purchase'").select(F.explode(F.array((F.col("user_id") + 1) % 150)).alias("slot")).distinct().withColumn("hit", F.lit(True))
    a = F.when(F.col("hit"), F.least(F.lit(1.0), F.col("activation") * (1 + 0.1 * 0.5))).otherwise(F.col("activation"))
    return slots(spark, d).join(touched, "slot", "left").select("slot", r6(a).alias("activation"))


@query("state_eviction", f"WITH s AS ({SLOT_SQL}) SELECT slot, 'eviction' AS source, round(activation * pow(0.95::DOUBLE, slot % 90), 6) AS importance FROM s WHERE activation * pow(0.95::DOUBLE, slot % 90) < 0.05")
def state_eviction(spark, d):
    """ST11, ST12, ST13."""
    a = F.col("activation") * F.pow(F.lit(0.95), F.col("slot") % 90)
    return slots(spark, d).filter(a < 0.05).select("slot", F.lit("eviction").alias("source"), r6(a).alias("importance"))


@query("state_compact", f"WITH s AS ({SLOT_SQL}), a AS (SELECT max(ts) AS now FROM events) SELECT (SELECT count(*) FROM s WHERE activation * pow(0.95::DOUBLE, slot % 90) < 0.1) AS evicted, (SELECT least(count(*), 1000) FROM events, a WHERE epoch(ts) <= epoch(now) - 20 * 86400) AS archived")
def state_compact(spark, d):
    """ST18, PF12, PF13."""
    e = read(spark, d, "events")
    evicted = slots(spark, d).filter(F.col("activation") * F.pow(F.lit(0.95), F.col("slot") % 90) < 0.1).agg(F.count(F.lit(1)).alias("evicted"))
    now = e.agg(F.max("ts").alias("now"))
    archived = e.join(F.broadcast(now), F.col("ts") <= F.col("now") - F.expr("interval 20 days")).agg(F.least(F.count(F.lit(1)), F.lit(1000)).alias("archived"))
    return evicted.crossJoin(archived)


@query("state_status", f"WITH s AS ({SLOT_SQL}), e AS (SELECT count(*) AS records, count(DISTINCT user_id) AS entities, max(event_id) AS steps, count(*) FILTER (WHERE event_type = 'error') AS archived FROM events), c AS (SELECT count(*) AS turns, count(DISTINCT conv_id) AS sessions FROM conversations) SELECT (SELECT count(*) FROM s WHERE activation > 0.5) AS active, (SELECT count(*) FROM s) AS used, e.*, c.* FROM e, c")
def state_status(spark, d):
    """ST20, KG12, PF8."""
    e = read(spark, d, "events").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("user_id").alias("entities"), F.max("event_id").alias("steps"), F.count_if(F.col("event_type") == "error").alias("archived"))
    c = read(spark, d, "conversations").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("sessions"))
    return slots(spark, d).agg(F.count_if(F.col("activation") > 0.5).alias("active"), F.count(F.lit(1)).alias("used")).crossJoin(e).crossJoin(c)


@query("slot_preview", "WITH s AS (SELECT conv_id, arg_max(text, turn) AS state, least(1.0, count(*) / 7.0) AS activation FROM conversations GROUP BY conv_id) SELECT conv_id, round(activation, 3) AS activation, left(state, 100) AS preview FROM s ORDER BY round(activation, 3) DESC, conv_id LIMIT 20")
def slot_preview(spark, d):
    """PF10, ST14: the twenty most active slots (one for each conversation) with the head of their text."""
    s = read(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("state"), F.least(F.lit(1.0), F.count(F.lit(1)) / 7.0).alias("activation"))
    return s.select("conv_id", F.round("activation", 3).alias("activation"), F.substring("state", 1, 100).alias("preview")).orderBy(F.desc("activation"), "conv_id").limit(20)


# ---- recall -------------------------------------------------------------------------------------------------------
COS = "list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[])"
SCORED = f"SELECT q.vec_id AS query_id, s.vec_id AS slot_id, 0.6 * greatest(0, {COS}) + 0.15 * (s.vec_id % 10) / 10.0 + 0.15 / (1 + 0.1 * greatest(1, 500 - s.vec_id % 500)) + CASE WHEN q.label = s.label THEN 0.2 ELSE 0 END AS score FROM embeddings q, embeddings s WHERE q.{ASKED} AND s.vec_id <> 40 AND s.vec_id <> q.vec_id"


def _slot_scores(spark, d, k: int):
    """The k best slots of each query; a slot for each vector, its entity the label, without the excluded one (PF7)."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 10 / 10.0).alias("activation"), (500 - F.col("vec_id") % 500).alias("age"))
    score = lambda q, s: recall.slot_score(s["score"], s["activation"], s["age"], q["label"] == s["label"], 1)
    found = recall.search(e.filter(ASKED), e.filter("vec_id <> 40"), k, score, ["label", "activation", "age"], digits=5)
    return found.select("query_id", F.col("vec_id").alias("slot_id"), F.round("score", 5).alias("score"))


@query("slot_score_topk", f"WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, slot_id) AS rank FROM s) SELECT query_id, slot_id, round(score, 5) AS score FROM r WHERE rank <= 5")
def slot_score_topk(spark, d):
    """RC0-RC4, PF7."""
    return _slot_scores(spark, d, 5)


@query("recall_rehearsal", f"WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, slot_id) AS rank FROM s), h AS (SELECT slot_id, count(*) AS n, max(query_id) AS last FROM r WHERE rank <= 5 GROUP BY slot_id) SELECT slot_id, n AS rehearsals, last AS last_active_step, round(least(1.0, (slot_id % 10) / 10.0 + 0.1 * n), 6) AS activation FROM h")
def recall_rehearsal(spark, d):
    """RC5: returned slots are boosted and refreshed each time they are returned (the query's id is the step)."""
    hits = _slot_scores(spark, d, 5).groupBy("slot_id").agg(F.count(F.lit(1)).alias("rehearsals"), F.max("query_id").alias("last_active_step"))
    return hits.select("slot_id", "rehearsals", "last_active_step", r6(F.least(F.lit(1.0), F.col("slot_id") % 10 / 10.0 + 0.1 * F.col("rehearsals"))).alias("activation"))


@query("l3_knn", f"WITH k AS (SELECT q.vec_id AS query_id, s.vec_id, s.label, {COS} AS c FROM embeddings q, embeddings s WHERE q.{ASKED} AND s.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 5) DESC, vec_id) AS rank FROM k) SELECT query_id, vec_id, round(c, 5) AS score FROM r WHERE rank <= 5 AND label <> 3")
def l3_knn(spark, d):
    """RC6: archived hits (label 3 here) are dropped after the k nearest are taken."""
    e = read(spark, d, "embeddings")
    best = recall.nearest(e.filter(ASKED), e, 5, digits=5)
    return best.join(e.filter("label <> 3").select("vec_id"), "vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("state_forget", f"WITH k AS (SELECT q.vec_id AS query_id, s.vec_id, {COS} AS c FROM embeddings q, embeddings s WHERE q.{ASKED} AND s.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 5) DESC, vec_id) AS rank FROM k), s AS ({SCORED}), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, slot_id) AS rank FROM s) SELECT DISTINCT 'l3' AS layer, vec_id, 'archived' AS fate FROM r WHERE rank <= 5 UNION ALL SELECT DISTINCT 'l2', slot_id, 'evicted' FROM l WHERE rank <= 5 AND round(score, 5) > 0.5")
def state_forget(spark, d):
    """ST13, ST19, RC12, PF6: of the five best slots those over 0.5 are evicted, and the five nearest records are archived whatever their distance."""
    e = read(spark, d, "embeddings")
    slots = _slot_scores(spark, d, 5).filter("score > 0.5").select(F.lit("l2").alias("layer"), F.col("slot_id").alias("vec_id"), F.lit("evicted").alias("fate")).distinct()
    return recall.nearest(e.filter(ASKED), e, 5, digits=5).select(F.lit("l3").alias("layer"), "vec_id", F.lit("archived").alias("fate")).distinct().unionByName(slots)


@query("l3_hybrid", f"WITH k AS (SELECT s.vec_id, s.label, row_number() OVER (ORDER BY round({COS}, 5) DESC, s.vec_id) AS rank FROM embeddings q, embeddings s WHERE q.vec_id = 0 AND s.vec_id <> 0), u AS (SELECT vec_id FROM k WHERE rank <= 10 UNION SELECT vec_id FROM (SELECT vec_id FROM embeddings WHERE label = 4 AND vec_id <> 0 ORDER BY (vec_id % 97) DESC, vec_id LIMIT 5)) SELECT vec_id, round((vec_id % 97) / 97.0, 6) AS importance FROM u ORDER BY vec_id % 97 DESC, vec_id LIMIT 5")
def l3_hybrid(spark, d):
    """RC9, RC7: nearest and entity hits, one row each, most important first."""
    e = read(spark, d, "embeddings")
    near = recall.nearest(e.filter("vec_id = 0"), e, 10, digits=5).select("vec_id")
    entity = e.filter("label = 4 and vec_id <> 0").orderBy(F.desc(F.col("vec_id") % 97), "vec_id").limit(5).select("vec_id")
    both = near.unionByName(entity).dropDuplicates(["vec_id"])
    return both.orderBy(F.desc(F.col("vec_id") % 97), "vec_id").limit(5).select("vec_id", r6(F.col("vec_id") % 97 / 97.0).alias("importance"))


FEDERATED = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
q AS (SELECT conv_id AS query_id, text AS q, {hash_sql('text', 64)} AS v FROM t WHERE r = 1),
w AS (SELECT query_id, lower(q) AS lq, list_distinct({tokens('q')}) AS qt, list_distinct({grams(tokens('q'))}) AS qg FROM q),
g AS (SELECT conv_id AS query_id, turn, r, text, lower(text) AS lt, list_distinct({tokens('text')}) AS tt, list_distinct({grams(tokens('text'))}) AS tg FROM t WHERE r BETWEEN 2 AND 5),
l1 AS (SELECT query_id, 'l1' AS layer, 1 AS branch, text, CASE WHEN r <= 3 THEN 0.8 ELSE 0.6 END * raw AS score, turn AS n FROM (SELECT *, {relevance('lq', 'lt', 'qg', 'tg', 'qt', 'tt')} AS raw FROM g JOIN w USING (query_id)) WHERE raw > 0.05),
c AS (SELECT q.query_id, s.vec_id, list_cosine_similarity(q.v, s.embedding::DOUBLE[]) AS c FROM q, embeddings s),
k2 AS (SELECT *, round(0.6 * greatest(0, c) + 0.15 * (vec_id % 10) / 10.0 + 0.15 / (1 + 0.1 * greatest(1, 500 - vec_id % 500)), 5) AS score FROM c),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k2),
l2 AS (SELECT query_id, 'l2', 2, d.text, score, vec_id FROM r2 JOIN documents d ON d.doc_id = vec_id WHERE rank <= 5 AND score >= 0.2),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 5) DESC, vec_id) AS rank FROM c),
l3 AS (SELECT query_id, 'l3', 3, d.text, {importance('d.text')}, vec_id FROM r3 JOIN documents d ON d.doc_id = vec_id WHERE rank <= 5),
qw AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(q, '\\s+')) AS name FROM q),
en AS (SELECT query_id, name, d.text, d.doc_id, {importance('d.text')} AS imp FROM qw JOIN documents d ON split_part(d.text, ' ', 1) = name WHERE name <> ''),
l4 AS (SELECT query_id, 'l3', 4, text, imp * 0.9, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY round(imp, 6) DESC, doc_id) AS rank FROM en) WHERE rank <= 3),
u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4),
f AS (SELECT *, left(text, 100) AS key, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY branch, round(score, 6) DESC, n) AS first FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, branch, key) AS rank FROM f WHERE first = 1)
SELECT query_id, rank::BIGINT AS rank, layer, key, round(score, 6) AS score, (sum(trunc(1.5 * {found('text', '[\\x{2E81}-\\x{10FFFF}]')} + 0.25 * (length(text) - {found('text', '[\\x{2E81}-\\x{10FFFF}]')}))) OVER (PARTITION BY query_id))::BIGINT AS total_tokens FROM r WHERE rank <= 5"""


@query("recall_federated", FEDERATED)
def recall_federated(spark, d):
    """RC10, PF5, PF6, EM2, EM5: the newest turn of each conversation asks its session, the slots, the records nearest by hash embedding, and the records of
    entities that its words name; texts with equal heads are kept once in layer order; with the tokens of what is returned.

    A slot and a record for each vector, with the document of the same id; a document's entity is its first word.
    """
    turns, docs, e = read(spark, d, "conversations"), read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), read(spark, d, "embeddings").select("vec_id", "embedding")
    e = spread(e)
    tiers = session.tiers(turns, K, M).filter("tier <> 'overflow'")
    asked = tiers.filter("r = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("q"))
    own = recall.headed(session.recall(tiers).join(turns, ["conv_id", "turn"]))
    l1 = recall.layer(own.select(F.col("conv_id").alias("query_id"), "key", "tokens", "score", F.col("turn").alias("n")), F.lit("l1"), F.lit(1))
    # a filter on the embedding would compute it anew for each of its components
    vectors = T.with_hash_embedding(asked.filter("q is not null"), "q", 64, "embedding").select(F.col("query_id").alias("vec_id"), "embedding")
    slots = e.withColumn("activation", F.col("vec_id") % 10 / 10.0).withColumn("age", 500 - F.col("vec_id") % 500)
    blank = vectors.withColumn("activation", F.lit(0.0)).withColumn("age", F.lit(0).cast("long"))
    score = lambda q, s: recall.slot_score(s["score"], s["activation"], s["age"], 0, 0)
    best = recall.search(blank, slots, 5, score, ["activation", "age"], digits=5, itself=True).filter(F.round("score", 5) >= 0.2)
    near = recall.search(vectors, e, 5, lambda q, r: r["score"], [], digits=5, itself=True)
    words = asked.select("query_id", F.explode(F.array_distinct(F.split("q", r"\s+"))).alias("name")).filter("name <> ''")
    records, vec = docs.withColumn("name", F.substring_index("text", " ", 1)), recall.by_id(F.col("vec_id"))
    # only what a vector or a word leads to is scored
    wanted = records.select("id", "name").join(words.select("name").distinct(), "name", "left_semi").select("id").union(e.select("vec_id")).distinct()
    most = docs.count() + e.count()
    wanted = spread(records.join(recall.sent(wanted, most if most <= recall.SENT_IDS else wanted.count()), "id", "left_semi"), docs)
    asks = [
        recall.hits(best, vec, "l2", 2, F.round("score", 5)),
        recall.hits(near, vec, "l3", 3, F.lit(None)),
        recall.hits(words, recall.by_name(F.col("name")), "l3", 4, F.lit(None), 0.9),
    ]
    met = reduce(DataFrame.unionByName, asks).join(recall.known(wanted, 3, lambda rows: T.with_importance(rows, "text", "imp")), "by")
    rest = recall.layer(met.withColumns({"score": F.coalesce("score", F.col("imp") * F.col("weight")), "n": F.col("id")}), F.col("layer"), F.col("branch"))
    out = recall.federate([l1, rest], 5).withColumn("total_tokens", F.sum("tokens").over(Window.partitionBy("query_id")))
    return out.select("query_id", "rank", "layer", "key", r6(F.col("score")).alias("score"), "total_tokens")


EMBED_SQL = f"SELECT doc_id, {hash_sql('text', 64)} AS v FROM documents"


@query("embed_hash", f"WITH v AS ({EMBED_SQL}) SELECT doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS e0, round(v[8] / sqrt(list_inner_product(v, v)), 6) AS e7, round(v[40] / sqrt(list_inner_product(v, v)), 6) AS e39 FROM v")
def embed_hash(spark, d):
    """EM1, EM2: 64 numbers of 32 bytes, so that the period shows."""
    v = T.with_hash_embedding(read(spark, d, "documents").select("doc_id", "text"), "text", 64, "v")
    return v.select("doc_id", *(r6(F.col("v")[i]).alias(f"e{i}") for i in (0, 7, 39)))


# ---- store --------------------------------------------------------------------------------------------------------
@query("l3_latest_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def l3_latest_wins(spark, d):
    """IO6, IO7, PF9: the newest version of each record."""
    return store.latest(read(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("l3_access_log", "SELECT user_id, count(*) AS load_count, max(event_id) AS last_loaded FROM events WHERE event_type = 'view' GROUP BY user_id")
def l3_access_log(spark, d):
    """RC11."""
    return store.access_counts(read(spark, d, "events").filter("event_type = 'view'"), "user_id", "event_id")


@query("l3_record", "SELECT p_partkey AS id, p_brand || '|' || p_type AS entities, p_size > 25 AS archived FROM part WHERE p_partkey = 77")
def l3_record(spark, d):
    """IO7, PF9: one record by its id, its JSON as a list and its integer as a flag."""
    stored = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.array("p_brand", "p_type")).alias("entities"), (F.col("p_size") > 25).cast("int").alias("archived"))
    return store.records_view(stored.filter("id = 77")).withColumn("entities", F.array_join("entities", "|"))


@query("l3_archive", "SELECT event_id, value, t.by AS superseded_by, t.by IS NULL AS live FROM events e LEFT JOIN (SELECT event_id - 1 AS id, event_id AS by FROM events WHERE event_type = 'error') t ON t.id = e.event_id WHERE event_type <> 'login'")
def l3_archive(spark, d):
    """RC12, PF1, PF2: rows outside one namespace (event types stand for these), archived by a tombstone that names their successor."""
    e = read(spark, d, "events")
    dead = e.filter("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id"), F.col("event_id").alias("superseded_by"))
    return store.archived(e.filter("event_type <> 'login'").select("event_id", "value"), dead, "event_id")


@query("l3_time_search", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' ORDER BY ts DESC, event_id LIMIT 50")
def l3_time_search(spark, d):
    """PF3, RC8."""
    return read(spark, d, "events").filter("ts between timestamp_ntz '2024-01-05' and timestamp_ntz '2024-01-06'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


@query("l3_entity_search", "WITH r AS (SELECT p_partkey AS utt_key, to_json([p_brand, p_type])::VARCHAR AS entities, round(p_retailprice, 2) AS importance, pattern FROM part, (SELECT unnest(['brand#2', 'Brand#_', '%BRASS']) AS pattern)), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY importance DESC, utt_key) AS rank FROM r WHERE entities ILIKE '%\"' || pattern || '\"%') SELECT pattern, utt_key, importance FROM k WHERE rank <= 10")
def l3_entity_search(spark, d):
    """PF4, RC7: containment in the JSON text, in any case, with the wildcards of an entity alive; ten for each."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("utt_key"), F.array("p_brand", "p_type").alias("entities"), F.round("p_retailprice", 2).alias("importance"))
    return store.search_entities(rows, ["brand#2", "Brand#_", "%BRASS"], 10).select("pattern", "utt_key", "importance")


@query("l3_snapshot_latest", "WITH s AS (SELECT user_id, max(event_id) AS step FROM events GROUP BY user_id), x AS (SELECT e.user_id, e.event_id AS step, e.event_type, e.value FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id = s.step) SELECT user_id, step, event_type AS topic, round(value * pow(0.95::DOUBLE, 2), 6) AS activation FROM x")
def l3_snapshot_latest(spark, d):
    """IO11-IO14: newest snapshot as JSON, restored to its number of slots with a cold-start decay of 60 s."""
    snapshots = read(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.to_json(F.array(F.struct(F.col("event_type").alias("topic"), F.col("value").alias("activation")))).alias("slots_json"))
    newest = store.newest_snapshot(snapshots, "user_id", "step", "slots_json")
    return store.restore(newest, "slots_json", "topic string, activation double", elapsed=60.0, slots=1).select("user_id", "step", "topic", r6(F.col("activation")).alias("activation"))


# ---- feedback -----------------------------------------------------------------------------------------------------
@query("feedback_positive", "SELECT p.user_id, min(p.event_id) AS event_id, 1.0 AS target FROM events p WHERE p.event_type = 'click' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = p.user_id) GROUP BY p.user_id")
def feedback_positive(spark, d):
    """LG18, LG19: the first stored prediction of a recalled slot becomes a positive sample."""
    e = read(spark, d, "events")
    recalled = e.filter("event_type = 'view'").select("user_id").distinct()
    return e.filter("event_type = 'click'").join(recalled, "user_id", "left_semi").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("target", F.lit(1.0))


@query("feedback_negative", "SELECT e.user_id, e.event_id, 0.0 AS target, 0.006 AS rate FROM events e WHERE e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = e.user_id AND r.event_id < e.event_id)")
def feedback_negative(spark, d):
    """LG20: an eviction that no recall of its slot came before is a negative sample at 0.3 of the rate."""
    e = read(spark, d, "events")
    first = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first"))
    evicted = e.filter("event_type = 'error'").select("user_id", "event_id").join(first, "user_id", "left")
    return evicted.filter("first is null or event_id < first").select("user_id", "event_id", F.lit(0.0).alias("target"), F.lit(0.006).alias("rate"))


@query("feedback_log", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, row_number() OVER (PARTITION BY user_id, length(event_type) > 5 ORDER BY event_id DESC) AS m FROM events) SELECT user_id, count(*) FILTER (WHERE n <= 500) AS held, count(*) FILTER (WHERE m <= 20 AND length(event_type) > 5) AS topics, min(event_id) FILTER (WHERE n <= 500) AS oldest FROM r GROUP BY user_id")
def feedback_log(spark, d):
    """LG18: the log of each slot holds 500 predictions, and 20 topics of over five characters."""
    topic = F.char_length("event_type") > 5
    newest = lambda *by: F.row_number().over(Window.partitionBy("user_id", *by).orderBy(F.desc("event_id")))
    r = read(spark, d, "events").select("user_id", "event_id", topic.alias("topic")).withColumn("n", newest()).withColumn("m", newest("topic"))
    return r.groupBy("user_id").agg(F.count_if(F.col("n") <= 500).alias("held"), F.count_if((F.col("m") <= 20) & F.col("topic")).alias("topics"), F.min(F.when(F.col("n") <= 500, F.col("event_id"))).alias("oldest"))


@query("state_replay")
def state_replay(spark, d):
    """ST1-ST5, ST9, ST16: conversations replayed through slot allocation, a namespace at a time."""
    from memoquarry.operators.replay import replay

    return replay(read(spark, d, "conversations"))


@query("stream_replay")
def stream_replay(spark, d):
    """The same replay as a Structured Streaming job over the conversation files."""
    from memoquarry.streaming.replay import replay_stream

    return replay_stream(spark, f"{d}/conversations.parquet")
