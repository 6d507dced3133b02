"""Evaluation, training and data queries (EV*, LG13-LG16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from memoquarry.functions import text as T
from memoquarry.operators import learned, recall
from memoquarry.plans.base import query, r6, read
from memoquarry.plans.memory_queries import ASKED, hash_sql
from memoquarry.plans.text_queries import CONTEXT_SQL, FEATURE_SQL, density, tokens
from memoquarry.sources.scratch import scratch_dir

GATED = f"SELECT d.doc_id, d.lang, d.source, l.quality = 1 AS wanted, {density('d.text')} AS score FROM documents d JOIN labels l USING (doc_id)"
CONFUSION = "count(*) FILTER (WHERE wanted AND kept)::BIGINT AS tp, count(*) FILTER (WHERE NOT wanted AND kept)::BIGINT AS fp, count(*) FILTER (WHERE wanted AND NOT kept)::BIGINT AS fn, count(*) FILTER (WHERE NOT wanted AND NOT kept)::BIGINT AS tn"


def gated(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", "source", "text").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rows, p = T.Parts.of(rows)
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("wanted"), T.density(p).alias("score")).withColumn("kept", F.round("score", 9) >= 0.45)


def confusion():
    w, k = F.col("wanted"), F.col("kept")
    return [F.count_if(w & k).alias("tp"), F.count_if(~w & k).alias("fp"), F.count_if(w & ~k).alias("fn"), F.count_if(~w & ~k).alias("tn")]


@query("eval_confusion", f"WITH g AS (SELECT *, round(score, 9) >= 0.45 AS kept FROM ({GATED})), c AS (SELECT {CONFUSION} FROM g) SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS prec, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM c")
def eval_confusion(spark, d):
    """EV1."""
    c = gated(spark, d).agg(*confusion())
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("prec"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("eval_by_category", f"WITH g AS (SELECT *, round(score, 9) >= 0.45 AS kept FROM ({GATED})) SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(CASE WHEN wanted = kept THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g GROUP BY GROUPING SETS ((source), (lang))")
def eval_by_category(spark, d):
    """EV2, EV10: both groupings in one pass."""
    g = gated(spark, d).groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("wanted") == F.col("kept"), 1.0).otherwise(0.0))).alias("accuracy"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "accuracy")


@query("eval_score_gap", f"SELECT wanted, round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(max(score), 6) AS most FROM ({GATED}) GROUP BY wanted")
def eval_score_gap(spark, d):
    """EV3."""
    return gated(spark, d).groupBy("wanted").agg(r6(F.min("score")).alias("least"), r6(F.avg("score")).alias("mean"), r6(F.max("score")).alias("most"))


RATES, THRESHOLDS, SLOT_COUNTS = (0.80, 0.85, 0.90, 0.95, 0.98), (0.03, 0.05, 0.10), (4, 8, 16)


@query("eval_decay_sweep", """WITH p AS (SELECT r AS rate, t AS threshold, s AS slots FROM (SELECT unnest([0.80, 0.85, 0.90, 0.95, 0.98]::DOUBLE[]) AS r), (SELECT unnest([0.03, 0.05, 0.10]::DOUBLE[]) AS t), (SELECT unnest([4, 8, 16]) AS s)),
u AS (SELECT user_id, avg(value) / 100 AS a, user_id % 20 AS age FROM events GROUP BY user_id), w AS (SELECT user_id FROM u ORDER BY round(a, 6) DESC, user_id LIMIT 1), x0 AS (SELECT p.*, user_id, a, a * pow(rate, age) AS now, user_id = (SELECT user_id FROM w) AS anchor FROM p, u),
x AS (SELECT *, row_number() OVER (PARTITION BY rate, threshold, slots ORDER BY round(now, 9) DESC, user_id) AS r FROM x0),
y AS (SELECT rate, threshold, slots, count(*) FILTER (WHERE now >= threshold AND r <= slots)::BIGINT AS held, count(*) FILTER (WHERE now < threshold)::BIGINT AS evicted, coalesce(max(now) FILTER (WHERE anchor AND now >= threshold AND r <= slots), 0) AS recall,
  count(*) FILTER (WHERE anchor AND (now < threshold OR r <= slots))::BIGINT AS found, count(*) FILTER (WHERE now >= threshold AND r <= slots AND round(a, 6) < 0.45)::BIGINT AS noise FROM x GROUP BY rate, threshold, slots)
SELECT rate, threshold, slots, held, evicted, round(recall, 6) AS recall, found, noise, round(held / slots::DOUBLE, 6) AS utilisation, round(3 * recall + found - 0.5 * noise + 0.5 * held / slots, 6) AS composite FROM y""")
def eval_decay_sweep(spark, d):
    """EV4: a parameter grid on closed-form decay: slots held, evictions, whether the strongest memory is recalled or found, weak ones held, and their composite."""
    p = spark.createDataFrame([(r, t, s) for r in RATES for t in THRESHOLDS for s in SLOT_COUNTS], "rate double, threshold double, slots int")
    u = read(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("a")).withColumn("age", F.col("user_id") % 20)
    strongest = u.orderBy(F.desc(F.round("a", 6)), "user_id").limit(1).select("user_id", F.lit(True).alias("anchor"))
    x = u.join(F.broadcast(strongest), "user_id", "left").crossJoin(F.broadcast(p)).withColumn("now", F.col("a") * F.pow("rate", "age"))  # one row; the grid has 45
    keys = ["rate", "threshold", "slots"]
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("now", 9)), "user_id")))
    fits = F.col("r") <= F.col("slots")
    held, anchor = (F.col("now") >= F.col("threshold")) & fits, F.coalesce("anchor", F.lit(False))
    y = x.groupBy(*keys).agg(
        F.count_if(held).alias("held"), F.count_if(F.col("now") < F.col("threshold")).alias("evicted"), F.coalesce(F.max(F.when(anchor & held, F.col("now"))), F.lit(0.0)).alias("recall"),
        F.count_if(anchor & ((F.col("now") < F.col("threshold")) | fits)).alias("found"), F.count_if(held & (F.round("a", 6) < 0.45)).alias("noise"),
    )
    use = F.col("held") / F.col("slots")
    return y.select(*keys, "held", "evicted", r6(F.col("recall")).alias("recall"), "found", "noise", r6(use).alias("utilisation"), r6(3 * F.col("recall") + F.col("found") - 0.5 * F.col("noise") + 0.5 * use).alias("composite"))


WEIGHTS = [(0.6, 0.15, 0.15), (0.7, 0.1, 0.1), (0.5, 0.2, 0.2), (0.4, 0.3, 0.2), (0.8, 0.1, 0.0)]


@query("eval_weight_sweep", f"WITH w AS (SELECT unnest([0.6, 0.7, 0.5, 0.4, 0.8]::DOUBLE[]) AS ws, unnest([0.15, 0.1, 0.2, 0.3, 0.1]::DOUBLE[]) AS wa, unnest([0.15, 0.1, 0.2, 0.2, 0.0]::DOUBLE[]) AS wr), c AS (SELECT q.vec_id AS qid, q.label AS ql, s.vec_id, s.label AS sl, greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[])) AS c FROM embeddings q, embeddings s WHERE q.{ASKED} AND s.vec_id <> q.vec_id), s AS (SELECT *, ws * c + wa * (vec_id % 10) / 10.0 + wr / (1 + 0.1 * (vec_id % 50)) AS score FROM c, w), r AS (SELECT *, row_number() OVER (PARTITION BY ws, qid ORDER BY round(score, 5) DESC, vec_id) AS k FROM s) SELECT ws AS semantic_weight, round(avg(CASE WHEN ql = sl THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1 FROM r WHERE k = 1 GROUP BY ws")
def eval_weight_sweep(spark, d):
    """EV5: precision at 1 of five weightings, each a search of the query set in blocks."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 10 / 10.0).alias("activation"), (F.col("vec_id") % 50).alias("age"))
    best = None
    for ws, wa, wr in WEIGHTS:
        score = lambda q, s, ws=ws, wa=wa, wr=wr: ws * np.maximum(s["score"], 0) + wa * s["activation"] + wr / (1 + 0.1 * s["age"])
        found = recall.search(e.filter(ASKED), e, 1, score, ["activation", "age"], digits=5).select("query_id", "vec_id", F.lit(ws).alias("ws"))
        best = found if best is None else best.unionByName(found)
    label = e.select("vec_id", "label")
    both = best.join(label.withColumnRenamed("label", "sl"), "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return both.groupBy(F.col("ws").alias("semantic_weight")).agg(r6(F.avg(F.when(F.col("ql") == F.col("sl"), 1.0).otherwise(0.0))).alias("precision_at_1"))


@query("eval_kfold", "WITH n AS (SELECT count(*) AS n FROM labels), r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM labels) SELECT least(rn // greatest(n // 5, 1), 4)::BIGINT AS fold, count(*) AS n_rows, sum(quality)::BIGINT AS positives FROM r, n GROUP BY 1")
def eval_kfold(spark, d):
    """EV6: folds by position, the remainder in the last; positions from per-range counts, not one global window.  The ranges are written once, so that both readers see the same."""
    parts = read(spark, d, "labels").select("doc_id", "quality").repartitionByRange("doc_id").withColumn("p", F.spark_partition_id())
    path = scratch_dir(spark, "folds")
    parts.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("doc_id")) - 1).write.parquet(path)
    own = spark.read.schema("doc_id long, quality int, p int, i int").parquet(path)
    n = own.count()
    sizes = own.groupBy("p").agg(F.count(F.lit(1)).alias("size"))  # a row for each range
    before = sizes.select("p", (F.sum("size").over(Window.orderBy("p")) - F.col("size")).alias("before"))
    fold = F.least(F.floor((F.col("i") + F.col("before")) / max(n // 5, 1)), F.lit(4))
    return own.join(F.broadcast(before), "p").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quality").cast("long").alias("positives"))


#: A network with fixed random weights.
NET = learned.Network.seeded(72)
PROFILE_SQL = f"""SELECT conv_id, turn, [round(least(max(coalesce(n, 0)) / 10.0, 1), 6), round(least(sum(coalesce(n, 0)) / max(size)::DOUBLE / 5, 1), 6), round(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) / max(size)::DOUBLE, 6), round(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / max(size)::DOUBLE, 6), round(least(any_value(recalls) / 100.0, 1), 6), round(any_value(top5)::DOUBLE / any_value(total), 6)] AS profile
FROM (SELECT conv_id, turn, unnest(t) AS w, len(t) AS size FROM u) e LEFT JOIN (SELECT *, row_number() OVER (ORDER BY n DESC, w) AS rank FROM a) r USING (w) CROSS JOIN (SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS recalls, (SELECT sum(n) FROM (SELECT n FROM a ORDER BY n DESC, w LIMIT 5)) AS top5, (SELECT sum(n) FROM a) AS total) k GROUP BY conv_id, turn"""
_numbers = lambda x: "[" + ",".join(repr(float(v)) for v in x) + "]::DOUBLE[]"
_hidden = [f"greatest(list_inner_product(f, {_numbers(NET.w1[:, j])}) + {float(NET.b1[j])!r}, 0) * {float(NET.w2[j])!r}" for j in range(len(NET.b1))]
NET_SQL = f"""WITH x AS ({CONTEXT_SQL}), u AS (SELECT conv_id, turn, role, list_distinct({tokens('text')}) AS t FROM conversations), a AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM u WHERE role = 'user') GROUP BY w), p AS ({PROFILE_SQL}),
h AS (SELECT conv_id, turn, [{', '.join(FEATURE_SQL)}]::DOUBLE[] AS rules, {hash_sql('text', 64)} AS v FROM conversations),
m AS (SELECT conv_id, turn, rules, list_transform(range(0, 24), lambda i: v[i * 2 + 1] + v[i * 2 + 2]) AS m FROM h),
g AS (SELECT m.conv_id, m.turn, list_concat(list_concat(rules, list_transform(m, lambda y: y / sqrt(list_inner_product(m, m)))), list_concat([f0, f1, f2, f3, f4, f5, f6, f7]::DOUBLE[], coalesce(profile, [0, 0, 0, 0, 0, 0])::DOUBLE[])) AS f FROM m JOIN x USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)),
i AS (SELECT conv_id, turn, list_transform(f, lambda y: round(y, 6)) AS f FROM g)
SELECT conv_id, turn, len(f)::BIGINT AS inputs, round(1 / (1 + exp(-({' + '.join(_hidden)} + {float(NET.b2)!r}))), 5) AS confidence FROM i"""


@query("net_forward", NET_SQL)
def net_forward(spark, d):
    """LG1-LG13, LG23: all 72 inputs of every turn, and a network of fixed weights as a Column expression."""
    rows = learned.full_features(read(spark, d, "conversations")).withColumn("f", F.transform("features", lambda x: F.round(x, 6)))
    return rows.select("conv_id", "turn", F.size("f").cast("long").alias("inputs"), F.round(NET.column([F.col("f")[i] for i in range(72)]), 5).alias("confidence"))


@query("net_train_cv")
def net_train_cv(spark, d):
    """LG14-LG16, EV7: 5-fold cross-validation of the seeded network; accuracy, precision, recall and F1, their means and deviations."""
    rows = learned.training_rows(read(spark, d, "documents"), read(spark, d, "labels")).orderBy("doc_id").collect()  # TRAIN_ROWS at most
    x, y = np.array([r.features for r in rows]), np.array([float(r.label) for r in rows])
    fold = np.minimum(np.arange(len(rows)) // max(len(rows) // 5, 1), 4)
    out = []
    for k in range(5):
        net = learned.Network.seeded(x.shape[1]).train(x[fold != k], y[fold != k])
        said, is_ = net.forward(x[fold == k]) >= 0.5, y[fold == k] == 1
        tp, fp, fn = (int((a & b).sum()) for a, b in ((said, is_), (said, ~is_), (~said, is_)))
        out.append((k, float((said == is_).mean()), tp / max(tp + fp, 1), tp / max(tp + fn, 1), 2 * tp / max(2 * tp + fp + fn, 1)))
    df = spark.createDataFrame(out, "fold int, accuracy double, prec double, recall double, f1 double")
    every = Window.partitionBy(F.lit(0))  # five rows
    return df.select("fold", *(r6(F.col(c)).alias(c) for c in df.columns[1:]), *(r6(f(c).over(every)).alias(f"{c}_{n}") for c in df.columns[1:] for f, n in ((F.avg, "mean"), (F.stddev_pop, "deviation"))))


@query("data_dedup_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(lower(trim(text))) ORDER BY doc_id) AS r FROM documents WHERE length(text) > 1) WHERE r = 1")
def data_dedup_first(spark, d):
    """EV9: the first of equal contents, by digest so that texts are not shuffled."""
    rows = read(spark, d, "documents").filter(F.char_length("text") > 1)
    return rows.groupBy(F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


#: (template, should_store, category, lang); {} is a brand and [] a port.
TEMPLATES = [
    ("We decided to use {} for storage", True, "decision", "en"),
    ("I prefer {} over the old one", True, "preference", "en"),
    ("Remember: {} listens on port []", True, "fact", "en"),
    ("Actually the port of {} is []", True, "correction", "en"),
    ("我们选择 {}，端口 []", True, "decision", "zh"),
    ("ok {}", False, "filler", "en"),
    ("Maybe we look at {} later", False, "deferral", "en"),
    ("What port does {} use?", False, "question", "en"),
    ("{} 怎么部署", False, "question", "zh"),
]
PORTS = (5432, 6379, 8080)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"


@query("data_template_expand", "WITH t(t, should_store, category, lang) AS (VALUES " + ", ".join(f"({_quoted(t)}, {s}, '{c}', '{lang}')" for t, s, c, lang in TEMPLATES) + f"), n AS (SELECT DISTINCT p_brand AS b FROM part), p AS (SELECT unnest({list(PORTS)}) AS p) SELECT DISTINCT replace(replace(t, '{{}}', b), '[]', p::VARCHAR) AS content, should_store, category, lang FROM t, n, p")
def data_template_expand(spark, d):
    """EV8, EV10: templates times names and ports, equal contents once."""
    t = spark.createDataFrame(TEMPLATES, "t string, should_store boolean, category string, lang string").crossJoin(spark.createDataFrame([(p,) for p in PORTS], "p int"))
    n = read(spark, d, "part").select(F.col("p_brand").alias("b")).distinct()
    filled = F.replace(F.replace("t", F.lit("{}"), F.col("b")), F.lit("[]"), F.col("p").cast("string"))
    return n.crossJoin(F.broadcast(t)).select(filled.alias("content"), "should_store", "category", "lang").dropDuplicates(["content", "should_store", "category", "lang"])  # a few dozen templates
