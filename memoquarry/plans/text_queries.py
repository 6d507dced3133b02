"""Text, gate and feature queries (TX*, G*, LG*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memoquarry.functions import lexicons as L
from memoquarry.functions import text as T
from memoquarry.operators import learned, recall
from memoquarry.plans.base import UTTERANCES_SQL, query, r6, read, spread, utterances


# ---- pieces of SQL, written from the formulas in DuckDB's dialect -------------------------------------------------
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def has(x: str, pattern: str) -> str:
    return rx(f"lower({x})", pattern)


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)::DOUBLE"


def found(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def count(x: str, pattern: str) -> str:
    return found(f"lower({x})", pattern)


def capped(x: str, cap: float) -> str:
    return f"least({x} / {cap}::DOUBLE, 1.0)"


STOPS_ZH, STOPS_EN = ("[" + ",".join(map(lit, s)) + "]" for s in (L.STOP_ZH, L.STOP_EN))


def tokens(x: str) -> str:
    """Set each CJK character apart, then take runs of letters and digits."""
    apart = f"regexp_replace(lower({x}), {lit('([' + L.CJK + '])')}, ' \\1 ', 'g')"
    return f"list_filter(regexp_extract_all({apart}, '[\\p{{L}}\\p{{N}}]+'), lambda t: CASE WHEN regexp_matches(t, {lit('^[' + L.CJK + ']')}) THEN NOT list_contains({STOPS_ZH}, t) ELSE length(t) > 1 AND NOT list_contains({STOPS_EN}, t) END)"


def grams(t: str) -> str:
    """Bigrams over the CJK tokens of a list, then its other tokens."""
    chars = f"list_filter({t}, lambda c: length(c) = 1)"
    return f"list_concat(list_transform(range(1, len({chars})), lambda i: ({chars})[i] || ({chars})[i + 1]), list_filter({t}, lambda w: length(w) > 1))"


def all_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(L.WORD + '+')})"


def kind(x: str, k: str) -> str:
    return rx(x, L.STRUCTURE[k]) if k in L.AS_IT_IS else has(x, L.STRUCTURE[k])


def kinds(x: str) -> str:
    return "(" + " + ".join(flag(kind(x, k)) for k in L.STRUCTURE) + ")"


def density(x: str) -> str:
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)"
    t, w = tokens(x), all_words(x)
    content = f"len(list_filter({w}, lambda q: length(q) > 1 AND NOT list_contains({STOPS_EN}, q) AND NOT list_contains({STOPS_ZH}, q)))"
    size = f"(CASE WHEN length({x}) < 5 THEN 0.0 WHEN length({x}) < 15 THEN 0.2 WHEN length({x}) < 200 THEN 0.7 ELSE 0.5 END)::DOUBLE"
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE ({capped(kinds(x), 3)} + {ratio(f'len(list_distinct({t}))', f'len({t})')} + {ratio(content, f'len({w})')} + {size} + {capped(count(x, '[0-9]+'), 3)}) / 5 END)"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def filler(x: str, words: str = L.FILLER) -> str:
    return has(stripped(x), f"^(?:{words})$")


def noise(x: str) -> str:
    s = stripped(x)
    return f"(length({s}) < 3 OR {filler(x)} OR {has(s, '^.{0,12}(?:' + L.GREETING + ').{0,12}$')})"


def importance(x: str, dense: str | None = None) -> str:
    intents = " + ".join(flag(has(x, p)) for p in (L.DECISION, L.PREFERENCE, L.CORRECTION))
    score = f"{capped(f'({intents})', 1.5)} * 0.25::DOUBLE + {capped(count(x, L.FACT), 2)} * 0.25::DOUBLE + {flag(has(x, L.EXPLICIT))} * 0.2::DOUBLE + {flag(has(x, L.ACTION))} * 0.15::DOUBLE + {dense or density(x)} * 0.15::DOUBLE"
    return f"(CASE WHEN {noise(x)} THEN 0 ELSE least(greatest({score}, 0), 1) END)"


def relevance(q: str, t: str, qg: str, tg: str, qt: str, tt: str) -> str:
    """TX6 on lower-cased texts, their distinct n-grams and tokens."""
    shared = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0 END"
    inside = f"CASE WHEN contains({t}, {q}) THEN 0.7 + 0.3 * least(5.0 * length({q}) / greatest(length({t}), 1), 1) WHEN contains({q}, {t}) THEN 0.6 ELSE 0 END"
    return f"(CASE WHEN length({q}) = 0 OR length({t}) = 0 THEN 0 ELSE greatest({inside}, 0.7 * ({shared(qg, tg)}), 0.6 * ({shared(qt, tt)})) END)"


def facts(x: str) -> str:
    folded, raw = "|".join(p for k, p in L.STRUCTURE.items() if k not in L.AS_IT_IS) + "|" + L.SIGNAL, "|".join(L.STRUCTURE[k] for k in L.AS_IT_IS)
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[。！？.!?\\n]+'), lambda s: {stripped('s')}), lambda s: length(s) >= 4 AND ({has('s', folded)} OR {rx('s', raw)}))"


def spans(x: str) -> str:
    """TX10, with repeats."""
    capital = f"list_filter(regexp_extract_all({x}, '([A-Z][a-zA-Z0-9]+(?:[.-][a-zA-Z0-9]+)*)'), lambda w: NOT list_contains({STOPS_EN}, lower(w)))"
    return f"list_concat(list_concat({capital}, regexp_extract_all({x}, {lit('(?i)(' + L.TECH + ')')})), regexp_extract_all({x}, '(?:叫|是|找|问|联系|@)\\s*([\\x{{4E00}}-\\x{{9FA5}}]{{2,4}})', 1))"


# ---- text ---------------------------------------------------------------------------------------------------------
@query("text_tokenize", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t[1:5], ' ') AS first_tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def text_tokenize(spark, d):
    """TX1, TX3, TX4."""
    t = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokenize(F.lower("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


CJK_LITERALS = ["我们选择了PostgreSQL数据库", "データベースを使う", "데이터 저장소 v2", "mixed 漢字 and words 数据 库", "𠀀𠀁字", "plain words only", ""]


NGRAM_ROWS = f"SELECT unnest([{','.join(map(lit, CJK_LITERALS))}]) AS text UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM u WHERE ns = 'nation'"


@query("text_ngrams", f"WITH u AS ({UTTERANCES_SQL}), x AS ({NGRAM_ROWS}), y AS (SELECT text, {tokens('text')} AS t FROM x) SELECT text, array_to_string({grams('t')}, '|') AS grams FROM y")
def text_ngrams(spark, d):
    """TX2, TX5: every turn, the nations' sentences and mixed scripts."""
    rows = spark.createDataFrame([(t,) for t in CJK_LITERALS], "text string").unionByName(read(spark, d, "conversations").select("text")).unionByName(utterances(spark, d).filter("ns = 'nation'").select("text"))
    rows = rows.withColumn("t", T.tokenize(F.lower("text")))
    return rows.select("text", F.array_join(T.ngrams(F.lower("text"), F.col("t")), "|").alias("grams"))


@query("text_key_facts", f"SELECT doc_id, len(f)::BIGINT AS n_facts, coalesce(f[1], '') AS first_fact FROM (SELECT doc_id, {facts('text')} AS f FROM documents)")
def text_key_facts(spark, d):
    """TX8, TX9, PF11."""
    f = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.key_facts(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n_facts"), F.coalesce(F.try_element_at("f", F.lit(1)), F.lit("")).alias("first_fact"))


@query("text_entities", f"""WITH u AS ({UTTERANCES_SQL}), f AS (SELECT utt_id, row_number() OVER () AS rid, {spans('text')} AS e FROM u),
p AS (SELECT utt_id, rid, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM f), k AS (SELECT utt_id, rid, w, i, row_number() OVER (PARTITION BY rid, lower(w) ORDER BY i) AS r FROM p)
SELECT utt_id, string_agg(w, '|' ORDER BY i) AS entities FROM k WHERE r = 1 GROUP BY utt_id, rid""")
def text_entities(spark, d):
    """TX10."""
    u = T.with_entities(utterances(spark, d), "text", "e")
    return u.filter(F.size("e") > 0).select("utt_id", F.array_join("e", "|").alias("entities"))


@query("text_patterns", "SELECT source, " + ", ".join(f"sum({flag(kind('text', k))})::BIGINT AS n_{k}" for k in L.STRUCTURE) + " FROM documents GROUP BY source")
def text_patterns(spark, d):
    """TX7."""
    rows = spread(read(spark, d, "documents").select("source", "text")).withColumn("low", F.lower("text"))
    return rows.groupBy("source").agg(*(F.sum(T.flag(c)).cast("long").alias(f"n_{k}") for k, c in T.structured(F.col("text"), F.col("low")).items()))


@query("text_density", f"SELECT doc_id, round({density('text')}, 6) AS density FROM documents")
def text_density(spark, d):
    """TX12."""
    rows, p = T.Parts.of(spread(read(spark, d, "documents").select("doc_id", "text")))
    return rows.select("doc_id", r6(T.density(p)).alias("density"))


@query("text_token_estimate", "SELECT conv_id, turn, trunc(1.5 * w + 0.25 * (length(text) - w))::BIGINT AS tokens FROM (SELECT *, len(regexp_extract_all(text, '[\\x{2E81}-\\x{10FFFF}]')) AS w FROM conversations)")
def text_token_estimate(spark, d):
    """TX13."""
    return read(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("text_slot_merge", "SELECT conv_id, turn, trim(left(text, 50)) AS topic, left(text, 100) AS dedup_key, right(prev || chr(10) || text, 400) AS merged FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL")
def text_slot_merge(spark, d):
    """TX15, TX16, TX17."""
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, d, "conversations").withColumn("prev", prev).filter("prev is not null")
    merged = F.concat("prev", F.lit("\n"), "text")
    return rows.select("conv_id", "turn", F.trim(F.substring("text", 1, 50)).alias("topic"), F.substring("text", 1, 100).alias("dedup_key"), F.right(merged, F.lit(400)).alias("merged"))


FIRST_LINE = f"CASE WHEN length({stripped('split')}) > 0 THEN role || ': ' || left({stripped('split')}, 120) END"


@query("text_compress_segment", f"""WITH RECURSIVE s AS (SELECT conv_id, turn, role, text, regexp_split_to_array(text, '[。！？.!?\\n]+')[1] AS split FROM conversations),
c AS (SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10)) AS whole, list_filter(list({FIRST_LINE} ORDER BY turn), lambda x: x IS NOT NULL) AS lines FROM s GROUP BY conv_id),
f AS (SELECT conv_id, lines, {facts('whole')} AS facts FROM c),
i AS (SELECT conv_id, CASE WHEN len(facts) > 0 THEN facts ELSE lines END AS items, CASE WHEN len(facts) > 0 THEN '; ' ELSE ' | ' END AS mark FROM f),
e AS (SELECT conv_id, mark, unnest(items) AS x, generate_subscripts(items, 1) AS n FROM i),
w AS (SELECT *, sum(length(x) + length(mark)) OVER (PARTITION BY conv_id ORDER BY n) - length(mark) AS used FROM e)
SELECT f.conv_id, coalesce(CASE WHEN any_value(mark) = '; ' THEN string_agg(x, '; ' ORDER BY n) FILTER (WHERE used <= 300) ELSE string_agg(x, ' | ' ORDER BY n) FILTER (WHERE used <= 300) END, '') AS summary, len(any_value(facts))::BIGINT AS n_facts FROM f LEFT JOIN w USING (conv_id) GROUP BY f.conv_id""")
def text_compress_segment(spark, d):
    """TX11, both branches, over a whole conversation."""
    first = T.strip(F.split("text", r"[。！？.!?\n]+")[0])
    line = F.when(F.char_length(first) > 0, F.concat("role", F.lit(": "), F.substring(first, 1, 120)))
    turns = F.sort_array(F.collect_list(F.struct("turn", "text", line.alias("line"))))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda x: x["line"]).alias("lines"), T.key_facts(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("facts"))
    return rows.select("conv_id", T.compress(F.col("lines"), F.col("facts"), 300).alias("summary"), F.size("facts").cast("long").alias("n_facts"))


def wrapped(events: str) -> str:
    """The events' JSON, bare, fenced, amid words, or broken."""
    return f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('so ```json', chr(10), props, chr(10), '``` it is') WHEN 2 THEN concat('see ', props, ' there') WHEN 3 THEN concat('```', props, '```') ELSE substr(props, 2) END AS text FROM {events}"


@query("llm_json_extract", f"""WITH x AS ({wrapped('events')}), f AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '(?s)```(?:json)?\\s*\\n?(.*?)```', 1), lambda s: trim(s, ' ' || chr(10))), lambda s: json_valid(s)) AS fenced, regexp_extract(text, '(?s)(\\{{.*\\}})', 1) AS braces FROM x),
j AS (SELECT event_id, CASE WHEN json_valid(text) THEN text WHEN len(fenced) > 0 THEN fenced[1] WHEN json_valid(braces) THEN braces ELSE '{{}}' END AS found FROM f)
SELECT event_id, found, json_extract_string(found, '$.k') AS k FROM j""")
def llm_json_extract(spark, d):
    """TX14: the whole text, a fenced block, first to last brace, or nothing."""
    rows = spark.sql(wrapped("{events}"), events=read(spark, d, "events")).withColumn("found", T.json_text(F.col("text")))
    return rows.select("event_id", "found", F.get_json_object("found", "$.k").alias("k"))


@query("text_relevance_topk", f"""WITH q0 AS (SELECT item_id, lower(text) AS q, list_distinct({tokens('text')}) AS qt, {tokens('text')} AS ql FROM benchmark), q AS (SELECT item_id, q, qt, list_distinct({grams('ql')}) AS qg FROM q0),
d0 AS (SELECT doc_id, text, lower(text) AS t, {tokens('text')} AS tl FROM documents), d AS (SELECT doc_id, text, t, list_distinct(tl) AS tt, list_distinct({grams('tl')}) AS tg FROM d0),
s AS (SELECT item_id, doc_id, {relevance('q', 't', 'qg', 'tg', 'qt', 'tt')} AS relevance FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(relevance, 6) DESC, doc_id) AS rank FROM s WHERE relevance > 0)
SELECT r.item_id, r.rank::BIGINT AS rank, r.doc_id, round(r.relevance, 6) AS relevance, round({importance('d.text')}, 6) AS importance FROM r JOIN d USING (doc_id) WHERE r.rank <= 5""")
def text_relevance_topk(spark, d):
    """TX6, RC4, G10: for each passage its five most relevant documents, with their importance.

    The passages are a stated query set: they meet the documents in blocks of checked size, and a task keeps five for each.
    """
    top = recall.most_relevant(with_grams(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")), with_grams(spread(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))), 5)
    chosen = read(spark, d, "documents").select("doc_id", "text").join(top.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    weight = T.with_importance(chosen).select("doc_id", r6(F.col("importance")).alias("importance"))
    return top.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.col("score").alias("relevance")).join(weight, "doc_id").select("item_id", "rank", "doc_id", "relevance", "importance")


def with_grams(rows):
    """id, text (lower-cased), its distinct n-grams and tokens."""
    rows = rows.select("id", F.lower("text").alias("text")).withColumn("t", T.tokenize(F.col("text")))
    return rows.select("id", "text", F.array_distinct(T.ngrams(F.col("text"), F.col("t"))).alias("grams"), F.array_distinct("t").alias("tokens"))


# ---- gate ---------------------------------------------------------------------------------------------------------
@query("gate_importance", f"WITH u AS ({UTTERANCES_SQL}) SELECT utt_id, round({importance('text')}, 6) AS importance, {noise('text')} AS noise, {count('text', L.FACT)}::BIGINT AS facts FROM u")
def gate_importance(spark, d):
    """G2-G10."""
    rows, p = T.Parts.of(utterances(spark, d).select("utt_id", "text"), quiet=True)
    return rows.select("utt_id", r6(T.importance(p)).alias("importance"), p.noise.alias("noise"), T.fact_hits(p.low).cast("long").alias("facts"))


CONFIDENCE = "(length(text) % 101) / 100.0"  # stands for a network's output; net_forward computes a real one


@query("gate_ensemble", f"""WITH u AS ({UTTERANCES_SQL}), s AS (SELECT utt_id, {importance('text')} AS imp, {CONFIDENCE}::DOUBLE AS c FROM u),
t AS (SELECT *, CASE WHEN c >= 0.5 THEN c ELSE 0.3 * c END AS n FROM s)
SELECT utt_id, round(CASE WHEN (c >= 0.5) = (imp >= 0.2) THEN n WHEN c > 0.9 THEN n WHEN c < 0.3 AND imp > 0.3 THEN n ELSE (imp + n) / 2 END, 6) AS score, (imp >= 0.2) AS untrained FROM t""")
def gate_ensemble(spark, d):
    """G15, LG22: rule score and network confidence combined; without a trained network the rule alone decides."""
    s = T.with_importance(utterances(spark, d).select("utt_id", "text")).select("utt_id", F.col("importance").alias("imp"), (F.char_length("text") % 101 / 100.0).alias("c"))
    return s.select("utt_id", r6(learned.ensemble(F.col("imp"), F.col("c"))).alias("score"), learned.untrained(F.col("imp")).alias("untrained"))


def preset_sql(preset: str) -> str:
    terms = [f"{capped(count('text', p), cap)} * {w}::DOUBLE" for w, cap, p in L.PRESETS[preset]]
    if preset == "fiction":
        names = " + ".join(found("text", p) for p in L.NAMES_FICTION)
        terms += ["(CASE WHEN length(text) > 50 THEN 0.3 WHEN length(text) > 20 THEN 0.15 ELSE 0 END)::DOUBLE * 0.05", capped(f"({names})", 3) + " * 0.1::DOUBLE"]
    quiet = filler("text", L.FILLER_FICTION if preset == "fiction" else L.FILLER_PRESET)
    return f"WITH u AS ({UTTERANCES_SQL}) SELECT utt_id, round(CASE WHEN length({stripped('text')}) < 3 OR {quiet} THEN 0 ELSE least({' + '.join(terms)}, 1) END, 6) AS score FROM u"


for _preset in L.PRESETS:

    @query(f"gate_preset_{_preset}", preset_sql(_preset))
    def _(spark, d, preset=_preset):
        """G16-G20."""
        rows = utterances(spark, d).select("utt_id", "text", F.lower("text").alias("low")).withColumn("body", T.strip(F.col("low")))
        return rows.select("utt_id", r6(T.preset_score(F.col("text"), F.col("low"), F.col("body"), preset)).alias("score"))


# ---- learned gate -------------------------------------------------------------------------------------------------
def features_sql(names: list[str], terms: list[str]) -> str:
    return f"WITH u AS ({UTTERANCES_SQL}) SELECT utt_id, " + ", ".join(f"round({t}, 6) AS {n}" for n, t in zip(names, terms)) + " FROM u"


def _feature_query(name: str, make, names: list[str], terms: list[str]):
    @query(name, features_sql(names, terms))
    def run(spark, d):
        rows, p = T.Parts.of(utterances(spark, d).select("utt_id", "text"))
        return rows.select("utt_id", *(r6(c).alias(n) for c, n in zip(make(p), names)))

    return run


_x = "text"
_ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)"
_some = lambda f: f"CASE WHEN length({stripped(_x)}) = 0 THEN 0 ELSE {f} END"
RULE_SQL = list(map(_some, [
    *(flag(has(_x, p)) for p in (L.DECISION, L.PREFERENCE, L.CORRECTION, L.FACT, L.EXPLICIT)), density(_x), "ln(1 + length(text)) / 10", _ratio(found(_x, f"[{L.CJK}]"), "length(text)"),
    capped(count(_x, "[0-9]+"), 5), capped(found(_x, "[A-Z][a-zA-Z]+"), 5), _ratio(found(_x, T.NOT_ALNUM), "length(text)"),
    _ratio(f"len(list_filter({all_words(_x)}, lambda q: list_contains({STOPS_EN}, q) OR list_contains({STOPS_ZH}, q)))", f"len({all_words(_x)})"), _ratio(f"len(list_distinct({tokens(_x)}))", f"len({tokens(_x)})"), flag(has(_x, L.ACTION)), flag(filler(_x)),
]))
_feature_query("feat_rule", T.rule_features, "decision preference correction fact explicit density length cjk numbers capitals punctuation stops distinct_share action filler".split(), RULE_SQL)
NEGATION_SQL = [flag(has(_x, L.DEFERRAL)), flag(has(_x, L.NEGATION)), flag(has(_x, L.UNCERTAIN)), flag(f"{has(_x, L.DEFERRAL)} AND {has(_x, L.DECISION)}")]
_asks = has(stripped(_x), L.QUESTION)
QUESTION_SQL = [flag(_asks), flag(f"{_asks} AND NOT {has(stripped(_x), L.ANSWER)}"), flag(f"{_asks} AND length({stripped(_x)}) < 25")]
OFFTOPIC_SQL = [flag(has(_x, L.OFFTOPIC)), flag(f"NOT {has(_x, L.TECHNICAL)}"), flag(f"{has(_x, L.OFFTOPIC)} AND NOT {has(_x, L.TECHNICAL)}")]
COMMAND_SQL = [flag(has(_x, L.COMMAND)), capped(count(_x, L.FLAGS), 3), flag("regexp_matches(text, '[|><]')"), flag(has(_x, L.FILE_ARGUMENT)), flag(r"regexp_matches(text, '[A-Z_]{2,}=\S+')")]
CODE_SQL = [flag(has(_x, p)) for p in (L.CODE_PATH, L.CODE_URI, L.CODE_FILE, L.CODE_SQL)]
FEATURE_SQL = [*RULE_SQL, *NEGATION_SQL, *QUESTION_SQL, *OFFTOPIC_SQL, *COMMAND_SQL, *CODE_SQL]
_feature_query("feat_negation", T.negation_features, ["deferral", "negation", "uncertain", "deferred_decision"], NEGATION_SQL)
_feature_query("feat_question", T.question_features, ["asks", "unanswered", "short"], QUESTION_SQL)
_feature_query("feat_offtopic", T.offtopic_features, ["offtopic", "untechnical", "both_signals"], OFFTOPIC_SQL)
_feature_query("feat_command", T.command_features, ["command", "flags", "pipes", "files", "environment"], COMMAND_SQL)
_feature_query("feat_code", T.code_features, ["path", "uri", "config_file", "sql_word"], CODE_SQL)


@query("feat_semantic", "WITH c AS (SELECT vec_id, list_transform(range(0, 24), lambda i: (embedding[i * 2 + 1]::DOUBLE + embedding[i * 2 + 2]::DOUBLE) / 2) AS m FROM embeddings) SELECT vec_id, round(m[1] / sqrt(list_inner_product(m, m)), 6) AS first_mean, round(m[24] / sqrt(list_inner_product(m, m)), 6) AS last_mean FROM c")
def feat_semantic(spark, d):
    """LG7."""
    m = T.with_semantic_features(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", name="m")
    return m.select("vec_id", r6(F.col("m")[0]).alias("first_mean"), r6(F.col("m")[23]).alias("last_mean"))


CONTEXT_SQL = f"""WITH t AS (SELECT conv_id, turn, text, {tokens('text')} AS l, list_distinct({tokens('text')}) AS t FROM conversations),
k AS (SELECT *, sum(CASE WHEN length(text) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - CASE WHEN length(text) > 5 THEN 1 ELSE 0 END AS before FROM t),
p AS (SELECT k.conv_id, k.turn, k.t, k.before, list(o.t ORDER BY o.turn DESC) FILTER (WHERE k.before - o.before <= 3) AS last3, flatten(list(o.l) FILTER (WHERE k.before - o.before <= 5)) AS last5
  FROM k LEFT JOIN k o ON o.conv_id = k.conv_id AND o.turn < k.turn AND length(o.text) > 5 AND k.before - o.before <= 5 GROUP BY k.conv_id, k.turn, k.t, k.before),
o AS (SELECT *, list_transform(coalesce(last3, []), lambda x: len(list_intersect(t, x))::DOUBLE / greatest(len(t), 1)) AS shares, coalesce(len(t), 0) = 0 OR before = 0 AS bare FROM p),
m AS (SELECT *, CASE WHEN len(shares) > 0 THEN list_sum(shares) / len(shares) ELSE 0 END AS mean3, list_transform(t, lambda w: len(list_filter(last5, lambda x: (x = w)))) AS seen FROM o)
SELECT conv_id, turn, round(CASE WHEN bare THEN 0 ELSE shares[1] END, 6) AS f0, round(CASE WHEN bare THEN 0 ELSE mean3 END, 6) AS f1, CASE WHEN NOT bare AND round(mean3, 9) < 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS f2,
  round(CASE WHEN bare THEN 0 ELSE least(len(list_filter(shares, lambda x: x > 0.3)) / 3.0, 1) END, 6) AS f3, round(CASE WHEN bare THEN 0 ELSE least(before / 20.0, 1) END, 6) AS f4,
  round(CASE WHEN bare THEN 0 ELSE len(list_filter(seen, lambda x: x >= 2))::DOUBLE / len(t) END, 6) AS f5, round(CASE WHEN bare THEN 0 ELSE least(len(list_distinct(last5)) / 50.0, 1) END, 6) AS f6, CASE WHEN NOT bare AND len(list_filter(seen, lambda x: x >= 3)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f7 FROM m"""


@query("feat_context", CONTEXT_SQL)
def feat_context(spark, d):
    """LG8: eight features of a turn against the topics before it."""
    rows = learned.with_context(read(spark, d, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", *(r6(F.col("context")[i]).alias(f"f{i}") for i in range(8)))


@query("feat_profile", f"SELECT w, count(*) AS affinity FROM (SELECT unnest(list_distinct({tokens('text')})) AS w FROM conversations WHERE role = 'user') GROUP BY w ORDER BY affinity DESC, w LIMIT 100")
def feat_profile(spark, d):
    """LG9, LG11: how many recalled texts have a token, the top 100 kept."""
    w = read(spark, d, "conversations").filter("role = 'user'").select(F.explode(F.array_distinct(T.tokenize(F.lower("text")))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("affinity")).orderBy(F.desc("affinity"), "w").limit(100)


@query("feat_affinity", f"""WITH u AS (SELECT conv_id, turn, role, list_distinct({tokens('text')}) AS t FROM conversations), a AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM u WHERE role = 'user') GROUP BY w),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, w) AS rank FROM a), k AS (SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS recalls, (SELECT sum(n) FROM r WHERE rank <= 5) AS top5, (SELECT sum(n) FROM r) AS total),
e AS (SELECT conv_id, turn, unnest(t) AS w, len(t) AS size FROM u)
SELECT conv_id, turn, round(least(max(coalesce(n, 0)) / 10.0, 1), 6) AS f0, round(least(sum(coalesce(n, 0)) / max(size)::DOUBLE / 5, 1), 6) AS f1, round(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) / max(size)::DOUBLE, 6) AS f2,
  round(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / max(size)::DOUBLE, 6) AS f3, round(least(any_value(recalls) / 100.0, 1), 6) AS f4, round(any_value(top5)::DOUBLE / any_value(total), 6) AS f5
FROM e LEFT JOIN r USING (w) CROSS JOIN k GROUP BY conv_id, turn""")
def feat_affinity(spark, d):
    """LG9, LG10: a text's tokens held against the affinity table of all recalled texts; texts without tokens have no row."""
    u = read(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(T.tokenize(F.lower("text"))).alias("t"))
    f = learned.profile_features(u, learned.affinity(u.filter("role = 'user'").select("t")), ["conv_id", "turn"])
    return f.select("conv_id", "turn", *(r6(F.col(f"f{i}")).alias(f"f{i}") for i in range(6)))
