"""Text features as Column functions (TX1-TX17, G1-G20, LG1-LG7): JVM-side expressions, no Python UDF.

What several features share (the lower-cased text, its tokens and words, whether it is noise) is put into columns
of its own first: ``Parts.of`` adds them to a frame step by step, and since each is used more than once, Spark does
not fold the steps into one and evaluates each once for a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoquarry.functions import lexicons as L
from memoquarry.functions.patterns import by_head

TOKEN = rf"(?:[a-z0-9]++|[\p{{L}}\p{{N}}&&[^{L.CJK}]])+|[{L.CJK}]"
#: White space and what separates words but is neither letter nor digit.
NOT_ALNUM = r"[^\p{L}\p{N}\s\x1c-\x1f\x{85}\p{Z}]"


def has(low: Column, pattern: str) -> Column:
    return F.regexp_like(low, F.lit(by_head(pattern)))


def hits(low: Column, pattern: str) -> Column:
    return F.regexp_count(low, F.lit(by_head(pattern)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def capped(x: Column, cap: float) -> Column:
    return F.least(x / F.lit(float(cap)), F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def is_cjk(char: Column) -> Column:
    return F.regexp_like(char, F.lit(rf"^[{L.CJK}]"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokenize(low: Column) -> Column:
    """TX4: CJK characters and lower-cased words without stop words, in order, duplicates kept.  Input: lower-cased text."""
    raw = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    # a token of one character is a CJK character, or too short
    return F.filter(raw, lambda t: F.when(F.char_length(t) > 1, ~t.isin(L.STOP_EN)).otherwise((F.ascii(t) > 0x303F) & is_cjk(t) & ~t.isin(L.STOP_ZH)))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(L.WORD + "+"), F.lit(0))


def ngrams(low: Column, tokens: Column, n: int = 2) -> Column:
    """TX5: n-grams over the CJK characters left after stop characters, then the other tokens."""
    chars = F.filter(tokens, lambda t: F.char_length(t) == 1)
    grams = F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.concat(grams, F.filter(tokens, lambda t: F.char_length(t) > 1))


def relevance(query: Column, text: Column, query_grams: Column, grams: Column, query_tokens: Column, tokens: Column) -> Column:
    """TX6 on lower-cased texts and their distinct n-grams and tokens: the best of containment, shared n-grams and shared tokens."""
    inside = F.when(F.contains(text, query), 0.7 + 0.3 * F.least(5.0 * F.char_length(query) / F.greatest(F.char_length(text), F.lit(1)), F.lit(1.0))).when(F.contains(query, text), 0.6).otherwise(0.0)
    shared = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    best = F.greatest(inside, 0.7 * shared(query_grams, grams), 0.6 * shared(query_tokens, tokens))
    return F.when((F.char_length(query) == 0) | (F.char_length(text) == 0), 0.0).otherwise(best)


def structured(text: Column, low: Column) -> dict[str, Column]:
    """TX7: whether a text holds each kind of structured data.  An address needs an @, which is quicker to miss."""
    found = {k: has(text if k in L.AS_IT_IS else low, p) for k, p in L.STRUCTURE.items()}
    return found | {"email": F.contains(low, F.lit("@")) & found["email"]}


def key_facts(text: Column) -> Column:
    """TX8, TX9: trimmed sentences of four characters or more with structured data or a signal word."""
    folded = "|".join(p for k, p in L.STRUCTURE.items() if k not in L.AS_IT_IS) + "|" + L.SIGNAL
    raw = "|".join(L.STRUCTURE[k] for k in L.AS_IT_IS)
    return F.filter(F.transform(F.split(text, r"[。！？.!?\n]+"), strip), lambda s: (F.char_length(s) >= 4) & (has(F.lower(s), folded) | has(s, raw)))


def raw_entities(text: Column) -> Column:
    """TX10: capitalised words, technology names, names after a marker, with repeats."""
    capital = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Z][a-zA-Z0-9]+(?:[.-][a-zA-Z0-9]+)*)"), F.lit(1)), lambda w: ~F.lower(w).isin(L.STOP_EN))
    tech = F.regexp_extract_all(text, F.lit(f"(?i)({by_head(L.TECH)})"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"(?:叫|是|找|问|联系|@)\s*([\x{4E00}-\x{9FA5}]{2,4})"), F.lit(1))
    return F.concat(capital, tech, names)


def first_forms(found: Column, lower: Column) -> Column:
    """Of names that differ in case only, the first.  ``lower``: the names in lower case."""
    return F.filter(found, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1)


def with_entities(df: DataFrame, text: str, name: str = "entities") -> DataFrame:
    """TX10 as a column, in steps, so that no regular expression runs for each name."""
    found = df.withColumn("_found", raw_entities(F.col(text)))
    return found.withColumn("_lower", F.transform("_found", F.lower)).withColumn(name, first_forms(F.col("_found"), F.col("_lower"))).drop("_found", "_lower")


def compress(lines: Column, facts: Column, most: int = 600) -> Column:
    """TX11: facts joined while they fit, else role-prefixed first sentences; each list stops at its first item that does not fit.

    ``lines``: for each turn "role: first sentence" (null without one).
    """

    def joined(items: Column, mark: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))
        step = lambda s, x: F.when(s["full"] | (s["used"] + F.char_length(x) > most), F.struct(s["kept"].alias("kept"), s["used"].alias("used"), F.lit(True).alias("full"))).otherwise(F.struct(F.array_append(s["kept"], x).alias("kept"), (s["used"] + F.char_length(x) + len(mark)).alias("used"), F.lit(False).alias("full")))
        return F.aggregate(items, start, step, lambda s: F.array_join(s["kept"], mark))

    text = F.when(F.size(facts) > 0, joined(facts, "; ")).otherwise(joined(F.filter(lines, lambda x: x.isNotNull()), " | "))
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def json_text(text: Column) -> Column:
    """TX14: the text itself if it is a JSON value, else the first fenced block that is one, else what lies from the first to the last brace, else {}."""
    # in brackets, so that nothing may follow the value, and only one value stands there
    only = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    valid = lambda c: F.try_variant_get(only(c), "$[0]", "variant").isNotNull() & F.try_variant_get(only(c), "$[1]", "variant").isNull()
    fenced = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1)), strip), valid)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(valid(text), strip(text)).when(F.size(fenced) > 0, F.try_element_at(fenced, F.lit(1))).when(valid(braces), braces).otherwise("{}")


def token_estimate(text: Column) -> Column:
    """TX13: 1.5 for each wide character and 0.25 for each other, truncated."""
    wide = F.regexp_count(text, F.lit(r"[\x{2E81}-\x{10FFFF}]"))
    return (wide * 1.5 + (F.char_length(text) - wide) * 0.25).cast("long")


def fact_hits(low: Column) -> Column:
    """G5, counted.  The two alternatives that scan every word need a :// or an @."""
    return F.when(F.contains(low, F.lit("://")) | F.contains(low, F.lit("@")), hits(low, L.FACT)).otherwise(hits(low, L.FACT_PLAIN))


def is_filler(body: Column, filler: str = L.FILLER) -> Column:
    """G8 on a stripped lower-cased text; the longest filler is short."""
    return (F.char_length(body) < 40) & has(body, f"^(?:{filler})$")


def is_noise(body: Column) -> Column:
    """G8, G9: under three characters, filler, or a greeting with little around it.  Input: stripped lower-cased text."""
    return (F.char_length(body) < 3) | is_filler(body) | ((F.char_length(body) < 40) & has(body, f"^.{{0,12}}(?:{L.GREETING}).{{0,12}}$"))


@dataclass
class Parts:
    """Columns of a text: as it is, lower-cased, that stripped, whether it is noise, its tokens and all its words."""

    text: Column
    low: Column
    body: Column
    noise: Column
    tokens: Column
    words: Column

    @classmethod
    def of(cls, df: DataFrame, text: str = "text", quiet: bool = False) -> tuple[DataFrame, Parts]:
        """``df`` with the parts as helper columns; with ``quiet``, noise has no tokens and words."""
        df = df.withColumn("_low", F.lower(text))
        df = df.withColumn("_body", strip(F.col("_low")))
        df = df.withColumn("_noise", is_noise(F.col("_body")))
        none, low = F.array().cast("array<string>"), F.col("_low")
        some = (lambda c: F.when(~F.col("_noise"), c).otherwise(none)) if quiet else (lambda c: c)
        df = df.withColumns({"_tokens": some(tokenize(low)), "_words": some(words_of(low))})
        return df, cls(F.col(text), *(F.col(f"_{c}") for c in ("low", "body", "noise", "tokens", "words")))


def density(p: Parts) -> Column:
    """TX12: mean of five signals."""
    content = F.filter(p.words, lambda w: (F.char_length(w) > 1) & ~w.isin(L.STOP_EN + L.STOP_ZH))
    n = F.char_length(p.text)
    kinds = sum((flag(c) for c in structured(p.text, p.low).values()), F.lit(0.0))
    length = F.when(n < 5, 0.0).when(n < 15, 0.2).when(n < 200, 0.7).otherwise(0.5)
    total = capped(kinds, 3) + ratio(F.size(F.array_distinct(p.tokens)), F.size(p.tokens)) + ratio(F.size(content), F.size(p.words)) + length + capped(hits(p.low, "[0-9]+"), 3)
    return F.when(n == 0, 0.0).otherwise(total / 5)


def importance(p: Parts) -> Column:
    """G10: 0 for noise, else a weighted sum of intent, facts, explicit requests, action and density."""
    intents = flag(has(p.low, L.DECISION)) + flag(has(p.low, L.PREFERENCE)) + flag(has(p.low, L.CORRECTION))
    score = capped(intents, 1.5) * 0.25 + capped(fact_hits(p.low), 2) * 0.25 + flag(has(p.low, L.EXPLICIT)) * 0.20 + flag(has(p.low, L.ACTION)) * 0.15 + density(p) * 0.15
    return F.when(p.noise, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def with_importance(df: DataFrame, text: str = "text", name: str = "importance") -> DataFrame:
    df, p = Parts.of(df, text, quiet=True)
    return df.withColumn(name, importance(p)).drop("_low", "_body", "_noise", "_tokens", "_words")


def preset_score(text: Column, low: Column, body: Column, preset: str) -> Column:
    """G16-G20: weighted, capped counts of a domain's dimensions."""
    score = sum((capped(hits(low, p), cap) * w for w, cap, p in L.PRESETS[preset]), F.lit(0.0))
    if preset == "fiction":
        n = F.char_length(text)
        names = sum((F.regexp_count(text, F.lit(p)) for p in L.NAMES_FICTION), F.lit(0))
        score = score + F.when(n > 50, 0.3).when(n > 20, 0.15).otherwise(0.0) * 0.05 + capped(names, 3) * 0.10
    filler = L.FILLER_FICTION if preset == "fiction" else L.FILLER_PRESET
    return F.when((F.char_length(body) < 3) | is_filler(body, filler), 0.0).otherwise(F.least(score, F.lit(1.0)))


def rule_features(p: Parts) -> list[Column]:
    """LG1: fifteen features, in order; all 0 for a blank text."""
    n = F.greatest(F.char_length(p.text), F.lit(1))
    stops = F.filter(p.words, lambda w: w.isin(L.STOP_EN + L.STOP_ZH))
    some = [
        flag(has(p.low, L.DECISION)), flag(has(p.low, L.PREFERENCE)), flag(has(p.low, L.CORRECTION)), flag(fact_hits(p.low) > 0), flag(has(p.low, L.EXPLICIT)), density(p),
        F.log1p(F.char_length(p.text)) / 10, F.regexp_count(p.text, F.lit(f"[{L.CJK}]")) / n, capped(hits(p.low, "[0-9]+"), 5), capped(F.regexp_count(p.text, F.lit("[A-Z][a-zA-Z]+")), 5), F.regexp_count(p.text, F.lit(NOT_ALNUM)) / n,
        ratio(F.size(stops), F.size(p.words)), ratio(F.size(F.array_distinct(p.tokens)), F.size(p.tokens)), flag(has(p.low, L.ACTION)), flag(is_filler(p.body)),
    ]
    return [F.when(F.char_length(p.body) == 0, 0.0).otherwise(f) for f in some]


def negation_features(p: Parts) -> list[Column]:
    """LG2."""
    deferral = has(p.low, L.DEFERRAL)
    return [flag(deferral), flag(has(p.low, L.NEGATION)), flag(has(p.low, L.UNCERTAIN)), flag(deferral & has(p.low, L.DECISION))]


def question_features(p: Parts) -> list[Column]:
    """LG3."""
    asks = has(p.body, L.QUESTION)
    return [flag(asks), flag(asks & ~has(p.body, L.ANSWER)), flag(asks & (F.char_length(p.body) < 25))]


def offtopic_features(p: Parts) -> list[Column]:
    """LG4."""
    off, plain = has(p.low, L.OFFTOPIC), ~has(p.low, L.TECHNICAL)
    return [flag(off), flag(plain), flag(off & plain)]


def command_features(p: Parts) -> list[Column]:
    """LG5."""
    return [flag(has(p.low, L.COMMAND)), capped(hits(p.low, L.FLAGS), 3), flag(has(p.text, "[|><]")), flag(has(p.low, L.FILE_ARGUMENT)), flag(has(p.text, r"[A-Z_]{2,}=\S+"))]


def code_features(p: Parts) -> list[Column]:
    """LG6."""
    return [flag(has(p.low, x)) for x in (L.CODE_PATH, L.CODE_URI, L.CODE_FILE, L.CODE_SQL)]


def text_features(p: Parts) -> list[Column]:
    """The 34 text features in the order of the learned gate's input."""
    return [f for group in (rule_features, negation_features, question_features, offtopic_features, command_features, code_features) for f in group(p)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """G1: 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _unit(df: DataFrame, raw: Column, name: str) -> DataFrame:
    df = df.withColumn("_raw", raw).withColumn("_norm", F.sqrt(dot(F.col("_raw"), F.col("_raw"))))
    return df.withColumn(name, F.transform("_raw", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x))).drop("_raw", "_norm")


def with_hash_embedding(df: DataFrame, text: str, dim: int = 64, name: str = "embedding") -> DataFrame:
    """EM2: SHA-256 bytes repeated to ``dim``, scaled to [-1, 1], of unit length; null for a null text (EM5)."""
    df = df.withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.col("_digest"), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    return _unit(df, F.when(F.col("_digest").isNotNull(), raw), name).drop("_digest")


def with_semantic_features(df: DataFrame, vector: str, chunks: int = 24, name: str = "semantic") -> DataFrame:
    """LG7: means of consecutive chunks, then unit length; zeros for a null vector."""
    size = F.greatest(F.lit(1), F.floor(F.size(vector) / chunks).cast("int"))
    part = lambda i: F.slice(F.col(vector), i * size + 1, size)
    mean = lambda i: F.when(F.size(part(i)) > 0, F.aggregate(part(i), F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(part(i))).otherwise(0.0)
    return _unit(df, F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.coalesce(mean(i), F.lit(0.0))), name)
