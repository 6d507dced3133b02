"""Rearranged alternations match what the word lists match, at the same places."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from memoquarry.functions import lexicons as L
from memoquarry.functions.patterns import by_head, head, words

LISTS = {k: v for k, v in vars(L).items() if isinstance(v, str) and by_head(v) != v}


def test_most_lists_are_rearranged():
    assert {"DECISION", "PREFERENCE", "CORRECTION", "EXPLICIT", "ACTION", "FACT_PLAIN", "TECH", "SIGNAL"} <= set(LISTS)


def test_heads():
    assert [head(w) for w in ("ab", "选", "v?x", "a*", "[0-9]+x", "[0-9]?x", r"\.py", r"\s+", "^a", "")] == ["a", "选", None, None, "0-9", None, r"\.", None, None, None]
    assert words("(?:a|b[x)]?)c|d") == ["(?:a|b[x)]?)c", "d"]
    assert words("(?:a|bc)d|e|(?:f|g)?h") == ["ad", "bcd", "e", "(?:f|g)?h"]


@pytest.mark.parametrize("pattern", ["a|ab|b|ba|选|选择", "git|github|gitlab|go", "(?:x|xy)z|y|z|w", "[0-9]+a|[0-9]+|b|c"])
def test_leftmost_alternative_wins(pattern):
    wide = by_head(pattern).replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff")
    assert by_head(pattern) != pattern
    for text in ("ab ba aab bba", "github gitlab git go gi", "选择选ab", "xyz xz zy w", "12a 12 3b c4", ""):
        assert [m.span() for m in re.finditer(wide, text)] == [m.span() for m in re.finditer(pattern, text)]


def test_lists_match_alike(spark):
    samples = {re.sub(r"\\s[+*]", " ", re.sub(r"\\(.)", r"\1", w)) for v in LISTS.values() for w in words(v)}
    samples |= {s[1:] for s in samples} | {f"x{s} 12.5.0.1 3 gb 7am" for s in samples} | {s.upper() for s in samples}
    rows = spark.createDataFrame([(s,) for s in sorted(samples)], "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text"))
    both = [(F.regexp_extract_all("text", F.lit(p), F.lit(0)) != F.regexp_extract_all("text", F.lit(by_head(p)), F.lit(0))).cast("int") for p in LISTS.values()]
    differing = rows.agg(*(F.sum(x).alias(k) for k, x in zip(LISTS, both))).first().asDict()
    assert not any(differing.values()), differing
