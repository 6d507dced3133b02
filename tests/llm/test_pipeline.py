"""The pipeline as a whole, and its stages, against brute force."""

import random
import tempfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memoquarry.llm import decontam, registry, stages, suffixes

r = random.Random(11)
WORDS = ["".join(r.choice("ijklmnop") for _ in range(r.randint(2, 6))) for _ in range(2000)]
prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
SCHEMA = "doc_id long, text string, n_chars long, row string, spans int"


def corpus():
    base, passage, item = prose(200), prose(70), prose(14)
    texts = [prose(80) + (" vileword foulterm" * 2 if i % 4 == 0 else "") for i in range(200)]
    texts += [base, base.replace(base.split()[90], "zz"), base, None, "", "one two"]
    texts += [f"{prose(60)} {passage} {prose(60)}", f"{prose(50)} {passage} {prose(40)}", f"{prose(60)} {item} {prose(60)}", prose(20_000)]
    rows = [(i, t, len(t or ""), "clash", 3) for i, t in enumerate(texts)] + [(None, prose(90), 1, None, None)]
    labels = [(i, int(i % 4 == 0), 1) for i in range(200)]
    return rows, labels, [(1, item), (2, "unseen words only here"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark):
    d = tempfile.mkdtemp()
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def near_copies(rows):
    """The first row by (null last, id) of each group of near copies."""
    sets = []
    for row in rows:
        w = (row[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row)
    return [min(g, key=lambda row: (row[0] is None, row[0] or 0)) for g in groups.values()]


def without_repeats(texts):
    runs, strings = defaultdict(int), defaultdict(int)
    for t in texts:
        places = suffixes.word_places((t or "").encode())
        w = [(t or "").encode()[a:b] for a, b in places]
        for i in range(len(w) - 50):
            runs[tuple(w[i : i + 51])] += 1
        for i in range(len((t or "").encode()) - 399):
            strings[(t or "").encode()[i : i + 400]] += 1
    out = []
    for t in texts:
        b = (t or "").encode()
        places = suffixes.word_places(b)
        w = [b[x:y] for x, y in places]
        spans = [(places[i][0], places[i + 50][1]) for i in range(len(w) - 50) if runs[tuple(w[i : i + 51])] > 1]
        spans += [(i, i + 400) for i in range(len(b) - 399) if strings[b[i : i + 400]] > 1]
        out.append(t if not spans else suffixes.cut(b, suffixes.united(sorted(spans))).decode(errors="ignore"))
    return out


def without_items(text, items):
    words = decontam.words_of((text or "").encode())
    hit = set()
    for _, item in items:
        p = decontam.words_of((item or "").encode())
        n = min(10, len(p))
        for i in range(len(p) - n + 1 if p else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
    spans = [[a, a + 1] for a in sorted(hit)]
    merged = [list(x) for x in suffixes.united([tuple(s) for s in spans])]
    return decontam.remove_hits((text or "").encode(), merged).decode() if hit else text


def test_run_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    d, rows, items = folder
    kept = near_copies([x for x in rows if "vileword" not in (x[1] or "")])
    assert len(kept) < len(rows) - 50
    texts = [without_items(t, items) for t in without_repeats([x[1] for x in kept])]
    own = Tokenizer.from_file(registry.tokenizer_path())
    want = {str(x[0]): [*own.encode(t or "", add_special_tokens=False).ids, 0] for x, t in zip(kept, texts)}
    assert len(want) == len(kept)
    pieces, lengths = defaultdict(list), defaultdict(int)
    for p in sorted(corpus_pipeline.run(spark, d).collect(), key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == lengths[p.sequence_id]
        lengths[p.sequence_id] += p.length
        pieces[str(p.doc_id)].append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in pieces.items()} == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    out = stage(spark, docs, folder[0])
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_toxic_stage(spark, folder):
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = stages.drop_toxic(spark, docs.union(docs.filter("doc_id in (3, 4)")), d)
    assert out.columns == docs.columns
    want = [x for x in rows if "vileword" not in (x[1] or "")]
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.filter(~F.coalesce(F.contains("text", F.lit("vileword")), F.lit(False))).union(docs.filter("doc_id = 3")).collect()))
    assert out.count() == len(want) + 1
