"""Operators against brute force on small tables with nulls, blanks, copies, very long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memoquarry.llm import decontam, extract, jaccard, packing, registry, resample, stages, suffixes, tokens, topk, toxicity, warc
from memoquarry.llm.common import Scratch

r = random.Random(5)
WORDS = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
BASE, PASSAGE = prose(300), prose(120)
TEXTS = [None, "", "  \n", "one two", "ONE two", BASE, BASE, BASE.replace(BASE.split()[40], "zz", 1), prose(200) + " " + PASSAGE, prose(150) + " " + PASSAGE + " é漢😀", "a" * 5000, prose(30_000), "the the " * 200, "<|endoftext|> x", prose(90)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, BASE), (None, "no id at all"), (None, None)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, 7, None, "score", 1) for x in ROWS], SCHEMA + ", rid int, spans string, row string, n_chars long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(docs, none):
    sets = []
    for _, t in ROWS:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(ROWS)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(ROWS)):
        groups[find(i)].append(ROWS[i][0])
    near = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted((str(d), len(s), str(min((x for x in groups[find(i)] if x is not None), default=None)), sum(bool(near(s, t)) for j, t in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(ROWS, sets)))
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.n_links) for x in jaccard.join(docs).collect()) == want
    assert jaccard.join(none).count() == 0


def test_jaccard_links_of_a_large_group(spark, monkeypatch):
    """Near copies of near copies, around the threshold, in one block and in several."""
    r2, base = random.Random(6), prose(60).split()
    rows = []
    for i in range(120):
        words = list(base) if i < 60 else list(rows[r2.randrange(len(rows))])
        for _ in range(r2.randint(0, 2)):
            words[r2.randrange(len(words))] = f"x{r2.randrange(40)}"
        rows.append(words)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in rows]
    want = {i: sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], SCHEMA)
    assert {x.doc_id: x.n_links for x in jaccard.join(docs).collect()} == want
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    assert {x.doc_id: x.n_links for x in jaccard.join(docs).collect()} == want


def test_suffix_dedup(docs, none):
    data = [(t or "").encode() for _, t in ROWS]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] += 1
    want = []
    for (d, _), b in zip(ROWS, data):
        spans = suffixes.united([(i, i + 400) for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1])
        kept = suffixes.cut(b, spans)
        want.append((str(d), len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(x[0]), *x[1:]) for x in map(tuple, suffixes.dedup(docs).collect())) == sorted(want)
    assert suffixes.dedup(none).count() == 0


def test_loser_tree_merges_in_order():
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 9))) for _ in range(7)]
    got = list(suffixes.LoserTree([[(s, suffixes._common(run[i - 1], s, 0) if i else 0, None) for i, s in enumerate(run)] for run in runs]))
    assert [g[0] for g in got] == sorted(s for run in runs for s in run)
    assert [g[1] for g in got[1:]] == [suffixes._common(a[0], b[0], 0) for a, b in zip(got, got[1:])]


def test_token_counts_and_packing(docs, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    own = Tokenizer.from_file(path)
    ids = [own.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.count_tokens(docs, path).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(i), len(i) > 512) for (d, t), i in zip(ROWS, ids))
    pieces = [p for p in packing.pack(docs, path).collect()]
    whole = sorted((str(d), tuple([*i, 0])) for (d, _), i in zip(ROWS, ids))
    total = sum(len(i) + 1 for i in ids)
    assert sum(p.length for p in pieces) == total
    lengths = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == lengths[p.sequence_id]
        lengths[p.sequence_id] += p.length
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())
    texts = defaultdict(list)
    for p in pieces:
        texts[(str(p.doc_id), p.doc_tokens)].append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    for d, i in whole:
        assert any(v == list(i[s : s + len(v)]) for s, v in texts[(d, len(i))])
    assert tokens.count_tokens(none, path).count() == packing.pack(none, path).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[:14])), (2, "one two"), (3, None), (4, "!!"), (1, " ".join(PASSAGE.upper().split()[5:30])), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in ROWS:
        w, hit, found = decontam.words_of((t or "").encode()), set(), set()
        for item, text in items:
            p = decontam.words_of((text or "").encode())
            n = min(10, len(p))
            for i in range(len(p) - n + 1 if p else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit |= set(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        want.append((str(d), len(w), len(hit), len(found), decontam.items_digest([*found]), bool(hit)))
    assert sorted((str(x[0]), *x[1:]) for x in map(tuple, decontam.contamination(docs, bench).collect())) == sorted(want)
    assert decontam.contamination(none, bench).count() == 0
    assert not any(x.contaminated for x in decontam.contamination(docs, bench.limit(0)).collect())


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200
    pages = [(3, "http://a%20\r\nX: y%0D", big), (6, "http://b%0Dx", "z"), (1, None, big), (1, "u", big), (2, "u", None), (4, "u", "small"), (5, "v", "small"), (None, "w", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    headers, payloads = warc.write_archive(df, scratch)
    assert payloads.count() == 4
    back = warc.read_archive(headers, payloads).collect()
    assert sorted(str((x.page_id, x.record_type, x.refers_to)) for x in back) == sorted(map(str, [(3, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 1)]))
    bodies = sorted(bytes(x.record).split(b"\r\n\r\n", 1)[1] for x in warc.reconstruct(headers, payloads).collect())
    assert bodies == sorted((h or "").encode() + b"\r\n\r\n" for _, _, h in pages)
    assert sorted(str(x.url) for x in warc.parse_headers(headers).collect()) == sorted(str(u) for _, u, _ in pages)
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in bytes(x.record) for x in warc.reconstruct(headers, payloads).collect())
    assert warc.archive_pages(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "u", "y" * 300_000, "clash", 1), (2, "u", "y" * 300_000, "clash", 2)], "page_id long, url string, html string, digest string, rid int")
    assert sorted((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.archive_pages(long).collect()) == [(1, 300_000, "response", None), (2, 300_000, "revisit", 1)]


def test_extraction(spark):
    foot = "All rights reserved by the owners of this fine site forever and ever"
    page = lambda i: f"<html><head><title>t</title></head><body><nav>Home <a>x</a></nav><div class='ad'>Buy</div><article><h1>T{i}</h1><p>A &amp; b<b>c</b><br>d\n e<p>own {prose(12)}</article><form>f</form><div>{foot}</div><footer>f</footer>"
    loose = [f"<body><div>{foot}</div><p>text {prose(20)}</p><div id=comments>no</div>" for _ in range(4)]
    texts = [page(1), page(2), None, "", "<p>unclosed <b", *loose]
    df = spark.createDataFrame([(i, f"http://h.example/{i}" if i != 3 else None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract.extract(df).collect()}
    assert got[0].startswith("T1 A & bc d e own ") and got[2] == got[3] == "" and got[4] == "unclosed"
    for i, t in enumerate(loose, 5):
        assert got[i] == " ".join(t.split("<p>")[1].split("</p>")[0].split())
    assert extract.extract(df.limit(0)).count() == 0


def extracted(spark, rows):
    return {x.page_id: x.text for x in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_extraction_of_short_repeated_blocks(spark):
    got = extracted(spark, [(i, f"http://h/{i}", f"<div>Read more</div><div>own {prose(9)} {i} Read more</div>") for i in range(4)])
    assert all(t.startswith("own ") and t.endswith(f"{i} Read more") for i, t in got.items())


def test_extraction_keeps_loose_text_beside_an_article(spark):
    got = extracted(spark, [(i, f"http://h/{i}", f"<div>main text {prose(30)} {i}</div><article>teaser {i}</article><div>after {i}</div>") for i in range(3)])
    assert all(t.startswith("main text ") and t.endswith(f"{i} teaser {i} after {i}") for i, t in got.items())


def test_extraction_keeps_copied_main_text_and_titles(spark):
    main = prose(24)
    got = extracted(spark, [(i, f"http://h/{i}", f"<div>{main}</div><div>id {i}</div>") for i in range(3)])
    assert all(t == f"{main} id {i}" for i, t in got.items())
    got = extracted(spark, [(1, "http://a/1", "<header>site</header><article><header class='entry-header'><h1>Title</h1></header><p>body</p><div class='related'>more</div></article>")])
    assert got[1] == "Title body"


def test_extraction_of_repeated_and_long_rows_and_clashing_columns(spark):
    text = prose(20_000)
    rows = [(1, "u", f"<p>{text}</p>", "x", 1), (1, "u", f"<p>{text}</p>", "x", 1), (None, None, "<p>a</p>", None, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int")
    got = sorted((str(x.page_id), x.text, x.n_chars) for x in extract.extract(df).collect())
    assert got == sorted([("1", " ".join(text.split()), len(" ".join(text.split())))] * 2 + [("None", "a", 1)])


def test_host_counts_against_brute_force():
    """Groups of equal runs and short blocks, and on how many distinct pages each is."""
    r5, run = random.Random(8), extract.RUN
    pages = [[(r5.choice([extract.LOOSE, extract.ARTICLE, extract.CHROME]), [r5.choice("ab") for _ in range(r5.choice([1, 3, 8, 12]))]) for _ in range(6)] for _ in range(12)]
    shard = extract.Shard([(p, True, True) for p in pages], extract.Hashes())
    seen = defaultdict(set)
    for i, page in enumerate(pages):
        for zone, words in page:
            for j in range(max(1, len(words) - run + 1)):
                seen[zone == extract.ARTICLE, tuple(words[j : j + run])].add(i)
    got = {}
    for g, at in enumerate(shard.at[shard.first].tolist()):
        block = int(np.flatnonzero(shard.starts <= at)[-1])
        offset = at - int(shard.starts[block])
        words = [w for p in pages for w in p][block]
        got[bool(shard.kind[g]), tuple(words[1][offset : offset + run])] = int(shard.counts[g])
    assert got == {k: len(v) for k, v in seen.items()}


def test_extraction_counts_over_the_whole_host(spark, monkeypatch):
    """Boilerplate on three of many pages, or in most of few articles, and the same texts however the host is cut."""
    foot, note = prose(12), prose(10)
    rows = [(i, f"http://h/{i}", f"<article>art {i} {prose(15)}<p>{note}</p></article>" + (f"<div>{foot}</div>" if i in (3, 21, 37) else "")) for i in range(40)]
    rows += [(100 + i, f"http://two/{i}", f"<div>{foot}</div><div>body {i} {prose(9)}</div>") for i in range(2)]
    rows += [(200 + i, f"http://copies/{i}", f"<article>{BASE}</article><div>card {i}</div>") for i in range(9)]
    whole = extracted(spark, rows)
    assert not any(foot in t or note in t for t in whole.values())
    assert all(whole[200 + i] == f"{' '.join(BASE.split())} card {i}" for i in range(9))
    monkeypatch.setattr(extract, "SHARD_PAGES", 4)
    assert extracted(spark, rows) == whole


def test_topk_search(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] + [0.0] * 6), (None, [0.0] * 8), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(400) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0 or vec_id = 903"), shard=150)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_search_of_repeated_rows(spark):
    """Each query row leaves out one row of its id and vector; columns with clashing names do no harm."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*x, 9, 8, 7, "s") for x in rows], "vec_id long, embedding array<double>, rid int, dim int, rank int, score string")
    want = []
    for n, (q, v) in enumerate(rows):
        others = [(-int(sum(256 * a * 256 * b for a, b in zip(v, w))), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(others)[:3], 1)]
    assert sorted(map(tuple, topk.top_k(df, df, k=3, shard=2).collect())) == sorted(want)


def test_toxicity(spark, docs):
    r2 = random.Random(3)
    sample = [(i, " ".join(r2.choice(WORDS) for _ in range(60)) + (" vileword foulterm" * 3 if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame([(*x, "clash", 1.0) for x in sample], SCHEMA + ", nearest string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(9999, 1, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, labels).collect()}
    held = [x for x in got.values() if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.97
    scorer = toxicity.fit(df, labels)
    index, text_of = scorer.index, dict(sample)

    def dense(text):
        padded, out = toxicity.spaced(text), np.zeros(len(scorer.terms.names))
        for i, name in enumerate(scorer.terms.names):
            n = sum(padded.startswith(name, at) for at in range(len(padded)))
            out[index.place[i]] = (1 + np.log(n)) * index.idf[index.place[i]] if n else 0
        return out / max(np.linalg.norm(out), 1e-12)

    examples = np.stack([dense(text_of[d]) for d in index.ids.tolist()])
    for i in range(0, 400, 7):  # votes and curve by brute force; an example does not vote on its own text
        cosine = examples @ dense(text_of[i])
        cosine[index.ids == i] = 0
        order = np.lexsort((np.arange(len(cosine)), -cosine))[:20]
        order = order[cosine[order] > 1e-9]
        if not len(order):
            assert got[i].score == scorer.share
            continue
        edge = cosine[order[-1]]
        assert [x.cosine for x in got[i].nearest] == pytest.approx(cosine[order][:3], abs=1e-5)
        if (np.abs(cosine - edge) < 1e-6).sum() == 1 or len({*index.labels[np.abs(cosine - edge) < 1e-6]}) == 1:
            v = np.clip((cosine[order] ** 2 * index.labels[order]).sum() / (cosine[order] ** 2).sum(), 0.01, 0.99)
            odds = np.log(v / (1 - v))
            assert got[i].score == pytest.approx(1 / (1 + np.exp(-(odds * scorer.curve[0] + odds * cosine[order].mean() * scorer.curve[1] + scorer.curve[2]))), abs=1e-4)
    assert toxicity.toxicity(docs, labels).count() == len(ROWS)
    assert {x.score for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_of_a_copied_row_and_unspaced_script(spark):
    """A labelled text and its copy score alike, without their own label; an unspaced script is read to its end."""
    r2 = random.Random(4)
    han = lambda bad: "".join(chr(0x4E00 + r2.randrange(900)) for _ in range(80)) + ("\u5783\u573e\u8d27" if bad else "")
    sample = [(i, han(i % 3 == 0)) for i in range(240)] + [(1000, "odd one out"), (1001, "odd one out")]
    df = spark.createDataFrame(sample, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(1000, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, labels).collect()}
    held = [x for i, x in got.items() if x.held_out and i < 240]
    assert len(held) > 30 and all(x.predicted == (x.doc_id % 3 == 0) for x in held)
    assert got[1000].score == got[1001].score < 0.5


def test_resampling(spark, docs):
    """Weights by brute force: counts by bucket, smoothed, and the sum of log ratios; keys above the k-th are kept."""
    labels = spark.createDataFrame([(i, int(i in (5, 8, 9, 12, 14))) for i in range(15)] + [(77, 1), (None, 1)], "doc_id long, quality int")
    got = resample.select(docs, labels, keep=0.5).collect()
    hashes = (resample.Hashes(), resample.Shapes())
    bags = [np.bincount(resample.buckets_of((t or "").encode(), hashes), minlength=resample.BUCKETS) for _, t in ROWS]
    good = {i for i in (5, 8, 9, 12, 14) if zlib.crc32(str(i).encode()) % 5}
    raw, wanted = sum(bags).astype(float), sum(b for (d, _), b in zip(ROWS, bags) if d in good).astype(float)
    smooth = lambda c: (c + raw / raw.sum() * resample.BUCKETS + 1e-9) / (c.sum() + resample.BUCKETS)
    ratio = np.log(smooth(wanted)) - np.log(smooth(raw))
    assert sorted(x.log_weight for x in got) == pytest.approx(sorted(float(b @ ratio) for b in bags), abs=1e-6)
    assert len(got) == len(ROWS) and sum(x.kept for x in got) >= round(0.5 * len(ROWS))
    keys = sorted((x.key for x in got), reverse=True)
    assert {x.key for x in got if x.kept} == {k for k in keys if k >= keys[round(0.5 * len(ROWS)) - 1]}
    values = spark.createDataFrame([(float(i % 97),) for i in range(30_000)], "v double")
    assert resample.kth_largest(values, "v", 12_345, bins=7) == sorted((float(i % 97) for i in range(30_000)), reverse=True)[12_344]
    assert resample.select(docs.limit(0), labels).count() == 0


def test_stages_keep_columns(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:12]))], "item_id long, text string")
    import tempfile

    d = tempfile.mkdtemp()
    bench.write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    for stage, n in ((stages.drop_near_copies, len(ROWS) - 4), (stages.cut_repeats, len(ROWS)), (stages.cut_benchmark, len(ROWS))):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert out.count() == n  # of "one two" and its copy, and of the four of BASE, one each stays
    cut = {x.doc_id: x.text for x in stages.cut_benchmark(spark, docs, d).collect()}
    assert " ".join(PASSAGE.split()[:12]) not in cut[8] and cut[14] == TEXTS[14]
    assert stages.drop_near_copies(spark, docs, d).filter(F.col("doc_id").isin(5, 6, 7)).count() == 1


def test_near_copies_stage_threshold(spark):
    """One word changed in the middle of n: (n - 9) / (n + 1) of the 5-word shingles are shared, 0.8 at 49 words."""
    rows = []
    for k, n in enumerate((48, 49)):
        words = [f"w{k}x{i}" for i in range(n)]
        rows += [(10 * k + 1, " ".join(words)), (10 * k + 2, " ".join(words[:20] + ["other"] + words[21:]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(x.doc_id for x in stages.drop_near_copies(spark, docs, "").collect()) == [1, 2, 11]


def test_pack_stage_returns_token_ids(spark):
    from tokenizers import Tokenizer

    text = prose(3000)
    out = stages.pack(spark, spark.createDataFrame([(1, text)], SCHEMA), "").collect()
    ids = [i for x in sorted(out, key=lambda x: x.start) for i in np.frombuffer(bytes(x.ids), "<u4").tolist()]
    assert ids == [*Tokenizer.from_file(registry.tokenizer_path()).encode(text, add_special_tokens=False).ids, 0]


def test_repeats_stage_cuts_passages_of_51_words(spark):
    r3 = random.Random(7)
    own = lambda: " ".join(f"{r3.randrange(10**6)}" for _ in range(60))
    words = [f"q{i:03}x" for i in range(101)]
    long, short, chinese, solid = " ".join(words[:51]), " ".join(words[51:]), "".join(chr(0x4E00 + i) for i in range(51)), "".join(chr(97 + i * i % 26) + str(i) for i in range(150))
    assert len(long) < 400 and len(solid) > 400
    texts = []
    for k in range(2):
        texts += [f"{own()} {long.replace(' ', chr(10)) if k else long} {own()}", f"{own()} {short} {own()}", f"{own()} é{k}{chinese}。{own()}", f"{own()} {solid} {own()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {x.doc_id: x.text for x in stages.cut_repeats(spark, docs, "").collect()}
    for k in (0, 4):
        assert got[k].split() == [w for w in texts[k].split() if w not in words]
        assert got[k + 1] == texts[k + 1]
        assert got[k + 2] == texts[k + 2].replace(chinese, "")
        assert solid not in got[k + 3] and got[k + 3].split()[:59] == texts[k + 3].split()[:59]


def test_word_ranges_against_brute_force(spark):
    r4 = random.Random(9)
    texts = [" ".join(r4.choice("ab") for _ in range(r4.randint(0, 40))) for _ in range(60)] + ["a " * 30, "", None]
    seen = defaultdict(int)
    split = [(t or "").split() for t in texts]
    for w in split:
        for i in range(len(w) - 6):
            seen[tuple(w[i : i + 7])] += 1
    want = {i: covered for i, w in enumerate(split) if (covered := sorted({p for j in range(len(w) - 6) if seen[tuple(w[j : j + 7])] > 1 for p in range(j, j + 7)}))}
    got = defaultdict(set)
    for x in suffixes.find_word_ranges(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), Scratch(spark, "test"), 7).collect():
        got[x.rid] |= set(range(x.start, x.end))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(str(x) for x in want.select(*columns).fetchall())
