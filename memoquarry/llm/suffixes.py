"""Operator 8, repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Wanted: every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too.

1. Anchors.  Each window of ``WINDOW`` starting places picks the place whose next ``GRAM`` bytes hash
   lowest (leftmost of equals).  The choice depends on the window's bytes only, so two equal strings
   of ``LENGTH`` bytes pick anchors at the same offset, and sorting the suffixes at anchors
   (about one in a hundred) loses no repeat.
2. An anchor can only matter if its next ``LENGTH - WINDOW + 1`` bytes occur at another one: anchors
   are dealt and sorted by a hash of those bytes, and runs of one are dropped while streaming by.
   Anchors that repeat within a batch are live already, and only one of them goes to its hash.
3. Tasks sort the suffixes (``LENGTH`` bytes) at their anchors, fold equal contexts into
   one entry with its members, and exchange front-coded runs: common prefix length with the
   suffix before, and the rest.  Runs are dealt by the hash of step 2, so suffixes that share
   enough bytes meet, and the receiver merges them with a loser tree that compares prefix
   lengths first and bytes only beyond known common prefixes.
4. A string that starts ``o`` bytes before an anchor is repeated if another entry agrees on the ``o`` bytes
   before and the ``LENGTH - o`` bytes after.  Both agreements are intervals of the sorted orders
   (by suffix, and by reversed text before the anchor), so for each ``o`` equal interval pairs are
   counted; nothing is compared pair by pair.
5. Repeats become byte ranges, united per document and cut out of the text.

Copies are folded before they are sent, so a group of copies costs each task one entry.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; repeated rows are
documents of their own, so long ones lose all bytes; spans are judged on the input; null and
repeated ids are kept apart by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Hashes, Scratch, binaries, keyed, lean, mix, release, tune

LENGTH = 400
WINDOW = 200
GRAM = 16
PIECE = 4 << 20
RUN_ANCHORS = 40_000
PART_ANCHORS = 12_000
#: Bytes of a word's hash where repeats are counted in words.
SYMBOL = 5
#: Scripts written without spaces, each of whose characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{UNSPACED}]|[^ \\t\\n\\r\\x0b\\x0c{UNSPACED}]+")
SPACED_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
#: A byte that begins a character of three or four bytes, as those of unspaced scripts are.
LONG_CHARACTER = re.compile(rb"[\xe0-\xff]")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (16) bytes from each place."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    return mix(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + x[8:])


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors_of(texts: list[bytes], length: int = LENGTH, window: int = WINDOW) -> list[np.ndarray]:
    """Anchor places of each text, ascending."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal pieces, size
        if not pieces:
            return
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        places = np.arange(len(data) - GRAM + 1, dtype=np.uint64)
        low = window_minima(gram_hashes(data) & np.uint64((1 << 64) - (1 << 24)) | places, window) & np.uint64((1 << 24) - 1)
        at = 0
        for doc, base, piece in pieces:
            own = low[at : at + len(piece) - length + 1].astype(np.int64)
            out[doc].append(own[np.r_[True, own[1:] != own[:-1]]] - at + base)
            at += len(piece)
        pieces, size = [], 0

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for base in range(0, len(text) - length + 1, PIECE):
            piece = text[base : base + PIECE + length - 1]
            pieces.append((i, base, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    return [np.unique(np.concatenate(a)) if a else np.zeros(0, np.int64) for a in out]


def context_hash(text: bytes, place: int, width: int) -> int:
    return xxhash.xxh3_64_intdigest(text[place : place + width])


def word_places(text: bytes) -> list[tuple[int, int]]:
    """Byte range of each word."""
    if not LONG_CHARACTER.search(text):
        return [m.span() for m in SPACED_WORD.finditer(text)]
    out, at, seen = [], 0, 0
    whole = text.decode()
    for m in WORD.finditer(whole):
        at += len(whole[seen : m.start()].encode())
        end = at + len(m[0].encode())
        out.append((at, end))
        at, seen = end, m.end()
    return out


def word_symbols(text: bytes, hashes: Hashes) -> bytes:
    """``SYMBOL`` bytes for each word."""
    words = text.split() if not LONG_CHARACTER.search(text) else [w.encode() for w in WORD.findall(text.decode())]
    return hashes.array(words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL].tobytes()


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are given."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (suffix, prefix common with the one before); never compares known prefixes again.

    Each run yields (suffix, lcp with its predecessor in the run, payload).  Iteration yields
    (suffix, lcp with the last suffix yielded, payload).
    """

    def __init__(self, runs: list):
        self.k = 1
        while self.k < max(len(runs), 1):
            self.k *= 2
        self.runs = [iter(r) for r in runs] + [iter(())] * (self.k - len(runs))
        self.head: list = [next(r, None) for r in self.runs]
        self.lcp = [0] * self.k  # with the last winner
        self.compared = 0
        self.tree = [-1] * self.k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The run with the smaller head; the loser stays in the node, with its prefix common with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None or x is None:
            win, lose = (a, b) if y is None else (b, a)
        elif self.lcp[a] != self.lcp[b]:
            win, lose = (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        else:
            h = _common(x[0], y[0], self.lcp[a])
            self.compared += h - self.lcp[a] + 1
            win, lose = (a, b) if x[0][h:] <= y[0][h:] else (b, a)
            self.lcp[lose] = h
        self.tree[node] = lose
        return win

    def __iter__(self):
        while (item := self.head[self.winner]) is not None:
            w = self.winner
            yield item[0], self.lcp[w], item[2]
            self.head[w] = nxt = next(self.runs[w], None)
            self.lcp[w] = nxt[1] if nxt is not None else 0
            node = (w + self.k) // 2
            while node:
                w = self._play(node, w, self.tree[node])
                node //= 2
            self.winner = w


def pack_run(entries: list[tuple[bytes, bytes, list[tuple[int, int]]]]) -> bytes:
    """Front-coded bytes of entries (suffix, reversed text before, members), sorted by suffix and text before."""
    lcp, rest, lcl, before = [], [], [], []
    last_s, last_b = b"", b""
    for s, b, _ in entries:
        h, g = _common(last_s, s, 0), _common(last_b, b, 0)
        lcp.append(h)
        rest.append(s[h:])
        lcl.append(g)
        before.append(b[g:])
        last_s, last_b = s, b
    members = [m for _, _, ms in entries for m in ms]
    heads = np.array([lcp, list(map(len, rest)), lcl, list(map(len, before)), [len(ms) for _, _, ms in entries]], np.uint32)
    return b"".join([np.array([len(entries), len(members)], np.uint32).tobytes(), heads.tobytes(), np.array(members, np.int64).reshape(-1, 2).tobytes(), *rest, *before])


def read_run(blob: bytes):
    """The entries of a packed run: (suffix, lcp with the one before, (text before, members))."""
    n, m = np.frombuffer(blob, np.uint32, 2).tolist()
    heads = np.frombuffer(blob, np.uint32, 5 * n, 8).reshape(5, n)
    at = 8 + 20 * n
    members = np.frombuffer(blob, np.int64, 2 * m, at).reshape(m, 2)
    at += 16 * m
    to = at + int(heads[1].sum())
    s, b, first = b"", b"", 0
    for h, r, g, q, k in heads.T.tolist():
        s, at = s[:h] + blob[at : at + r], at + r
        b, to = b[:g] + blob[to : to + q], to + q
        yield s, h, (b, members[first : first + k])
        first += k


def repeats_of(entries: list, length: int = LENGTH, window: int = WINDOW):
    """Repeated strings around anchors.

    ``entries``: (suffix, lcp with the one before, (reversed text before, members)) in suffix order.  Yields
    (members, first offset before the anchor, last offset) for each maximal run of offsets.
    """
    if not entries:
        return
    floor = length - window + 1
    lcp = np.array([e[1] for e in entries], np.int64)
    lcp[0] = 0
    group = np.cumsum(lcp < floor) - 1  # suffixes that share too little never share a string
    weight = np.array([len(e[2][1]) for e in entries], np.int64)
    before = [e[2][0] for e in entries]
    r_len, l_len = np.array([len(e[0]) for e in entries]), np.array(list(map(len, before)))
    same = np.r_[False, (lcp[1:] == r_len[1:]) & (r_len[1:] == r_len[:-1]) & np.fromiter((a == b for a, b in zip(before, before[1:])), bool, len(before) - 1)]
    sure = (weight > 1) | same | np.r_[same[1:], False]
    sizes = np.bincount(group)
    undecided = np.bincount(group, ~sure) > 0
    ok = np.zeros((len(entries), window), bool)
    valid = np.arange(window)[None, :]
    ok[sure] = (valid <= l_len[sure, None]) & (length - valid <= r_len[sure, None])
    todo = np.flatnonzero((undecided & (sizes > 1))[group])
    if len(todo):
        n = len(todo)
        cut, right, left_len, w = lcp[todo].copy(), r_len[todo], l_len[todo], weight[todo]
        cut[np.r_[True, group[todo][1:] != group[todo][:-1]]] = 0
        order = sorted(range(n), key=lambda i: before[todo[i]])
        lcl = np.array([0, *(_common(before[todo[a]], before[todo[b]], 0) for a, b in zip(order, order[1:]))], np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        for o in range(window):
            fits = np.flatnonzero((left_len >= o) & (right >= length - o))
            if not len(fits):
                continue
            key = np.cumsum(cut < length - o)[fits] * (n + 1) + np.cumsum(lcl < o)[rank[fits]]
            by = np.argsort(key, kind="stable")
            head = np.r_[True, key[by][1:] != key[by][:-1]]
            number = np.cumsum(head) - 1
            many = np.bincount(number, w[fits][by]) > 1
            ok[todo[fits[by]], o] = many[number]
    edge = np.diff(np.pad(ok, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    for i, a, b in zip(row.tolist(), start.tolist(), (stop - 1).tolist()):
        yield entries[i][2][1], a, b


def find_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(rid, start, end): byte ranges [start, end) that repeated strings cover; at each place in one but its last ``length - 1`` a repeated string starts.  ``docs``: rid, text."""
    spark = docs.sparkSession
    tune(spark)
    floor = length - window + 1

    def anchors(batches):
        for b in batches:
            texts = [t or b"" for t in binaries(b.column(1))]
            found = anchors_of(texts, length, window)
            h = [context_hash(t, a, floor) for t, at in zip(texts, found) for a in at.tolist()]
            rid = np.repeat(b.column(0).to_numpy(), [len(a) for a in found])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            h = np.array(h, np.uint64)
            # an anchor met twice in a batch is live already: one stands for its hash, the others are dealt anywhere
            _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            sure = n[inverse] > 1
            away = sure & (first[inverse] != np.arange(len(h)))
            deal = np.where(away, mix(h ^ mix(rid.astype(np.uint64) << np.uint64(20) ^ at.astype(np.uint64))), h)
            yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(sure), pa.array(rid, pa.int64()), pa.array(at, pa.int64())], names=["h", "sure", "rid", "at"])

    def shared(batches):
        last, pending = None, None
        for b in batches:
            if pending is not None:
                b = pa.Table.from_batches([pending, b]).combine_chunks().to_batches()[0]
            h = b.column(0).to_numpy()
            if not len(h):
                continue
            same = np.r_[last is not None and h[0] == last, h[1:] == h[:-1]]
            keep = same | np.r_[same[1:], False] | b.column(1).to_numpy(zero_copy_only=False)
            yield b.slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
            pending, last = b.slice(len(h) - 1), (h[-2] if len(h) > 1 else last)
        if pending is not None and (pending.column(1)[0].as_py() or (last is not None and pending.column(0)[0].as_py() == last)):
            yield pending

    dealt = docs.select("rid", "text").mapInArrow(lean(anchors), "h long, sure boolean, rid long, at long").repartition("h").sortWithinPartitions("h")
    live = scratch.write(dealt.mapInArrow(lean(shared), "h long, sure boolean, rid long, at long").select("rid", "at"), "anchors")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), live.count() // PART_ANCHORS, 1)
    del dealt  # else its shuffle files stay
    release(spark)
    places = live.groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def runs(batches):
        held: dict[tuple[bytes, bytes], list] = {}
        count = 0

        def flush():
            by_part: dict[int, list] = {}
            for (s, b), members in held.items():
                by_part.setdefault((xxhash.xxh3_64_intdigest(s[:floor]) >> 8) % parts, []).append((s, b, members))
            keys = sorted(by_part)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([pack_run(sorted(by_part[k], key=lambda e: e[:2])) for k in keys], pa.binary())], names=["part", "run"])

        for b in batches:
            for rid, text, at in zip(b.column(0).to_pylist(), binaries(b.column(1)), b.column(2).to_pylist()):
                for a in at:
                    held.setdefault((text[a : a + length], text[max(0, a - window + 1) : a][::-1]), []).append((rid, a))
                count += len(at)
                if count >= RUN_ANCHORS:
                    yield flush()
                    held, count = {}, 0
        if held:
            yield flush()

    sent = docs.select("rid", "text").join(places, "rid").select("rid", "text", "at").mapInArrow(lean(runs), "part int, run binary")

    def merge(table):
        entries = list(LoserTree([read_run(blob) for blob in binaries(table.column("run"))]))
        rid, start, end = [], [], []
        for members, a, b in repeats_of(entries, length, window):
            rid.append(members[:, 0])
            start.append(members[:, 1] - b)
            end.append(members[:, 1] - a + length)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (rid, start, end)], names=["rid", "start", "end"])

    spans = scratch.write(sent.groupBy("part").applyInArrow(merge, "rid long, start long, end long"), "spans")
    scratch.drop("anchors")
    del sent, places, live
    release(spark)
    return spans


def find_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(rid, spans) for rows that have some, each span a range of ``find_ranges``."""
    return find_ranges(docs, scratch, length, window).groupBy("rid").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("spans"))


def find_word_ranges(docs: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """(rid, start, end): ranges of words, counted from 0, that repeated runs of ``words`` words cover.  ``docs``: rid, text.

    Words become symbols of equal width, and repeated strings of ``words`` symbols are found; those
    that start inside a symbol are not runs of words and go.
    """

    def encode(batches):
        hashes = Hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_symbols(t or b"", hashes) for t in binaries(b.column(1))], pa.binary())], names=["rid", "text"])

    tune(docs.sparkSession)
    length = words * SYMBOL
    found = find_ranges(docs.select("rid", "text").mapInArrow(lean(encode), "rid long, text binary"), scratch, length, length // 2)
    return found.select("rid", F.ceil(F.col("start") / SYMBOL).alias("start"), F.floor(F.col("end") / SYMBOL).alias("end")).filter(F.col("end") - F.col("start") >= words)


def united(spans: list | None) -> list[tuple[int, int]]:
    """Maximal ranges of sorted, possibly overlapping ones."""
    out: list[list[int]] = []
    for s, e in spans or ():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (with text and a unique key ``rid``) and the sorted spans of repeated strings (null where there are none)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    return docs.join(find_repeats(docs.select("rid", "text"), scratch, length, length // 2), "rid", "left")


def with_passages(docs: DataFrame, words: int, length: int = LENGTH) -> DataFrame:
    """``docs`` (with text and a unique key ``rid``) and ``spans``: ranges of words in repeated runs of ``words`` words, and of bytes in repeated strings of ``length`` bytes (null without either)."""
    spark = docs.sparkSession
    rows = docs.select("rid", "text")
    by_word = find_word_ranges(rows, Scratch(spark, "passages"), words)
    release(spark)
    by_byte = find_ranges(rows, Scratch(spark, "suffixes"), length, length // 2)
    both = by_word.withColumn("unit", F.lit("words")).unionByName(by_byte.withColumn("unit", F.lit("bytes")))
    own = lambda unit: F.collect_list(F.when(F.col("unit") == unit, F.array("start", "end"))).alias(unit)
    return docs.join(both.groupBy("rid").agg(own("words"), own("bytes")).select("rid", F.struct("words", "bytes").alias("spans")), "rid", "left")


def cut_passages(text: bytes, spans: dict) -> bytes:
    """``text`` without the ranges that ``with_passages`` gives."""
    ranges = [tuple(x) for x in spans["bytes"]]
    if spans["words"]:
        places = word_places(text)
        ranges += [(places[a][0], places[b - 1][1]) for a, b in spans["words"]]
    return cut(text, united(sorted(ranges)))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Operator 8's digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = with_spans(keyed(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "suffixes-docs")), length).select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(binaries(b.column(1)), b.column(2).to_pylist()):
                text, ranges = text or b"", united(spans)
                kept = cut(text, ranges)
                out.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
