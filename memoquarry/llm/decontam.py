"""Operator 6, benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of bounded size.  A shard's word stream becomes a
text over the benchmark's own vocabulary: a word that no item has cannot lie in a match, so
each stretch of such words is one separator, and stretches of item words that are shorter
than the shortest window are left out too (both without loss).  Over that text the
shard builds a suffix array, its Burrows-Wheeler transform, a wavelet matrix with rank
counts, and every ``STEP``-th suffix position.  All windows are searched backwards together,
their occurrences are located from the sampled positions, and overlapping ones are merged.

The benchmark is sent to executors in blocks of at most ``BLOCK_BYTES`` of text; with several
blocks the documents pass through one narrow step for each, and the driver holds one block at a time, so memory stays
bounded however large the benchmark is, and nothing is shuffled.  A worker makes a block's windows once.

Defined results: null or empty texts have no words; texts are read whole, however long; items without words have no window;
rows of the benchmark without an item_id still hit words but are not listed; repeated item_ids
count once; an empty benchmark contaminates nothing, and an empty table of documents gives an empty result; repeated documents
are judged row by row; other columns, whatever their names, are kept by ``find_hits`` (but for n_words, spans and items) and ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import binaries, lean, ragged, tune

WINDOW = 10
STEP = 8
SHARD_BYTES = 24 << 20
BLOCK_BYTES = 16 << 20
#: ASCII letters lower-cased, digits and bytes of other characters kept, the rest blank.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """The distinct windows of benchmark items as rows of vocabulary ids, and their items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list]] = {}
        for n in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == n]
            self.by_length[n] = np.array(keys, np.int64), [found[k] for k in keys]
        self.shortest = min(self.by_length, default=1)


class FMIndex:
    """Suffix order, wavelet matrix and sampled positions of one shard's text.

    ``text``: symbols from 1, with 0 as separator (the last symbol is one).
    """

    def __init__(self, text: np.ndarray, step: int = STEP):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.start = np.searchsorted(text[sa], np.arange(int(text.max()) + 2))  # rows before a symbol's own
        self.ones, self.zeros, row = [], [], bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.base = np.array([self._walk(np.array([c]), np.array([0]))[0] for c in range(int(text.max()) + 1)])
        self.bwt = bwt
        head = np.concatenate(([True], text[:-1] == 0))  # a walk back ends at a stretch's first symbol at the latest
        marked = head | (np.arange(n) % step == 0)
        self.marked = marked[sa]
        self.order = np.concatenate(([0], np.cumsum(self.marked)))
        self.sampled = sa[self.marked]

    def _walk(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            up = self.ones[k][row]
            row = np.where((symbol >> level) & 1, self.zeros[k] + up, row - up)
        return row

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol occurs in the transform before the row."""
        return self._walk(symbol, row) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern."""
        known = (patterns < len(self.start) - 1).all(axis=1)
        low = np.zeros(len(patterns), np.int64)
        high = np.where(known, len(self.bwt), 0)
        live = np.flatnonzero(known)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            low[live] = self.start[c] + self.rank(c, low[live])
            high[live] = self.start[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            hit = self.marked[rows[live]]
            done = live[hit]
            out[done] = self.sampled[self.order[rows[done]]] + walked
            live = live[~hit]
            c = self.bwt[rows[live]]
            rows[live] = self.start[c] + self.rank(c, rows[live])
            walked += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; separators are unequal (ordered by place), so no order runs past one."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    sa, k = np.argsort(rank, kind="stable"), 1
    place = rank[sa]
    new = np.concatenate(([0], np.cumsum(place[1:] != place[:-1])))
    rank[sa] = new
    while int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        place = key[sa]
        rank[sa] = np.concatenate(([0], np.cumsum(place[1:] != place[:-1])))
        k *= 2
    return sa


def hits_of_shard(texts: list[bytes | None], windows: Windows) -> tuple[np.ndarray, list[np.ndarray], list[set]]:
    """Words of each text, its merged hit spans (start, end), and the items found in it."""
    ids, n_words = [], np.zeros(len(texts), np.int64)
    get, none = windows.vocab.get, iter(lambda: 0, 1)
    for i, text in enumerate(texts):
        words = words_of(text)
        n_words[i] = len(words)
        ids.append(np.fromiter(map(get, words, none), np.int64, len(words)))
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
    items: list[set] = [set() for _ in texts]
    if not windows.by_length or not n_words.sum():
        return n_words, spans, items
    flat, first = np.concatenate(ids), np.concatenate(([0], np.cumsum(n_words)))
    # stretches of item words within one text, of a window's length at least
    inside = flat > 0
    begin = inside & np.concatenate(([True], ~inside[:-1]))
    begin[first[:-1][n_words > 0]] |= inside[first[:-1][n_words > 0]]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return n_words, spans, items
    stretch = np.cumsum(begin)[inside] - 1
    lengths = np.bincount(stretch, minlength=len(starts))
    keep = lengths >= windows.shortest
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return n_words, spans, items
    ends = np.cumsum(lengths + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    word_at = np.full(len(text), -1, np.int64)
    to = ragged(ends - lengths - 1, lengths)
    word_at[to] = ragged(starts, lengths)
    text[to] = flat[word_at[to]]
    index = FMIndex(text)
    found_at, found_len, found_key = [], [], []
    owners: list[set] = []
    for size, (patterns, names) in windows.by_length.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        found_at.append(word_at[index.locate(ragged(low[hit], count))])
        found_len.append(np.full(len(found_at[-1]), size))
        found_key.append(np.repeat(hit, count) + len(owners))
        owners += names
    at, size, key = map(np.concatenate, (found_at, found_len, found_key))
    if not len(at):
        return n_words, spans, items
    doc = np.searchsorted(first, at, side="right") - 1
    for d, k in set(zip(doc.tolist(), key.tolist())):
        items[d] |= owners[k]
    order = np.argsort(at, kind="stable")
    at, to, doc = at[order], (at + size)[order], doc[order]
    reach = np.maximum.accumulate(to)
    new = np.concatenate(([True], (at[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    merged = np.stack([at[heads], reach[tails]], 1)
    of = doc[heads]
    for d in np.unique(of):
        spans[d] = merged[of == d] - first[d]
    return n_words, spans, items


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows = sorted([*a.tolist(), *b.tolist()])
    out: list[list[int]] = []
    for s, e in rows:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, np.int64).reshape(-1, 2)


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES):
    """The items in blocks of bounded size, one after another as they are streamed to the driver (one at least)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        n = len(row[1] or b"") + 16
        if size + n > most and block:
            yield block
            block, size = [], 0
        block.append((row[0], None if row[1] is None else bytes(row[1])))
        size += n
    yield block


_made: dict = {}


def windows_of(shared, window: int) -> Windows:
    """The windows of a broadcast block, made once in a worker (which keeps those of one block)."""
    block = shared.value  # a worker keeps a broadcast's value, so the same list is the same block
    if _made.get("of") is not block or _made["window"] != window:
        _made.update(of=block, window=window, made=Windows(block, window))
    return _made["made"]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges) and items (sorted ids) appended."""
    spark = docs.sparkSession
    tune(spark)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<array<long>>"), "items": F.array().cast("array<string>")})
    for block in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            windows = windows_of(shared, window)

            def flush(held):
                texts = [t for b in held for t in binaries(b.column(b.schema.get_field_index(text_col)))]
                n_words, spans, items = hits_of_shard(texts, windows)
                i = 0
                for b in held:
                    old = b.select(["spans", "items"]).to_pylist()
                    n = len(old)
                    new = {"n_words": pa.array(n_words[i : i + n]), "spans": pa.array([_union(np.array(o["spans"], np.int64).reshape(-1, 2), s).tolist() for o, s in zip(old, spans[i : i + n])], pa.list_(pa.list_(pa.int64()))), "items": pa.array([sorted({*o["items"], *(x for x in s if x is not None)}) for o, s in zip(old, items[i : i + n])], pa.list_(pa.string()))}
                    i += n
                    yield pa.RecordBatch.from_arrays([new.get(name, b.column(k)) for k, name in enumerate(b.schema.names)], names=b.schema.names)

            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= SHARD_BYTES:
                    yield from flush(held)
                    held, size = [], 0
            if held:
                yield from flush(held)

        out = out.mapInArrow(lean(run), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Operator 6's digest: one row per document."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_hits(text: bytes | None, spans: list) -> bytes | None:
    """A text without the words of its hit spans (from a span's first word to its last)."""
    if not spans or text is None:
        return text
    folded = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], folded.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : begin[s]])
        at = int(end[e - 1])
    return b"".join([*out, text[at:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, sizes WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win USING (n, k)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY 1)
SELECT f.doc_id, len(f.w)::BIGINT AS n_words, coalesce(word.n_hit, 0)::BIGINT AS n_hit, coalesce(named.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(word.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
