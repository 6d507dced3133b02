"""Operator 5, token counts by rank-synchronous array merging.

Texts are cut into pre-tokens, the distinct ones of a batch are held as one ragged
numpy array of symbols, and in each round every sequence merges all places of its own
lowest-rank pair at once.  The symbols that survive are the tokens.  Narrow plan: no
shuffle, memory bounded by the batch and by ``CACHE`` remembered pre-tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted
row by row; an empty table gives an empty result; other columns are ignored; a special
string inside a text is one token, as the library takes it by default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memoquarry.llm.common import tune

CACHE = 400_000
#: White space as Unicode has it (the tokenizer's library leaves out U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary -> that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Counts the tokens of byte strings under a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, back = spec["model"]["vocab"], byte_symbols()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.first = np.zeros(256, np.int64)
        for char, byte in back.items():
            self.first[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], len(self.keys))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word, all words merged in step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        none = len(self.keys)
        while len(ids):
            rank = np.where(seq[1:] == seq[:-1], self.ranks(ids[:-1] * self.width + ids[1:]), none)
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(np.append(rank, none), heads)
            sizes = np.diff(np.append(heads, len(ids)))
            out[seq[heads]] = sizes
            live = low < none
            if not live.any():
                break
            chosen = np.append(rank == np.repeat(low, sizes)[:-1], False) & np.repeat(live, sizes)
            at = np.flatnonzero(chosen)
            run = np.r_[True, np.diff(at) > 1]  # neighbours in a run such as "aaa" overlap: every second one merges
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.repeat(live, sizes)
            keep[at + 1] = False
            ids, seq = ids[keep], seq[keep]
        return out


class TokenCounter:
    def __init__(self, path: str):
        import regex

        self.merger, self.pattern, self.known = PairMerger(path), regex.compile(PATTERN), {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings among them."""
        if self.split is None or not self.split.search(text):
            return self.pattern.findall(text), 0
        pieces = self.split.split(text)
        return [w for p in pieces for w in self.pattern.findall(p)], len(pieces) - 1

    def batch(self, texts: list[str | None]) -> np.ndarray:
        split = [self.parts(t or "") for t in texts]
        fresh = list({w for words, _ in split for w in words if w not in self.known})
        local = dict(zip(fresh, self.merger.counts([w.encode("utf-8", "surrogatepass") for w in fresh]).tolist())) if fresh else {}
        if len(self.known) + len(local) > CACHE:
            local |= {w: self.known[w] for words, _ in split for w in words if w in self.known}
            self.known = {}
        if len(local) <= CACHE:
            self.known.update(local)
            local = self.known
        else:
            local = self.known | local
        return np.array([sum(map(local.__getitem__, words)) + special for words, special in split], np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    tune(docs.sparkSession)

    def run(batches):
        counter = TokenCounter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            n = counter.batch(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
