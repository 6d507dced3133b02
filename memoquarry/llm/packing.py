"""Operator 10, packing along a space-filling curve.

Every document becomes token ids; its hashed bag of tokens is projected to ``DIMS`` numbers,
each cut to ``BITS`` bits, and their Hilbert index is its place on the curve.  Documents are
range-partitioned and sorted by that key, and each partition is cut along the curve into full
sequences, so that neighbours on the curve share a sequence.  A partition's last ids fill
sequences whose lengths are powers of two, so no sequence needs padding.

The key's low bits are a hash of the row, so copies (which share their Hilbert index) are
spread over as many partitions as they need.  Documents travel in runs of at most ``RUN`` ids, so that ranges of
equally many rows hold nearly equally many ids wherever long documents lie on the curve.  Tokenized rows are
written to the scratch folder once; ids travel in the fewest bytes that the vocabulary needs.

Defined results: a null or empty text is its end id alone; texts are read whole, however long; rows with equal ids and texts are
packed one by one; ties on the curve are broken by row; an empty table gives no sequence; null ids are packed and returned
as null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Scratch, keyed, lean, mix, tune
from memoquarry.llm.tokens import byte_symbols

LENGTH = 1024
END = 0
DIMS, BITS, SALT_BITS = 4, 10, 22
BUCKETS = 1024
#: Ids of a document that travel in one row.
RUN = 1024
#: Bytes of ids that one task sorts.
PARTITION_BYTES = 24 << 20


class Ids:
    """Token ids as the byte-level vocabulary file gives them (special strings as by default)."""

    def __init__(self, path: str):
        import tiktoken

        from memoquarry.llm.tokens import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_symbols()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.size = max(*ranks.values(), *special.values()) + 1
        self.special = set(special)
        self.of = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END], np.uint32)
        ids = self.of.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        return np.append(ids, np.uint32(END)).astype(np.uint32, copy=False)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates (any number of dimensions)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the coarsest
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], salts: np.ndarray) -> np.ndarray:
    """Hilbert index of each document's projected hashed vector, with the salt below it."""
    plane = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    bag = np.zeros((len(ids), BUCKETS))
    for row, x in zip(bag, ids):
        row += np.bincount((mix(x) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    bag = np.sqrt(bag)
    bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-12)
    cells = np.clip(((bag @ plane) / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return (hilbert(cells) << SALT_BITS) | (salts & ((1 << SALT_BITS) - 1))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(rid, doc_id, salt, curve, doc_tokens, start, n, ids) for each run of a document's ids, packed little-endian.  ``docs``: rid, doc_id, text."""
    tune(docs.sparkSession)

    def run(batches):
        encode = Ids(path)
        kind = np.uint16 if encode.size <= 1 << 16 else np.uint32
        for b in batches:
            ids = [encode(t) for t in b.column(2).to_pylist()]
            key = curve_keys(ids, b.column(3).to_numpy()) if ids else np.zeros(0, np.int64)
            runs = [(i, s) for i, x in enumerate(ids) for s in range(0, len(x), RUN)]
            at = pa.array([i for i, _ in runs], pa.int64())
            pieces = [ids[i][s : s + RUN] for i, s in runs]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(key, pa.int64()).take(at), pa.array([len(ids[i]) for i, _ in runs], pa.int64()), pa.array([s for _, s in runs], pa.int64()), pa.array([len(x) for x in pieces], pa.int64()), pa.array([x.astype(kind).tobytes() for x in pieces], pa.binary())], names=["rid", "doc_id", "salt", "curve", "doc_tokens", "start", "n", "ids"])

    rows = docs.select("rid", "doc_id", "text", F.xxhash64("doc_id", "text").alias("salt"))
    return rows.mapInArrow(lean(run), f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, salt long, curve long, doc_tokens long, start long, n long, ids binary")


def cuts(total: int, length: int) -> list[int]:
    """Sequence lengths for so many ids: full ones, then powers of two."""
    out = [length] * (total // length)
    rest = total % length
    return out + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.write(tokenize(keyed(docs.select("doc_id", "text"), scratch, "docs"), path), "ids")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(total * 2 // PARTITION_BYTES))
    order = ["curve", "salt", "rid", "start"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    wide = path_width(path)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        made, room, filled = 0, length, 0
        held: list = []  # pieces of the open sequence, whose length is not known yet

        def rows_of(pieces, first_sequence):
            return [(d, s, len(x), zlib.crc32(x.tobytes()), n, base + first_sequence, o, x.tobytes()) for d, s, x, n, o in pieces]

        def emit(out):
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            keep = 8 if keep_ids else 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names=names[:keep])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            out = []
            for doc, n, start, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(blob, wide).astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(room - filled, len(ids) - at)
                    if held and start + at and held[-1][0] == doc and held[-1][1] + len(held[-1][2]) == start + at and held[-1][3] == n:
                        held[-1] = (doc, held[-1][1], np.concatenate((held[-1][2], ids[at : at + take])), n, held[-1][4])
                    else:
                        held.append((doc, start + at, ids[at : at + take], n, filled))
                    at, filled = at + take, filled + take
                    if filled == room:
                        out += rows_of(held, made)
                        made, filled, held = made + 1, 0, []
            if out:
                yield emit(out)
        if held:  # the partition's last ids, in sequences of a power of two
            out, sizes = [], cuts(filled, length)
            ends = np.cumsum(sizes)
            for doc, at, ids, n, offset in held:
                while len(ids):
                    k = int(np.searchsorted(ends, offset, side="right"))
                    take = min(len(ids), int(ends[k]) - offset)
                    out += rows_of([(doc, at, ids[:take], n, offset - int(ends[k]) + sizes[k])], made + k)
                    at, ids, offset = at + take, ids[take:], offset + take
            yield emit(out)

    schema = f"doc_id {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "doc_tokens", "start", "ids").mapInArrow(lean(run), schema + (", ids binary" if keep_ids else ""))


def path_width(path: str) -> str:
    return "<u2" if Ids(path).size <= 1 << 16 else "<u4"
