"""Operator 2, exact Jaccard join of word shingle sets: links, and their components.

1. Every text becomes its set of hashed ``WORDS``-word shingles, written once.  Equal sets are one class
   from here on (a set's answers are those of an equal set), so copies cost one row each.
2. Shingles are ordered frequent-last: those in over ``COMMON`` of all documents, counted over
   all documents, come after all others; hashes order the rest.  Two sets that reach the
   threshold share a shingle in their prefixes, so prefixes are indexed: (shingle, set, size,
   position) in packed blocks by shingle range.
3. Lists are walked in order of size.  First only neighbours in a list are proposed, then for each
   member the one that looks nearest, and the proven ones are joined into components.  Then each list is walked again: members
   of one component are skipped, and of the rest only blocks of positions whose bound (1 + what
   remains after the position) and size can reach the threshold are paired.
4. Pairs are dropped if parity bitmaps, whose distance bounds the sets' difference
   from below, already exceed what the threshold allows; the rest are compared exactly.
5. Components are closed by large-star and small-star rounds on the class graph.
6. Links join members of one component only.  There each set is held as its difference X from one set of the
   component, the pivot, and the answers of all members follow from these: |a xor b| = |Xa| + |Xb| - 2 |Xa and Xb|.
   Pairs that |Xa| + |Xb| already admits, or ||Xa| - |Xb|| already excludes, are settled without a look at the
   differences.  Large components are cut into blocks, and a task counts the links between two blocks.

A group of near copies costs a chain of neighbours in each of its lists; its links are counted, not emitted.  A task
holds the entries of one shingle range (24 bytes each; ranges grow in number with the input), or two blocks of differences.

Defined results: null, empty and blank texts have no shingles, stand alone and have no links; texts of fewer
words than ``WORDS`` have one shingle, the whole sequence; texts are read whole, however long; repeated rows and ids belong to one
class, and each row links with every other row of it; a null id is a component of its own class (its smallest id is taken among
non-null ids); an empty table gives an empty result; other columns, whatever their names, are ignored.
Shingles are 64-bit hashes; sets are told apart by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoquarry.llm.common import Hashes, Scratch, binaries, keyed, lean, mix, ragged, release, tune

WORDS = 4
NUMERATOR, DENOMINATOR = 85, 100
#: Share of documents from which a shingle counts as common.
COMMON = 1 / 2000
#: Most common shingles that are told apart (the sum of set sizes over COMMON bounds them anyway).
COMMON_MOST = 1 << 20
CHUNK_BYTES = 8 << 20
#: Bytes of the short parity map that list members carry.
BRIEF = 32
#: Ids that are broadcast at most (8 bytes each).
SENT_IDS = 1 << 18
#: Pairs that a task holds to drop their repeats (16 bytes each) before it emits them.
HELD_PAIRS = 1 << 19


def shingles(text: bytes | None, hashes: Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    w = hashes.array(text.lower().split())
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(31) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def least_overlap(a, b, num: int = NUMERATOR, den: int = DENOMINATOR):
    """Smallest intersection of sets of sizes a and b that link: den * i >= num * (a + b - i)."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(n, num: int = NUMERATOR, den: int = DENOMINATOR):
    return n - -((-num * n) // den) + 1


def parity_bits(n: int) -> int:
    """Bitmap length for a set of n: a power of two, at least n and 256."""
    return max(8 * BRIEF, 1 << max(n - 1, 0).bit_length())


def parity(s: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of members falls on it (packed)."""
    bits = parity_bits(len(s))
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def brief(bitmap: np.ndarray) -> np.ndarray:
    """A parity bitmap folded to ``BRIEF`` bytes."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, BRIEF), axis=0)


def parity_distance(a: bytes, b: bytes) -> int:
    """At most |a xor b|; the longer map is folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):  # bit i of the short map holds all i + k * bits of the long one
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _facts(docs: DataFrame, words: int) -> DataFrame:
    """rid, n (set size), sid and sid2 (the set's digest), parity bitmap, its short form, and the set itself."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            sets = [shingles(t, hashes, words) for t in binaries(b.column(1))]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            bits = [parity(s) for s in sets]
            low, high = (np.array([d >> k & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64) for k in (0, 64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([brief(x).tobytes() for x in bits], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "n", "sid", "sid2", "parity", "brief", "set"])

    return docs.select("rid", "text").mapInArrow(lean(run), "rid long, n long, sid long, sid2 long, parity binary, brief binary, set binary")


def common_shingles(facts: DataFrame, total: int) -> np.ndarray:
    """Shingles that a share ``COMMON`` of all documents have, counted per chunk and summed."""

    def run(batches):
        held, docs_held, size = [], 0, 0

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, int(COMMON * docs_held))
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

        for b in batches:
            held += [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
            docs_held, size = docs_held + b.num_rows, size + b.nbytes
            if size >= CHUNK_BYTES:
                yield flush()
                held, docs_held, size = [], 0, 0
        if held:
            yield flush()

    counted = facts.select("set").mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = counted.filter(F.col("n") >= max(2, int(COMMON * total))).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST)
    return np.sort(often.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def _entries(facts: DataFrame, common: np.ndarray, ranges: int, num: int, den: int) -> DataFrame:
    """Packed blocks of prefix entries: (part, entries)."""
    shared = facts.sparkSession.sparkContext.broadcast(common)  # bounded by COMMON_MOST

    def run(batches):
        common, known = shared.value, set()
        held: list[tuple] = []
        size = 0

        def flush():
            token, sid, n, pos = map(np.concatenate, zip(*held))
            part = (token >> np.uint64(32)).astype(np.int64) * ranges >> 32
            order = np.argsort(part, kind="stable")
            part, rows = part[order], np.stack([token, sid, n.astype(np.uint64) << np.uint64(32) | pos.astype(np.uint64)], 1)[order]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.append(heads[1:], len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary())], names=["part", "entries"])

        for b in batches:
            for sid, blob in zip(b.column(0).to_numpy().view(np.uint64), b.column(1).to_pylist()):
                if not blob or sid in known:
                    continue
                if len(known) < 500_000:
                    known.add(sid)
                s = np.frombuffer(blob, np.uint64)
                last = np.isin(s, common, assume_unique=True) if len(common) else np.zeros(len(s), bool)
                first = np.concatenate((s[~last], s[last]))[: prefix_length(len(s), num, den)]
                held.append((first, np.full(len(first), sid, np.uint64), np.full(len(first), len(s)), np.arange(len(first))))
                size += 24 * len(first)
            if size >= CHUNK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return facts.select("sid", "set").mapInArrow(lean(run), "part int, entries binary")


def _lists(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Entries of one shingle range, sorted by shingle, size, set: list number, set, size, position; lists of two or more."""
    rows = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 3)
    order = np.argsort(rows[:, 0], kind="stable")
    rows = rows[order]
    same = np.r_[False, rows[1:, 0] == rows[:-1, 0]]
    rows = rows[same | np.r_[same[1:], False]]  # most shingles occur in one set only
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2] >> np.uint64(32), rows[:, 0]))]
    if len(rows):
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]  # equal sets from several tasks
    size = (rows[:, 2] >> np.uint64(32)).astype(np.int64)
    pos = (rows[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    number = np.cumsum(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) - 1 if len(rows) else np.zeros(0, np.int64)
    return number, rows[:, 1], size, pos


def _possible(na, pa_, nb, pb, num, den):
    """Size and position bounds for two sets that share the shingles at these positions."""
    need = least_overlap(na, nb, num, den)
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) + np.minimum(pa_, pb) >= need)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
    return np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.zeros((0, 2), np.int64)


def _pairs_frame(both: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _neighbours(members: DataFrame, num: int, den: int) -> DataFrame:
    """Neighbours within a list, as the written lists have them (a list cut by a split loses one pair, which a later walk finds)."""

    def run(batches):
        for b in batches:
            part, number, sid, size, pos = (b.column(i).to_numpy() for i in range(5))
            near = np.flatnonzero((part[1:] == part[:-1]) & (number[1:] == number[:-1]) & _possible(size[1:], pos[1:], size[:-1], pos[:-1], num, den)) if len(part) > 1 else np.zeros(0, np.int64)
            yield _pairs_frame(_distinct_pairs(sid[near], sid[near + 1]))

    return members.select("part", "list", "sid", "n", "pos").mapInArrow(lean(run), "a long, b long").distinct()


def _memberships(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(part, list, lead, sid, n, pos) of lists with two members or more, unless the bounds part its only two; lead: the first member."""

    def run(key, table):
        number, sid, size, pos = _lists(binaries(table.column("entries")))
        if len(number):
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            first = first[np.diff(np.append(first, len(number))) == 2]
            parted = first[~_possible(size[first], pos[first], size[first + 1], pos[first + 1], num, den)]
            keep = np.ones(len(number), bool)
            keep[parted] = keep[parted + 1] = False
            number, sid, size, pos = number[keep], sid[keep], size[keep], pos[keep]
        part = pa.array(np.full(len(sid), key[0].as_py(), np.int32))
        head = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
        lead = np.repeat(sid[head], np.diff(np.append(head, len(number))))
        return pa.Table.from_arrays([part, pa.array(number), pa.array(lead.view(np.int64)), pa.array(sid.view(np.int64)), pa.array(size), pa.array(pos)], names=["part", "list", "lead", "sid", "n", "pos"])

    return entries.groupBy("part").applyInArrow(run, "part int, list long, lead long, sid long, n long, pos long")


def _across(members: DataFrame, num: int, den: int, best: bool = False) -> DataFrame:
    """Pairs of one list but of different components that the bounds allow.  Input: sorted by list and size.

    ``best``: for each member only the partner whose short parity map is nearest.
    """

    def near(size, bits, i, j):
        """Places where the short parity maps allow the overlap that is needed, the nearest first."""
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        order = np.argsort(apart, kind="stable")
        return order[(size[i] + size[j] - 2 * least_overlap(size[i], size[j], num, den) >= apart)[order]]

    def pairs(size, pos, comp, bits):
        """Walk a list by size; per member, skip the blocks of positions that cannot reach it."""
        left, right = [], []
        top = np.searchsorted(size, (size * den) // num, side="right")
        for i in range(len(size)):
            j = np.arange(i + 1, top[i])
            if not len(j):
                continue
            block = pos[j] >> 3  # whole blocks by their first position
            reach = np.minimum(size[i] - pos[i] - 1, size[j] - (block << 3) - 1) + 1 + np.minimum(pos[i], (block << 3) + 7)
            j = j[(reach >= least_overlap(size[i], size[j], num, den)) & (comp[j] != comp[i])]
            j = j[_possible(size[i], pos[i], size[j], pos[j], num, den)]
            j = j[near(size, bits, np.full(len(j), i), j)]
            j = j[:1] if best else j
            left.append(np.full(len(j), i))
            right.append(j)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def run(batches):
        tail: list[np.ndarray] | None = None
        held, size = [], 0
        for b in batches:
            cols = [c.to_numpy() for c in b.columns[:-1]] + [np.frombuffer(b"".join(b.columns[-1].to_pylist()), np.uint64).reshape(-1, BRIEF // 8)]
            cols = [np.concatenate((t, c)) for t, c in zip(tail, cols)] if tail else cols
            part, lst = cols[0], cols[1]
            cut = int(np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lst[1:] != lst[:-1])])[-1]) if len(part) else 0
            held.append(work([c[:cut] for c in cols]))
            tail, size = [c[cut:] for c in cols], size + len(held[-1])
            if size >= HELD_PAIRS:  # a pair's lists are spread over many batches
                held = [np.unique(np.concatenate(held), axis=0)]
                size = len(held[0])
                if 2 * size >= HELD_PAIRS:
                    yield _pairs_frame(held[0])
                    held, size = [], 0
        if tail:
            held.append(work(tail))
        if held:
            yield _pairs_frame(np.unique(np.concatenate(held), axis=0))

    def work(cols):
        part, lst, sid, size, pos, comp, bits = cols
        if not len(part):
            return np.zeros((0, 2), np.int64)
        heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lst[1:] != lst[:-1])])
        ends = np.append(heads[1:], len(part))
        two = (ends - heads == 2)
        i = heads[two]
        i = i[(comp[i] != comp[i + 1])]
        i = i[_possible(size[i], pos[i], size[i + 1], pos[i + 1], num, den)]
        i = i[near(size, bits, i, i + 1)]
        left, right = [sid[i]], [sid[i + 1]]
        for s, e in zip(heads[~two], ends[~two]):
            if (comp[s:e] != comp[s]).any():
                a, b = pairs(size[s:e], pos[s:e], comp[s:e], bits[s:e])
                left.append(sid[s + a])
                right.append(sid[s + b])
        return _distinct_pairs(np.concatenate(left), np.concatenate(right))

    return members.mapInArrow(lean(run), "a long, b long")


def _verify(pairs: DataFrame, reps: DataFrame, facts: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs of hash ids whose sets link, as pairs of class ids (their representatives' row keys)."""
    side = lambda x: reps.select(F.col("sid").alias(x), F.col("class").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb")

    def prune(batches):
        for b in batches:
            d = b.to_pydict()
            keep = [na + nb - 2 * int(least_overlap(na, nb, num, den)) >= parity_distance(x, y) for na, nb, x, y in zip(d["na"], d["nb"], d["pa"], d["pb"])]
            both = np.array([(min(x, y), max(x, y)) for x, y, k in zip(d["ca"], d["cb"], keep) if k], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["ca", "cb"])

    likely = scratch.write(met.select("ca", "cb", "na", "nb", "pa", "pb").mapInArrow(lean(prune), "ca long, cb long").distinct(), f"likely-{name}")
    wanted = scratch.write(likely.select(F.col("ca").alias("rid")).union(likely.select("cb")).distinct(), f"wanted-{name}")
    # few ids are sent to the sets, so that these are not shuffled; beyond that size both meet by shuffle
    few = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    sets = scratch.write(facts.select("rid", "set").join(few, "rid", "left_semi"), f"sets-{name}")
    joined = likely.join(sets.select(F.col("rid").alias("cb"), F.col("set").alias("other")), "cb").join(sets.select(F.col("rid").alias("ca"), "set"), "ca")

    def compare(batches):
        for b in batches:
            own, other = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = pa.array([overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least_overlap(len(x) // 8, len(y) // 8, num, den) for x, y in zip(own, other)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    links = scratch.write(joined.select("ca", "cb", "set", "other").mapInArrow(lean(compare), "a long, b long"), f"links-{name}")
    for part in ("likely", "wanted", "sets", "proposed"):
        scratch.drop(f"{part}-{name}")
    return links


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


#: Members of a component in one block of its link count, and blocks of one component at most (beyond, blocks grow).
BLOCK_MEMBERS, BLOCKS = 256, 32


def count_links(size: np.ndarray, copies: np.ndarray, diffs: list[np.ndarray], block: np.ndarray, num: int, den: int) -> np.ndarray:
    """For sets given by their differences from one pivot, the copies of the other sets that each links with.

    ``block``: 0 and 1 for the two blocks, whose cross pairs alone count, or all equal: all pairs count.
    """
    x = np.array([len(d) for d in diffs], np.int64)
    inside = block.min() == block.max()
    right = np.arange(len(x)) if inside else np.flatnonzero(block == block.max())
    left = right if inside else np.flatnonzero(block == block.min())
    if inside and len(left) < 2:
        return np.zeros(len(x), np.int64)
    tokens, where = np.unique(np.concatenate([diffs[j] for j in right]), return_inverse=True)
    by = np.argsort(where, kind="stable")
    owner = np.repeat(np.arange(len(right)), x[right])[by]
    start = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(tokens))))).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for i in left.tolist():
        both = size[i] + size[right]
        most = both - 2 * least_overlap(size[i], size[right], num, den)  # members in which the two may differ
        linked = x[i] + x[right] <= most
        open_ = ~linked & (np.abs(x[i] - x[right]) <= most)
        if open_.any():
            at = np.searchsorted(tokens, diffs[i])
            at = at[at < len(tokens)][tokens[at[at < len(tokens)]] == diffs[i][at < len(tokens)]]
            shared = np.bincount(owner[ragged(start[at], start[at + 1] - start[at])], minlength=len(right))
            linked |= open_ & (x[i] + x[right] - 2 * shared <= most)
        if inside:
            linked[i] = False
        out[i] += copies[right[linked]].sum()
        if not inside:
            out[right[linked]] += copies[i]
    return out


def _links(roots: DataFrame, reps: DataFrame, facts: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(class, linked): the documents of other classes that a class links with.  ``roots``: (node, root) of components of two classes or more."""
    members = roots.select(F.col("node").alias("class"), "root").union(roots.select("root", "root").distinct())
    count = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = scratch.write(members, "members-of")
    few = members.select(F.col("class").alias("rid"))
    few = F.broadcast(few) if members.count() <= SENT_IDS else few
    sets = scratch.write(facts.select("rid", "set").join(few, "rid", "left_semi").select(F.col("rid").alias("class"), "set"), "sets-of")
    rows = members.join(reps.select("class", "n", "copies"), "class").join(sets, "class")
    rows = rows.join(count, "root").join(sets.select(F.col("class").alias("root"), F.col("set").alias("pivot")), "root")

    def differ(batches):
        for b in batches:
            diffs = [np.setxor1d(np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64), assume_unique=True).tobytes() for s, p in zip(b.column(5).to_pylist(), b.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(diffs, pa.binary())], names=["root", "class", "members", "n", "copies", "diff"])

    diffs = rows.select("root", "class", "members", "n", "copies", "set", "pivot").mapInArrow(lean(differ), "root long, class long, members long, n long, copies long, diff binary")
    blocks = F.least(F.ceil(F.col("members") / BLOCK_MEMBERS), F.lit(BLOCKS)).cast("int")
    dealt = diffs.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "n", "copies", "block", "diff")
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def count_pairs(batches):
        held, at = [], None

        def flush():
            cls, n, copies, block = (np.array(c, np.int64) for c in list(zip(*held))[:4])
            if at[1] != at[2] and block.min() == block.max():
                return None  # the other block is empty
            out = count_links(n, copies, [np.frombuffer(h[4], np.uint64) for h in held], block, num, den)
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(out)], names=["class", "linked"])

        for b in batches:
            for root, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (root, i, j) != at:
                    if held and (frame := flush()):
                        yield frame
                    held, at = [], (root, i, j)
                held.append(row)
        if held and (frame := flush()):
            yield frame

    counted = met.mapInArrow(lean(count_pairs), "class long, linked long")
    return counted.groupBy("class").agg(F.sum("linked").alias("linked"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Alternating large-star and small-star rounds (each node's neighbours are pointed at the
    smallest one); every round is written out, so a lost executor costs one round at most.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before = scratch.write(now, f"{name}-0"), None
    for k in range(1, 100):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(root).distinct()
        now, old = scratch.write(small, f"{name}-{k}"), now
        # settled once each node has one edge and no root is itself below another
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("decimal(38,0)").alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{k - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components have not settled in 99 rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Rows of one first member's lists in a task, as a share of all rows; beyond it they are dealt on.
LEAD_SHARE = 1 / 500


def classes(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, links: bool = False) -> DataFrame:
    """For rows of rid (a unique key), doc_id and text: rid, doc_id, n_shingles, component (smallest key of the class), component_id, and with ``links`` n_links."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "jaccard")
    facts = scratch.write(_facts(docs, words), "facts")
    total = facts.count()
    common = common_shingles(facts, total)
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000)
    # a class for each set: its smallest row; empty sets stand alone
    reps = scratch.write(facts.filter("n > 0").groupBy("sid", "sid2").agg(F.min("rid").alias("class"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "parity", "brief"))), "classes")
    members = scratch.write(_memberships(_entries(facts, common, ranges, num, den), num, den), "members")
    release(spark)
    proposed = scratch.write(_neighbours(members, num, den), "proposed-near")
    found = _verify(proposed, reps, facts, num, den, scratch, "near")
    release(spark)
    rows = members.count()
    # leads with many rows are dealt on by list; there are 1 / LEAD_SHARE of them at most
    hot = members.groupBy("lead").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max(2048, int(rows * LEAD_SHARE))).collect()
    deals = {r["lead"]: -(-r["rows"] // max(2048, int(rows * LEAD_SHARE))) for r in hot}
    deal = F.lit(0)
    for lead, n in deals.items():
        deal = F.when(F.col("lead") == lead, F.pmod(F.xxhash64("part", "list"), F.lit(n)).cast("int")).otherwise(deal)
    for name, best in (("nearest", True), ("across", False)):
        rough = scratch.write(components(found, scratch, f"rough-{name}"), f"rough-{name}")
        named = reps.join(rough.withColumnRenamed("node", "class"), "class", "left").groupBy("sid").agg(F.min(F.coalesce("root", "class")).alias("component"), F.first("brief").alias("brief"))
        lists = members.join(named, "sid").select("lead", deal.alias("deal"), "part", "list", "sid", "n", "pos", "component", "brief")
        # lists with the same first member side by side: most of a pair's lists meet, and the pair is proposed once
        lists = lists.repartition("lead", "deal").sortWithinPartitions("lead", "deal", "part", "list", "n", "sid").drop("lead", "deal")
        proposed = scratch.write(_across(lists, num, den, best).distinct(), f"proposed-{name}")
        del lists  # else its shuffle files stay
        release(spark)
        found = found.union(_verify(proposed, reps, facts, num, den, scratch, name))
        scratch.drop(f"rough-{name}")
    scratch.drop("members")
    release(spark)
    roots = scratch.write(components(found, scratch, "all"), "roots")
    for name in ("near", "nearest", "across"):
        scratch.drop(f"links-{name}")
    placed = facts.select("rid", "n", "sid", "sid2").join(docs.select("rid", "doc_id"), "rid").join(reps.select("sid", "sid2", "class", "copies"), ["sid", "sid2"], "left")
    placed = placed.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("rid")).alias("class"), "copies")
    rooted = placed.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "rid", "doc_id", "n_shingles", F.coalesce("root", "class").alias("component"), "copies")
    extra = []
    if links:
        linked = scratch.write(_links(roots, reps, facts, num, den, scratch), "linked")
        rooted = rooted.join(linked, "class", "left")
        extra = [(F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links")]
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    done = scratch.write(rooted.join(least, "component").select("rid", "doc_id", "n_shingles", "component", "component_id", *extra), "done")
    for name in ("facts", "classes", "roots", *(["linked", "members-of", "sets-of"] if links else [])):
        scratch.drop(name)  # a few numbers a document stay, not its set
    return done


def join(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (other documents that it links with)."""
    docs = keyed(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "jaccard-docs"))
    return classes(docs, words, num, den, links=True).select("doc_id", "n_shingles", "component_id", "n_links")
