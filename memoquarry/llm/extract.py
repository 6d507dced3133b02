"""Operator 9, main text of web pages by a host suffix array.

A page is cut into blocks of words, each in one of three zones: ``article`` (inside an article or main
element), ``loose`` (other text), and ``chrome`` (menus, headers, footers, sidebars, notices, adverts, forms,
comments, by element, role, class and id).  The word streams of a host's pages, all zones, are
concatenated and their suffixes sorted by ``RUN`` words through prefix doubling; equal neighbours are
runs, or whole blocks of fewer words, that repeat.  Outside an article those on ``LOOSE_PAGES`` distinct pages
(on both, if the host has two) are boilerplate; inside one, only what at least ``ARTICLE_PAGES`` and more than
``ARTICLE_SHARE`` of the host's distinct articles have (a copied article or a quoted passage is content).
All else outside chrome stays, beside an article too.  Where that would leave a page without article under ``LEFT`` of
its loose words, its main text itself repeats (copied or syndicated): its longest block and those at least half as long stay.
Inside an article, a header is the article's own (its title) and stays.

Blocks are sent to their host, sorted by article, and cut into shards of at most ``SHARD_PAGES`` pages and
``SHARD_BYTES`` bytes; hosts with over 1/200 of all pages are dealt over several partitions first.  Equal
articles and pages meet, so that the counts of a host's shards add up.  A host in one shard is judged there;
the runs of other hosts are summed over their shards by hash, and what is boilerplate is sent to all tasks.

Defined results: a null or empty page has the text ""; pages with a null url share one host; null page_ids are kept; repeated
rows are extracted one by one and count as one page; pages are read whole, however long; runs on equally many
pages are judged alike; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from memoquarry.llm.common import Hashes, Scratch, mix, ragged, release, tune

RUN = 8
LOOSE_PAGES = 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 3
LEFT = 0.25
SHARD_PAGES, SHARD_BYTES = 400, 12 << 20
CHROME, LOOSE, ARTICLE = 0, 1, 2
#: Rows of the first pass: finished pages, pages of hosts in several shards, and those hosts' counts.
DONE, OPEN, TOTALS, LOOSE_RUN, ARTICLE_RUN = range(5)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!/?][^>]*\Z",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME_TAGS = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_WORDS = "ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|notice|nav|navbar|navigation|menu|sidebar|footer|masthead|comments?|respond|share|sharing|social|related|newsletter|subscribe|breadcrumbs?|popup|modal|login|signup|disqus|pagination|pager|widget"
CHROME_NAMES, CHROME_NAMES_INSIDE = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I) for words in (f"header|{CHROME_WORDS}", CHROME_WORDS))
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLOSED_BY_BLOCK = frozenset(["p"])


def is_chrome(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element holds no main text; ``inside``: it stands in an article."""
    if tag in CHROME_TAGS and not (inside and tag == "header"):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in CHROME_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and (CHROME_NAMES_INSIDE if inside else CHROME_NAMES).search(value):
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[int, list[str]]]:
    """(zone, words) of each block, in page order."""
    out: list[tuple[int, list[str]]] = []
    if not page:
        return out
    stack: list[tuple[str, bool, bool]] = []  # element, chrome, article
    chrome = article = 0
    held: list[str] = []

    def flush() -> None:
        nonlocal held
        if held:
            words = "".join(held).split()
            if words:
                out.append((CHROME if chrome else ARTICLE if article else LOOSE, words))
            held = []

    def close(to: int) -> None:
        nonlocal chrome, article
        for _, c, a in stack[to:]:
            chrome, article = chrome - c, article - a
        del stack[to:]

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            held.append(entities.unescape(text) if "&" in text else text)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), (m[2] if m[3] else m[5]) == "/", (m[4] if m[3] else m[7]) or ""
        if ends:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    close(i)
                    break
            continue
        if tag not in INLINE:
            flush()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
        if tag in VOID or attributes.endswith("/"):
            continue
        c, a = is_chrome(tag, attributes, article > 0), tag in ("article", "main")
        if c or a or tag not in INLINE:
            if c and tag in INLINE:
                flush()
            stack.append((tag, c, a))
            chrome, article = chrome + c, article + a
    if at < len(page):
        held.append(entities.unescape(page[at:]))
    flush()
    return out


def repeated(text: np.ndarray, kind: np.ndarray, owner: np.ndarray, short: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a run of ``run`` words or a whole shorter block begins, their groups of equal ones of a kind, and on how many distinct owners each group occurs.

    Prefix doubling sorts suffixes by their first ``run`` symbols (a power of two).  ``text``: words, and 0 between blocks;
    at least ``run`` zeros end a block of the places ``short``, so that its suffix is the block.  An owner below 0 does not count.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < run:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        k *= 2
    whole = np.zeros(n, bool)  # a run must not run over a block's end
    zero = np.concatenate(([0], np.cumsum(text == 0)))
    whole[: n - run + 1] = zero[run:] == zero[:-run]
    whole[short] = True
    at = np.flatnonzero(whole)
    rank = rank[at] * 2 + kind[at]
    order = np.lexsort((owner[at], rank))
    at, r, p = at[order], rank[order], owner[at][order]
    new_rank = np.concatenate(([True], r[1:] != r[:-1]))[: len(r)]
    new_pair = new_rank | np.concatenate(([True], p[1:] != p[:-1]))[: len(r)]
    group = np.cumsum(new_rank) - 1
    return at, group, np.bincount(group[new_pair & (p >= 0)], minlength=group[-1] + 1 if len(group) else 0)


class Shard:
    """The word streams of some pages of a host.

    ``pages``: the blocks of each page, whether its markup counts (one of equal pages does), and whether its article does.
    """

    def __init__(self, pages: list[tuple[list, bool, bool]], hashes: Hashes, run: int = RUN):
        self.parsed, self.run = [p[0] for p in pages], run
        self.pages, self.articles = sum(p[1] for p in pages), sum(p[2] for p in pages)
        words: list[str] = []
        at = 0
        starts, lengths, kinds, owners = [], [], [], []
        for i, (blocks, page, article) in enumerate(pages):
            for z, block in blocks:
                words += block
                starts.append(at)
                lengths.append(len(block))
                kinds.append(z == ARTICLE)
                owners.append(i if (article if z == ARTICLE else page) else -1)
                at += len(block) + (1 if len(block) >= run else run)
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.text = np.zeros(at + run, np.uint64)
        place = ragged(self.starts, self.lengths)
        self.text[place] = hashes.array(words) | np.uint64(1)
        kind, owner = np.zeros(len(self.text), np.int64), np.full(len(self.text), -1, np.int64)
        kind[place], owner[place] = np.repeat(kinds, self.lengths), np.repeat(owners, self.lengths)
        self.width = np.full(len(self.text), run, np.int64)
        short = self.lengths < run
        self.width[self.starts[short]] = self.lengths[short]
        self.at, self.group, self.counts = repeated(self.text, kind, owner, self.starts[short], run)
        self.first = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1]))) if len(self.group) else np.zeros(0, np.int64)
        self.kind = kind[self.at[self.first]]

    def keys(self, host: int) -> np.ndarray:
        """A hash of host, kind and words of each group."""
        h = np.full(len(self.first), host, np.uint64) + self.kind.astype(np.uint64)
        for k in range(self.run):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.text[self.at[self.first] + k])
        return h.view(np.int64)

    def decided(self) -> np.ndarray:
        """Which groups are boilerplate if these are all pages of the host."""
        return np.where(self.kind == 1, (self.counts >= ARTICLE_PAGES) & (self.counts > ARTICLE_SHARE * self.articles), self.counts >= loose_pages(self.pages))

    def texts(self, boiler: np.ndarray) -> list[str]:
        at = self.at[boiler[self.group]]
        edge = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width[at], -1)
        covered = np.cumsum(edge) > 0
        out, k = [], 0
        for blocks in self.parsed:
            kept, first = [], k
            loose = [(int(covered[self.starts[k + i] : self.starts[k + i] + len(words)].sum()), len(words)) for i, (z, words) in enumerate(blocks) if z == LOOSE]
            least = len(self.text)  # the length from which a loose block stays, repeated or not
            if loose and not any(z == ARTICLE for z, _ in blocks) and sum(n - c for c, n in loose) < LEFT * sum(n for _, n in loose):
                least = -(-max(n for _, n in loose) // 2)
            for k, (z, words) in enumerate(blocks, first):
                if z != CHROME:
                    mask = covered[self.starts[k] : self.starts[k] + len(words)]
                    kept += words if (z == LOOSE and len(words) >= least) or not mask.any() else [w for w, c in zip(words, mask.tolist()) if not c]
            k = first + len(blocks)
            out.append(" ".join(kept))
        return out


def shards(batch: pa.RecordBatch, hashes: Hashes):
    """Host hash, shard and places of the rows of each host of a batch of open pages."""
    hosts = batch.column(0).to_numpy()
    blocks, flags = batch.column(3).to_pylist(), batch.column(4).to_pylist()
    for h in np.unique(hosts):
        own = np.flatnonzero(hosts == h).tolist()
        yield int(h) % (1 << 64), Shard([(unpacked(blocks[i]), bool(flags[i] & 1), bool(flags[i] & 2)) for i in own], hashes), own


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def loose_pages(pages: int) -> int:
    return min(LOOSE_PAGES, max(2, pages))


def packed(blocks: list[tuple[int, list[str]]]) -> str:
    return "\n".join(f"{z}{' '.join(words)}" for z, words in blocks)


def main_part(line: str) -> str:
    """Packed blocks without chrome, which only counts."""
    return "\n".join(x for x in line.split("\n") if x[:1] != str(CHROME))


def unpacked(line: str) -> list[tuple[int, list[str]]]:
    return [(int(x[0]), x[1:].split(" ")) for x in line.split("\n")] if line else []


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    tune(spark)
    scratch = Scratch(spark, "extract")
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    hot = hosts.filter(F.col("n") > max(SHARD_PAGES, total // 200)).collect()  # 200 rows at most
    deals = {host: -(-n // SHARD_PAGES) for host, n in hot}
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches):
        seen: set[tuple[str, int]] = set()
        for k, b in enumerate(batches):
            out = []
            for i, (url, page, host) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                blocks = blocks_of(page)
                markup = xxh3_64_intdigest(page or "") >> 1
                inside = [w for z, words in blocks if z == ARTICLE for w in words]
                article = xxh3_64_intdigest(" ".join(inside)) >> 1 if inside else markup
                copy = (host, markup) in seen
                seen.add((host, markup))
                # equal articles meet; a page met twice in a task is dealt anywhere and does not count
                deal = (xxh3_64_intdigest(f"{url} {k} {i}") if copy else article) % deals.get(host, 1)
                out.append((host, deal, copy, article, markup, zlib.compress(packed(blocks).encode(), 1)))
            cols = list(zip(*out)) if out else [()] * 6
            types = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["page_id", "url", "host", "part", "copy", "article", "markup", "blocks"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).mapInArrow(parse, f"page_id {kind}, url string, host string, part int, copy boolean, article long, markup long, blocks binary")
    dealt = rows.repartition(max(1, -(-total // 1600)), "host", "part").sortWithinPartitions("host", "part", "copy", "article", "markup")
    names = ["what", "host_key", "key", "n", "page_id", "url", "text"]

    def judge(batches):
        hashes, id_type = Hashes(), None
        at, held, size, last, open_ = None, [], 0, (None, None), False

        def frame(what, host_key, key, n, ids, urls, texts):
            m = max(len(key), len(ids))
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, what, np.int32)), pa.array(np.full(m, host_key, np.int64)), pa.array(key, pa.int64()) if len(key) else pa.nulls(m, pa.int64()), pa.array(n, pa.int64()) if len(n) else pa.nulls(m, pa.int64()), pa.array(ids, id_type) if ids else pa.nulls(m, id_type), pa.array(urls, pa.string()) if ids else pa.nulls(m, pa.string()), pa.array(texts, pa.string()) if ids else pa.nulls(m, pa.string())], names=names)

        def flush(several):
            shard = Shard([(unpacked(x[2]), *x[3:]) for x in held], hashes)
            ids, urls = [x[0] for x in held], [x[1] for x in held]
            host = xxh3_64_intdigest(at[0])
            if not several:
                yield frame(DONE, 0, [], [], ids, urls, shard.texts(shard.decided()))
                return
            host_key = signed(host)
            yield frame(OPEN, host_key, [], [x[3] + 2 * x[4] for x in held], ids, urls, [main_part(x[2]) for x in held])
            yield frame(TOTALS, host_key, [0, 1], [shard.pages, shard.articles], [], [], [])
            keys, loose = shard.keys(host), (shard.kind == 0) & (shard.counts > 0)
            yield frame(LOOSE_RUN, host_key, keys[loose], shard.counts[loose], [], [], [])
            # what over half of a host's articles share, over half of those of some shard share
            likely = (shard.kind == 1) & (shard.counts > ARTICLE_SHARE * shard.articles)
            yield frame(ARTICLE_RUN, host_key, keys[likely], shard.counts[likely], [], [], [])

        for b in batches:
            id_type = b.column(0).type
            for page_id, url, host, part, copy, article, markup, blocks in zip(*(c.to_pylist() for c in b.columns)):
                blocks = zlib.decompress(blocks).decode()
                if (host, part) != at:
                    if held:
                        yield from flush(open_)
                    at, held, size, last, open_ = (host, part), [], 0, (None, None), deals.get(host, 1) > 1
                elif len(held) >= SHARD_PAGES or size >= SHARD_BYTES:
                    open_ = True
                    yield from flush(True)
                    held, size = [], 0
                held.append((page_id, url, blocks, not copy and markup != last[1], not copy and article != last[0] and f"\n{blocks}".find(f"\n{ARTICLE}") >= 0))
                last = last if copy else (article, markup)
                size += len(blocks)
        if held:
            yield from flush(open_)

    judged = scratch.write(dealt.mapInArrow(judge, f"what int, host_key long, key long, n long, page_id {kind}, url string, text string"), "judged")
    release(spark)
    done = judged.filter(F.col("what") == DONE).select("page_id", "url", "text")
    open_pages = judged.filter(F.col("what") == OPEN).select("host_key", "page_id", "url", "text", "n")
    totals = {(h, k): n for h, k, n in judged.filter(F.col("what") == TOTALS).groupBy("host_key", "key").agg(F.sum("n")).collect()}
    if totals:
        # the boilerplate of hosts of several shards is sent to all tasks, 8 bytes for each run
        counted = judged.filter(F.col("what") == LOOSE_RUN).groupBy("host_key", "key").agg(F.sum("n").alias("n")).filter("n >= 2").select("host_key", "key", "n")
        boiler = [k for h, k, n in counted.filter(F.col("n") >= LOOSE_PAGES).collect()]
        few = [h for (h, k), n in totals.items() if k == 0 and n < LOOSE_PAGES]
        boiler += [k for h, k, n in counted.filter((F.col("n") < LOOSE_PAGES) & F.col("host_key").isin(few)).collect()] if few else []
        likely = np.unique(np.array([k for k, in judged.filter(F.col("what") == ARTICLE_RUN).select("key").distinct().collect()], np.int64))
        if len(likely):
            asked = spark.sparkContext.broadcast(likely)

            def recount(batches):
                hashes = Hashes()
                for b in batches:
                    for h, shard, _ in shards(b, hashes):
                        keys = shard.keys(h)
                        some = np.isin(keys, asked.value)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), signed(h))), pa.array(keys[some]), pa.array(shard.counts[some], pa.int64())], names=["host_key", "key", "n"])

            again = open_pages.mapInArrow(recount, "host_key long, key long, n long").groupBy("host_key", "key").agg(F.sum("n")).collect()
            boiler += [k for h, k, n in again if n >= ARTICLE_PAGES and n > ARTICLE_SHARE * totals[h, 1]]
        shared = spark.sparkContext.broadcast(np.unique(np.array(boiler, np.int64)))

        def apply(batches):
            hashes = Hashes()
            for b in batches:
                texts = [""] * b.num_rows
                for h, shard, own in shards(b, hashes):
                    for i, t in zip(own, shard.texts(np.isin(shard.keys(h), shared.value))):
                        texts[i] = t
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        done = done.unionByName(open_pages.mapInArrow(apply, f"page_id {kind}, url string, text string"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
