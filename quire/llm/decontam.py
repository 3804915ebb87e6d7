"""Benchmark decontamination by greedy string tiling (operator 4).

Words, in lower case and without punctuation, become 64-bit hashes, and a running Karp-Rabin hash covers each `tile` (5) of them. The hashes of
the benchmark's passages are the seeds; a document joins the items that it shares seeds with. An item whose seeds in the document can't cover
`least` of its words is left there. For the others the tiling runs: matches of 5 or more words, the longest first, are marked in both texts, each word once, and what others have left of a match is
a match of its own if it's still 5 words long. The share of the item's words under tiles is its coverage, in whatever order the document
has its parts; a document is contaminated by an item of which it covers `least` (0.5).

The longest match is found by halving on its length: running hashes of that many unmarked words of both texts, compared as sets. So memory is some dozen numbers for each
word of the two texts, however often words repeat, and the places of equal seeds are never paired.

The benchmark is the query set. Up to BLOCK characters it's broadcast, some 30 MB of seeds, and documents don't shuffle. A larger one becomes tables: a bitmap of the seeds there are, of 64 MB at
most, is broadcast, the distinct seeds of each distinct text that pass it join the items' seeds, and the pairs of a text and an item that share enough of them are tiled. Then memory
hangs neither on the number of items nor on that of documents, and both are read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import discard, packed, staged, unpacked

TILE, LEAST, BLOCK = 5, 0.5, 4 << 20
PIECE, CACHE = 1 << 20, 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, for the running hash modulo 2^64
SEED_BITS, MOST_BITS = 20, 29  # of the table that says which seeds there may be: of a block, and of a whole benchmark

_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def text_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about `size` characters that end at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        stop = cut.end() if cut else len(text)
        yield text[at:stop]
        at = stop


def word_hashes(text: str) -> np.ndarray:
    parts = [np.fromiter(map(_hashes.__getitem__, _WORD.findall(p.lower())), dtype=np.uint64) for p in text_pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def running(words: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The hash of each run of `tile` words."""
    n = len(words) - tile + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, tile):
        out = out * BASE + words[k : k + n]
    return out ^ (out >> np.uint64(29))


def _windows(sums: np.ndarray, powers: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the runs of `size` unmarked words, and their hashes."""
    at = (marks[size:] == marks[:-size]).nonzero()[0]
    return at, (sums[at + size] - sums[at]) * powers[at]


def tiled(item: np.ndarray, doc: np.ndarray, tile: int = TILE) -> int:
    """Words of `item` under the tiles of greedy string tiling: again and again the longest match of unmarked words, of equal ones that with the first place in item and then in doc."""
    texts = (item, doc)
    longest = max(len(item), len(doc)) + 1
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest, BASE))))
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest, np.uint64(pow(int(BASE), -1, 2**64))))))
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(t * inverse[: len(t)]))) for t in texts]
    taken = [np.zeros(len(t), dtype=bool) for t in texts]
    covered, high = 0, min(map(len, texts))

    def free(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_windows(s, powers, np.concatenate(([0], np.cumsum(m))), size) for s, m in zip(sums, taken)]

    while high >= tile:
        low = tile - 1  # a match of `low` words may be left; one of more than `high` is not
        while low < high:
            middle = (low + high + 1) // 2
            (_, x), (_, y) = free(middle)
            low, high = (middle, high) if len(x) and len(y) and np.isin(x, y).any() else (low, middle - 1)
        if low < tile:
            break
        (i, x), (j, y) = free(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        left, right = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        some = (right > left).nonzero()[0]
        next_of: dict[int, int] = {}  # of a hash, by its first place in y: the first of its places in doc that may be free
        for a, first, end in zip(i[some].tolist(), left[some].tolist(), right[some].tolist()):
            if taken[0][a : a + low].any():
                continue
            k = next_of.get(first, first)
            while k < end and (taken[1][j[k]] or taken[1][j[k] + low - 1] or taken[1][j[k] : j[k] + low].any()):
                k += 1
            next_of[first] = k
            if k < end and (item[a : a + low] == doc[j[k] : j[k] + low]).all():
                taken[0][a : a + low] = taken[1][j[k] : j[k] + low] = True
                covered += low
        high = low - 1
    return covered


def _near_seeds(words: np.ndarray, at: np.ndarray, tile: int) -> np.ndarray:
    """The words under the seeds at these places, in order, with a word of its own where some are left out. No match goes beyond them."""
    under = np.zeros(len(words) + 1, dtype=np.int64)
    under[at] += 1
    under[at + tile] -= 1
    under = under.cumsum()[:-1] > 0
    gaps = (under & ~np.concatenate(([False], under[:-1]))).cumsum()
    gaps = np.flatnonzero(np.diff(gaps[under], prepend=0))
    return np.insert(words[under], gaps, np.arange(len(gaps), dtype=np.uint64))


def coverage(item: np.ndarray, item_seeds: np.ndarray, words: np.ndarray, seeds: np.ndarray, least: float, tile: int) -> float:
    """The share of the item's words under tiles in a document; 0 if the seeds that both have can't cover `least` of them."""
    shared = np.isin(item_seeds, seeds).nonzero()[0]
    under = np.zeros(len(item) + 1, dtype=np.int64)
    under[shared] += 1
    under[shared + tile] -= 1
    if not len(shared) or (under.cumsum()[:-1] > 0).sum() < least * len(item):
        return 0.0
    return tiled(item, _near_seeds(words, np.isin(seeds, item_seeds).nonzero()[0], tile), tile) / len(item)


class Block:
    """Items of the benchmark and their seeds."""

    def __init__(self, texts: list[str | None], tile: int = TILE) -> None:
        self.tile = tile
        made = [(k, words) for k, text in enumerate(texts) if len(words := word_hashes(text or "")) >= tile]
        self.places, self.words = [k for k, _ in made], [w for _, w in made]
        self.seeds = [running(w, tile) for w in self.words]
        every = np.concatenate([*self.seeds, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(made)), [len(s) for s in self.seeds])
        order = np.argsort(every, kind="stable")
        self.keys, self.item = every[order], item[order]
        self.some = np.zeros(1 << SEED_BITS, dtype=bool)
        self.some[self.keys >> np.uint64(64 - SEED_BITS)] = True

    def judge(self, text: str, least: float) -> tuple[float, int | None, int]:
        """(coverage, place) of the item covered most, the first of equals, and the number of items covered by `least`."""
        words = word_hashes(text)
        mine = running(words, self.tile)
        at = self.some[mine >> np.uint64(64 - SEED_BITS)].nonzero()[0]
        if not len(at) or not len(self.keys):
            return 0.0, None, 0
        shared = np.unique(mine[at])
        lo, hi = np.searchsorted(self.keys, shared, "left"), np.searchsorted(self.keys, shared, "right")
        lo, hi = lo[hi > lo], hi[hi > lo]
        if not len(lo):
            return 0.0, None, 0
        items, hits = np.unique(self.item[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])], return_counts=True)
        best, n = (0.0, None), 0
        for k, hit in zip(items.tolist(), hits.tolist()):
            if hit * self.tile < least * len(self.words[k]):
                continue
            share = coverage(self.words[k], self.seeds[k], words, mine, least, self.tile)
            if share >= least and share > 0:
                n += 1
                if share > best[0]:
                    best = share, self.places[k]
        return *best, n


def _by_block(texts: DataFrame, items: list, least: float, tile: int) -> DataFrame:
    """texts with `found`: coverage, at (the item's place in items), n."""
    sent = texts.sparkSession.sparkContext.broadcast(Block([r.t for r in items], tile))

    @F.pandas_udf("coverage double, at int, n long")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = [sent.value.judge(t, least) for t in texts]
        return pd.DataFrame({"coverage": [r[0] for r in rows], "at": pd.array([r[1] for r in rows], dtype="Int32"), "n": [r[2] for r in rows]})

    return texts.withColumn("found", judged.asNondeterministic()("text"))  # else a filter on the result runs it twice


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which of the 2^bits values the first bits of a seed take, packed."""
    slot = F.shiftrightunsigned("seed", 64 - bits) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m"))
    out = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
    for r in parts.toLocalIterator():  # 4 KB each
        piece = np.frombuffer(r.m, dtype=np.uint8)[: len(out)]
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(piece)] = piece
    return out


def _by_tables(texts: DataFrame, items: DataFrame, least: float, tile: int) -> DataFrame:
    """key, coverage, item, n of each distinct text that covers `least` of an item. texts: key, text; items: k, place, t."""

    @F.pandas_udf("words int, seeds array<long>")
    def seeds_of(texts: pd.Series) -> pd.DataFrame:
        words = [word_hashes(t or "") for t in texts]
        return pd.DataFrame({"words": [len(w) for w in words], "seeds": [running(w, tile).view(np.int64) for w in words]})

    items = staged(items.withColumn("made", seeds_of("t")), "items")
    seeds = staged(items.select("place", F.col("made.words").alias("words"), F.explode("made.seeds").alias("seed")).groupBy("place", "words", "seed").agg(F.count("*").alias("times")), "item-seeds")
    bits = min(MOST_BITS, max(SEED_BITS, (16 * seeds.count()).bit_length()))
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(seeds, bits))

    @F.pandas_udf("array<long>")
    def shared_seeds(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            mine = np.unique(running(word_hashes(text), tile))
            slot = mine >> np.uint64(64 - bits)
            return mine[(sent.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1].view(np.int64)

        return texts.map(one)

    mine = texts.select("key", shared_seeds("text").alias("seeds")).filter(F.size("seeds") > 0).groupBy("key").agg(F.first("seeds").alias("seeds"))
    mine = staged(mine.select("key", F.explode("seeds").alias("mine")), "text-seeds")
    hits = mine.join(seeds, F.col("mine") == F.col("seed")).groupBy("key", "place", "words").agg(F.sum("times").alias("hits")).filter(F.col("hits") * tile >= least * F.col("words"))
    hits = staged(hits.select("key", "place"), "hits")
    wanted = hits.select(F.col("key").alias("wanted")).distinct()
    said = staged(texts.join(wanted, F.col("key") == F.col("wanted"), "left_semi").groupBy("key").agg(F.first("text").alias("text")), "texts")
    pairs = hits.join(said, "key").join(items.select(F.col("place").alias("p"), "k", "t"), F.col("place") == F.col("p"))

    @F.pandas_udf("double")
    def covered(texts: pd.Series, passages: pd.Series) -> pd.Series:
        def one(text: str, passage: str) -> float:
            words, item = word_hashes(text), word_hashes(passage)
            return coverage(item, running(item, tile), words, running(words, tile), least, tile)

        return pd.Series([one(*x) for x in zip(texts, passages)], dtype="float64")

    shares = pairs.select("key", "k", covered("text", "t").alias("share")).filter((F.col("share") >= least) & (F.col("share") > 0))
    shares = staged(shares, "shares")
    top = staged(shares.groupBy("key").agg(F.max("share").alias("coverage"), F.count("*").alias("n")), "best")
    out = shares.join(top.select(F.col("key").alias("of"), "coverage", "n"), (F.col("key") == F.col("of")) & (F.col("share") == F.col("coverage")))
    out = staged(out.groupBy("key", "coverage", "n").agg(F.min("k").alias("item")), "judged")
    discard(mine, hits, said, seeds, items, shares, top)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", tile: int = TILE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """df with contaminated, coverage, item_id, n_items: the number of items of which the text covers `least`, and the one covered most (the
    smallest id of equals) with its share of covered words; 0, null and 0 where there is none.

    The ids of items may be of any type that has an order. Items with fewer than `tile` words match nothing; null texts count as empty; items without an id are skipped, and of items that share one each counts by itself. An empty
    benchmark contaminates nothing; an empty table gives no rows. Columns of df with the names of the new ones make way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("k"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size, n = items.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0)), F.count("*")).first()
    if size + n <= block:
        held = sorted(items.collect(), key=lambda r: (r.k, r.t))
        rows = _by_block(packed(df, text=text), held, least, tile)
        named = df.sparkSession.createDataFrame([(p, r.k) for p, r in enumerate(held)], f"place int, item {items.schema['k'].dataType.simpleString()}", verifySchema=False)
        rows = rows.join(F.broadcast(named), F.col("found.at") == F.col("place"), "left")
        n_items, best, item = F.col("found.n"), F.col("found.coverage"), F.col("item")
    else:
        key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
        judged = _by_tables(df.select(key.alias("key"), text.alias("text")), items.withColumn("place", F.monotonically_increasing_id()), least, tile)
        rows = packed(df, own=key).join(judged, F.col("own") == F.col("key"), "left")
        n_items, best, item = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("coverage", F.lit(0.0)), F.col("item")
    return unpacked(rows, n_items=n_items, coverage=F.round(best, 6), item_id=item, contaminated=n_items > 0)
