"""Near duplicates by SimHash and tiled exact comparison (operator 1).

A text's fingerprint has bit i if over half of the XXH64 values of its word shingles have it. Distinct fingerprints go to cells by their population counts,
one count for each of `blocks` equal parts of the 64 bits; a cell is cut by hash into tiles of about TILE fingerprints. Two fingerprints within
the radius have counts that differ by the radius at most, summed over the parts, so all other pairs of tiles are skipped. The pairs left
are compared whole, in numpy, by exclusive-or and bit counts. Finer blocks skip more and copy a tile to more partners: 4 leave about one
pair in a hundred and 41 partners; 8, for tables of billions of texts, one in some thousands and 145.

A tile pair yields a spanning forest of its links, never all pairs in a group, and the components of these links are those of all links.

near_copies() finds texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. That far apart, 64 bits don't tell copies from strangers, so it takes fingerprints
of WORDS * 64 bits, of the distinct shingles: at 0.8 about 39 of 256 bits differ (the angle of the sets), of unrelated texts 128. The tiles are of texts of like size, since sets that
similar have sizes within 0.8 of each other; all pairs of tiles within that, whose population counts allow it, are compared, and pairs within the radius are candidates, of which the exact similarity decides:

1. A tile pair yields a spanning forest of its candidates, the closest first; its links are verified.
2. Where verified links leave a candidate component in parts, tiles of its sets are compared, and all candidates between parts that no link has joined yet are verified on the spot. A tile pair yields a spanning forest
   of these links. So pairs of copies are never sent on one by one, and no link is lost that is within the radius: at a similarity of 0.8 that leaves out some 7 pairs in 100,000 (computed), at more far fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import roots
from quire.llm.shared import packed, staged, unpacked

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE, STEP, PIECE = 8192, 256, 1 << 20
SHIFT = 6  # bits for a population count in the key of a cell

COPY_SHINGLE, LEAST = 5, 0.8
WORDS, FIRST, WIDE = 4, 24, 60  # 64-bit words of a fingerprint; bits that may differ in the first one, and in all
SMALL, MORE = 8, 16  # sets of fewer shingles have coarse bits: so many more may differ
CELLS = 4  # cells of sizes for each factor of 1 / least
OPEN, OPEN_HASHES = 512, 200_000  # sets of a tile in the second step, and their shingles


def word_pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of data, split at ASCII white space, by pieces of about `size` bytes."""
    at = 0
    while at < len(data):
        stop = at + size
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield data[at:stop].split()
        at = stop


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, by pieces of the text; a shorter text is one shingle, a text without words has none."""
    import xxhash

    hashed, n, carried = xxhash.xxh64_intdigest, 0, []
    for words in word_pieces((text or "").encode().lower()):
        words = carried + words
        carried = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        begins = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        yield np.array([hashed(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
        n += 1
    if not n and carried:
        yield np.array([hashed(b" ".join(carried), SEED)], dtype="<u8")


def bit_sums(values: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64 bits; 0 for a text without words."""
    n, bits = 0, np.zeros(64, dtype=np.int64)
    for values in shingle_hashes(text, shingle):
        bits += bit_sums(values)
        n += len(values)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0]) if n else 0


def offsets(radius: int, blocks: int) -> list[int]:
    """Differences of the keys of two cells that may hold a link; of each pair of opposites the positive one, and 0."""
    near = [(0,) * blocks]
    for _ in range(radius):
        near = list({tuple(x + s * (j == i) for j, x in enumerate(v)) for v in near for i in range(blocks) for s in (-1, 0, 1)})
    return sorted(k for v in near if (k := sum(x << (SHIFT * i) for i, x in enumerate(v))) >= 0)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ. Of negative numbers bitwise_count would count the bits of the absolute value."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


class Forest:
    """A spanning forest of the links that are added, which come as places x, y; labels are those of its components."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The places, in x and y, of links that join components; of the links of a component the first one is taken each time."""
        n, taken, index = len(self.label), [], np.arange(len(x))
        while True:
            a, b = self.label[x[index]], self.label[y[index]]
            apart = a != b
            index, a, b = index[apart], a[apart], b[apart]
            if not len(index):
                return np.concatenate([*taken, np.zeros(0, dtype=np.int64)])
            ends, first = np.unique(np.stack((a, b), axis=1), return_index=True)
            best = np.unique(first // 2)
            taken.append(index[best])
            parent = np.arange(n)
            for p, q in zip(a[best].tolist(), b[best].tolist()):
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                parent[max(p, q)] = min(p, q)
            change = np.arange(n)
            for v in ends.tolist():
                root = v
                while parent[root] != root:
                    root = parent[root]
                change[v] = root
            self.label = change[self.label]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b, or within a if b is None."""
    values = a if b is None else np.concatenate((a, b))
    other, shift = (a, 0) if b is None else (b, len(a))
    made, grown = [], Forest(len(values))
    for i in range(0, len(a), STEP):
        x, y = np.nonzero(differing(a[i : i + STEP, None], other[None, :]) <= radius)
        x, y = x + i, y + shift
        new = grown.add(x, y)
        made += zip(values[x[new]].tolist(), values[y[new]].tolist())
    return made


def linked(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = 4) -> DataFrame:
    """fingerprints: distinct values fp. Pairs a, b of them whose components are those of all pairs within the radius."""
    width = 64 // blocks
    key = sum((F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)).cast("long") * (1 << (SHIFT * i)) for i in range(blocks)), F.lit(0).cast("long"))
    keyed = fingerprints.select("fp", key.alias("cell"))
    sizes = keyed.groupBy(F.col("cell").alias("sized")).agg(F.ceil(F.count("*") / TILE).alias("parts"))
    if (width + 1) ** blocks <= 100_000:  # cells at most
        sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    tiles = keyed.join(sizes, F.col("cell") == F.col("sized")).groupBy("cell", part.alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = staged(tiles, "tiles")
    left = tiles.select(F.col("cell").alias("ca"), F.col("part").alias("pa"), F.explode(F.array(*(F.lit(d).cast("long") for d in offsets(radius, blocks)))).alias("d"))
    right = tiles.select(F.col("cell").alias("cb"), F.col("part").alias("pb"))
    pairs = left.join(right, (F.col("ca") + F.col("d") == F.col("cb")) & ((F.col("d") > 0) | (F.col("pa") <= F.col("pb"))))
    full = tiles.select("cell", "part", "fps")
    pairs = pairs.join(full.toDF("ta", "ua", "a"), (F.col("ca") == F.col("ta")) & (F.col("pa") == F.col("ua")))
    pairs = pairs.join(full.toDF("tb", "ub", "b"), (F.col("cb") == F.col("tb")) & (F.col("pb") == F.col("ub")))
    same = (F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, one in zip(batch["a"], batch["b"], batch["same"]):
                found += forest(np.asarray(a), None if one else np.asarray(b), radius)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.select("a", "b", same.alias("same")).mapInPandas(compare, "a long, b long")


def _first(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("tag"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, radius: int = RADIUS, blocks: int = 4) -> DataFrame:
    """df, without the text unless keep_text, with fingerprint (16 hex digits), component_id and kept.

    A component is what links of `radius` or fewer differing bits reach; component_id is its smallest id, null if all its ids are null. kept is true
    for one row of each component, one with that id; of repeated rows with that id one is kept. A text without words, null included, has the fingerprint 0, which links like any
    other. An empty table gives no rows. Columns of df with the names of the new ones make way.
    """

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64")

    rows = packed(df, () if keep_text else (text_col,), fp=hashed(F.coalesce(F.col(text_col), F.lit(""))), id=F.col(id_col), tag=F.monotonically_increasing_id())
    rows = staged(rows, "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min(_first("id")).alias("first")), "classes")
    found = roots(linked(classes.select("fp"), radius, blocks))
    classes = classes.join(found, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("root", "fp").alias("top"))
    named = rows.join(_with_heads(classes, "fp"), F.col("fp") == F.col("of"))
    return unpacked(named, fingerprint=F.lower(F.lpad(F.hex("fp"), 16, "0")), component_id=F.col("head.id"), kept=F.col("tag") == F.col("head.tag"))


def _with_heads(classes: DataFrame, value: str) -> DataFrame:
    """of, head for each class (value, first, top): the least `first` of all classes with the same top."""
    heads = classes.groupBy(F.col("top").alias("t")).agg(F.min("first").alias("head"))
    return staged(classes.join(heads, F.col("top") == F.col("t")).select(F.col(value).alias("of"), "head"), "heads")


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The sorted set of the shingles' hashes."""
    parts = [np.unique(p) for p in shingle_hashes(text, shingle)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([*parts, np.zeros(0, dtype="<u8")]))


def wide_fingerprint(values: np.ndarray) -> list[int]:
    """WORDS signed 64-bit words: the majority of the bits of the values, and of mixtures of them."""
    out = []
    for k in range(WORDS):
        x = values
        if k:
            x = (x ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        out.append(int(np.packbits(2 * bit_sums(x) > len(x), bitorder="little").view("<i8")[0]))
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 64-bit values."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


Side = dict[str, np.ndarray]  # the columns of a tile: set, n, f0, f1, ...


def candidates(a: Side, b: Side | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x in a and y in b (in a, if b is None) of pairs within the radius, by strips of a, the closest first."""
    other = a if b is None else b
    for i in range(0, len(a["n"]), STEP):
        x, y = np.nonzero(differing(a["f0"][i : i + STEP, None], other["f0"][None, :]) <= FIRST)
        x += i
        if b is None:
            x, y = x[x < y], y[x < y]
        low, high = np.minimum(a["n"][x], other["n"][y]), np.maximum(a["n"][x], other["n"][y])
        ok = low >= least * high - 1e-9
        x, y, low = x[ok], y[ok], low[ok]
        far = sum(differing(a[f"f{k}"][x], other[f"f{k}"][y]).astype(np.int64) for k in range(WORDS))
        ok = (far <= WIDE + MORE * (low < SMALL)).nonzero()[0]
        ok = ok[np.argsort(far[ok], kind="stable")]
        yield x[ok], y[ok]


def closest(a: Side, b: Side | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the candidates, as sets of a and b."""
    shift = 0 if b is None else len(a["n"])
    values = a["set"] if b is None else np.concatenate((a["set"], b["set"]))
    grown = Forest(len(values))
    for x, y in candidates(a, b, least):
        new = grown.add(x, y + shift)
        yield values[x[new]], values[y[new] + shift]


def between(a: Side, b: Side | None, least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the verified links between different labels, as sets of a and b. A side has `data`, the shingles of its sets, too."""
    other = a if b is None else b
    sets = [np.frombuffer(d, dtype="<u8") for d in other["data"]]
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    _, label = np.unique(np.concatenate((a["label"], other["label"])), return_inverse=True)
    mine, theirs, joined = label[: len(a["n"])], label[len(a["n"]) :], Forest(len(label))
    for x, y in candidates(a, b, least):
        for i in np.unique(x[joined.label[mine[x]] != joined.label[theirs[y]]]).tolist():
            k = y[x == i]
            k = k[joined.label[theirs[k]] != joined.label[mine[i]]]
            if not len(k):
                continue
            own = np.frombuffer(a["data"][i], dtype="<u8")
            low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            many = high - low
            at = np.repeat(low - np.concatenate(([0], many.cumsum()[:-1])), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(sets))[k]
            k = k[both / (len(own) + other["n"][k] - both) >= least]
            for j in k[joined.add(np.full(len(k), mine[i]), theirs[k])].tolist():
                yield int(a["set"][i]), int(other["set"][j])


def _sides(batch: pd.DataFrame, names: list[str]) -> Iterator[tuple[Side, Side | None]]:
    for r in batch.to_dict("records"):
        a, b = ({n: np.asarray(r[f"{s}_{n}"]) for n in names} for s in "ab")
        yield a, None if r["same"] else b


def _near(classes: DataFrame, least: float) -> DataFrame:
    """classes: set, n, f0, ... Distinct pairs a < b: spanning forests of the candidates in all pairs of tiles that may hold one."""
    names = ["set", "n", *(f"f{k}" for k in range(WORDS))]
    cell = F.floor(F.log("n") / math.log(1 / least) * CELLS).cast("int")
    counts = sum(F.bit_count(f"f{k}") for k in range(WORDS))
    keyed = classes.select(*names, cell.alias("cell"), counts.alias("ones"))
    sizes = keyed.groupBy(F.col("cell").alias("sized")).agg(F.ceil(F.count("*") / TILE).alias("parts"))  # as many as there are factors of 1.06 in the longest text
    part = F.pmod(F.xxhash64("set"), F.col("parts"))
    tiles = keyed.join(F.broadcast(sizes), F.col("cell") == F.col("sized")).groupBy("cell", part.alias("part"))
    tiles = tiles.agg(F.collect_list(F.struct(*names)).alias("all"), F.min("ones").alias("low"), F.max("ones").alias("high"))
    tiles = staged(tiles.select("cell", "part", "low", "high", *(F.col(f"all.{n}").cast("array<long>").alias(n) for n in names)), "tiles")
    left = tiles.select(F.col("cell").alias("ca"), F.col("part").alias("pa"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.lit(0), F.lit(CELLS))).alias("d"))
    right = tiles.select(F.col("cell").alias("cb"), F.col("part").alias("pb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    may = (F.col("la") - F.col("hb") <= WIDE + MORE) & (F.col("lb") - F.col("ha") <= WIDE + MORE)
    pairs = left.join(right, (F.col("ca") + F.col("d") == F.col("cb")) & ((F.col("d") > 0) | (F.col("pa") <= F.col("pb"))) & may)
    full = tiles.select("cell", "part", F.struct(*names).alias("side"))
    pairs = pairs.join(full.toDF("ta", "ua", "a"), (F.col("ca") == F.col("ta")) & (F.col("pa") == F.col("ua")))
    pairs = pairs.join(full.toDF("tb", "ub", "b"), (F.col("cb") == F.col("tb")) & (F.col("pb") == F.col("ub")))
    same = (F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb"))
    flat = pairs.select(*(F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in "ab" for n in names), same.alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _sides(batch, names):
                for x, y in closest(a, b, least):
                    if len(x):
                        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return flat.mapInPandas(compare, "a long, b long").distinct()


def _sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """c, data: the shingles of the classes w."""

    @F.pandas_udf("binary")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, shingle).tobytes())

    of = classes.join(wanted, F.col("set") == F.col("w"), "left_semi").select(F.col("set").alias("c"), F.col("first.tag").alias("t"))
    texts = rows.select("tag", F.col("row").getField(text_col).alias("text")).join(of, F.col("tag") == F.col("t"))
    return staged(texts.select("c", read(F.coalesce(F.col("text"), F.lit(""))).alias("data")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs whose sets are similar enough."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[similarity(x, y) >= least for x, y in zip(batch["x"], batch["y"])], ["a", "b"]]

    both = pairs.join(sets.toDF("ca", "x"), F.col("a") == F.col("ca")).join(sets.toDF("cb", "y"), F.col("b") == F.col("cb"))
    return staged(both.select("a", "b", "x", "y").mapInPandas(compared, "a long, b long"), "links")


def _between(classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """classes: set, n, f0, ..., label, whole. Links a, b between classes of the same `whole` with different labels: spanning forests of each pair of tiles."""
    names = ["set", "n", "label", *(f"f{k}" for k in range(WORDS)), "data"]
    by_whole = classes.groupBy(F.col("whole").alias("w")).agg(F.greatest(F.ceil(F.count("*") / OPEN), F.ceil(F.sum("n") / OPEN_HASHES)).alias("parts"))
    by_label = classes.groupBy(F.col("label").alias("l")).agg(F.greatest(F.ceil(F.count("*") / OPEN), F.ceil(F.sum("n") / OPEN_HASHES)).alias("pieces"))
    dealt = classes.join(staged(by_whole, "wholes"), F.col("whole") == F.col("w")).join(staged(by_label, "labels"), F.col("label") == F.col("l"))
    tile = F.concat_ws("/", F.col("whole"), F.pmod(F.xxhash64("label"), F.col("parts")), F.pmod(F.xxhash64("set"), F.col("pieces")))
    dealt = dealt.withColumn("tile", tile).join(sets, F.col("set") == F.col("c"))
    tiles = dealt.groupBy("whole", "tile").agg(F.collect_list(F.struct(*names)).alias("all"), F.min("label").alias("low"), F.max("label").alias("high"))
    tiles = staged(tiles.select("whole", "tile", "low", "high", *(F.col(f"all.{n}").alias(n) for n in names)), "tiles")
    left = tiles.select(F.col("whole").alias("wa"), F.col("tile").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"))
    right = tiles.select(F.col("whole").alias("wb"), F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    pairs = left.join(right, (F.col("wa") == F.col("wb")) & (F.col("ta") <= F.col("tb")) & ~((F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")) & (F.col("la") == F.col("lb"))))
    full = tiles.select("tile", F.struct(*names).alias("side"))
    pairs = pairs.select("ta", "tb").join(full.toDF("ua", "a"), F.col("ta") == F.col("ua")).join(full.toDF("ub", "b"), F.col("tb") == F.col("ub"))
    flat = pairs.select(*(F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in "ab" for n in names), (F.col("ta") == F.col("tb")).alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pair for a, b in _sides(batch, names) for pair in between(a, b, least)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return staged(flat.mapInPandas(compare, "a long, b long"), "links")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, least: float = LEAST) -> DataFrame:
    """df with component_id and kept.

    A component is what links of `least` similarity reach; component_id is its smallest id, null if all its ids are null. kept is true for one row of each component, one
    with that id; of repeated rows with that id one is kept. Texts without words, null included, are alike. An empty table gives no rows. Columns of df with the names of the new ones make way.
    """

    @F.pandas_udf("set long, n long, " + ", ".join(f"f{k} long" for k in range(WORDS)))
    def sketched(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        sets = [shingle_set(t, shingle) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        words = zip(*(wide_fingerprint(s) for s in sets))
        return pd.DataFrame({"set": names, "n": [len(s) for s in sets], **{f"f{k}": w for k, w in enumerate(words)}})

    rows = staged(packed(df, sketch=sketched(F.coalesce(F.col(text_col), F.lit(""))), id=F.col(id_col), tag=F.monotonically_increasing_id()), "sketches")
    classes = rows.groupBy(F.col("sketch.set").alias("set")).agg(F.min(_first("id")).alias("first"), F.min("sketch").alias("sketch"))
    classes = staged(classes.select("set", "first", *(F.col(f"sketch.{c}").alias(c) for c in ("n", *(f"f{k}" for k in range(WORDS))))), "classes")
    near = staged(_near(classes.filter("n > 0"), least), "candidates")
    touched = staged(near.select(F.col("a").alias("w")).union(near.select("b")).distinct(), "touched")
    sets = _sets(touched, classes, rows, text_col, shingle)
    links = _verified(near, sets, least)
    parts, wholes = staged(roots(links), "parts").toDF("pu", "label"), staged(roots(near), "wholes").toDF("wu", "whole")
    named = touched.join(parts, F.col("w") == F.col("pu"), "left").join(wholes, F.col("w") == F.col("wu"), "left").select("w", F.coalesce("label", "w").alias("label"), F.coalesce("whole", "w").alias("whole"))
    named = staged(named, "named")
    broken = staged(named.groupBy(F.col("whole").alias("in")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("in"), "broken")
    named = named.join(broken, F.col("whole") == F.col("in"), "left_semi")
    links = links.unionByName(_between(classes.drop("first").join(named, F.col("set") == F.col("w")).drop("w"), sets, least))

    found = roots(links)
    tops = classes.join(found, F.col("set") == F.col("u"), "left").select("set", "first", F.coalesce("root", "set").alias("top"))
    out = rows.join(_with_heads(tops, "set"), F.col("sketch.set") == F.col("of"))
    return unpacked(out, component_id=F.col("head.id"), kept=F.col("tag") == F.col("head.tag"))
