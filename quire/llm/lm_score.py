"""Masked pseudo-likelihood scores of documents (operator 3).

Tokens are words and punctuation marks in lower case. A network reads the two words on each side of a place, through one table of embeddings and a matrix for each of the four
places, and predicts the word between: the hidden layer gives the probabilities of CLASSES classes, and within the class those of its words. The most frequent words of the corpus, some four thousand,
have embeddings and output weights of their own; the others share those of their ending, BINS bins by a hash of their last two characters, and a word within its bin follows its
share of the bin's tokens in the corpus. The sum of log P(word | words on both sides) over all tokens scores a document.

A text is tokenised once: its words as 32-bit codes (24 bits of a hash, and the ending's bin in the last 8) are written to the shared folder. All counts are of the whole corpus. The network trains in numpy on
the executors: in each round every task masks a part of its tokens, other ones in each round, takes gradient steps (Adagrad) from the common weights, and sends its weights; their mean, by numbers of masked
tokens and summed up in two steps, is the next round's start. The rounds' parts make up the whole corpus: each place of each document is predicted once in training. Work and traffic follow the size of the corpus.

The driver holds the vocabulary, the weights (some 1.2 MB) and the counts of rare words, which share SLOTS slots at most (16 MB) by their hash once there are more of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.decontam import text_pieces
from quire.llm.shared import discard, packed, staged, unpacked

KNOWN, BINS, CLASSES, SLOTS = 4096, 256, 64, 1 << 22
AROUND = (-2, -1, 1, 2)
HIDDEN, ROUNDS, SHARE, BATCH, RATE, START, SEED = 32, 2, 8, 8192, 0.1, 0.01, 42
CACHE, CHUNK, PIECES, GROUPS = 300_000, 1 << 14, 32, 64  # words held; tokens of a piece of work; pieces of the weights, groups of tasks that are summed up
STEPS_OF_2 = 16
NEAR = 2048  # rows of a softmax at a time, which stay in the cache
RUN, RUNS = 8, 1024  # rows of a number that are summed up side by side; such runs at a time

AT_ONCE = 1 << 20  # characters that are cut at once

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SPACE, _WORD, _SIGN = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)  # 0: bytes of other characters
_KINDS[:128] = [_SPACE if chr(c).isspace() else _WORD if chr(c).isalnum() or chr(c) == "_" else _SIGN for c in range(128)]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        ending = word[-2:] if word.isascii() else word.decode()[-2:].encode()
        self[word] = code = (xxhash.xxh64_intdigest(word) >> 40) << 8 | zlib.crc32(ending) % BINS
        return code


_codes = _Codes()


def codes_of(text: str | None) -> np.ndarray:
    return codes_of_texts([text])[0]


def codes_of_texts(texts: list[str | None]) -> list[np.ndarray]:
    out, held, size = [[np.zeros(0, dtype=np.uint32)] for _ in texts], [], 0

    def flush() -> None:
        for (k, _), codes in zip(held, _codes_of_pieces([piece for _, piece in held])):
            out[k].append(codes)

    for k, text in enumerate(texts):
        for piece in text_pieces(text or ""):
            held.append((k, piece))
            size += len(piece)
            if size >= AT_ONCE:
                flush()
                held, size = [], 0
    if held:
        flush()
    return [np.concatenate(parts) for parts in out]


def _codes_of_pieces(pieces: list[str]) -> list[np.ndarray]:
    """Cut by kinds of bytes, and each distinct word of the pieces looked up once; pieces with characters beyond ASCII and the letters up to U+017F are cut by the pattern."""
    raw = [p.lower().encode() for p in pieces]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _KINDS.take(data)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] & 0xDF != 0x97)]  # the signs of times and division are no letters
    kind[lead] = kind[lead + 1] = _WORD
    others = np.unique(np.searchsorted(ends, np.flatnonzero(kind == 0), side="right")).tolist()
    for k in others:
        kind[ends[k] - len(raw[k]) - 1 : ends[k]] = _SPACE
    word, begins = kind == _WORD, kind == _SIGN
    begins[0] |= word[0]
    begins[1:] |= word[1:] & ~word[:-1]
    at, solid = np.flatnonzero(begins), kind != _SPACE
    said = np.cumsum(solid, dtype=np.int32)
    offsets = np.append(said[at] - 1, said[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = np.fromiter(map(_codes.__getitem__, distinct), np.uint32, len(distinct)).take(words.indices.to_numpy())
    out = np.split(codes, np.searchsorted(at, ends[:-1]))
    for k in others:
        out[k] = np.array([_codes[t.encode()] for t in _TOKEN.findall(raw[k].decode())], dtype=np.uint32)
    return out


def stored(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint32)


class Vocabulary:
    """Outcomes are places in CLASSES classes of `width` words or bins; ids count them through, the last id is the edge of a text."""

    def __init__(self, words: list[tuple[int, int]], mass: np.ndarray, rare: np.ndarray) -> None:
        """words: (code, n) of those known by name; mass: tokens of each bin's other words; rare: how many of them fall on each slot, bin by bin."""
        n = np.concatenate((np.array([w[1] for w in words], dtype=np.float64), mass))
        order = np.lexsort((np.arange(len(n)), -n))
        self.width = -(-len(n) // CLASSES)
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n))
        place = rank % CLASSES * self.width + rank // CLASSES
        codes = np.array([w[0] for w in words], dtype=np.uint32)
        self.known, self.known_ids, self.bin_ids = np.sort(codes), place[: len(words)][np.argsort(codes)], place[len(words) :]
        first = np.searchsorted(self.known, np.arange((1 << 16) + 1, dtype=np.uint64) << 16)  # of the words whose codes begin with these 16 bits
        self.first, self.several = np.minimum(first[:-1], max(0, len(words) - 1)).astype(np.int32), np.diff(first) > 1
        self.edge = CLASSES * self.width
        self.counts = np.zeros(self.edge)
        self.counts[place] = n + 0.5
        self.slots = len(rare) // BINS
        self.rare = np.log((rare.reshape(BINS, -1) + 0.5) / (mass[:, None] + 0.5 * self.slots)).reshape(-1).astype(np.float32)

    @classmethod
    def of(cls, counts: DataFrame, known: int = KNOWN, slots: int = SLOTS) -> Vocabulary:
        """counts: code, n. Words are known from the lowest frequency on at which they are no more than `known`, in steps of 2^(1/STEPS_OF_2)."""
        step = F.floor(F.log2("n") * STEPS_OF_2).cast("int")
        steps, least, n = counts.groupBy(step.alias("s")).count().collect(), 1 << 30, 0
        for r in sorted(steps, key=lambda r: -r.s):
            n += r["count"]
            if n > known:
                break
            least = r.s
        top = sorted(((r.code, r.n) for r in counts.filter(step >= least).collect()), key=lambda w: (-w[1], w[0]))
        others = counts.filter(step < least).select(F.pmod("code", F.lit(BINS)).cast("int").alias("bin"), F.shiftrightunsigned("code", 8).alias("hash"), "n")
        kinds = sum(r["count"] for r in steps if r.s < least)
        each = max(16, min(slots, 1 << (2 * kinds).bit_length()) // BINS)
        rare = np.zeros(BINS * each, dtype=np.float32)
        found = others.groupBy((F.col("bin") * each + F.pmod("hash", F.lit(each))).cast("int").alias("slot")).agg(F.sum("n").alias("n")).toArrow()
        rare[found["slot"].to_numpy()] = found["n"].to_numpy()
        return cls(top, rare.reshape(BINS, -1).sum(1, dtype=np.float64), rare)

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and which are not known by name."""
        if not len(self.known):
            return self.bin_ids[codes & (BINS - 1)], np.ones(len(codes), dtype=bool)
        head = codes >> 16
        at = self.first.take(head)
        other = self.known.take(at) != codes
        rest = np.flatnonzero(other & self.several.take(head))
        at[rest] = np.minimum(np.searchsorted(self.known, codes[rest]), len(self.known) - 1)
        other[rest] = self.known[at[rest]] != codes[rest]
        return np.where(other, self.bin_ids.take(codes & (BINS - 1)), self.known_ids.take(at)), other

    def within_bin(self, codes: np.ndarray) -> np.ndarray:
        """log P(word | its bin)."""
        return self.rare[(codes & (BINS - 1)).astype(np.int64) * self.slots + (codes >> 8) % self.slots]


def chunks(texts: list[np.ndarray], size: int = CHUNK) -> Iterator[list[int]]:
    """Places of neighbouring texts that have about `size` words together."""
    held, n = [], 0
    for k, t in enumerate(texts):
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(k)
        n += len(t)
    if held:
        yield held


def windows(texts: list[np.ndarray], edge: int, here: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, or of those at the places `here`, and, a row a place around them, of their neighbours."""
    pad = np.full(2, edge, dtype=np.int64)
    line = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
    at = np.flatnonzero(line != edge)
    if here is not None:
        at = at[here]
    return line[at], np.stack([line.take(at + o) for o in AROUND])


class Network:
    """The weights: embeddings e, a matrix t for each place, bias b, classes c and words u with their biases."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def start(cls, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = SEED) -> Network:
        """Without context: the biases are the logarithms of the counts, so it begins as a model of single words."""
        rng, width = np.random.default_rng(seed), vocabulary.width
        counts = vocabulary.counts.reshape(CLASSES, width)
        with np.errstate(divide="ignore"):
            bias = np.where(counts > 0, np.log(counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)), -40.0)  # places without a word
        new = {
            "e": rng.normal(0, 0.3, (vocabulary.edge + 1, hidden)), "t": rng.normal(0, hidden**-0.5, (len(AROUND), hidden, hidden)), "b": np.zeros(hidden),
            "c": np.zeros((hidden, CLASSES)), "cb": np.log(np.maximum(counts.sum(1), 1e-9) / max(1e-9, counts.sum())), "u": np.zeros((CLASSES, width, hidden)), "ub": bias,
        }
        return cls({k: v.astype(np.float32) for k, v in new.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.w.values()])

    def of(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([v.size for v in self.w.values()])[:-1]
        return Network({k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(self.w.items(), np.split(flat, ends))})

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What places are predicted by: the embeddings times each place's matrix, and the weights of classes and of words with the biases as a last row."""
        return _placed(self.w["e"], self.w), *self._biased()

    def _biased(self) -> tuple[np.ndarray, np.ndarray]:
        c, u = np.concatenate((self.w["c"], self.w["cb"][None])), np.empty((CLASSES, len(self.w["b"]) + 1, self.w["u"].shape[1]), self.w["u"].dtype)
        u[:, :-1], u[:, -1] = self.w["u"].transpose(0, 2, 1), self.w["ub"]
        return c, u

    def log_probability(self, y: np.ndarray, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log P(y | x) for ids y and their neighbours x."""
        rows, c, u = tables
        kind, of, order, groups = _by_class(y, u.shape[2])
        h = _hidden(rows, x.T.take(order, axis=1) * len(AROUND))
        logs, logs_within = np.empty_like(h[:, 0]), np.empty_like(h[:, 0])
        for i in range(0, len(y), NEAR):
            part = slice(i, i + NEAR)
            _log_of(h[part] @ c, kind[part], logs[part])
        for group in groups:
            part = slice(group[0][1], group[-1][2])
            _log_of(_within(h, u, group), of[part], logs_within[part])
        out = np.empty_like(logs)
        out[order] = logs + logs_within
        return out

    def gradient(self, y: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of -log P summed over the examples, by weight; that of e is of the rows that come second."""
        w = self.w
        c, u = self._biased()
        kind, of, order, groups = _by_class(y, u.shape[2])
        ids = np.flatnonzero(np.bincount(x.reshape(-1)))
        number = np.zeros(len(w["e"]), dtype=np.uint16 if len(ids) * len(AROUND) <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
        number[ids] = np.arange(len(ids)) * len(AROUND)
        near, e = number.take(x.T.take(order, axis=1)), w["e"][ids]
        rows, sides = _placed(e, w), _sides(w)
        h1 = _hidden(rows, near.astype(np.intp))
        h = np.ascontiguousarray(h1[:, :-1])
        back = np.empty_like(h)
        g, down = {k: np.zeros_like(w[k]) for k in ("cb", "u", "ub")}, np.ascontiguousarray(w["c"].T)
        by_class = np.zeros_like(down)
        for i in range(0, len(y), NEAR):
            part = slice(i, i + NEAR)
            p = _error(h1[part] @ c, kind[part])
            by_class += p.T @ h[part]
            g["cb"] += np.ones(len(p), dtype=p.dtype) @ p
            np.matmul(p, down, out=back[part])
        for group in groups:
            i, j = group[0][1], group[-1][2]
            p, more, ones = _error(_within(h1, u, group), of[i:j]), np.empty_like(h[i:j]), np.ones(j - i, dtype=h.dtype)
            for k, a, b in group:
                mine = p[a - i : b - i]
                np.matmul(mine.T, h[a:b], out=g["u"][k])
                np.matmul(ones[: b - a], mine, out=g["ub"][k])
                np.matmul(mine, w["u"][k], out=more[a - i : b - i])
            back[i:j] += more
        h *= h
        back *= np.subtract(1, h, out=h)
        near += np.arange(len(AROUND), dtype=near.dtype)[:, None]
        sums = _summed(near.reshape(-1), back, len(rows)).reshape(len(ids), -1)  # by id and place, so the matrices multiply a row for each id and not for each place
        g["c"], g["b"], g["e"] = by_class.T, np.ones(len(back), dtype=back.dtype) @ back, sums @ sides.T
        g["t"] = (e.T @ sums).reshape(len(w["b"]), len(AROUND), -1).transpose(1, 0, 2)
        return g, ids


def _sides(w: dict[str, np.ndarray]) -> np.ndarray:
    """The matrices of the places beside each other."""
    return w["t"].transpose(1, 0, 2).reshape(len(w["b"]), -1)


def _placed(e: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Embeddings times each place's matrix, a row for each id and place; those of the first place have the bias."""
    made = e @ _sides(w)
    made[:, : len(w["b"])] += w["b"]
    return made.reshape(-1, len(w["b"]))


def _hidden(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hidden layer from the neighbours' first rows, with a last column of ones for the biases."""
    n, h = x.shape[1], np.ones((x.shape[1], rows.shape[1] + 1), rows.dtype)
    for i in range(0, n, NEAR):
        part = x[:, i : i + NEAR]
        z = rows.take(part[0], axis=0)
        for o in range(1, len(AROUND)):
            z += rows.take(part[o] + o, axis=0)
        np.tanh(z, out=h[i : i + NEAR, :-1])
    return h


def _within(h: np.ndarray, u: np.ndarray, group: list[tuple[int, int, int]]) -> np.ndarray:
    """The logits of words of the classes of a group."""
    i, z = group[0][1], np.empty((group[-1][2] - group[0][1], u.shape[2]), h.dtype)
    for k, a, b in group:
        np.matmul(h[a:b], u[k], out=z[a - i : b - i])
    return z


def _log_of(z: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """The logarithm of the softmax at one column of each row. The biases are those of probabilities, so exp() has room."""
    out[:] = z.reshape(-1).take(np.arange(len(z)) * z.shape[1] + at)
    out -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=z.dtype))


def _error(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax less 1 at one column of each row."""
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], dtype=z.dtype)))[:, None]
    z.reshape(-1)[np.arange(len(z)) * z.shape[1] + at] -= 1
    return z


def _summed(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of rows by the numbers `of` them, which are below n; `of` goes through the rows again and again. Runs of at most RUN rows of one number are summed up side by side, then the runs of numbers with more of them."""
    order, size = np.argsort(of, kind="stable"), np.bincount(of, minlength=n)
    order %= len(rows)
    runs = (size + RUN - 1) // RUN
    ends = runs.cumsum()
    number = np.repeat(np.arange(n), runs)
    past = (np.arange(len(number)) - (ends - runs)[number]) * RUN
    length = np.minimum(size[number] - past, RUN).astype(np.int8)
    by = np.argsort(-length, kind="stable")
    at, longer = ((size.cumsum() - size)[number] + past)[by], len(number) - np.bincount(length, minlength=RUN + 1).cumsum()
    part, more = np.empty((len(by), rows.shape[1]), rows.dtype), np.empty((RUNS, rows.shape[1]), rows.dtype)
    for i in range(0, len(by), RUNS):  # slices that stay in the cache
        here = part[i : i + RUNS]
        rows.take(order.take(at[i : i + RUNS]), axis=0, out=here, mode="clip")
        for k in range(1, RUN):
            n_here = max(0, min(longer[k] - i, RUNS))
            here[:n_here] += rows.take(order.take(at[i : i + n_here] + k), axis=0, out=more[:n_here], mode="clip")
    place = np.empty(len(by), dtype=np.intp)
    place[by] = np.arange(len(by))
    out, one, more = np.zeros((n, rows.shape[1]), rows.dtype), np.flatnonzero(runs == 1), np.flatnonzero(runs > 1)
    out[one] = part.take(place[ends[one] - 1], axis=0)
    if len(more):
        out[more] = np.add.reduceat(part.take(place[runs[number] > 1], axis=0), runs[more].cumsum() - runs[more])
    return out


def _by_class(y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """Classes and places within them in the order by class, that order, and groups of classes of some NEAR examples: where each class begins and ends."""
    kind = y // width
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    ends = np.concatenate(([0], np.bincount(kind, minlength=CLASSES).cumsum())).tolist()
    kind, groups = kind.take(order), []
    for k in range(CLASSES):
        if ends[k + 1] > ends[k]:
            if not groups or ends[k + 1] - groups[-1][0][1] > NEAR:
                groups.append([])
            groups[-1].append((k, ends[k], ends[k + 1]))
    return kind, y.take(order) - kind * width, order, groups


class Trainer:
    """Adagrad steps on a network's own copy of the weights."""

    def __init__(self, network: Network, rate: float = RATE) -> None:
        self.network, self.rate, self.n = Network({k: v.copy() for k, v in network.w.items()}), rate, 0
        self.sums = {k: np.full_like(v, START) for k, v in network.w.items()}

    def step(self, y: np.ndarray, x: np.ndarray) -> None:
        self.n += len(y)
        grad, rows = self.network.gradient(y, x)
        for k, g in grad.items():
            w, sums = self.network.w[k], self.sums[k][rows] if k == "e" else self.sums[k]
            sums += g * g
            g = g * self.rate
            g /= np.sqrt(sums)
            if k == "e":
                self.sums[k][rows] = sums
                w[rows] -= g
            else:
                w -= g


def masked(codes: np.ndarray, round_: int, rounds: int = SHARE, lengths: np.ndarray | None = None) -> np.ndarray:
    """The places that a round predicts, by a hash of the place and the words there and before, of one text or of texts of these lengths. SHARE parts are dealt out to the rounds, so that each place is in one of them; rounds beyond SHARE begin anew."""
    place, before = np.arange(len(codes), dtype=np.uint32), np.zeros(len(codes), dtype=np.uint32)
    before[1:] = codes[:-1] >> 7
    if lengths is not None:
        first = lengths.cumsum() - lengths
        before[first[lengths > 0]] = 0
        place -= np.repeat(first, lengths).astype(np.uint32)
    mixed = (codes ^ place) + before
    mixed = (mixed ^ (mixed >> 15)) * np.uint32(0x9E3779B1)
    parts = min(rounds, SHARE)
    return (mixed >> 16) % SHARE % parts == round_ % parts


def _round(tokens: DataFrame, vocabulary, network, round_: int, rounds: int) -> tuple[np.ndarray | None, int]:
    """The mean of the weights of all tasks after their steps, None if there is no token; and how many places they predicted."""

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        trainer, task, v = Trainer(network.value), TaskContext.get().partitionId(), vocabulary.value
        rng, kept = np.random.default_rng((SEED, round_, task)), (np.zeros(0, dtype=np.int64), np.zeros((len(AROUND), 0), dtype=np.int64))
        for batch in batches:
            texts = [stored(t) for t in batch["codes"]]
            for some in chunks(texts):
                codes, lengths = np.concatenate([texts[k] for k in some]), np.array([len(texts[k]) for k in some])
                here = masked(codes, round_, rounds, lengths).nonzero()[0]
                rng.shuffle(here)
                y, x = windows(np.split(v.ids(codes)[0], lengths.cumsum()[:-1]), v.edge, here)
                y, x = np.concatenate((kept[0], y)), np.concatenate((kept[1], x), axis=1)
                whole = len(y) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    trainer.step(y[i : i + BATCH], x[:, i : i + BATCH].T)
                kept = y[whole:], x[:, whole:]
        if len(kept[0]):
            trainer.step(kept[0], kept[1].T)
        if trainer.n:
            parts = np.array_split(trainer.network.flat().astype(np.float64) * trainer.n, PIECES)
            yield pd.DataFrame({"piece": range(PIECES), "group": task % GROUPS, "n": trainer.n, "sums": [p.astype(np.float32).tobytes() for p in parts]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, dtype=np.float32).astype(np.float64) for s in part["sums"])
        return pd.DataFrame({"piece": [part["piece"].iloc[0]], "group": [part["group"].iloc[0]], "n": [part["n"].sum()], "sums": [total.astype(np.float32).tobytes()]})

    schema = "piece int, group int, n long, sums binary"
    sent = tokens.select("codes").mapInPandas(trained, schema).groupBy("piece", "group").applyInPandas(summed, schema)
    sent = sent.withColumn("group", F.lit(0)).groupBy("piece").applyInPandas(summed, schema)
    rows = sorted(sent.collect(), key=lambda r: r.piece)  # one set of weights
    return (np.concatenate([np.frombuffer(r.sums, dtype=np.float32).astype(np.float64) / r.n for r in rows]) if rows else None), max((r.n for r in rows), default=0)


class Model:
    """A vocabulary and a network, and how many places it was trained on."""

    def __init__(self, vocabulary: Vocabulary, network: Network, trained: int = 0) -> None:
        self.vocabulary, self.network, self.tables, self.trained = vocabulary, network, network.tables(), trained

    def score_codes(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sums of log P over the texts."""
        out = np.zeros(len(texts))
        for some in chunks(texts):
            codes = np.concatenate([texts[k] for k in some])
            ids, other = self.vocabulary.ids(codes)
            lengths = np.array([len(texts[k]) for k in some])
            y, x = windows(np.split(ids, lengths.cumsum()[:-1]), self.vocabulary.edge)
            logs = np.concatenate([self.network.log_probability(y[i : i + CHUNK], x[:, i : i + CHUNK].T, self.tables).astype(np.float64) for i in range(0, len(y), CHUNK)] or [np.zeros(0)])
            logs[other] += self.vocabulary.within_bin(codes[other])
            out[some] = np.bincount(np.repeat(np.arange(len(some)), lengths), weights=logs, minlength=len(some))
        return out

    def score(self, text: str | None) -> tuple[int, float]:
        codes = codes_of(text)
        return len(codes), float(self.score_codes([codes])[0])


def tokenised(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """row (the columns of df) and codes, written to the shared folder."""

    @F.pandas_udf("binary")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([codes.tobytes() for codes in codes_of_texts(texts.tolist())], dtype=object)

    return staged(packed(df, () if keep_text else (text_col,), codes=read(F.coalesce(F.col(text_col), F.lit("")))), "tokens")


def word_counts(tokens: DataFrame) -> DataFrame:
    """code, n over all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code, n = np.unique(stored(b"".join(batch["codes"])), return_counts=True)
            yield pd.DataFrame({"code": code.astype(np.int64), "n": n})

    return tokens.select("codes").mapInPandas(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit(tokens: DataFrame, rounds: int = ROUNDS) -> Model:
    """From all texts of a table that tokenised() gives. An empty one gives a model of unseen words alone."""
    context = tokens.sparkSession.sparkContext
    counts = staged(word_counts(tokens), "words")
    vocabulary = Vocabulary.of(counts)
    discard(counts)
    network, sent, trained = Network.start(vocabulary), context.broadcast(vocabulary), 0
    for k in range(rounds):
        now = context.broadcast(network)
        mean, n = _round(tokens, sent, now, k, rounds)
        now.destroy()
        if mean is not None:  # a few words may all fall to another round
            network, trained = network.of(mean), trained + n
    sent.destroy()
    return Model(vocabulary, network, trained)


def scored(df: DataFrame, text_col: str = "text", keep_text: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """df, without the text unless keep_text, with n_tokens, log_probability (the sum) and mean_log_probability, by a model of all its texts. A text without tokens, null included, has 0, 0 and null. An
    empty table gives no rows. Columns of df with the names of the new ones make way."""
    tokens = tokenised(df, text_col, keep_text)
    return scored_tokens(tokens, fit(tokens, rounds))


def scored_tokens(tokens: DataFrame, model: Model) -> DataFrame:
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score_codes([stored(t) for t in texts]))

    rows = tokens.select("row", (F.octet_length("codes") / 4).cast("long").alias("n"), score("codes").alias("total"))
    return unpacked(rows, n_tokens=F.col("n"), log_probability=F.col("total"), mean_log_probability=F.when(F.col("n") > 0, F.col("total") / F.col("n")))
