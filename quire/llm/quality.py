"""Quality classifier: a sparse rule ensemble (operator 2).

Statistics of a text, of which only the logarithm of the number of words hangs on its length, feed shallow regression trees, boosted on random halves of the rows and statistics. Each path from
a root to a node is a rule, a conjunction of comparisons. A logistic regression with a lasso penalty, fitted by accelerated proximal
gradient steps, gives most rules the weight 0; the others are compiled into one Spark column expression over the statistics.

The fit runs on the driver, over a sample of labelled rows of at most `sample` (20,000) rows; scoring covers all rows.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import packed, unpacked
from quire.llm.simhash import word_pieces

STATS = ("log_words", "word_length", "upper", "symbols", "exclaims", "bars", "digits", "stops", "distinct", "repeats", "breaks", "word_ends", "short_words", "long_words")
SAMPLE, HELD_OUT, THRESHOLD = 20_000, 5, 0.3
TREES, DEPTH, BINS, RATE, LEAF = 40, 3, 32, 0.1, 4
PENALTIES, STEPS = (0.01, 0.003, 0.001), 400
WINDOW = 256  # words over which distinct words are counted

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_SYMBOL = b"#$%&*+<=>@[\\]^_`{|}~"


def statistics(text: str) -> list[float]:
    """STATS of a whole text; all 0 for a text without words. Shares are of words, but those of upper case (of ASCII letters), symbols and digits (of bytes)."""
    data = text.encode()
    size, lacks = max(1, len(data)), len
    upper, lower = (len(data) - lacks(data.translate(None, s)) for s in (_UPPER, _LOWER))
    symbols, digits = ((len(data) - lacks(data.translate(None, s))) / size for s in (_SYMBOL, _DIGIT))
    n = chars = distinct = repeats = ends = short = long = 0
    last = b""
    for words in word_pieces(data):
        if not words:
            continue
        n += len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars += int(lengths.sum())
        short += int((lengths <= 3).sum())
        long += int((lengths > 15).sum())
        repeats += sum(a == b for a, b in zip(words, words[1:])) + (words[0] == last)
        ends += sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
        distinct += sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW))
        last = words[-1]
    if not n:
        return [0.0] * len(STATS)
    per = [data.count(x) / n for x in (b"!", b"|")]
    return [float(np.log1p(n)), chars / n, upper / max(1, upper + lower), symbols, per[0], per[1], digits, data.count(b".") / n, distinct / n, repeats / n, data.count(b"\n") / n, ends / n, short / n, long / n]


def _stats(text: Column) -> Column:
    """STATS as a struct."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATS))

    return stats(text)


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, greater than the bound or else not, bound)


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for s, above, bound in rule:
        out &= (x[s] > bound) == above
    return out


def _grow(x: dict[str, np.ndarray], residual: np.ndarray, rows: np.ndarray, names: list[str], bounds: dict, path: Rule, out: list, depth: int) -> np.ndarray:
    """Adds the rules of a tree to `out`; returns the tree's value for the rows."""
    value = np.full(len(rows), residual[rows].mean())
    if depth == 0 or len(rows) < 2 * LEAF:
        return value
    best = (1e-9, None, 0.0)
    total, r = residual[rows].sum(), residual[rows]
    for s in names:
        cuts = bounds[s]
        at = np.searchsorted(cuts, x[s][rows], side="left")
        n, t = np.bincount(at, minlength=len(cuts) + 1).cumsum()[:-1], np.bincount(at, weights=r, minlength=len(cuts) + 1).cumsum()[:-1]
        ok = (n >= LEAF) & (len(rows) - n >= LEAF)
        gain = np.where(ok, t**2 / np.maximum(n, 1) + (total - t) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), s, float(cuts[gain.argmax()]))
    _, s, bound = best
    if s is None:
        return value
    for above in (False, True):
        side = (x[s][rows] > bound) == above
        longer = path + ((s, above, bound),)
        out.append(longer)
        value[side] = _grow(x, residual, rows[side], names, bounds, longer, out, depth - 1)
    return value


def paths_of_trees(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 42) -> list[Rule]:
    rng, score, found = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    bounds = {s: np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for s, v in x.items()}
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        names = [STATS[i] for i in sorted(rng.choice(len(STATS), len(STATS) // 2 + 1, replace=False))]
        made: list[Rule] = []
        residual = y - 1 / (1 + np.exp(-score))
        _grow(x, residual, rows, names, bounds, (), made, DEPTH)
        found += made
        step = np.zeros(len(y))
        for rule in made:  # the deepest rule that holds gives the value
            held = _holds(rule, x)
            step[held] = residual[held & np.isin(np.arange(len(y)), rows)].mean() if (held[rows]).any() else 0
        score += RATE * 4 * step
    return list(dict.fromkeys(found))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss plus penalty times the weights' absolute sum."""
    n, k = z.shape
    step = 4.0 / max(1e-9, np.linalg.norm(z.T @ z / n + np.outer(z.mean(0), z.mean(0)), 2) + 1)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(z @ pw + pb, -40, 40))) - y
        g = pw - step * (z.T @ error) / n
        new_w, new_b = np.sign(g) * np.maximum(np.abs(g) - step * penalty, 0), pb - step * error.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)


class RuleEnsemble:
    """Rules with weights, in the order of the size of the weight."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float) -> None:
        self.rules, self.intercept = sorted(rules, key=lambda r: (-abs(r[1]), r[0])), intercept

    @classmethod
    def fit(cls, x: dict[str, np.ndarray], y: np.ndarray, seed: int = 42) -> RuleEnsemble:
        """The penalty is the one with the least log loss on a fifth of the rows left out. With one class or no rows: no rule, the smoothed share of 1."""
        rules = paths_of_trees(x, y, seed) if len(y) >= 50 and y.min() < y.max() else []
        if not rules:
            p = (y.sum() + 1) / (len(y) + 2)
            return cls([], float(np.log(p / (1 - p))))
        z = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64)
        out = np.random.default_rng(seed).random(len(y)) < 0.2
        if out.all() or not out.any():
            out = np.arange(len(y)) % 5 == 0

        def loss(penalty: float) -> float:
            w, b = lasso_logistic(z[~out], y[~out], penalty)
            p = np.clip(1 / (1 + np.exp(-(z[out] @ w + b))), 1e-9, 1 - 1e-9)
            return float(-np.mean(y[out] * np.log(p) + (1 - y[out]) * np.log(1 - p)))

        w, b = lasso_logistic(z, y, min(PENALTIES, key=loss))
        return cls([(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6], b)

    def column(self, stats: str = "stats") -> Column:
        """The score as an expression over the struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for s, above, bound in rule:
                held = held & (F.col(f"{stats}.{s}") > bound if above else F.col(f"{stats}.{s}") <= bound)
            total = total + F.when(held, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def in_held_out(id_col: str) -> Column:
    """crc32 of the id as text is 0 mod 5; so is a null id, which is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def usable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id, y: the ids that may be learned from. Labels that are null, are held out or contradict each other count for nothing."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most"))
    return known.filter((F.col("y") == F.col("most")) & ~in_held_out("id")).select("id", "y")


def learned_from(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """id, y, text: of the first `sample` usable ids by a hash, the texts; of texts that share an id the first two by a hash. It's the same in any layout of the tables."""
    known = usable(labels, id_col, label_col)
    place, n = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)), known.count()
    if n > 4 * sample:  # the first by hash are among these, and tasks need not send `sample` rows each
        known = known.filter(place < int((1 << 30) * 4 * sample / n))
    known = known.orderBy(place, "id").limit(sample)
    found = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc") == F.col("id"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text"))
    return found.withColumn("nth", nth).filter("nth <= 2").select("id", "y", "text")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 42) -> RuleEnsemble:
    """labels: id_col, label_col (0 or 1). It learns from `sample` labels and 2 * sample texts at most, see learned_from()."""
    rows = learned_from(df, labels, id_col, text_col, label_col, sample, seed).select("id", "y", _stats(F.col("text")).alias("stats")).select("id", "y", "stats.*").toPandas()
    rows = rows.sort_values(["id", *STATS]).reset_index(drop=True)
    return RuleEnsemble.fit({s: rows[s].to_numpy(dtype=np.float64) for s in STATS}, rows["y"].to_numpy(dtype=np.float64), seed)


def scored(df: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold, else 0). A null text counts as empty; all its statistics are 0. An empty
    table gives no rows. Columns of df with the names of the new ones make way."""
    made = packed(df, stats=_stats(F.coalesce(F.col(text_col), F.lit("")))).select("row", model.column().alias("value"))
    return unpacked(made, score=F.col("value"), predicted=(F.col("value") >= threshold).cast("int"))
