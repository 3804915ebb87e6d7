"""Spelling variants: words at distance one by a trie self-join, and the form that each stands for (operator 13).

The vocabulary's trie is partitioned by prefix. A prefix with more words than one task should hold is split by the next code point; two words that part at that very place are then near if
nothing but equal text follows the one code point that differs, so they're joined by that rest, at most one word for each code point and rest. Smaller prefixes go to one task each, which
builds the trie below and walks down it with the pairs of active nodes: two nodes are active together while their strings are at distance one at most. As long as both are one node the distance is zero; where the paths part (one code point replaced, or one more on one side)
it is one, and from then on both go down by the same code point alone. Two ends of words that meet are a pair. Each pair parts at one place only, the end of its common prefix, so it comes once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import ascii_lower, discard, staged

RUN = "[A-Za-zÀ-ÿ]"
GROUP = 20_000  # words of a prefix that one task takes at once
_END = ""  # the key of a word's end in a node


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, typo_every: int | None = None) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z in lower case, that have `least_length` code points and come `least_n` times overall.

    With typo_every, a run whose crc32 of "id:run" it divides loses the code point at crc32 % length; what is left counts. Null texts have no runs, a null id is written as nothing. Counts are added up before they're shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    word = ascii_lower(F.col("run"))
    if typo_every:
        runs = runs.select(word.alias("run"), F.crc32(F.encode(F.concat("id", F.lit(":"), word), "UTF-8")).alias("h"))
        gap = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % typo_every == 0, F.concat(F.substring(F.col("run"), F.lit(1), gap), F.substring(F.col("run"), gap + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _trie(words: list[str], depth: int) -> dict:
    """Nested dicts by code point; a subtree of one word is that word."""
    root: dict = {}
    for word in words:
        node, at = root, depth
        while True:
            key = word[at : at + 1]
            other = node.get(key)
            if other is None:
                node[key] = word
                break
            if isinstance(other, str):  # two words: the node opens, as deep as they agree
                node[key] = other = {other[at + 1 : at + 2]: other}
            node, at = other, at + 1
    return root


def _children(node: dict | str, at: int) -> dict:
    return node if isinstance(node, dict) else {node[at : at + 1]: node}


def near_in(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs of distinct words at distance one that share their first `depth` code points and part no earlier."""
    nodes = [(_trie(words, depth), depth)]
    active: list[tuple] = []  # two nodes and their depths, at distance one
    while nodes:
        node, at = nodes.pop()
        kids = [(c, x) for c, x in node.items() if c != _END]
        for k, (c, x) in enumerate(kids):
            for _, y in kids[k + 1 :]:
                active.append((x, at + 1, y, at + 1))
            below = _children(x, at + 1)  # the words of x have c more
            for d, y in below.items():
                if d != c and d in node:
                    if d == _END:
                        yield node[d], y
                    else:
                        active.append((node[d], at + 1, y, at + 2))
            if isinstance(x, dict):
                nodes.append((x, at + 1))
        while active:
            x, i, y, j = active.pop()
            if isinstance(x, str) and isinstance(y, str):
                if x[i:] == y[j:]:
                    yield x, y
                continue
            few, many = _children(x, i), _children(y, j)
            for c in few if len(few) <= len(many) else many:
                if c in few and c in many:
                    if c == _END:
                        yield few[c], many[c]
                    else:
                        active.append((few[c], i + 1, many[c], j + 1))


def _parting_at(split: DataFrame, depth: int) -> DataFrame:
    """Pairs of words that share the first `depth` code points of split prefixes and differ in the one that follows."""
    from_here = lambda k: F.substring(F.col("word"), F.lit(depth + 1 + k), F.char_length("word"))
    one = split.select("prefix", "word", from_here(0).alias("whole"), from_here(1).alias("rest"), F.substring("word", depth + 1, 1).alias("c"))
    shorter = F.col("c") != F.substring(F.col("rest"), 1, 1)  # else the two part further down
    a = one.select("prefix", F.explode(F.array(F.struct(F.lit("=").alias("kind"), F.col("rest").alias("key")), F.struct(F.lit("+").alias("kind"), F.col("whole").alias("key")))).alias("k"), F.col("word").alias("a"), F.col("c").alias("ca"))
    b = one.select(F.col("prefix").alias("p"), F.explode(F.filter(F.array(F.struct(F.lit("=").alias("kind"), F.col("rest").alias("key"), F.lit(True).alias("use")), F.struct(F.lit("+").alias("kind"), F.col("rest").alias("key"), shorter.alias("use"))), lambda x: x["use"])).alias("l"), F.col("word").alias("b"), F.col("c").alias("cb"))
    b = b.filter("cb <> ''")
    same = (F.col("prefix") == F.col("p")) & (F.col("k.kind") == F.col("l.kind")) & (F.col("k.key") == F.col("l.key"))
    return a.join(b, same).filter(F.when(F.col("k.kind") == "=", F.col("ca") < F.col("cb")).otherwise(F.col("a") != F.col("b")) & ((F.col("ca") != "") | (F.col("k.kind") == "+"))).select("a", "b")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """a, b: each pair of distinct words at distance one, once, from a column `word` of distinct strings without nulls.

    Prefixes of more than `group` words are split again and again; the rounds grow with the length of the longest such prefix, and each reads the words of such prefixes only.
    """
    rows, found, depth = words.select(F.lit("").alias("prefix"), "word"), [], 0
    small = None
    while True:
        sizes = rows.groupBy("prefix").count()
        large = staged(sizes.filter(F.col("count") > group).select(F.col("prefix").alias("lp")), "large-prefixes")
        fits = rows.join(large, F.col("prefix") == F.col("lp"), "left_anti").withColumn("depth", F.lit(depth))
        small = fits if small is None else small.unionByName(fits)
        if large.isEmpty():
            break
        split = staged(rows.join(large, F.col("prefix") == F.col("lp"), "left_semi"), "split-prefixes")
        found.append(_parting_at(split, depth))
        depth += 1
        # a word that ends here has met its near words that part here, and has none below
        rows = split.filter(F.char_length("word") >= depth).select(F.substring("word", 1, depth).alias("prefix"), "word")

    def walked(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(near_in(part["word"].tolist(), key[1]), columns=["a", "b"])

    pairs = small.groupBy("prefix", "depth").applyInPandas(walked, "a string, b string")
    for more in found:
        pairs = pairs.unionByName(more)
    return pairs


def _best() -> Column:
    """Of near words the one of largest n, then the smallest."""
    return F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near")))


def variants(words: DataFrame, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts n.

    form: the near word of largest n, the smallest of ties by code point, if its n is `ratio` times the word's own or more; else null. root: the last word reached by forms, the word itself if it has none. Counts
    grow along forms by the ratio, so their chains are short. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms could run in circles")
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_words(words, group), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), F.col("b") == F.col("near"))
    best = counted.groupBy("a").agg(F.count("*").alias("k"), _best().alias("best"))
    joined = words.join(best, F.col("word") == F.col("a"), "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    forms = staged(joined.select("word", "n", F.coalesce("k", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    step = staged(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = step.select(F.col("word").alias("w"), F.col("root").alias("next"))
        far = staged(step.join(after, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not far.filter("moved").isEmpty()
        discard(step)
        step = far
        if not moved:
            break
    root = step.select(F.col("word").alias("w"), "root")
    return forms.join(root, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
