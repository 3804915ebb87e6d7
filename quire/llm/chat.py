"""Reply trees to training conversations (operator 6).

Pointer doubling: after k self-joins each message knows its ancestor 2^k steps up and the sum of scores until there, so the depth of a tree
costs joins by its logarithm. Leaves rank by the mean score of their root-to-leaf path; the best of each conversation are
chosen, and the same pointers, from the longest down, list the messages of the chosen paths alone. Each path becomes one text:

    <|im_start|>ROLE
    TEXT<|im_end|>

a turn, and a loss mask: the spans (code points, end not included) of the assistants' texts. Inside roles and texts a backslash is doubled and "<|" becomes
"<\\|", so no text holds a control string, and read_back() gets all of it back. A line break in a role becomes "<\\n".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import put, staged

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _pointers(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: _c, _m, _up (2^k steps above or null), _sum and _len of the scores from the message until below _up."""
    longest = nodes.groupBy("_c").count().agg(F.max("count")).first()[0] or 0
    levels = [staged(nodes.select("_c", "_m", F.col("_p").alias("_up"), F.col("_score").alias("_sum"), F.lit(1).cast("long").alias("_len")), "pointers")]
    while not (active := levels[-1].filter("_up is not null")).isEmpty():
        if 1 << (len(levels) - 1) >= longest:  # a path of that many messages meets one twice
            loop = active.select(F.col("_c").alias("_lc"), F.col("_m").alias("_lm"))
            cut = nodes.join(loop, _same("_c", "_lc") & (F.col("_m") == F.col("_lm")), "left")
            return _pointers(cut.withColumn("_p", F.when(F.col("_lm").isNull(), F.col("_p"))).drop("_lc", "_lm"))
        above = levels[-1].select(F.col("_c").alias("_ac"), F.col("_m").alias("_am"), F.col("_up").alias("_aup"), F.col("_sum").alias("_asum"), F.col("_len").alias("_alen"))
        jumped = active.join(above, _same("_c", "_ac") & (F.col("_up") == F.col("_am"))).select("_c", "_m", F.col("_aup").alias("_up"), (F.col("_sum") + F.col("_asum")).alias("_sum"), (F.col("_len") + F.col("_alen")).alias("_len"))
        levels.append(staged(levels[-1].filter("_up is null").unionByName(jumped), "pointers"))
    return levels


def chosen_paths(messages: DataFrame, conv: str = "conv_id", msg: str = "msg", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score", keep: int = 1) -> DataFrame:
    """conv, branch (1 is the best), n (0 is the root), role, text: the messages of the `keep` best root-to-leaf paths of each conversation.

    Ties of the mean score go to the longer path, then to the smaller leaf. A message whose parent is null, itself or not in the
    conversation is a root, and so is each one that never reaches a root. Null roles, texts and scores count as empty and 0; a null conversation is
    one like any other. Each row without a message id is a message of its own, which no row can name as its parent; the greatest (score, role, text)
    stays for a message id that comes twice. An empty table gives no rows.
    """
    missing = F.lit(None)
    content = F.sha2(F.to_json(F.struct(F.col(score).cast("double").alias("s"), F.col(role).alias("r"), F.col(text).alias("t"), F.col(parent).cast("string").alias("p"))), 256)
    own = F.concat(F.lit("\0"), content, F.lit("\0"), F.monotonically_increasing_id().cast("string"))  # by content first, so that ties of leaves don't hang on the layout
    rows = messages.select(F.col(conv).alias("_c"), F.coalesce(F.col(msg).cast("string"), own).alias("_m"), F.col(parent).cast("string").alias("_p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_score"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = staged(rows.groupBy("_c", "_m").agg(F.max(F.struct("_score", "_role", "_text", "_p")).alias("_one")).select("_c", "_m", "_one.*"), "messages")
    known = rows.select(F.col("_c").alias("_kc"), F.col("_m").alias("_km"))
    linked = rows.filter(F.col("_p").isNotNull() & (F.col("_p") != F.col("_m"))).select("_c", "_m", "_p", "_score")
    linked = linked.join(known, _same("_c", "_kc") & (F.col("_p") == F.col("_km")), "left").withColumn("_p", F.col("_km")).drop("_kc", "_km")
    roots = rows.filter(F.col("_p").isNull() | (F.col("_p") == F.col("_m"))).select("_c", "_m", missing.cast("string").alias("_p"), "_score")
    levels = _pointers(linked.unionByName(roots))
    inner = levels[0].filter("_up is not null").select(F.col("_c").alias("_ic"), F.col("_up").alias("_im")).distinct()
    leaves = levels[-1].join(inner, _same("_c", "_ic") & (F.col("_m") == F.col("_im")), "left_anti")
    best = Window.partitionBy("_c").orderBy((F.col("_sum") / F.col("_len")).desc(), F.col("_len").desc(), "_m")
    steps = leaves.withColumn("_branch", F.row_number().over(best)).filter(F.col("_branch") <= keep).select("_c", "_branch", "_m", (F.col("_len") - 1).alias("_n"))
    for k in reversed(range(len(levels) - 1)):
        up = levels[k].filter("_up is not null").select(F.col("_c").alias("_uc"), F.col("_m").alias("_um"), "_up")
        both = F.array(F.struct("_m", "_n"), F.struct(F.col("_up").alias("_m"), (F.col("_n") - (1 << k)).alias("_n")))
        steps = steps.join(up, _same("_c", "_uc") & (F.col("_m") == F.col("_um")), "left")
        steps = steps.select("_c", "_branch", F.explode(F.when(F.col("_up").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("_s")).select("_c", "_branch", "_s._m", "_s._n")
    said = rows.select(F.col("_c").alias("_tc"), F.col("_m").alias("_tm"), "_role", "_text")
    steps = steps.join(said, _same("_c", "_tc") & (F.col("_m") == F.col("_tm")))
    return steps.select(F.col("_c").alias(conv), F.col("_branch").alias("branch"), F.col("_n").alias("n"), F.col("_role").alias("role"), F.col("_text").alias("text"))


def formatted(paths: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, branch, formatted, loss_spans (array of start, end): one row a path of chosen_paths()."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = paths.withColumn("_head", head).withColumn("_body", escape(F.col("text"))).withColumn("_turn", F.concat("_head", "_body", F.lit(END)))
    before = Window.partitionBy(conv, "branch").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_at", F.coalesce(F.sum(F.char_length("_turn")).over(before), F.lit(0)) + F.char_length("_head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("_at").alias("start"), (F.col("_at") + F.char_length("_body")).alias("end")))
    grouped = turns.withColumn("_span", span).groupBy(conv, "branch").agg(F.array_sort(F.collect_list(F.struct("n", "_turn", "_span"))).alias("_t"))
    spans = F.filter(F.transform("_t", lambda t: t["_span"]), lambda s: s.isNotNull())
    return grouped.select(conv, "branch", F.array_join(F.transform("_t", lambda t: t["_turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(made: DataFrame) -> DataFrame:
    """made with turns (array of role, text) and loss_text (the unescaped text under the mask), both read from formatted."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(unescape_role(F.substring(F.substring_index(p, "\n", 1), F.lit(len(START) + 1), F.char_length(p))).alias("role"), unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p))).alias("text")),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return put(made, turns=turns, loss_text=loss)
