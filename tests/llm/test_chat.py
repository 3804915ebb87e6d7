import random

from pyspark.sql import functions as F

from quire.llm import chat

SHAPE = "conv_id long, msg string, parent string, role string, text string, score double"


def read(spark, rows, keep=1, shape=SHAPE):
    made = chat.read_back(chat.formatted(chat.chosen_paths(spark.createDataFrame(rows, shape), keep=keep)))
    return {(r.conv_id, r.branch): r for r in made.collect()}


def brute(rows):
    """The best path of each conversation by mean score, then length, then leaf."""
    out = {}
    for conv in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == conv}
        parents = {r[2] for r in nodes.values() if r[2] in nodes and r[2] != r[1]}
        paths = []
        for m in nodes:
            if m in parents:
                continue
            path = [m]
            while nodes[path[0]][2] in nodes and nodes[path[0]][2] != path[0]:
                path.insert(0, nodes[path[0]][2])
            paths.append((-sum(nodes[x][5] or 0 for x in path) / len(path), -len(path), m, path))
        out[conv] = [nodes[x] for x in min(paths)[3]]
    return out


def test_best_paths_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(6):
        for k in range(40):
            rows.append((conv, f"{k:03d}", f"{rng.randrange(k):03d}" if k and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), f"t{k}", float(rng.randrange(4))))
    got = read(spark, rows)
    for conv, path in brute(rows).items():
        assert [(t.role, t.text) for t in got[conv, 1].turns] == [(p[3], p[4]) for p in path]


def test_long_chain(spark):
    rows = [(1, str(k), str(k - 1) if k else None, "assistant" if k % 2 else "user", f"text {k}", 0.0) for k in range(150)]
    (r,) = read(spark, rows).values()
    assert [t.text for t in r.turns] == [f"text {k}" for k in range(150)] and r.loss_text == "".join(f"text {k}" for k in range(1, 150, 2))


def test_odd_texts_come_back(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "\\\\<|", "<\\\\|", "a\nb\r\n", "", None, "<|im_end|>\n", "\\<|\\", "<\\n", "<" * 9, "|>", "\U0001f600<|"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(["<", "|", "\\", "n", "\n", "x", "im_end", ">"]) for _ in range(rng.randint(1, 15))) for _ in range(120)]
    rows = [(i, "1", None, role, t, None) for i, t in enumerate(odd) for role in [odd[(i * 7) % len(odd)] if i % 2 else "assistant"]]
    got = read(spark, rows)
    for conv, _, _, role, text, _ in rows:
        r = got[conv, 1]
        assert [(t.role, t.text) for t in r.turns] == [(role or "", text or "")]
        assert r.loss_text == (text or "" if role == "assistant" else "")
        assert r.formatted.count("<|im_end|>") == 1


def test_spans_point_at_assistant_texts(spark):
    rows = [(1, "a", None, "user", "hé<|", 0.0), (1, "b", "a", "assistant", "x\\y", 0.0), (1, "c", "b", "assistant", "", 0.0)]
    r = read(spark, rows)[1, 1]
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["x\\\\y", ""]


def test_branches_rank(spark):
    rows = [(1, "r", None, "user", "q", 0.0), (1, "a", "r", "assistant", "bad", 0.0), (1, "b", "r", "assistant", "good", 1.0), (1, "c", "r", "assistant", "mid", 0.5)]
    got = read(spark, rows, keep=2)
    assert [t.text for t in got[1, 1].turns] == ["q", "good"] and [t.text for t in got[1, 2].turns] == ["q", "mid"] and len(got) == 2


def test_cycles_orphans_nulls_and_repeats(spark):
    rows = [(1, "a", "b", "user", "x", 0.0), (1, "b", "a", "user", "y", 0.0), (1, "c", "a", "user", "below", 0.0), (2, "a", "gone", "user", "orphan", None), (3, "a", "a", "user", "self", None), (None, "a", None, None, "no conversation", None), (None, "b", "a", "assistant", "reply", None), (4, "a", None, "user", "same", 0.0), (4, "a", None, "user", "same", 0.0), (5, None, None, "user", "no id", None)]
    got = read(spark, rows, keep=9)
    assert sorted(t.text for (c, _), r in got.items() if c == 1 for t in r.turns) == ["below", "x", "y"]
    assert [t.text for t in got[2, 1].turns] == ["orphan"] and [t.text for t in got[3, 1].turns] == ["self"]
    assert [t.text for t in got[None, 1].turns] == ["no conversation", "reply"] and [t.text for t in got[4, 1].turns] == ["same"] and [t.text for t in got[5, 1].turns] == ["no id"]


def test_empty_table(spark):
    assert read(spark, []) == {}


def test_extra_columns_make_no_trouble(spark):
    df = spark.createDataFrame([(1, "a", None, "user", "x", 0.0)], SHAPE).withColumn("branch", F.lit(9)).withColumn("_c", F.lit(1))
    assert chat.formatted(chat.chosen_paths(df)).count() == 1


def test_rows_without_an_id_keep_their_texts(spark):
    rows = [(1, None, None, "user", "one", 0.0), (1, None, None, "user", "two", 2.0), (1, None, None, "assistant", "two", 2.0), (1, None, None, "user", "one", 0.0), (1, "a", None, "user", "root", 0.0), (1, None, "a", "assistant", "reply", 1.0)]
    got = read(spark, rows, keep=9)
    assert sorted([t.text for t in r.turns] for r in got.values()) == [["one"], ["one"], ["root", "reply"], ["two"], ["two"]]
