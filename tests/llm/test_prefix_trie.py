"""The trie of conversations' prefixes against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from quire.llm import prefix_trie
from quire.llm.queries import op12_prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, depth string"


def expected(rows):
    said = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            said.setdefault(c, []).append((turn, role or "", text or ""))
    said = {c: [(r, x) for _, r, x in sorted(t, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))] for c, t in said.items()}
    rebuilt = {c: said.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in said.items()}
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for top, members in nodes.items():
        below = [(k, m) for k, m in nodes.items() if k[: len(top)] == top]
        children = {k: sum(len(o) == len(k) + 1 and o[: len(k)] == k for o in nodes) for k, _ in below}
        saved = sum((len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k, m in below if k)
        ends = ",".join(str(m) for m in sorted(members) if len(rebuilt[m]) == len(top))
        parent = min(nodes[top[:-1]]) if top else None
        out.append((min(members), len(top), parent, len(members), children[top], sum(not n for n in children.values()), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def made(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        if rng.random() < 0.15:
            continue
        for t in range(40 if c == 45 else rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["u", "a", None]), rng.choice(["x y", "x", None, "", "a\x0bb c", "é z q"]), "d"))
    rows += [(c, 0, "u", "same words here", None) for c in range(200, 240)] + [(None, 1, "u", "q", None)] + rows[:5]
    return rows


@pytest.mark.parametrize("part", [3, 4096])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, part):
    """Parts of three turns make every sum and neighbour cross an edge; runs of three ends make nodes be hashed run by run."""
    monkeypatch.setattr(prefix_trie, "PART", part)
    monkeypatch.setattr(prefix_trie, "ENDS", part)
    rows = made()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_prefix_trie(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == expected(rows)


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    ids = spark.createDataFrame([(5,), (9,)], "conv long")
    turns = spark.createDataFrame([(9, 0, "u", "one two")], "conv long, n long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(ids, turns).collect()}
    assert set(got) == {(5, 0), (9, 1)}
    assert (got[5, 0].n_convs, got[5, 0].n_children, got[5, 0].n_leaves, got[5, 0].parent_conv_id) == (2, 1, 1, None)
    assert got[5, 0].ends_sha256 == hashlib.sha256(b"5").hexdigest() and got[9, 1].parent_conv_id == 5


def test_empty(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame([], COLUMNS))).collect() == []
