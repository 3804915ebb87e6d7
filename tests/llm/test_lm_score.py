import math
import random
import re
from collections import Counter

import numpy as np

from quire.llm import lm_score


def texts(n=400, seed=1):
    """Sentences of a small grammar."""
    rng = random.Random(seed)
    return [" ".join(f"the {rng.choice(['cat', 'dog', 'bird'])} {rng.choice(['sees', 'hears'])} a {rng.choice(['red', 'old'])} {rng.choice(['house', 'boat', 'tree'])} ." for _ in range(5)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, N_tokens string")


def vocabulary(known=50, seed=2):
    rng = np.random.default_rng(seed)
    words = [(int(c), int(n)) for c, n in zip(np.unique(rng.integers(0, 2**32, known)), rng.integers(5, 500, known))]
    rare = rng.integers(0, 3, lm_score.BINS * 16).astype(np.float64)
    return lm_score.Vocabulary(words, rare.reshape(lm_score.BINS, -1).sum(1), rare)


def shaken(network, seed=4):
    rng = np.random.default_rng(seed)
    return lm_score.Network({k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in network.w.items()})


def test_order_and_neighbours_matter(spark):
    tokens = lm_score.tokenised(frame(spark, list(zip(range(2000), texts(2000), "c" * 2000))))
    model = lm_score.fit(tokens, rounds=8)
    rng = random.Random(3)
    better = swapped = 0
    for t in texts(60, seed=9):
        words = t.split()
        swap = " ".join({"cat": "house", "dog": "boat", "bird": "tree", "house": "cat", "boat": "dog", "tree": "bird"}.get(w, w) for w in words)
        rng.shuffle(words)
        better += model.score(t)[1] > model.score(" ".join(words))[1] + 5
        swapped += model.score(t)[1] > model.score(swap)[1] + 2  # words of like frequency in the wrong place
    assert better == 60 and swapped >= 57


def test_counts_are_of_the_whole_corpus(spark):
    rows = list(zip(range(50), texts(50), "c" * 50)) + [(99, "rare " * 3, "c"), (98, None, "c"), (97, "", "c")]
    got = {r.code: r.n for r in lm_score.word_counts(lm_score.tokenised(frame(spark, rows))).collect()}
    want = Counter(w for _, t, _ in rows for w in (t or "").split())
    assert got == {int(lm_score.codes_of(w)[0]): n for w, n in want.items()}


def test_each_word_is_masked_in_one_of_the_rounds():
    codes = lm_score.codes_of(" ".join(random.Random(1).choices("abcdefgh", k=5000)))
    seen = sum(lm_score.masked(codes, k).astype(int) for k in range(lm_score.SHARE))
    assert (seen == 1).all() and all(400 < lm_score.masked(codes, k).sum() < 900 for k in range(lm_score.SHARE))


def test_every_place_is_trained_on(spark):
    rows = list(zip(range(70), texts(70), "c" * 70)) + [(99, "rare", "c"), (98, None, "c")]
    tokens = lm_score.tokenised(frame(spark, rows))
    assert lm_score.fit(tokens).trained == lm_score.fit(tokens, rounds=3).trained == sum(len((t or "").split()) for _, t, _ in rows)
    codes = lm_score.codes_of(" ".join(random.Random(1).choices("abcdefgh", k=5000)))
    for rounds in (1, 2, 3, 8):
        assert (sum(lm_score.masked(codes, k, rounds).astype(int) for k in range(rounds)) == 1).all()


def test_probabilities_sum_up_to_one():
    v = vocabulary()
    net = shaken(lm_score.Network.start(v))
    outcomes = np.concatenate((v.known_ids, v.bin_ids))
    assert len(set(outcomes.tolist())) == 50 + lm_score.BINS
    x = np.tile(np.array([v.edge, outcomes[3], outcomes[9], outcomes[1]]), (len(outcomes), 1))
    every = np.arange(v.edge)
    full = net.log_probability(every, np.tile(x[0], (v.edge, 1)), net.tables())
    assert abs(np.exp(full.astype(np.float64)).sum() - 1) < 1e-4
    start = lm_score.Network.start(v)
    assert abs(np.exp(start.log_probability(outcomes, x, start.tables()).astype(np.float64)).sum() - 1) < 1e-4
    assert np.allclose(np.exp(v.rare.reshape(lm_score.BINS, -1).astype(np.float64)).sum(1), 1, atol=1e-4)


def test_gradient_equals_differences():
    v = vocabulary()
    net = shaken(lm_score.Network.start(v, hidden=6))
    net = lm_score.Network({k: w.astype(np.float64) for k, w in net.w.items()})
    rng = np.random.default_rng(5)
    outcomes = np.concatenate((v.known_ids, v.bin_ids))
    y, x = rng.choice(outcomes, 40), rng.choice(np.append(outcomes, v.edge), (40, 4))
    grad, rows = net.gradient(y, x)
    loss = lambda: -net.log_probability(y, x, net.tables()).sum()
    for name, g in grad.items():
        for _ in range(8):
            place = tuple(int(rng.integers(n)) for n in g.shape)
            real = (int(rows[place[0]]), *place[1:]) if name == "e" else place
            net.w[name][real] += 1e-5
            up = loss()
            net.w[name][real] -= 2e-5
            down = loss()
            net.w[name][real] += 1e-5
            assert abs((up - down) / 2e-5 - g[place]) < 1e-3 * max(1, abs(g[place])), name


def test_scores_equal_brute_force_from_counts_on(spark):
    """Twenty documents: the words' places, the network's sums and the shares within bins, one token at a time."""
    rng = random.Random(7)
    said = [" ".join(rng.choices([f"w{k}" for k in range(200)], range(200, 0, -1), k=rng.randint(1, 60))) for _ in range(18)] + ["", None]
    tokens = lm_score.tokenised(frame(spark, [(i, t, "c") for i, t in enumerate(said)]))
    v = lm_score.Vocabulary.of(lm_score.word_counts(tokens), known=40)
    net = shaken(lm_score.Network.start(v))
    got = {r.doc_id: r for r in lm_score.scored_tokens(tokens, lm_score.Model(v, net)).collect()}
    w = {k: x.astype(np.float64) for k, x in net.w.items()}
    counts = Counter(t for s in said for t in (s or "").split())
    code = {t: int(lm_score.codes_of(t)[0]) for t in counts}
    by_code = dict(zip(v.known.tolist(), v.known_ids.tolist()))
    assert 0 < len(by_code) <= 40 and min(counts[t] for t in counts if code[t] in by_code) > max(counts[t] for t in counts if code[t] not in by_code)
    bins, mass, slots = {t: code[t] % 256 for t in counts}, Counter(), Counter()
    slot = {t: (code[t] >> 8) % v.slots for t in counts}
    for t, n in counts.items():
        if code[t] not in by_code:
            mass[bins[t]] += n
            slots[bins[t], slot[t]] += n
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    for i, s in enumerate(said):
        words, total = (s or "").split(), 0.0
        ids = [v.edge] * 2 + [by_code.get(code[t], int(v.bin_ids[bins[t]])) for t in words] + [v.edge] * 2
        for at, t in enumerate(words):
            h = np.tanh(sum(w["e"][ids[at + 2 + o]] @ w["t"][k] for k, o in enumerate((-2, -1, 1, 2))) + w["b"])
            k, j = divmod(ids[at + 2], v.width)
            total += math.log(softmax(h @ w["c"] + w["cb"])[k]) + math.log(softmax(w["u"][k] @ h + w["ub"][k])[j])
            if code[t] not in by_code:
                total += math.log((slots[bins[t], slot[t]] + 0.5) / (mass[bins[t]] + 0.5 * v.slots))
        assert got[i].n_tokens == len(words) and abs(got[i].log_probability - total) < 1e-3 * max(1, abs(total))
        assert (got[i].mean_log_probability is None) == (not words)


def test_query_tells_documents_from_shuffled_ones(spark, tmp_path):
    from quire.llm import queries

    rng = random.Random(11)
    plain = texts(600)
    rows = [(i, t, "en", "s") for i, t in enumerate(plain)]
    for i, t in enumerate(plain[:60]):
        words = t.split()
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en", "s"))
    rows += [(2000 + i, plain[0], "en", "s") for i in range(3)] + [(3000, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows} and got[3000].n_tokens == 0 and got[3000].log_probability == 0
    assert all(got[d].n_tokens == len(re.findall(r"\w+|[^\w\s]", t)) for d, t, *_ in rows[:100])
    assert abs(got[2000].log_probability - got[2001].log_probability) < 1e-3
    assert abs(got[2000].log_probability - got[0].log_probability) < 1e-3
    assert sum(got[i].log_probability > got[1000 + i].log_probability for i in range(60)) >= 57


def test_empty_table_long_text_and_names_that_clash(spark):
    empty = lm_score.scored(frame(spark, []).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_tokens", "log_probability", "mean_log_probability"]
    names = ["codes", "row", "n", "total", "Log_probability"]
    df = spark.createDataFrame([(1, "a b " * 200_000, 0, 1, 2, 3, 4), (2, "a", 0, 1, 2, 3, 4)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = lm_score.scored(df, keep_text=False)
    assert out.columns == ["doc_id", *names[:-1], "n_tokens", "log_probability", "mean_log_probability"]
    assert [(r.n_tokens, r.codes, r.total) for r in out.orderBy("doc_id").collect()] == [(400_000, 0, 3), (1, 0, 3)]


def test_words_are_cut_at_white_space_alone(monkeypatch):
    text = " ".join(f"word{i}, and" for i in range(300))
    want = lm_score.codes_of(text)
    monkeypatch.setattr(lm_score, "text_pieces", lambda t, f=lm_score.text_pieces: f(t, 17))
    assert (lm_score.codes_of(text) == want).all()


def test_texts_are_cut_together_as_by_the_pattern():
    rng = random.Random(8)
    atoms = [chr(c) for c in [*range(0x250), 0x2019, 0x3A3, 0x4E2D, 0x2028, 0x301, 0x963, 0x1F600]] + ["word", "Été", "x_1", "a×b", "c÷"] * 40
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None, "".join(chr(c) for c in range(0x180))]
    got = lm_score.codes_of_texts(texts)
    want = [[lm_score._codes[w.encode()] for w in re.findall(r"\w+|[^\w\s]", (t or "").lower())] for t in texts]
    assert [g.tolist() for g in got] == want


def test_rows_are_summed_by_number_and_masks_are_alike_in_chunks():
    rng = np.random.default_rng(9)
    of, rows = np.minimum(rng.zipf(1.3, 4 * 900) - 1, 299).astype(np.uint16), rng.normal(size=(900, 5))
    want = np.zeros((300, 5))
    np.add.at(want, of, np.tile(rows, (4, 1)))
    assert np.allclose(lm_score._summed(of, rows, 300), want)
    lengths = np.array([0, 700, 1, 0, 299, 0])
    codes = rng.integers(0, 2**32, 1000, dtype=np.uint32)
    apart = np.concatenate([lm_score.masked(c, 3) for c in np.split(codes, lengths.cumsum()[:-1])])
    assert (lm_score.masked(codes, 3, lengths=lengths) == apart).all()
