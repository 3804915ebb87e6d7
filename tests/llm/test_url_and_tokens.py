import random

import public_tokenizers
import pytest
import sentencepiece

from quire.llm import token_count, url_reputation
from quire.llm.queries import RULES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def judged(spark, urls, outcomes=(), rules=RULES, **more):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    good = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r.page_id: r for r in url_reputation.judge(pages, good, list(rules), **more).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.COM/En/x", "a.example.com", "/En/x", "com/", "allow"),
        ("http://a.example.com/en/x?q=1#t", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/?a", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://x.net/de/", "x.net", "/de/", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.com?a=/en/", "x.com", "", None, "allow"),
        ("http://x.com#/", "x.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a?u=http://b.com/x", "b.com", "/x", "com/", "allow"),
        ("http://u@x.com:80/", "u@x.com:80", "/", None, "allow"),
        ("http:///p", "", "/p", None, "allow"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), cases[i]


def test_bad_hosts_are_blocked_and_others_stay(spark):
    urls = [f"http://{h}.org/{k}" for h in ("bad", "fine") for k in range(60)] + ["http://new.bad.org/", "http://other.org/"]
    outcomes = [(i, int(i >= 60 or i % 20 == 0)) for i in range(120)]
    got = judged(spark, urls, outcomes, rules=[])
    assert all(got[i].verdict == ("block" if i < 60 else "allow") for i in range(120)) and got[121].verdict == "allow"
    assert got[0].posterior_bound < got[120].posterior_bound < got[60].posterior_bound


def test_shrinkage_equals_hand_made(spark):
    hosts = ["a.x.org"] * 6 + ["b.x.org"] * 4 + ["c.y.net"] * 5
    seen = spark.createDataFrame([(h, h[2:], h[4:], int(i in (0, 6, 7, 8, 10, 11))) for i, h in enumerate(hosts)], "name string, domain string, suffix string, good int")
    got = {r.name: r for r in url_reputation.host_reputation(seen).collect()}

    def kappa(groups):
        n, x, k = sum(a for a, _ in groups), sum(b for _, b in groups), len(groups)
        p = x / n
        base = p * (1 - p)
        spread = sum(b * b / a for a, b in groups) - x * x / n
        room = base * (n - sum(a * a for a, _ in groups) / n - (k - 1))
        rho = 0.05 if room <= 0 else (spread - base * (k - 1)) / room
        return 1 / min(0.5, max(0.001, rho)) - 1

    hosts, domains = {"a.x.org": (6, 1), "b.x.org": (4, 3), "c.y.net": (5, 2)}, {"x.org": (10, 4), "y.net": (5, 2)}
    ks, kh = kappa(list(domains.values())), kappa(list(hosts.values()))
    mean = 6 / 15
    for host, (n, x) in hosts.items():
        dn, dx = domains[host[2:]]
        ms = (dx + mean * ks) / (dn + ks)
        md = (dx + ms * ks) / (dn + ks)
        assert abs(got[host].posterior_mean - (x + md * kh) / (n + kh)) < 1e-12


def test_suffixes_and_addresses(spark):
    urls = ["http://a.b.co.uk/", "http://10.0.0.1:80/", "http://localhost/", "http://..com/"]
    assert len(judged(spark, urls, [(0, 1), (0, 0)])) == 4


def test_suffix_rules_with_wildcards_and_exceptions(spark):
    rules = ("co.uk", "*.ck", "!www.ck", "github.io", "a.b.kobe.jp", "*.kobe.jp", "!city.kobe.jp")
    cases = {"x.co.uk": ("x.co.uk", "co.uk"), "y.x.co.uk": ("x.co.uk", "co.uk"), "a.shop.ck": ("a.shop.ck", "shop.ck"), "www.ck": ("www.ck", "ck"), "z.www.ck": ("www.ck", "ck"), "me.github.io": ("me.github.io", "github.io"),
             "q.w.city.kobe.jp": ("city.kobe.jp", "kobe.jp"), "q.w.e.kobe.jp": ("w.e.kobe.jp", "e.kobe.jp"), "x.a.b.kobe.jp": ("x.a.b.kobe.jp", "a.b.kobe.jp"), "x.com": ("x.com", "com"), "com": ("com", "com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    levels = url_reputation._levels(df["h"], rules)
    got = {r.h: (r.domain, r.suffix) for r in df.select("h", levels["domain"].alias("domain"), levels["suffix"].alias("suffix")).collect()}
    assert got == cases
    with pytest.raises(ValueError):
        url_reputation.suffix_length(df["h"], ("a.b.c.d.e",))


def test_outcomes_move_with_the_suffix_rules(spark):
    urls = [f"http://{h}.github.io/{k}" for h in ("bad", "fine") for k in range(40)] + [f"http://h{k % 8}.net/" for k in range(80)]
    outcomes = [(k, 0) for k in range(40)] + [(80 + k, 1) for k in range(80)]
    apart = judged(spark, urls, outcomes, rules=[], suffix_rules=("github.io",))
    one = judged(spark, urls, outcomes, rules=[], suffix_rules=())
    assert one[0].verdict == apart[0].verdict == "block" and apart[79].posterior_bound > one[79].posterior_bound + 0.05


def test_extra_columns_may_have_any_name(spark):
    names = ["row", "name", "known", "n", "of", "good", "domain", "suffix", "_n", "_host", "posterior_mean", "Rule"]
    pages = spark.createDataFrame([(1, "http://a.org/", *range(len(names)))], "page_id long, url string, " + ", ".join(f"{n} int" for n in names))
    out = url_reputation.judge(pages, spark.createDataFrame([(1, 1)], "page_id long, good int"), RULES)
    assert out.columns == ["page_id", "url", *names[:-1], "host", "path", "rule", "verdict", "host_outcomes", "posterior_bound"]
    assert [out.first()[n] for n in names[:-1]] == list(range(len(names) - 1))


def test_token_query_equals_the_library(spark):
    from quire.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op9_tokens(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(sp.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 4096)


def test_null_pages_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    good = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "page_id long, good int")
    assert url_reputation.judge(pages, good.filter("page_id is not null"), RULES).count() == 3
    assert url_reputation.judge(pages.limit(0), good.limit(0), RULES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_chunks_count_as_the_library_does(seed):
    rng, sp = random.Random(seed), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    parts = ["the ", "of", "  ", "    ", "\n", "\t", "é", "ß", "漢", "字", "\U0001f9d9", "a", "aa", " ", "▁", "1", "<s>", "</s>", "<unk>", "x" * 5, "tion ", "."]
    for _ in range(250):
        text = "".join(rng.choice(parts[: rng.randint(2, len(parts))]) for _ in range(rng.randint(1, 300)))
        assert token_count.count_tokens(text, MODEL, rng.choice([10, 30, 100]), rng.choice([1, 4, 20])) == len(sp.encode(text)), text


def test_text_without_any_proven_boundary():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a" * 5000, " " * 5000, "ab" * 3000, "́" * 500):
        assert token_count.count_tokens(text, MODEL, 100, 10) == len(sp.encode(text))


def test_counts_of_a_table(spark):
    texts = [None, "", " ", "one two", "one two", "word " * 30_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, N_BYTES string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in token_count.token_counts(df, MODEL).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert token_count.token_counts(df.limit(0), MODEL).count() == 0
