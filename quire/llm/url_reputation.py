"""URL filter by host reputation with empirical-Bayes shrinkage (operator 7).

Labelled pages give each host n outcomes, x of them good. The rates of hosts vary about their registered domain's, domains' about their
suffix's, suffixes' about the rate of all pages; at each level the spread is a beta distribution with mean m, of the level above, and
strength 1 / rho - 1, where rho, the correlation of two outcomes in one group, is estimated by moments from all groups of the level. The
posterior mean of a level is the prior mean of the next one down. A host is blocked if its rate, even at the
upper bound (posterior mean plus z standard deviations), is below `least`: hosts with few outcomes take the bound of their domain and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import UPPER, packed, staged, unpacked

#: Registries that sell names one level further down, as suffix rules: "*" stands for one label, "!" before a rule makes an exception. Fixed values, a small part of the rules there are: give a table of all.
SUFFIX_RULES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr", "com.tr", "com.ar")
LABELS = 4  # of a rule, at most
LEAST, Z = 0.5, 1.6448536269514722
NO_SPREAD, RHO_MIN, RHO_MAX = 0.05, 0.001, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: then up to "?", "#" or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.char_length(url))
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.when(there, host).otherwise(""), F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest (verdict, host, path) that fits, or nulls; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def suffix_length(name: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    """Labels of the name's suffix: of an exception that fits one less than it has, else those of the longest rule that fits, else 1."""
    plain, wild, but = ([r.strip().lower() for r in rules if r and test(r)] for test in (lambda r: r[0] not in "*!", lambda r: r[0] == "*", lambda r: r[0] == "!"))
    if any(r.count(".") >= LABELS for r in rules):
        raise ValueError(f"a rule of more than {LABELS} labels")
    out = F.lit(1)
    for n in range(2, LABELS + 1):
        last, there = F.substring_index(name, ".", -n), F.size(F.split(name, r"\.")) >= n
        same = [r for r in plain if r.count(".") == n - 1]
        stars = [r[2:] for r in wild if r.count(".") == n - 1]
        if same:
            out = F.when(there & last.isin(*same), n).otherwise(out)
        if stars:
            out = F.when(there & F.substring_index(name, ".", 1 - n).isin(*stars), n).otherwise(out)
    for n in range(2, LABELS + 1):
        if same := [r[1:] for r in but if r.count(".") == n - 1]:
            out = F.when(F.substring_index(name, ".", -n).isin(*same), n - 1).otherwise(out)
    return out


def _levels(host: Column, rules: tuple[str, ...]) -> dict[str, Column]:
    """The name without user and port, its registered domain and its suffix; an address is all three itself."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^([0-9.]+|\[.*\])$")
    n = suffix_length(name, rules)
    domain, suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in range(1, LABELS + 1):
        suffix = F.when(n == k, F.substring_index(name, ".", -k)).otherwise(suffix)
        domain = F.when(n == k, F.substring_index(name, ".", -k - 1)).otherwise(domain)
    return {"name": name, "domain": F.when(address, name).otherwise(domain), "suffix": F.when(address, name).otherwise(suffix)}


def _strengths(groups: dict[str, DataFrame]) -> tuple[dict[str, float], float]:
    """For each level 1 / rho - 1 over its groups with n outcomes, x good; and the rate of all. One job over the staged hosts."""
    n, x = F.col("n"), F.col("x")
    made = [g.filter("n > 0").agg(F.lit(k).alias("level"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("k"), F.sum(x * x / n).alias("xx"), F.sum((n * n).cast("double")).alias("nn")) for k, g in groups.items()]
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    out, rate = {}, 0.5
    for level, n, x, k, xx, nn in every.collect():
        out[level] = 1 / NO_SPREAD - 1
        if n:
            p = rate = x / n
            base, spread = p * (1 - p), xx - x * x / n
            room = base * (n - nn / n - (k - 1))
            rho = NO_SPREAD if room <= 0 else (spread - base * (k - 1)) / room
            out[level] = 1 / min(RHO_MAX, max(RHO_MIN, rho)) - 1
    return out, rate


def host_reputation(seen: DataFrame) -> DataFrame:
    """name, n, posterior_mean, posterior_bound: one row a host. seen: name, domain, suffix, good (0, 1 or null), one row a page."""
    hosts = staged(seen.groupBy("name", "domain", "suffix").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("x")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    strength, rate = _strengths({"host": hosts, "domain": domains, "suffix": suffixes})
    ks, kd, kh = strength["suffix"], strength["domain"], strength["host"]
    suffixes = suffixes.select("suffix", ((F.col("x") + rate * ks) / (F.col("n") + ks)).alias("ms"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("x") + F.col("ms") * kd) / (F.col("n") + kd)).alias("md"))
    made = hosts.join(domains, "domain")
    made = made.withColumn("posterior_mean", (F.col("x") + F.col("md") * kh) / (F.col("n") + kh))
    bound = F.col("posterior_mean") + Z * F.sqrt(F.col("posterior_mean") * (1 - F.col("posterior_mean")) / (F.col("n") + kh + 1))
    return staged(made.select("name", "n", "posterior_mean", bound.alias("posterior_bound")), "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", least: float = LEAST, suffix_rules: tuple[str, ...] = SUFFIX_RULES) -> DataFrame:
    """pages with host, path, rule, verdict, host_outcomes, posterior_bound: the verdict of the longest rule that fits, else block
    if the host's bound is below least, else allow.

    A null url, or one without "://", has an empty host, judged like any other. outcomes: id_col and good (0 or 1, null: none); a page with several has
    the worst. Pages without an id have no outcome. suffix_rules: which suffixes of several labels registries sell names under. Columns of pages with the names of the new ones make way.
    pages are read twice: once for the counts of hosts, once for the verdicts.
    """
    host, path = host_and_path(F.col(url_col))
    levels = _levels(host, suffix_rules)
    outcomes = outcomes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.min("good").alias("good"))
    seen = pages.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in levels.items())).join(outcomes, F.col("id") == F.col("of"), "left")
    known = host_reputation(seen).select(F.col("name").alias("known"), "n", "posterior_bound")
    rows = packed(pages, host=host, path=path, name=levels["name"]).join(known, F.col("name") == F.col("known"), "left")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("posterior_bound") < least, "block").otherwise("allow")
    return unpacked(rows, host=F.col("host"), path=F.col("path"), rule=rule, verdict=F.coalesce(verdict, method), host_outcomes=F.col("n"), posterior_bound=F.round("posterior_bound", 6))
