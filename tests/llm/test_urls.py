import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from capturelake.llm.urls import Index, Rule, decide, judge, mine, tokens

SCHEMA = "page_id long, url string, label string"
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


def plain(url):
    host, path = split(url)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def urls(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = rng.choice(["http", "https"]) + "://" + rng.choice(["", "www.", "m."]) + rng.choice(["pills", "news", "shop"]) + "." + rng.choice(["example", "site"]) + "." + rng.choice(["org", "net"]) + "/" + rng.choice(["buy", "en", "fr"]) + f"/{i}" + rng.choice(["", "?ref=x", "?page=2&ref=y"])
        bad = ("pills" in url and "/buy/" in url) or ("ref=y" in url and "/fr/" in url)
        out.append((i, url, rng.choice(["block", "block", None]) if bad and i % 9 == 0 else "block" if bad else rng.choice(["allow", None])))
    return out


def test_rules_by_host_and_path(spark):
    odd = [None, "", "no scheme/en/", "http://", "http://COM", "http://com/", "http://a.com?x=/", "HTTP://WWW.Example.COM/en/1", "http://x.example.com/en/", "http://x.example.com/en", "http://example.com/En/", "http://a.net/es/", "http://anet/es/", "x://y://a.net/fr/z", "http://b.net#/fr/", "http://é.NET/fr/\nq", "http://u@a.com:80/", "http://com/en/" + "a" * 100000]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(odd)], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.label) for r in decide(rows).collect()}
    for i, u in enumerate(odd):
        host, path, rule = plain(u)
        assert got[i] == (host, path, rule, RULES.get(rule)), u


def test_mined_rules_equal_enumeration(spark):
    data = urls()
    rows = spark.createDataFrame(data, SCHEMA)
    held = {r.page_id: set(r.t) for r in rows.select("page_id", tokens(F.col("url")).alias("t")).collect()}
    bad = {i for i, _, lab in data if lab == "block"}
    every, hits = Counter(), Counter()
    for i, have in held.items():
        for n in range(1, 4):
            for c in combinations(sorted(have), n):
                every[c] += 1
                hits[c] += i in bad
    rules = {c: h / every[c] for c, h in hits.items() if h >= 5 and h / every[c] >= 0.8}
    want = {c: v for c, v in rules.items() if not any(rules.get(p, 0) >= v for n in range(1, len(c)) for p in combinations(c, n))}
    got = mine(rows, min_support=0.0, min_count=5, min_confidence=0.8, max_items=60, max_rule=3)
    assert want and {r.tokens: round(r.confidence, 9) for r in got} == {c: round(v, 9) for c, v in want.items()}
    assert got == sorted(got, key=lambda r: (-r.confidence, -r.support, r.tokens))

    judged = {r.page_id: r for r in judge(rows.drop("label").withColumn("path", F.lit(1)), got).collect()}
    for i, url, _ in data:
        rule = plain(url)[2]
        best = next((r for r in got if set(r.tokens) <= held[i]), None)
        assert judged[i].mined == (" ".join(best.tokens) if best else None)
        assert judged[i].verdict == (RULES[rule] if rule else "block" if best else "allow")


def test_an_index_finds_what_a_scan_finds():
    rng = random.Random(2)
    rules = [Rule(tuple(sorted(rng.sample("abcdefgh", rng.randrange(1, 4)))), 1.0, 0.1) for _ in range(60)]
    index = Index(rules)
    for _ in range(300):
        held = rng.sample("abcdefghij", rng.randrange(6))
        assert index.best(held) == next((n for n, r in enumerate(rules) if set(r.tokens) <= set(held)), None)


def test_what_is_not_labelled_counts_against_a_rule(spark):
    rows = [(i, f"http://a{i % 7}.net/es/{i}", "block") for i in range(40)] + [(100 + i, f"http://b{i % 7}.net/en/{i}", None) for i in range(60)]
    got = mine(spark.createDataFrame(rows, SCHEMA))
    assert got and all("tld:net" != r.tokens[0] or len(r.tokens) > 1 for r in got)
    judged = judge(spark.createDataFrame([(1, "http://c.net/en/5", None), (2, "http://c.org/es/5", None)], SCHEMA), got).orderBy("page_id").collect()
    assert [r.verdict for r in judged] == ["allow", "block"]


def test_many_tokens_that_always_stand_together_stay_bounded(spark):
    long = "/".join("s" + chr(97 + i) for i in range(25))
    rows = [(i, f"http://x.example.org/{long}/{i}", "block") for i in range(50)] + [(100 + i, f"http://y{i}.example.org/z", None) for i in range(50)]
    got = mine(spark.createDataFrame(rows, SCHEMA), max_items=8)
    assert 0 < len(got) <= 2**8 and all(r.confidence == 1.0 for r in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty) == [] and judge(empty, []).count() == 0
    rows = spark.createDataFrame([(None, None, "block"), (1, "x", None), (1, "x", None)], SCHEMA)
    assert mine(rows) == [] and [r.verdict for r in judge(rows, []).collect()] == ["allow"] * 3


def test_no_token_or_count_is_cut_from_long_urls(spark):
    """Counted level by level, as URLs with more tokens than max_items are, rules are those of FP-growth over all tokens."""
    rows = spark.createDataFrame(urls(), SCHEMA)
    how = {"min_support": 0.0, "min_count": 5, "min_confidence": 0.8, "max_rule": 3}
    whole = mine(rows, max_items=60, **how)
    assert any(len(r.tokens) > 1 for r in whole) and mine(rows, max_items=2, **how) == whole
    tail = [(i, f"http://{i % 2}.org/a/b/c/d/e/f/g/h/i/j/k/l/z", "block") for i in range(40)] + [(50 + i, f"http://{i % 2}.org/a/b/c/d/e/f/g/h/i/j/k/l", "allow") for i in range(40)]
    assert [r.tokens for r in mine(spark.createDataFrame(tail, SCHEMA), max_items=12)] == [("path:z",)]
    assert len(mine(rows, min_support=0.0, min_count=2, max_items=1, max_rule=2)) == len(mine(rows, min_support=0.0, min_count=2, max_items=60, max_rule=2))
