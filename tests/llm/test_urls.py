"""The automaton against a plain matcher, and the rules against a plain reading of them."""

import random
import re
import time

import pytest

from loomery.llm.plans.op3_url_automaton import RULES
from loomery.llm.url_rules import HostRule, ShiftAnd, judge_urls

URLS = [
    None, "", "no-scheme.com/en/", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/", "https://example.com/en", "https://www.example.com/en/x?y#z", "https://a.www.example.com/en/q",
    "https://notexample.com/en/", "https://x.net/es/1", "https://net/fr/", "https://net/FR/", "http://evil.org/x.com/", "http://evil.org/?u=http://a.com/", "http://a.com:80/en/", "http://a.com#/en/", "ftp://b.net?/es/", "x://y://z.com/",
    "http://é.example.com/en/ü😀", "http://a.com/" + "p" * 50_000, "http://b.net/es/\n\n", "http://.com/", "//com/", "http:///en/",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, None)], "page_id long, url string, host string")
    got = judge_urls(df, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id]), URLS[r.page_id]


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(df, [], default="block").first().verdict == "block"
    assert judge_urls(df.limit(0), RULES).count() == 0
    tie = [HostRule("allow", "a.com", "/"), HostRule("block", "a.com", "/")]
    assert judge_urls(df, tie).first().verdict == "allow"


def test_very_long_urls(spark):
    long_ = "/en/" + "x" * 3_000_000
    df = spark.createDataFrame([(1, f"http://a.example.com{long_}"), (2, f"http://a.net/es{long_}"), (3, f"http://b.org{long_}")], "page_id long, url string")
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in judge_urls(df, RULES).collect()}
    assert got == {1: ("example.com/en/", "block", 3_000_004), 2: ("net/es/", "block", 3_000_007), 3: (None, "allow", 3_000_004)}
    # A step for each character would take minutes.
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rnd = random.Random(seed)
    word = lambda chars, n: "".join(rnd.choice(chars) for _ in range(rnd.randint(0, n)))
    globs = [word("ab/.*", 12) for _ in range(60)]
    texts = [word("ab/.é", 15) for _ in range(300)]
    regs = [re.compile("(?s)" + "".join({"**": ".*", "*": "[^/]*"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", re.sub(r"\*{3,}", "**", g)))) for g in globs]
    got = ShiftAnd(globs).match(texts)
    for t, row in zip(texts, got, strict=True):
        assert [bool(r.fullmatch(t)) for r in regs] == row.tolist()


def test_twin(spark):
    from compare import assert_same
    from loomery.llm import registry

    assert assert_same(spark, registry.queries()["op3_url_automaton"], registry.oracle_sql()["op3_url_automaton"], "/root/testdata/sf0.01") == 250
