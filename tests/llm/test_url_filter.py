import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import url_filter
from tastegrid.llm.shelf import Shelf
from tastegrid.llm.url_filter import ALLOW, BLOCK, Rule, build, hashed, judge

RULES = [
    Rule(ALLOW, "com"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"), Rule(BLOCK, "b.c", "/x/"), Rule(ALLOW, "a.b.c", "/"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en",
    "http://notexample.com/en/", "https://sub.example.com/en/1", "ftp://x.net/fr/a", "x://x.net?/fr/", "a://b://net/es/",
    "http://a.b.c/x/", "http://q.a.b.c/x/1", "http://net/es/", "http://.net/fr/", "http://a..net/es/", "http://example.com:80/en/",
    "http://" + "a." * 2000 + "net/fr/", "http://net/fr/" + "p" * 50_000, "http://éa.com/ü", "http://com/#x", "http://example.com/en/",
]


def brute_force(url, rules=RULES, default=ALLOW):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [
        r for r in rules
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else default


@pytest.mark.parametrize("default", [ALLOW, BLOCK])
def test_verdicts_equal_brute_force(spark, default):
    rows = [*enumerate(URLS), (None, "http://com/"), (3, "http://com/"), (3, "http://com/")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id BIGINT, url STRING, host INT, keys STRING")
    found = sorted((tuple(r) for r in judge(pages, RULES, default).collect()), key=str)
    assert found == sorted(((i, *brute_force(u, default=default)) for i, u in rows), key=str)


def test_no_rows_and_bad_rules(spark):
    assert judge(spark.createDataFrame([], "page_id BIGINT, url STRING"), RULES).count() == 0
    for rules in ([], [RULES[0], RULES[0]]):
        with pytest.raises(ValueError):
            judge(spark.createDataFrame([], "page_id BIGINT, url STRING"), rules)
    for bad in (("maybe", "com", "/"), (ALLOW, "com", ""), (ALLOW, "c/m", "/")):
        with pytest.raises(ValueError):
            Rule(*bad)


def test_cascade_is_exact_over_its_universe_and_small(spark):
    draw = random.Random(1)
    keys = sorted({f"k{draw.randrange(10**9)}" for _ in range(20_000)})
    listed = set(draw.sample(keys, 1500))
    frame = spark.createDataFrame([(k,) for k in keys], "key STRING").select(hashed(F.col("key")).alias("k")).select("k.*")
    rules = spark.createDataFrame([(k,) for k in [*listed, "elsewhere"]], "key STRING").select(hashed(F.col("key")).alias("k")).select("k.*")
    cascade = build(frame, rules, Shelf(spark), "test", 1 << 20)
    rows = frame.collect()
    has = cascade.has(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]))
    assert {r["key"] for r, h in zip(rows, has) if h} == listed
    assert len(cascade.levels) > 2 and sum(lv.bits for lv in cascade.levels) < 20 * len(listed)
    with pytest.raises(ValueError):
        build(frame, rules, Shelf(spark), "small", 100)


def test_equal_hashes_of_different_keys_are_an_error(spark):
    universe = spark.createDataFrame([("in", 1, 2), ("out", 1, 2)], "key STRING, a BIGINT, b BIGINT")
    with pytest.raises(RuntimeError):
        build(universe, universe.where("key = 'in'"), Shelf(spark), "same", 1 << 20)


def test_many_rules_need_no_join_to_apply(spark):
    plan = judge(spark.createDataFrame([(1, "http://com/")], "page_id BIGINT, url STRING"), RULES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
    assert url_filter.MAX_LEVELS >= 64
