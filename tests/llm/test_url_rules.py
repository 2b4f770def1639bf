import itertools
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import url_rules
from tessera.llm.queries import HOST_RULES, QUERIES
from tessera.llm.url_rules import Index, TokenRule


def brute(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [
    None, "", "nothing", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/1?x=/y", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com/de/1#a?b", "http://notcom/fr/1", "http://com/fr/1", "http://a.b.org", "http://a.org/", "http://É.org/p\nq?r", "x://y://z.org/a", "http://h.com?u=http://a.org/",
]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    rows = url_rules.judge(pages.union(pages), HOST_RULES, []).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_rules.judge(pages.limit(0), HOST_RULES, []).count() == 0


def test_mined_rules_are_those_of_counting_all_token_sets(spark):
    urls = [f"http://{h}.example.com/{d}/{i}" for i, (h, d) in enumerate(itertools.product(["bad", "good", "odd"], ["x", "y"] * 10))]
    rows = [(u, int("bad." in u or "odd." in u and "/y/" in u)) for u in urls]
    frame = spark.createDataFrame(rows, "url string, bad int")
    sets = {u: frozenset(t) for u, t in frame.select("url", url_rules.tokens_of(F.col("url"))).collect()}
    every = {}
    for url, bad in rows:
        tokens = sorted(sets[url])
        for n in range(1, len(tokens) + 1):
            for some in itertools.combinations(tokens, n):
                every.setdefault(frozenset(some), [0, 0])[bad] += 1
    want = [
        TokenRule(some, bool(bad), round(n[bad] / sum(n), 12), round(n[bad] / len(rows), 12))
        for some, n in every.items()
        for bad in (0, 1)
        if n[bad] / len(rows) >= 0.1 and n[bad] / sum(n) >= 0.6 and n[bad] / sum(n) > sum(b == bad for _, b in rows) / len(rows)
    ]
    got = url_rules.mine(frame, 0.1, 0.6, least=1, errors=0.0)
    assert sorted(got, key=lambda r: r.order) == sorted(url_rules.pruned(want), key=lambda r: r.order)
    judged = url_rules.judge(frame.select(F.lit(1).alias("page_id"), "url"), [], got).select("verdict").collect()
    assert [r.verdict for r in judged] == ["block" if bad else "allow" for _, bad in rows]
    assert url_rules.mine(frame.limit(0)) == []


def test_rules_by_chance_are_left_out_and_real_ones_found(spark):
    import random

    r = random.Random(5)
    urls = [f"http://{r.choice('abcdefgh')}.example.com/{r.choice('stuv')}/{r.choice('xyz')}{i}.html" for i in range(1500)]
    noise = [(u, int(r.random() < 0.24)) for u in urls]
    assert not any(rule.blocks for rule in url_rules.mine(spark.createDataFrame(noise, "url string, bad int")))
    real = [(u, int(r.random() < (0.9 if "//c." in u and "/t/" in u else 0.1))) for u in urls]
    rules = url_rules.mine(spark.createDataFrame(real[:1000], "url string, bad int"))
    assert any(rule.blocks and {"first c", "folder t"} <= rule.tokens for rule in rules)
    held = spark.createDataFrame([(bad, u) for u, bad in real[1000:]], "bad int, url string")
    blocked = [x.page_id for x in url_rules.judge(held, [], rules, page_id="bad").where("verdict = 'block'").collect()]
    assert len(blocked) > 5 and sum(blocked) / len(blocked) > 0.7


def test_given_labels_block_nothing_or_better_than_the_share_of_bad_pages(spark):
    folder = "/root/testdata/sf0.1"
    pages, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("pages", "labels"))
    rows = url_rules.labelled_urls(pages, labels).withColumn("half", F.crc32("url") % 2).cache()
    rules = url_rules.mine(rows.where("half = 0"))
    judged = url_rules.judge(rows.where("half = 1"), [], rules, page_id="bad").where("verdict = 'block' and page_id is not null").collect()
    share = rows.where("half = 1").select(F.avg("bad")).first()[0]
    assert not judged or sum(x.page_id for x in judged) / len(judged) > share


def test_very_long_url(spark):
    url = "http://a.example.org/" + "é/" * 100_000
    assert url_rules.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), HOST_RULES, []).first().path == url[len("http://a.example.org") :]


def test_index_finds_what_trying_all_rules_finds():
    import random

    r = random.Random(1)
    rules = [TokenRule(frozenset(r.sample("abcdefgh", r.randint(1, 3))), bool(r.getrandbits(1)), round(r.random(), 2), 0.1) for _ in range(60)]
    index = Index(rules)
    for _ in range(200):
        tokens = set(r.sample("abcdefghij", r.randint(0, 6)))
        assert index.best(tokens) == max((x for x in rules if x.tokens <= tokens), key=lambda x: x.order, default=None)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_over_all_pages(spark, folder):
    rows = {r.page_id: r for r in QUERIES["op1_url_rules"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        host, path, rule, verdict = brute(page.url)
        r = rows[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_labels_come_by_the_number_in_the_url(spark):
    pages = spark.createDataFrame([("http://a/en/7.html",), ("http://a/en/8/",), ("http://a/en/x",), (None,), ("http://a/7/9?p=1",), ("http://a/" + "9" * 30,)], "url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (9, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_rules.labelled_urls(pages, labels).collect())) == [("http://a/7/9?p=1", 1), ("http://a/en/7.html", 1), ("http://a/en/8/", 0)]
