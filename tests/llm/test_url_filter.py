import random

from fieldproof.llm import url_filter as U

from ..oracle import same

CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("https://m.EXAMPLE.net/en/25#top", "m.example.net", "/en/25", "example.net/en/", "allow"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/DE/", "example.com", "/DE/", None, "allow"),
    ("http://x.org/fr/a?u=http://b.net/", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x/", "a.net", "", None, "allow"),
    ("http://a.net:80/", "a.net:80", "/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://www.cheap-pills.example.com/", "www.cheap-pills.example.com", "/", None, "block"),
    ("http://cheap-pills.example.net/en/", "cheap-pills.example.net", "/en/", "example.net/en/", "allow"),
    ("http://xcheap-pills.com/", "xcheap-pills.com", "/", None, "allow"),
    ("http://net/\nx", "net", "/\nx", "net/", "block"),
    ("://É.org/fr/", "É.org", "/fr/", "org/fr/", "allow"),
]


def test_cases(spark):
    rows = [(i, u, "old", 1) for i, (u, *_) in enumerate(CASES)] + [(0, CASES[0][0], "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, _url int")
    for inline in (256, 0):
        out = U.judge(pages, inline=inline).orderBy("page_id").collect()
        assert {r["_url"] for r in out} == {1} and len(out) == len(CASES) + 1 and out[0]["verdict"] == out[1]["verdict"]
        for r in out:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:], CASES[r["page_id"]]
    assert U.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in U.judge(pages, rules=()).collect()} == {"allow"}


def test_wildcards_and_tokens():
    assert U.pattern_rule("||ads*server.").tokens == ()
    assert U.pattern_rule("/a/bc*d/").tokens == ("a",)
    assert U.host_rule("org/fr", "allow").tokens == ("org",)


def test_index_takes_the_rarest(spark):
    pages = spark.createDataFrame([(i, f"http://a.example.com/{'de' if i else 'x'}/") for i in range(5)], "page_id long, url string")
    assert set(U.index(pages, (U.host_rule("example.com/x/", "block"), U.host_rule("com/", "allow")))) == {"x", "com"}


def test_many_rules(spark):
    r = random.Random(1)
    rules = tuple(U.host_rule(f"h{i}.com/{'p/' * (i % 3)}", r.choice(["allow", "block"])) for i in range(300))
    pages = spark.createDataFrame([(i, f"http://s.h{i % 310}.com/p/p/") for i in range(400)], "page_id long, url string")
    rows = lambda df: sorted((x["page_id"], x["rule"] or "", x["verdict"]) for x in df.collect())
    assert rows(U.judge(pages, rules)) == rows(U.judge(pages, rules, inline=1000))


def test_sql(spark):
    assert same(spark, U.op2_url_filter, U.ORACLE) == 50
