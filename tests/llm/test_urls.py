import random

from panelspark.llm import url_trie as u
from panelspark.llm.queries import URL_RULES


def brute(rules, host, path):
    fit = [(host_.count("."), len(path_), v == "block", host_ + path_, v) for v, host_, path_ in rules if (host == host_ or host.endswith("." + host_)) and path.startswith(path_)]
    return max(fit)[3:] if fit else None


def test_trie_finds_the_longest_rule():
    rnd = random.Random(4)
    labels, pieces = ["a", "b", "com", "net"], ["", "x", "xy", "z"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "/" + "/".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 3)))
    for _ in range(60):
        rules = [(rnd.choice(["allow", "block"]), host(), path()) for _ in range(12)]
        trie = u.Trie(rules)
        for _ in range(60):
            h, p = host(), rnd.choice([path(), ""])
            assert trie.look_up(h, p) == brute(rules, h, p), (rules, h, p)


def test_parts_of_odd_urls():
    assert u.parts("HTTP://WWW.Example.COM/En/a?b#c") == ("www.example.com", "/En/a")
    assert u.parts("http://a.b?x=/y") == ("a.b", "")
    assert u.parts("http://a://b/c") == ("a:", "//b/c")
    assert u.parts("no host") == u.parts("") == ("", "")


def test_judged_pages(spark):
    urls = [None, "", "x", "http://example.com/en/1", "http://www.example.com/en/1", "http://m.example.com/en", "http://a.net/es/", "http://a.net/en/", "http://a.org/", "http://com", "http://xcom/"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = [(r["rule"], r["verdict"]) for r in u.judge(df, URL_RULES).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 3 + [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block")] + [(None, "allow")] * 4
    assert u.judge(df, [], default="block").filter("verdict <> 'block'").isEmpty()
    assert u.judge(df.limit(0), URL_RULES).count() == 0
