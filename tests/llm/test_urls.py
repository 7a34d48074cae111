"""Rules and vocabulary against brute force; the registered query has SQL, too."""

import re

from cohortlens.llm import urls

CASES = {
    None: (None, "allow"), "": (None, "allow"), "no scheme/porn": (None, "block"), "http://EXAMPLE.com/en/a": ("example.com/en/", "block"),
    "https://m.Example.com/en/": ("example.com/en/", "block"), "https://www.example.com/en/x?y": ("www.example.com/en/", "allow"),
    "https://example.com": (None, "allow"), "https://example.com/?a=/en/": ("com/", "allow"), "http://a.net/fr/1#://b.com/": ("net/fr/", "block"),
    "http://anet/es/": (None, "allow"), "http://x.org/casino": (None, "allow"), "http://x.org/casino/Casino": (None, "allow"),
    "http://x.org/free-casino": (None, "block"), "http://x.org/XXX": (None, "block"), "http://x.org/xxxl": (None, "allow"),
    "http://x.org/sussex": (None, "allow"), "http://casino.com/free/porn": ("com/", "allow"), "http://x.com:80/": (None, "allow"), "://": (None, "allow"), "a\nb://c.com/d\ne": ("com/", "allow"),
}


def test_cases(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got == dict(enumerate(CASES.values()))
    assert urls.judged(df.limit(0)).count() == 0


def test_hits_equal_patterns():
    found = urls.automaton(urls.STRICT_TERMS, urls.SOFT_TERMS)
    texts = ["sex-sexy/sexsexy.sex", "a" * 50_000 + "/porn", "xxx_xxx", "bet.betting.bets", "é-free-é"]
    for t in texts:
        alone = lambda w: bool(re.search(f"(?<![a-z0-9]){w}(?![a-z0-9])", t))  # noqa: B023, E731
        assert urls.hits(t, found) == (sum(map(alone, urls.STRICT_TERMS)), sum(map(alone, urls.SOFT_TERMS)))


def test_own_vocabulary(spark):
    df = spark.createDataFrame([(1, "http://a.org/ok/fine"), (2, "http://a.org/ok")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(df, rules=(), strict=(), soft=("ok", "fine"), several=2).collect()}
    assert got == {1: "block", 2: "allow"}
    assert {r.verdict for r in urls.judged(df, rules=(), strict=(), soft=()).collect()} == {"allow"}


SPAM = (
    "http://free-bets.a.org/1", "http://casino-win.a.org/", "http://adult-x.a.org/2", "http://cheap-pills.a.org/", "http://spam-farm.a.org/", "http://ads-track.a.org/",
    "http://a.org/FreeBets", "http://onlinecasino.a.org/", "http://a.org/live_poker?x=1", "http://a.org/buy-viagra", "http://a.org/order-meds", "http://adtracker.a.org/p.gif",
    "http://a.org/roulette/blackjack", "http://a.org/sportsbook-bonuses", "http://a.org/xanax/valium", "http://linkfarm.a.org/", "http://a.org/torrents/keygens", "http://youporn.a.org/",
)
CLEAN = (
    "http://a.org/track-and-field/how-to-win", "http://a.org/cheap-flights/free-cancellation", "http://a.org/adult-education", "http://a.org/ads/manager", "http://a.org/farm/cheap-seeds",
    "http://a.org/alphabets", "http://a.org/read-tracking-numbers", "http://a.org/essex-farms", "http://a.org/windows-tracker", "http://a.org/free-software", "http://a.org/spam-recipes", "http://a.org/x-ray",
    "http://a.org/load-server", "http://a.org/pharmacy", "http://a.org/road-track", "http://a.org/win", "http://a.org/lottery-winners", "http://a.org/better-adulthood",
)


def test_planted_spam_and_clean_urls_without_a_rule(spark):
    df = spark.createDataFrame(list(enumerate(SPAM + CLEAN)), "page_id long, url string")
    got = urls.judged(df).collect()
    assert all(r.rule is None for r in got)
    assert [r.verdict for r in sorted(got)] == ["block"] * len(SPAM) + ["allow"] * len(CLEAN)


def test_vocabulary_rejects_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urls.judged(pages)
    assert got.where("strict_terms > 0").count() > 0 and got.where("rule is null and verdict = 'block'").count() > 0


def test_terms_are_sought_in_the_decoded_url(spark):
    cases = {
        "http://a.org/free%20casino": (0, 2), "http://a.org/%70orn": (1, 0), "http://a.org/%50ORN": (1, 0), "http://a.org/x%2Fporn%2d1": (1, 0), "http://a.org/%C3%A9porn%C3%A9": (1, 0),
        "http://a.org/porn%41": (0, 0), "http://a.org/%2570orn": (0, 0), "http://a.org/100%porn": (1, 0), "http://a.org/%ffporn%": (1, 0), "http://a.org/%C3%A9": (0, 0), "%": (0, 0),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(df, rules=()).collect()}
    assert [(got[i].strict_terms, got[i].soft_terms) for i in range(len(cases))] == list(cases.values())
    assert got[0].path == "/free%20casino"  # host and path are the raw URL's


def test_columns_called_as_those_that_are_added(spark):
    df = spark.createDataFrame([(1, "http://a.org/casino-win", "x", "y", "z", "w"), (1, None, "x", "y", "z", "w")], "page_id long, url string, host string, path string, _url string, rule string")
    out = urls.judged(df).collect()
    assert sorted((r.host, r.path) for r in out) == [("", ""), ("a.org", "/casino-win")]
