"""URL filter: site rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

Terms are sought in the percent-decoded URL. A term counts where it stands alone: no letter or
digit on either side. One strict term or ``SOFT`` distinct soft terms reject a URL. Rules decide
before the vocabulary does, by the URL as it is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Site rules as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _compounds(firsts: Sequence[str], seconds: Sequence[str]) -> tuple[str, ...]:
    """Each first word with each second: written as one, or with a hyphen or underscore between."""
    return tuple(a + between + b for a in firsts for b in seconds for between in ("", "-", "_"))


#: Terms of which one rejects, and terms of which several do. Words that are common in
#: clean URLs (win, cheap, farm, ads, track) count only in compounds that leave no doubt.
STRICT_TERMS = (
    "camgirl", "camgirls", "escorts", "hentai", "porn", "pornhub", "porno", "pornos", "pornstar", "pornstars", "redtube",
    "sexcam", "sexcams", "warez", "xhamster", "xvideos", "xxx", "youporn",
    *_compounds(("free", "live", "online", "win"), ("bet", "bets", "betting", "casino", "casinos", "jackpot", "jackpots", "poker")),
    *_compounds(("betting", "casino", "casinos"), ("bonus", "bonuses", "win", "wins")),
    *_compounds(("buy", "cheap", "discount", "order"), ("cialis", "meds", "pills", "viagra", "xanax")),
    *_compounds(("adult",), ("cam", "cams", "chat", "dating", "sex", "video", "videos", "x", "xxx")),
    *_compounds(("free", "live"), ("nudes", "porn", "sex")),
    *_compounds(("link", "spam"), ("farm", "farms")),
    *_compounds(("ad", "ads"), ("click", "clicks", "server", "servers", "track", "tracker", "trackers", "tracking")),
)
SOFT_TERMS = (
    "adult", "adults", "adware", "baccarat", "bet", "bets", "betting", "bettor", "bettors", "blackjack", "bonus", "bonuses",
    "bookie", "bookies", "bookmaker", "bookmakers", "casino", "casinos", "cialis", "clickbait", "crack", "cracked", "cracks",
    "dating", "erotic", "erotica", "escort", "fetish", "free", "freebie", "freebies", "gamble", "gambler", "gamblers",
    "gambling", "hookup", "hookups", "jackpot", "jackpots", "keygen", "keygens", "levitra", "loans", "lotteries", "lottery",
    "lotto", "meds", "milf", "milfs", "naked", "nude", "nudes", "payday", "pharmacies", "pharmacy", "pill", "pills", "poker",
    "popunder", "popunders", "popup", "popups", "promo", "promos", "roulette", "sex", "sexy", "slots", "spam", "spammer",
    "spammers", "spamming", "sportsbook", "sportsbooks", "stripper", "strippers", "striptease", "torrent", "torrents",
    "tracker", "trackers", "tramadol", "valium", "viagra", "wager", "wagering", "wagers", "xanax",
)
SOFT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)


@cache
def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    """One per Python worker and vocabulary."""
    made = ahocorasick.Automaton()
    for term in (*soft, *strict):  # a term in both lists is strict
        made.add_word(term, (term, len(term), term in strict))
    made.make_automaton()
    return made


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def decoded(url: str) -> str:
    """Percent escapes decoded once, A-Z lower-cased. What is no escape stays; bytes that are no UTF-8 become U+FFFD."""
    return unquote(url).translate(_TO_LOWER)


def hits(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Numbers of distinct strict and soft terms that stand alone in a lower-case URL."""
    seen: tuple[set[str], set[str]] = (set(), set())
    for end, (term, length, strict) in found.iter(url):
        start = end - length
        if not (start >= 0 and _word(url[start])) and not (end + 1 < len(url) and _word(url[end + 1])):
            seen[0 if strict else 1].add(term)
    return len(seen[0]), len(seen[1])


def term_hits(url: Column, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS) -> Column:
    """struct(strict, soft): distinct terms that stand alone in the decoded URL. A null URL has none."""
    kind = pa.struct([("strict", pa.int32()), ("soft", pa.int32())])
    strict, soft = tuple(strict), tuple(soft)

    @F.arrow_udf("strict int, soft int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton(strict, soft) if strict or soft else None
        for urls in batches:
            pairs = [hits(decoded(u), found) if u and found else (0, 0) for u in urls.to_pylist()]
            yield pa.array([{"strict": a, "soft": b} for a, b in pairs], kind)

    return count(url)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(
    df: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, several: int = SOFT,
) -> DataFrame:
    """(id, host, path, rule, verdict, strict_terms, soft_terms) per row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    decides, and of equally long ones the first listed. Null URLs have an empty host and path,
    fit no rule and hold no term, so they are allowed. Each row is judged alone and whole, so repeated
    rows and URLs of any length have one verdict each; an empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    d = df.select(F.col(f"`{id}`"), F.col(f"`{url}`").alias("_url"))
    d = d.select(F.col(f"`{id}`"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), term_hits(F.col("_url"), strict, soft).alias("_hits"))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= several), "block").otherwise("allow")
    for host, path, says in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return d.select(
        F.col(f"`{id}`"), "host", "path", rule.alias("rule"), verdict.alias("verdict"),
        F.col("_hits.strict").alias("strict_terms"), F.col("_hits.soft").alias("soft_terms"),
    )
