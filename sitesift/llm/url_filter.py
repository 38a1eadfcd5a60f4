"""URL verdicts with DataFrame functions only: rules by host and path, and a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path, trained by gradient descent
from a small labelled URL table.  One step of the descent is one aggregation over that table; at most BUCKETS numbers reach
the driver, whatever the table holds.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .fingerprints import once

BUCKETS = 4096
SIZES = (3, 4)  # characters in an n-gram
ALLOW, BLOCK = "allow", "block"

# The labelled URL table: invented addresses, 1 for those that a corpus should not have.
BLOCKED = """
http://www.best-casino-bonus.test/en/slots  https://casino-royale-win.test/play/22  http://m.win-big-casino.test/de/jackpot
https://free-poker-bets.test/odds/7  http://sport-bets-today.test/en/8123  https://www.bets-and-odds.test/fr/12  https://freebets.test/es/91
http://cheap-pills-online.test/en/4  https://blog.pills-for-less.test/order/17  http://www.cheap-meds.test/buy/pills  https://discount-pills-shop.test/de/9
http://adult-videos.test/watch/5  https://www.adult-chat-x.test/en/551  http://m.xxx-adult.test/fr/31  https://adult-dates.test/es/7
http://ads.click-track.test/pixel/9  https://track-ads-server.test/t/812  http://www.ads-banner.test/img/3  https://m.adtrack.test/en/77
http://link-spam.test/en/page1  https://www.spam-links-farm.test/de/2  http://content-farm-spam.test/fr/18  https://seo-farm.test/es/44
http://free-movies-download.test/crack/1  https://www.keygen-crack.test/warez/6  http://payday-loans-fast.test/en/3  https://quick-loans-win.test/de/5
http://replica-watches-cheap.test/en/21  https://www.hot-singles.test/fr/3  http://lottery-win-prize.test/es/8  https://free-prize-claim.test/en/19
"""
ALLOWED = """
https://www.cityherald.test/en/3312  http://blog.gardening.test/en/771  https://m.railways.test/fr/12044  http://weather.test/de/88
https://www.university.test/es/1207  http://library.test/en/41890  https://news.harbour.test/fr/6521  http://museum.test/de/7710
https://recipes.test/es/2231  http://www.mountains.test/en/902  https://blog.theatre.test/de/33120  http://m.science.test/en/5123
https://orchestra.test/fr/412  http://www.council.test/es/99  https://school.test/en/77812.html  http://blog.nature.test/fr/5509.html
https://history.test/de/12/  http://www.language.test/en/4410/  https://bakery.test/es/318  http://m.astronomy.test/fr/20117
https://journal.test/en/654  http://www.hospital.test/de/71  https://blog.printing.test/en/29001  http://woodwork.test/fr/83
https://thetion.test/en/9321  http://www.thering.test/en/611  https://blog.tionly.test/de/1022  http://restion.test/fr/307
https://m.ingther.test/es/15  http://theres.test/en/28441  https://www.anding.test/de/5150  http://blog.entment.test/en/360.html
https://parliament.test/en/docs/18  http://www.statistics.test/fr/tables/4  https://maps.test/en/region/9  http://forum.cycling.test/de/thread/71
https://www.translation.test/es/word/55  http://poetry.test/en/archive/1890  https://blog.chemistry.test/en/notes/6  http://www.aquarium.test/fr/visit
https://gallery.test/de/rooms/3  http://radio.test/en/programme/7  https://www.football-club.test/en/results/2019  http://harvest-market.test/es/prices
https://open-source.test/en/manual/2  http://www.long-distance-walks.test/de/map  https://north-sea-ferries.test/en/times  http://blog.old-town.test/fr/47
https://thistle.test/en/1530  http://www.thrones.test/de/4021  https://blog.other-shore.test/en/2207  http://threeriver.test/fr/918
https://station.test/en/10833  http://www.nation-building.test/de/640  https://m.reading-room.test/en/3307  http://singing.test/es/72
https://blog.thinking-aloud.test/en/194  http://portable-radio.test/fr/5531  https://www.tablecloth.test/de/828  http://lovely-weather.test/en/61
https://friendly-fire-museum.test/de/250  http://www.finishing-school.test/fr/904  https://m.bookshelf.test/en/7215  http://theology.test/de/3309
https://english-heritage.test/en/486  http://www.fishing-lakes.test/es/17390  https://blog.thread-count.test/fr/240  http://entrance.test/de/1
https://inner-circle-line.test/en/6627  http://www.instruments.test/fr/3180  https://andersen.test/de/41  http://m.ontario-parks.test/en/2502
https://restaurant-guide.test/fr/1150  http://www.retention-ponds.test/en/88  https://blog.herbarium.test/es/3916  http://therapy-dogs.test/en/705
https://thermal-springs.test/de/1284  http://www.ethics.test/en/530  https://m.hesperides.test/es/2096  http://handwriting.test/fr/611
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, y (1: block) of the table above."""
    rows = [(u, 1.0) for u in BLOCKED.split()] + [(u, 0.0) for u in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, y double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the contract cuts them; both empty for null and for a url without ://."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def features(host: Column, path: Column) -> Column:
    """array<int>: the distinct buckets of all n-grams of host and path, ends marked, fields told apart.

    Characters come from one split, bound once, and n-grams from slices, so a long address costs no more a character.
    """

    def grams(field: str, text: Column) -> Column:
        def of(chars: Column, n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(field), F.slice(chars, i, n)), F.lit(BUCKETS)).cast("int"))

        return once(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda chars: F.concat(*[of(chars, n) for n in SIZES]))

    return F.array_distinct(F.concat(grams("host", host), grams("path", path)))


def logit(weights: list[float], found: Column) -> Column:
    """The bias (last weight) and the mean-scaled sum of the weights of the buckets found."""
    table = F.from_json(F.lit(str(weights)), "array<double>")  # folded to one constant of BUCKETS + 1 numbers
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return total / F.sqrt(F.size(found).cast("double")) + F.lit(weights[-1])


def train(labelled: DataFrame, rows: int = 2_000, rounds: int = 30, rate: float = 8.0, ridge: float = 2e-4) -> list[float]:
    """BUCKETS weights and a bias, from at most ``rows`` labelled URLs (url, y in 0 and 1; the first by a hash of the url).

    Gradient descent with momentum; a round sums the gradient by bucket in one aggregation.  Both labels weigh the same,
    however many rows each has, as the table says nothing of how often they occur elsewhere.  Sums are of integers
    (errors scaled by 2^32), so the order in which rows arrive does not change a digit.  Rows with a null label or url
    are left out; without any row all weights are 0, which allows every url.
    """
    some = labelled.filter("url is not null and y is not null").orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    host, path = host_and_path(F.col("url"))
    known = stage(some.select(features(host, path).alias("found"), F.col("y").cast("double").alias("y")).coalesce(1), "urls")
    known = known.coalesce(1)  # one small file: a round is one task
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(size.values())
    share = F.when(F.col("y") > 0.5, n / (2 * size.get(1.0, n or 1))).otherwise(n / (2 * size.get(0.0, n or 1)))
    weights, speed = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    for _ in range(rounds if n else 0):
        error = (1 / (1 + F.exp(-logit(weights, F.col("found")))) - F.col("y")) * share
        scaled = lambda e: F.round(e * 2.0**32).cast("long")
        rows_ = known.select(error.alias("e"), "found").select("e", F.explode(F.concat("found", F.array(F.lit(BUCKETS)))).alias("b"), F.size("found").alias("k"))
        each = F.when(F.col("b") < BUCKETS, F.col("e") / F.sqrt(F.col("k").cast("double"))).otherwise(F.col("e"))
        gradient = {r.b: r.g / 2.0**32 / n for r in rows_.groupBy("b").agg(F.sum(scaled(each)).alias("g")).collect()}
        for b in range(BUCKETS + 1):
            speed[b] = 0.9 * speed[b] - rate * (gradient.get(b, 0.0) + (ridge * weights[b] if b < BUCKETS else 0.0))
            weights[b] += speed[b]
    if not all(map(math.isfinite, weights)):
        raise ArithmeticError("the descent diverged; take a smaller rate")
    return [round(w, 9) for w in weights]


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (host/path) that fits, else null: its host or a subdomain, and the path starts like its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, start = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: dict[str, str], weights: list[float], url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and p_block, the classifier's probability.

    ``rules`` maps host/path to allow or block; where none fits, the classifier decides: block from 0.5 on.  A null
    url or one without :// has empty host and path.  Rows are judged one by one: repeated rows, null page_ids and ties need
    nothing special; an empty table gives no row; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = 1 / (1 + F.exp(-logit(weights, features(F.col("host"), F.col("path")))))
    rows = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), p.alias("p_block"))
    named = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    verdict = F.coalesce(named, F.when(F.col("p_block") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
