"""URL filter: rules first, then logistic regression on hashed character n-grams.

Everything is a DataFrame or SQL expression. Host and path give n-grams of three to five
characters, hashed into ``BUCKETS``; a small labelled table of URLs trains the weights by
damped diagonal Newton steps, each one an aggregation over the labelled rows. Only the
weights, one number per bucket, pass through the driver.

A null url, or one without ``://``, has an empty host and path and is judged by the bias
alone. An empty labelled table gives weights of 0, and every url is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAMS = 4096, (3, 4, 5)
STEPS, RIDGE = 12, 0.3

# fixed values: the labelled URL table, 1 to block
BLOCKED = [
    "http://casino-win.example.com/en/1", "https://www.casino-online.example.net/play.html", "http://best-casino.example.org/slots?ref=x",
    "https://free-bets.example.com/en/2", "http://sports-bets.example.net/odds/", "https://m.bets-today.example.org/de/3.html",
    "http://cheap-pills.example.com/fr/4", "https://buy-pills.example.net/order", "http://www.pills-shop.example.org/en/5",
    "https://adult-x.example.com/es/6", "http://adult-video.example.net/watch", "https://blog.adult-chat.example.org/en/7",
    "http://ads-track.example.com/en/8#top", "https://ads-click.example.net/pixel", "http://m.track-ads.example.org/en/9",
    "https://spam-farm.example.com/de/10", "http://link-farm.example.net/index.html", "https://www.spam-links.example.org/en/11/",
    "http://poker-win.example.org/en/12", "https://slots-jackpot.example.com/en/13", "http://xxx-tube.example.net/en/14", "https://viagra-cheap.example.org/en/15",
]
ALLOWED = [
    "http://news.example.com/en/1", "https://www.library.example.net/catalogue.html", "http://science.example.org/articles?ref=x",
    "https://weather.example.com/en/2", "http://history.example.net/museum/", "https://m.recipes.example.org/de/3.html",
    "http://university.example.com/fr/4", "https://garden.example.net/plants", "http://www.music.example.org/en/5",
    "https://travel.example.com/es/6", "http://school.example.net/lessons", "https://blog.painter.example.org/en/7",
    "http://theatre.example.com/en/8#top", "https://nation.example.net/atlas", "http://m.thinking.example.org/en/9",
    "https://station.example.com/de/10", "http://health.example.net/index.html", "https://www.northern.example.org/en/11/",
    "http://other.example.org/en/12", "https://motion.example.com/en/13", "http://threads.example.net/en/14", "https://tribune.example.org/en/15",
    "http://blog.question.example.com/en/16?utm_source=feed", "https://www.rather.example.net/fr/17?page=2&ref=x", "http://thatch.example.org/es/18", "https://leather.example.com/de/19",
    "http://brother.example.net/en/20", "https://mention.example.org/en/21", "http://www.cities.example.com/en/22", "https://able.example.net/en/23",
    "http://shire.example.org/en/24", "https://house.example.com/en/25", "http://anthem.example.net/en/26", "https://method.example.org/en/27",
]
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    named = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(named) + 1), r"^[^?#]*", 0)
    return F.translate(named, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule whose host is the url's or above it and whose path begins the url's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.find("/") if "/" in rule else len(rule)
        its_host, its_path = rule[:at], rule[at:]
        fits = ((host == its_host) | F.endswith(host, F.lit(f".{its_host}"))) & F.startswith(path, F.lit(its_path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def buckets(host: Column, path: Column, n_buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the n-grams of both parts, digits taken as one."""
    def grams(mark: str, part: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), F.regexp_replace(part, r"[0-9]+", "0"), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(f"{mark}{n}"), F.substr(text, i, F.lit(n)))), F.lit(n_buckets)).cast("int"))

    return F.array_distinct(F.concat(*[grams(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in GRAMS]))


def margin(slots: Column, weights: list[float]) -> Column:
    """Bias and summed weights; the weights are one constant of the plan."""
    bias, *table = weights
    constant = F.split(F.lit(",".join(f"{w:.6g}" for w in table)), ",").cast("array<double>")
    return F.aggregate(slots, F.lit(bias), lambda total, slot: total + F.get(constant, slot))


def trained(labelled: DataFrame, n_buckets: int = BUCKETS, steps: int = STEPS, ridge: float = RIDGE) -> list[float]:
    """Weights, bias first, from a table (url, label) with labels 0 and 1.

    Every step sums gradient and curvature of each bucket over the labelled rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(buckets(host, path, n_buckets).alias("slots"), F.col("label").cast("double").alias("y")).cache()
    weights = [0.0] * (n_buckets + 1)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-margin(F.col("slots"), weights)))
        pulls = rows.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("slots"))).alias("slot"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), F.size("slots").alias("n"))
        # the curvature is scaled by the number of slots that move together
        sums = pulls.groupBy("slot").agg(F.sum("g").alias("g"), F.sum(F.col("h") * F.col("n")).alias("h")).collect()
        for r in sums:
            at = r["slot"] + 1
            weights[at] += (r["g"] - ridge * weights[at]) / (r["h"] + ridge)
    rows.unpersist()
    return weights


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def judged(pages: DataFrame, weights: list[float], rules: dict[str, str] = RULES) -> DataFrame:
    """All columns with host, path, rule, score (0 to 1, higher: block) and verdict."""
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "score", "verdict"}]
    host, path = host_and_path(F.col("url"))
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    ruled = parts.withColumns({"rule": matching_rule(F.col("host"), F.col("path"), list(rules)), "score": 1 / (1 + F.exp(-margin(buckets(F.col("host"), F.col("path")), weights)))})
    of_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        of_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(of_rule)
    return ruled.withColumn("verdict", F.coalesce(of_rule, F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))))
