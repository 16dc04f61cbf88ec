"""URL filtering: path rules first, then logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions: URLs are split with SQL functions, n-grams
are hashed inside array functions, and each step of the gradient descent is one
aggregation over the small labelled table, whose sums (one a slot) reach the driver.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SLOTS, GRAMS, STEPS, RATE, DECAY = 1 << 13, (3, 4, 5), 30, 4.0, 1e-3
MAX_LABELLED = 5_000
"""Labelled rows that training uses (those of least hashed URL)."""

# A small hand-made table of host names to block and to allow.
BLOCK_NAMES = (
    "cheap-pills casino-win free-bets spam-farm ads-track adult-x online-poker win-lottery fast-loans buy-replica "
    "hot-singles torrent-hub click-bonus xxx-cams viagra-shop crypto-doubler fake-watches pharma-deal sex-chat "
    "slot-jackpot bet-bonus casino-slots cheap-meds pills-shop spam-mailer link-farm ads-server track-pixel "
    "adult-video adult-dating free-casino payday-cash malware-drop phishing-login popup-ads earn-money-fast "
    "poker-bonus free-pills sexy-cams fast-cash lottery-cash replica-watches click-ads porn-video xxx-dating cheap-replica"
).split()
ALLOW_NAMES = (
    "news library university museum recipes weather science garden travel history open-data city-council python-docs "
    "maps bookshop music theatre school research archive journal health sports kitchen photos mountain river "
    "notes forum wiki project people my-garden book-club local-news home-repair bike-tours math-notes bird-watch old-maps "
    "town-library school-news river-trail music-archive city-museum weather-maps garden-club science-journal"
).split()
HELD_OUT = 5
"""Every so many names of the built-in table are left out when its accuracy is measured."""


def labelled_urls(spark: SparkSession, held_out: bool | None = None) -> DataFrame:
    """The built-in labelled table (url, label): every name under a few subdomains, domains and paths.

    ``held_out`` takes only the names that are left out for measuring, or only the others.
    """
    rows = []
    for label, names in ((1, BLOCK_NAMES), (0, ALLOW_NAMES)):
        names = [n for k, n in enumerate(names) if held_out is None or (k % HELD_OUT == HELD_OUT - 1) == held_out]
        for k, (name, zone) in enumerate(product(names, ("example.com", "example.net", "example.org"))):
            sub = ("", "www.", "m.", "blog.")[k % 4]
            path = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2")[k * 7 // 3 % 4].format(k * 7919 % 50_000)
            rows.append((f"http://{sub}{name}.{zone}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def ascii_lower(c: Column) -> Column:
    """A-Z, and nothing else, lower-cased."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host (lower-cased) and path; both are empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def gram_slots(slots: int = SLOTS) -> Column:
    """The distinct slots of the character n-grams of host and path, each set between marks."""

    def of(name: str) -> list[Column]:
        marked = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        out = []
        for n in GRAMS:
            last = F.length(marked) - (n - 1)
            places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            out.append(F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(marked, i, F.lit(n))), F.lit(slots)).cast("int")))
        return out

    return F.array_distinct(F.flatten(F.array(*of("host"), *of("path"))))


def _weights(values: list[float]) -> Column:
    """Weights as one literal, so that a plan holds a string and not thousands of nodes."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def margin(slots: Column, weights: list[float], bias: float) -> Column:
    """The model's log odds: mean-scaled sum of the weights of a URL's slots."""
    w = _weights(weights)
    total = F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.element_at(w, s + 1))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double"))


def train(labelled: DataFrame, steps: int = STEPS, slots: int = SLOTS) -> tuple[list[float], float]:
    """Weights and bias of the logistic regression, by full-batch gradient descent with momentum.

    ``labelled`` has (url, label 1 to block, 0 to allow); null labels are left out, the
    two classes weigh the same.  The table is small by contract, so it is kept in one
    partition and needs no shuffle.
    """
    named = with_parts(labelled.where("label is not null").select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double")))
    chosen = named.orderBy(F.xxhash64("url"), "label").limit(MAX_LABELLED)
    rows = written(chosen.select("label", gram_slots(slots).alias("slots")).coalesce(1), "urls").coalesce(1)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [0.0] * slots, 0.0
    share = F.when(F.col("label") == 1, F.lit(0.5 / counts.get(1.0, 1))).otherwise(F.lit(0.5 / counts.get(0.0, 1)))
    weights, bias, speed, speed_bias = [0.0] * slots, 0.0, [0.0] * slots, 0.0
    for _ in range(steps):
        chance = 1 / (1 + F.exp(-margin(F.col("slots"), weights, bias)))
        wrong = rows.select("slots", ((chance - F.col("label")) * share).alias("e"))
        scaled = wrong.select(F.col("e"), F.explode_outer("slots").alias("slot"), (F.col("e") / F.sqrt(F.size("slots").cast("double"))).alias("g"))
        per_row = wrong.select(F.lit(-1).alias("slot"), F.col("e").alias("g"))
        sums = scaled.select("slot", "g").where("slot is not null").unionByName(per_row).coalesce(1).groupBy("slot").agg(F.sum("g").alias("g")).collect()
        gradient = {r["slot"]: r["g"] for r in sums}
        for s in range(slots):
            speed[s] = 0.9 * speed[s] - RATE * (gradient.get(s, 0.0) + DECAY * weights[s])
            weights[s] += speed[s]
        speed_bias = 0.9 * speed_bias - RATE / 4 * gradient[-1]
        bias += speed_bias
    return weights, bias


def matching_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls where none does.

    A rule is (verdict, "host/path"); it fits its host and all subdomains where the
    path starts with its own.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    The verdict is the longest fitting rule's, else ``block`` where the model's
    probability ``score`` is at least one half.  A null URL, or one without ``://``, has
    empty parts and is judged on these; URLs of any length are read whole.  Repeated rows
    are judged each; other columns are not read; an empty table gives an empty one.
    """
    weights, bias = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    parts = with_parts(pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("_url")), "_url")
    scored = parts.withColumn("score", 1 / (1 + F.exp(-margin(gram_slots(), weights, bias))))
    rule, verdict = matching_rule(rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
