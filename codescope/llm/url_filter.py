"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

DataFrame operations only; the model is the DataFrame API's own logistic regression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions.text import let

from .tables import aside

NGRAMS = (3, 4)
FEATURES = 1 << 14
#: A host of which the labelled table says nothing gets about a half at most; blocking takes evidence beyond that.
BLOCK_FROM = 0.7
#: Rules are literals of the plan, so their number is bounded.
MAX_RULES = 1_000

# A small labelled table of invented URLs; 1 is to be blocked.
LABELLED_URLS = (
    ("https://www.cheap-pills-direct.example.com/en/buy/12", 1), ("http://cheap-pills.example.org/fr/4711", 1),
    ("https://best-cheap-meds.example.net/de/pills", 1), ("http://blog.pills-online.example.com/en/981", 1),
    ("https://casino-royal-win.example.net/en/bonus", 1), ("http://win-casino.example.com/es/77?ref=a", 1),
    ("https://m.casino-win-big.example.org/en/1520", 1), ("https://www.casino-jackpot.example.com/de/31", 1),
    ("http://spam-farm-links.example.org/en/5", 1), ("https://www.spam-farm.example.net/fr/60", 1),
    ("https://link-farm-spam.example.com/en/8", 1), ("http://m.spam-mill.example.org/es/14", 1),
    ("https://ads-track-click.example.com/en/2", 1), ("http://m.ads-track.example.net/en/346", 1),
    ("https://track-ads.example.org/de/click", 1), ("http://ads-banner-track.example.com/fr/92", 1),
    ("https://free-xxx-video.example.net/en/11", 1), ("http://www.hot-xxx-cams.example.com/de/6", 1),
    ("https://payday-loan-fast.example.org/en/43", 1), ("http://quick-loan-cash.example.com/es/210", 1),
    ("https://warez-crack-keygen.example.net/en/7", 1), ("http://torrent-crack.example.org/fr/18", 1),
    ("https://replica-watch-sale.example.com/en/55", 1), ("http://cheap-replica.example.net/de/305", 1),
    ("https://poker-bet-win.example.org/en/640", 1), ("http://bet-bonus-casino.example.net/fr/9", 1),
    ("https://malware-download.example.com/en/exe", 1), ("http://phish-login-verify.example.org/en/27", 1),
    ("https://www.library.example.org/en/catalogue/12", 0), ("http://blog.gardener.example.com/en/981", 0),
    ("https://city-museum.example.net/de/31", 0), ("https://m.weather-report.example.org/en/1520", 0),
    ("http://university.example.com/fr/4711", 0), ("https://www.cooking-recipes.example.com/en/77", 0),
    ("https://history-society.example.org/es/14", 0), ("http://m.railway-times.example.net/en/346", 0),
    ("https://blog.astronomy.example.com/en/8.html", 0), ("https://open-source-docs.example.org/en/5", 0),
    ("http://www.chess-club.example.com/de/6", 0), ("https://news-daily.example.net/fr/60?page=2", 0),
    ("https://thenther.example.com/en/43", 0), ("http://ertionan.example.org/es/210#top", 0),
    ("https://www.atinger.example.net/en/7", 0), ("http://m.andthes.example.com/fr/18", 0),
    ("https://tionwhere.example.org/de/305", 0), ("https://blog.theroun.example.net/en/640/", 0),
    ("http://edhaor.example.com/en/9", 0), ("https://orestion.example.net/en/27?utm_source=feed", 0),
    ("https://physics-lectures.example.org/en/92", 0), ("http://bird-watching.example.com/en/2", 0),
    ("https://parliament.example.net/fr/11", 0), ("https://www.hospital-advice.example.org/de/55", 0),
    ("http://thandered.example.net/es/71", 0), ("https://m.ingthent.example.com/en/2200", 0),
    ("https://music-school.example.com/es/19", 0), ("http://forest-walks.example.org/en/404", 0),
)


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits, as a struct with ``rule`` and ``verdict``, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the longer host
    wins, then block.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(set(rules), key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"))
    for verdict, rule_host, rule_path in ordered:  # the last that fits wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        this = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, this).otherwise(best)
    return best


def _grams(kind: str, text: Column) -> Column:
    """All runs of ``NGRAMS`` characters of ``text`` between its marks. The characters are parted once and then met by
    place, so work is in proportion to the length."""
    def of(characters: Column, size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(characters) - size, F.lit(0)))
        return F.transform(
            starts, lambda i: F.concat_ws("", F.lit(kind), *[F.get(characters, i + k) for k in range(size)])
        )

    marked = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    grams = let(marked, lambda characters: F.concat(*[of(characters, n) for n in NGRAMS]))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(grams)


def _features(frame: DataFrame) -> DataFrame:
    grams = F.concat(_grams("h:", F.col("_host")), _grams("p:", F.col("_path")))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashed.transform(frame.withColumn("_grams", grams))


def labelled_urls(spark: SparkSession, urls: Sequence[tuple[str, int]] = LABELLED_URLS) -> DataFrame:
    rows = [F.struct(F.lit(url).alias("url"), F.lit(float(label)).alias("label")) for url, label in urls]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on ``labelled(url, label)``, a small table; rows with a null are left out."""
    usable = labelled.where("url is not null and label in (0, 1)").select(
        host_of("url").alias("_host"), path_of("url").alias("_path"), F.col("label").cast("double").alias("label")
    )
    regression = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.02, maxIter=60)
    return regression.fit(_features(usable).select("_features", "label"))


def judged(
    pages: DataFrame,
    model: LogisticRegressionModel,
    rules: Sequence[tuple[str, str, str]] = (),
    block_from: float = BLOCK_FROM,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``p_block``.

    The longest fitting rule decides; else the model blocks from a probability of ``block_from``. Every row is judged
    where it is read. A null url, or one without ``://``, has empty host and path, fits no rule, and gets the model's
    probability for no evidence, like any other empty one. Repeated rows stay; an empty table gives an empty
    result; columns of these names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "p_block"]
    pages, given_back = aside(pages, ["_host", "_path", "_grams", "_features", "_probability", "_rule", "rawPrediction", "prediction"])
    kept = [c for c in pages.columns if c not in new]
    parted = pages.withColumn("_host", host_of("url")).withColumn("_path", path_of("url"))
    scored = model.setProbabilityCol("_probability").transform(_features(parted))
    p = vector_to_array("_probability")[1]
    rule = matched_rule(F.col("_host"), F.col("_path"), rules)
    scored = scored.select(*kept, "_host", "_path", p.alias("p_block"), rule.alias("_rule"))
    chosen = F.when(F.col("p_block") >= block_from, F.lit("block")).otherwise(F.lit("allow"))
    return given_back(scored.select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", chosen).alias("verdict"), "p_block",
    ))
