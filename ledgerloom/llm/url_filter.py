"""URL filters: host and path rules, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame expressions and pyspark.ml stages, which run in the JVM.  The model is trained from a small
table of labelled URLs; a rule that fits decides before the model does.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed n-grams, their lengths, and the strength of the penalty.
FEATURES, LENGTHS, PENALTY = 1 << 14, (3, 4, 5), 0.003
#: (rule, verdict): host/path; the longest that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, _, rule_path = rule.partition("/")
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule = F.coalesce(*[F.when(_fits(host, path, r), F.lit(r)) for r, _ in ordered])
    verdict = F.coalesce(*[F.when(_fits(host, path, r), F.lit(v)) for r, v in ordered])
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """The marked character n-grams of a text between its bounds."""
    bounded = F.concat(F.lit("^"), text, F.lit("$"))

    def of_length(chars: Column, n: int) -> Column:
        # one argument only: a second one would be taken for the place in the array
        grams = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, F.lit(n)), "")))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    # the text is cut into characters once, and a variable of the outer function stands for them in the inner ones
    characters = F.regexp_extract_all(bounded, F.lit("(?s)."), F.lit(0))
    return F.get(F.transform(F.array(characters), lambda chars: F.concat(*[of_length(chars, n) for n in LENGTHS])), F.lit(0))


def with_ngrams(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path) with the feature vector of their n-grams."""
    grams = urls.withColumn("_grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(grams)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): a small table of made-up URLs; label 1 is to be blocked.

    Its origin: a rule over the words below, which were written by hand after the categories that public block lists
    have (adult, gambling, drugs, adverts and tracking, malware, fraud) and after everyday topics.  No crawl and no
    given table was read for it.  Common words of site names go with both kinds, paths and top domains too, and names
    of made-up syllables are wanted, so only a host's own words speak against it.
    """
    # Words of unwanted hosts, of wanted ones, and of both.
    unwanted = ("adult", "porn", "xxx", "sex", "cams", "escorts", "nude", "casino", "bets", "betting", "poker", "slots", "jackpot", "roulette", "pills", "pharmacy", "viagra", "steroids", "meds", "ads", "adserver", "advert", "tracker", "track", "banners", "popups", "clicks", "warez", "keygen", "cracks", "malware", "torrents", "spam", "scam", "phishing", "lottery", "prizes", "loans", "replica", "fakes")
    wanted = ("library", "university", "museum", "gazette", "weather", "recipes", "science", "history", "garden", "council", "letters", "journal", "school", "theatre", "music", "forest", "river", "bridge", "station", "kitchen", "travel", "photo", "novel", "poetry", "physics", "biology", "market", "village", "harbour", "mountain", "castle", "festival", "football", "cycling", "hospital", "charity", "parish", "archive", "atlas", "railway")
    both = ("free", "cheap", "best", "online", "win", "club", "zone", "world", "farm", "x", "hot", "my", "top", "shop", "house", "city")
    heads, tails = ("b", "d", "g", "l", "m", "n", "p", "r", "s", "t", "th", "v"), ("an", "en", "in", "on", "er", "or", "es", "ed", "at", "ing", "ly", "ou")
    tops, fronts, paths = ("com", "org", "net"), ("", "www.", "m.", "blog."), ("en/12", "de/850.html", "fr/7/", "es/431", "index.html", "", "it/3?page=2", "about")
    hosts = [(f"{w}-{x}" if (i + j) % 2 else f"{x}-{w}", label) for label, words in ((1.0, unwanted), (0.0, wanted)) for i, w in enumerate(words) for j, x in enumerate(both) if (i + j) % 2]
    hosts += [(f"{w}{words[(i + 7) % len(words)]}", label) for label, words in ((1.0, unwanted), (0.0, wanted)) for i, w in enumerate(words)]
    hosts += [(f"{a}{x}{b}{y}", 0.0) for i, a in enumerate(heads) for j, x in enumerate(tails) for k, b in enumerate(heads) for y in tails[(i + j + k) % 12 :][:1] if (i + 5 * j + 7 * k) % 3 == 0]
    rows = [(f"https://{fronts[k % 4]}{host}.example.{tops[k // 4 % 3]}/{paths[k // 12 % 8]}", label) for k, (host, label) in enumerate(hosts)]
    return spark.createDataFrame(rows, "url string, label double")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """The model of a small labelled table (url, label 1 = block)."""
    host, path = host_and_path(F.col("url"))
    data = with_ngrams(labelled.select(host.alias("host"), path.alias("path"), "label")).coalesce(1)
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=PENALTY, maxIter=30).fit(data.select("_features", "label"))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (allow or block) and score for every row.

    Where no rule fits, the verdict is the model's: block at a score of ``threshold`` or more.  Null and malformed
    URLs have empty host and path and are scored like others; a URL of any length is cut once, so time and memory grow
    in proportion to it; repeated ids are rows like others; an empty table gives no rows; other columns are not read.
    """
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = model.transform(with_ngrams(parts)).withColumn("score", vector_to_array("probability").getItem(1))
    guess = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "score")
