"""URL filtering: listed host rules first, then association rules mined from labelled URLs; DataFrame operations only.

*Listed rules* are a short parameter: (verdict, ``host/path``).  A rule fits its host and all subdomains when the path of the URL starts
with the rule's; the longest fitting rule decides.

*Mined rules.*  Each labelled URL is a transaction of all its tokens and its label, ``block`` or ``allow``.  Spark's FP-growth finds the combinations of at
least ``LEAST`` URLs, whatever the number of URLs.  A combination is a rule for a label if among its URLs that label is likelier than among all: by
``GAIN`` of the way from the label's overall share to certainty, (confidence - share) / (1 - share).  A rule is left out if part of it gains as much for the same label.
Tokens that occur in just the same labelled URLs are one item, the first in order standing for them, since a rule needs no more than one.

*Judging.*  An inverted index leads from the rarest token of a rule to the rule; a hit counts when the URL has all tokens of the rule.  The rule of the largest gain decides
(then block, then the larger support, then the tokens in order); URLs without a hit are allowed.  An index of at most ``INSIDE`` rules is looked up inside the row; a larger
one is joined by token, the rules going out once per salt because a token may be in a third of all URLs.

*Defined results.*  A null URL, or one without ``://``, has an empty host and path and no tokens, so it is allowed.  Equal URLs get equal
verdicts.  Without labels, or with labels of one kind, nothing is mined and nothing but the listed rules blocks.  Long URLs have all their tokens; extra columns of either table are not read.
The number of combinations is that of FP-growth: tokens that are nested in one another, k deep in ``LEAST`` URLs or more, have 2^k.
"""

from __future__ import annotations

import json
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from keysift.sources.staging import Staging

LEAST = 20
GAIN = 0.25
INSIDE = 2000
SALTS = 16
BLOCK, ALLOW = "=block", "=allow"
RULES = "token string, rule_tokens array<string>, verdict string, gain double, confidence double, support bigint"
LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
          ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """(rule, verdict) of the longest listed rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens_of(url: Column) -> Column:
    """Distinct tokens: registered name, words of the labels before it, path segments that are no numbers, ending, query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    name = F.array(F.concat(F.lit("name:"), F.substring_index(host, ".", -2)))
    before = F.when(F.size(labels) > 2, F.slice(labels, 1, F.size(labels) - 2)).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.flatten(F.transform(before, lambda x: F.split(x, "[-_]+"))), lambda x: x != ""),
                        lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.filter(F.split(F.lower(path), "/"), lambda x: (x != "") & ~x.rlike(r"^\d+(\.[a-z]+)?$")),
                           lambda x: F.concat(F.lit("path:"), x))
    ending = F.regexp_extract(F.lower(path), r"\.([a-z]{2,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    ends = F.when(ending != "", F.array(F.concat(F.lit("end:"), ending))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(name, words, segments, ends, keys))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def frequent_items(rows: DataFrame, staging: Staging, least: int = LEAST) -> DataFrame:
    """Of (row, tokens): (token, item, n) of the tokens in at least ``least`` rows; tokens in just the same rows share an item.

    Rows are told by two exclusive-or sums of their numbers' hashes.
    """
    spread = rows.select("row", F.explode("tokens").alias("token"))
    seen = spread.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", F.lit(0))).alias("a"),
                                       F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).filter(F.col("n") >= least)
    seen = staging.write(seen, "tokens")
    first = seen.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return staging.write(seen.join(first, ["n", "a", "b"]).select("token", "item", "n"), "items")


def mine(labelled: DataFrame, staging: Staging, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """Of (tokens, bad): the index (token, rule_tokens, verdict, gain, confidence, support), one row per kept rule; support counts URLs."""
    rows = staging.write(labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    none = staging.spark.createDataFrame([], RULES)
    if not 0 < bad < n:
        return none
    items = frequent_items(rows, staging, least)
    met = (rows.select("row", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
           .groupBy("row").agg(F.collect_set("item").alias("items")))  # no more than the tokens of a URL
    label = F.when(F.col("bad"), BLOCK).otherwise(ALLOW)
    baskets = staging.write(met.join(rows.select("row", "bad"), "row").select(F.array_append("items", label).alias("items")), "baskets")
    size = baskets.count()
    if size < least:
        return none
    model = FPGrowth(itemsCol="items", minSupport=least / size, numPartitions=staging.spark.sparkContext.defaultParallelism).fit(baskets)
    found = staging.write(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    marked = F.array_contains("items", BLOCK) | F.array_contains("items", ALLOW)
    plain = found.filter(~marked).select(F.col("items").alias("rule_tokens"), F.col("freq").alias("support"))
    with_label = found.filter(marked & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~x.isin(BLOCK, ALLOW)).alias("rule_tokens"),
        F.when(F.array_contains("items", BLOCK), "block").otherwise("allow").alias("verdict"), "freq")
    share = F.when(F.col("verdict") == "block", bad / n).otherwise(1 - bad / n)
    rules = (with_label.join(plain, "rule_tokens").withColumn("confidence", F.col("freq") / F.col("support"))
             .withColumn("gain", (F.col("confidence") - share) / (1 - share)).filter(F.col("gain") >= gain))
    rarest = (rules.select("*", F.explode("rule_tokens").alias("token")).join(items.filter("token = item").select("token", "n"), "token")
              .groupBy("rule_tokens", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("token"), *[F.first(c).alias(c) for c in ("gain", "confidence", "support")]))
    index = staging.write(rarest.select("token", "rule_tokens", "verdict", "gain", "confidence", "support"), "rules")
    # a part of a rule has its rarest token among the rule's
    part = index.select("token", F.col("rule_tokens").alias("part"), "verdict", F.col("gain").alias("as_good"))
    beaten = (index.select("rule_tokens", "verdict", "gain", F.explode("rule_tokens").alias("token")).join(part, ["token", "verdict"])
              .filter((F.size("part") < F.size("rule_tokens")) & (F.size(F.array_except("part", "rule_tokens")) == 0) & (F.col("as_good") >= F.col("gain")))
              .select("rule_tokens", "verdict").distinct())
    return staging.write(index.join(beaten, ["rule_tokens", "verdict"], "left_anti").select(index.columns), "index")


def _hit(rule: Column) -> Column:
    """What the best of several rules is chosen by, largest first."""
    return F.struct(rule["gain"].alias("gain"), (rule["verdict"] == "block").alias("block"), rule["support"].alias("support"),
                    F.array_join(rule["rule_tokens"], " ").alias("mined"), rule["verdict"].alias("verdict"), rule["confidence"].alias("confidence"))


def best_rules(rows: DataFrame, index: DataFrame, staging: Staging) -> DataFrame:
    """Of (.., tokens): the same rows with ``hit``, the best rule that fits, or null."""
    few = index.limit(INSIDE + 1).collect()  # the size is checked
    if len(few) <= INSIDE:
        by_token: dict[str, list] = {}
        for r in few:
            by_token.setdefault(r["token"], []).append({k: r[k] for k in ("rule_tokens", "verdict", "gain", "confidence", "support")})
        kind = "map<string,array<struct<rule_tokens:array<string>,verdict:string,gain:double,confidence:double,support:bigint>>>"
        known = F.from_json(F.lit(json.dumps(by_token)), kind)
        there = F.flatten(F.filter(F.transform("tokens", lambda t: F.element_at(known, t)), lambda x: x.isNotNull()))
        fits = F.filter(there, lambda r: F.size(F.array_except(r["rule_tokens"], F.col("tokens"))) == 0)
        return rows.withColumn("hit", F.array_max(F.transform(fits, _hit)))
    numbered = staging.write(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
    spread = numbered.select("_row", "tokens", F.explode("tokens").alias("token"), salt.alias("_salt"))
    salted = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = spread.join(salted, ["token", "_salt"]).filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = met.select("_row", _hit(F.struct(*index.columns)).alias("hit")).groupBy("_row").agg(F.max("hit").alias("hit"))
    return numbered.join(best, "_row", "left").drop("_row")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
          label: str = "quality", rules=LISTED) -> DataFrame:
    """(id, url, host, path, rule, verdict, mined, confidence), one row per row of ``pages``.

    ``labels`` mark ids with 1 (good) or 0 (bad); an id with several labels is bad if any is 0.
    """
    staging = Staging(pages.sparkSession, "url-rules")
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    marks = labels.groupBy(labels[label_id].alias("id")).agg((F.min(label) == 0).alias("bad")).filter("bad IS NOT NULL")
    index = mine(urls.join(marks, "id").select(tokens_of(F.col("url")).alias("tokens"), "bad"), staging)
    staging.drop("labelled", "tokens", "items", "baskets", "itemsets", "rules")
    best = best_rules(urls.select("id", "url", tokens_of(F.col("url")).alias("tokens")), index, staging)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = best.select("id", "url", host.alias("host"), path.alias("path"), "hit")
    ruled = placed.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    return ruled.select("id", "url", "host", "path", "listed.rule", F.coalesce("listed.verdict", "hit.verdict", F.lit("allow")).alias("verdict"),
                        "hit.mined", "hit.confidence")
