"""URL filters: fixed host and path rules, then association rules mined from labelled pages.

The words of a URL (host labels, path segments, extension, query names) and a sign for unwanted pages are the items of
FP-growth. Rules that lead to the sign are kept when support, confidence and lift are high enough and no rule with
fewer words is as sure. They match by an inverted index: each rule is filed under its rarest word, and a
URL that holds this word is tested for the rest. Rules are bounded by the support, whatever the number of pages.
Words that stand on the same labelled pages throughout are mined as one, since each of their sets would be an itemset;
in a rule each of them stands for all, as the rules of one word alone are as sure as those of several. Words that stand on unwanted pages only are
rules by themselves, of confidence 1: no rule of more words is surer, so they leave the baskets before sets are mined, and
unwanted pages that share many words make no sets of these.

Everything is DataFrame, SQL or Spark ML; no Python runs on the executors. A null URL or one without ``://`` has an
empty host and path and no words; null labels are ignored; without any labelled page there are no mined rules;
repeated rows are judged one by one, rows with equal URLs alike; an empty table gives an empty result. A very long URL is judged whole, by all of its words. Other columns,
also of clashing names, are not read. Rules as sure as a narrower one give way to it; of rules that match, the surest counts.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written

MIN_SUPPORT = 0.002
#: Pages that a rule must rest on at least, where the support asks for fewer.
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
UNWANTED = "label:unwanted"
#: Groups over which the pages of one URL are dealt.
SALTS = 64

# Rules by host, then path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and the rest of each URL."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("after", r"^[^/?#]*", 0)
    tail = F.expr("substring(after, char_length(raw_host) + 1)")
    return (
        pages.withColumn("after", F.coalesce(rest, F.lit("")))
        .withColumn("raw_host", host)
        .withColumn("tail", tail)
        .withColumn("host", _lower(F.col("raw_host")))
        .withColumn("path", F.regexp_extract("tail", r"^[^?#]*", 0))
    )


def _base_rule() -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _words() -> Column:
    """Distinct words of a URL, with their place; numbers count as one word."""
    named = lambda kind, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    plain = F.regexp_replace("path", r"\d+", "0")
    query = F.regexp_extract("tail", r"\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            named("host:", F.split("host", r"\.")),
            named("path:", F.split(plain, "/")),
            named("query:", F.split(F.regexp_replace(query, "=[^&]*", ""), "&")),
            F.when(F.col("tail").contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def _alike(baskets: DataFrame, pages: int) -> DataFrame:
    """Words of ``pages`` baskets or more by the first of those in the same baskets: word, freq, bad (unwanted ones of these), alike.

    The same baskets have the same sum of hashes. The support bounds the rows, and the words within them.
    """
    bad = F.array_contains("items", UNWANTED).cast("long").alias("bad")
    words = baskets.select(F.xxhash64("items").cast("decimal(20,0)").alias("mark"), bad, F.explode("items").alias("word"))
    counted = words.filter(F.col("word") != UNWANTED).groupBy("word").agg(F.count("*").alias("freq"), F.sum("bad").alias("bad"), F.sum("mark").alias("mark"))
    return (
        counted.filter(F.col("freq") >= pages)
        .groupBy("freq", "bad", "mark")
        .agg(F.min("word").alias("word"), F.sort_array(F.collect_set("word")).alias("alike"))
        .select("word", "freq", "bad", "alike")
    )


def mined_rules(urls: DataFrame, labels: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT) -> DataFrame:
    """Rules (words, confidence, support, lift, groups, key): URL words that lead to unwanted pages.

    A rule fits a URL with a word of each group; it has a row for each word of its rarest group.
    """
    unwanted = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = (
        labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max(unwanted).alias("unwanted"))
    )
    baskets = urls.join(known, F.col("page_id") == F.col("labelled")).select(
        F.when(F.col("unwanted"), F.array_append("words", F.lit(UNWANTED))).otherwise(F.col("words")).alias("items")
    )
    baskets = written(baskets.filter(F.size("items") > 0))
    count = max(1, baskets.count())
    least = min(1.0, max(min_support, MIN_PAGES / count))
    alike = written(_alike(baskets, math.ceil(least * count)))
    sure = F.col("freq") == F.col("bad")
    # at most a page's words divided by the support
    spare = [r.word for r in alike.select(F.explode(F.when(sure, F.col("alike")).otherwise(F.array_remove("alike", F.col("word")))).alias("word")).collect()]
    once = baskets.select(F.array_except("items", F.lit(spare)).alias("items")) if spare else baskets
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(once)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == UNWANTED) & (F.col("lift") >= min_lift)).select(
        F.sort_array("antecedent").alias("words"), "confidence", "support", "lift"
    )
    unwanted_pages = baskets.agg(F.count_if(F.array_contains("items", UNWANTED)).alias("unwanted_pages"))  # one row
    alone = alike.filter(sure).crossJoin(unwanted_pages).select(
        F.array("word").alias("words"), F.lit(1.0).alias("confidence"), (F.col("freq") / count).alias("support"), F.try_divide(F.lit(float(count)), F.col("unwanted_pages")).alias("lift")
    )
    rules = written(rules.unionByName(alone.filter(F.col("lift") >= min_lift)))
    wider = rules.select(F.col("words").alias("few"), F.col("confidence").alias("sure"), F.explode("words").alias("word"))
    narrower = rules.select("words", "confidence", F.explode("words").alias("word"))
    beaten = (
        narrower.join(wider, "word")
        .filter((F.size("few") < F.size("words")) & (F.size(F.array_except("few", "words")) == 0) & (F.col("sure") >= F.col("confidence")))
        .select("words")
        .distinct()
    )
    keys = (
        rules.join(beaten, "words", "left_anti")
        .select("words", "confidence", "support", "lift", F.explode("words").alias("word"))
        .join(alike, "word")
        .groupBy("words", "confidence", "support", "lift")
        .agg(F.collect_list("alike").alias("groups"), F.min_by("alike", F.struct("freq", "word")).alias("rarest"))
        .select("words", "confidence", "support", "lift", "groups", F.explode("rarest").alias("key"))
    )
    return written(keys)


def url_filters(pages: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, and the confidence of the best mined rule."""
    rule, verdict = _base_rule()
    urls = parts(pages.select("page_id", "url")).select("page_id", "url", "host", "path", "tail").withColumn("words", _words())
    rules = mined_rules(urls, labels, **limits)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")
    base = urls.select("page_id", "url", salt, "host", "path", rule.alias("rule"), verdict.alias("base"))
    # each URL is matched once for each salt, so that no task gets all pages of one URL
    caught = (
        urls.filter("url is not null")
        .select("url", salt, "words")
        .distinct()
        .select("url", "salt", "words", F.explode("words").alias("key"))
        .join(rules.select("key", "groups", "confidence"), "key")
        .filter(F.forall("groups", lambda g: F.arrays_overlap(g, F.col("words"))))
        .groupBy("url", "salt")
        .agg(F.max("confidence").alias("confidence"))
    )
    return base.join(caught, ["url", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("base", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
