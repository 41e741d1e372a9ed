"""URL filters by association rules, in DataFrame operations only.

Fixed rules decide the URLs they fit. Their verdicts are the labels for all others: FP-growth
mines combinations of URL tokens that go with a verdict, rules below a support or a confidence
are pruned, and the rest match by an inverted index from token to rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.llm.common import keep

#: (rule, verdict): a host with all its subdomains, then a path prefix.
FIXED_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
SUPPORT = 0.005
CONFIDENCE = 0.8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens_of(url: str = "url") -> Column:
    """Distinct tokens, marked h, p or q for host, path or what follows it, sorted; numbers are one token."""
    rest = F.coalesce(F.regexp_extract(url, "://[^?#]*(.*)", 1), F.lit(""))

    def marked(part: Column, mark: str) -> Column:
        words = F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))

    parts = F.concat(marked(F.col("host"), "h:"), marked(F.col("path"), "p:"), marked(rest, "q:"))
    return F.sort_array(F.array_distinct(parts))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens array, verdict, confidence, support) from rows of (tokens, verdict)."""
    mark = "verdict:"
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return labelled.select("tokens", "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=parts).fit(baskets)
    verdict = F.col("consequent")[0]
    return model.associationRules.filter(F.startswith(verdict, F.lit(mark))).select(
        F.sort_array("antecedent").alias("tokens"), F.substring_index(verdict, ":", -1).alias("verdict"), "confidence", "support"
    )


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence) of the best rule for each row of `token_sets` (tokens, distinct) that some rule fits.

    A token leads to its rules; a rule fits if all its tokens lead to it. The most confident one
    wins, then the best supported, the longest, and the first by its tokens.
    """
    index = rules.select(
        F.xxhash64("tokens", "verdict").alias("rule_no"), F.size("tokens").alias("size"), "verdict", "confidence", "support",
        F.array_join("tokens", " ").alias("name"), F.explode("tokens").alias("token"),
    )
    each = token_sets.select("tokens", F.explode("tokens").alias("token"))
    hits = each.join(index, "token").groupBy("tokens", "rule_no").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "verdict", "confidence", "support", "name"))
    )
    rank = F.struct(-F.col("confidence"), -F.col("support"), -F.col("size"), "name", "verdict", "confidence")
    return hits.filter("n = size").groupBy("tokens").agg(F.min(rank).alias("best")).select("tokens", "best.verdict", "best.confidence")


def judge(
    pages: DataFrame,
    *,
    rules: tuple[tuple[str, str], ...] = FIXED_RULES,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url; other columns are ignored).

    `rule` is the longest fixed rule that fits, else null, when the mined rules decide and
    `allow` stands where none fits. A null url, or one without ://, has empty parts and no
    tokens. Repeated rows stay. An empty table gives an empty result; without labelled URLs
    no rules are mined.
    """
    rule, verdict = fitting_rule(rules)
    parts = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"))
    judged = parts.withColumns({"rule": rule, "fixed": verdict, "tokens": tokens_of()}).drop("url")
    mined_rules = keep(mined(judged.filter("rule is not null").select("tokens", F.col("fixed").alias("verdict")), support, confidence))
    open_sets = judged.filter("rule is null").select("tokens").distinct()
    best = keep(matched(open_sets, mined_rules)).select(F.col("tokens").alias("_tokens"), F.col("verdict").alias("_verdict"))
    wanted = F.when(F.col("rule").isNull(), F.col("tokens"))
    return judged.join(best, wanted == F.col("_tokens"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", "_verdict", F.lit(DEFAULT)).alias("verdict")
    )
