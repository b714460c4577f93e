"""URL filter by association rules, under given host and path rules.

Labelled urls become sets of tokens with a class token; FP-growth finds the frequent sets,
and rules from tokens to the bad class are kept by support, confidence and lift. Rules are
indexed by their rarest token; a url meets only the rules under its own tokens and is then
checked for all tokens of each. A given rule decides first where one fits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import stage
from voxmill.session import broadcast_within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


@dataclass(frozen=True)
class Rule:
    verdict: Literal["allow", "block"]
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the url query applies.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host_ == rule.host) | F.endswith(host_, F.lit("." + rule.host))) & F.startswith(path_, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels and the host's end, path segments with digits blurred, keys of the query."""
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    end = F.concat(F.lit("t:"), F.regexp_extract(host(url), r"([^.]*)$", 1))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    made = F.array_distinct(F.concat(labels, F.array(end), segments, keys))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.filter(made, lambda x: F.length(x) > 2)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.001, least_rows: int = 20, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """Rules (rule_id, antecedent, key_token, support, confidence, lift) from rows (url, bad).

    A set must occur in ``min_support`` of the labelled urls and in ``least_rows`` of them. Null
    urls and labels are left out. Without labelled rows, or without bad ones, there is no rule.
    """
    rows = labelled.where("url is not null and bad is not null")
    baskets = rows.select(F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens(F.col("url"))).alias("items"))
    baskets = stage(baskets.where(F.size("items") > 0))
    total = baskets.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, key_token string, support double, confidence double, lift double")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least_rows / total)), minConfidence=min_confidence).fit(baskets).freqItemsets
    sets = stage(sets.select(F.sort_array("items").alias("items"), "freq"))
    bad_total = sets.where(F.col("items") == F.array(F.lit(BAD))).select("freq").first()
    singles = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("both"))
    confidence = F.col("both") / F.col("freq")
    lift = confidence / F.lit((bad_total["freq"] if bad_total else total) / total)
    kept = with_bad.join(sets, "items").select("items", (F.col("both") / total).alias("support"), confidence.alias("confidence"), lift.alias("lift")).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    keyed = kept.select("*", F.explode("items").alias("token")).join(singles, "token").groupBy("items", "support", "confidence", "lift").agg(F.min_by("token", F.struct("token_freq", "token")).alias("key_token"))
    return keyed.select(F.xxhash64("items").alias("rule_id"), F.col("items").alias("antecedent"), "key_token", "support", "confidence", "lift")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, confidence, antecedent): the strongest mined rule of each distinct url that has one."""
    index = broadcast_within(rules.select(F.col("key_token").alias("token"), "antecedent", "confidence"), F.size("antecedent") + 2)
    looked = urls.where("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("own"))
    met = looked.select("url", "own", F.explode("own").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "own")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("best"))
    return best.select("url", "best.confidence", "best.antecedent")


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, **pruning: float) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, confidence), one for each row of ``pages``.

    A given rule's verdict stands; else a page is blocked if a mined rule matches its url and
    allowed if none does. Null urls have an empty host and path and are allowed.
    """
    found = matches(pages, stage(mine(labelled, **pruning))).withColumnRenamed("url", "_url")
    joined = pages.select("page_id", "url").join(found, F.col("url") == F.col("_url"), "left")
    shown = joined.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "confidence")
    by_rule = shown.withColumn("given", given(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return by_rule.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "confidence")
