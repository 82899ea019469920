"""URL verdicts: fixed rules by longest match, and association rules mined by FP-growth, in DataFrame operations only.

Labelled URLs become baskets of tokens plus the item of their label. Tokens that stand in exactly the same URLs are one item, so that
a long URL that is seen often has no combinations of its own. FP-growth finds the combinations that reach a share and an absolute number
of URLs; of the rules for the blocking label those are kept whose confidence is sure (the lower bound of its interval reaches
the limit, so a few URLs alike prove nothing), whose lift is over 1, and that no shorter rule makes redundant. A rule is filed in
an inverted index under its rarest token, so that very common tokens find few rules; a URL meets the rules of its tokens by
an equi-join and matches those whose tokens it has all of.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import cut

BLOCK = "label=block"
#: Between the tokens of an item.
BAR = "\x1f"
#: Fixed rules are one expression of the plan; longer lists belong in a table.
MAX_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits (null if none) and its verdict. ``rules``: (verdict, "host/path"), the first of equals wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, last two labels, path words (digits as one), query keys, a fragment's presence."""
    host, path = host_and_path(url)
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    lower = F.lower(F.regexp_replace(path, r"\d+", "#"))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            tag("scheme", F.array(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            tag("host", F.split(host, r"\.")),
            tag("site", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
            tag("path", F.split(lower, r"[/._-]+")),
            tag("query", F.transform(query, lambda x: F.lower(F.regexp_extract(x, r"^([^=]*)", 1)))),
            F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def sure(good: Column, all_of: Column, z: float) -> Column:
    """The lower end of Wilson's interval of a share, ``z`` standard errors wide."""
    p = good / all_of
    return (p + z * z / (2 * all_of) - z * F.sqrt(p * (1 - p) / all_of + z * z / (4 * all_of * all_of))) / (1 + z * z / all_of)


def merged(baskets: DataFrame, least: int) -> DataFrame:
    """``item`` and ``freq`` of the tokens in at least ``least`` baskets (``id``, ``have``); tokens in exactly the same baskets are one item.

    Two tokens are held equal by how many baskets they have and two hashes of those baskets' ids. An item is its tokens in order, with ``BAR`` between.
    """
    each = baskets.select("id", F.explode("have").alias("token"))
    mark = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("freq") >= least)
    return marks.groupBy("freq", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("token")), BAR).alias("item")).select("item", "freq")


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.5, least: int = 30, z: float = 2.33) -> DataFrame:
    """Blocking rules from ``url`` and ``bad`` (boolean): ``items``, ``key`` (a token of the rarest item; a row for each), ``confidence``, ``support``.

    A rule holds for at least a share ``support`` and a number ``least`` of the labelled rows, and its confidence is at least ``confidence`` with ``z`` standard
    errors to spare. A rule goes if one with fewer of its items is as confident. Tokens that the rows do not tell apart are one item, which a URL
    has if it has any of them. Null urls and null labels are left out; no labelled rows, or fewer than ``least``, give no rules.
    """
    rows = labelled.where("url is not null and bad is not null").groupBy("url", "bad").agg(F.count(F.lit(1)).alias("times"))
    rows = cut(rows.withColumn("have", tokens(F.col("url"))).withColumn("id", F.monotonically_increasing_id()))
    seen = rows.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("times"))), F.lit(0)).alias("bad")).first()
    if seen.n < max(1, least):
        return labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, key string")
    need = math.ceil(max(support * seen.n, least) - 1e-9)
    # a URL seen more than once counts as often
    baskets = cut(rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(F.struct("id", "_i").alias("id"), "have", "bad"))
    items = cut(merged(baskets, need))
    first = items.select("item", F.split("item", BAR)[0].alias("token"))
    named = baskets.select("id", "bad", F.explode("have").alias("token")).join(first, "token", "left").groupBy("id", "bad").agg(F.collect_list("item").alias("items"))
    named = cut(named.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / named.count(), minConfidence=confidence).fit(named)
    count = F.round(F.col("support") * named.count())
    found = model.associationRules.where(F.col("consequent")[0] == BLOCK).select(F.array_sort("antecedent").alias("items"), "confidence", (count / seen.n).alias("support"), count.alias("n"))
    certain = sure(F.col("n"), F.round(F.col("n") / F.col("confidence")), z) >= confidence
    found = cut(found.where((F.col("confidence") > seen.bad / seen.n) & certain))
    # shorter rules are looked up by their first item
    short = found.select(F.col("items")[0].alias("item"), F.col("items").alias("_items"), F.col("confidence").alias("_c"))
    covers = (F.size("_items") < F.size("items")) & (F.col("_c") >= F.col("confidence") - 1e-12) & (F.size(F.array_except("_items", "items")) == 0)
    beaten = found.select("items", "confidence", F.explode("items").alias("item")).join(short, "item").where(covers).select("items").distinct()
    each = found.join(beaten, "items", "left_anti").withColumn("item", F.explode("items")).join(items, "item")
    rules = each.groupBy("items", "confidence", "support").agg(F.min(F.struct("freq", "item")).getField("item").alias("rare"))
    return cut(rules.withColumn("key", F.explode(F.split("rare", BAR))).drop("rare"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and ``confidence`` (of the best rule) for each different url that a mined rule blocks."""
    each = urls.where("url is not null").select("url").distinct().withColumn("have", tokens(F.col("url")))
    met = each.withColumn("key", F.explode("have")).join(rules.select("key", "items", "confidence"), "key")
    has_all = F.forall("items", lambda i: F.arrays_overlap(F.split(i, BAR), F.col("have")))
    return met.where(has_all).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``confidence`` (of the mined rule, else null).

    A fixed rule decides; where none fits, a URL that a mined rule matches is blocked and any other allowed. Defined cases: a null
    url and one without ``://`` have empty host and path, fit no rule and are allowed unless mined tokens block them;
    repeated rows are judged alike; columns of these names that are there already are replaced; empty gives empty.
    """
    docs = pages.drop("host", "path", "rule", "verdict", "confidence")
    host, path = host_and_path(F.col("url"))
    docs = docs.withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    docs = docs.withColumn("rule", rule).withColumn("_fixed", verdict)
    found = match(docs.where("rule is null"), mined)
    docs = docs.join(found, "url", "left")
    return docs.withColumn("verdict", F.coalesce("_fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))).drop("_fixed")
