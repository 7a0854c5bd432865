"""URL filtering by rules and a ratio of character language models.

A rule is `host/path`; it fits its host and all subdomains, for paths that
start with the rule's.  The longest fitting rule decides a URL.  The URLs that
rules decide also teach two models, one of accepted and one of rejected URLs,
and the others are judged by them.

A model is a smoothed Markov model of variable order: the chance of a
character behind the ``ORDER`` characters before it mixes all shorter contexts
(Witten-Bell: a context weighs as often as it was seen, the next shorter one
as often as it had new successors; a context the class never saw counts for
nothing).  A URL's score is the difference of the two log likelihoods divided
by its number of characters (and the end).  Four fifths of the distinct
labelled URLs (by the text's md5) are counted; on the rest the threshold is
calibrated: it minimises the sum of the two error rates, and lies in the middle
of the scores that do so equally well.

All steps are DataFrame operations:

* distinct URLs are cut into (ORDER + 1)-grams, summed in the map tasks; all
  shorter grams are sums of the distinct long ones.  Counts cover every URL of
  the table and grow with it;
* the chances are computed level by level: a gram meets its own tail, so a key
  meets at most as many rows as there are characters;
* URLs meet the scores of their grams in a join.  Grams with at least one
  10,000th of all places (10,000 of them at most) are broadcast, so no key of
  the shuffled join has more than a 10,000th of the rows;
* log ratios are whole millionths, so sums do not depend on the order of rows.

Edge cases: a null url or one without '://' has empty host and path, fits no
rule, and is judged by its whole text (null: by the empty text).  Repeated rows
and URLs give repeated rows with equal verdicts; each distinct URL is counted
once.  If no accepted or no rejected URL was counted, all scores are 0 and the
threshold is 0, so undecided URLs are allowed; if none was left to calibrate
with, the threshold is 0.  Other columns never reach the operator; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import attach_scalars
from ..operators.lineage import materialize
from .common import partitions_for

#: Characters of context, part of the labelled URLs kept for calibration,
#: frequency (one in so many) from which a gram is broadcast.
ORDER, FOLDS, HOT = 5, 5, 10_000
#: Rows of the table per partition of distinct URLs.
URLS_EACH = 8_000
#: Scores are calibrated in steps of 1/STEPS, between -BOUND and BOUND.
STEPS, BOUND = 100, 20
_BEGIN, _END, _MICRO = "\x02", "\x03", 1_000_000


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the text that the models read."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    text = F.when(at > 0, F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)$", 1))).otherwise(url)
    return host, path, text


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule (of equally long ones
    the first in alphabetical order), or null.  The list is part of the plan."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        own_host, slash, rest = rule.partition("/")
        if not slash or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """All (ORDER + 1)-grams of a text; it begins with ORDER marks and ends
    with one.  The array of characters is made once a text (as the variable of
    a lambda), so long texts cost no more a place."""
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    marked = F.concat(F.array_repeat(F.lit(_BEGIN), ORDER), chars, F.array(F.lit(_END)))
    return F.transform(F.array(marked), lambda m: F.transform(
        F.sequence(F.lit(0), F.size(m) - (ORDER + 1)),
        lambda k: F.concat(*[F.get(m, k + d) for d in range(ORDER + 1)])))[0]


def _levels(counted: DataFrame) -> DataFrame:
    """gram, level (its length) and, per class, its count, and for its context
    (all but the last character) count and number of successors; n_chars: on
    level 1, how many characters there are."""
    tails = counted.select(F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("level"),
                           "gram", "accepted", "rejected")
    tails = (tails.groupBy(F.expr("right(gram, level)").alias("gram"), "level")
             .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    context = Window.partitionBy("level", F.expr("left(gram, level - 1)"))
    for c in ("accepted", "rejected"):
        tails = (tails.withColumn(f"{c}_all", F.sum(c).over(context))
                 .withColumn(f"{c}_kinds", F.count_if(F.col(c) > 0).over(context)))
    return tails.withColumn("n_chars", F.count(F.lit(1)).over(context))


def gram_scores(counted: DataFrame) -> DataFrame:
    """gram, ratio: log ratio of the last character's chances, in millionths.
    ``counted``: gram, accepted, rejected."""
    tables = materialize(_levels(counted))
    shorter = None
    for level in range(1, ORDER + 2):
        own = tables.filter(F.col("level") == level)
        if shorter is None:
            own = own.withColumns({f"p_{c}": 1.0 / F.col("n_chars") for c in ("accepted", "rejected")})
        else:
            tail = F.expr(f"right(gram, {level - 1})")
            own = own.withColumn("tail", tail).join(shorter, "tail")
        seen = {c: F.when(F.col(f"{c}_all") > 0,
                          (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}"))
                          / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}"))
                for c in ("accepted", "rejected")}
        shorter = own.select(F.col("gram").alias("tail"), *[p.alias(f"p_{c}") for c, p in seen.items()])
    ratio = F.round((F.ln("p_accepted") - F.ln("p_rejected")) * _MICRO).cast("bigint")
    return shorter.select(F.col("tail").alias("gram"), ratio.alias("ratio"))


def scores(urls: DataFrame) -> DataFrame:
    """``urls``: distinct (id, text, label, counted), label 'allow', 'block' or
    null, counted whether the models learn from it.  id and score of all rows
    that are not counted."""
    at = (urls.select("id", "counted",
                      (F.col("counted") & (F.col("label") == "allow")).cast("bigint").alias("a"),
                      (F.col("counted") & (F.col("label") == "block")).cast("bigint").alias("b"),
                      F.explode(grams(F.col("text"))).alias("gram")))
    counted = materialize(at.groupBy("gram").agg(
        F.sum(F.coalesce("a", F.lit(0))).alias("accepted"), F.sum(F.coalesce("b", F.lit(0))).alias("rejected"),
        F.count_if(~F.col("counted")).alias("places")))
    ratios = gram_scores(counted).join(counted.select("gram", "places"), "gram")
    ratios = materialize(attach_scalars(ratios, counted.agg(
        F.sum("places").alias("all_places"),
        (F.max("accepted") > 0).alias("any_accepted"), (F.max("rejected") > 0).alias("any_rejected")))
        .select("gram", F.when(F.col("any_accepted") & F.col("any_rejected"), F.col("ratio")).otherwise(0)
                .alias("ratio"), (F.col("places") * HOT >= F.col("all_places")).alias("hot"), "places")
        .filter("places > 0"))
    # at most HOT rows: their places add up to all places
    hot = F.broadcast(ratios.filter("hot").select("gram", "ratio"))
    met = at.filter(~F.col("counted")).select("id", "gram").join(hot, "gram", "left")
    cold = (met.filter(F.col("ratio").isNull()).select("id", "gram")
            .join(ratios.filter("not hot").select("gram", "ratio"), "gram"))
    every = met.filter(F.col("ratio").isNotNull()).select("id", "ratio").union(cold.select("id", "ratio"))
    return every.groupBy("id").agg((F.sum("ratio") / F.count(F.lit(1)) / _MICRO).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, ``threshold``, from (score, label) of calibration URLs."""
    bound = BOUND * STEPS
    step = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-bound)), F.lit(bound))
    found = (scored.groupBy(step.alias("step"))
             .agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b")))
    steps = scored.sparkSession.range(-bound, bound + 1, numPartitions=1).withColumnRenamed("id", "step")
    every = steps.join(found, "step", "left").fillna(0, ["a", "b"])
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # 2 * bound + 1 rows; accepted from the step on: wrong are accepted below, rejected from it
    lost, all_a, all_b = F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(whole), F.sum("b").over(whole)
    let_in = all_b - F.coalesce(F.sum("b").over(below), F.lit(0))
    wrong = every.select("step", (lost * all_b + let_in * all_a).alias("wrong"), (all_a * all_b).alias("any"))
    best = wrong.withColumn("least", F.min("wrong").over(whole)).filter("wrong = least")
    return best.agg(F.coalesce(F.when(F.max("any") > 0, (F.min("step") + F.max("step")) / 2 / STEPS),
                               F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict ('allow' or 'block') and score (null
    where a rule decides) of every row of ``pages`` (page_id, url)."""
    host, path, text = parts(F.col("url"))
    pages = (pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
             .withColumn("by", fitting_rule(F.col("host"), F.col("path"), rules)))
    label = F.col("by.verdict")
    # a URL becomes some dozens of rows, so few make a partition
    urls = pages.select("text", label.alias("label")).distinct().repartition(partitions_for(pages, URLS_EACH))
    held = F.conv(F.right(F.md5("text"), F.lit(8)), 16, 10).cast("bigint") % FOLDS == 0
    urls = materialize(urls.select(F.monotonically_increasing_id().alias("id"), "text", "label",
                                   (F.col("label").isNotNull() & ~held).alias("counted")))
    scored = materialize(urls.filter(~F.col("counted")).join(scores(urls), "id").select("text", "label", "score"))
    limit = threshold(scored.filter(F.col("label").isNotNull()))
    rest = attach_scalars(scored.filter(F.col("label").isNull()).select("text", "score"), limit)
    rest = rest.select("text", "score", F.when(F.col("score") >= F.col("threshold"), "allow")
                       .otherwise("block").alias("verdict"))
    decided = pages.filter(label.isNotNull()).select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"), label.alias("verdict"),
        F.lit(None).cast("double").alias("score"))
    judged = pages.filter(label.isNull()).join(rest, "text").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict", "score")
    return reduce(DataFrame.union, [decided, judged])
