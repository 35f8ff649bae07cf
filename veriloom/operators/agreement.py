"""Agreement between raters, from long ratings (stratum..., item, rater, value).

Everything comes from counts of values by item, never from pairs of ratings: an item with r ratings
costs as many rows as it has different values. Coefficients of all strata (and all bootstrap draws)
are one grouped aggregation. Undefined coefficients are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import rounded
from veriloom.functions.distributions import f_p, normal_p, t_critical

NOMINAL = ("percent_agreement", "gwet_ac1", "fleiss_kappa", "brennan_prediger", "krippendorff_alpha")


def item_counts(ratings: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, item, value, r_ik and r_i; null values don't count."""
    counts = ratings.where("value is not null").groupBy(*by, "item", "value").agg(F.count(F.lit(1)).alias("r_ik"))
    return counts.withColumn("r_i", F.sum("r_ik").over(Window.partitionBy(*by, "item")))


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what their group has; without groups, groups is one row."""
    return rows.join(groups, by) if by else rows.crossJoin(F.broadcast(groups))


def coefficients(ratings: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """One row a group: percent agreement and the chance-corrected coefficients, closed forms.

    weight: a column of counts that an item is taken with (bootstrap draws), else once.
    """
    by = list(by)
    counts = item_counts(ratings, [*by, *([weight] if weight else [])])
    w = F.col(weight) if weight else F.lit(1)
    two = F.col("r_i") >= 2
    value = counts.groupBy(*by, "value").agg(
        F.sum(w * F.col("r_ik") / F.col("r_i")).alias("p"),
        F.sum(F.when(two, w * F.col("r_ik"))).alias("a"),
        F.sum(F.when(two, w * F.col("r_ik") * (F.col("r_ik") - 1) / (F.col("r_i") * (F.col("r_i") - 1)))).alias("agree"),
        F.sum(F.when(two, w * F.col("r_ik") * (F.col("r_ik") - 1) / (F.col("r_i") - 1))).alias("within"),
        F.sum(F.when(two, w * F.col("r_ik") / F.col("r_i"))).alias("items2"),
    )
    total = value.groupBy(*by).agg(
        F.sum("p").alias("n"),
        F.sum("items2").alias("n2"),
        F.sum("agree").alias("agree"),
        F.sum("within").alias("within"),
        F.count(F.lit(1)).alias("q"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum("a").alias("a"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
    )
    pa, q, pp = F.col("pa"), F.col("q"), F.col("pp") / (F.col("n") * F.col("n"))
    chance = lambda pe, p=pa: F.when((q > 1) & (F.lit(1.0) - pe != 0), (p - pe) / (1 - pe))
    total = total.withColumn("pa", F.when(F.col("n2") > 0, F.col("agree") / F.col("n2")))
    a, apart = F.col("a"), F.col("a") * F.col("a") - F.col("aa")
    return total.select(
        *by,
        F.round("n").cast("long").alias("n_items"),
        q.cast("long").alias("n_values"),
        rounded(pa).alias("percent_agreement"),
        rounded(chance((1 - pp) / (q - 1))).alias("gwet_ac1"),
        rounded(chance(pp)).alias("fleiss_kappa"),
        rounded(chance(1 / q)).alias("brennan_prediger"),
        rounded(F.when(apart > 0, 1 - (a - 1) * (a - F.col("within")) / apart)).alias("krippendorff_alpha"),
    )


def conger_kappa(ratings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Chance agreement from each rater's own shares of values."""
    by = list(by)
    rated = ratings.where("value is not null")
    own = rated.groupBy(*by, "rater", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "rater")))
    raters = rated.groupBy(*by).agg(F.count_distinct("rater").alias("raters"))
    # raters without a value have a share of 0 there: sums over all raters, not means over those that have it
    value = own.groupBy(*by, "value").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("ss"))
    joined = value.join(raters, by) if by else value.crossJoin(F.broadcast(raters))
    mean, n = F.col("s") / F.col("raters"), F.col("raters")
    spread = (F.col("ss") - n * mean * mean) / (n - 1)
    chance = joined.groupBy(*by).agg((F.sum(mean * mean) - F.sum(spread / n)).alias("pe"), F.count(F.lit(1)).alias("q"))
    agree = coefficients(ratings, by).select(*by, "percent_agreement")
    both = agree.join(chance, by) if by else agree.crossJoin(F.broadcast(chance))
    pe = F.col("pe")
    return both.select(*by, rounded(F.when((F.col("q") > 1) & (pe != 1), (F.col("percent_agreement") - pe) / (1 - pe))).alias("conger_kappa"))


def krippendorff_interval(ratings: DataFrame, by: list[str] = (), value: str = "value") -> DataFrame:
    """Alpha with squared differences, from sums and sums of squares by item."""
    by = list(by)
    x = F.col(value).cast("double")
    unit = ratings.where(x.isNotNull()).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")).where("m >= 2")
    # within an item the squared differences over ordered pairs sum to 2 (m ss - s^2)
    inside = F.sum(2 * (F.col("m") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    n, s, ss = F.sum("m"), F.sum("s"), F.sum("ss")
    out = unit.groupBy(*by).agg(inside.alias("inside"), n.alias("n"), s.alias("s"), ss.alias("ss"))
    seen, expected = F.col("inside") / F.col("n"), 2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return out.select(*by, rounded(F.when(expected > 0, 1 - seen / expected)).alias("krippendorff_alpha_interval"))


def gwet_inference(ratings: DataFrame, by: list[str] = (), confidence_upper: float = 1.0) -> DataFrame:
    """AC1 with its linearised standard error, p-value (normal) and 95 % bounds (t with n - 1 degrees), the upper capped."""
    by = list(by)
    counts = item_counts(ratings, by)
    p = counts.groupBy(*by, "value").agg(F.sum(F.col("r_ik") / F.col("r_i")).alias("p"))
    shares = _beside(p, p.groupBy(*by).agg(F.sum("p").alias("all"), F.count(F.lit(1)).alias("q")), by).withColumn("share", F.col("p") / F.col("all"))
    items = counts.join(shares.select(*by, "value", "share", "q"), [*by, "value"])
    agree = F.sum(F.col("r_ik") * (F.col("r_ik") - 1)) / (F.first("r_i") * (F.first("r_i") - 1))
    item = items.groupBy(*by, "item").agg(F.when(F.first("r_i") >= 2, agree).alias("pa_i"), F.sum(F.col("r_ik") / F.col("r_i") * (1 - F.col("share"))).alias("e_i"), F.first("q").alias("q"))
    head = coefficients(ratings, by).select(*by, "n_items", "percent_agreement", "gwet_ac1")
    sums = shares.groupBy(*by).agg((F.sum(F.col("share") * (1 - F.col("share"))) / (F.first("q") - 1)).alias("pe"))
    several = item.groupBy(*by).agg(F.count("pa_i").alias("n2"))
    joined = _beside(_beside(_beside(item, head, by), sums, by), several, by)
    k = (F.coalesce(F.col("pa_i"), F.lit(0.0)) * F.col("n_items") / F.col("n2") - F.col("pe")) / (1 - F.col("pe"))
    star = k - 2 * (1 - F.col("gwet_ac1")) * (F.col("e_i") / (F.col("q") - 1) - F.col("pe")) / (1 - F.col("pe"))
    terms = joined.withColumn("d", star - F.col("gwet_ac1"))
    out = terms.groupBy(*by).agg(F.first("gwet_ac1").alias("gwet_ac1"), F.first("n_items").alias("n_items"), F.sqrt(F.sum(F.col("d") * F.col("d")) / (F.first("n_items") * (F.first("n_items") - 1))).alias("se"))
    half = t_critical((F.col("n_items") - 1).cast("double")) * F.col("se")
    return out.select(*by, "gwet_ac1", rounded("se").alias("se"), rounded(F.col("gwet_ac1") - half).alias("ci_lower"), rounded(F.least(F.col("gwet_ac1") + half, F.lit(confidence_upper))).alias("ci_upper"), rounded(normal_p(F.col("gwet_ac1") / F.col("se"))).alias("p_value"))


def concordance(ratings: DataFrame, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """Concordance correlation of two raters: twice the covariance over the variances and the squared mean difference."""
    x, y = (F.max(F.when(F.col("rater") == r, F.col("value").cast("double"))) for r in (first, second))
    pairs = ratings.groupBy(*by, "item").agg(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    gap = F.avg("x") - F.avg("y")
    below = F.var_pop("x") + F.var_pop("y") + gap * gap
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), rounded(F.when(below > 0, 2 * F.covar_pop("x", "y") / below)).alias("ccc"))


def intraclass(ratings: DataFrame, raters: list[str], by: list[str] = ()) -> DataFrame:
    """ICC(1), (2), (3) and their k forms from the two-way sums of squares of complete items, with F and p of ICC(3)."""
    by, k = list(by), len(raters)
    cells = ratings.where(F.col("rater").isin(*raters) & F.col("value").isNotNull()).groupBy(*by, "item", "rater").agg(F.avg(F.col("value").cast("double")).alias("x"))
    whole = cells.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(*by, "item"))).where(F.col("c") == k)
    item = whole.groupBy(*by, "item").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    rows = item.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("t"), F.sum("ss").alias("ss"), (F.sum(F.col("s") * F.col("s")) / k).alias("rows"))
    per = whole.groupBy(*by, "rater").agg(F.sum("x").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("cols"))
    t = rows.join(per, by) if by else rows.crossJoin(F.broadcast(per))
    mean = F.col("t") * F.col("t") / (F.col("n") * k)
    msr, msc = (F.col("rows") - mean) / (F.col("n") - 1), (F.col("cols") / F.col("n") - mean) / (k - 1)
    sse = F.col("ss") - F.col("rows") - F.col("cols") / F.col("n") + mean
    t = t.select(*by, "n", msr.alias("msr"), msc.alias("msc"), (sse / ((F.col("n") - 1) * (k - 1))).alias("mse"), ((F.col("ss") - F.col("rows")) / (F.col("n") * (k - 1))).alias("msw"))
    r, c, e, w, n = (F.col(x) for x in ("msr", "msc", "mse", "msw", "n"))
    forms = {"icc1": (r - w) / (r + (k - 1) * w), "icc2": (r - e) / (r + (k - 1) * e + k * (c - e) / n), "icc3": (r - e) / (r + (k - 1) * e), "icc1k": (r - w) / r, "icc2k": (r - e) / (r + (c - e) / n), "icc3k": (r - e) / r}
    return t.select(*by, n.alias("n_items"), *(rounded(v).alias(x) for x, v in forms.items()), rounded(r / e).alias("f_value"), (n - 1).cast("double").alias("df1"), ((n - 1) * (k - 1)).cast("double").alias("df2"))


def intraclass_p(icc: DataFrame) -> DataFrame:
    return icc.withColumn("p_value", rounded(f_p("f_value", "df1", "df2")))


def pairwise(ratings: DataFrame, by: list[str] = ()) -> DataFrame:
    """For rater pairs r1 < r2 with shared items: their number, percent agreement and AC1. Pairs of raters, not of items, are formed."""
    by = list(by)
    a = ratings.where("value is not null").select(*by, "item", F.col("rater").alias("r1"), F.col("value").alias("v1"))
    b = ratings.where("value is not null").select(*by, "item", F.col("rater").alias("r2"), F.col("value").alias("v2"))
    cells = a.join(b, [*by, "item"]).where("r1 < r2").groupBy(*by, "r1", "r2", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    pair = [*by, "r1", "r2"]
    shares = cells.select(*pair, "n", F.explode(F.array("v1", "v2")).alias("v")).groupBy(*pair, "v").agg((F.sum("n") / 2).alias("m"))
    chance = shares.groupBy(*pair).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count(F.lit(1)).alias("q"))
    same = cells.groupBy(*pair).agg(F.sum(F.when(F.col("v1") == F.col("v2"), F.col("n")).otherwise(0)).alias("same"))
    both, n, q = chance.join(same, pair), F.col("n"), F.col("q")
    pa, pe = F.col("same") / n, (1 - F.col("mm") / (n * n)) / (q - 1)
    return both.select(*pair, F.round("n").cast("long").alias("n_items"), rounded(pa).alias("percent_agreement"), rounded(F.when((q > 1) & (pe != 1), (pa - pe) / (1 - pe))).alias("gwet_ac1"))


def against_truth(ratings: DataFrame, truth: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each rater and the ground truth as two raters over the items both have. truth: item, value."""
    keys = [*by, "rater"]
    shared = ratings.where("value is not null").join(truth.where("value is not null").select("item", F.col("value").alias("truth")), "item")
    long = shared.select(*keys, "item", F.explode(F.array("value", "truth")).alias("value"))
    return coefficients(long, keys)


# bootstrap


def hash_draw(draw: str, place: str, n: str):
    """Portable draw: the first 8 hex digits of md5('b-j') modulo n."""
    digits = F.substring(F.md5(F.concat_ws("-", F.col(draw).cast("string"), F.col(place).cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % F.col(n)).cast("long")


def bootstrap_items(items: DataFrame, draws: int, by: list[str] = ()) -> DataFrame:
    """by, draw, item and the times it was drawn: items with replacement, as many as there are.

    items: by, item. One row a draw and item. Places go by the items' MD5: counts of 4096 buckets give each bucket its
    first place, so items are numbered bucket by bucket and never in one task.
    """
    by = list(by)
    known = items.select(*by, "item").distinct().withColumn("h", F.md5(F.col("item").cast("string"))).withColumn("bucket", F.substring("h", 1, 3))
    sizes = known.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a group
    first = _beside(sizes.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))), sizes.groupBy(*by).agg(F.sum("size").alias("n")), by)
    within = Window.partitionBy(*by, "bucket").orderBy("h", "item")
    indexed = known.withColumn("k", F.row_number().over(within)).join(first, [*by, "bucket"]).withColumn("j", (F.col("first") + F.col("k") - 1).cast("long"))
    grid = indexed.select(*by, F.col("j"), "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = grid.withColumn("j", hash_draw("draw", "j", "n")).groupBy(*by, "draw", "j").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(indexed.select(*by, "j", "item"), [*by, "j"]).select(*by, "draw", "item", "times")


def bootstrap_agreement(ratings: DataFrame, draws: int, by: list[str] = (), metric: str = "percent_agreement") -> DataFrame:
    """by, draw and the metric of each draw."""
    times = bootstrap_items(ratings, draws, by)
    counted = ratings.join(times, [*by, "item"])
    return coefficients(counted, [*by, "draw"], "times").select(*by, "draw", metric)


def bootstrap_summary(drawn: DataFrame, point: DataFrame, metric: str, by: list[str] = ()) -> DataFrame:
    """Percentile bounds, standard error (1e-15 if none) and the normal p-value of the point estimate against 0."""
    stats = drawn.groupBy(*by).agg(F.percentile(metric, 0.025).alias("ci_lower"), F.percentile(metric, 0.975).alias("ci_upper"), F.stddev_samp(metric).alias("se"))
    both = stats.join(point.select(*by, metric), list(by)) if by else stats.crossJoin(F.broadcast(point.select(metric)))
    se = F.when(F.col("se") == 0, 1e-15).otherwise(F.col("se"))
    return both.select(*by, F.col(metric).alias("value"), rounded("ci_lower").alias("ci_lower"), rounded("ci_upper").alias("ci_upper"), rounded(se).alias("se"), rounded(normal_p(F.col(metric) / se)).alias("p_value"))


# bootstrap of sums: any metric that is a function of sums over items


BLOCK_ITEMS, MOST_BLOCKS = 10_000, 65_536


def drawn_in_block(draw: int, block: int, before: np.ndarray, seed: int = 0) -> int:
    """How many of a draw's items come from a block: halves of the range of blocks get binomial shares, down to the block.

    before: items before each block, and all. Every block finds the same numbers on its way, so they sum to all."""
    low, high, n = 0, len(before) - 1, int(before[-1])
    while high - low > 1 and n:
        middle = (low + high) // 2
        share = (before[middle] - before[low]) / (before[high] - before[low]) if before[high] > before[low] else 0.0
        left = int(np.random.default_rng((seed, draw, low, high)).binomial(n, share))
        low, high, n = (low, middle, left) if block < middle else (middle, high, n - left)
    return n


def bootstrap_sums(items: DataFrame, draws: int, seed: int = 0, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """draw and the sums of stats over as many items as there are, drawn with replacement. items: item, stats (array of doubles).

    Items are dealt to blocks by hash; a block draws its own items as often as drawn_in_block() says, so nothing is
    exploded, joined or numbered: a block gives one row a draw. The driver holds one number a block, MOST_BLOCKS at most.
    Items are sorted within their block, so a task that runs again draws the same."""
    n = items.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // block_items)))
    dealt = items.select("item", "stats", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"))
    size = np.zeros(blocks + 1, np.int64)
    for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["block"] + 1] = r["n"]
    before = np.cumsum(size)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block, x = int(pdf["block"].iloc[0]), np.stack(pdf.sort_values("item", kind="stable")["stats"].to_numpy())
        sums = []
        for b in range(draws):
            rng = np.random.default_rng((seed, b, block))
            times = np.bincount(rng.integers(0, len(x), drawn_in_block(b, block, before, seed)), minlength=len(x))
            sums.append(times @ x)
        return pd.DataFrame({"draw": np.arange(draws), "sums": sums})

    per_block = dealt.groupBy("block").applyInPandas(draw, "draw long, sums array<double>")
    parts = per_block.select("draw", F.posexplode("sums").alias("i", "x")).groupBy("draw", "i").agg(F.sum("x").alias("x"))
    return parts.groupBy("draw").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sums"))


def nominal_stats(ratings: DataFrame, values: list) -> DataFrame:
    """item and stats: one, whether of two ratings, agreement, agreement within, then shares and counts by value."""
    counts = item_counts(ratings)
    r, n, two = F.col("r_ik"), F.col("r_i"), F.col("r_i") >= 2
    some = lambda c: F.sum(F.when(two, c).otherwise(0.0))
    of = lambda v, c: F.sum(F.when(F.col("value") == v, c).otherwise(0.0))
    stats = [F.lit(1.0), F.max(two.cast("double")), some(r * (r - 1) / (n * (n - 1))), some(r * (r - 1) / (n - 1)), *(of(v, r / n) for v in values), *(of(v, F.when(two, r).otherwise(0.0)) for v in values)]
    return counts.groupBy("item").agg(F.array(*(x.cast("double") for x in stats)).alias("stats"))


def nominal_from_sums(sums: DataFrame, n_values: int) -> DataFrame:
    """The coefficients of nominal_stats() sums."""
    at = lambda i: F.get("sums", F.lit(i))
    p, a = F.slice("sums", 5, n_values), F.slice("sums", 5 + n_values, n_values)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e)
    square = lambda x: add(F.transform(x, lambda e: e * e))
    t = sums.select("draw", at(0).alias("n"), at(1).alias("n2"), at(2).alias("agree"), at(3).alias("within"), square(p).alias("pp"), F.size(F.filter(p, lambda e: e > 0)).alias("q"), add(a).alias("a"), square(a).alias("aa"))
    pa, q, pp = F.when(F.col("n2") > 0, F.col("agree") / F.col("n2")), F.col("q"), F.col("pp") / (F.col("n") * F.col("n"))
    chance = lambda pe: F.when((q > 1) & (F.lit(1.0) - pe != 0), (pa - pe) / (1 - pe))
    total, apart = F.col("a"), F.col("a") * F.col("a") - F.col("aa")
    alpha = F.when(apart > 0, 1 - (total - 1) * (total - F.col("within")) / apart)
    return t.select("draw", pa.alias("percent_agreement"), chance((1 - pp) / (q - 1)).alias("gwet_ac1"), chance(pp).alias("fleiss_kappa"), chance(1 / q).alias("brennan_prediger"), alpha.alias("krippendorff_alpha"))


def bootstrap_nominal(ratings: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """metric_name, value, bounds, se and p-value of all categorical coefficients. The values rated come to the driver: categories, few."""
    values = sorted(r["value"] for r in ratings.where("value is not null").select("value").distinct().collect())
    drawn = nominal_from_sums(bootstrap_sums(nominal_stats(ratings, values), draws, seed), len(values))
    return intervals(drawn, coefficients(ratings).select(*NOMINAL))


CONTINUOUS = ("icc3", "ccc", "krippendorff_alpha_interval")


def continuous(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """One row: ICC(3), concordance and interval alpha of two raters' values, null values left out."""
    both = ratings.where(F.col("rater").isin(first, second))
    out = intraclass(both, [first, second]).select("icc3")
    return out.crossJoin(F.broadcast(concordance(both, first, second).select("ccc"))).crossJoin(F.broadcast(krippendorff_interval(both)))


def bootstrap_continuous(ratings: DataFrame, first: str, second: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """The same of ICC(3), concordance and interval alpha, over the items that both raters rated."""
    x, y = (F.max(F.when(F.col("rater") == r, F.col("value").cast("double"))) for r in (first, second))
    pairs = ratings.groupBy("item").agg(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    rated = pairs.select("item", F.explode(F.array(F.struct(F.lit(first).alias("rater"), F.col("x").alias("value")), F.struct(F.lit(second).alias("rater"), F.col("y").alias("value")))).alias("r")).select("item", "r.*")
    xx, yy, xy = F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y")
    items = pairs.select("item", F.array(F.lit(1.0), "x", "y", xx, yy, xy).alias("stats"))
    n, sx, sy, sxx, syy, sxy = (F.get("sums", F.lit(i)) for i in range(6))
    vx, vy, cov, gap = sxx / n - sx * sx / (n * n), syy / n - sy * sy / (n * n), sxy / n - sx * sy / (n * n), (sx - sy) / n
    mean = (sx + sy) * (sx + sy) / (2 * n)
    rows, cols, all_ = (sxx + syy + 2 * sxy) / 2, (sx * sx + sy * sy) / n, sxx + syy
    msr, mse = (rows - mean) / (n - 1), (all_ - rows - cols + mean) / (n - 1)
    inside, expected = F.lit(2.0) * (2 * all_ - (sxx + syy + 2 * sxy)) / (2 * n), 2 * (2 * n * all_ - (sx + sy) * (sx + sy)) / (2 * n * (2 * n - 1))
    sums = bootstrap_sums(items, draws, seed)
    drawn = sums.select("draw", F.when(msr + mse != 0, (msr - mse) / (msr + mse)).alias("icc3"), F.when(vx + vy + gap * gap > 0, 2 * cov / (vx + vy + gap * gap)).alias("ccc"), F.when(expected > 0, 1 - inside / expected).alias("krippendorff_alpha_interval"))
    return intervals(drawn, continuous(rated, first, second).select(*CONTINUOUS))


def intervals(drawn: DataFrame, point: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, metric_name, value, ci_lower, ci_upper, se, p_value of each metric column. drawn: by, draw, metrics; point: by, metrics."""
    by, metrics = list(by), [c for c in drawn.columns if c not in ("draw", *by)]
    long = drawn.unpivot([*by, "draw"], metrics, "metric_name", "x")
    stats = long.groupBy(*by, "metric_name").agg(F.percentile("x", 0.025).alias("ci_lower"), F.percentile("x", 0.975).alias("ci_upper"), F.stddev_samp("x").alias("se"))
    both = point.unpivot(by, metrics, "metric_name", "value").join(stats, [*by, "metric_name"])
    se = F.when(F.col("se") == 0, 1e-15).otherwise(F.col("se"))
    return both.select(*by, "metric_name", rounded("value").alias("value"), rounded("ci_lower").alias("ci_lower"), rounded("ci_upper").alias("ci_upper"), rounded(se).alias("se"), rounded(normal_p(F.col("value") / se)).alias("p_value"))


#: Categorical metrics by name, besides those of one pass: functions of ratings and groups that give a column of their name.
METRICS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"conger_kappa": conger_kappa, "krippendorff_alpha_interval": krippendorff_interval}


def dispatch(ratings: DataFrame, metrics: tuple[str, ...] = ("percent_agreement", "gwet_ac1"), by: list[str] = (), more: dict[str, Callable[[DataFrame, list[str]], DataFrame]] | None = None) -> DataFrame:
    """Long metric rows (by, metric_name, value) by name; more: metrics of the caller's own, as in METRICS."""
    by, known = list(by), METRICS | (more or {})
    unknown = set(metrics) - set(NOMINAL) - set(known)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    parts = []
    if one_pass := [m for m in metrics if m in NOMINAL and m not in (more or {})]:
        parts.append(coefficients(ratings, by).unpivot(by, one_pass, "metric_name", "value"))
    parts += [known[m](ratings, by).unpivot(by, [m], "metric_name", "value") for m in metrics if m not in one_pass]
    return reduce(DataFrame.unionByName, parts)
