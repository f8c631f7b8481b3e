"""Tables that sum up labels, curves and differences: profiles, typicality, kinks, verdicts, compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.checks import CheckFailed


def valid_versions(versions: DataFrame, key: str, since: str, order: str, last: int = 9999) -> DataFrame:
    """Adds valid_to: the year before the key's next version begins; of a year's versions the last by ``order`` stays."""
    newest = versions.groupBy(key, since).agg(F.max(order).alias(order))
    one = versions.join(newest, [key, since, order], "left_semi")
    following = F.lead(since).over(Window.partitionBy(key).orderBy(since))
    return one.withColumn("valid_to", F.coalesce(following - 1, F.lit(last)))


def valid_in(versions: DataFrame, year: Column, since: str = "year_from", until: str = "valid_to") -> DataFrame:
    """The versions whose inclusive interval holds ``year``."""
    return versions.where(year.between(F.col(since), F.col(until)))


def detours(pairs: DataFrame, road: Column, straight: Column, limit: float) -> DataFrame:
    """Adds the ratio of road to straight distance, null where the latter is zero, and whether it exceeds the limit."""
    r = ratio(road, straight)
    return pairs.withColumn("detour", r).withColumn("long_way", F.coalesce(r > limit, F.lit(False)))


def profile(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(label, n, share, mean_<f>, z_<f>): size, share of all rows, means, and the means in population deviations of all rows.

    A feature that does not vary has null z. All sums are combined before the shuffle; the overall row is one.
    """
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    own = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])
    z = [ratio(F.col(f"mean_{f}") - F.col(f"_m_{f}"), F.col(f"_s_{f}")).alias(f"z_{f}") for f in features]
    return own.join(F.broadcast(whole)).select(label, "n", (F.col("n") / F.col("_n")).alias("share"), *[f"mean_{f}" for f in features], *z)


def caption(features: list[str], least: float = 0.5) -> Column:
    """The features with an absolute z of ``least`` or more, strongest first, each with an arrow and the deviations."""
    entries = F.array(*[F.struct((-F.abs(F.col(f"z_{f}"))).alias("order"), F.lit(f).alias("name"), F.col(f"z_{f}").alias("z")) for f in features])
    strong = F.array_sort(F.filter(entries, lambda e: F.abs(e["z"]) >= least))
    word = lambda e: F.concat(e["name"], F.when(e["z"] > 0, "↑").otherwise("↓"), F.format_string("%.2f", F.abs(e["z"])), F.lit("σ"))
    return F.array_join(F.transform(strong, word), ", ")


def kinks(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Adds difference to the point before, whether the slope turns here, and whether the point is above both neighbours.

    A curve has one point for each x of a closed list; the window orders these few.
    """
    w = Window.orderBy(x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    step, ahead = F.col(y) - before, after - F.col(y)
    return curve.select("*", step.alias("step"), F.coalesce(step * ahead < 0, F.lit(False)).alias("kink"), F.coalesce((step > 0) & (ahead < 0), F.lit(False)).alias("peak"))


def typicality(curve: DataFrame, y: str) -> DataFrame:
    """Adds z against all rows (sample deviation) and the rank from the largest; one row per period of a closed list."""
    whole = curve.agg(F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s"))
    rank = F.rank().over(Window.orderBy(F.desc(y))).cast("long")
    return curve.join(F.broadcast(whole)).select(*curve.columns, ratio(F.col(y) - F.col("_m"), F.col("_s")).alias("z"), rank.alias("rank"))


def mean_differences(rows: DataFrame, group: str, value: str, width: float = 1.96) -> DataFrame:
    """(a, b, difference, se, multiple, overlap) of each pair of groups: combined standard error and whether the intervals meet.

    Groups are a closed list; what is paired is one row for each.
    """
    g = rows.groupBy(group).agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    a, b = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns]), g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    gap, se = F.col("m_a") - F.col("m_b"), F.hypot("se_a", "se_b")
    meet = F.abs(gap) <= width * (F.col("se_a") + F.col("se_b"))
    return a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b")).select(F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), gap.alias("difference"), se.alias("se"), ratio(gap, se).alias("multiple"), meet.alias("overlap"))


def median_order(rows: DataFrame, by: str, group: str, value: str, top: str, bottom: str) -> DataFrame:
    """(by, ordering, top_ok, bottom_ok): groups from the largest median down, and whether the ends are as expected."""
    m = rows.groupBy(by, group).agg(F.median(value).alias("m"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), F.col(group).alias("g")))), lambda x: x["g"])
    o = m.groupBy(by).agg(listed.alias("o"))
    return o.select(by, F.array_join("o", ">").alias("ordering"), (F.col("o")[0] == top).alias("top_ok"), (F.element_at("o", -1) == bottom).alias("bottom_ok"))


def month_verdict(months: DataFrame, key: str, need: int, alpha: float = 0.05) -> DataFrame:
    """(key, n, n_passed, holds): months with p < alpha and an observed value above the null's p95, and whether there are ``need`` of them."""
    passed = F.count_if(F.coalesce((F.col("p") < alpha) & (F.col("observed") > F.col("p95")), F.lit(False)))
    return months.groupBy(key).agg(F.count(F.lit(1)).alias("n"), passed.alias("n_passed")).withColumn("holds", F.col("n_passed") >= need)


def median_gap(rows: DataFrame, group: str, a: str, b: str, x: str, y: str) -> DataFrame:
    """One row: the gap of the groups' median y, and the gap that the regression of y on x over all rows expects of their median x."""
    own = lambda g, c: F.median(F.when(F.col(group) == g, F.col(c)))
    s = rows.agg(F.regr_slope(y, x).alias("slope"), (own(a, x) - own(b, x)).alias("dx"), (own(a, y) - own(b, y)).alias("actual"))
    return s.select("actual", (F.col("slope") * F.col("dx")).alias("expected"), (F.col("actual") - F.col("slope") * F.col("dx")).alias("unexplained"))


def composition(rows: DataFrame, kind: str, label: str = "label", least: int = 1) -> DataFrame:
    """(kind, label, n, share, place): share of a label in its kind and its place there, null for kinds below ``least`` rows."""
    n = rows.groupBy(kind, label).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(kind))
    place = F.rank().over(Window.partitionBy(kind).orderBy(F.desc("n"))).cast("long")
    return n.select(kind, label, "n", (F.col("n") / whole).alias("share"), F.when(whole >= least, place).alias("place"))


def flows(modes: DataFrame) -> DataFrame:
    """(first, last, n, share) of rows (first, last): how many go from each first label to each last one."""
    n = modes.groupBy("first", "last").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("first")))


def aligned(labels: DataFrame, anchor: Column, id: str = "id", period: str = "period") -> DataFrame:
    """Adds ``aligned``: the anchor period's label that most members of a (period, label) have there, ties to the smallest.

    Null where none of the members is in the anchor period, which maps to itself.
    """
    at = labels.where(F.col(period) == anchor).select(id, F.col("label").alias("_there"))
    n = labels.join(at, id).groupBy(period, "label", "_there").agg(F.count(F.lit(1)).alias("_n"))
    mapped = n.groupBy(period, "label").agg(F.min(F.struct((-F.col("_n")).alias("m"), "_there")).alias("_b")).select(period, "label", F.col("_b._there").alias("aligned"))
    return labels.join(mapped, [period, "label"], "left")


def threshold_sensitivity(stability: DataFrame, thresholds: list[float], share: str = "main_share", changes: str = "n_changes") -> DataFrame:
    """(threshold, n, kept, mean_changes): nodes whose main share reaches each threshold, in one pass over the nodes."""
    hit = lambda t: F.col(share) >= t
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(hit(t)).alias("n"), (F.count_if(hit(t)) / F.count(F.lit(1))).alias("kept"), F.avg(F.when(hit(t), F.col(changes))).alias("mean_changes")) for t in thresholds]
    return stability.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def fragmentation(contingency: DataFrame, least: float) -> DataFrame:
    """(i, parts, largest): into how many labels j with a share of ``least`` or more a label i falls, and the largest share."""
    share = ratio(F.col("n").cast("double"), F.col("ni"))
    return contingency.groupBy("i").agg(F.count_if(share >= least).alias("parts"), F.max(share).alias("largest"))


def label_at(labels: DataFrame, wanted: DataFrame, missing: str, id: str = "id", period: str = "period") -> DataFrame:
    """The label of each wanted (id, period), ``missing`` where there is none; it takes the place of a label that ``wanted`` has."""
    return wanted.drop("label").join(labels.select(id, period, "label"), [id, period], "left").withColumn("label", F.coalesce("label", F.lit(missing)))


def quoted(value: Column) -> Column:
    """A CSV field in quotes, with those inside doubled; empty for null."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def export_lines(labels: DataFrame, periods: list[str], id: str = "id", period: str = "period") -> DataFrame:
    """(id, line): one quoted CSV line per node, its label in each of the closed list of periods."""
    cells = labels.groupBy(id).agg(*[F.max(F.when(F.col(period) == F.lit(p).cast("date"), F.col("label"))).alias(f"_{k}") for k, p in enumerate(periods)])
    return cells.select(id, F.concat_ws(";", quoted(F.col(id)), *[quoted(F.col(f"_{k}")) for k in range(len(periods))]).alias("line"))


def merge_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of its one row in ``right``; stops where there is none or several."""
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bad = left.select(*keys).distinct().join(n, keys, "left").where("_n is null or _n > 1").limit(3).collect()
    if bad:
        raise CheckFailed(f"STOP: not exactly one row: {[tuple(r) for r in bad]}")
    return left.join(right, keys)


def union_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, by key those of ``first`` where it has any."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").select(*first.columns))


def guarded_deviation(rows: DataFrame, group: str, value: str, guard: float) -> DataFrame:
    """(group, n, mean, median, d_mean, d_median): how far a group's mean and median are from those of all rows, as parts of the latter; null where these are below ``guard``."""
    whole = rows.agg(F.avg(value).alias("_mean"), F.median(value).alias("_median"))
    own = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median")).join(F.broadcast(whole))
    d = lambda c: F.when(F.abs(F.col(f"_{c}")) >= guard, (F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}")).alias(f"d_{c}")
    return own.select(group, "n", "mean", "median", d("mean"), d("median"))
