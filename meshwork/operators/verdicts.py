"""Verdicts from tests at two levels, and names of types from features that hold in two records of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.rank import holm

CONFIRMED, NOT_CONFIRMED = "confirmed", "not confirmed"
#: What results over all rows and within regions mean together.
STAGES = {(True, True): "confirmed at both levels", (True, False): "confirmed over all rows only", (False, True): "confirmed within regions only", (False, False): NOT_CONFIRMED}
EXPLORATORY, OPPOSITE, SMALL = "exploratory", "opposite sign", "confirmed, but the effect is small"


def effect_size(eta: Column) -> Column:
    """Words for eta squared, at Cohen's bounds 0.01, 0.06 and 0.14."""
    return F.when(eta < 0.01, "negligible").when(eta < 0.06, "small").when(eta < 0.14, "medium").otherwise("large")


def assemble(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds p_holm, result, to_benchmark and note to (hypothesis, variable, level, family, p, confirmed, observed, size, benchmark, opposite).

    Within a family p is adjusted by Holm's steps; a test without family is exploratory and keeps its p. A test holds if its level's rule confirmed it and p is below
    alpha. The ratio to the benchmark's effect is given over all rows. A test without p or without its rule's answer stops the query.
    """
    lack = F.concat(F.lit("no p or no rule for "), F.col("hypothesis"), F.lit(", "), F.col("level"))
    sure = tests.withColumn("p", F.when(F.col("p").isNull() | F.col("confirmed").isNull(), F.raise_error(lack)).otherwise(F.col("p")))
    stepped = holm(sure.where(F.col("family").isNotNull()), "p", ["family"], "variable")
    alone = sure.where(F.col("family").isNull()).withColumn("p_holm", F.lit(None).cast("double"))
    holds = F.col("confirmed") & (F.coalesce("p_holm", "p") < alpha)
    said = F.array(F.when(F.col("family").isNull(), EXPLORATORY), F.when(F.col("opposite"), OPPOSITE), F.when(holds & F.col("size").isin("negligible", "small"), SMALL))
    out = stepped.unionByName(alone).withColumn("result", F.when(holds, CONFIRMED).otherwise(NOT_CONFIRMED))
    return out.withColumn("to_benchmark", F.when(F.col("level") == "all", ratio(F.col("observed"), F.col("benchmark")))).withColumn("note", F.array_join(said, "; "))


def stages(levels: DataFrame) -> DataFrame:
    """(hypothesis, variable, stage, note): what both levels' results mean together; a hypothesis that lacks a level has no stage."""
    at = lambda level: F.max(F.when(F.col("level") == level, F.col("result") == CONFIRMED))
    note = F.array_sort(F.collect_list(F.when(F.col("note") != "", F.concat_ws(": ", "level", "note"))))  # two levels
    both = levels.groupBy("hypothesis", "variable").agg(at("all").alias("a"), at("within").alias("b"), F.array_join(note, " | ").alias("note"))
    stage = F.lit(None).cast("string")
    for (a, b), text in STAGES.items():
        stage = F.when((F.col("a") == a) & (F.col("b") == b), text).otherwise(stage)
    return both.select("hypothesis", "variable", stage.alias("stage"), "note")


def type_names(types: DataFrame, features: list[str], ratios: list[tuple[str, str, float, str]], least: float, margin: float) -> DataFrame:
    """(label, name, border) from z_<f> and other_<f>, a feature's deviations in two records of the same data.

    A feature holds if both are ``least`` or more in size and of one sign; the strongest comes first. ``ratios`` are (column, ">=" or "<=", bound, word): the word follows the
    name if the column is on that side. ``border`` lists features whose smaller size is below ``least + margin``.
    """
    entry = lambda f: F.struct((-F.abs(F.col(f"z_{f}"))).alias("order"), F.lit(f).alias("name"), F.col(f"z_{f}").alias("z"), F.col(f"other_{f}").alias("o"))
    holding = F.array_sort(F.filter(F.array(*[entry(f) for f in features]), lambda e: (F.abs(e["z"]) >= least) & (F.abs(e["o"]) >= least) & (F.signum(e["z"]) == F.signum(e["o"]))))
    word = lambda e: F.concat(e["name"], F.when(e["z"] > 0, " higher").otherwise(" lower"))
    base = F.when(F.size("_h") > 0, F.array_join(F.transform("_h", word), ", ")).otherwise("no distinct profile")
    more = [F.when(F.col(c) >= bound if side == ">=" else F.col(c) <= bound, text) for c, side, bound, text in ratios]
    edge = F.transform(F.filter("_h", lambda e: F.least(F.abs(e["z"]), F.abs(e["o"])) < least + margin), lambda e: e["name"])
    return types.withColumn("_h", holding).select("label", F.concat_ws(" · ", base, *more).alias("name"), F.array_join(edge, ", ").alias("border"))
