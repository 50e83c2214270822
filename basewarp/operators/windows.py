"""Rules in sliding windows: a window opens at every distinct site and reaches ``window`` bases on.

A sequence's sites are dealt to stretches; those within a window's width of a stretch's begin are in the one before, too, as
its halo, so windows are whole and one long sequence is many keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rules import Rule, parse_rule

#: Bases of a stretch, if a window is not longer.
STRETCH = 1 << 16


def rule_windows(sites: DataFrame, rule: Rule | str) -> DataFrame:
    """Windows in which the rule holds: rule_name, seq_id, lo, hi (last site within), width and a count per pattern."""
    rule = parse_rule(rule) if isinstance(rule, str) else rule
    names = [t.name for t in rule.terms]
    own = sites.where(F.col("pat").isin(names)).select("seq_id", "site", "pat").distinct()
    # One row per site first, so windows never begin between two patterns at one base.
    at = own.groupBy("seq_id", "site").agg(*[F.sum((F.col("pat") == n).cast("int")).alias(f"c_{k}") for k, n in enumerate(names)])
    wide = F.lit(max(STRETCH, rule.window))
    k = F.floor(F.col("site") / wide)
    at = at.withColumn("own", k).withColumn("stretch", F.explode(F.when((F.col("site") - k * wide <= rule.window) & (k > 0), F.array(k, k - 1)).otherwise(F.array(k))))
    ahead = Window.partitionBy("seq_id", "stretch").orderBy("site").rangeBetween(0, rule.window)
    counted = at.select("seq_id", "own", "stretch", F.col("site").alias("lo"), F.max("site").over(ahead).alias("hi"), *[F.sum(f"c_{k}").over(ahead).alias(f"n_{n}") for k, n in enumerate(names)]).where("own = stretch")
    out = counted.where(rule.holds({n: F.col(f"n_{n}") for n in names}))
    return out.select(F.lit(rule.name).alias("rule_name"), "seq_id", "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"), *[f"n_{n}" for n in names])


def rule_tables(sites: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules at once; counts as a map, since rules name different patterns."""
    out = None
    for r in rules:
        names = [t.name for t in r.terms]
        df = rule_windows(sites, r)
        df = df.select("rule_name", "seq_id", "lo", "hi", "width", F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"n_{n}"))]).alias("counts"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no rules")
    return out
