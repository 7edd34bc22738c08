"""Stratified splits of whole duplicate groups, as one ranking of all groups.

Groups are put in an order in which neighbours are alike (images, then images by class) and equal ones are shuffled by a seed. The
group of rank r gets the point r * STEP mod 2**32: such points fill every stretch of ranks evenly, so a split that takes the points of
an interval gets its share of every kind of group, and with it of every class. Splits are disjoint intervals, budgets nested ones. It is
one pass over ranges of the order for any number of groups. A class that a split lacks is then given to it by one group from the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.operators.graphs import materialise
from boxwright.operators.ordered import ranked

#: 2**32 over the golden ratio, odd; its multiples are spread most evenly.
STEP, CIRCLE = 2654435769, 1 << 32


def seeded(seed: int, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(p) if isinstance(p, str) else p for p in parts)), 256)


def describe_groups(rows: DataFrame) -> DataFrame:
    """``rows``: id, group, classes (array), protected (boolean). A row a group: group, images, kind (images by class, as text), classes,
    protected. ValueError if a group has both protected and other images, or an id occurs twice."""
    repeated = rows.groupBy("id").count().where("count > 1").count()
    if repeated:
        raise ValueError(f"{repeated} ids occur more than once")
    whole = rows.groupBy("group").agg(F.count("*").alias("images"), F.min("protected").alias("protected"), F.max("protected").alias("any"))
    present = rows.select("group", F.explode(F.array_distinct("classes")).alias("class")).groupBy("group", "class").agg(F.count("*").alias("n"))
    told = present.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("class", "n"))).alias("have"))  # a row a class of the group
    text = F.array_join(F.transform("have", lambda h: F.concat(h["class"].cast("string"), F.lit("="), h["n"].cast("string"))), ";")
    none = F.array().cast(rows.schema["classes"].dataType)
    described = materialise(whole.join(told, "group", "left").select("group", "images", F.coalesce(text, F.lit("")).alias("kind"), F.coalesce(F.transform("have", lambda h: h["class"]), none).alias("classes"), "protected", "any"), "groups")
    mixed = described.where("protected <> any").count()
    if mixed:
        raise ValueError(f"{mixed} groups have both protected and other images")
    return described.drop("any")


def points(groups: DataFrame, seed: int) -> DataFrame:
    """``groups`` with their point on the circle."""
    order = [F.desc("images"), F.col("kind"), seeded(seed, F.col("group").cast("string")), F.col("group")]
    placed = ranked(groups, order, "rank")
    return placed.withColumn("point", (F.col("rank").bitwiseAND(F.lit((1 << 30) - 1)) * F.lit(STEP)) % F.lit(CIRCLE)).drop("rank")


def intervals(shares: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Where on the circle each split lies, one behind the other."""
    out, at = {}, 0
    for name, share in shares.items():
        end = at + round(share * CIRCLE)
        out[name], at = (at, end), end
    if at > CIRCLE:
        raise ValueError("the shares are more than the whole")
    return out


def split_groups(groups: DataFrame, shares: dict[str, float], seed: int, rest: str = "train_pool") -> DataFrame:
    """(group, images, split) of the groups of :func:`describe_groups`: protected ones are external_test, others in turn by their point, the
    rest ``rest``. Every split has every class, if the rest has groups with it and the share has room for one image a class: of these groups
    the first in an order of the split's own comes over, for a group that two splits want to the earlier one."""
    free = groups.where("NOT protected")
    place = F
    for name, (low, high) in intervals(shares).items():
        place = place.when((F.col("point") >= low) & (F.col("point") < high), F.lit(name))
    placed = materialise(points(free, seed).select("group", "images", "classes", place.otherwise(F.lit(rest)).alias("split")), "placed")
    by_class = placed.select("group", "split", "images", F.explode("classes").alias("class"))
    total, n_classes = placed.agg(F.sum("images")).first()[0] or 0, by_class.select("class").distinct().count()
    roomy = [(k, name) for k, (name, share) in enumerate(shares.items()) if round(total * share) >= n_classes]
    wanted = by_class.select("class").distinct().withColumn("s", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in roomy)))) if roomy else None
    moved = None
    if wanted is not None and n_classes:
        lacking = wanted.select("class", "s.k", F.col("s.name").alias("split")).join(by_class.select("class", "split").distinct(), ["class", "split"], "left_anti")
        first = F.min(F.struct(seeded(seed, F.col("k").cast("string"), F.col("group").cast("string")).alias("o"), F.col("group")))
        chosen = by_class.where(F.col("split") == rest).select("class", "group").join(lacking, "class").groupBy("class", "k", F.col("split").alias("into")).agg(first.alias("first"))
        moved = chosen.groupBy(F.col("first.group").alias("group")).agg(F.min(F.struct("k", "into")).alias("to"))
    final = placed.select("group", "images", "split") if moved is None else placed.join(moved, "group", "left").select("group", "images", F.coalesce("to.into", "split").alias("split"))
    return final.union(groups.where("protected").select("group", "images", F.lit("external_test")))


def budgets(groups: DataFrame, percentages: Sequence[int], seed: int) -> DataFrame:
    """(group, images, budget): the smallest percentage a group is part of; larger budgets hold the smaller ones. Groups of none have no row."""
    smallest = F
    for p in sorted(percentages):
        smallest = smallest.when(F.col("point") < round(p * CIRCLE / 100), F.lit(p))
    return points(groups, seed).select("group", "images", smallest.otherwise(F.lit(None)).alias("budget")).where("budget IS NOT NULL")
