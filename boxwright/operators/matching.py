"""Greedy matching folds and optimal one-to-one matching, per image (and class)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.graphs import materialise

_BOX = ("x1", "y1", "x2", "y2")


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], rank, threshold: float, *, payload: tuple[str, ...] = ("confidence",)) -> DataFrame:
    """Walks each group's left rows in ``order``; each takes the open right row that ``rank`` puts first, if its overlap is
    ``threshold`` or more. Right rows have a column n that identifies them in their group.

    One join on the keys finds the overlaps over the threshold, one shuffle a side. A row without one, and a pair whose boxes have no other
    partner, are settled as they stand; only the others' overlaps, a few of a group, are folded. Returns keys, the payload, the box, n of the
    partner (null for none) and iou.
    """
    numbered = Window.partitionBy(*keys).orderBy(*order, *_BOX, *payload)
    lefts = left.select(*keys, *dict.fromkeys((*_BOX, *payload)), F.row_number().over(numbered).alias("_k"))
    more = [c for c in right.columns if c not in keys]
    rights = right.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(c).alias(f"_r_{c}") for c in more))
    one, option = F.struct(*_BOX), F.struct(*(F.col(f"_r_{c}").alias(c) for c in more))
    value = G.iou(G.Box.of(), G.Box.of("_r_"))
    same = value >= F.lit(threshold)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    met = lefts.join(rights, same, "left").select(*keys, *dict.fromkeys((*_BOX, *payload)), "_k", F.col("_r_n").cast("long").alias("n"), F.when(F.col("_r_n").isNotNull(), rank(one, option)).alias("_rank"))
    # the overlaps of a group, best first for the first box, then the second one's
    edge = F.when(F.col("n").isNotNull(), F.struct((-F.col("_k")).alias("k"), F.col("_rank").alias("rank"), "n"))
    rows = met.withColumn("_all", F.collect_list(edge).over(Window.partitionBy(*keys)))
    k, n = -F.col("_k"), F.col("n")
    rival = F.exists("_all", lambda e: (e["k"] == k) != (e["n"] == n))
    nothing = F.expr("filter(array(named_struct('k', cast(null AS INT), 'n', cast(null AS BIGINT))), x -> false)")
    taken = F.aggregate(
        F.sort_array("_all", asc=False),
        nothing,
        lambda got, e: F.when(F.exists(got, lambda t: (t["k"] == e["k"]) | (t["n"] == e["n"])), got).otherwise(F.array_append(got, F.struct(e["k"].alias("k"), e["n"].alias("n")))),
    )
    # a row of several overlaps stays once: with the partner that it gets, or, if it gets none, with its first overlap
    mine = F.get(F.filter("_taken", lambda t: t["k"] == k), F.lit(0))["n"]
    first = F.array_max(F.filter("_all", lambda e: e["k"] == k))["n"]
    judged = rows.withColumn("_taken", F.when(n.isNotNull() & rival, taken))
    settled = judged.withColumn("_mine", F.when(F.col("_taken").isNull(), n).otherwise(mine))
    stays = F.col("_taken").isNull() | (n == F.coalesce("_mine", first))
    return settled.where(stays).select(*keys, *dict.fromkeys((*payload, *_BOX)), F.col("_mine").alias("n"), F.when(F.col("_mine").isNotNull(), F.col("_rank")["iou"]).alias("iou"))


def struct_iou(a: Column, b: Column) -> Column:
    return G.iou(G.Box.in_struct(a), G.Box.in_struct(b))


def rank_first_best(one: Column, option: Column) -> Column:
    """Largest overlap; among equals the smallest number."""
    value = struct_iou(one, option)
    return F.struct(value.alias("iou"), (-option["n"]).alias("minus"), option["n"].alias("n"))


def rank_largest_index(one: Column, option: Column) -> Column:
    """Largest overlap; among equals the largest number."""
    return F.struct(struct_iou(one, option).alias("iou"), option["n"].alias("n"))


def rank_cross_view(one: Column, option: Column) -> Column:
    """Largest overlap, then smallest coordinates, then highest confidence."""
    return F.struct(struct_iou(one, option).alias("iou"), *((-option[c]).alias(f"m{c}") for c in _BOX), option["confidence"].alias("confidence"), option["n"].alias("n"))


def suppress(rows: DataFrame, keys: list[str], order: list[Column], threshold: float, *, strict: bool = False, cap: int | None = None, same: str | None = "class_id", payload: tuple[str, ...] = ("confidence", "class_id"), skip: str | None = None) -> DataFrame:
    """Greedy non-maximum suppression of each group in ``order`` with an optional cap, in one fold.

    A box goes if it overlaps a kept one (of the same ``same``) by ``threshold`` or more (more, if ``strict``); the cap is tested after that,
    and boxes over it are no reference for later ones. Adds verdict: accepted, nms_duplicate or max_boxes_per_image. Rows whose payload
    ``skip`` is true only pass through: they are no reference, do not count and get the verdict skipped.
    """
    row = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), *_BOX, *payload)
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))

    def step(state: Column, one: Column) -> Column:
        over = (lambda v: v > F.lit(threshold)) if strict else (lambda v: v >= F.lit(threshold))
        clash = F.exists(state["kept"], lambda k: ((k[same] == one[same]) if same else F.lit(True)) & over(struct_iou(k, one)))
        full = (F.size(state["kept"]) >= cap) if cap is not None else F.lit(False)
        aside = one[skip] if skip else F.lit(False)
        verdict = F.when(aside, "skipped").when(clash, "nms_duplicate").when(full, "max_boxes_per_image").otherwise("accepted")
        return F.struct(F.when(aside | clash | full, state["kept"]).otherwise(F.array_append(state["kept"], one)).alias("kept"), F.array_append(state["out"], verdict).alias("out"))

    start = F.struct(F.filter("all", lambda _: F.lit(False)).alias("kept"), F.expr("filter(array(''), x -> false)").alias("out"))
    folded = grouped.select(*keys, "all", F.aggregate("all", start, step)["out"].alias("verdicts"))
    out = folded.select(*keys, F.explode(F.arrays_zip(F.col("all").alias("b"), F.col("verdicts").alias("v"))).alias("z"))
    return out.select(*keys, *(F.col(f"z.b.{c}").alias(c) for c in (*payload, *_BOX)), F.col("z.v").alias("verdict"))


def assign(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """A matching of the most pairs, among those of the largest total weight (in billionths), and among those of the smallest pairs in order.

    Successive shortest alternating paths over whole numbers, so that ties are exact: below the weight, a row counts more than all later rows together.
    """
    rows = sorted({a for a, _ in weights})
    columns = sorted({b for _, b in weights})
    place, base = {b: len(columns) - j for j, b in enumerate(columns)}, len(columns) + 1
    power = {a: base ** (len(rows) - 1 - i) for i, a in enumerate(rows)}
    edges = [(a, b, round(w * 1e9) * base ** len(rows) + power[a] * place[b]) for (a, b), w in sorted(weights.items())]
    mate_row: dict[int, int] = {}
    mate_column: dict[int, int] = {}
    while True:
        # unmatched edges cost their weight, matched ones give it back
        cost = {("r", a): 0 for a in rows if a not in mate_row}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for a, b, w in edges:
                here, there, value = ("c", b), ("r", a), w
                if mate_row.get(a) != b:
                    here, there, value = there, here, -w
                if here in cost and (there not in cost or cost[here] + value < cost[there]):
                    cost[there], came[there], changed = cost[here] + value, here, True
        ends = [b for b in columns if b not in mate_column and ("c", b) in cost]
        if not ends:
            return sorted(mate_row.items())
        at = ("c", min(ends, key=lambda b: (cost["c", b], b)))
        while at in came:
            before = came[at]
            if at[0] == "c":
                mate_row[before[1]], mate_column[at[1]] = at[1], before[1]
            at = before


def _solved(rows: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Matchings of the groups of sorted batches; a batch's last group may go on in the next."""
    rest: pd.DataFrame | None = None

    def matched(group: pd.DataFrame) -> pd.DataFrame:
        columns = [group[c].tolist() for c in (*keys, "a", "b", "iou")]
        out, now, weights = [], None, {}
        for *key, a, b, iou in zip(*columns, strict=True):
            if key != now:
                out += [(*now, *p, weights[p]) for p in assign(weights)] if weights else []
                now, weights = key, {}
            weights[int(a), int(b)] = iou
        out += [(*now, *p, weights[p]) for p in assign(weights)] if weights else []
        return pd.DataFrame(out, columns=[*keys, "a", "b", "iou"])

    for batch in rows:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rest):
            continue
        open_ = (rest[keys] == rest[keys].iloc[-1]).all(axis=1)
        if not open_.all():
            yield matched(rest[~open_])
            rest = rest[open_]
    if rest is not None and len(rest):
        yield matched(rest)


def optimal_match(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges``: keys (not null), a, b, iou of the pairs over the threshold. Returns the matched ones. A pair whose boxes have no other
    partner is matched as it stands; of the partners of one box that have no other partner themselves the best is taken. Only the others, a few boxes
    of some images, reach the solver, which gets sorted batches of many groups."""
    weight = F.round(F.col("iou") * 1e9).cast("long")
    rivals = [F.count("*").over(Window.partitionBy(*keys, side)) for side in ("a", "b")]
    counted = edges.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "iou", rivals[0].alias("of_a"), rivals[1].alias("of_b"))
    # a star: every partner of its centre has no other partner
    star_a = (F.max("of_b").over(Window.partitionBy(*keys, "a")) == 1).alias("star_a")
    star_b = (F.max("of_a").over(Window.partitionBy(*keys, "b")) == 1).alias("star_b")
    told = counted.select("*", star_a, star_b)
    best_a = F.row_number().over(Window.partitionBy(*keys, "a").orderBy(weight.desc(), "b"))
    best_b = F.row_number().over(Window.partitionBy(*keys, "b").orderBy(weight.desc(), "a"))
    told = materialise(told.select("*", best_a.alias("best_a"), best_b.alias("best_b")), "edges")
    star = F.col("star_a") | F.col("star_b")
    best = F.when(F.col("star_a"), F.col("best_a")).otherwise(F.col("best_b")) == 1
    alone = told.where(star & best).select(*keys, "a", "b", "iou")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    dealt = told.where(~star).select(*keys, "a", "b", "iou").repartition(*keys).sortWithinPartitions(*keys)
    solved = dealt.mapInPandas(lambda rows: _solved(rows, keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a long, b long, iou double")
    return alone.unionByName(solved)
