"""Selection of files under a byte budget. Closures and sizes are made by joins; the greedy choice depends on each choice
before it, so it is taken document by document, documents in parallel. A document's candidates come to one task as ids,
ranks and sizes, never as contents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.operators.sizes import json_bytes, selection_bytes, stated_total
from tarnbeck.sources.folders import stored

# Why a file stays out, and why a selection is made without a blocking reason.
ALONE, TOO_LARGE, LEFT, OVER = "file_exceeds_budget_alone", "closure_exceeds_budget", "max_passes_reached", "PROMPT_BUDGET_EXCEEDED"


def candidates(files: DataFrame, reach: DataFrame, group: str) -> DataFrame:
    """(group, file, rank, size, needs, need_sizes) from files (group, file, rank, size) and reach (group, file, need)."""
    sizes = files.select(group, F.col("file").alias("need"), F.col("size").alias("need_size"))
    pairs = reach.join(sizes, [group, "need"]).groupBy(group, "file").agg(F.sort_array(F.collect_list(F.struct("need", "need_size"))).alias("n"))
    out = files.join(pairs, [group, "file"], "left")
    own = F.array(F.struct(F.col("file").alias("need"), F.col("size").alias("need_size")))
    n = F.array_distinct(F.concat(F.coalesce("n", F.expr("cast(array() as array<struct<need:string,need_size:bigint>>)")), own))
    return out.withColumn("n", n).select(group, "file", "rank", "size", F.col("n.need").alias("needs"), F.col("n.need_size").alias("need_sizes"))


def _never(budget: Column) -> Column:
    """Whether a candidate's closure alone is over the budget, so that it fits beside nothing: what is taken with it has at least its
    bytes. False where a need stands twice, with two sizes, or has none."""
    alone = F.aggregate("need_sizes", F.lit(0).cast("long"), lambda a, x: a + x) > budget
    return F.coalesce(alone & (F.size(F.array_distinct("needs")) == F.size("needs")), F.lit(False))


def _fit(rows: list[dict], taken: set, used: int, budget: int) -> tuple[set, int, dict]:
    """One first-fit pass in rank order: what it takes with closures, the bytes used, and why the others stay out."""
    out, why = set(taken), {}
    for r in rows:
        if r["file"] in out:
            continue
        new = {f: s for f, s in zip(r["needs"], r["need_sizes"], strict=True) if f not in out}
        cost = sum(new.values())
        if used + cost <= budget:
            out |= set(new)
            used += cost
        else:
            why[r["file"]] = TOO_LARGE
    return out, used, why


def select_files(found: DataFrame, group: str, budget: int | Column, base: int | Column = 0) -> DataFrame:
    """(group, file, selected, reason, status): in rank order a file is taken with all it needs if the sum of all that is
    taken stays within the budget; later ones still get their chance. A file too large by itself is told apart.

    A group's candidates follow each other in one task, which holds the ids that it has taken and no other row; a file that was
    turned away may still come in with a later one, so what a file becomes is summed up afterwards."""
    kind = found.schema[group].dataType.simpleString()
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = stored(found.withColumn("_left", (lit(budget) - lit(base)).cast("long")), "candidates")
    fits = rows.groupBy(group).agg((F.sum("size") <= F.min("_left")).alias("_whole"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, used = object(), set(), 0
        for b in batches:
            out = []
            for k, file, size, left, needs, sizes in zip(*(b[c] for c in (group, "file", "size", "_left", "needs", "need_sizes")), strict=True):
                if k != now:
                    now, taken, used = k, set(), 0
                if file in taken:
                    continue
                if size > left:
                    out.append((k, file, ALONE))
                    continue
                new = {f: s for f, s in zip(needs, sizes, strict=True) if f not in taken}
                if used + sum(new.values()) <= left:
                    taken |= set(new)
                    used += sum(new.values())
                    out += [(k, f, None) for f in new]
                else:
                    out.append((k, file, TOO_LARGE))
            yield pd.DataFrame(out, columns=[group, "file", "reason"])

    # candidates that fit beside nothing need not wait for the others of their group
    never = _never(F.col("_left"))
    refused = rows.filter(never).select(group, "file", F.when(F.col("size") > F.col("_left"), ALONE).otherwise(TOO_LARGE).alias("reason"))
    ordered = rows.filter(~never).select(group, "file", "rank", "size", "_left", "needs", "need_sizes").repartition(group).sortWithinPartitions(group, "rank", "file")
    events = ordered.mapInPandas(choose, f"{group} {kind}, file string, reason string").union(refused)
    became = stored(events.groupBy(group, "file").agg(F.bool_or(F.col("reason").isNull()).alias("_in"), F.max("reason").alias("_why")), "chosen")
    some = became.groupBy(group).agg(F.bool_or("_in").alias("_any"))
    out = rows.select(group, "file").join(fits, group).join(became, [group, "file"], "left").join(some, group, "left")
    selected = F.col("_whole") | F.coalesce("_in", F.lit(False))
    status = F.when(F.col("_whole"), "not_needed").when(F.coalesce("_any", F.lit(False)), "applied").otherwise("failed")
    return out.select(group, "file", selected.alias("selected"), F.when(~selected, F.col("_why")).alias("reason"), status.alias("status"))


def metadata_reserve(files: DataFrame, group: str, budget: Column, reasons: Column) -> DataFrame:
    """(group, reserve): bytes that a selection's description may come to at most, every file counted as taken and as left out
    for the longer reason. ``files``: (group, file) and what ``budget`` and ``reasons`` read."""
    rows = files.select(group, "file", budget.alias("_b"), reasons.alias("_r"))
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(json_bytes(F.col("file"))).alias("size"), F.first("_b").alias("b"), F.first("_r").alias("r"))
    n, size, b = F.col("n"), F.col("size"), F.col("b")
    most = selection_bytes(F.lit("applied"), b, F.length(b.cast("string")), n, size, n, size + n * (len(TOO_LARGE) + 2), F.col("r"))
    return sums.select(group, (most - len("null")).cast("long").alias("reserve"))


def completeness_gate(documents: DataFrame, files: DataFrame, reach: DataFrame, group: str, budget: int, blocking: Sequence[str]) -> DataFrame:
    """(group, action, reasons, selected, excluded, total): what a document is sent as. Unchanged unless a blocking reason holds or
    its whole size is over the budget; else files are selected once, in what the selection's description leaves of the
    budget. ``total`` is the exact size with the description, which states that size itself. Where nothing fits, or the total
    does not settle or is over the budget, the action is failed: it never goes on with a part that wasn't chosen.

    ``documents``: (group, base, codes), ``base`` the bytes without any file; ``files``: (group, file, rank, size); ``reach``:
    (group, file, need)."""
    held = F.array_intersect(F.coalesce("codes", F.array().cast("array<string>")), F.array(*map(F.lit, blocking)))
    whole = files.groupBy(group).agg(F.sum("size").alias("_all"))
    docs = documents.join(whole, group, "left").withColumn("_all", F.coalesce("_all", F.lit(0)) + F.col("base"))
    docs = stored(docs.select(group, "base", "_all", F.when(F.size(held) > 0, held).when(F.col("_all") > budget, F.array(F.lit(OVER))).alias("reasons")), "gate")
    due = docs.filter("reasons IS NOT NULL")
    own = files.join(due.select(group, "base", "reasons"), group)
    found = candidates(own.select(*files.columns), reach.join(due.select(group), group, "left_semi"), group)
    reserve = metadata_reserve(own, group, F.lit(budget), F.col("reasons"))
    found = found.join(due.select(group, "base").join(reserve, group), group)
    chosen = select_files(found, group, F.lit(budget) - F.col("reserve"), F.col("base")).join(files.select(group, "file", "size"), [group, "file"])
    name = json_bytes(F.col("file"))
    sums = chosen.groupBy(group).agg(
        F.first("status").alias("status"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("excluded"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("size"))), F.lit(0)).alias("_size"),
        F.coalesce(F.sum(F.when(F.col("selected"), name)), F.lit(0)).alias("_in"), F.coalesce(F.sum(F.when(~F.col("selected"), name + F.length("reason") + 2)), F.lit(0)).alias("_out"))
    out = docs.join(sums, group, "left")
    said = selection_bytes(F.col("status"), F.lit(budget), F.lit(0), F.col("selected"), F.col("_in"), F.col("excluded"), F.col("_out"), F.col("reasons"))
    total = stated_total(F.col("base") + F.col("_size") + said + len(', "contextSelection": '))
    sent = F.col("status").isin("not_needed", "applied") & (total <= budget)
    action = F.when(F.col("reasons").isNull(), "unchanged").when(F.coalesce(sent, F.lit(False)), F.col("status")).otherwise("failed")
    shown = F.when(action == "unchanged", F.col("_all")).when(action != "failed", total)
    return out.select(group, action.alias("action"), "reasons", F.when(action.isin("not_needed", "applied"), F.col("selected")).alias("selected"), F.when(action.isin("not_needed", "applied"), F.col("excluded")).alias("excluded"), shown.cast("long").alias("total"))


def plan_passes(found: DataFrame, group: str, budget: int, base: int = 0, most: int = 8) -> DataFrame:
    """(group, pass_index, file, role, reason): first fit again and again over what is not primary yet; what a pass takes along
    from earlier ones is context. Files that never fit, or are left after ``most`` passes, have pass 0 and a reason. A pass looks at
    all that is left of its group, so a group is one task, which holds its ids, ranks and sizes, and the needs of those that can fit."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["rank", "file"]).to_dict("records")
        left, never, out = {r["file"] for r in rows}, {}, []
        for k in range(1, most + 1):
            todo = [r for r in rows if r["file"] in left and r["file"] not in never]
            first = 0
            while first < len(todo) and (todo[first]["_never"] or base + sum(todo[first]["need_sizes"]) > budget):
                r = todo[first]
                never[r["file"]] = ALONE if base + r["size"] > budget else TOO_LARGE
                first += 1
            todo = [r for r in todo[first:] if not r["_never"]]
            if not todo:
                break
            taken, _, _ = _fit(todo, set(), base, budget)
            primary = taken & left
            out += [(k, f, "primary" if f in primary else "context", None) for f in sorted(taken)]
            left -= primary
            never = {f: w for f, w in never.items() if f not in primary}
        out += [(0, f, "unassigned", never.get(f, LEFT)) for f in sorted(left)]
        return pd.DataFrame([(pdf[group].iloc[0], *x) for x in out], columns=[group, "pass_index", "file", "role", "reason"])

    rows = found.select(group, "file", "rank", "size", "needs", "need_sizes", _never(F.lit(budget - base)).alias("_never"))
    none = lambda c: F.when(~F.col("_never"), F.col(c)).alias(c)
    rows = rows.select(group, "file", "rank", "size", none("needs"), none("need_sizes"), "_never")
    return rows.groupBy(group).applyInPandas(plan, f"{group} {kinds[group]}, pass_index int, file string, role string, reason string")


def units(targets: DataFrame, parts: DataFrame, group: str, most_bytes: int = 8192, callees: int = 3, callee_bytes: int = 4096) -> DataFrame:
    """(group, unit_bytes, callees, state): a target and its modifiers up to ``most_bytes`` or not reviewed at all; then callees in
    order while they are few and small enough. Nothing is ever cut. ``parts``: (group, role, place, size)."""
    own = parts.filter("role <> 'callee'").groupBy(group).agg(F.sum("size").alias("own"))
    small = parts.filter((F.col("role") == "callee") & (F.col("size") <= callee_bytes))
    calls = small.groupBy(group).agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "size"))), 1, callees).alias("c"))
    out = targets.select(group).join(own, group, "left").join(calls, group, "left")
    c = F.coalesce("c", F.expr("cast(array() as array<struct<place:int,size:bigint>>)"))
    extra = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    ok = F.coalesce("own", F.lit(0)) <= most_bytes
    return out.select(group, F.when(ok, F.coalesce("own", F.lit(0)) + extra).alias("unit_bytes"), F.when(ok, F.size(c)).otherwise(0).alias("callees"), F.when(ok, "BUILT").otherwise("NOT_REVIEWED").alias("state"))


