"""Closures, induced subgraphs and paths, by joins whose frontier shrinks to nothing on cycles as well."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.sources.folders import stored


def _stored(df: DataFrame) -> DataFrame:
    """A step's rows, so that a lineage never grows with the depth."""
    return stored(df, "graph")


def lifted(edges: DataFrame, from_files: DataFrame, to_files: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (from, to) between keys as (from_file, to_file), with the imports; unknown keys and self edges go."""
    a = from_files.select(F.col("key").alias("from"), F.col("file").alias("from_file"))
    b = to_files.select(F.col("key").alias("to"), F.col("file").alias("to_file"))
    own = edges.select("from", "to").distinct().join(a, "from").join(b, "to").select("from_file", "to_file")
    return own.union(imports.select("from_file", "to_file")).filter("from_file <> to_file").distinct()


def closure(edges: DataFrame, seeds: DataFrame, known: DataFrame | None = None, most_steps: int | None = None) -> DataFrame:
    """(seed, node): all nodes that each seed reaches, itself included. ``edges``: (from, to); ``seeds``: (seed). Each step
    joins the frontier to the edges and takes away what was reached before, so a cycle ends it."""
    e = edges.select("from", "to").distinct()
    if known is not None:
        e = e.join(known.select(F.col("node").alias("to")), "to", "left_semi")
    e = _stored(e.select("from", "to"))
    reached = frontier = _stored(seeds.select("seed", F.col("seed").alias("node")).distinct())
    steps = 0
    while most_steps is None or steps < most_steps:
        step = frontier.join(e, frontier["node"] == e["from"]).select("seed", F.col("to").alias("node")).distinct()
        frontier = _stored(step.join(reached, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        # one table again after a few steps, so that a long way does not make a long plan
        reached = reached.union(frontier) if steps % 8 < 7 else _stored(reached.union(frontier))
        steps += 1
    return reached


def closure_within(edges: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """(seed, node): what each node of ``sizes`` (node, size) reaches, itself included; a seed whose nodes have come to more than ``limit``
    together is not followed on, so it has some of its nodes, over the limit already. A step looks again only at seeds that still
    grow and fit. Sizes are not negative; null counts as nothing."""
    sizes = sizes.groupBy("node").agg(F.coalesce(F.min("size"), F.lit(0)).alias("size"))
    e = _stored(edges.select("from", F.col("to").alias("node")).distinct().join(sizes, "node").select("from", F.col("node").alias("to"), F.col("size").alias("to_size")))
    own = _stored(sizes.select(F.col("node").alias("seed"), "node", "size"))
    reached = frontier = own.filter(F.col("size") <= limit)
    done, steps = own.filter(F.col("size") > limit), 0
    while True:
        step = frontier.join(e, frontier["node"] == e["from"]).select("seed", F.col("to").alias("node"), F.col("to_size").alias("size")).distinct()
        new = _stored(step.join(reached, ["seed", "node"], "left_anti"))
        if new.isEmpty():
            return done.union(reached).select("seed", "node")
        grown = reached.withColumn("new", F.lit(False)).union(new.withColumn("new", F.lit(True)))
        live = _stored(grown.groupBy("seed").agg(F.sum("size").alias("all"), F.max("new").alias("new")).filter(F.col("new") & (F.col("all") <= limit)).select("seed"))
        done = done.union(grown.drop("new").join(live, "seed", "left_anti"))
        # one table again after a few steps, so that a long way does not make a long plan
        done = done if steps % 8 < 7 else _stored(done)
        reached, frontier, steps = _stored(grown.drop("new").join(live, "seed", "left_semi")), new.join(live, "seed", "left_semi"), steps + 1


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("from")), "from", "left_semi").join(nodes.select(F.col("node").alias("to")), "to", "left_semi")


def simple_paths(edges: DataFrame, starts: DataFrame, extend: Column, most_steps: int | None = None) -> DataFrame:
    """(start, hops, node): paths without a repeated node, from each start; ``extend`` (over the edge's columns and node)
    says whether a path may go on from the node that it has reached. Without ``most_steps`` all of them, which may be many."""
    frontier = _stored(starts.select("start", F.array("start").alias("hops"), F.col("start").alias("node"), F.lit(True).alias("open")))
    out = frontier.filter("false")
    for _ in count() if most_steps is None else range(most_steps):
        e = edges.withColumn("go_on", extend)
        step = frontier.filter("open").join(e, frontier["node"] == e["from"]).filter(~F.array_contains("hops", F.col("to")))
        frontier = _stored(step.select("start", F.concat("hops", F.array("to")).alias("hops"), F.col("to").alias("node"), F.col("go_on").alias("open")).distinct())
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out.drop("open")


def _cyclic(edges: DataFrame) -> DataFrame:
    """The edges inside strong components of two nodes or more. Nodes that nothing leads to, or that lead nowhere, are peeled off
    layer by layer first; of what is left, an edge lies on a cycle if its end reaches its start, which is a closure of the rest alone."""
    e = edges
    while True:
        kept = _stored(e.join(e.select(F.col("from").alias("to")).distinct(), "to", "left_semi").select("from", "to").join(e.select(F.col("to").alias("from")).distinct(), "from", "left_semi"))
        if kept.count() == e.count():
            break
        e = kept
    if e.isEmpty():
        return e
    reach = closure(e, e.select(F.col("to").alias("seed")).distinct())
    return _stored(e.join(reach.select(F.col("seed").alias("to"), F.col("node").alias("from")), ["from", "to"], "left_semi"))


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle): every simple cycle once, from its least node; a self edge is [a, a]. Only edges that lie on some cycle are walked, so
    a graph without cycles costs no paths; the number of simple cycles itself can be exponential."""
    e = _stored(edges.select("from", "to").distinct())
    found = e.filter(F.col("from") == F.col("to")).select(F.array("from", "to").alias("cycle"))
    e = _cyclic(e.filter(F.col("from") != F.col("to")))
    # a cycle is walked from its least node only, so a path never steps below its start
    paths = _stored(e.filter(F.col("from") < F.col("to")).select(F.array("from", "to").alias("hops")))
    while not paths.isEmpty():
        last, first = F.element_at("hops", -1), F.element_at("hops", 1)
        step = paths.join(e, last == e["from"])
        found = found.union(step.filter(F.col("to") == first).select(F.col("hops").alias("cycle")))
        paths = _stored(step.filter((F.col("to") > first) & ~F.array_contains("hops", F.col("to"))).select(F.concat("hops", F.array("to")).alias("hops")))
    return found


def _first_paths(bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, base, path): the first path from each of ``nodes`` (node) to each of its bases. Of each node and base only the first path
    known so far is kept and, where it got better, walked on, so the work is bounded by pairs and not by paths."""
    first = F.min(F.struct("path", "seen")).alias("b")
    b = _stored(bases.select(F.col("node").alias("base"), F.col("place").alias("p"), F.col("base").alias("next")))
    own = bases.join(nodes, "node", "left_semi")
    step = _stored(own.groupBy("node", "base").agg(F.min(F.struct(F.array("place").alias("path"), F.array("node", "base").alias("seen"))).alias("b")).select("node", "base", "b.*"))
    best = step
    while True:
        on = step.join(b, "base").filter(~F.array_contains("seen", F.col("next")))
        on = on.select("node", F.col("next").alias("base"), F.concat("path", F.array("p")).alias("path"), F.concat("seen", F.array("next")).alias("seen")).groupBy("node", "base").agg(first)
        known = best.select("node", "base", F.col("path").alias("known"))
        step = _stored(on.join(known, ["node", "base"], "left").filter(F.col("known").isNull() | (F.col("b.path") < F.col("known"))).select("node", "base", "b.*"))
        if step.isEmpty():
            break
        best = _stored(best.join(step.select("node", "base"), ["node", "base"], "left_anti").union(step))
    return best.select("node", "base", "path")


def linearised(bases: DataFrame) -> DataFrame:
    """(node, base, place): each node's bases in depth-first preorder, each once. ``bases``: (node, place, base). A path of
    places sorts as the walk goes, and of several paths to a base the first holds.

    From the nodes without bases upwards a node's order is that of its bases put one behind the other, each base before its own ones,
    what came before left out; so an order is passed on once along each edge, and no path is ever held. Nodes that reach a cycle
    have no such order of steps: there, and only there, the first path to each base is searched for."""
    e = _stored(bases.select("node", "place", "base").distinct())
    none = F.array().cast(f"array<{e.schema['base'].dataType.simpleString()}>")
    tops = e.select("base").distinct().join(e.select(F.col("node").alias("base")), "base", "left_anti")
    # orders that are known, and of which the nodes above are still to be told
    known, waiting, told, out = _stored(tops.select(F.col("base").alias("of"), none.alias("under"))), e, None, []
    while True:
        same = F.col("base").eqNullSafe(F.col("of"))
        found = waiting.join(known, same).select("node", F.struct("place", "base", "under").alias("part"), F.lit(False).alias("open"))
        waiting = _stored(waiting.join(known.select("of"), same, "left_anti"))
        rows = found.unionByName(waiting.select("node", F.lit(True).alias("open")), allowMissingColumns=True)
        each = (rows if told is None else rows.unionByName(told)).groupBy("node").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.bool_or("open").alias("open"))
        under = F.array_distinct(F.flatten(F.transform("parts", lambda x: F.concat(F.array(x["base"]), x["under"]))))
        each = _stored(each.select("node", "open", F.when(F.col("open"), F.col("parts")).alias("parts"), F.when(~F.col("open"), under).alias("under")))
        ready = each.filter("NOT open")
        if ready.isEmpty():
            break
        out.append(ready.select("node", F.posexplode("under").alias("place", "base")).select("node", "base", "place"))
        told = each.filter("open").select("node", F.explode("parts").alias("part"), F.lit(False).alias("open"))
        known = ready.select(F.col("node").alias("of"), "under")
    if not waiting.isEmpty():
        paths = _first_paths(e, waiting.select("node").distinct())
        out.append(paths.select("node", "base", (F.row_number().over(Window.partitionBy("node").orderBy("path")) - 1).alias("place")))
    return reduce(DataFrame.union, out) if out else e.select("node", "base", F.lit(0).alias("place"))


def privilege_paths(functions: DataFrame, calls: DataFrame, delegates: DataFrame) -> DataFrame:
    """(contract, function, target_contract, target_function, hops, ambiguous, matched): from each function that anyone may call and
    that changes state, all functions of other contracts of that kind which it reaches, with a shortest way there.

    ``functions``: (contract, name, signature, exposed, readonly, guarded), a row for each overload; ``calls``: (from, function,
    to, method); ``delegates``: (from, to). A call reaches a name if any of its overloads is unguarded, and goes on from there,
    also through one that only reads; a name whose overloads are all guarded ends the branch. A contract that delegates
    reaches every exposed unguarded function of the other. A call without a method is not guessed. ``ambiguous`` says that the
    target has several overloads, ``matched`` has the signatures of those that are exposed, unguarded and change state. An unknown
    guard counts as none.

    Ways are never enumerated: each start keeps a node at its first step only, with the least node before it and the way to that one, which
    goes on with the frontier alone. So of several shortest ways the one with the least nodes, from its end, comes out. Pairs are compared by
    numbers of the names in their order."""
    free = ~F.coalesce("guarded", F.lit(False))
    shown = free & F.coalesce("exposed", F.lit(False))
    hit = shown & ~F.coalesce("readonly", F.lit(False))
    node = lambda contract, name: F.struct(F.col(contract).alias("contract"), F.col(name).alias("name"))
    names = functions.groupBy(node("contract", "name").alias("at")).agg(
        F.bool_or(free).alias("open"), F.bool_or(shown).alias("shown"), F.bool_or(hit).alias("target"), (F.count("*") > 1).alias("ambiguous"), F.sort_array(F.collect_set(F.when(hit, F.col("signature")))).alias("matched")
    )
    names = _stored(names.orderBy("at").withColumn("node", F.monotonically_increasing_id()))
    own = calls.filter(F.col("method").isNotNull()).select(node("from", "function").alias("caller"), node("to", "method").alias("at")).distinct()
    own = own.join(names.filter("open").select("at", F.col("node").alias("to")), "at")
    own = _stored(own.join(names.select(F.col("at").alias("caller"), "node"), "caller").select("node", "to", "at"))
    # all functions of a contract that delegates lead to the other one: the least of them stands for it
    whole = _stored(delegates.select("from", "to").distinct().join(names.select(F.col("at.contract").alias("from"), "node"), "from").select("node", F.col("to").alias("other")))
    of_contract = names.filter("shown").select(F.col("at.contract").alias("other"), F.col("node").alias("to"), "at")

    frontier = _stored(names.filter("target").select(F.col("node").alias("start"), "node", F.array("at").alias("hops")))
    reached, met, steps = frontier.select("start", "node"), [], 0
    while not frontier.isEmpty():
        last = F.struct(F.col("node").alias("before"), "hops").alias("last")
        called = frontier.select("start", "node", last).join(own, "node").select("start", F.col("to").alias("node"), "last", "at")
        handed = frontier.select("start", "node", last).join(whole, "node").groupBy("start", "other").agg(F.min("last").alias("last"))
        handed = handed.join(of_contract, "other").select("start", F.col("to").alias("node"), "last", "at")
        step = called.union(handed).join(reached, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min(F.struct("last", "at")).alias("x"))
        frontier = _stored(step.select("start", "node", F.concat("x.last.hops", F.array("x.at")).alias("hops")))
        met.append(frontier)
        reached = reached.union(frontier.select("start", "node")) if steps % 8 < 7 else _stored(reached.union(frontier.select("start", "node")))
        steps += 1

    first, target = F.element_at("hops", 1), F.element_at("hops", -1)
    found = reduce(DataFrame.union, met) if met else frontier
    found = found.filter(first["contract"] != target["contract"]).join(names.filter("target").select("node", "ambiguous", "matched"), "node")
    return found.select(first["contract"].alias("contract"), first["name"].alias("function"), target["contract"].alias("target_contract"), target["name"].alias("target_function"), "hops", "ambiguous", "matched")
