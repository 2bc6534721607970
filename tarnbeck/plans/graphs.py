"""Closures, cycles, paths, linearisation and proxies on graphs made from parts, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import graph as H
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles
_EDGES = "e AS (SELECT p_partkey AS a, p_partkey // 4 AS b FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 6 + p_size % 2 FROM part UNION SELECT 0, 3)"


def _edges(t):
    """Each part to the ones at a quarter and a sixth of its key; 0 leads back to 3, so there are cycles."""
    p, k = t("part"), F.col("p_partkey")
    own = p.filter("p_partkey > 0").select(k.alias("from"), F.floor(k / 4).alias("to")).union(p.select(k, F.floor(k / 6) + F.col("p_size") % 2))
    return own.union(p.agg(F.min(k), (F.min(k) + 3))).distinct()


@_q.add("H1_closure", f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS seed, p_partkey AS node FROM part UNION SELECT seed, b FROM r JOIN e ON a = node) SELECT seed, node FROM r""")
def _(t):
    return H.closure(_edges(t), t("part").select(F.col("p_partkey").alias("seed")))


@_q.add("H4_linearisation", """
WITH RECURSIVE b AS (SELECT p_partkey AS node, 1 AS place, p_partkey // 4 AS base FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, 2, p_partkey // 6 FROM part WHERE p_partkey > 0),
 w AS (SELECT node, base, [place] AS path, [node, base] AS seen FROM b UNION ALL SELECT w.node, b.base, list_append(path, b.place), list_append(seen, b.base) FROM w JOIN b ON b.node = w.base WHERE NOT list_contains(seen, b.base)),
 f AS (SELECT node, base, min(path) AS path FROM w GROUP BY 1, 2) SELECT node, base, row_number() OVER (PARTITION BY node ORDER BY path) - 1 AS place FROM f""")
def _(t):
    p, k = t("part").filter("p_partkey > 0"), F.col("p_partkey")
    bases = p.select(k.alias("node"), F.lit(1).alias("place"), F.floor(k / 4).alias("base")).union(p.select(k, F.lit(2), F.floor(k / 6)))
    return H.linearised(bases).select("node", "base", F.col("place").cast("long").alias("place"))


@_q.add("H5_privilege_paths", f"""
WITH RECURSIVE {_EDGES},
 g AS (SELECT p_partkey // 8 AS c, p_partkey % 8 // 2 AS f, p_partkey AS k, p_size % 3 = 0 AS guarded, p_size % 5 <> 0 AS exposed, p_type = 'SMALL' AS readonly FROM part),
 n AS (SELECT c, f, bool_or(NOT guarded) AS open, bool_or(exposed AND NOT guarded) AS shown, bool_or(exposed AND NOT guarded AND NOT readonly) AS target, count(*) > 1 AS ambiguous,
        list(k ORDER BY k) FILTER (exposed AND NOT guarded AND NOT readonly) AS matched FROM g GROUP BY c, f),
 s AS (SELECT a // 8 AS c, a % 8 // 2 AS f, n.c AS tc, n.f AS tf FROM e JOIN n ON n.c = b // 8 AND n.f = b % 8 // 2 AND open WHERE b % 11 <> 0
       UNION SELECT x.c, x.f, y.c, y.f FROM n x JOIN n y ON y.c = x.c // 3 AND y.shown WHERE x.c % 50 = 3),
 w AS (SELECT c AS sc, f AS sf, c, f, [c * 10 + f] AS back FROM n WHERE target
       UNION ALL SELECT sc, sf, tc, tf, list_prepend(tc * 10 + tf, back) FROM w JOIN s USING (c, f) WHERE NOT list_contains(back, tc * 10 + tf)),
 p AS (SELECT sc, sf, c, f, first(back ORDER BY len(back), back) AS back FROM w WHERE sc <> c GROUP BY sc, sf, c, f)
SELECT sc AS contract, sf AS function, c AS target_contract, f AS target_function, [h // 10 || '.' || h % 10 FOR h IN list_reverse(back)] AS hops, ambiguous, matched FROM p JOIN n USING (c, f) WHERE target""")
def _(t):
    contract, name = lambda c: F.floor(F.col(c) / 8), lambda c: F.floor(F.col(c) % 8 / 2)
    size = F.col("p_size")
    functions = t("part").select(contract("p_partkey").alias("contract"), name("p_partkey").alias("name"), F.col("p_partkey").alias("signature"), (size % 3 == 0).alias("guarded"), (size % 5 != 0).alias("exposed"), (F.col("p_type") == "SMALL").alias("readonly"))
    calls = _edges(t).select(contract("from").alias("from"), name("from").alias("function"), contract("to").alias("to"), F.when(F.col("to") % 11 != 0, name("to")).alias("method"))
    delegates = functions.select(F.col("contract").alias("from")).filter("from % 50 = 3").withColumn("to", F.floor(F.col("from") / 3))
    found = H.privilege_paths(functions, calls, delegates)
    return found.withColumn("hops", F.transform("hops", lambda h: F.concat_ws(".", h["contract"].cast("string"), h["name"].cast("string"))))


@_q.add("H6_delegate_cycles", """
WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 3 + s_nationkey) % 100 AS b FROM supplier UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_nationkey = 3),
 w AS (SELECT a AS start, [a, b] AS hops, b AS node FROM e WHERE a < b UNION ALL SELECT start, list_append(hops, b), b FROM w JOIN e ON a = node WHERE b > start AND NOT list_contains(hops, b))
SELECT hops AS cycle FROM w JOIN e ON a = node AND b = start UNION ALL SELECT [a, a] FROM e WHERE a = b""")
def _(t):
    s = F.col("s_suppkey")
    edges = t("supplier").select(s.alias("from"), ((s * 3 + F.col("s_nationkey")) % 100).alias("to")).union(t("supplier").filter("s_nationkey = 3").select(s, s))
    return H.cycles(edges)


@_q.add("H7_selector_clash", """
WITH f AS (SELECT DISTINCT l_suppkey AS c, l_partkey % 60 AS sig FROM lineitem WHERE l_quantity > 44), p AS (SELECT s_suppkey AS proxy, (s_suppkey + 1) % 100 AS impl FROM supplier WHERE s_nationkey < 12)
SELECT proxy, impl, list_sort(list(a.sig)) AS clashes FROM p JOIN f a ON a.c = proxy JOIN f b ON b.c = impl AND b.sig = a.sig GROUP BY 1, 2""")
def _(t):
    f = t("lineitem").filter("l_quantity > 44").select(F.col("l_suppkey").alias("c"), (F.col("l_partkey") % 60).alias("sig")).distinct()
    pairs = t("supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("proxy"), ((F.col("s_suppkey") + 1) % 100).alias("impl"))
    a, b = f.select(F.col("c").alias("proxy"), "sig"), f.select(F.col("c").alias("impl"), "sig")
    return pairs.join(a, "proxy").join(b, ["impl", "sig"]).groupBy("proxy", "impl").agg(F.sort_array(F.collect_list("sig")).alias("clashes"))


@_q.add("H8_context_bundle", f"""
WITH {_EDGES} SELECT p_partkey, p_name, (SELECT list_sort(list(b)) FROM e WHERE a = p_partkey) AS calls, (SELECT list_sort(list(a)) FROM e WHERE b = p_partkey) AS called_by FROM part""")
def _(t):
    e = _edges(t)
    out = e.groupBy(F.col("from").alias("p_partkey")).agg(F.sort_array(F.collect_list("to")).alias("calls"))
    into = e.groupBy(F.col("to").alias("p_partkey")).agg(F.sort_array(F.collect_list("from")).alias("called_by"))
    return t("part").select("p_partkey", "p_name").join(out, "p_partkey", "left").join(into, "p_partkey", "left")
