"""Evidence from a query workload: how much of its weight carries a feature, and how tables are joined."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import expr as X
from ..plans import ir, parser, proof, rewrites
from . import graph


def feature_support(queries: DataFrame, features: DataFrame) -> DataFrame:
    """queries (cluster, query, weight), features (query, feature) -> cluster, feature, support: the share of the cluster's weight that has the feature.

    A feature that a query names twice counts once. Clusters without weight have no rows.
    """
    total = queries.groupBy("cluster").agg(F.sum("weight").alias("total"))
    part = queries.join(features.distinct(), "query").groupBy("cluster", "feature").agg(F.sum("weight").alias("part"))
    return part.join(total, "cluster").where("total > 0").select("cluster", "feature", (F.col("part") / F.col("total")).alias("support"))


def invariants(support: DataFrame, least: float = 0.8) -> DataFrame:
    """cluster, feature, invariant: features of support `least` or more belong to every view of the cluster, others are optional."""
    return support.select("cluster", "feature", (F.col("support") >= least).alias("invariant"))


def join_graph(edges: DataFrame) -> DataFrame:
    """edges (a, b, weight), each pair of tables in either order -> node, degree, weighted_degree, centrality (its share of all weighted degrees).

    Self joins join no two tables and are left out. degree counts distinct neighbours.
    """
    one = edges.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    ends = one.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    total = nodes.agg(F.sum("weighted_degree").alias("total"))  # one row
    return nodes.join(F.broadcast(total)).select("node", "degree", "weighted_degree", (F.col("weighted_degree") / F.col("total")).alias("centrality"))


# ---- patterns of queries

# Weights of the kinds of features in the likeness of two patterns.
KINDS = {"relation": 1.0, "join": 2.0, "predicate": 1.5, "column": 1.0, "group": 2.0}


@dataclass(frozen=True)
class Pattern:
    """Features of one query: (kind, text) pairs, aggregates and flags."""

    features: frozenset[tuple[str, str]]
    aggregates: tuple[str, ...]
    flags: frozenset[str]


def pattern(sql: str) -> Pattern:
    """What a query touches: relations, join edges and predicates by table (values as ?), read columns, group keys; texts that do not parse have table names only."""
    try:
        node = parser.to_algebra(sql)
    except ValueError:
        return Pattern(frozenset(("relation", t) for t in parser.table_refs(sql)), (), frozenset({"unparsed"}))
    table = {rewrites.alias_of(s).lower(): s.table.lower() for s in rewrites.scans(node)}
    only = next(iter(table.values())) if len(set(table.values())) == 1 else None
    full = lambda c: f"{table.get((c[0] or '').lower(), only or (c[0] or '?'))}.{c[1].lower()}"
    out = {("relation", t) for t in table.values()}
    for e in rewrites.join_graph(node):
        out.add(("join", "=".join(sorted((full((e.left, e.left_column)), full((e.right, e.right_column)))))))
    for p in rewrites.predicates(node):
        if not (p.op == "=" and all(a.op == "col" for a in p.args)):
            shape = X.canonical(p).map(lambda x: X.col(*reversed(full(x.value).rsplit(".", 1))) if x.op == "col" else X.col("?") if x.op in ("lit", "typed") else x)
            out.add(("predicate", X.to_text(shape).replace("`", "")))
    aggregates = []
    for n in node.walk():
        texts = [e for e, _ in n.items] if isinstance(n, ir.Project) else [e for e, _ in n.keys + n.measures] if isinstance(n, ir.Aggregate) else []
        if isinstance(n, ir.Project) and isinstance(n.child, ir.Aggregate):
            texts = []  # names of the aggregate below
        out |= {("column", full(c)) for t in texts if t != "*" for c in X.parse(t).columns()}
        if isinstance(n, ir.Aggregate):
            out |= {("group", full(c)) for t, _ in n.keys for c in X.parse(t).columns()}
            aggregates += [m.lower() for m, _ in n.measures]
    return Pattern(frozenset(out), tuple(sorted(aggregates)), rewrites.features(node))


@lru_cache(maxsize=4096)
def _feature_rows(sql: str) -> list[dict[str, str]]:
    return [{"kind": k, "feature": f} for k, f in sorted(pattern(sql).features)]


def _features(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: _feature_rows(s or ""))


def features(queries: DataFrame) -> DataFrame:
    """queries (query, sql) -> query, kind, feature, one row for each feature of a query."""
    found = F.pandas_udf(_features, "array<struct<kind:string,feature:string>>")
    return queries.select("query", F.explode(found("sql")).alias("f")).select("query", "f.*").distinct()


def similarities(feats: DataFrame, kinds: dict[str, float] = KINDS) -> DataFrame:
    """a, b, similarity: weighted Jaccard of the queries that share a feature; a < b. Patterns are templates of a workload, not its executions."""
    weight = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("kind")]
    f = feats.select("query", F.concat_ws(":", "kind", "feature").alias("feature"), weight.alias("w"))
    size = f.groupBy("query").agg(F.sum("w").alias("size"))
    x, y = f.alias("x"), f.alias("y")
    both = x.join(y, (F.col("x.feature") == F.col("y.feature")) & (F.col("x.query") < F.col("y.query"))).groupBy(F.col("x.query").alias("a"), F.col("y.query").alias("b")).agg(F.sum("x.w").alias("both"))
    sa, sb = size.select(F.col("query").alias("a"), F.col("size").alias("na")), size.select(F.col("query").alias("b"), F.col("size").alias("nb"))
    return both.join(sa, "a").join(sb, "b").select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))


def clusters(queries: DataFrame, pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """query, cluster: single linkage at `least`, named by the least member; rounds of least neighbours until nothing changes."""
    near = pairs.where(F.col("similarity") >= least)
    links = graph.cut(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = graph.cut(queries.select("query", F.col("query").alias("cluster")))
    while True:
        seen = links.join(label, links["b"] == label["query"]).groupBy("a").agg(F.min("cluster").alias("low"))
        step = label.join(seen, label["query"] == seen["a"], "left").select("query", F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"))
        # a jump along the labels themselves shortens chains
        up = step.select(F.col("query").alias("cluster"), F.col("cluster").alias("top"))
        new = graph.cut(step.join(up, "cluster").select("query", F.col("top").alias("cluster")))
        if new.join(label.withColumnRenamed("cluster", "was"), "query").where("cluster != was").isEmpty():
            return new
        label = new


# ---- evidence


def evidence(queries: DataFrame, feats: DataFrame, kind: str) -> DataFrame:
    """feature, n, weight: how many queries (query, weight) carry a feature of a kind, and their weight."""
    return feats.where(F.col("kind") == kind).select("query", "feature").distinct().join(queries.select("query", "weight"), "query").groupBy("feature").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


# Shares of grouping and joining in a candidate key's score.
KEY_GROUP, KEY_JOIN, KEY_LEAST = 2.0, 1.5, 0.7


def candidate_keys(queries: DataFrame, feats: DataFrame, least: float = KEY_LEAST) -> DataFrame:
    """column, score of columns that queries group and join by."""
    total = queries.agg(F.sum("weight").alias("total"))
    use = feats.where("kind = 'group'").select("query", F.col("feature").alias("column"), F.lit(1).alias("g"), F.lit(0).alias("j")).unionByName(feats.where("kind = 'join'").select("query", F.explode(F.split("feature", "=")).alias("column"), F.lit(0).alias("g"), F.lit(1).alias("j")))
    per = use.groupBy("query", "column").agg(F.max("g").alias("g"), F.max("j").alias("j")).join(queries.select("query", "weight"), "query")
    score = per.groupBy("column").agg(F.sum(F.col("weight") * (KEY_GROUP * F.col("g") + KEY_JOIN * F.col("j"))).alias("s")).crossJoin(F.broadcast(total))  # one row
    return score.select("column", F.round(F.col("s") / F.col("total"), 6).alias("score")).where(F.col("score") >= least)


def global_support(queries: DataFrame, feats: DataFrame) -> DataFrame:
    """feature, support of the whole workload (query, cluster, weight), clusters that carry it, their share of all, and support times share."""
    total = queries.agg(F.sum("weight").alias("total"), F.countDistinct("cluster").alias("all"))
    f = feats.select("query", "feature").distinct().join(queries, "query").groupBy("feature").agg(F.sum("weight").alias("part"), F.countDistinct("cluster").alias("clusters")).crossJoin(F.broadcast(total))  # one row
    support, share = F.col("part") / F.col("total"), F.col("clusters") / F.col("all")
    return f.select("feature", F.round(support, 6).alias("support"), "clusters", F.round(share, 6).alias("coverage"), F.round(support * share, 6).alias("score"))


def base_features(overall: DataFrame, least: float = 0.7, clusters: int = 3) -> DataFrame:
    return overall.where((F.col("support") >= least) & (F.col("clusters") >= clusters)).select("feature")


def special_features(overall: DataFrame, local: DataFrame, rare: float = 0.3, least: float = 0.7) -> DataFrame:
    """cluster, feature: rare in the workload, common in the cluster (feature_support)."""
    return local.where(F.col("support") >= least).join(overall.where(F.col("support") < rare).select("feature"), "feature", "left_semi").select("cluster", "feature")


def overlap(feats: DataFrame, clusters_: DataFrame) -> DataFrame:
    """a, b, shared: numbers of features that two clusters (query, cluster) have in common; a < b."""
    own = feats.join(clusters_, "query").select("cluster", "feature").distinct()
    x, y = own.alias("x"), own.alias("y")
    return x.join(y, (F.col("x.feature") == F.col("y.feature")) & (F.col("x.cluster") < F.col("y.cluster"))).groupBy(F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b")).agg(F.count("*").alias("shared"))


def statistics(queries: DataFrame, feats: DataFrame) -> DataFrame:
    """One row about a workload (query, weight): queries, weight, distinct relations, joins and predicates."""
    by = feats.groupBy().agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col("feature"))).alias(f"{k}s") for k in ("relation", "join", "predicate")))
    return queries.agg(F.count("*").alias("queries"), F.sum("weight").alias("weight")).crossJoin(by)  # one row each


# ---- shapes of the join graph


def hubs(nodes: DataFrame, least: float = 0.15, degree: int = 3) -> DataFrame:
    """Nodes of a join graph whose share of all weighted degrees is at least `least`, with `degree` neighbours."""
    return nodes.where((F.col("centrality") >= least) & (F.col("degree") >= degree)).select("node", "degree", "centrality")


def star(edges: DataFrame, share: float = 0.7, degree: int = 3) -> DataFrame:
    """centre, degree, share of the other tables that touch only the centre; no row where no table is a star's centre. edges (a, b)."""
    one = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = one.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    deg = ends.groupBy("node").agg(F.count("*").alias("degree"))
    only = ends.join(deg.where("degree = 1").select("node"), "node", "left_semi").groupBy(F.col("other").alias("node")).agg(F.count("*").alias("leaves"))
    others = deg.agg((F.count("*") - 1).alias("others"))
    got = deg.join(only, "node").crossJoin(F.broadcast(others)).where((F.col("degree") >= degree) & (F.col("leaves") / F.col("others") >= share))  # one row
    return got.orderBy(F.desc("degree"), "node").limit(1).select(F.col("node").alias("centre"), "degree", F.round(F.col("leaves") / F.col("others"), 6).alias("share"))


class JoinShape:
    """A workload's join graph on the driver: as large as its tables and their joins, not its queries. Edges (a, b, weight)."""

    def __init__(self, edges: list[tuple[str, str, float]]):
        self.weight: dict[tuple[str, str], float] = {}
        for a, b, w in edges:
            if a != b:
                k = (min(a, b), max(a, b))
                self.weight[k] = self.weight.get(k, 0) + w
        self.near: dict[str, set[str]] = {}
        for a, b in self.weight:
            self.near.setdefault(a, set()).add(b)
            self.near.setdefault(b, set()).add(a)

    def centrality(self) -> dict[str, float]:
        total = 2 * sum(self.weight.values()) or 1
        return {n: sum(self.edge(n, m) for m in near) / total for n, near in sorted(self.near.items())}

    def edge(self, a: str, b: str) -> float:
        return self.weight[min(a, b), max(a, b)]

    def path_weight(self, path: list[str]) -> float:
        return min(self.edge(a, b) for a, b in zip(path, path[1:], strict=False))

    def hubs(self, least: float = 0.15, degree: int = 3) -> list[str]:
        c = self.centrality()
        return sorted((n for n in c if c[n] >= least and len(self.near[n]) >= degree), key=lambda n: (-c[n], n))

    def chains(self, hubs: list[str]) -> list[tuple[list[str], float]]:
        """Walks from ends through tables of two neighbours up to a hub or a branching; three tables at least."""
        out = {}
        for start in sorted(n for n, near in self.near.items() if len(near) == 1):
            path = [start]
            while True:
                nxt = sorted(self.near[path[-1]] - set(path))
                if len(nxt) != 1:
                    break
                path.append(nxt[0])
                if path[-1] in hubs or len(self.near[path[-1]]) > 2:
                    break
            if len(path) >= 3:
                out[min(tuple(path), tuple(reversed(path)))] = self.path_weight(path)
        return [(list(p), w) for p, w in sorted(out.items(), key=lambda x: (-x[1], x[0]))]

    def distances(self, start: str) -> dict[str, list[str]]:
        """Shortest paths to all reachable tables, ties by name."""
        paths, front = {start: [start]}, [start]
        while front:
            nxt = []
            for n in front:
                for m in sorted(self.near.get(n, ())):
                    if m not in paths:
                        paths[m] = [*paths[n], m]
                        nxt.append(m)
            front = nxt
        return paths

    def boundaries(self, hubs: list[str]) -> list[tuple[list[str], float]]:
        """Each table goes to the hub that reaches it first; a view's score is the share of its joins that stay inside. Without a hub all tables are one view."""
        if not self.near:
            return []
        if not hubs:
            return [(sorted(self.near), 1.0)]
        reach = {h: self.distances(h) for h in hubs}
        group: dict[str, list[str]] = {h: [] for h in hubs}
        for n in sorted(self.near):
            found = [(len(reach[h][n]), i, h) for i, h in enumerate(hubs) if n in reach[h]]
            if found:
                group[min(found)[2]].append(n)
        out = []
        for h in hubs:
            mine = set(group[h])
            inside = sum(a in mine and b in mine for a, b in self.weight)
            edge = sum((a in mine) != (b in mine) for a, b in self.weight)
            out.append((sorted(mine), inside / (inside + edge) if inside + edge else 0.0))
        return out

    def canonical_paths(self, hubs: list[str], ends: tuple[str, str] | None = None, longest: int = 5) -> list[tuple[list[str], float]]:
        """Shortest paths between two tables, or all hubs, and the chains; the heaviest first."""
        pairs = [ends] if ends else [(a, b) for i, a in enumerate(hubs) for b in hubs[i + 1 :]]
        found = [p for a, b in pairs if (p := self.distances(a).get(b)) and 1 < len(p) <= longest]
        out = [(p, self.path_weight(p)) for p in found] + ([] if ends else self.chains(hubs))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def components(self) -> list[list[str]]:
        left, out = set(self.near), []
        while left:
            part = set(self.distances(min(left)))
            out.append(sorted(part))
            left -= part
        return out

    def suggestions(self, least: float = 0.15) -> list[tuple[str, list[str]]]:
        """Views worth having: hubs with their neighbours, connected parts, and each heaviest pair."""
        out = [("hub", sorted({h, *self.near[h]})) for h in self.hubs(least)]
        out += [("connected", c) for c in self.components() if len(c) > 2]
        return out + [("pair", list(k)) for k, w in sorted(self.weight.items(), key=lambda x: (-x[1], x[0])) if w == max(self.weight.values())]


# ---- views


@dataclass(frozen=True)
class View:
    """A view made from a cluster of queries: its plan where it could be verified, else the parts its members share."""

    members: tuple[str, ...]
    plan: ir.Node | None
    relations: tuple[str, ...]
    joins: tuple[str, ...]
    predicates: tuple[str, ...]
    columns: tuple[str, ...]
    verified: bool


# Least support of a join, a predicate and a column of a derived view, and how many views there are at most.
VIEW_JOIN, VIEW_PREDICATE, VIEW_COLUMN, MAX_VIEWS = 0.5, 0.8, 0.3, 50


def derived_features(queries: DataFrame, feats: DataFrame) -> DataFrame:
    """cluster, kind, feature, support of the parts that belong to each cluster's view. queries (query, cluster, weight)."""
    total = queries.groupBy("cluster").agg(F.sum("weight").alias("total"))
    part = feats.distinct().join(queries, "query").groupBy("cluster", "kind", "feature").agg(F.sum("weight").alias("part")).join(total, "cluster").withColumn("support", F.col("part") / F.col("total"))
    least = F.create_map(*(F.lit(x) for kv in {"relation": VIEW_JOIN, "join": VIEW_JOIN, "predicate": VIEW_PREDICATE, "column": VIEW_COLUMN, "group": VIEW_COLUMN}.items() for x in kv))
    return part.where(F.col("support") >= least[F.col("kind")]).select("cluster", "kind", "feature", F.round("support", 6).alias("support"))


def learned_view(queries: dict[str, str]) -> View:
    """The view of a cluster (name -> SQL): the greatest common part of its members where all are conjunctive, checked to hold each of them; else shared features only."""
    pats = [pattern(s) for s in queries.values()]
    shared = frozenset.intersection(*(p.features for p in pats))
    of = lambda k: tuple(sorted(f for kind, f in shared if kind == k))
    plan = None
    try:
        parts = [proof.conjunctive(parser.to_algebra(s)) for s in queries.values()]
        common = proof.greatest_common(parts)
        if common and common.head:
            plan = proof.algebra(common)
            bare = [proof.Conjunctive(tuple((n, c) for n, c in p.head if n in dict(common.head)), p.atoms, p.classes, p.conditions) for p in parts]
            plan = plan if all(proof.contained(b, proof.Conjunctive(tuple(x for x in common.head if x[0] in dict(b.head)), common.atoms, common.classes, common.conditions)) for b in bare) else None
    except ValueError:
        plan = None
    return View(tuple(sorted(queries)), plan, of("relation"), of("join"), of("predicate"), of("column"), plan is not None)


def hierarchy(views: dict[str, frozenset[tuple[str, str]]], base: frozenset[tuple[str, str]]) -> list[tuple[str, str | None, frozenset]]:
    """(view, parent, its own features): a base view of the features that all clusters share, and each cluster's beyond it."""
    return [("base", None, base), *((n, "base" if base <= f else None, f - base) for n, f in sorted(views.items()))]


# ---- topologies


@dataclass(frozen=True)
class Topology:
    """Relations (numbered where one occurs again) and equalities between their columns."""

    relations: frozenset[str]
    edges: frozenset[str]


def topology(sql: str) -> Topology:
    """Of a query: occurrences of a table are numbered in the order of their joins' columns, so aliases do not matter."""
    node = parser.to_algebra(sql)
    scans = rewrites.scans(node)
    joins = rewrites.join_graph(node)
    mark = {rewrites.alias_of(s): sorted((e.left_column if e.left == rewrites.alias_of(s) else e.right_column) for e in joins if rewrites.alias_of(s) in (e.left, e.right)) for s in scans}
    name: dict[str, str] = {}
    for t in sorted({s.table.lower() for s in scans}):
        own = sorted((rewrites.alias_of(s) for s in scans if s.table.lower() == t), key=lambda a: (mark[a], a))
        for k, a in enumerate(own):
            name[a] = t if not k else f"{t}#{k + 1}"
    return Topology(frozenset(name.values()), frozenset("=".join(sorted((f"{name[e.left]}.{e.left_column.lower()}", f"{name[e.right]}.{e.right_column.lower()}"))) for e in joins if e.left in name and e.right in name))


def topology_similarity(a: Topology, b: Topology) -> float:
    """0.4 of the relations' and 0.6 of the edges' Jaccard; two topologies without edges have equal edges."""
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return 0.4 * j(a.relations, b.relations) + 0.6 * j(a.edges, b.edges)


def topology_common(ts: list[Topology]) -> Topology:
    return Topology(frozenset.intersection(*(t.relations for t in ts)), frozenset.intersection(*(t.edges for t in ts)))


def is_subtopology(a: Topology, b: Topology) -> bool:
    return a.relations <= b.relations and a.edges <= b.edges


def is_connected(t: Topology) -> bool:
    shape = JoinShape([(*(x.rsplit(".", 1)[0] for x in e.split("=")), 1.0) for e in t.edges])
    return len(t.relations) < 2 or set(shape.near) >= t.relations and len(shape.components()) == 1


def topology_plan(t: Topology) -> ir.Node:
    """Relations joined greedily along edges; what no edge reaches is a cross join."""
    alias = {r: r.replace("#", "_").replace(".", "_") for r in sorted(t.relations)}
    conds = [(e, [x.rsplit(".", 1) for x in e.split("=")]) for e in sorted(t.edges)]
    left = sorted(t.relations)
    have = [left.pop(0)]
    node: ir.Node = ir.Scan(have[0].split("#")[0], alias[have[0]])
    while left:
        nxt = next((r for r in left if any({x[0], y[0]} <= {*have, r} and r in (x[0], y[0]) for _, (x, y) in conds)), left[0])
        left.remove(nxt)
        on = tuple(f"{alias[x[0]]}.{x[1]} = {alias[y[0]]}.{y[1]}" for _, (x, y) in conds if nxt in (x[0], y[0]) and {x[0], y[0]} <= {*have, nxt})
        have.append(nxt)
        node = ir.Join(node, ir.Scan(nxt.split("#")[0], alias[nxt]), "inner" if on else "cross", on)
    return node


def learned_topologies(queries: dict[str, str], least: float = 0.3) -> list[tuple[str, tuple[str, ...], Topology, float]]:
    """(name, members, common topology, mean weight of its edges): average linkage at `least`; a star is named by its centre. Queries are a workload's templates."""
    tops = {n: topology(s) for n, s in sorted(queries.items())}
    groups = [[n] for n in tops]
    while len(groups) > 1:
        best = max(((sum(topology_similarity(tops[x], tops[y]) for x in a for y in b) / (len(a) * len(b)), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < least:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    out = []
    for g in groups:
        common = topology_common([tops[n] for n in g])
        shape = JoinShape([(*(x.rsplit(".", 1)[0] for x in e.split("=")), 1.0) for e in common.edges])
        centre = next((n for n, near in sorted(shape.near.items()) if len(near) >= 3 and all(len(shape.near[m]) == 1 for m in near)), None)
        name = f"star_{centre}" if centre else "_".join(sorted(common.relations)) or "mixed"
        every = frozenset().union(*(tops[n].edges for n in g))
        out.append((name, tuple(sorted(g)), common, len(common.edges) / len(every) if every else 1.0))
    return sorted(out)
