"""Answering a query from a view: the view's rows must hold all that the query needs, and what the view lacks is joined and filtered again above it.

A view folds into a query where its relations are among the query's, its joins among the query's joins, its conditions implied by the query's, and its
outputs hold each column that the query still reads of them. Full coverage reads the view only; partial coverage joins the remaining relations to it.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from dataclasses import dataclass, replace

from . import expr as X
from . import ir, proof, rewrites
from .expr import E

NONE, PARTIAL, FULL = "none", "partial", "full"
LEAST_ATTRIBUTES = 0.5


@dataclass(frozen=True)
class Constraints:
    """Keys and references, tables and columns in lower case: primary key columns, (table, column) -> (table, column), columns that are never NULL."""

    keys: Mapping[str, tuple[str, ...]]
    references: Mapping[tuple[str, str], tuple[str, str]]
    not_null: frozenset[tuple[str, str]]


@dataclass(frozen=True)
class Fold:
    coverage: str
    plan: ir.Node | None
    reasons: tuple[str, ...] = ()
    covered: tuple[str, ...] = ()
    remaining: tuple[str, ...] = ()
    boundary: tuple[rewrites.JoinEdge, ...] = ()


def coverage(query: ir.Node, view: ir.Node) -> tuple[str, frozenset[str]]:
    """How far the view's base tables are the query's; CTE names are no base tables."""
    ctes = {c.name.lower() for n in (*query.walk(), *view.walk()) if isinstance(n, ir.With) for c in n.ctes}
    q, v = ({s.table.lower() for s in rewrites.scans(n)} - ctes for n in (query, view))
    return (NONE if not q & v else FULL if q <= v else PARTIAL), frozenset(q & v)


def spj_reasons(node: ir.Node) -> tuple[str, ...]:
    """Why a plan is no select-project-join, empty where it is one."""
    return tuple(sorted(rewrites.features(node) & rewrites.NOT_SPJ))


def boundary(query: ir.Node, covered: set[str]) -> tuple[rewrites.JoinEdge, ...]:
    """Joins between covered relations and others: the plan by which the rest is joined to the view."""
    return tuple(e for e in rewrites.join_graph(query) if (e.left in covered) != (e.right in covered))


def self_join_safe(node: ir.Node, view: ir.Node, constraints: Constraints) -> bool:
    """A table that occurs twice may be answered by the view only if the view keeps its primary key."""
    tables = [s.table.lower() for s in rewrites.scans(node)]
    twice = {t for t in tables if tables.count(t) > 1}
    kept = {c[1].lower() for text, _ in _block(view).items for c in X.parse(text).columns()} if isinstance(_block(view), ir.Project) else set()
    return all(constraints.keys.get(t) and set(constraints.keys[t]) <= kept for t in twice & {s.table.lower() for s in rewrites.scans(view)})


def outer_to_inner(node: ir.Node, constraints: Constraints) -> ir.Node:
    """Left joins along a reference become inner: the referencing column is never NULL and the referenced side is the table itself."""

    def rule(n: ir.Node) -> ir.Node:
        if isinstance(n, ir.Join) and n.how == "left" and isinstance(n.right, ir.Scan) and len(n.on) == 1:
            e = X.parse(n.on[0])
            where = {rewrites.alias_of(s).lower(): s.table.lower() for s in rewrites.scans(n)}
            if e.op == "=" and all(a.op == "col" and a.value[0] for a in e.args):
                for a, b in (e.args, e.args[::-1]):
                    x, y = ((where.get(c.value[0].lower()), c.value[1].lower()) for c in (a, b))
                    on_left = any(rewrites.alias_of(s).lower() == a.value[0].lower() for s in rewrites.scans(n.left))
                    if on_left and y[0] == n.right.table.lower() and constraints.references.get(x) == y and x in constraints.not_null and not _nullable(n.left, a.value[0].lower()):
                        return replace(n, how="inner")
        return n

    return node.rewritten(rule)


def _nullable(node: ir.Node, alias: str) -> bool:
    """Whether outer joins below can fill the relation with NULLs."""
    for n in node.walk():
        if isinstance(n, ir.Join) and n.how in ("left", "right", "full"):
            lost = {"left": [n.right], "right": [n.left], "full": [n.left, n.right]}[n.how]
            if any(rewrites.alias_of(s).lower() == alias for side in lost for s in rewrites.scans(side)):
                return True
    return False


def correlated_safe(conjuncts: tuple[str, ...], covered: set[str]) -> bool:
    """Whether subquery predicates name relations that stay outside the view only."""
    for c in conjuncts:
        for x in X.parse(c).walk():
            if x.op in ("exists", "in query", "scalar"):
                from .parser import to_algebra

                inner = to_algebra(x.value)
                own = {rewrites.alias_of(s) for s in rewrites.scans(inner)}
                named = {t for f in inner.walk() if isinstance(f, ir.Filter) for p in f.conjuncts for t, _ in X.parse(p).columns() if t and t not in own}
                if named & covered:
                    return False
    return True


def _block(node: ir.Node) -> ir.Node:
    """Below sorts and limits."""
    while isinstance(node, (ir.Sort, ir.Limit)):
        node = node.child
    return node


def _relations(node: ir.Node) -> tuple[ir.Node, list[E], list[tuple[str, str]]] | None:
    """The projection or aggregate of a block, conditions of the joins below it, and its (table, alias) pairs; None where joins are not inner."""
    for n in node.walk():
        if isinstance(n, ir.Join) and (n.how not in ("inner", "cross") or n.using or n.natural) or isinstance(n, (ir.SetOp, ir.With, ir.Alias, ir.DistinctOn)):
            return None
    return node, rewrites.predicates(node), [(s.table.lower(), rewrites.alias_of(s)) for s in rewrites.scans(node)]


def fold(query: ir.Node, view: ir.Node, name: str, constraints: Constraints | None = None) -> Fold:
    """The query over the view called `name`, or why it does not fold."""
    part, _ = coverage(query, view)
    if part == NONE:
        return Fold(NONE, None, ("no common table",))
    if reasons := spj_reasons(view):
        return Fold(NONE, None, tuple(f"view has {r}" for r in reasons))
    block = _block(query)
    below = block.child if isinstance(block, (ir.Project, ir.Aggregate)) else block
    if isinstance(below, ir.Aggregate):
        below = below.child
    q, v = _relations(below), _relations(_block(view))
    if q is None or v is None:
        return Fold(NONE, None, ("joins that are not inner, or nested queries",))
    if constraints and not self_join_safe(query, view, constraints):
        return Fold(NONE, None, ("a self join whose key the view lacks",))
    reasons = ["relations of the view are not all in the query"]
    for pick in itertools.product(*([a for t, a in q[2] if t == table] for table, _ in v[2])):
        if len(set(pick)) < len(pick):
            continue
        m = dict(zip((a for _, a in v[2]), pick, strict=True))
        got = _folded(query, q, v, _block(view), m, name)
        if isinstance(got, Fold):
            return got
        reasons.append(got)
    return Fold(NONE, None, tuple(dict.fromkeys(reasons)))


def _qualify(e: E, relations: list[tuple[str, str]]) -> E:
    """Bare columns of a single relation get its alias."""
    only = relations[0][1] if len(relations) == 1 else None
    return e.map(lambda x: X.col(x.value[1], only) if x.op == "col" and not x.value[0] and only else x)


def _folded(query: ir.Node, q, v, view: ir.Node, m: dict[str, str], name: str) -> Fold | str:
    _, conditions, relations = q
    _, needed, theirs = v
    conditions = [_qualify(c, relations) for c in conditions]
    move = lambda e: _qualify(e, theirs).map(lambda x: X.col(x.value[1], m.get(x.value[0], x.value[0])) if x.op == "col" else x)
    facts = X.canonical(X.all_of(conditions))
    for c in needed:
        if proof.implication(facts, X.canonical(move(c))) != proof.PROVED:
            return f"the query does not imply {move(c)}"
    covered = set(m.values())
    mapping: dict[tuple[str, str], str] = {}
    for text, out in view.items if isinstance(view, ir.Project) else ():
        e = move(X.parse(text))
        if e.op == "col":
            mapping.setdefault((e.value[0], e.value[1].lower()), out)
    above: list[str] = []

    def over(e: E) -> E:
        def rule(x: E) -> E:
            if x.op == "col" and x.value[0] in covered:
                key = (x.value[0], x.value[1].lower())
                if key not in mapping:
                    above.append(X.to_text(x))
                    return x
                return X.col(mapping[key], name)
            return x

        return _qualify(e, relations).map(rule)

    exact, _ = rewrites.keep_over_view(conditions, [move(c) for c in needed])
    kept = tuple(X.to_text(over(c)) for c in exact)
    rest = [r for r in relations if r[1] not in covered]
    node: ir.Node = ir.Scan(name)
    for t, a in rest:
        node = ir.Join(node, ir.Scan(t, a), "cross")
    node = ir.Filter(node, kept) if kept else node

    def rebuilt(n: ir.Node) -> ir.Node:
        match n:
            case ir.Sort() | ir.Limit():
                return replace(n, child=rebuilt(n.child))
            case ir.Project(ir.Aggregate() as a, _, _):
                return replace(n, child=rebuilt(a))
            case ir.Project(_, items, distinct):
                return ir.Project(node, tuple((X.to_text(over(X.parse(e))), o) for e, o in items), distinct)
            case ir.Aggregate(_, keys, measures, having):
                return ir.Aggregate(node, *(tuple((X.to_text(over(X.parse(e))), o) for e, o in part) for part in (keys, measures)), having)
        raise TypeError(n)

    plan = rebuilt(query)
    if above:
        read = len({*above}) + len([x for x in mapping])
        share = 1 - len(set(above)) / max(1, read)
        return f"the view lacks {', '.join(sorted(set(above)))}" + ("" if share >= LEAST_ATTRIBUTES else ", more than half")
    full = FULL if not rest else PARTIAL
    return Fold(full, plan, (), tuple(sorted(covered)), tuple(sorted(a for _, a in rest)), boundary(query, covered))


def best_fold(query: ir.Node, views: Mapping[str, ir.Node], constraints: Constraints | None = None) -> tuple[str, Fold] | None:
    """The view that leaves the fewest relations to join."""
    found = [(n, f) for n, view in sorted(views.items()) if (f := fold(query, view, n, constraints)).plan is not None]
    return min(found, key=lambda x: len(x[1].remaining), default=None)
