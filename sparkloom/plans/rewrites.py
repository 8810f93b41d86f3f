"""Rewrites of the algebra above Catalyst: canonical joins, decorrelation, outer-join safety, predicates kept over a view."""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import expr as X
from . import ir
from .expr import E


def scans(node: ir.Node) -> list[ir.Scan]:
    return [n for n in node.walk() if isinstance(n, ir.Scan) and n.table != ir.DUAL]


def alias_of(scan: ir.Scan) -> str:
    return scan.alias or scan.table.split(".")[-1]


def predicates(node: ir.Node, joins: bool = True) -> list[E]:
    """Atomic filter conditions of a plan, with those of inner joins if asked for."""
    out: list[E] = []
    for n in node.walk():
        if isinstance(n, ir.Filter) or joins and isinstance(n, ir.Join) and n.how == "inner":
            out += [X.parse(c) for c in (n.conjuncts if isinstance(n, ir.Filter) else n.on)]
    return out


@dataclass(frozen=True)
class JoinEdge:
    left: str
    left_column: str
    right: str
    right_column: str
    how: str


def join_graph(node: ir.Node) -> list[JoinEdge]:
    """Equalities between columns of two relations, from join conditions and filters, by aliases; the lesser side first."""
    out = set()
    for n in node.walk():
        if isinstance(n, (ir.Join, ir.Filter)):
            for c in n.on if isinstance(n, ir.Join) else n.conjuncts:
                e = X.parse(c)
                if e.op == "=" and all(a.op == "col" and a.value[0] for a in e.args) and e.args[0].value[0] != e.args[1].value[0]:
                    (a, x), (b, y) = sorted(a.value for a in e.args)
                    out.add(JoinEdge(a, x, b, y, n.how if isinstance(n, ir.Join) else "inner"))
    return sorted(out, key=lambda j: (j.left, j.left_column, j.right, j.right_column))


def simple_join_graph(node: ir.Node) -> list[tuple[str, str, str]]:
    """(left, right, predicate) of every join condition between two relations."""
    out = []
    for n in node.walk():
        if isinstance(n, ir.Join):
            for c in n.on:
                names = sorted({t for t, _ in X.parse(c).columns() if t})
                if len(names) == 2:
                    out.append((*names, c))
    return sorted(out)


def flatten_inner(node: ir.Node) -> ir.Node:
    """Inner and cross joins of a block become one left-deep chain of cross joins in the order met, their conditions one filter above."""

    def parts(n: ir.Node) -> tuple[list[ir.Node], list[str]]:
        if isinstance(n, ir.Join) and n.how in ("inner", "cross") and not n.using and not n.natural:
            (a, x), (b, y) = parts(n.left), parts(n.right)
            return a + b, x + y + list(n.on)
        if isinstance(n, ir.Filter) and isinstance(n.child, ir.Join) and n.child.how in ("inner", "cross"):
            a, x = parts(n.child)
            return a, x + list(n.conjuncts)
        return [n], []

    def go(n: ir.Node) -> ir.Node:
        relations, conditions = parts(n)
        if len(relations) > 1:
            out = go(relations[0])
            for r in relations[1:]:
                out = ir.Join(out, go(r), "cross")
            return ir.Filter(out, tuple(dict.fromkeys(conditions))) if conditions else out
        new = {f: go(v) for f, v in vars(n).items() if isinstance(v, ir.Node)}
        return replace(n, **new) if new else n

    return go(node)


def canonical_joins(node: ir.Node) -> ir.Node:
    """Flattened, relations in alphabetical order, conditions canonical and sorted: equal for queries that differ in join order only."""

    def rule(n: ir.Node) -> ir.Node:
        if isinstance(n, ir.Filter):
            texts = tuple(sorted({X.to_text(X.canonical(X.parse(c))) for c in n.conjuncts}))
            if isinstance(n.child, ir.Join) and n.child.how == "cross":
                return ir.Filter(ordered(n.child), texts)
            return ir.Filter(n.child, texts)
        return n

    def chain(n: ir.Node) -> list[ir.Node]:
        return chain(n.left) + [n.right] if isinstance(n, ir.Join) and n.how == "cross" else [n]

    def ordered(n: ir.Join) -> ir.Node:
        first, *rest = sorted(chain(n), key=lambda r: repr(r).lower())
        for r in rest:
            first = ir.Join(first, r, "cross")
        return first

    return flatten_inner(ir.merge_filters(node)).rewritten(rule)


def same_structure(a: ir.Node, b: ir.Node) -> bool:
    return canonical_joins(a) == canonical_joins(b)


def implies_quickly(a: E, b: E) -> bool:
    """Equal, a conjunct of a, or one of b's disjuncts: no reasoning over values."""
    a, b = X.canonical(a), X.canonical(b)
    return a == b or b in X.conjuncts(a) or any(implies_quickly(a, d) for d in X.disjuncts(b) if d != b) or a.op == "or" and all(implies_quickly(d, b) for d in X.disjuncts(a))


# ---- decorrelation


class NotDecorrelated(ValueError):
    """A subquery that has no join form here."""


def split_correlated(conjuncts: tuple[str, ...], inner: set[str]) -> tuple[list[str], list[str]]:
    """Conjuncts of a subquery that name relations outside it, and the others."""
    out: tuple[list[str], list[str]] = ([], [])
    for c in conjuncts:
        out[all(t is None or t.lower() in inner for t, _ in X.parse(c).columns())].append(c)
    return out


def decorrelate(node: ir.Node) -> ir.Node:
    """EXISTS and IN become semi joins, NOT EXISTS anti joins, NOT IN a null-aware anti join, an uncorrelated scalar subquery a one-row cross join."""
    nth = [0]

    def rule(n: ir.Node) -> ir.Node:
        if not isinstance(n, ir.Filter):
            return n
        plain, child = [], n.child
        for c in n.conjuncts:
            e = X.parse(c)
            if not any(x.op in ("exists", "in query", "scalar") for x in e.walk()):
                plain.append(c)
                continue
            body = e.args[0] if e.op == "not" else e
            if body.op == "exists":
                child = _half_join(child, body.value, [], e.op == "not", nth)
            elif body.op == "in query":
                child = _half_join(child, body.value, [body.args[0]], e.op == "not", nth)
            else:
                child, new = _scalars(child, e, nth)
                plain.append(X.to_text(new))
        return ir.Filter(child, tuple(plain)) if plain else child

    return node.rewritten(rule)


def _half_join(child: ir.Node, query: str, asked: list[E], negated: bool, nth: list[int]) -> ir.Node:
    from .parser import to_algebra

    sub = decorrelate(to_algebra(query))
    block = sub
    if not isinstance(block, ir.Project):
        if asked:
            raise NotDecorrelated(query)
        block = ir.Project(block, (("1", "one"),))
    below = block.child
    inner = {alias_of(s).lower() for s in scans(below)} | {n.name.lower() for n in below.walk() if isinstance(n, ir.Alias)}
    outer, kept = ([], [])
    if isinstance(below, ir.Filter):
        outer, kept = split_correlated(below.conjuncts, inner)
        below = ir.Filter(below.child, tuple(kept)) if kept else below.child
    elif isinstance(below, ir.Aggregate) and any(split_correlated(f.conjuncts, inner)[0] for f in below.walk() if isinstance(f, ir.Filter)):
        raise NotDecorrelated("a correlated aggregate")
    nth[0] += 1
    side = f"sub{nth[0]}"
    # columns of the subquery that conditions name get names of their own
    names: dict[tuple[str | None, str], str] = {}

    def renamed(e: E) -> E:
        return e.map(lambda x: X.col(names.setdefault(x.value, f"c{len(names)}"), side) if x.op == "col" and x.value[0] and x.value[0].lower() in inner else x)

    on = [X.to_text(renamed(X.parse(c))) for c in outer]
    items = [(X.to_text(X.col(c, t)), n) for (t, c), n in names.items()]
    if asked:
        value = X.parse(block.items[0][0])
        items.append((X.to_text(value), "value"))
        same = E("=", (asked[0], X.col("value", side)))
        # NOT IN holds only where no comparison is unknown
        on.insert(0, X.to_text(E("or", (same, E("is null", (asked[0],)), E("is null", (X.col("value", side),))))) if negated else X.to_text(same))
    if isinstance(below, ir.Aggregate) or not asked:
        right: ir.Node = ir.Project(below, tuple(items) or (("1", "one"),))
    else:
        right = ir.Project(below, tuple(items), not outer and not negated)
    return ir.Join(child, ir.Alias(right, side), "left_anti" if negated else "left_semi", tuple(on) or ("1 = 1",))


def _scalars(child: ir.Node, e: E, nth: list[int]) -> tuple[ir.Node, E]:
    from .parser import to_algebra

    holder = [child]

    def rule(x: E) -> E:
        if x.op != "scalar":
            return x
        sub = decorrelate(to_algebra(x.value))
        if not (isinstance(sub, ir.Project) and isinstance(sub.child, ir.Aggregate) and not sub.child.keys):
            raise NotDecorrelated("a scalar subquery that is no global aggregate")
        inner = {alias_of(s).lower() for s in scans(sub)}
        if any(split_correlated(f.conjuncts, inner)[0] for f in sub.walk() if isinstance(f, ir.Filter)):
            raise NotDecorrelated("a correlated scalar subquery")
        nth[0] += 1
        side = f"sub{nth[0]}"
        holder[0] = ir.Join(holder[0], ir.Alias(ir.Project(sub.child, ((sub.items[0][0], f"{side}_value"),)), side), "cross")
        return X.col(f"{side}_value", side)

    new = e.map(rule)
    return holder[0], new


# ---- over a view


def keep_over_view(query: list[E], view: list[E]) -> tuple[list[E], list[E]]:
    """Predicates of a query to apply above a view, and those the view already has exactly."""
    have = {X.canonical(v) for v in view}
    return [q for q in query if X.canonical(q) not in have], [q for q in query if X.canonical(q) in have]


def renamed_columns(e: E, mapping: dict[tuple[str, str], str], view: str) -> E | None:
    """The expression over the view's outputs; None where it needs a column that the view does not give."""
    missing = [c for c in e.columns() if c not in mapping]
    return None if missing else e.map(lambda x: X.col(mapping[x.value], view) if x.op == "col" else x)


def outer_join_safe(node: ir.Node, covered: set[str]) -> bool:
    """Whether the covered relations (aliases) stand on the preserved side of each outer join that they share with others."""
    for n in node.walk():
        if isinstance(n, ir.Join) and n.how in ("left", "right", "full"):
            left, right = ({alias_of(s) for s in scans(x)} for x in (n.left, n.right))
            if covered >= left | right or not covered & (left | right):
                continue
            lost = {"left": right, "right": left, "full": left | right}[n.how]
            if covered & lost:
                return False
    return True


def features(node: ir.Node) -> frozenset[str]:
    """What a plan uses: the vector that decides which rewrites may touch it."""
    out = set()
    for n in node.walk():
        match n:
            case ir.Aggregate():
                out.add("aggregation")
            case ir.SetOp():
                out.add("set")
            case ir.Project(_, _, True) | ir.DistinctOn():
                out.add("distinct")
            case ir.Join(how=how) if how in ("left", "right", "full"):
                out.add("outer")
            case ir.Join(how=how) if how in ("left_semi", "left_anti"):
                out.add("semi")
            case ir.Sort():
                out.add("order")
            case ir.Limit():
                out.add("limit")
            case ir.With(recursive=True):
                out.add("recursion")
            case ir.Alias(lateral=True):
                out.add("lateral")
        texts = n.conjuncts if isinstance(n, ir.Filter) else n.on if isinstance(n, ir.Join) else [e for e, _ in n.items if e != "*"] if isinstance(n, ir.Project) else ()
        for t in texts:
            for x in X.parse(t).walk():
                out |= {"window"} if x.op == "over" else {"subquery"} if x.op in ("exists", "in query", "scalar") else {"or"} if x.op == "or" else {"volatile"} if X.is_volatile(x) and x.op == "call" else set()
    aliases = [s.table for s in scans(node)]
    if len(aliases) > len(set(aliases)):
        out.add("self join")
    return frozenset(out)


NOT_SPJ = frozenset({"aggregation", "set", "distinct", "window", "subquery", "recursion", "lateral", "limit", "outer", "semi"})


def capabilities(node: ir.Node) -> dict[str, bool]:
    f = features(node)
    return {"spj": not f & NOT_SPJ, "spjg": not f & (NOT_SPJ - {"aggregation"}), "provable": not f & (NOT_SPJ | {"volatile"}), "algebraic": not f & {"recursion", "lateral", "volatile"}}
