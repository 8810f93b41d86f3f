"""Implication and containment: whether one condition's truth forces another's, and one query's rows are among another's.

Implication is under WHERE semantics: wherever p is TRUE, q is TRUE. Four layers answer in turn: equal texts, the values each column can still take,
linear arithmetic over exact fractions, and a search for a row that makes p TRUE and q not. The first three prove, the last refutes; else the verdict is unknown.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

from . import expr as X
from . import ir, rewrites
from .expr import E

PROVED, REFUTED, UNKNOWN = "proved", "refuted", "unknown"
MAX_INEQUALITIES, MAX_VARIABLES, MAX_ROWS = 1000, 20, 20_000


# ---- evaluation


def like_pattern(pattern: str) -> re.Pattern:
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), re.S)


def _compare(op: str, a, b) -> bool | None:
    if a is None or b is None:
        return None
    if isinstance(a, str) != isinstance(b, str):
        return None
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class Unevaluated(ValueError):
    """An expression that needs more than the row."""


def evaluate(e: E, row: dict[tuple[str | None, str], object]):
    """The value over a row by three-valued logic."""
    go = lambda x: evaluate(x, row)
    match e.op:
        case "lit":
            return Fraction(e.value) if isinstance(e.value, (int, Decimal)) and not isinstance(e.value, bool) else e.value
        case "typed":
            return e.value[1]
        case "col":
            return row[e.value]
        case "and":
            v = [go(a) for a in e.args]
            return False if False in v else None if None in v else True
        case "or":
            v = [go(a) for a in e.args]
            return True if True in v else None if None in v else False
        case "not":
            v = go(e.args[0])
            return None if v is None else not v
        case "is null":
            return go(e.args[0]) is None
        case "in":
            v = [_compare("=", go(e.args[0]), go(a)) for a in e.args[1:]]
            return True if True in v else None if None in v else False
        case "like" | "ilike":
            a, b = go(e.args[0]), go(e.args[1])
            return None if a is None or b is None or not isinstance(a, str) else bool(like_pattern(b.lower() if e.op == "ilike" else b).fullmatch(a.lower() if e.op == "ilike" else a))
        case "neg":
            v = go(e.args[0])
            return None if v is None else -v
        case "+" | "-" | "*" | "/" | "%":
            a, b = go(e.args[0]), go(e.args[1])
            if a is None or b is None or e.op in "/%" and b == 0 or isinstance(a, str) or isinstance(b, str):
                return None
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e.op]()
    if e.op in X.COMPARISONS:
        return _compare(e.op, go(e.args[0]), go(e.args[1]))
    raise Unevaluated(e.op)


# ---- values a column can take


@dataclass
class Values:
    """What a conjunction leaves of a column: a range, perhaps a finite set, values taken out, patterns, and whether NULL is out."""

    low: object = None
    low_open: bool = False
    high: object = None
    high_open: bool = False
    among: frozenset | None = None
    out: frozenset = frozenset()
    likes: tuple[str, ...] = ()
    known: bool = False  # not NULL
    null: bool = False  # is NULL

    def above(self, v, strict: bool) -> None:
        if self.low is None or v > self.low or v == self.low and strict:
            self.low, self.low_open = v, strict

    def below(self, v, strict: bool) -> None:
        if self.high is None or v < self.high or v == self.high and strict:
            self.high, self.high_open = v, strict

    def keep(self, vs: frozenset) -> None:
        self.among = vs if self.among is None else self.among & vs

    def allows(self, v) -> bool:
        if self.null or self.among is not None and v not in self.among or v in self.out:
            return False
        try:
            if self.low is not None and (v < self.low or v == self.low and self.low_open):
                return False
            if self.high is not None and (v > self.high or v == self.high and self.high_open):
                return False
        except TypeError:
            return False
        return all(like_pattern(p).fullmatch(str(v)) for p in self.likes)

    def finite(self) -> frozenset | None:
        if self.among is not None:
            return frozenset(v for v in self.among if self.allows(v))
        if self.low is not None and self.low == self.high and not (self.low_open or self.high_open):
            return frozenset([self.low])
        return None

    def empty(self) -> bool:
        if self.null and self.known:
            return True
        f = self.finite()
        if f is not None:
            return not f
        return self.low is not None and self.high is not None and (self.low > self.high or self.low == self.high and (self.low_open or self.high_open))


def _constant(e: E):
    try:
        return evaluate(e, {})
    except (KeyError, Unevaluated):
        return None


def values_of(parts: list[E]) -> dict[tuple[str | None, str], Values]:
    """By column what the atoms of a conjunction leave; equal columns share what is known."""
    out: dict = {}
    equal: list[tuple] = []
    for p in parts:
        p = X.canonical(p)
        if p.op in X.COMPARISONS and p.args[0].op == "col":
            v = out.setdefault(p.args[0].value, Values())
            v.known = True
            if p.args[1].op == "col":
                out.setdefault(p.args[1].value, Values()).known = True
                if p.op == "=":
                    equal.append((p.args[0].value, p.args[1].value))
                continue
            c = _constant(p.args[1])
            if c is None:
                for x in p.args[1].columns():
                    out.setdefault(x, Values()).known = True
                continue
            try:
                if p.op == "=":
                    v.keep(frozenset([c]))
                elif p.op == "<>":
                    v.out |= {c}
                elif p.op in (">", ">="):
                    v.above(c, p.op == ">")
                else:
                    v.below(c, p.op == "<")
            except TypeError:
                pass
        elif p.op in X.COMPARISONS:
            for x in p.columns():
                out.setdefault(x, Values()).known = True
        elif p.op == "in" and p.args[0].op == "col":
            v = out.setdefault(p.args[0].value, Values())
            v.known = True
            c = [_constant(a) for a in p.args[1:]]
            v.keep(frozenset(x for x in c if x is not None)) if all(a.op in ("lit", "typed", "neg") for a in p.args[1:]) else None
        elif p.op == "like" and p.args[0].op == "col" and p.args[1].op == "lit":
            v = out.setdefault(p.args[0].value, Values())
            v.known, v.likes = True, (*v.likes, p.args[1].value)
        elif p.op == "is null" and p.args[0].op == "col":
            out.setdefault(p.args[0].value, Values()).null = True
        elif p.op == "not":
            q = p.args[0]
            if q.op == "is null" and q.args[0].op == "col":
                out.setdefault(q.args[0].value, Values()).known = True
            elif q.op == "in" and q.args[0].op == "col":
                v = out.setdefault(q.args[0].value, Values())
                v.known, v.out = True, v.out | {c for a in q.args[1:] if (c := _constant(a)) is not None}
            elif q.op in ("like", "ilike"):
                for x in q.columns():
                    out.setdefault(x, Values()).known = True
    for _ in range(len(equal)):
        for a, b in equal:
            for x, y in ((out[a], out[b]), (out[b], out[a])):
                try:
                    if x.low is not None:
                        y.above(x.low, x.low_open)
                    if x.high is not None:
                        y.below(x.high, x.high_open)
                    if x.among is not None:
                        y.keep(x.among)
                    y.out |= x.out
                except TypeError:
                    pass
    return out


def _negations(e: E) -> E:
    """NOT pushed to the atoms, by the laws that hold in three-valued logic."""
    if e.op == "not":
        x = e.args[0]
        if x.op == "not":
            return _negations(x.args[0])
        if x.op in ("and", "or"):
            return E("or" if x.op == "and" else "and", tuple(_negations(E("not", (a,))) for a in x.args))
        if x.op in X.NEGATED:
            return E(X.NEGATED[x.op], x.args)
    if e.op in ("and", "or"):
        return E(e.op, tuple(map(_negations, e.args)))
    return e


def _by_values(p: dict, q: E) -> bool:
    """Whether what p leaves of q's column makes the atom q TRUE."""
    q = X.canonical(q)
    body = q.args[0] if q.op == "not" else q
    if not body.args or body.args[0].op != "col":
        return False
    v = p.get(body.args[0].value)
    if v is None:
        return False
    if q.op == "is null":
        return v.null
    if q.op == "not" and body.op == "is null":
        return v.known
    if not v.known:
        return False
    known = v.finite()
    if known:
        try:
            return all(evaluate(q, {body.args[0].value: x}) is True for x in known)
        except (KeyError, Unevaluated):
            return False
    c = _constant(q.args[1]) if q.op in X.COMPARISONS else None
    try:
        match q.op:
            case ">" | ">=" if c is not None:
                return v.low is not None and (v.low > c or v.low == c and (v.low_open or q.op == ">="))
            case "<" | "<=" if c is not None:
                return v.high is not None and (v.high < c or v.high == c and (v.high_open or q.op == "<="))
            case "<>" if c is not None:
                return not v.allows(c) and not v.likes or c in v.out
            case "like":
                return any(_like_within(a, q.args[1].value) for a in v.likes)
            case "not" if body.op == "in":
                return all((x := _constant(a)) is not None and not v.allows(x) for a in body.args[1:])
    except TypeError:
        return False
    return False


def _like_within(a: str, b: str) -> bool:
    """Whether every text that LIKE a matches is matched by b: equal, or b a prefix pattern of a's fixed start, or a's fixed end."""
    head = re.split("[%_]", a)[0]
    tail = re.split("[%_]", a)[-1]
    fixed = b.strip("%")
    if a == b:
        return True
    if "_" in b or "%" in fixed:
        return False
    if b == fixed + "%":
        return head.startswith(fixed)
    if b == "%" + fixed:
        return tail.endswith(fixed)
    return b == f"%{fixed}%" and any(fixed in part for part in re.split("[%_]", a))


# ---- linear arithmetic


class NotLinear(ValueError):
    pass


def linear(e: E) -> dict:
    """Coefficients by column, and the constant under None."""
    if e.op == "col":
        return {e.value: Fraction(1)}
    c = _constant(e)
    if isinstance(c, Fraction):
        return {None: c}
    if e.op == "neg":
        return {k: -v for k, v in linear(e.args[0]).items()}
    if e.op in "+-" and len(e.args) == 2:
        a, b = linear(e.args[0]), linear(e.args[1])
        return {k: a.get(k, 0) + (b.get(k, 0) if e.op == "+" else -b.get(k, 0)) for k in a.keys() | b.keys()}
    if e.op in "*/" and len(e.args) == 2:
        a, b = linear(e.args[0]), linear(e.args[1])
        if set(b) <= {None}:
            k = b.get(None, Fraction(0))
            if e.op == "*" or k:
                return {n: v * k if e.op == "*" else v / k for n, v in a.items()}
        if e.op == "*" and set(a) <= {None}:
            return {n: v * a.get(None, Fraction(0)) for n, v in b.items()}
    raise NotLinear(e.op)


def _at_most_zero(e: E) -> list[tuple[dict, bool]]:
    """A comparison as forms that are at most 0; strict ones below it."""
    a, b = linear(e.args[0]), linear(e.args[1])
    less = {k: a.get(k, Fraction(0)) - b.get(k, Fraction(0)) for k in a.keys() | b.keys()}
    more = {k: -v for k, v in less.items()}
    match e.op:
        case "<" | "<=":
            return [(less, e.op == "<")]
        case ">" | ">=":
            return [(more, e.op == ">")]
        case "=":
            return [(less, False), (more, False)]
    raise NotLinear(e.op)


def infeasible(forms: list[tuple[dict, bool]]) -> bool | None:
    """Whether no real numbers meet all forms, by eliminating one variable after another; None beyond the limits."""
    names = sorted({k for f, _ in forms for k in f if k is not None}, key=str)
    if len(names) > MAX_VARIABLES:
        return None
    for n in names:
        up = [(f, s) for f, s in forms if f.get(n, 0) > 0]
        down = [(f, s) for f, s in forms if f.get(n, 0) < 0]
        forms = [(f, s) for f, s in forms if not f.get(n, 0)]
        if len(forms) + len(up) * len(down) > MAX_INEQUALITIES:
            return None
        for (f, s), (g, t) in itertools.product(up, down):
            x, y = 1 / f[n], -1 / g[n]
            forms.append(({k: f.get(k, 0) * x + g.get(k, 0) * y for k in (f.keys() | g.keys()) - {n}}, s or t))
    return any(f.get(None, 0) > 0 or s and f.get(None, 0) == 0 for f, s in forms)


def _by_arithmetic(parts: list[E], q: E, known: set) -> bool:
    """q is a comparison of columns that p makes known; p with its opposite has no solution."""
    if q.op not in X.COMPARISONS or q.op == "<>" or not set(q.columns()) <= known:
        return False
    forms: list = []
    for p in parts:
        try:
            forms += _at_most_zero(p) if p.op in X.COMPARISONS else []
        except (NotLinear, TypeError):
            continue
    try:
        against = [E(op, q.args) for op in (("<", ">") if q.op == "=" else (X.NEGATED[q.op],))]
        return all(infeasible(forms + _at_most_zero(a)) for a in against)
    except (NotLinear, TypeError):
        return False


# ---- implication


def _refuting_row(p: E, q: E) -> dict | None:
    """A row over values near the constants that makes p TRUE and q not."""
    both = E("and", (p, q))
    columns = both.columns()
    numbers = sorted({c for e in both.walk() if e.op == "lit" and isinstance(c := _constant(e), Fraction)} | {-c for e in both.walk() if e.op == "neg" and isinstance(c := _constant(e.args[0]), Fraction)})
    texts = sorted({e.value for e in both.walk() if e.op == "lit" and isinstance(e.value, str)} | {e.value[1] for e in both.walk() if e.op == "typed"})
    near = sorted({c + d for c in numbers for d in (-1, Fraction(-1, 2), 0, Fraction(1, 2), 1)} | {(a + b) / 2 for a, b in zip(numbers, numbers[1:], strict=False)} | ({numbers[0] - numbers[-1] - 1, numbers[0] + numbers[-1] + 1} if numbers else set()))
    words = sorted({w for t in texts for w in (t, t + "z", t.replace("%", "").replace("_", "x"), t.replace("%", "qx"), "")})
    about: dict = {c: set() for c in columns}  # which kinds of constants a column meets
    for e in both.walk():
        if e.op in (*X.COMPARISONS, "in", "like", "ilike"):
            kinds = {"t" if x.op == "typed" or isinstance(x.value, str) else "n" for x in e.walk() if x.op in ("lit", "typed")}
            for c in e.columns():
                about[c] |= kinds
    choices = [[None, *(words if about[c] == {"t"} else near or [Fraction(0), Fraction(1)])] for c in columns]
    for k, row in enumerate(itertools.product(*choices)):
        if k >= MAX_ROWS:
            return None
        r = dict(zip(columns, row, strict=True))
        try:
            if evaluate(p, r) is True and evaluate(q, r) is not True:
                return r
        except (Unevaluated, TypeError):
            return None
    return None


def _proves(parts: tuple[E, ...], q: E) -> bool:
    alternatives = next((p for p in parts if p.op == "or"), None)
    if alternatives is not None:
        rest = tuple(p for p in parts if p is not alternatives)
        if rest and _proves(rest, q):
            return True
        return all(_proves((*rest, *X.conjuncts(d)), q) for d in X.disjuncts(alternatives))
    left = values_of(list(parts))
    if any(v.empty() for v in left.values()) or any(p.op == "lit" and p.value is not True for p in parts):
        return True  # p is never TRUE
    known = {c for c, v in left.items() if v.known}
    have = {X.canonical(p) for p in parts}

    def holds(q: E) -> bool:
        if q.op == "and":
            return all(map(holds, q.args))
        if q.op == "or":
            return any(map(holds, q.args)) or _covers(left, q)
        if q.op == "lit":
            return q.value is True
        return X.canonical(q) in have or _by_values(left, q) or _by_arithmetic(list(parts), q, known) or q.op == "in" and _covers(left, q)

    return holds(q)


def _covers(left: dict, q: E) -> bool:
    """A disjunction on one column that covers each of the finitely many values left."""
    columns = q.columns()
    if len(columns) != 1 or columns[0] not in left or not (known := left[columns[0]].finite()):
        return False
    try:
        return all(evaluate(q, {columns[0]: v}) is True for v in known)
    except (Unevaluated, TypeError):
        return False


@lru_cache(maxsize=4096)
def implication(p: E, q: E) -> str:
    """proved, refuted or unknown: wherever p is TRUE, q is TRUE."""
    p, q = X.canonical(_negations(p)), X.canonical(_negations(q))
    if rewrites.implies_quickly(p, q) or _proves(tuple(X.conjuncts(p)), q):
        return PROVED
    return REFUTED if _refuting_row(p, q) is not None else UNKNOWN


def implies(p: str | E, q: str | E) -> bool:
    p, q = (X.parse(x) if isinstance(x, str) else x for x in (p, q))
    return implication(p, q) == PROVED


def relaxed(a: list[E], b: list[E]) -> list[E]:
    """The strongest per-column conditions implied by both conjunctions: common atoms, the hull of ranges, the union of value lists."""
    va, vb = values_of(a), values_of(b)
    have = {X.canonical(x) for x in a} & {X.canonical(x) for x in b}
    out = sorted(have, key=X.to_text)
    for c in sorted(va.keys() & vb.keys(), key=str):
        x, y = va[c], vb[c]
        fx, fy = x.finite(), y.finite()
        here = X.E("col", (), c)
        new: list[E] = []
        try:
            if fx and fy:
                new.append(E("in", (here, *(_literal(v) for v in sorted(fx | fy)))) if len(fx | fy) > 1 else E("=", (here, _literal(next(iter(fx))))))
            else:
                lows = [(min(f), False) if f else (v.low, v.low_open) for f, v in ((fx, x), (fy, y))]
                highs = [(max(f), False) if f else (v.high, v.high_open) for f, v in ((fx, x), (fy, y))]
                if all(v is not None for v, _ in lows):
                    low = min(lows, key=lambda t: (t[0], t[1]))
                    new.append(E(">" if low[1] else ">=", (here, _literal(low[0]))))
                if all(v is not None for v, _ in highs):
                    high = max(highs, key=lambda t: (t[0], not t[1]))
                    new.append(E("<" if high[1] else "<=", (here, _literal(high[0]))))
        except TypeError:
            continue
        out += [n for n in new if not rewrites.implies_quickly(X.all_of(out), n)]
    return out


def _literal(v) -> E:
    return X.lit(v if not isinstance(v, Fraction) else int(v) if v.denominator == 1 else Decimal(v.numerator) / Decimal(v.denominator))


# ---- conjunctive queries


@dataclass(frozen=True)
class Conjunctive:
    """Head variables by output name, atoms (table, alias), what each (alias, column) stands for, and conditions over these."""

    head: tuple[tuple[str, tuple[str, str]], ...]
    atoms: tuple[tuple[str, str], ...]
    classes: tuple[frozenset, ...] = ()
    conditions: tuple[E, ...] = field(default=())

    def variable(self, c: tuple[str, str]):
        return next((k for k in self.classes if c in k), frozenset([c]))


class NotConjunctive(ValueError):
    pass


def conjunctive(node: ir.Node) -> Conjunctive:
    """Of a select-project-join plan whose columns are qualified (or whose only relation is clear)."""
    while isinstance(node, (ir.Sort,)):
        node = node.child
    if not isinstance(node, ir.Project) or rewrites.features(node) & (rewrites.NOT_SPJ - {"distinct"}):
        raise NotConjunctive("only selections, projections and inner joins")
    atoms = tuple((s.table.lower(), rewrites.alias_of(s)) for s in rewrites.scans(node))
    only = atoms[0][1] if len(atoms) == 1 else None

    def own(e: E) -> E:
        def rule(x: E) -> E:
            if x.op == "col" and not x.value[0]:
                if not only:
                    raise NotConjunctive(f"column {x.value[1]} has no relation")
                return X.col(x.value[1], only)
            return x

        return e.map(rule)

    head = []
    for text, name in node.items:
        e = own(X.parse(text))
        if e.op != "col":
            raise NotConjunctive("an output that is no column")
        head.append((name, e.value))
    classes: list[set] = []
    conditions = []
    for p in rewrites.predicates(node):
        p = own(p)
        if p.op == "=" and all(a.op == "col" for a in p.args):
            a, b = (x.value for x in p.args)
            joined = [k for k in classes if a in k or b in k]
            classes = [k for k in classes if k not in joined] + [set().union({a, b}, *joined)]
        else:
            conditions.append(p)
    return Conjunctive(tuple(head), atoms, tuple(sorted(map(frozenset, classes), key=lambda k: sorted(k))), tuple(conditions))


def algebra(q: Conjunctive) -> ir.Node:
    """The plan of a conjunctive query: relations joined along equal columns."""
    first, *rest = q.atoms
    node: ir.Node = ir.Scan(first[0], first[1])
    have, used = {first[1]}, []
    equal = [(a, b) for k in q.classes for a, b in zip(sorted(k), sorted(k)[1:], strict=False)]
    while rest:
        nxt = next((r for r in rest if any({a[0], b[0]} <= have | {r[1]} and r[1] in (a[0], b[0]) for a, b in equal)), rest[0])
        rest.remove(nxt)
        have.add(nxt[1])
        on = [p for p in equal if p not in used and {p[0][0], p[1][0]} <= have]
        used += on
        node = ir.Join(node, ir.Scan(nxt[0], nxt[1]), "inner" if on else "cross", tuple(X.to_text(E("=", (E("col", (), a), E("col", (), b)))) for a, b in on))
    left = [X.to_text(E("=", (E("col", (), a), E("col", (), b)))) for a, b in equal if (a, b) not in used] + [X.to_text(c) for c in q.conditions]
    return ir.Project(ir.Filter(node, tuple(left)) if left else node, tuple((X.to_text(E("col", (), c)), n) for n, c in q.head))


def homomorphisms(source: Conjunctive, target: Conjunctive) -> Iterator[dict[str, str]]:
    """Maps of source's relations to target's of the same table under which source's equalities hold."""
    choices = [[b for t, b in target.atoms if t == table] for table, _ in source.atoms]
    for pick in itertools.product(*choices):
        m = dict(zip((a for _, a in source.atoms), pick, strict=True))
        move = lambda c, m=m: (m[c[0]], c[1].lower())
        low = [frozenset((a, c.lower()) for a, c in k) for k in target.classes]
        if all(len({next((i for i, t in enumerate(low) if move(c) in t), move(c)) for c in k}) == 1 for k in source.classes):
            yield m


def _lower(c: tuple[str, str]) -> tuple[str, str]:
    return c[0], c[1].lower()


def contained(a: Conjunctive, b: Conjunctive) -> bool:
    """Whether every row of a is one of b's, as sets: a map from b to a that keeps the head and whose conditions a's imply."""
    if len(a.head) != len(b.head):
        return False
    same = lambda x, y: _lower(x) == _lower(y) or any({_lower(x), _lower(y)} <= {_lower(c) for c in k} for k in a.classes)
    facts = list(a.conditions) + [E("=", (E("col", (), x), E("col", (), y))) for k in a.classes for x, y in zip(sorted(k), sorted(k)[1:], strict=False)]
    for m in homomorphisms(b, a):
        if all(same((m[t], c), y) for (_, (t, c)), (_, y) in zip(b.head, a.head, strict=True)):
            goal = [p.map(lambda x, m=m: X.col(x.value[1], m[x.value[0]]) if x.op == "col" else x) for p in b.conditions]
            if all(implication(X.canonical(X.all_of(facts)), X.canonical(g)) == PROVED for g in goal):
                return True
    return False


def equivalent(a: ir.Node, b: ir.Node) -> str:
    """structural, containment (both ways) or no."""
    if rewrites.same_structure(a, b):
        return "structural"
    try:
        x, y = conjunctive(a), conjunctive(b)
    except NotConjunctive:
        return "no"
    return "containment" if contained(x, y) and contained(y, x) else "no"


def common_part(a: Conjunctive, b: Conjunctive) -> Conjunctive | None:
    """The least query that holds both's rows on their shared relations: relations paired by table, equalities both have, conditions relaxed, outputs shared."""
    pairs, taken = [], set()
    for t, x in a.atoms:
        free = [y for u, y in b.atoms if u == t and y not in taken]
        y = x if x in free else next(iter(free), None)
        if y is not None:
            taken.add(y)
            pairs.append((t, x, y))
    if not pairs:
        return None
    back = {y: x for _, x, y in pairs}
    mine = {x for _, x, _ in pairs}
    move = lambda e: e.map(lambda c: X.col(c.value[1], back[c.value[0]]) if c.op == "col" else c)
    inside = lambda e, names: all(t in names for t, _ in e.columns())
    theirs = [frozenset((back[t], c.lower()) for t, c in k if t in back) for k in b.classes]
    classes = []
    for k in a.classes:
        own = frozenset((t, c.lower()) for t, c in k if t in mine)
        classes += [own & o for o in theirs if len(own & o) > 1]
    conditions = relaxed([X.canonical(c) for c in a.conditions if inside(c, mine)], [X.canonical(move(c)) for c in b.conditions if inside(c, set(back))])
    wanted = {(back[t], c.lower()) for _, (t, c) in b.head if t in back}
    head = tuple((n, c) for n, c in a.head if _lower(c) in wanted)
    return Conjunctive(head, tuple((t, x) for t, x, _ in pairs), tuple(classes), tuple(conditions))


def meet(a: Conjunctive, b: Conjunctive) -> Conjunctive | None:
    """The query of the rows in both: same relations, all equalities and conditions of either; None where the relations differ."""
    if sorted(t for t, _ in a.atoms) != sorted(t for t, _ in b.atoms) or len({t for t, _ in a.atoms}) < len(a.atoms):
        return None
    name = {t: x for t, x in a.atoms}
    back = {y: name[t] for t, y in b.atoms}
    classes = [set(k) for k in a.classes]
    for k in b.classes:
        new = {(back[t], c) for t, c in k}
        joined = [x for x in classes if x & new]
        classes = [x for x in classes if x not in joined] + [set().union(new, *joined)]
    moved = [c.map(lambda e: X.col(e.value[1], back[e.value[0]]) if e.op == "col" else e) for c in b.conditions]
    return Conjunctive(a.head, a.atoms, tuple(map(frozenset, classes)), tuple(dict.fromkeys(X.canonical(c) for c in [*a.conditions, *moved])))


def greatest_common(queries: list[Conjunctive]) -> Conjunctive | None:
    """The common part of several queries, folded from the first."""
    out: Conjunctive | None = queries[0]
    for q in queries[1:]:
        out = common_part(out, q) if out else None
    return out
