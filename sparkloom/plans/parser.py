"""SQL text to relational algebra, and what can be told from a statement: tables, targets, columns and their lineage.

SELECT statements become nodes of `ir`: aggregation then projection, so composite outputs such as sum(a) / sum(b) keep their form; USING and NATURAL joins keep
their condition. Statements that this grammar does not know raise SqlError; `table_refs` then falls back to patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import expr as X
from . import ir
from .expr import E, Parser, SqlError

JOIN_WORDS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "LATERAL")


class QueryParser(Parser):
    def query(self) -> ir.Node:
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")

            def cte() -> ir.Cte:
                name = self.name()
                columns = ()
                if self.accept("("):
                    columns = tuple(self.listed(self.name))
                    self.expect(")")
                self.expect("AS")
                self.expect("(")
                body = self.query()
                self.expect(")")
                return ir.Cte(body, name, columns)

            return ir.With(tuple(self.listed(cte)), self._ordered(self._sets()), recursive)
        return self._ordered(self._sets())

    def _sets(self) -> ir.Node:
        left = self._intersections()
        while self.now.upper in ("UNION", "EXCEPT", "MINUS"):
            kind = "union" if self.take().upper == "UNION" else "except"
            every = self.accept("ALL")
            self.accept("DISTINCT")
            left = ir.SetOp(left, self._intersections(), kind, every)
        return left

    def _intersections(self) -> ir.Node:
        left = self._block()
        while self.accept("INTERSECT"):
            every = self.accept("ALL")
            left = ir.SetOp(left, self._block(), "intersect", every)
        return left

    def _ordered(self, node: ir.Node) -> ir.Node:
        if self.accept("ORDER", "BY"):
            keys = tuple(self.order_keys())
            if isinstance(node, ir.Project):
                names = [n for _, n in node.items]
                keys = tuple(names[int(k.split()[0]) - 1] + k[len(k.split()[0]) :] if k.split()[0].isdigit() else k for k in keys)
            node = ir.Sort(node, keys)
        count, offset = None, 0
        for _ in range(2):
            if self.accept("LIMIT"):
                count = None if self.accept("ALL") else int(self.take().text)
            if self.accept("OFFSET"):
                offset = int(self.take().text)
                self.accept("ROWS")
        return ir.Limit(node, count if count is not None else (1 << 31) - 1, offset) if count is not None or offset else node

    def _block(self) -> ir.Node:
        if self.accept("("):
            out = self.query()
            self.expect(")")
            return out
        self.expect("SELECT")
        distinct, on = self.accept("DISTINCT"), ()
        if distinct and self.accept("ON"):
            self.expect("(")
            on = tuple(X.to_text(e) for e in self.listed(self.expression))
            self.expect(")")
        self.accept("ALL")
        items = self.listed(self._item)
        node: ir.Node = self._from() if self.accept("FROM") else ir.Scan(ir.DUAL)
        if self.accept("WHERE"):
            node = ir.Filter(node, tuple(map(X.to_text, X.conjuncts(self.expression()))))
        keys: list[E] = []
        if self.accept("GROUP", "BY"):
            keys = [items[e.value - 1][0] if e.op == "lit" and isinstance(e.value, int) else next((x for x, n in items if e.op == "col" and e.value == (None, n) and x.op != "col"), e) for e in self.listed(self.expression)]
        having = self.expression() if self.accept("HAVING") else None
        if keys or having is not None or any(X.has_aggregate(e) for e, _ in items):
            node, items = _aggregated(node, keys, items, having)
        if on:
            order: tuple[str, ...] = ()
            if self.accept("ORDER", "BY"):
                order = tuple(self.order_keys())[len(on) :]
            return ir.Project(ir.DistinctOn(node, on, order or on), tuple(_named(items)))
        return ir.Project(node, tuple(_named(items)), distinct)

    def _item(self) -> tuple[E, str | None]:
        e = self.expression()
        if self.accept("AS"):
            return e, self.name()
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.text.lower() not in X.RESERVED | {"minus"}:
            return e, self.name()
        return e, None

    def _from(self) -> ir.Node:
        node = self._joined()
        while self.accept(","):
            node = ir.Join(node, self._joined(), "cross")
        return node

    def _joined(self) -> ir.Node:
        left = self._table()
        while self.now.upper in JOIN_WORDS and not (self.now.upper in ("LEFT", "RIGHT") and self.ahead().text == "("):
            natural = self.accept("NATURAL")
            word = self.now.upper
            how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}.get(word, "inner")
            if word != "JOIN":
                self.take()
            self.accept("OUTER")
            if how == "left" and self.now.upper in ("SEMI", "ANTI"):
                how = "left_" + self.take().upper.lower()
            self.expect("JOIN")
            right = self._table()
            on: tuple[str, ...] = ()
            using: tuple[str, ...] = ()
            if self.accept("ON"):
                on = tuple(map(X.to_text, X.conjuncts(self.expression())))
            elif self.accept("USING"):
                self.expect("(")
                using = tuple(self.listed(self.name))
                self.expect(")")
            left = ir.Join(left, right, how, on, using, natural)
        return left

    def _table(self) -> ir.Node:
        lateral = self.accept("LATERAL")
        if self.accept("("):
            inner = self.query() if self.now.upper in ("SELECT", "WITH", "(") else self._from()
            self.expect(")")
            name, columns = self._alias()
            if not name and not isinstance(inner, (ir.Join, ir.Scan)):
                name = "t"
            return ir.Alias(inner, name, columns, lateral) if name else inner
        if self.now.upper == "UNNEST" and self.ahead().text == "(":
            self.i += 2
            e = self.expression()
            self.expect(")")
            name, columns = self._alias()
            return ir.Alias(ir.Project(ir.Scan(ir.DUAL), ((f"explode({X.to_text(e)})", columns[0] if columns else name or "value"),)), name or "unnest", columns, lateral)
        parts = [self.name()]
        while self.now.text == "." and self.accept("."):
            parts.append(self.name())
        name, columns = self._alias()
        scan = ir.Scan(".".join(parts), name or None)
        return ir.Alias(scan, name, columns) if columns else scan

    def _alias(self) -> tuple[str, tuple[str, ...]]:
        name = ""
        if self.accept("AS") or self.now.kind == "quoted" or self.now.kind == "word" and self.now.text.lower() not in X.RESERVED | {"set", "returning", "natural", "minus", "window", "qualify", "inner"}:
            name = self.name()
        columns: tuple[str, ...] = ()
        if name and self.now.text == "(":
            self.take()
            columns = tuple(self.listed(self.name))
            self.expect(")")
        return name, columns


def output_name(e: E) -> str:
    """The name of an output without alias: the first column it names, else the function's name or `value`."""
    for c in e.columns():
        return c[1]
    return next((x.value[0] for x in e.walk() if x.op == "call"), "value")


def _named(items: list[tuple[E, str | None]]) -> list[tuple[str, str]]:
    return [(X.to_text(e), n or (X.to_text(e) if e.op == "star" else output_name(e))) for e, n in items]


def _aggregated(child: ir.Node, keys: list[E], items: list[tuple[E, str | None]], having: E | None) -> tuple[ir.Node, list]:
    """Keys and aggregate calls get names of their own; outputs and HAVING are rewritten over them."""
    names: dict[E, str] = {}
    for nth, k in enumerate(keys):
        names[k] = next((n for e, n in items if e == k and n), None) or (k.value[1] if k.op == "col" else f"key{nth}")
    calls: dict[E, str] = {}

    def over(e: E) -> E:
        if e in names:
            return X.col(names[e])
        for k, n in names.items():  # unqualified or qualified spellings of one key
            if k.op == e.op == "col" and k.value[1] == e.value[1] and None in (k.value[0], e.value[0]):
                return X.col(n)
        if X.is_aggregate(e) or e.op == "within" and X.is_aggregate(e.args[0]):
            if e not in calls:
                alone = next((n for x, n in items if x == e and n), None)
                calls[e] = alone if alone and alone not in names.values() else f"agg{len(calls)}"
            return X.col(calls[e])
        return E(e.op, tuple(map(over, e.args)), e.value)

    new = [(over(e), n or output_name(e)) for e, n in items]
    kept = X.to_text(over(having)) if having is not None else None
    node = ir.Aggregate(child, tuple((X.to_text(k), n) for k, n in names.items()), tuple((X.to_text(c), n) for c, n in calls.items()), kept)
    return node, new


def to_algebra(sql: str) -> ir.Node:
    p = QueryParser(sql)
    out = p.query()
    p.accept(";")
    if p.now.kind != "end":
        raise SqlError(f"unexpected {p.now.text!r} at {p.now.at}")
    return out


# ---- statements


@dataclass(frozen=True)
class Statement:
    kind: str  # select, insert, create, merge, update, delete, transaction, other
    target: str | None
    query: str | None  # text of the query that feeds the target, or of the statement itself where it is a query
    sources: tuple[str, ...]


def _qualified(p: Parser) -> str:
    parts = [p.name()]
    while p.now.text == "." and p.accept("."):
        parts.append(p.name())
    return ".".join(parts)


def inspect(sql: str) -> Statement:
    """Kind, written table, feeding query and read tables of a statement."""
    p = QueryParser(sql)
    word = p.now.upper
    rest = lambda: sql[p.now.at :].rstrip().rstrip(";").rstrip()
    read = lambda text: tuple(sorted({n for n, _ in references(text)}))
    if word in ("SELECT", "WITH", "("):
        if word == "WITH":  # WITH ... INSERT
            for k, t in enumerate(p.tokens):
                if t.upper == "INSERT":
                    p.i = k
                    got = inspect(sql[t.at :])
                    return Statement("insert", got.target, got.query, read(sql))
        return Statement("select", None, rest(), read(sql))
    if word in ("BEGIN", "COMMIT", "ROLLBACK", "START"):
        return Statement("transaction", None, None, ())
    if word == "INSERT" or word == "REPLACE":
        p.take()
        p.accept("OVERWRITE")
        p.accept("INTO")
        p.accept("TABLE")
        target = _qualified(p)
        if p.now.text == "(" and p.ahead().upper not in ("SELECT", "WITH"):
            p.take()
            p.nested_text()
        query = rest() if p.now.upper in ("SELECT", "WITH", "(") else None
        return Statement("insert", target, query, read(query) if query else ())
    if word == "CREATE":
        while p.now.upper not in ("TABLE", "VIEW"):
            if p.take().kind == "end":
                return Statement("other", None, None, ())
        p.take()
        p.accept("IF", "NOT", "EXISTS")
        target = _qualified(p)
        while p.now.kind != "end" and not p.accept("AS"):
            if p.take().text == "(":
                p.nested_text()
        query = rest() if p.now.kind != "end" else None
        return Statement("create", target, query, read(query) if query else ())
    if word in ("UPDATE", "MERGE", "DELETE"):
        p.take()
        p.accept("INTO")
        p.accept("FROM")
        target = _qualified(p)
        body = sql[p.now.at :]
        names = {n for n, _ in references("SELECT * " + body if word != "MERGE" else "SELECT * FROM " + target + " JOIN " + body.split("USING", 1)[-1].split("using", 1)[-1] if "using" in body.lower() else "")}
        return Statement(word.lower(), target, None, tuple(sorted(names - ({target} if word != "MERGE" else {target}))))
    return Statement("other", None, None, ())


# ---- table references

# Words that a FROM or JOIN pattern may take for tables, and schemas of the system.
SKIP_NAMES = frozenset("select where and or on as set values into limit order group having case when then else end not null true false is in between like exists all any some lateral unnest generate_series dual".split())
SKIP_SCHEMAS = frozenset("information_schema pg_catalog pg_toast pg_temp".split())


def references(sql: str) -> list[tuple[str, str | None]]:
    """(table, alias) after FROM, JOIN, USING of MERGE and in comma lists, wherever in the statement; functions, CTEs, literals and EXTRACT's FROM are none."""
    toks = X.tokens(sql)
    ctes, out, depth, extract = set(), [], 0, []
    for k, t in enumerate(toks):
        if t.kind in ("word", "quoted") and toks[k + 1].upper == "AS" and toks[k + 2].text == "(" and (k == 0 or toks[k - 1].upper in ("WITH", "RECURSIVE") or toks[k - 1].text == ","):
            ctes.add(t.text.strip('"`').lower())
        if t.kind in ("word", "quoted") and toks[k + 1].text == "(" and k and toks[k - 1].upper in ("WITH", "RECURSIVE"):
            ctes.add(t.text.strip('"`').lower())

    def table(k: int) -> int:
        """Reads a table at k; the place after it and its alias."""
        while toks[k].upper in ("LATERAL", "ONLY", "TABLE"):
            k += 1
        if toks[k].kind not in ("word", "quoted") or toks[k].text.lower() in SKIP_NAMES and toks[k].kind == "word":
            return k
        parts = [toks[k].text]
        while toks[k + 1].text == "." and toks[k + 2].kind in ("word", "quoted"):
            parts.append(toks[k + 2].text)
            k += 2
        while toks[k + 1].text == "-" and toks[k + 2].kind == "word" and toks[k + 2].at == toks[k + 1].at + 1:  # project-name
            parts[-1] += "-" + toks[k + 2].text
            k += 2
            while toks[k + 1].text == "." and toks[k + 2].kind in ("word", "quoted"):
                parts.append(toks[k + 2].text)
                k += 2
        k += 1
        if toks[k].text == "(":
            return k
        names = [n for p in parts for n in (p[1:-1].split(".") if p[0] == "`" else [p[1:-1] if p[0] in '"[' else p])]
        k += toks[k].upper == "AS"
        alias = None
        if toks[k].kind == "quoted" or toks[k].kind == "word" and toks[k].text.lower() not in X.RESERVED | {"set", "natural", "using", "returning", "inner", "when"}:
            alias = toks[k].text.strip('"`')
            k += 1
        if not (len(names) == 1 and names[0].lower() in ctes) and not (len(names) > 1 and names[-2].lower() in SKIP_SCHEMAS) and names[0].lower() not in SKIP_SCHEMAS:
            out.append((".".join(names), alias))
        return k

    k = 0
    lists: list[bool] = []  # by bracket: within a FROM list
    here = False
    while k < len(toks):
        t = toks[k]
        if t.text == "(" and t.kind == "sign":
            depth += 1
            extract.append(k and toks[k - 1].upper in ("EXTRACT", "TRIM", "SUBSTRING", "OVERLAY", "POSITION"))
            lists.append(here)
            here = False
        elif t.text == ")" and t.kind == "sign" and lists:
            depth -= 1
            extract.pop()
            here = lists.pop()
        elif t.upper in ("FROM", "JOIN") and not (extract and extract[-1] and t.upper == "FROM") and not (t.upper == "FROM" and k and toks[k - 1].upper == "DISTINCT" and toks[max(0, k - 2)].upper in ("IS", "NOT")):
            here = True
            k = max(k + 1, table(k + 1))
            continue
        elif t.upper in ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "SELECT", "SET", "ON", "USING"):
            here = here and t.upper in ("ON", "USING")
        elif t.text == "," and t.kind == "sign" and here:
            k = max(k + 1, table(k + 1))
            continue
        k += 1
    return out


def table_refs(sql: str) -> list[str]:
    """Distinct lower-case names of read tables in order; text that has no tokens at all gives what a pattern finds."""
    try:
        found = [n for n, _ in references(sql)]
    except (SqlError, IndexError):
        found = [m for m in re.findall(r"(?i)\b(?:from|join)\s+[\"`]?([\w.-]+)", sql) if m.lower() not in SKIP_NAMES and m.split(".")[0].lower() not in SKIP_SCHEMAS]
    return list(dict.fromkeys(n.lower() for n in found))


def normalized(sql: str) -> str:
    """Comments go, string and number literals become ?, one space between tokens where the text had any; names keep their case."""
    out, end = [], 0
    toks = X.tokens(sql)
    for t in toks[:-1]:
        if out and (t.at > end or sql[end : t.at].strip()):
            out.append(" ")
        out.append("?" if t.kind in ("string", "number") else t.text)
        end = t.at + len(t.text)
    return "".join(out).strip()


# ---- scopes, binding and lineage


@dataclass(frozen=True)
class Bound:
    """An output column: its name, the expression, and the (table, column) pairs it comes from."""

    name: str
    text: str
    sources: tuple[tuple[str, str], ...]


class Scope:
    """Names visible in a query block: aliases to their columns' origins; a parent holds those of the enclosing query."""

    def __init__(self, catalog: dict[str, tuple[str, ...]], parent: Scope | None = None, ctes: dict[str, list[Bound]] | None = None):
        self.catalog = {k.lower(): v for k, v in catalog.items()}
        self.parent, self.ctes = parent, dict(ctes or (parent.ctes if parent else {}))
        self.relations: dict[str, dict[str, tuple[tuple[str, str], ...]]] = {}

    def add(self, alias: str, columns: dict[str, tuple[tuple[str, str], ...]]) -> None:
        if alias.lower() in self.relations:
            raise SqlError(f"relation {alias} twice")
        self.relations[alias.lower()] = {k.lower(): v for k, v in columns.items()}

    def resolve(self, table: str | None, name: str) -> tuple[tuple[str, str], ...]:
        """Origins of a column; unknown and ambiguous names raise."""
        scope: Scope | None = self
        while scope:
            if table:
                if table.lower() in scope.relations:
                    found = [scope.relations[table.lower()].get(name.lower())]
                    if found[0] is None:
                        raise SqlError(f"no column {name} in {table}")
                    return found[0]
            else:
                found = [r[name.lower()] for r in scope.relations.values() if name.lower() in r]
                if len(found) > 1:
                    raise SqlError(f"column {name} is ambiguous")
                if found:
                    return found[0]
            scope = scope.parent
        raise SqlError(f"no column {f'{table}.' if table else ''}{name}")

    def is_outer(self, table: str | None, name: str) -> bool:
        """Whether the column belongs to an enclosing query."""
        if table:
            return table.lower() not in self.relations
        return not any(name.lower() in r for r in self.relations.values())


def bind(node: ir.Node, catalog: dict[str, tuple[str, ...]], parent: Scope | None = None, ctes: dict[str, list[Bound]] | None = None) -> list[Bound]:
    """Output columns of a query against a catalog (table -> columns); the tables of subquery predicates are bound too."""
    return _bind(node, Scope(catalog, parent, ctes))[0]


def _bind(node: ir.Node, scope: Scope) -> tuple[list[Bound], Scope]:
    fresh = lambda: Scope(scope.catalog, scope.parent, scope.ctes)
    match node:
        case ir.Scan(table, alias):
            if table == ir.DUAL:
                return [], scope
            if table.lower() in scope.ctes:
                columns = {b.name: b.sources for b in scope.ctes[table.lower()]}
            else:
                known = scope.catalog.get(table.lower()) or scope.catalog.get(table.split(".")[-1].lower())
                if known is None:
                    raise SqlError(f"no table {table}")
                columns = {c: ((table, c),) for c in known}
            scope.add(alias or table.split(".")[-1], columns)
            return [Bound(c, c, s) for c, s in columns.items()], scope
        case ir.Alias(child, name, names, lateral):
            inner, _ = _bind(child, Scope(scope.catalog, scope if lateral else scope.parent, scope.ctes))
            columns = {(names[i] if i < len(names) else b.name): b.sources for i, b in enumerate(inner)}
            scope.add(name, columns)
            return [Bound(c, c, s) for c, s in columns.items()], scope
        case ir.Join(left, right, how, on, using, _):
            a, _ = _bind(left, scope)
            b, _ = _bind(right, scope)
            for c in on:
                _origins(X.parse(c), scope)
            return a if how in ("left_semi", "left_anti") else a + [x for x in b if x.name not in using], scope
        case ir.Filter(child, parts):
            out, scope = _bind(child, scope)
            for c in parts:
                _origins(X.parse(c), scope)
            return out, scope
        case ir.Project(child, items, _):
            below, scope = _bind(child, scope)
            out = []
            for text, name in items:
                e = X.parse(text)
                if e.op == "star":
                    wanted = scope.relations.get((e.value or "").lower()) if e.value else None
                    out += [Bound(c, c, s) for c, s in wanted.items()] if wanted is not None else below
                else:
                    out.append(Bound(name, text, _origins(e, scope)))
            return out, scope
        case ir.Aggregate(child, keys, measures, _):
            _, inner = _bind(child, scope)
            out = [Bound(n, e, _origins(X.parse(e), inner)) for e, n in keys + measures]
            above = fresh()
            above.relations = {"": {b.name.lower(): b.sources for b in out}}
            if node.having:
                _origins(X.parse(node.having), above)
            return out, above
        case ir.With(parts, child):
            known = dict(scope.ctes)
            for c in parts:
                if node.recursive:
                    first = c.child.left if isinstance(c.child, ir.SetOp) else c.child
                    known[c.name.lower()] = _renamed(bind(first, scope.catalog, scope.parent, known), c.columns)
                known[c.name.lower()] = _renamed(bind(c.child, scope.catalog, scope.parent, known), c.columns)
            return _bind(child, Scope(scope.catalog, scope.parent, known))
        case ir.SetOp(left, right):
            a, b = bind(left, scope.catalog, scope.parent, scope.ctes), bind(right, scope.catalog, scope.parent, scope.ctes)
            if len(a) != len(b):
                raise SqlError("set operation over different numbers of columns")
            return [Bound(x.name, x.text, tuple(dict.fromkeys(x.sources + y.sources))) for x, y in zip(a, b, strict=True)], scope
    return _bind(next(node.children()), scope)


def _renamed(columns: list[Bound], names: tuple[str, ...]) -> list[Bound]:
    return [Bound(names[i] if i < len(names) else b.name, b.text, b.sources) for i, b in enumerate(columns)]


def _origins(e: E, scope: Scope) -> tuple[tuple[str, str], ...]:
    out: dict[tuple[str, str], None] = {}
    for x in e.walk():
        if x.op == "col":
            out.update(dict.fromkeys(scope.resolve(*x.value)))
        elif x.op in ("exists", "in query", "scalar"):
            inner = bind(to_algebra(x.value), scope.catalog, scope, scope.ctes)
            if x.op == "scalar":
                out.update(dict.fromkeys(s for b in inner for s in b.sources))
    return tuple(out)


def correlations(query: str, catalog: dict[str, tuple[str, ...]]) -> list[str]:
    """Conjuncts of a subquery's filters that name columns of the enclosing query."""
    node = to_algebra(query)
    scope = Scope(catalog)
    for n in node.walk():
        if isinstance(n, ir.Scan) and n.table != ir.DUAL:
            columns = scope.catalog.get(n.table.lower(), ())
            scope.add(n.alias or n.table, {c: ((n.table, c),) for c in columns})
    return [c for n in node.walk() if isinstance(n, ir.Filter) for c in n.conjuncts if any(scope.is_outer(*x) for x in X.parse(c).columns())]


@dataclass(frozen=True)
class ColumnEdge:
    source_table: str
    source_column: str
    target_column: str


def column_edges(sql: str) -> list[ColumnEdge]:
    """Edges from base columns to outputs, read from the text alone: a bare column counts only where there is one source table; `*` and CTE sources give none."""
    node = to_algebra(sql)
    ctes = {c.name.lower() for n in node.walk() if isinstance(n, ir.With) for c in n.ctes}
    while isinstance(node, (ir.Sort, ir.Limit, ir.With, ir.DistinctOn)):
        node = node.child
    if not isinstance(node, ir.Project):
        return []
    below = node.child
    names: dict[str, E] = {}
    if isinstance(below, ir.Aggregate):
        names = {n: X.parse(e) for e, n in below.keys + below.measures}
    scans = [n for n in _own(below) if isinstance(n, ir.Scan) and n.table != ir.DUAL]
    known = {(s.alias or s.table.split(".")[-1]).lower(): s.table for s in scans}
    out: dict[ColumnEdge, None] = {}
    for text, name in node.items:
        e = X.parse(text)
        full = e.map(lambda x: names.get(x.value[1], x) if x.op == "col" and not x.value[0] else x)
        for t, c in full.columns():
            table = known.get(t.lower()) if t else scans[0].table if len(scans) == 1 else None
            if table and table.lower() not in ctes:
                out[ColumnEdge(table, c, name)] = None
    return list(out)


def _own(node: ir.Node):
    """Nodes of this block, not those of subqueries in FROM."""
    yield node
    if not isinstance(node, (ir.Alias, ir.With)):
        for c in node.children():
            yield from _own(c)


def lineage_method(sql: str) -> str:
    return "column" if column_edges(sql) else "table"


# ---- names


def qualified(name: str) -> tuple[str | None, str | None, str]:
    """(catalog, schema, table) of a dotted name, quotes removed."""
    parts = [p.strip('"`[]') for p in re.findall(r'"[^"]*"|`[^`]*`|\[[^\]]*\]|[^.]+', name)]
    return (None, None, *parts)[-3:] if len(parts) < 3 else tuple(parts[-3:])


def bare(name: str) -> str:
    return qualified(name)[2].lower()


def unique_alias(name: str, taken: set[str]) -> str:
    """The name's initials, numbered where taken."""
    base = "".join(p[:1] for p in re.split(r"[^a-z0-9]+", bare(name)) if p) or "t"
    k, out = 1, base
    while out in taken:
        k += 1
        out = f"{base}{k}"
    return out


def quoted(name: str, dialect: str = "spark") -> str:
    """Each part in the dialect's quotes; control characters are refused."""
    if not name or any(ord(c) < 32 for c in name):
        raise SqlError("not a name")
    q = QUOTES[dialect]
    return ".".join(q + p.replace(q, q * 2) + q for p in (x for x in qualified(name) if x))


# Quotes of names by dialect.
QUOTES = {"spark": "`", "bigquery": "`", "mysql": "`", "duckdb": '"', "postgres": '"', "snowflake": '"', "sqlite": '"'}
