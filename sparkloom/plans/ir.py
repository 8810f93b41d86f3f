"""A small relational algebra that compiles to DataFrames: immutable nodes, Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The relation of a SELECT without FROM: one row without columns.
DUAL = "__dual__"


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                yield v
            elif isinstance(v, tuple):
                yield from (x for x in v if isinstance(x, Node))

    def rewritten(self, rule: Callable[[Node], Node]) -> Node:
        """The tree with `rule` applied bottom-up."""
        new = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                new[f.name] = v.rewritten(rule)
            elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
                new[f.name] = tuple(x.rewritten(rule) for x in v)
        return rule(replace(self, **new) if new else self)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Scan(Node):
    table: str
    alias: str | None = None


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    conjuncts: tuple[str, ...]


@dataclass(frozen=True)
class Project(Node):
    child: Node
    items: tuple[tuple[str, str], ...]  # expression, name
    distinct: bool = False


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node
    how: str = "inner"  # inner, left, right, full, cross, left_semi, left_anti
    on: tuple[str, ...] = ()
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Alias(Node):
    """A derived table: the child's rows under a name, with names of columns where given."""

    child: Node
    name: str
    columns: tuple[str, ...] = ()
    lateral: bool = False


@dataclass(frozen=True)
class Cte(Node):
    child: Node
    name: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class With(Node):
    ctes: tuple[Cte, ...]
    child: Node
    recursive: bool = False


@dataclass(frozen=True)
class Aggregate(Node):
    child: Node
    keys: tuple[tuple[str, str], ...]
    measures: tuple[tuple[str, str], ...]
    having: str | None = None


@dataclass(frozen=True)
class Sort(Node):
    child: Node
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Limit(Node):
    child: Node
    count: int
    offset: int = 0


@dataclass(frozen=True)
class SetOp(Node):
    left: Node
    right: Node
    kind: str  # union, except, intersect
    all: bool = False


@dataclass(frozen=True)
class DistinctOn(Node):
    """First row of each key in the given order; ties must be broken by the order."""

    child: Node
    keys: tuple[str, ...]
    order: tuple[str, ...]


def _and(conjuncts: tuple[str, ...]) -> Column:
    out = F.expr(conjuncts[0])
    for c in conjuncts[1:]:
        out = out & F.expr(c)
    return out


def _output(e: str, name: str) -> Column:
    return F.col(e) if e == "*" or e.endswith(".*") else F.expr(e).alias(name)


def to_dataframe(node: Node, tables: Callable[[str], DataFrame]) -> DataFrame:
    """Compiles to DataFrame operators; subquery predicates become joins (`rewrites.decorrelate`)."""
    from . import rewrites

    return _frame(rewrites.decorrelate(node), tables)


def _frame(node: Node, tables: Callable[[str], DataFrame]) -> DataFrame:
    go = lambda n: _frame(n, tables)
    match node:
        case Scan(table, alias):
            return tables(table).alias(alias or table.split(".")[-1])
        case Alias(child, name, columns):
            out = go(child)
            return (out.toDF(*columns, *out.columns[len(columns) :]) if columns else out).alias(name)
        case With(ctes, child, recursive):
            if recursive:
                raise NotImplementedError("recursion runs as SQL: see to_sql")
            known: dict[str, DataFrame] = {}
            look = lambda t: known[t.lower()] if t.lower() in known else tables(t)
            for c in ctes:
                known[c.name.lower()] = _frame(Alias(c.child, c.name, c.columns), look)
            return _frame(child, look)
        case Filter(child, conjuncts):
            return go(child).where(_and(conjuncts))
        case Project(child, items, distinct):
            out = go(child).select(*(_output(e, n) for e, n in items))
            return out.distinct() if distinct else out
        case Join(left, right, how, on, using, natural):
            a, b = go(left), go(right)
            if natural:
                using = tuple(c for c in a.columns if c in b.columns)
            if using:
                return a.join(b, list(using), how)
            return a.join(b, _and(on), how) if on else a.crossJoin(b)
        case Aggregate(child, keys, measures, having):
            out = go(child).groupBy(*(F.expr(e).alias(n) for e, n in keys))
            out = out.agg(*(F.expr(e).alias(n) for e, n in measures)) if measures else out.agg(F.lit(1).alias("__one")).drop("__one")
            return out.where(having) if having else out
        case Sort(child, keys):
            return go(child).orderBy(*map(sort_key, keys))
        case Limit(child, count, offset):
            return go(child).offset(offset).limit(count) if offset else go(child).limit(count)
        case SetOp(left, right, kind, every):
            a, b = go(left), go(right)
            if kind == "union":
                return a.union(b) if every else a.union(b).distinct()
            if kind == "intersect":
                return a.intersectAll(b) if every else a.intersect(b)
            return a.exceptAll(b) if every else a.subtract(b)
        case DistinctOn(child, keys, order):
            from pyspark.sql import Window

            w = Window.partitionBy(*map(F.expr, keys)).orderBy(*map(sort_key, order))
            return go(child).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    raise TypeError(node)


def sort_key(text: str) -> Column:
    """`expr [DESC]`; NULLs come last unless NULLS FIRST is written."""
    first = text.upper().endswith(" NULLS FIRST")
    text = text[: -len(" NULLS FIRST")] if first else text
    down = text.upper().endswith(" DESC")
    e = F.expr(text[:-5] if down else text)
    return {(0, 0): e.asc_nulls_last, (0, 1): e.asc_nulls_first, (1, 0): e.desc_nulls_last, (1, 1): e.desc_nulls_first}[down, first]()


def to_sql(node: Node, dialect: str = "spark") -> str:
    """SQL text of a dialect: spark, duckdb, postgres, snowflake or bigquery. NULLs come last where the plan does not say."""
    return Emitter(dialect).query(node)


# Names that differ by dialect; what is not listed is written as it stands.
FUNCTIONS = {
    "spark": {"string_agg": "listagg", "array_agg": "collect_list"},
    "duckdb": {"listagg": "string_agg", "collect_list": "array_agg", "substring": "substr", "sha2": "sha256", "explode": "unnest", "count_if": "count_if"},
    "postgres": {"listagg": "string_agg", "collect_list": "array_agg", "explode": "unnest"},
    "snowflake": {"string_agg": "listagg", "collect_list": "array_agg"},
    "bigquery": {"listagg": "string_agg", "collect_list": "array_agg", "explode": "unnest"},
}
TYPES = {"duckdb": {"string": "varchar"}, "postgres": {"string": "text", "double": "double precision"}, "bigquery": {"varchar": "string", "bigint": "int64", "double": "float64"}, "spark": {"varchar": "string", "text": "string"}, "snowflake": {"string": "varchar"}}
JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "cross": "CROSS JOIN"}
HALF_JOINS = {"spark": {"left_semi": "LEFT SEMI JOIN", "left_anti": "LEFT ANTI JOIN"}, "duckdb": {"left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}}
DISTINCT_ON = ("duckdb", "postgres")


class Emitter:
    def __init__(self, dialect: str):
        if dialect not in FUNCTIONS:
            raise ValueError(f"dialect {dialect}")
        self.dialect, self.quote = dialect, "`" if dialect in ("spark", "bigquery") else '"'

    def text(self, e: str) -> str:
        """An expression in the dialect's names, types and quotes."""
        from . import expr as X

        names, types = FUNCTIONS[self.dialect], TYPES[self.dialect]

        def rule(x: X.E) -> X.E:
            if x.op == "call":
                return X.E(x.op, x.args[:1] if x.value[0] == "sha2" and names.get("sha2") else x.args, (names.get(x.value[0], x.value[0]), x.value[1]))
            if x.op == "cast":
                return X.E(x.op, x.args, types.get(x.value.lower(), x.value))
            if x.op in ("exists", "in query", "scalar"):
                from .parser import to_algebra

                return X.E(x.op, x.args, self.query(to_algebra(x.value)))
            return x

        return X.to_text(X.parse(e).map(rule), self.quote)

    def key(self, k: str) -> str:
        first, down = k.upper().endswith(" NULLS FIRST"), " DESC" in k.upper()
        body = k
        for end in (" NULLS FIRST", " NULLS LAST", " DESC", " ASC"):
            body = body[: -len(end)] if body.upper().endswith(end) else body
        return f"{self.text(body)}{' DESC' * down} NULLS {'FIRST' if first else 'LAST'}"

    def items(self, items: tuple[tuple[str, str], ...]) -> str:
        from .expr import name_text

        return ", ".join(self.text(e) if e == "*" or e.endswith(".*") else f"{self.text(e)} AS {name_text(n, self.quote)}" for e, n in items)

    def query(self, node: Node) -> str:
        sub = lambda n: f"({self.query(n)})"
        match node:
            case Scan(table, alias):
                return "SELECT 1" if table == DUAL else f"SELECT * FROM {self.source(node)}"
            case Alias() | Join():
                return f"SELECT * FROM {self.source(node)}"
            case With(ctes, child, recursive):
                parts = ", ".join(f"{c.name}{'(' + ', '.join(c.columns) + ')' if c.columns else ''} AS {sub(c.child)}" for c in ctes)
                return f"WITH {'RECURSIVE ' * recursive}{parts} {self.query(child)}"
            case Filter(child, conjuncts):
                return f"SELECT * FROM {self.source(child)} WHERE {self._and(conjuncts)}"
            case Project(DistinctOn(child, keys, order), items, False) if self.dialect in DISTINCT_ON:
                at = self._below(child)
                return f"SELECT DISTINCT ON ({', '.join(map(self.text, keys))}) {self.items(items)} {at} ORDER BY {', '.join(self.text(k) for k in keys)}, {', '.join(map(self.key, order))}"
            case Project(DistinctOn(child, keys, order), items, False):
                inner = f"SELECT {self.items(items)}, row_number() OVER (PARTITION BY {', '.join(map(self.text, keys))} ORDER BY {', '.join(map(self.key, order))}) AS nth__ {self._below(child)}"
                return f"SELECT {', '.join(n for _, n in items)} FROM ({inner}) AS r WHERE nth__ = 1"
            case Project(child, items, distinct):
                return f"SELECT {'DISTINCT ' * distinct}{self.items(items)}{' ' + self._below(child) if child != Scan(DUAL) else ''}"
            case Aggregate(child, keys, measures, having):
                inner = f"SELECT {self.items(keys + measures)} {self._below(child)}" + (f" GROUP BY {', '.join(self.text(e) for e, _ in keys)}" if keys else "")
                return f"SELECT * FROM ({inner}) AS agg WHERE {self.text(having)}" if having else inner
            case Sort(child, keys):
                return f"{self.query(child)} ORDER BY {', '.join(map(self.key, keys))}" if isinstance(child, (Project, Aggregate)) else f"SELECT * FROM {sub(child)} AS s ORDER BY {', '.join(map(self.key, keys))}"
            case Limit(child, count, offset):
                body = self.query(child) if isinstance(child, (Sort, Project)) else f"SELECT * FROM {sub(child)} AS l"
                return body + f" LIMIT {count}" + (f" OFFSET {offset}" if offset else "")
            case SetOp(left, right, kind, every):
                return f"{sub(left)} {kind.upper()}{' ALL' * every} {sub(right)}"
            case DistinctOn(child, keys, order):
                inner = f"SELECT *, row_number() OVER (PARTITION BY {', '.join(map(self.text, keys))} ORDER BY {', '.join(map(self.key, order))}) AS nth__ {self._below(child)}"
                return f"SELECT * {'EXCEPT' if self.dialect in ('spark', 'bigquery') else 'EXCLUDE'} (nth__) FROM ({inner}) AS r WHERE nth__ = 1"
        raise TypeError(node)

    def _and(self, conjuncts: tuple[str, ...]) -> str:
        return " AND ".join(f"({self.text(c)})" for c in conjuncts)

    def _below(self, node: Node) -> str:
        """FROM, and WHERE where the node filters relations whose aliases the block needs."""
        if isinstance(node, Filter) and isinstance(node.child, (Scan, Join, Alias)):
            return f"FROM {self.source(node.child)} WHERE {self._and(node.conjuncts)}"
        return f"FROM {self.source(node)}"

    def source(self, node: Node) -> str:
        match node:
            case Scan(table, alias):
                return f"{table} AS {alias}" if alias else table
            case Alias(Scan(table, _), name, columns, _):
                return f"{table} AS {name}{'(' + ', '.join(columns) + ')' if columns else ''}"
            case Alias(child, name, columns, lateral):
                return f"{'LATERAL ' * lateral}({self.query(child)}) AS {name}{'(' + ', '.join(columns) + ')' if columns else ''}"
            case Join(left, right, how, on, using, natural):
                if how in ("left_semi", "left_anti") and self.dialect not in HALF_JOINS:
                    cond = self._and(on) or "TRUE"
                    return f"(SELECT * FROM {self.source(left)} WHERE {'NOT ' * (how == 'left_anti')}EXISTS (SELECT 1 FROM {self.source(right)} WHERE {cond})) AS h"
                word = JOINS.get(how) or HALF_JOINS[self.dialect][how]
                end = f" USING ({', '.join(using)})" if using else f" ON {self._and(on)}" if on else "" if how in ("cross", "inner") or natural else " ON TRUE"
                right_ = self.source(right)
                return f"{self.source(left)} {'NATURAL ' * natural}{'CROSS JOIN' if how == 'inner' and not end and not natural else word} {f'({right_})' if isinstance(right, Join) else right_}{end}"
            case Filter(child, _) if isinstance(child, (Scan, Alias)):
                return f"({self.query(node)}) AS {child.name if isinstance(child, Alias) else child.alias or child.table}"
        return f"({self.query(node)}) AS t"


def merge_filters(node: Node) -> Node:
    """Nested filters become one; repeated conjuncts go."""

    def rule(n: Node) -> Node:
        if isinstance(n, Filter) and isinstance(n.child, Filter):
            return Filter(n.child.child, tuple(dict.fromkeys(n.child.conjuncts + n.conjuncts)))
        return n

    return node.rewritten(rule)


def outer_to_inner(node: Node, keys: Mapping[tuple[str, str], str], not_null: frozenset[str]) -> Node:
    """A left join along a foreign key becomes inner where the referencing column is known not to be NULL.

    keys: (referencing column, referenced column) -> referenced table, both columns qualified as in the join condition. The right side
    must be that table itself, unfiltered; the referencing column's NOT NULL is needed too, else its rows would be lost.
    """

    def rule(n: Node) -> Node:
        if isinstance(n, Join) and n.how == "left" and len(n.on) == 1 and isinstance(n.right, Scan):
            a, _, b = (x.strip() for x in n.on[0].partition("="))
            for x, y in ((a, b), (b, a)):
                if keys.get((x, y)) == n.right.table and x in not_null:
                    return replace(n, how="inner")
        return n

    return node.rewritten(rule)


def roll_up(node: Aggregate, view: Aggregate, view_scan: Scan) -> Aggregate | None:
    """The aggregate over a finer aggregate of the same input: SUM, COUNT, MIN and MAX re-aggregate; anything else gives None."""
    if node.child != view.child or view.having or not {e for e, _ in node.keys} <= {e for e, _ in view.keys}:
        return None
    name = {e.lower().replace(" ", ""): n for e, n in view.keys + view.measures}
    out = []
    for e, n in node.measures:
        key = e.lower().replace(" ", "")
        kind = key.partition("(")[0]
        if key not in name or "distinct" in key or kind not in ("sum", "count", "min", "max"):
            return None
        if kind == "count":  # over no rows it is 0, where the sum of no counts is NULL
            out.append((f"coalesce(sum({name[key]}), 0)", n))
        else:
            out.append((f"{kind}({name[key]})", n))
    return Aggregate(view_scan, tuple((name[e.lower().replace(" ", "")], n) for e, n in node.keys), tuple(out), node.having)


def grain(node: Node) -> tuple[str, ...]:
    """Columns that tell the rows of an aggregate apart; none where the plan does not aggregate last."""
    while isinstance(node, (Sort, Limit, Project, With)):
        node = node.child
    return tuple(n for _, n in node.keys) if isinstance(node, Aggregate) else ()


def is_roll_up_safe(measure: str) -> bool:
    """Whether finer values of the measure combine into coarser ones."""
    from .expr import parse

    e = parse(measure)
    return e.op == "call" and e.value[0] in ("sum", "count", "min", "max") and not e.value[1]


def tables_of(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.range(1).drop("id") if name == DUAL else spark.read.parquet(f"{sf_dir}/{name}.parquet")
