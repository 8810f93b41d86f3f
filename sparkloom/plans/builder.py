"""A fluent way to write a query: each call gives a new builder, `plan` the algebra, `sql` its text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from . import expr as X
from . import ir


@dataclass(frozen=True)
class Query:
    source: ir.Node
    filters: tuple[str, ...] = ()
    items: tuple[tuple[str, str], ...] = ()
    keys: tuple[tuple[str, str], ...] = ()
    measures: tuple[tuple[str, str], ...] = ()
    kept: str | None = None
    order: tuple[str, ...] = ()
    most: int | None = None
    skip: int = 0
    unique: bool = False

    def join(self, table: str | Query, on: str, alias: str | None = None, how: str = "inner") -> Query:
        right = ir.Alias(table.plan(), alias or "t") if isinstance(table, Query) else ir.Scan(table, alias)
        return replace(self, source=ir.Join(self.source, right, how, tuple(map(X.to_text, X.conjuncts(X.parse(on))))))

    def left_join(self, table: str | Query, on: str, alias: str | None = None) -> Query:
        return self.join(table, on, alias, "left")

    def right_join(self, table: str | Query, on: str, alias: str | None = None) -> Query:
        return self.join(table, on, alias, "right")

    def full_join(self, table: str | Query, on: str, alias: str | None = None) -> Query:
        return self.join(table, on, alias, "full")

    def cross_join(self, table: str, alias: str | None = None) -> Query:
        return replace(self, source=ir.Join(self.source, ir.Scan(table, alias), "cross"))

    def where(self, condition: str) -> Query:
        return replace(self, filters=self.filters + tuple(map(X.to_text, X.conjuncts(X.parse(condition)))))

    def select(self, *plain: str, **named: str) -> Query:
        return replace(self, items=self.items + tuple((e, e.split(".")[-1]) for e in plain) + tuple((e, n) for n, e in named.items()))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def group_by(self, *plain: str, **named: str) -> Query:
        return replace(self, keys=self.keys + tuple((e, e.split(".")[-1]) for e in plain) + tuple((e, n) for n, e in named.items()))

    def agg(self, **named: str) -> Query:
        return replace(self, measures=self.measures + tuple((e, n) for n, e in named.items()))

    def having(self, condition: str) -> Query:
        return replace(self, kept=condition)

    def order_by(self, *keys: str) -> Query:
        return replace(self, order=self.order + keys)

    def limit(self, count: int, offset: int = 0) -> Query:
        return replace(self, most=count, skip=offset)

    def plan(self) -> ir.Node:
        node = ir.Filter(self.source, self.filters) if self.filters else self.source
        if self.keys or self.measures:
            node = ir.Aggregate(node, self.keys, self.measures, self.kept)
        if self.items or not (self.keys or self.measures):
            node = ir.Project(node, self.items or (("*", "*"),), self.unique)
        if self.order:
            node = ir.Sort(node, self.order)
        return ir.Limit(node, self.most, self.skip) if self.most is not None else node

    def sql(self, dialect: str = "spark") -> str:
        return ir.to_sql(self.plan(), dialect)

    def frame(self, tables: Callable[[str], DataFrame]) -> DataFrame:
        return ir.to_dataframe(self.plan(), tables)


def from_(table: str, alias: str | None = None) -> Query:
    return Query(ir.Scan(table, alias))


class Visitor:
    """Dispatch by node class: `visit_Filter(node)` and so on; other nodes go to `visit_other`, which visits children."""

    def visit(self, node: ir.Node):
        return getattr(self, f"visit_{type(node).__name__}", self.visit_other)(node)

    def visit_other(self, node: ir.Node):
        for c in node.children():
            self.visit(c)


class Collector(Visitor):
    """Gathers what `found` gives for each node."""

    def __init__(self, found: Callable[[ir.Node], list]):
        self.found, self.out = found, []

    def visit(self, node: ir.Node):
        self.out += self.found(node)
        super().visit(node)
        return self.out


def peeled(node: ir.Node) -> tuple[list[ir.Node], ir.Node]:
    """Limits, sorts, a projection over an aggregate and the aggregate off the top, outermost first, and what is below."""
    layers: list[ir.Node] = []
    while isinstance(node, (ir.Limit, ir.Sort, ir.Aggregate)) or isinstance(node, ir.Project) and isinstance(node.child, ir.Aggregate):
        layers.append(node)
        node = node.child
    return layers, node


def wrapped(layers: list[ir.Node], node: ir.Node) -> ir.Node:
    """The layers put back over a node."""
    for layer in reversed(layers):
        node = replace(layer, child=node)
    return node
