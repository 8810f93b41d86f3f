"""Expressions as small immutable trees: a tokenizer, a precedence parser, a printer and helpers over them.

A node has an operator, arguments and a value. Operators: col (value: table or None, name), lit (value), typed (value: type, text), star (value: table or
None), call (value: name, distinct), cast (value: type), case (operand, when, then, ..., else; `none` where left out), over (call, partition...; value: order
keys, frame), and, or, not, neg, is null, in, like, ilike, exists, in query, scalar (value: SQL text of the query), comparisons and arithmetic by their signs.
BETWEEN becomes two comparisons, NOT is pushed nowhere, != becomes <>.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
FLIPPED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}

# Functions whose value changes between calls, and aggregate functions.
VOLATILE = frozenset("now current_timestamp current_date current_time random uuid_generate_v4 gen_random_uuid clock_timestamp statement_timestamp transaction_timestamp".split())
AGGREGATES = frozenset("count sum avg min max array_agg string_agg bool_and bool_or stddev variance var_pop var_samp percentile_cont percentile_disc first last any_value".split())
#: Spark's further names for aggregates.
SPARK_AGGREGATES = AGGREGATES | frozenset("collect_list collect_set count_if listagg max_by min_by stddev_samp stddev_pop approx_count_distinct median mode".split())


class SqlError(ValueError):
    """Text that is no SQL of the supported kind."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, number, string, sign, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "sign" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|$))|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[A-Za-z_][^\]]*\])|(?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<word>[^\W\d][\w$]*)|(?P<sign><=|>=|<>|!=|\|\||::|[-+*/%(),.;<>=?:\[\]{}@&|^~])""",
    re.S | re.X,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"character {sql[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


@dataclass(frozen=True)
class E:
    op: str
    args: tuple[E, ...] = ()
    value: object = None

    def walk(self) -> Iterator[E]:
        yield self
        for a in self.args:
            yield from a.walk()

    def map(self, rule: Callable[[E], E]) -> E:
        """The tree with `rule` applied bottom-up."""
        return rule(E(self.op, tuple(a.map(rule) for a in self.args), self.value))

    def columns(self) -> list[tuple[str | None, str]]:
        return list(dict.fromkeys(e.value for e in self.walk() if e.op == "col"))

    def __str__(self) -> str:
        return to_text(self)


NONE = E("none")


def col(name: str, table: str | None = None) -> E:
    return E("col", (), (table, name))


def lit(value) -> E:
    return E("lit", (), value)


def conjuncts(e: E) -> list[E]:
    return [x for a in e.args for x in conjuncts(a)] if e.op == "and" else [e]


def disjuncts(e: E) -> list[E]:
    return [x for a in e.args for x in disjuncts(a)] if e.op == "or" else [e]


def all_of(parts: list[E]) -> E:
    parts = list(dict.fromkeys(parts))
    return lit(True) if not parts else parts[0] if len(parts) == 1 else E("and", tuple(parts))


def any_of(parts: list[E]) -> E:
    parts = list(dict.fromkeys(parts))
    return lit(False) if not parts else parts[0] if len(parts) == 1 else E("or", tuple(parts))


def atoms(e: E) -> list[E]:
    """Atomic conjuncts; disjunctions and negations give none."""
    return [c for c in conjuncts(e) if c.op not in ("or", "not")]


def canonical(e: E) -> E:
    """Sorted and deduplicated conjunctions, disjunctions and value lists; comparisons with the column, or the lesser text, on the left."""

    def rule(x: E) -> E:
        if x.op in ("and", "or"):
            parts = sorted({p for a in x.args for p in (conjuncts(a) if x.op == "and" else disjuncts(a))}, key=to_text)
            return parts[0] if len(parts) == 1 else E(x.op, tuple(parts))
        if x.op == "in":
            return E("in", (x.args[0], *sorted(set(x.args[1:]), key=to_text)))
        if x.op in FLIPPED and len(x.args) == 2:
            a, b = x.args
            if (a.op == "lit" and b.op != "lit") or (a.op == "lit") == (b.op == "lit") and to_text(b) < to_text(a):
                return E(FLIPPED[x.op], (b, a))
        if x.op == "col":
            t, n = x.value
            return col(n.lower(), t.lower() if t else None)
        return x

    return e.map(rule)


def fingerprint(e: E) -> str:
    return hashlib.sha256(to_text(canonical(e)).encode()).hexdigest()[:16]


def is_aggregate(e: E) -> bool:
    return e.op == "call" and e.value[0] in SPARK_AGGREGATES


def has_aggregate(e: E) -> bool:
    return is_aggregate(e) or e.op != "over" and any(map(has_aggregate, e.args))


def is_volatile(e: E) -> bool:
    return any(x.op == "call" and x.value[0] in VOLATILE for x in e.walk())


_RANK = {"or": 1, "and": 2, "not": 3, "+": 6, "-": 6, "||": 5, "*": 7, "/": 7, "%": 7, "neg": 8}
_WORD = re.compile(r"[A-Za-z_]\w*\Z")
# Words that need quotes as names.
RESERVED = frozenset("select from where group having order by limit offset union except intersect join on using inner left right full cross lateral as and or not in is null like between case when then else end distinct all with values exists".split())


def name_text(name: str, quote: str = "`") -> str:
    return name if _WORD.match(name) and name.lower() not in RESERVED else quote + name.replace(quote, quote * 2) + quote


def to_text(e: E, quote: str = "`") -> str:
    go = lambda x: to_text(x, quote)
    sub = lambda x, least: f"({go(x)})" if _RANK.get(x.op, 4 if x.op in COMPARISONS or x.op in ("in", "like", "ilike", "is null", "in query", "between") else 9) <= least else go(x)
    match e.op:
        case "col":
            return ".".join(name_text(p, quote) for p in e.value if p)
        case "star":
            return f"{name_text(e.value, quote)}.*" if e.value else "*"
        case "lit":
            v = e.value
            return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        case "typed":
            return f"{e.value[0].upper()} '{e.value[1]}'"
        case "call":
            name, distinct = e.value
            if name == "extract":
                return f"extract({e.args[0].value} FROM {go(e.args[1])})"
            return f"{name}({'DISTINCT ' * distinct}{', '.join(map(go, e.args))})"
        case "within":
            return f"{go(e.args[0])} WITHIN GROUP (ORDER BY {', '.join(e.value)})"
        case "cast":
            return f"CAST({go(e.args[0])} AS {e.value})"
        case "case":
            first, *rest, last = e.args
            body = "".join(f" WHEN {go(w)} THEN {go(t)}" for w, t in zip(rest[::2], rest[1::2], strict=True))
            return "CASE" + (f" {go(first)}" if first != NONE else "") + body + (f" ELSE {go(last)}" if last != NONE else "") + " END"
        case "over":
            order, frame = e.value
            spec = [f"PARTITION BY {', '.join(map(go, e.args[1:]))}"] * bool(e.args[1:]) + [f"ORDER BY {', '.join(order)}"] * bool(order) + [frame] * bool(frame)
            return f"{go(e.args[0])} OVER ({' '.join(spec)})"
        case "and" | "or":
            return f" {e.op.upper()} ".join(sub(a, _RANK[e.op]) for a in e.args)
        case "not":
            return f"NOT {sub(e.args[0], 3)}" if e.args[0].op != "exists" else f"NOT {go(e.args[0])}"
        case "neg":
            return f"-{sub(e.args[0], 8)}"
        case "is null":
            return f"{sub(e.args[0], 4)} IS NULL"
        case "in":
            return f"{sub(e.args[0], 4)} IN ({', '.join(map(go, e.args[1:]))})"
        case "like" | "ilike":
            return f"{sub(e.args[0], 4)} {e.op.upper()} {sub(e.args[1], 4)}"
        case "exists":
            return f"EXISTS ({e.value})"
        case "in query":
            return f"{sub(e.args[0], 4)} IN ({e.value})"
        case "scalar":
            return f"({e.value})"
        case "none":
            return ""
    rank = _RANK.get(e.op, 4)
    return f"{sub(e.args[0], rank - 1)} {e.op} {sub(e.args[1], rank)}"


class Parser:
    """A cursor over tokens with the expression grammar; plans.parser adds queries."""

    def __init__(self, sql: str):
        self.sql, self.tokens, self.i = sql, tokens(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def accept(self, *words: str) -> bool:
        """Takes the words if all stand here."""
        if all(self.ahead(k).upper == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise SqlError(f"{' '.join(words)} expected at {self.now.at}, not {self.now.text!r}")

    def name(self) -> str:
        t = self.take()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        if t.kind != "word":
            raise SqlError(f"name expected at {t.at}, not {t.text!r}")
        return t.text

    def listed(self, one: Callable) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def nested_text(self) -> str:
        """The text up to the bracket that closes the open one, which is taken."""
        start, depth = self.now.at, 1
        while True:
            t = self.take()
            if t.kind == "end":
                raise SqlError("bracket not closed")
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            if not depth:
                return self.sql[start : t.at].strip()

    def expression(self) -> E:
        parts = [self._and()]
        while self.accept("OR"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else E("or", tuple(parts))

    def _and(self) -> E:
        parts = [self._not()]
        while self.accept("AND"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else E("and", tuple(x for p in parts for x in (conjuncts(p) if p.op == "and" else [p])))

    def _not(self) -> E:
        return E("not", (self._not(),)) if self.accept("NOT") else self._predicate()

    def _predicate(self) -> E:
        x = self._sum()
        while True:
            t = self.now.upper
            t = "<>" if t == "!=" else t
            if t in COMPARISONS:
                self.take()
                x = E(t, (x, self._sum()))
                continue
            if self.accept("IS"):
                no = self.accept("NOT")
                if self.accept("NULL"):
                    y = E("is null", (x,))
                elif self.accept("DISTINCT", "FROM"):
                    y = E("call", (x, self._sum()), ("isdistinct", False))
                else:
                    y = E("=", (x, lit(self.take().upper == "TRUE")))
                x = E("not", (y,)) if no else y
                continue
            at = self.i
            no = self.accept("NOT")
            if self.accept("BETWEEN"):
                low = self._sum()
                self.expect("AND")
                y = E("and", (E(">=", (x, low)), E("<=", (x, self._sum()))))
            elif self.accept("IN"):
                self.expect("(")
                if self.now.upper in ("SELECT", "WITH"):
                    y = E("in query", (x,), self.nested_text())
                else:
                    y = E("in", (x, *self.listed(self.expression)))
                    self.expect(")")
            elif self.now.upper in ("LIKE", "ILIKE"):
                y = E(self.take().upper.lower(), (x, self._sum()))
            else:
                self.i = at
                return x
            x = E("not", (y,)) if no else y

    def _sum(self) -> E:
        x = self._product()
        while self.now.upper in ("+", "-", "||"):
            x = E(self.take().text, (x, self._product()))
        return x

    def _product(self) -> E:
        x = self._unary()
        while self.now.upper in ("*", "/", "%"):
            x = E(self.take().text, (x, self._unary()))
        return x

    def _unary(self) -> E:
        if self.accept("-"):
            x = self._unary()
            return lit(-x.value) if x.op == "lit" and isinstance(x.value, (int, Decimal)) and not isinstance(x.value, bool) else E("neg", (x,))
        self.accept("+")
        x = self._primary()
        while self.accept("::"):
            x = E("cast", (x,), self.type_name())
        return x

    def type_name(self) -> str:
        out = self.take().text
        while self.now.kind == "word" and self.now.upper in ("PRECISION", "VARYING", "WITH", "WITHOUT", "TIME", "ZONE"):
            out += " " + self.take().text
        if self.accept("("):
            out += f"({self.nested_text()})"
        return out

    def _primary(self) -> E:
        t = self.now
        if t.kind == "number":
            self.take()
            return lit(int(t.text) if t.text.isdigit() else Decimal(t.text))
        if t.kind == "string":
            self.take()
            return lit(t.text[1:-1].replace("''", "'"))
        if self.accept("("):
            if self.now.upper in ("SELECT", "WITH"):
                return E("scalar", (), self.nested_text())
            x = self.listed(self.expression)
            self.expect(")")
            return x[0] if len(x) == 1 else E("call", tuple(x), ("struct", False))
        if t.upper == "*":
            self.take()
            return E("star")
        if t.upper in ("NULL", "TRUE", "FALSE"):
            self.take()
            return lit({"NULL": None, "TRUE": True, "FALSE": False}[t.upper])
        if t.upper in ("DATE", "TIMESTAMP", "INTERVAL", "TIME") and (self.ahead().kind == "string" or t.upper == "INTERVAL" and self.ahead().kind == "number"):
            self.take()
            text = self.take().text.strip("'")
            if t.upper == "INTERVAL" and self.now.kind == "word" and self.now.upper.rstrip("S") in ("DAY", "MONTH", "YEAR", "HOUR", "MINUTE", "SECOND", "WEEK"):
                text += " " + self.take().text
            return E("typed", (), (t.upper.lower(), text))
        if self.accept("CASE"):
            parts = [NONE if self.now.upper == "WHEN" else self.expression()]
            while self.accept("WHEN"):
                parts.append(self.expression())
                self.expect("THEN")
                parts.append(self.expression())
            parts.append(self.expression() if self.accept("ELSE") else NONE)
            self.expect("END")
            return E("case", tuple(parts))
        if t.upper in ("CAST", "TRY_CAST") and self.ahead().text == "(":
            self.i += 2
            x = self.expression()
            self.expect("AS")
            out = E("cast", (x,), self.type_name())
            self.expect(")")
            return out
        if t.upper == "EXISTS" and self.ahead().text == "(":
            self.i += 2
            return E("exists", (), self.nested_text())
        if t.upper == "EXTRACT" and self.ahead().text == "(":
            self.i += 2
            field = self.take().text.lower()
            self.expect("FROM")
            x = self.expression()
            self.expect(")")
            return E("call", (lit(field), x), ("extract", False))
        if t.kind not in ("word", "quoted") or t.kind == "word" and t.text.lower() in RESERVED - {"left", "right", "values"}:
            raise SqlError(f"expression expected at {t.at}, not {t.text!r}")
        parts = [self.name()]
        while self.now.text == "." and self.now.kind == "sign":
            self.take()
            if self.accept("*"):
                return E("star", (), parts[-1])
            parts.append(self.name())
        if self.now.text == "(" and t.kind == "word":
            return self._call(parts[-1].lower())
        if len(parts) == 1 and parts[0].lower() in ("current_date", "current_timestamp", "current_time") and t.kind == "word":
            return E("call", (), (parts[0].lower(), False))
        return col(parts[-1], parts[-2] if len(parts) > 1 else None)

    def _call(self, name: str) -> E:
        self.expect("(")
        distinct, args = self.accept("DISTINCT"), []
        if not self.accept(")"):
            args = self.listed(self._argument)
            order = self.order_keys() if self.accept("ORDER", "BY") else ()
            self.expect(")")
            if order:
                return self._over(E("within", (E("call", tuple(args), (name, distinct)),), tuple(order)))
        x = E("call", tuple(args), (name, distinct))
        if self.accept("WITHIN", "GROUP", "("):
            self.expect("ORDER", "BY")
            x = E("within", (x,), tuple(self.order_keys()))
            self.expect(")")
        if self.accept("FILTER", "("):
            self.expect("WHERE")
            keep = self.expression()
            self.expect(")")
            x = E("call", (E("case", (NONE, keep, x.args[0] if x.args and x.args[0].op != "star" else lit(1), NONE)), *x.args[1:]), x.value)
        return self._over(x)

    def _argument(self) -> E:
        x = self.expression()
        if self.now.text == "-" and self.ahead().text == ">":  # a lambda of one variable
            self.i += 2
            return E("lambda", (x, self.expression()))
        return x

    def _over(self, x: E) -> E:
        if not self.accept("OVER"):
            return x
        self.expect("(")
        parts = self.listed(self.expression) if self.accept("PARTITION", "BY") else []
        order = self.order_keys() if self.accept("ORDER", "BY") else []
        frame = ""
        if self.now.upper in ("ROWS", "RANGE", "GROUPS"):
            frame = self.nested_text()
        else:
            self.expect(")")
        return E("over", (x, *parts), (tuple(order), frame.upper()))

    def order_keys(self) -> list[str]:
        def one() -> str:
            x = to_text(self.expression())
            x += " DESC" if self.accept("DESC") else ""
            self.accept("ASC")
            return x + (" NULLS FIRST" if self.accept("NULLS", "FIRST") else " NULLS LAST" if self.accept("NULLS", "LAST") else "")

        return self.listed(one)


def parse(text: str) -> E:
    """One expression."""
    p = Parser(text)
    out = p.expression()
    if p.now.kind != "end":
        raise SqlError(f"unexpected {p.now.text!r} at {p.now.at}")
    return out
