"""The factor-expression language: typed trees, a parser and printer, registries and the compiler.

Types are series, int and float. A tree compiles to Columns of a panel: equal sub-trees, within and
across expressions, become one column, and columns are added level by level so that the windows of one
level over one partitioning share a sort."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.operators import cross_section as cs
from panelforge.operators import elementwise as el
from panelforge.operators import timeseries as tsop
from panelforge.plans.panel import Panel

SERIES, INT, FLOAT = "series", "int", "float"


class ExpressionError(ValueError):
    """An expression that cannot be parsed, or whose types do not fit."""


@dataclass(frozen=True)
class Op:
    """build takes Columns and numbers, and the symbol and ts names where family is not "e"."""

    name: str
    args: tuple[str, ...]
    build: Callable
    family: str = "e"  # e: elementwise, cs: cross-section, ts: time series, frame: whole table
    returns: str = SERIES


@dataclass(frozen=True)
class Node:
    """A field, a number, or an operator with its arguments."""

    name: str
    args: tuple[Node, ...] = ()
    kind: str = SERIES
    value: float | int | None = None

    def __str__(self) -> str:
        if self.value is not None:
            return f"get_f{self.value:g}" if self.kind == FLOAT else f"get_{self.value}"
        return f"{self.name}({', '.join(map(str, self.args))})" if self.args else self.name

    @property
    def height(self) -> int:
        return 1 + max((a.height for a in self.args), default=-1)

    @property
    def size(self) -> int:
        return 1 + sum(a.size for a in self.args)

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()


@dataclass
class Registry:
    """Named operators, and the numbers that may stand in an expression."""

    ops: dict[str, Op]
    ints: tuple[int, ...] = ()
    floats: tuple[float, ...] = ()

    def register(self, name: str, args: tuple[str, ...], family: str = "e", returns: str = SERIES):
        """Decorator: a user's operator from a builder of Columns."""

        def add(build: Callable) -> Callable:
            self.ops[name] = Op(name, tuple(args), build, family, returns)
            return build

        return add


def _native() -> dict[str, Op]:
    n, i, f = SERIES, INT, FLOAT
    ops = [
        Op("add", (n, n), el.add), Op("subtract", (n, n), el.subtract), Op("multiply", (n, n), el.multiply), Op("divide", (n, n), el.divide),
        Op("inverse", (n,), el.inverse), Op("abs", (n,), el.absolute), Op("sqrt", (n,), el.sqrt), Op("reverse", (n,), el.reverse),
        Op("maximum", (n, n), el.maximum), Op("minimum", (n, n), el.minimum), Op("s_log_1p", (n,), el.s_log_1p), Op("log", (n,), el.log),
        Op("sign", (n,), el.sign), Op("signed_power", (n, f), el.signed_power),
        Op("rank", (n,), cs.rank, "cs"), Op("normalize", (n,), cs.normalize, "cs"), Op("quantile", (n,), cs.quantile, "cs"), Op("scale", (n,), cs.scale, "cs"), Op("winsorize", (n,), cs.winsorize, "cs"),
        Op("ts_delay", (n, i), tsop.ts_delay, "ts"), Op("ts_corr", (n, n, i), tsop.ts_corr, "ts"), Op("ts_cov", (n, n, i), tsop.ts_cov, "ts"),
        Op("ts_min", (n, i), tsop.ts_min, "ts"), Op("ts_max", (n, i), tsop.ts_max, "ts"), Op("ts_arg_min", (n, i), tsop.ts_arg_min, "ts"), Op("ts_arg_max", (n, i), tsop.ts_arg_max, "ts"),
        Op("ts_rank", (n, i), tsop.ts_rank, "ts"), Op("ts_sum", (n, i), tsop.ts_sum, "ts"), Op("ts_std_dev", (n, i), tsop.ts_std_dev, "ts"), Op("ts_mean", (n, i), tsop.ts_mean, "ts"), Op("ts_zscore", (n, i), tsop.ts_zscore, "ts"),
    ]
    return {o.name: o for o in ops}


def _more() -> dict[str, Op]:
    n, i, f = SERIES, INT, FLOAT
    ops = [
        Op("zscore", (n,), cs.zscore, "cs"), Op("ts_delta", (n, i), tsop.ts_delta, "ts"), Op("ts_product", (n, i), tsop.ts_product, "ts"),
        Op("ts_decay_linear", (n, i), tsop.ts_decay_linear, "ts"), Op("ts_quantile", (n, i), tsop.ts_quantile, "ts"), Op("ts_regression", (n, n, i), tsop.ts_regression, "ts"), Op("ts_scale", (n, i), tsop.ts_scale, "ts"),
        Op("power", (n, i), el.power), Op("days_from_last_change", (n,), tsop.days_from_last_change, "ts"), Op("kth_element", (n, i, i), tsop.kth_element, "ts"),
        Op("last_diff_value", (n, i), tsop.last_diff_value, "ts"), Op("rolling_rank", (n, i), tsop.rolling_rank, "ts"), Op("hump", (n, f), tsop.hump, "frame"),
    ]
    return {o.name: o for o in ops}


#: Other spellings of the same operators.
ALIASES = {"ts_argmin": "ts_arg_min", "ts_argmax": "ts_arg_max", "ts_stddev": "ts_std_dev", "rolling_mean": "ts_mean", "fabs": "abs", "delay": "ts_delay", "delta": "ts_delta", "ts_covariance": "ts_cov", "max": "maximum", "min": "minimum"}

# The numbers that a search draws from, by registry; each once.
USUAL_INTS = (*range(3, 20), *range(20, 246, 5))
USUAL_FLOATS = (*map(float, range(1, 100)), *map(float, range(100, 246, 5)))
LEGACY_INTS = (3, 5, 6, 9, 10, 12, 15, 18, 20, 24, 30, 60, 90, 120)


def native(cross_section: bool = True, time_series: bool = True) -> Registry:
    ops = {k: o for k, o in _native().items() if o.family == "e" or (o.family == "cs" and cross_section) or (o.family == "ts" and time_series)}
    return Registry(ops, USUAL_INTS, USUAL_FLOATS)


def dialect() -> Registry:
    """Operators of the external dialect: those on two series also take a number on either side."""
    known = _native() | _more()
    two = {"add": el.add, "multiply": el.multiply, "subtract": el.subtract, "divide": el.divide, "max": el.maximum, "min": el.minimum}
    ops: dict[str, Op] = {}
    for name, f in two.items():
        ops[name] = Op(name, (SERIES, SERIES), f)
        ops[f"{name}_nf"] = Op(f"{name}_nf", (SERIES, FLOAT), f)
        ops[f"{name}_fn"] = Op(f"{name}_fn", (FLOAT, SERIES), f)
        ops[f"{name}_ff"] = Op(f"{name}_ff", (FLOAT, FLOAT), f, returns=FLOAT)
    for name in ("abs", "reverse", "inverse", "log", "sign", "sqrt", "rank", "normalize", "quantile", "scale", "winsorize", "zscore", "ts_delay", "ts_corr", "ts_arg_min", "ts_arg_max", "ts_rank", "ts_sum", "ts_std_dev", "ts_mean", "ts_zscore", "ts_product", "power", "ts_decay_linear", "ts_delta", "ts_quantile", "ts_regression", "ts_scale"):
        ops[name] = known[name]
    ops["ts_covariance"] = Op("ts_covariance", (SERIES, SERIES, INT), tsop.ts_cov, "ts")
    ops["signed_power"] = Op("signed_power", (SERIES, INT), el.signed_power)
    for name, f in (("reverse", el.reverse), ("inverse", el.inverse)):
        ops[f"{name}_f"] = Op(f"{name}_f", (FLOAT,), f, returns=FLOAT)
    return Registry(ops, tuple(range(1, 1000)), tuple(map(float, range(1, 1000))))


def legacy() -> Registry:
    """Operators by their older names; division by zero has another sentinel."""
    known = _native() | _more()
    ops = {name: known[name] for name in ("rank", "add", "multiply", "subtract", "sqrt", "ts_corr", "ts_cov", "ts_min", "ts_max", "ts_rank", "ts_sum", "ts_zscore", "rolling_rank")}
    for name, of in (("fabs", "abs"), ("delay", "ts_delay"), ("delta", "ts_delta"), ("ts_argmin", "ts_arg_min"), ("ts_argmax", "ts_arg_max"), ("ts_stddev", "ts_std_dev"), ("rolling_mean", "ts_mean")):
        ops[name] = Op(name, known[of].args, known[of].build, known[of].family)
    ops["divide"] = Op("divide", (SERIES, SERIES), lambda x, y: el.divide(x, y, el.LEGACY_ZERO_DIVISION))
    return Registry(ops, LEGACY_INTS)


def everything() -> Registry:
    """All operators, under all names, and any number."""
    ops = _native() | _more()
    for alias, of in ALIASES.items():
        ops.setdefault(alias, Op(alias, ops[of].args, ops[of].build, ops[of].family))
    ops |= {k: o for k, o in dialect().ops.items() if k not in ops}
    return Registry(ops)


_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(-?\d+\.?\d*(?:[eE][-+]?\d+)?)|([(),]))")


def parse(text: str, registry: Registry, fields: tuple[str, ...]) -> Node:
    """A typed tree. Numbers are written plainly or as get_3 and get_f3."""
    tokens: list[str] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r} at {at}")
        tokens.append(m.group().strip())
        at = m.end()
    tokens.append("")

    def number(t: str) -> Node | None:
        m = re.fullmatch(r"get_(f?)(\d+(?:\.\d+)?)", t)
        if m:
            return Node("const", kind=FLOAT, value=float(m[2])) if m[1] else Node("const", kind=INT, value=int(m[2]))
        if re.fullmatch(r"-?\d+", t):
            return Node("const", kind=INT, value=int(t))
        if re.fullmatch(r"-?\d+\.?\d*(?:[eE][-+]?\d+)?", t):
            return Node("const", kind=FLOAT, value=float(t))
        return None

    def term(k: int) -> tuple[Node, int]:
        t = tokens[k]
        if not t or t in "(),":
            raise ExpressionError(f"unexpected {t or 'end'!r}")
        if tokens[k + 1] != "(":
            node = number(t)
            if node is None and t not in fields:
                raise ExpressionError(f"unknown name {t!r}")
            return node or Node(t), k + 1
        if t not in registry.ops:
            raise ExpressionError(f"unknown operator {t!r}")
        args, k = [], k + 2
        while tokens[k] != ")":
            a, k = term(k)
            args.append(a)
            if tokens[k] == ",":
                k += 1
            elif tokens[k] != ")":
                raise ExpressionError(f"expected , or ) before {tokens[k] or 'end'!r}")
        return typed(registry.ops[t], args), k + 1

    node, k = term(0)
    if tokens[k]:
        raise ExpressionError(f"unexpected {tokens[k]!r} after the expression")
    return node


def typed(op: Op, args: list[Node]) -> Node:
    """The operator applied, its argument types checked; an int serves as a float."""
    if len(args) != len(op.args):
        raise ExpressionError(f"{op.name} takes {len(op.args)} arguments, not {len(args)}")
    out = []
    for want, a in zip(op.args, args, strict=True):
        if want == FLOAT and a.kind == INT and a.value is not None:
            a = Node("const", kind=FLOAT, value=float(a.value))
        if a.kind != want:
            raise ExpressionError(f"{op.name} takes {want}, not {a.kind} {a}")
        out.append(a)
    return Node(op.name, tuple(out), op.returns)


def valid(text: str, registry: Registry, fields: tuple[str, ...]) -> bool:
    """Whether the text parses and prints back as itself, spaces apart."""
    try:
        return str(parse(text, registry, fields)).replace(" ", "") == text.replace(" ", "")
    except ExpressionError:
        return False


def evaluate(panel: Panel, expressions: dict[str, str | Node], registry: Registry | None = None) -> Panel:
    """The panel with one more column per expression. Window operators become columns of their own, by
    level and then by partitioning; elementwise ones are built into what uses them."""
    registry = registry or everything()
    trees = {k: parse(e, registry, panel.fields) if isinstance(e, str) else e for k, e in expressions.items()}
    df, made = panel.df, {}

    def level(n: Node) -> int:
        """How many times the rows must be arranged before the node is known."""
        below = max((level(a) for a in n.args), default=0)
        return below + (n.args != () and registry.ops[n.name].family != "e")

    def column(n: Node):
        if n.value is not None:
            return n.value
        key = str(n)
        if key in made:
            return F.col(made[key])
        if not n.args:
            return F.col(n.name)
        op = registry.ops[n.name]
        args = [column(a) for a in n.args]
        if op.family == "e":
            if not any(isinstance(a, Column) for a in args) or op.args.count(FLOAT) and op.build in (el.add, el.subtract, el.multiply, el.divide, el.maximum, el.minimum, el.inverse, el.reverse):
                args = [a if isinstance(a, Column) else F.lit(float(a)) for a in args]
            return op.build(*args)
        return op.build(*args, **({"ts": panel.ts} if op.family == "cs" else {"symbol": panel.symbol, "ts": panel.ts}))

    waiting = {str(n): n for t in trees.values() for n in t.walk() if n.args and registry.ops[n.name].family != "e"}
    for key, n in sorted(waiting.items(), key=lambda x: (level(x[1]), registry.ops[x[1].name].family, x[0])):
        name = f"__x{len(made)}"
        if registry.ops[n.name].family == "frame":
            arg = f"__a{len(made)}"
            first = column(n.args[0])
            df = registry.ops[n.name].build(df.withColumn(arg, first.cast("double")), arg, name, *[a.value for a in n.args[1:]], symbol=panel.symbol, ts=panel.ts).drop(arg)
        else:
            df = df.withColumn(name, column(n))
        made[key] = name
    for name, t in trees.items():
        c = column(t)
        df = df.withColumn(name, c if isinstance(c, Column) else F.lit(c))
    return Panel(df.drop(*made.values()), panel.fields, panel.symbol, panel.ts)
