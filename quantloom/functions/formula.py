"""A small language for rolling formulas, compiled to Spark columns or to DuckDB SQL.

    z100(oir) - lag5(z100(oir))        if(a > 0, b / a, null)        ewm(0.01376, 100, x)

Functions whose name ends in a number take it as rows: z zN mean std sum min max wma lag lead delta.
cum_max cum_min cum_sum run from the start of the series; clip(x, low, high) may have a null bound; sgn is
the sign. A window needs ``rows`` present values; ``z`` of a window without dispersion is 0, ``zN`` null.
Null propagates as in SQL; a division by zero is null.

A window over a window can't be one expression, so a set of formulas is compiled into stages: equal
subexpressions share a column, and all windows of a stage share one sort of the series. Both engines read the
same SQL, but for rolling sums, deviations and recursive means, which Spark gets from ``with_rolling``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import ROLLING, Frame, with_rolling

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|!=|[-+*/()<>=&|,]))")
_ROWS = re.compile(r"^(zN|z|mean|std|sum|min|max|wma|lag|lead|delta)(\d+)$")
_TESTS = ("<", ">", "<=", ">=", "=", "!=", "&", "|")
_CUM = ("cum_max", "cum_min", "cum_sum")
_LEVELS = [("|",), ("&",), ("<", ">", "<=", ">=", "=", "!="), ("+", "-"), ("*", "/")]

Node = tuple


def parse(text: str) -> Node:
    """Formula -> nested tuples: ("num", x), ("col", name), ("call", name, args...), (operator, a, b)."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 20]!r} in {text!r}")
        tokens.append(m.group(m.lastindex))
        at = m.end()
    tokens.append("")
    pos = 0

    def take(want: str | None = None) -> str:
        nonlocal pos
        if want is not None and tokens[pos] != want:
            raise ValueError(f"expected {want!r}, not {tokens[pos]!r}, in {text!r}")
        pos += 1
        return tokens[pos - 1]

    def level(k: int) -> Node:
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while tokens[pos] in _LEVELS[k]:
            op = take()
            left = (op, left, level(k + 1))
        return left

    def unary() -> Node:
        if tokens[pos] == "-":
            take()
            inner = unary()
            return ("num", -inner[1]) if inner[0] == "num" else ("neg", inner)
        t = take()
        if t == "(":
            inner = level(0)
            take(")")
            return inner
        if re.match(r"\d", t):
            return ("num", float(t))
        if not re.match(r"[A-Za-z_]", t):
            raise ValueError(f"unexpected {t!r} in {text!r}")
        if tokens[pos] != "(":
            return ("null",) if t == "null" else ("col", t)
        take("(")
        args = []
        while tokens[pos] != ")":
            args.append(level(0))
            if tokens[pos] == ",":
                take()
        take(")")
        return ("call", t, *args)

    out = level(0)
    if tokens[pos]:
        raise ValueError(f"unexpected {tokens[pos]!r} in {text!r}")
    return out


def columns(node: Node) -> set[str]:
    """Input columns of a formula."""
    if node[0] == "col":
        return {node[1]}
    return set().union(*[columns(x) for x in node if isinstance(x, tuple)])


def substitute(node: Node, names: dict[str, Node]) -> Node:
    """Replace columns by formulas."""
    if node[0] == "col":
        return names.get(node[1], node)
    return tuple(substitute(x, names) if isinstance(x, tuple) else x for x in node)


def _is_test(node: Node) -> bool:
    return node[0] in _TESTS or (node[0] == "call" and node[1] in ("isnull", "notnull"))


def _is_window(node: Node) -> bool:
    return node[0] == "call" and (bool(_ROWS.match(node[1])) or node[1] in _CUM or node[1] == "ewm")


def depth(node: Node) -> int:
    """Nesting of window functions."""
    inner = max((depth(x) for x in node if isinstance(x, tuple)), default=0)
    return inner + _is_window(node)


@dataclass
class Plan:
    """Stages of named expressions, and the name that holds each formula."""

    stages: list[dict[str, Node]]
    outputs: dict[str, Node]


def plan(formulas: dict[str, Node]) -> Plan:
    """Window nodes become columns of the stage after those they need; equal nodes share a column."""
    known: dict[Node, tuple[str, int]] = {}
    stages: list[dict[str, Node]] = []

    def lift(node: Node) -> tuple[Node, int]:
        parts = [lift(x) if isinstance(x, tuple) else (x, 0) for x in node]
        flat, level = tuple(p for p, _ in parts), max(k for _, k in parts)
        if not _is_window(node):
            return flat, level
        if flat not in known:
            known[flat] = (f"w{len(known)}_", level)
            while len(stages) <= level:
                stages.append({})
            stages[level][known[flat][0]] = flat
        name, at = known[flat]
        return ("col", name), at + 1

    return Plan(stages, {k: lift(v)[0] for k, v in formulas.items()})


# Spark


def compute(df: DataFrame, formulas: dict[str, str | Node], frame: Frame = Frame(), keep: list[str] | None = None) -> DataFrame:
    """df with a column for each formula: as many passes as windows are nested, one sort each."""
    nodes = {k: parse(v) if isinstance(v, str) else v for k, v in formulas.items()}
    p = plan(nodes)
    kept = df.columns if keep is None else keep
    # a pass in Python carries what it is given, so only what is read goes in
    used = {c.lower() for c in set(kept).union(frame.keys, frame.order, *map(columns, nodes.values()))}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() in used])
    for stage in p.stages:
        passed = {k: _pass(v, frame) for k, v in stage.items()}
        plain = [f"{_sql(v, frame)} AS `{k}`" for k, v in stage.items() if passed[k] is None]
        rolled = {k: v for k, v in passed.items() if v is not None}
        out = out.selectExpr("*", *plain) if plain else out
        out = with_rolling(out, frame, rolled) if rolled else out
    return out.selectExpr(*[f"`{c}`" for c in kept], *[f"CAST({_sql(v, frame)} AS DOUBLE) AS `{k}`" for k, v in p.outputs.items()])


def _pass(node: Node, frame: Frame) -> tuple | None:
    """What ``with_rolling`` takes for a window node; None for one that is a running or short frame in SQL."""
    if node[1] == "ewm":
        return ("ewm", _sql(node[4], frame), node[2][1], int(node[3][1]))
    m = _ROWS.match(node[1])
    return (m.group(1), _sql(node[2], frame), int(m.group(2))) if m and m.group(1) in ROLLING else None


# DuckDB


def _sql(node: Node, frame: Frame) -> str:
    kind = node[0]
    if kind == "num":
        return f"{node[1]!r}::DOUBLE"
    if kind == "null":
        return "NULL::DOUBLE"
    if kind == "col":
        return node[1]
    a = [_sql(x, frame) for x in node[1:] if isinstance(x, tuple)]
    if kind == "neg":
        return f"(-{a[0]})"
    if kind in "+-*/":
        a = [f"CAST({x} AS DOUBLE)" if _is_test(n) else x for x, n in zip(a, node[1:], strict=True)]
    if kind == "/":
        return f"({a[0]} / nullif({a[1]}, 0))"
    if kind != "call":
        return f"({a[0]} {({'&': 'AND', '|': 'OR', '!=': '<>'}).get(kind, kind)} {a[1]})"
    name = node[1]
    part = f"PARTITION BY {', '.join(frame.keys)} ORDER BY {', '.join(frame.order)}"
    if m := _ROWS.match(name):
        what, n = m.group(1), int(m.group(2))
        rows = f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        x = f"CAST({a[0]} AS DOUBLE)"
        full = f"count({x}) {rows} = {n}"
        if what in ("z", "zN"):
            sd = f"stddev_samp({x}) {rows}"
            flat = "0.0" if what == "z" else "NULL"
            return f"CASE WHEN {full} THEN CASE WHEN {sd} > 0 THEN ({x} - avg({x}) {rows}) / ({sd}) ELSE {flat} END END"
        if what == "lag":
            return f"lag({a[0]}, {n}) OVER ({part})"
        if what == "lead":
            return f"lead({a[0]}, {n}) OVER ({part})"
        if what == "delta":
            return f"({a[0]} - lag({a[0]}, {n}) OVER ({part}))"
        if what == "wma":
            terms = " + ".join(f"lag({x}, {k}) OVER ({part}) * {n - k}" for k in range(n))
            return f"CASE WHEN {full} THEN ({terms}) / {n * (n + 1) / 2} END"
        fn = {"mean": "avg", "std": "stddev_samp"}.get(what, what)
        return f"CASE WHEN {full} THEN {fn}({x}) {rows} END"
    if name in _CUM:
        fn = name[4:]
        x = f"CAST({a[0]} AS DOUBLE)" if fn == "sum" else a[0]
        return f"CASE WHEN {a[0]} IS NOT NULL THEN {fn}({x}) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END"
    if name == "ewm":
        alpha, least, x = node[2][1], int(node[3][1]), a[2]
        seen = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({part} ROWS UNBOUNDED PRECEDING)"
        fold = f"list_reduce({seen}, lambda acc, v: acc * {1 - alpha!r} + v * {alpha!r})"
        return f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= {least} THEN {fold} END"
    if name == "if":
        return f"CASE WHEN {a[0]} THEN CAST({a[1]} AS DOUBLE) ELSE CAST({a[2]} AS DOUBLE) END"
    if name == "clip":
        out = a[0] if node[3] == ("null",) else f"greatest({a[0]}, {a[1]})"
        out = out if node[4] == ("null",) else f"least({out}, {a[2]})"
        return f"CASE WHEN {a[0]} IS NOT NULL THEN {out} END"
    if name == "bool":
        return f"CAST({a[0]} AS DOUBLE)"
    if name in ("isnull", "notnull"):
        return f"({a[0]} IS {'NOT ' if name == 'notnull' else ''}NULL)"
    if name == "log":
        return f"CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END"
    if name in ("abs", "sqrt", "pow", "sgn"):
        return f"{'sign' if name == 'sgn' else name}({', '.join(a)})" + ("::DOUBLE" if name == "sgn" else "")
    raise ValueError(f"unknown function {name}")


def sql(source: str, formulas: dict[str, str | Node], keep: list[str], frame: Frame = Frame(), digits: int = 6) -> str:
    """DuckDB query with the rows of ``compute`` over a subquery, rounded."""
    nodes = {k: parse(v) if isinstance(v, str) else v for k, v in formulas.items()}
    p = plan(nodes)
    ctes, last = [f"s0 AS ({source})"], "s0"
    for k, stage in enumerate(p.stages):
        ctes.append(f"s{k + 1} AS (SELECT *, {', '.join(f'{_sql(v, frame)} AS {n}' for n, v in stage.items())} FROM {last})")
        last = f"s{k + 1}"
    out = ", ".join(f"round({_sql(v, frame)}, {digits}) + 0.0 AS {n}" for n, v in p.outputs.items())
    return f"WITH {', '.join(ctes)} SELECT {', '.join(keep)}, {out} FROM {last}"
