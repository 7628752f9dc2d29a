"""Per-pixel expressions over bands, compiled to one column.

Comparisons bind loosest and can be chained, then + and -, then * and /, then a sign; all associate to the left. NULL in, NULL out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ComputeError
from ..functions.nodata import INF, no_nan

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<name>[A-Za-z]\w*)|(?P<symbol><=|>=|==|!=|[-+*/(),<>]))", re.ASCII)
_LEVELS = (("<", "<=", ">", ">=", "==", "!="), ("+", "-"), ("*", "/"))


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is an infinity, 0 / 0 is nodata."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return no_nan(F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b)))


def natural_log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def choose(c: Column, a: Column, b: Column) -> Column:
    return F.when(c.isNotNull() & a.isNotNull() & b.isNotNull(), F.when(c == 0, b).otherwise(a))


_BINARY = {
    "+": lambda a, b: no_nan(a + b), "-": lambda a, b: no_nan(a - b), "*": lambda a, b: no_nan(a * b), "/": divide,
    "<": lambda a, b: (a < b).cast("double"), "<=": lambda a, b: (a <= b).cast("double"), ">": lambda a, b: (a > b).cast("double"),
    ">=": lambda a, b: (a >= b).cast("double"), "==": lambda a, b: (a == b).cast("double"), "!=": lambda a, b: (a != b).cast("double"),
}
FUNCTIONS = {
    "sqrt": (1, lambda x: no_nan(F.sqrt(x))), "abs": (1, F.abs), "exp": (1, F.exp), "log": (1, natural_log),
    "min": (2, lambda a, b: both(a, b, F.least(a, b))), "max": (2, lambda a, b: both(a, b, F.greatest(a, b))),
    "pow": (2, lambda a, b: no_nan(F.pow(a, b))), "where": (3, choose),
}


@dataclass
class Compiled:
    column: Column
    bands: int


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise ComputeError(f"unexpected character {rest[:1]!r} in the expression")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def compile_expression(text: str) -> Compiled:
    """The column of an expression, and how many bands its input needs at least."""
    queue, most = tokens(text), -1

    def peek() -> str | None:
        return queue[0][1] if queue else None

    def take(expected: str | None = None) -> tuple[str, str]:
        if not queue:
            raise ComputeError("the expression ends too soon" + (f", {expected!r} expected" if expected else ""))
        if expected is not None and queue[0][1] != expected:
            raise ComputeError(f"{expected!r} expected, found {queue[0][1]!r}")
        return queue.pop(0)

    def binary(level: int) -> Column:
        if level == len(_LEVELS):
            return signed()
        left = binary(level + 1)
        while peek() in _LEVELS[level]:
            left = _BINARY[take()[1]](left, binary(level + 1))
        return left

    def signed() -> Column:
        if peek() == "-":
            take()
            return -signed()
        return atom()

    def atom() -> Column:
        nonlocal most
        kind, word = take()
        if kind == "number":
            return F.lit(float(word))
        if word == "(":
            inner = binary(0)
            take(")")
            return inner
        if kind != "name":
            raise ComputeError(f"unexpected {word!r}")
        if re.fullmatch(r"b\d+", word):
            most = max(most, int(word[1:]))
            return F.col(f"b{int(word[1:])}")
        if word not in FUNCTIONS:
            raise ComputeError(f"unknown name {word!r}")
        count, f = FUNCTIONS[word]
        take("(")
        given = [binary(0)] if peek() != ")" else []
        while peek() == ",":
            take()
            given.append(binary(0))
        take(")")
        if len(given) != count:
            raise ComputeError(f"{word} takes {count} arguments, {len(given)} given")
        return f(*given)

    column = binary(0)
    if queue:
        raise ComputeError(f"trailing input {queue[0][1]!r}")
    return Compiled(column, most + 1)


def band_math(cells: DataFrame, text: str) -> DataFrame:
    """One band b0 from an expression over the bands of cells."""
    from ..functions.nodata import bands

    have, compiled = bands(cells.columns), compile_expression(text)
    if compiled.bands > len(have):
        raise ComputeError(f"the expression needs {compiled.bands} bands, its input has {len(have)}")
    return cells.select(*[c for c in cells.columns if c not in have], compiled.column.cast("double").alias("b0"))
