"""Scalars of texts, choices and payloads as column expressions, and a translation of users' arithmetic to them."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import finite

#: Equality of users' expressions holds up to this difference. Fixed value.
EQUAL_WITHIN = 1e-12

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),
    ast.Pow: lambda a, b: F.pow(a, b),
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: F.abs(a - b) <= EQUAL_WITHIN,
    ast.NotEq: lambda a, b: F.abs(a - b) > EQUAL_WITHIN,
}
_CALLS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "min": F.least, "max": F.greatest, "floor": F.floor, "ceil": F.ceil}


def _plain(text: str) -> str:
    """The expression with Python's operators."""
    for old, new in (("~=", "!="), (".*", "*"), ("./", "/"), (".^", "**"), ("^", "**"), ("&&", " and "), ("||", " or "), ("!=", "\0"), ("!", " not "), ("~", " not "), ("\0", "!=")):
        text = text.replace(old, new)
    return text.strip()


def expression(text: str, names: set[str] | list[str]) -> Column:
    """A users' arithmetic or Boolean expression over named columns, as a double column; truth is 1 and 0.

    Also in the notation `~=`, `!x`, `~x`, `&&`, `||`, `^`, `.*`, `./`, `.^`. Anything but numbers, the names given,
    operators and a few functions is an error. A division by zero is NULL.
    """
    def number(truth: Column) -> Column:
        return F.when(truth, 1.0).when(~truth, 0.0)

    def of(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return of(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Name) and node.id.lower() in ("true", "false"):
            return F.lit(float(node.id.lower() == "true"))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -of(node.operand) if isinstance(node.op, ast.USub) else of(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return number(of(node.operand) == 0)
        if isinstance(node, ast.BoolOp):
            parts = [of(v) != 0 for v in node.values]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole & p if isinstance(node.op, ast.And) else whole | p
            return number(whole)
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [of(x) for x in (node.left, *node.comparators)]
            whole = F.lit(True)
            for o, a, b in zip(node.ops, sides, sides[1:], strict=False):
                whole = whole & _COMPARE[type(o)](a, b)
            return number(whole)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return _CALLS[node.func.id](*map(of, node.args)).cast("double")
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    try:
        tree = ast.parse(_plain(text), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"no expression: {text}") from error
    return of(tree)


def token_of(label: Column, tokens: dict[str, str]) -> Column:
    """The value of the first token that stands in the label between underscores or its ends; NULL without one."""
    found = F.lit(None).cast("string")
    for token, value in reversed(tokens.items()):
        found = F.when(F.lower(label).rlike(rf"(^|_){token}(_|$)"), value).otherwise(found)
    return found


def label_of_path(path: Column, labels: list[str]) -> Column:
    """The longest label that the path's file name ends with, else the longest that it holds; NULL without one. Ties go to the first by name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    ranked = sorted(labels, key=lambda x: (-len(x), x))
    return F.coalesce(*(F.when(F.endswith(name, F.lit(x)), x) for x in ranked), *(F.when(F.contains(name, F.lit(x)), x) for x in ranked)) if ranked else F.lit(None).cast("string")


_NOTHING = ["", "nan", "none", "null"]


def nullable_bool(text: Column) -> Column:
    """True, false, or NULL for the texts that say nothing; other texts are NULL too."""
    said = F.lower(F.trim(text))
    return F.when(said.isin("1", "true", "yes", "y", "t", "on"), True).when(said.isin("0", "false", "no", "n", "f", "off"), False)


def nullable_int(text: Column) -> Column:
    said = F.lower(F.trim(text))
    whole = F.regexp_replace(said, r"\.0+$", "")
    return F.when(~said.isin(_NOTHING), whole.try_cast("long"))


def resolved_choice(answer: Column, choices: Column) -> Column:
    """The choice that equals the answer, else the only one that does when case is ignored; NULL if there is none or several."""
    answer = F.trim(answer)
    alike = F.filter(choices, lambda c: F.lower(c) == F.lower(answer))
    return F.when(F.array_contains(choices, answer), answer).when(F.size(alike) == 1, F.get(alike, F.lit(0)))


def significant(x: Column, digits: int = 4) -> Column:
    """x to some significant digits; -0 is 0."""
    if not 1 <= digits <= 15:
        raise ValueError("1 to 15 digits")
    magnitude = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.floor(F.abs(x) * magnitude + 0.5) / magnitude * F.signum(x))


def subtree(run: Column, children: Column, time0: Column) -> Column:
    """The ids of a baseline, its children and their time0 runs: each once, none empty."""
    every = F.concat(F.array(run), F.coalesce(children, F.array().cast("array<string>")), F.coalesce(time0, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")))


def tri_state(verdict: Column) -> Column:
    """yes, no or error of a verdict given as text; what is neither is an error."""
    said = F.lower(F.trim(verdict))
    return F.when(said.isin("yes", "true", "1"), "yes").when(said.isin("no", "false", "0"), "no").otherwise("error")


def json_safe(x: Column) -> Column:
    """The number, or NULL where JSON has none for it."""
    return F.when(finite(x), x)


def valid_ratios(levels: Column) -> Column:
    """The list if each member is NULL, finite or minus infinity; else NULL."""
    return F.when(F.forall(levels, lambda x: x.isNull() | finite(x) | (x == float("-inf"))), levels)


#: A parameter's sampling: its interval and how it is drawn.
SAMPLING = "low double, high double, scale string"


def sampling(spec: Column) -> Column:
    """struct (low, high, scale) of a JSON text {"interval": [low, high], "distribution": ...}; NULL unless low <= high, and low > 0 where it is loguniform."""
    given = F.from_json(spec, "interval array<double>, distribution string")
    low, high = F.get(given["interval"], F.lit(0)), F.get(given["interval"], F.lit(1))
    scale = F.lower(F.coalesce(given["distribution"], F.lit("uniform")))
    good = (F.size(given["interval"]) == 2) & finite(low) & finite(high) & (low <= high) & scale.isin("uniform", "loguniform") & ((scale != "loguniform") | (low > 0))
    return F.when(good, F.struct(low.alias("low"), high.alias("high"), scale.alias("scale")))


def drawn(spec: Column, uniform: Column) -> Column:
    """The value of an interval at a uniform draw, even on its scale."""
    low, high = spec["low"], spec["high"]
    return F.when(spec["scale"] == "loguniform", F.exp(F.ln(low) + uniform * (F.ln(high) - F.ln(low)))).otherwise(low + uniform * (high - low))


def drawn_outside(spec: Column, uniform: Column, gap_low: Column, gap_high: Column) -> Column:
    """The value of an interval without its gap (gap_low, gap_high) at a uniform draw: what is left, put together, is even on the spec's scale. NULL if nothing is left."""
    logs = spec["scale"] == "loguniform"
    to = lambda x: F.when(logs, F.ln(x)).otherwise(x)
    low, high = to(spec["low"]), to(spec["high"])
    a, b = F.least(F.greatest(to(gap_low), low), high), F.least(F.greatest(to(gap_high), low), high)
    left, right = a - low, high - b
    at = uniform * (left + right)
    place = F.when(at < left, low + at).otherwise(b + at - left)
    return F.when(left + right > 0, F.when(logs, F.exp(place)).otherwise(place))


def nested(names: Column, rows: Column) -> Column:
    """A square matrix (array of arrays) as a map of maps by name; numbers that JSON lacks become NULL."""
    inner = lambda row: F.map_from_arrays(names, F.transform(row, json_safe))
    return F.map_from_arrays(names, F.transform(rows, inner))


def matrix(names: Column, maps: Column) -> Column:
    """The matrix of a map of maps, in the order of the names."""
    return F.transform(names, lambda r: F.transform(names, lambda c: F.try_element_at(F.try_element_at(maps, r), c)))


def identity_number(text: Column) -> Column:
    """The text of a number as identities hash it: whole numbers without a point, never -0."""
    x = text.try_cast("double")
    whole = F.when(x == 0, "0").when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string"))
    return F.when(x.isNull(), text).otherwise(F.coalesce(whole, x.cast("string")))


def evaluated(df: DataFrame, given: dict[str, str]) -> DataFrame:
    """df with a column for each expression, which may name columns and the other expressions; a circle is an error."""
    left, out = dict(given), df
    while left:
        ready = [n for n, text in left.items() if not _names(text) & left.keys()]
        if not ready:
            raise ValueError(f"expressions in a circle: {sorted(left)}")
        for n in ready:
            out = out.withColumn(n, expression(left.pop(n), out.columns))
    return out


def _names(text: str) -> set[str]:
    return {x.id for x in ast.walk(ast.parse(_plain(text), mode="eval")) if isinstance(x, ast.Name)}
