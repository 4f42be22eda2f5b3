"""Rules as data: formulas with guards, checked and turned into columns, each row meets each rule once."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITHMETIC: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Pow: F.pow, ast.Mod: F.try_mod}
COMPARISONS: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
FUNCTIONS: dict[str, Callable] = {"sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "abs": F.abs, "min": F.least, "max": F.greatest, "exp": F.exp, "log": F.ln, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double")}
#: Length of a formula, and nodes that it may have.
LONGEST, MOST_NODES = 2000, 200


@dataclass(frozen=True)
class Rule:
    """A formula over named values; ``guard`` has to hold, ``tier`` tells how far it can be trusted, from 1 on up."""

    rule_id: str
    expression: str
    unit: str | None = None
    guard: str | None = None
    tier: int | None = None
    region: str | None = None
    kind: str = "formula"


class RuleError(ValueError):
    """What is wrong with a rule itself."""


class Compiled:
    """A formula as a column, and the names that it needs. Only numbers, names, arithmetic, comparisons and FUNCTIONS are let through."""

    def __init__(self, text: str, have: set[str]):
        if len(text) > LONGEST:
            raise RuleError("formula too long")
        try:
            tree = ast.parse(text, mode="eval")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            raise RuleError("not a formula") from None
        if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
            raise RuleError("formula too long")
        self.have, self.names = have, []
        self.column = self.of(tree.body)

    @property
    def missing(self) -> list[str]:
        return [n for n in dict.fromkeys(self.names) if n not in self.have]

    def of(self, node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() as value):
                return F.lit(value)
            case ast.Constant(value=int() | float() as value):
                return F.lit(float(value))
            case ast.Name(id=name):
                self.names.append(name)
                return F.col(name).cast("double") if name in self.have else F.lit(None).cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.of(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.of(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in ARITHMETIC:
                return ARITHMETIC[type(op)](self.of(a), self.of(b))
            case ast.BoolOp(op=op, values=values):
                out = self.of(values[0])
                for value in values[1:]:
                    out = out & self.of(value) if isinstance(op, ast.And) else out | self.of(value)
                return out
            case ast.Compare(left=a, ops=ops, comparators=rest) if all(type(op) in COMPARISONS for op in ops):
                sides, out = [self.of(a), *map(self.of, rest)], F.lit(True)
                for x, op, y in zip(sides, ops, sides[1:], strict=False):
                    out = out & COMPARISONS[type(op)](x, y)
                return out
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
                return FUNCTIONS[name](*map(self.of, args))
        raise RuleError(f"{type(node).__name__} isn't allowed in a formula")


def warnings_of(rule: Rule) -> list[str]:
    """Why a result of the rule should be looked at."""
    tier = [f"credibility tier {rule.tier}"] if rule.tier is not None and rule.tier <= 3 else []
    return tier + ([f"region {rule.region}"] if rule.region else [])


def evaluated(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, rule_id, result, unit, tier, warnings, error) of each row and rule; errors are values, and stop nothing.

    A rule that isn't a formula, or whose text or guard isn't allowed, has the same error for every row; so has one that
    needs values that the rows haven't. A row's own errors are a guard that doesn't hold and a result that is no number.
    """
    have, told, values, guards = set(rows.columns), [], F, F
    for k, rule in enumerate(rules):
        wrong, of = F.lit(None).cast("string"), F.col("__r.k") == k
        try:
            if rule.kind != "formula":
                raise RuleError(f"only formulas have results, not a {rule.kind}")
            formula, guard = Compiled(rule.expression, have), Compiled(rule.guard, have) if rule.guard else None
            missing = formula.missing + [n for n in (guard.missing if guard else []) if n not in formula.missing]
            if missing:
                raise RuleError(f"missing: {', '.join(missing)}")
            values = values.when(of, formula.column.cast("double"))
            guards = guards.when(of, F.coalesce(guard.column, F.lit(False))) if guard else guards
        except RuleError as error:
            wrong = F.lit(str(error))
        told.append(
            F.struct(
                F.lit(k).alias("k"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.unit).cast("string").alias("unit"), F.lit(rule.tier).cast("int").alias("tier"), F.lit("; ".join(warnings_of(rule))).alias("warnings"), wrong.alias("wrong")
            )
        )
    # A row meets the rules first, as constants, and then only the formula of its rule: all formulas as one array of structs are too much code for Java to compile.
    value = values.otherwise(F.lit(None)) if values is not F else F.lit(None)
    holds = guards.otherwise(F.lit(True)) if guards is not F else F.lit(True)
    each = rows.select("*", F.explode(F.array(*told)).alias("__r")).select(*keys, "__r", value.cast("double").alias("__value"), holds.alias("__holds"))
    number = F.col("__value").isNotNull() & ~F.isnan("__value") & (F.abs("__value") != float("inf"))
    error = F.coalesce("__r.wrong", F.when(~F.col("__holds"), F.lit("guard")).when(~number, F.lit("no number")))
    result = F.when(F.col("__holds") & number, F.col("__value"))
    return each.select(*keys, "__r.rule_id", result.alias("result"), "__r.unit", "__r.tier", "__r.warnings", error.alias("error"))
