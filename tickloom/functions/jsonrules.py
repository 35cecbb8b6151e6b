"""Rules that turn nested JSON messages into columns.

A rule set is a dict from output name to a rule: a constant (``Const``), a path (a list of keys,
positions and ``ONE``, then functions of columns), or a nested rule set located by a path
(``Each``), which gives a struct, or an array of structs where the message has a list. A missing
or null value ends a path: functions after it do not run.

A message is parsed once, into a variant value that all rules read from. A text that is no JSON
gives nulls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _One:
    """In a path: the only element of a list; nothing where there are more or none."""

    def __repr__(self) -> str:
        return "ONE"


ONE = _One()


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Each:
    path: tuple
    rules: dict
    many: bool = False


def _path(steps: list | tuple) -> str:
    """A variant path; keys are quoted, so that they may have any characters but quotes."""
    out = "$"
    for step in steps:
        if isinstance(step, str) and ("'" in step or "\\" in step):
            raise ValueError(f"a key has a quote or backslash: {step}")
        out += f"[{step}]" if isinstance(step, int) else f"['{step}']"
    return out


def _at(part: Column, steps: list | tuple, kind: str) -> Column:
    steps = list(steps)
    if ONE in steps:
        i = steps.index(ONE)
        some = _at(part, steps[:i], "array<variant>")
        return _at(F.when(F.size(some) == 1, F.get(some, 0)), steps[i + 1 :], kind)
    return F.try_variant_get(part, _path(steps), kind)


def _value(part: Column, rule) -> Column:
    if isinstance(rule, Const):
        return F.lit(rule.value)
    if isinstance(rule, Each):
        if rule.many:
            return F.transform(_at(part, rule.path, "array<variant>"), lambda x: F.struct(*_columns(x, rule.rules)))
        inner = _at(part, rule.path, "variant")
        return F.when(inner.isNotNull() & ~F.is_variant_null(inner), F.struct(*_columns(inner, rule.rules)))
    out = _at(part, [k for k in rule if not callable(k)], "string")
    for step in (k for k in rule if callable(k)):
        out = F.when(out.isNotNull(), step(out))
    return out


def _columns(part: Column, rules: dict) -> list[Column]:
    return [_value(part, rule).alias(name) for name, rule in rules.items()]


def parsed(df: DataFrame, message: str, rules: dict, keep: list[str] = []) -> DataFrame:
    """The columns ``keep`` of ``df`` and those of a rule set over the JSON texts in ``message``."""
    name = "message"
    while name in df.columns:
        name = "_" + name
    variants = df.select(*keep, F.try_parse_json(message).alias(name))
    return variants.select(*keep, *_columns(F.col(name), rules))
