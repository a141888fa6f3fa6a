"""Rules as data: ordered tables of patterns with what excludes them, and tables of transitions, compiled into one column expression.

The tables come from the caller; the library has no words of its own in them. A null text fits nothing and excludes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Guard:
    """A pattern that excludes a rule; looked for after the first place where ``after`` fits (nowhere, if it doesn't), or in the whole text."""

    pattern: str
    after: str | None = None


@dataclass(frozen=True)
class Rule:
    """A name for texts that fit a pattern and none of its guards. Two rules may have one name: its other way to fit."""

    name: str
    pattern: str
    guards: tuple[Guard, ...] = ()


def _fits(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def guarded(text: Column, guard: Guard) -> Column:
    if guard.after is None:
        return _fits(text, guard.pattern)
    at = F.regexp_instr(text, F.lit(guard.after))
    return F.coalesce(at > 0, F.lit(False)) & _fits(F.substr(text, at), guard.pattern)


def first_rule(text: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that fits and isn't excluded, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        free = _fits(text, rule.pattern)
        for g in rule.guards:
            free = free & ~guarded(text, g)
        out = F.when(free, F.lit(rule.name)).otherwise(out)
    return out


def rule_report(text: Column, rules: Sequence[Rule]) -> Column:
    """Every rule that fits, in order: its name, and the number (from 0) of the first guard that excludes it, or null."""
    each = []
    for rule in rules:
        by = F.lit(None).cast("int")
        for i, g in reversed(list(enumerate(rule.guards))):
            by = F.when(guarded(text, g), i).otherwise(by)
        each.append(F.when(_fits(text, rule.pattern), F.struct(F.lit(rule.name).alias("name"), by.alias("excluded_by"))))
    return F.array_compact(F.array(*each))


@dataclass(frozen=True)
class Step:
    """From a state (None: from any) an action that fits the pattern leads to another."""

    state: str | None
    pattern: str
    to: str


def _next(state: Column, action: Column, steps: Sequence[Step]) -> Column:
    out = state
    for step in reversed(steps):
        here = F.lit(True) if step.state is None else state == step.state
        out = F.when(here & _fits(action, step.pattern), F.lit(step.to)).otherwise(out)
    return out


def final_state(actions: Column, start: str, steps: Sequence[Step]) -> Column:
    """The state after all of an ordered array of texts, the first step that applies being taken at each; without one, the state stays. Null for a null array."""
    return F.aggregate(actions, F.lit(start), lambda s, a: _next(s, a, steps))


def furthest_state(actions: Column, start: str, steps: Sequence[Step], order: Sequence[str]) -> Column:
    """The state latest in ``order`` that was ever entered, start included; states not in it count as before all."""
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, order)), s), F.lit(0))

    def step(acc: Column, action: Column) -> Column:
        to = _next(acc["state"], action, steps)
        return F.struct(to.alias("state"), F.when(rank(to) > rank(acc["best"]), to).otherwise(acc["best"]).alias("best"))

    first = F.struct(F.lit(start).alias("state"), F.lit(start).alias("best"))
    return F.aggregate(actions, first, step, lambda acc: acc["best"])


def changes(actions: Column, start: str, steps: Sequence[Step]) -> Column:
    """(place, state) of each action, from 0, that led to another state."""

    def step(acc: Column, action: Column) -> Column:
        to = _next(acc["state"], action, steps)
        entered = F.array(F.struct(acc["at"].alias("place"), to.alias("state")))
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), F.when(to != acc["state"], F.concat(acc["seen"], entered)).otherwise(acc["seen"]).alias("seen"))

    empty = F.array().cast("array<struct<place:int,state:string>>")
    return F.aggregate(actions, F.struct(F.lit(start).alias("state"), F.lit(0).alias("at"), empty.alias("seen")), step, lambda acc: acc["seen"])
