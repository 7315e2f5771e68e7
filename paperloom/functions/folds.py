"""Folds over arrays that also emit rows, in time that grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once. What body gives is copied: keep it small in folds."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def emitting(items: Column, state: Column, state_type: str, emitted_type: str, step: Callable[[Column, Column], Column]) -> Column:
    """A struct of `state`, what step() leads to over all items, and `out`, all that it emits.
    step(state, item) gives a struct of `state`, the next one, of the same fields and types,
    and `out`, an array of emitted values.

    Appending to one array copies it each time, so stretches of CHUNK items emit into arrays
    of their own. What a step made is kept as it is and appended by the next one: so nothing
    is evaluated twice, and what was emitted is neither cast nor copied again."""
    empty, none = F.array().cast(f"array<{emitted_type}>"), F.array().cast(f"array<array<{emitted_type}>>")
    made_type = f"struct<state:{state_type},out:array<{emitted_type}>>"
    pair = lambda made, out: F.struct(made.alias("made"), out.alias("out"))
    begun = F.struct(state.cast(state_type).alias("state"), empty.alias("out")).cast(made_type)

    def one(acc, item):
        return pair(step(acc["made"]["state"], item), F.concat(acc["out"], acc["made"]["out"]))

    def folded(items):
        def stretch(acc, at):
            done = F.aggregate(F.slice(items, at + 1, F.lit(CHUNK)), pair(acc["done"]["made"], empty), one)
            return F.struct(done.alias("done"), F.concat(acc["outs"], F.array(acc["done"]["out"])).alias("outs"))

        starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        start = F.struct(pair(begun, empty).alias("done"), none.alias("outs"))
        return F.aggregate(starts, start, stretch, lambda acc: F.struct(acc["done"]["made"]["state"].alias("state"), F.flatten(F.concat(acc["outs"], F.array(acc["done"]["out"], acc["done"]["made"]["out"]))).alias("out")))

    return let(items, folded)
