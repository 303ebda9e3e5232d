"""Folds over arrays that give arrays, in time proportional to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded into one array before it is put aside: concat() copies what it has.
BLOCK = 256


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once however often f uses it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def fold(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, finish: Callable[[Column], Column] | None = None) -> Column:
    """step(state, item) gives the next state and an array of outputs (of type kind); these are put together in order, with those of finish(last state) after them."""

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.named_struct(F.lit("state"), state, F.lit("out"), F.concat(acc["out"], out))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.named_struct(F.lit("state"), acc["state"], F.lit("out"), empty(f"array<{kind}>")), one)
        return bind(inner, lambda i: F.named_struct(F.lit("state"), i["state"], F.lit("out"), F.concat(acc["out"], F.array(i["out"]))))

    def over(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / F.lit(BLOCK)).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(empty("array<int>"))
        blocks = F.transform(starts, lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.named_struct(F.lit("state"), zero, F.lit("out"), empty(f"array<array<{kind}>>"))
        end = (lambda s: F.flatten(s["out"])) if finish is None else (lambda s: F.concat(F.flatten(s["out"]), finish(s["state"])))
        return F.aggregate(blocks, start, block, end)

    return bind(items, over)
