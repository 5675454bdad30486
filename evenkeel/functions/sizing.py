"""How much is taken, and when: closed forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_POLICIES = ("quarter", "square", "one")
REFILL_RULES = ("sqrt", "third", "empty")


def split_size(n: Column, policy: str = "quarter", max_items: int | None = None) -> Column:
    """Items taken from the head of a queue of `n`.

    `quarter` takes while what is left is at least three times what was taken, `square` while it is
    at least the square of it; both stop one item past the solution of that inequality.
    """
    if policy == "quarter":
        size = F.call_function("div", n, F.lit(4)) + 1
    elif policy == "square":
        size = F.floor((F.sqrt(1 + 4 * n) - 1) / 2) + 1
    elif policy == "one":
        size = F.lit(1)
    else:
        raise ValueError(f"policy must be one of {SPLIT_POLICIES}: {policy!r}")
    if max_items is not None:
        size = F.least(F.lit(max_items), size)
    return F.when(n > 0, size).otherwise(0).cast("long")


def needs_refill(remaining: Column, batch_size: Column, pool_size: Column, rule: str = "sqrt") -> Column:
    """True where a queue is low against its last batch and the pool still has items."""
    if rule == "sqrt":
        low = remaining <= F.sqrt(batch_size)
    elif rule == "third":
        low = remaining <= F.call_function("div", batch_size, F.lit(3))
    elif rule == "empty":
        low = remaining == 0
    else:
        raise ValueError(f"rule must be one of {REFILL_RULES}: {rule!r}")
    return low & (pool_size > 0)
