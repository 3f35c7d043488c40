"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once: inside lambdas a plain column expression is computed for each element."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, fold: Callable[[Column, Column], Column], block: int) -> Column:
    """For each number the fold, from 0, of those before it, as longs. Blocks are folded first, so n numbers take some n * block steps."""
    zero = F.lit(0).cast("long")
    total = lambda part, begin=zero: F.aggregate(part, begin, lambda a, x: fold(a, x.cast("long")))

    def of(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / block).cast("int"))
        part = lambda b: F.slice(x, b * block + 1, block)
        sums = F.transform(blocks, lambda b: total(part(b)))
        inside = lambda b, before: let(part(b), lambda p: F.transform(p, lambda _, i: total(F.slice(p, F.lit(1), i), before)))
        return let(sums, lambda s: F.flatten(F.transform(blocks, lambda b: let(total(F.slice(s, F.lit(1), b)), lambda before: inside(b, before)))))

    return let(numbers, of)


def running_sums(numbers: Column, block: int = 256) -> Column:
    """For each number the sum of those before it."""
    return _running(numbers, lambda a, x: a + x, block)


def running_max(numbers: Column, block: int = 256) -> Column:
    """For each number the largest of 0 and those before it."""
    return _running(numbers, F.greatest, block)


def cut_out(text: Column, block: int = 16_384) -> Callable[[Column, Column], Column]:
    """A function from code points a and b to what is between them. `text` is the array of blocks that `in_blocks` gives,
    so a cut reads the blocks it touches and not all that is before it."""

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int")
        inner = lambda k, start, end: F.substr(F.get(text, k), start.cast("int"), end.cast("int"))
        one = inner(first, a - first * block + 1, b - a)
        more = F.concat(inner(first, a - first * block + 1, F.lit(block)), F.array_join(F.slice(text, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), inner(last, F.lit(1), b - last * block))
        return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(more)

    return between


def in_blocks(text: Column, block: int = 16_384) -> Column:
    """A text as an array of its stretches of `block` code points."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda k: F.substr(text, k * block + 1, F.lit(block)))


def hash_windows(words: Column, width: int) -> Column:
    """Hash of each run of `width` elements, by start; empty with fewer. Elements are looked up where they stand, as a
    slice for each run would be a new array each time."""
    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(n >= width, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)
