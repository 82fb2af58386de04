"""Expressions over a text's words that stay in the JVM and cost a few operations per word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, of) -> Column:
    """of(value), with value evaluated once however often `of` uses it."""
    return F.transform(F.array(value), of)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII spaces; null counts as an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, size: int) -> Column:
    """64-bit hash of each `size` neighbours of a bound array of hashes; empty where it has fewer.

    Windows of 1, 2, 4, ... are joined in pairs, so the work is in proportion to log(size).
    """

    def joined(a: Column, b: Column, offset: int) -> Column:
        """Hashes of a[i] and b[i + offset]. What runs over the end is cut off at last."""
        return F.zip_with(a, F.slice(b, F.lit(offset + 1), F.greatest(F.size(b), F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def step(power: Column, width: int, done: Column | None, covered: int) -> Column:
        if covered + width <= size and (size - covered) & width:
            done, covered = (power if done is None else joined(done, power, covered)), covered + width
        if covered == size:
            return F.slice(done, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
        return bound(joined(power, power, width), lambda p: step(p, 2 * width, done, covered))

    return step(hashes, 1, None, 0)
