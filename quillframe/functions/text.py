"""Column expressions over text: tokens, symbols, patterns and symbol classes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words.
SPACES = "[ \\t\\n\\r\\f]+"
#: The symbols of class 1 (ascenders and capitals), 2 (descenders) and 3 (short, near the baseline); all others are class 0.
TALL = '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZbdfhkl?![](){}@%$#/"^<>'
DEEP = "gjpqy"
LOW = ".,_"
FIRST, LAST = 32, 126


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def symbols(text: Column) -> Column:
    """The code points of a text, in order; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def printable(c: Column) -> Column:
    return F.ascii(c).between(FIRST, LAST)


def numerized(word: Column) -> Column:
    """Each symbol's rank by first occurrence: sassy becomes 1.2.1.1.3."""
    s = F.split(word, "")
    d = F.array_distinct(s)
    return F.array_join(F.transform(s, lambda c: F.array_position(d, c).cast("string")), ".")


def symbol_class(c: Column) -> Column:
    """1 tall, 2 deep, 3 low marks, 0 other."""
    return F.when(F.instr(F.lit(TALL), c) > 0, 1).when(F.instr(F.lit(DEEP), c) > 0, 2).when(F.instr(F.lit(LOW), c) > 0, 3).otherwise(0)


def offset_class(asc: Column, desc: Column) -> Column:
    """The class from a shape's offsets over x-height and under the baseline, in pixels."""
    return F.when(asc >= 5, 1).when(desc >= 5, 2).when(asc <= -5, 3).otherwise(0)
