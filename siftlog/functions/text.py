"""Column expressions over message text and timestamps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity labels, scores and the words of each tier, strongest first.
SEVERITY_TIERS = (
    ("High", 3, ("fatal", "crash", "crashed", "panic", "exception", "timeout", "denied")),
    ("Medium", 2, ("error", "fail", "failed", "failure", "invalid", "unable", "not found")),
    ("Low", 1, ("warn", "warning")),
)
NO_SEVERITY = ("Normal", 0)

# Everything between white space, as Unicode and the four ASCII separators define it.
WORD = r"(?U)[^\s\x1c-\x1f]+"


def _tier_pattern(words: tuple[str, ...]) -> str:
    return r"(?U)\b(?:" + "|".join(words) + r")\b"


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    """A word of the tier as a whole word.

    The plain substring tests spare most messages the regular expression.
    """
    stems = [word for word in words if not any(other != word and other in word for other in words)]
    return reduce(or_, [F.contains(text, F.lit(stem)) for stem in stems]) & text.rlike(_tier_pattern(words))


def severity_score(message: Column) -> Column:
    """0 to 3 by the strongest tier with a whole-word match, ignoring case."""
    text = F.lower(message)
    result = F.lit(NO_SEVERITY[1])
    for _, score, words in reversed(SEVERITY_TIERS):
        result = F.when(_mentions(text, words), score).otherwise(result)
    return result


def severity_label(score: Column, below: str = NO_SEVERITY[0]) -> Column:
    """The label of a severity score; `below` is the label of score 0."""
    result = F.lit(below)
    for label, value, _ in reversed(SEVERITY_TIERS):
        result = F.when(score == value, label).otherwise(result)
    return result


def message_length(message: Column) -> Column:
    """Length in code points."""
    return F.length(message)


def word_count(message: Column) -> Column:
    """Number of non-empty tokens between white space."""
    return F.regexp_count(message, F.lit(WORD))


def seconds_of_minute(time: Column) -> Column:
    """Seconds with their fraction, as a double."""
    return F.extract(F.lit("SECOND"), time).cast("double")


def time_text(time: Column) -> Column:
    """`2024-01-31 08:00:00+00:00`, with six more digits where there is a fraction."""
    whole = F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    fraction = F.when(F.unix_micros(time) % 1_000_000 != 0, F.date_format(time, ".SSSSSS")).otherwise("")
    return F.coalesce(F.concat(whole, fraction, F.lit("+00:00")), F.lit("NaT"))


def quoted(text: Column) -> Column:
    """Text in quotes: single ones, or double ones around text that holds a single quote only."""
    escaped = text
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(single)
