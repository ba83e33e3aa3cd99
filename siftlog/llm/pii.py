"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

All of it is Spark expressions. A pattern cuts the text into what it matches and
what lies between; the running sum of both lengths gives the places. The patterns
never go back over what they have taken, so that their cost grows with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bound, ready, running_sums

# Code points before a span in which words are looked for, and the least score of a span that a pattern alone doesn't make sure.
CONTEXT_CHARS, LEAST_SCORE = 40, 0.5


@dataclass(frozen=True)
class Kind:
    """What finds a kind of data. `sure` kinds stay whatever their score."""

    name: str
    pattern: str
    sure: bool
    score: float
    checked_score: float
    context: str


# The kinds and their patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\"'][A-Za-z0-9+/_.=-]{16,}+[\"']"
KINDS = (
    Kind("email", EMAIL, True, 0.9, 0.9, r"(?i)\b(?:mail|e-mail|email|contact|write|kontakt|correo|courriel)\b"),
    Kind("ip", IP, True, 0.6, 0.6, r"(?i)\b(?:ip|host|server|address|adresse|direcci[oó]n)\b"),
    Kind("card", CARD, True, 0.3, 0.8, r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)\b"),
    Kind("phone", PHONE, True, 0.6, 0.6, r"(?i)\b(?:phone|call|tel|mobile|fax|telefon|tel[eé]fono)\b"),
    Kind("iban", IBAN, False, 0.4, 0.9, r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    Kind("secret", SECRET, False, 0.7, 0.7, r"(?i)\b(?:key|login|auth|credential)\b"),
)
BASE = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: `start`, `end` (exclusive) in code points, `found`, and the CONTEXT_CHARS `before` it.

    The text before a match reaches back to the match before the last one at most.
    """

    def spans(parts: Column) -> Column:
        found, gaps = parts["found"], F.slice(parts["gaps"], F.lit(1), F.size(parts["found"]))
        ends = running_sums(F.zip_with(gaps, found, lambda gap, word: F.length(gap) + F.length(word)))
        tails = F.zip_with(gaps, found, lambda gap, word: F.right(F.concat(F.right(gap, F.lit(CONTEXT_CHARS)), word), F.lit(CONTEXT_CHARS)))
        earlier = F.concat(F.array(F.lit("")), F.slice(tails, F.lit(1), F.greatest(F.size(tails) - 1, F.lit(0))))
        before = F.zip_with(earlier, gaps, lambda tail, gap: F.right(F.concat(tail, F.right(gap, F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS)))
        ended = F.zip_with(found, ends, lambda word, end: F.struct((end - F.length(word)).alias("start"), end.alias("end"), word.alias("found")))
        return F.zip_with(ended, before, lambda span, context: F.struct(span["start"].alias("start"), span["end"].alias("end"), span["found"].alias("found"), context.alias("before")))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
    return bound(parts, lambda both: F.when(F.size(both["found"]) > 0, spans(both)).otherwise(empty))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))

    def value(place: Column) -> Column:
        digit = F.substring(F.reverse(number), place, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (F.length(number) > 0) & (F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0)


def mod_97(found: Column) -> Column:
    """Whether an account number, its first four moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        letter = F.ascii(char) - 55
        return F.when(letter >= 10, rest * 100 + letter).otherwise(rest * 10 + F.ascii(char) - 48) % 97

    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(step(rest, char))) == 1)


def allowed(kind: str, found: Column) -> Column:
    """What a match must have to count at all."""
    number = digits(found)
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.lit(True)


def checked(kind: str, found: Column) -> Column:
    """Whether the checksum of its kind confirms a match; false for kinds without one."""
    return F.lit(True) if kind == "card" else mod_97(found) if kind == "iban" else F.lit(False)


def kind_spans(text: Column, kind: Kind) -> Column:
    """The spans of one kind with their scores, in order."""

    def scored(span: Column) -> Column:
        nearby = F.when(span["before"].rlike(kind.context), 0.2).otherwise(0.0)
        score = F.when(checked(kind.name, span["found"]), kind.checked_score).otherwise(kind.score) + nearby
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    found = F.filter(matches(text, kind.pattern), lambda span: allowed(kind.name, span["found"]))
    out = F.transform(found, scored)
    return out if kind.sure else F.filter(out, lambda span: span["score"] >= LEAST_SCORE)


def find(docs: DataFrame) -> DataFrame:
    """All columns of `docs` in a struct `_row`, and `_spans`: an array of kind, start, end and score.

    Spans are sorted by kind in the order of KINDS, then by start; places are code
    points, the end is exclusive. Email, ip, card and phone follow fixed rules and
    always stay, words nearby raise their score only; account numbers need their checksum
    or, without it, a word nearby that lifts them to LEAST_SCORE, and secrets their label. A null text has none, an empty table
    gives an empty one; every row gets its own result, so repeated rows repeat it.
    """
    ready(docs.sparkSession)
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    spans = F.concat(*[kind_spans(F.col("_text"), kind) for kind in KINDS])
    return whole.select("_row", spans.alias("_spans"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda span: span["kind"] == kind)).cast("long")


def joined_spans(kinds: tuple[str, ...] | None = None) -> Column:
    spans = F.col("_spans") if kinds is None else F.filter("_spans", lambda span: span["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ",")


def joined_scores() -> Column:
    """The score of each span, as a percentage."""
    return F.array_join(F.transform("_spans", lambda span: F.round(span["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of the text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    found = find(docs)
    ordered = F.array_sort("_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("_row.text")

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        longer = F.struct(span["end"].alias("at"), F.concat(state["out"], gap, F.lit("<"), span["kind"], F.lit(">")).alias("out"))
        return F.when(span["start"] >= state["at"], longer).otherwise(state)

    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select(*[(folded if name == "text" else F.col("_row")[name]).alias(name) for name in docs.columns])
