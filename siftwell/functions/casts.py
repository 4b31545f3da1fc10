"""Text to typed values. Every function returns (value, error): error is NULL when all is well.

Blank input gives a NULL value and no error. Nothing here raises, also with ANSI mode on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import blank_to_null

# Accepted spellings.
TRUE_WORDS = ["true", "1", "si", "sí", "yes", "verdadero"]
FALSE_WORDS = ["false", "0", "no", "falso"]
TRUE_WORDS_FIELD = ["true", "si", "sí", "1"]
FALSE_WORDS_FIELD = ["false", "no", "0"]

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
INTEGER_RE = rf"^[+-]?{_DIGITS}$"
FINITE_RE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NAN_RE = r"^[+-]?(?i:nan)$"
FIRST_RE = "^[-+.0-9iInN]"
INFINITE_RE = r"^[+-]?(?i:inf|infinity)$"

Checked = tuple[Column, Column]


def quoted(message: str, text: Column) -> Column:
    return F.concat(F.lit(message + " '"), text, F.lit("'"))


def _failed(text: Column, value: Column, message: Column) -> Column:
    return F.when(text.isNotNull() & value.isNull(), message)


def spanish_number(text: Column) -> Column:
    """Thousands dots dropped, decimal comma to dot. '1234.50' hence becomes 123450."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def parse_float(text: Column) -> Column:
    """NULL where the text is not a number; signs, exponents, digit underscores, nan and inf count.

    Plain numbers take the built-in cast. Its type suffixes (5d) and hexadecimal forms are no
    numbers here; those and whatever it cannot read are judged by pattern, a path only odd values take.
    A text whose first character begins no number is not even that.
    """
    suffixed = F.substring(text, -1, 1).isin("d", "D", "f", "F") | F.contains(text, F.lit("x")) | F.contains(text, F.lit("X"))
    # '+' to '9' in byte order: a text that starts otherwise would cost the cast an exception.
    digits = (text >= "+") & (text < ":")
    odd = (
        F.when(~text.rlike(FIRST_RE), F.lit(None).cast("double"))
        .when(text.rlike(FINITE_RE), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(NAN_RE), F.lit(float("nan")))
        .when(text.rlike(INFINITE_RE), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))
    return F.coalesce(F.when(digits & ~suffixed, text.try_cast("double")), odd)


def cast_text(c: Column, target: str, number_format: str = "en") -> Column:
    """First step of a cast: the stripped text, NULL when blank."""
    text = blank_to_null(c)
    return spanish_number(text) if number_format == "es" and target in ("integer", "double") else text


def cast_parse(text: Column, target: str) -> Column:
    """Second step: the text read as the target's kind, NULL when it cannot be."""
    if target in ("integer", "double"):
        return parse_float(text)
    if target == "boolean":
        return _words(text, TRUE_WORDS, FALSE_WORDS)
    return iso_date(text) if target == "date" else text


def cast_finish(text: Column, parsed: Column, target: str) -> Checked:
    """Last step: value and error. Integers truncate toward zero, so '12.9' is 12 and '1e3' is 1000."""
    if target == "varchar":
        return text, F.lit(None).cast("string")
    if target == "boolean":
        return parsed, _failed(text, parsed, quoted("not a boolean:", text))
    if target == "date":
        return parsed, _failed(text, parsed, quoted("Invalid isoformat string:", text))
    not_a_number = quoted("could not convert string to float:", text)
    if target == "double":
        return parsed, _failed(text, parsed, not_a_number)
    value = F.when(~F.isnan(parsed), parsed.try_cast("bigint"))
    reason = (
        F.when(parsed.isNull(), not_a_number)
        .when(F.isnan(parsed), F.lit("cannot convert float NaN to integer"))
        .otherwise(quoted("integer out of range:", text)))
    return value, _failed(text, value, reason)


def cast_to(c: Column, target: str, number_format: str = "en") -> Checked:
    """The three steps in one go, for a single column."""
    text = cast_text(c, target, number_format)
    return cast_finish(text, cast_parse(text, target), target)


def _words(text: Column, true_words: list[str], false_words: list[str]) -> Column:
    word = F.lower(text)
    return F.when(word.isin(true_words), F.lit(True)).when(word.isin(false_words), F.lit(False))


def fixed_date(text: Column, layout: str) -> Column:
    """Date of a zero-padded layout such as 'd/m/Y', cut by position; NULL for any other text.

    The common spelling needs no pattern this way. A part that is not digits fails the cast.
    """
    at, parts, here = 1, {}, F.lit(True)
    for mark in layout:
        if mark in "dmY":
            width = 4 if mark == "Y" else 2
            parts[mark] = F.substring(text, at, width)
            at += width
        else:
            here = here & (F.substring(text, at, 1) == mark)
            at += 1
    iso = F.concat(parts["Y"], F.lit("-"), parts["m"], F.lit("-"), parts["d"])
    return F.when((F.length(text) == at - 1) & here, iso.try_cast("date"))


_WEEK_RE = r"^([0-9]{4})-?W(0[1-9]|[1-4][0-9]|5[0-3])(?:-?([1-7]))?"
_DATE_RE = r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
_OFFSET = r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?)?"
_CLOCK = r"(?:[01][0-9]|2[0-3])(?::[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?|[0-5][0-9](?:[0-5][0-9](?:[.,][0-9]+)?)?)?"
_TIME_TAIL = rf"(?:.{_CLOCK}{_OFFSET})?$"


def iso_date(text: Column) -> Column:
    """Calendar or ISO week date, extended or compact, with an optional time that is dropped."""
    parts = F.regexp_replace(F.regexp_extract(text, _DATE_RE, 0), _DATE_RE, "$1-$3-$4")
    calendar = parts.try_cast("date")

    year = F.regexp_extract(text, _WEEK_RE, 1).try_cast("int")
    week = F.regexp_extract(text, _WEEK_RE, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, _WEEK_RE, 3).try_cast("int"), F.lit(1))
    fourth = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")
    monday = F.date_sub(fourth, F.weekday(fourth))
    by_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    by_week = F.when(F.weekofyear(by_week) == week, by_week)

    odd = F.when(text.rlike(_DATE_RE + _TIME_TAIL), calendar).when(text.rlike(_WEEK_RE + _TIME_TAIL), by_week)
    return F.coalesce(fixed_date(text, "Y-m-d"), fixed_date(text, "Ymd"), odd)


_TIMESTAMP_RE = _DATE_RE + _TIME_TAIL


def field_value(c: Column, kind: str) -> Checked:
    """Conversion of a hand-written field by catalogue type; narrower than `cast_to`."""
    text = blank_to_null(c)
    if kind in ("varchar", "uuid"):
        return text, F.lit(None).cast("string")
    if kind == "integer":
        value = F.when(text.rlike(INTEGER_RE), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    elif kind == "double":
        value = parse_float(F.replace(text, F.lit(","), F.lit(".")))
    elif kind == "boolean":
        value = _words(text, TRUE_WORDS_FIELD, FALSE_WORDS_FIELD)
    elif kind == "date":
        value = F.when(text.rlike(_DATE_RE + "$") | text.rlike(_WEEK_RE + "$"), iso_date(text))
    elif kind == "timestamp":
        value = F.when(text.rlike(_TIMESTAMP_RE), F.coalesce(
            text.try_cast("timestamp_ntz"), iso_date(text).cast("timestamp_ntz")))
    else:
        raise ValueError(f"unknown field type {kind}")
    return value, _failed(text, value, F.concat(F.lit("not a valid " + kind + ": '"), text, F.lit("'")))


# Type names a catalogue may use and the Spark type each one is stored as.
FIELD_TYPES = {
    "uuid": "string", "varchar": "string", "integer": "bigint", "double": "double",
    "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz",
}
