"""Day/month formats and spreadsheet serial numbers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.casts import fixed_date, parse_float
from siftwell.functions.text import blank_to_null

# Fixed values.
EPOCHS = {"1900": "1899-12-30", "1904": "1904-01-01"}
SERIAL_MIN, SERIAL_MAX = 1, 60000
AMBIGUOUS_PAIRS = [
    ("%d/%m/%Y", "%m/%d/%Y"),
    ("%d/%m/%y", "%m/%d/%y"),
    ("%d-%m-%Y", "%m-%d-%Y"),
    ("%d-%m-%y", "%m-%d-%y"),
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
PARTS_RE = r"^[0-9]{1,4}[/\-.][0-9]{1,4}[/\-.][0-9]{1,4}$"
_ABOVE_12 = r"(?:0{0,2}(?:1[3-9]|[2-9][0-9])|0?[1-9][0-9]{2}|[1-9][0-9]{3})"
FIRST_ABOVE_12_RE = rf"^{_ABOVE_12}[/\-.][0-9]{{1,4}}[/\-.][0-9]{{1,4}}$"
SECOND_ABOVE_12_RE = rf"^[0-9]{{1,4}}[/\-.]{_ABOVE_12}[/\-.][0-9]{{1,4}}$"


def _either(words: list[str]) -> str:
    return "((?i:" + "|".join(words) + "))"


# What each directive of a date format accepts.
_DIRECTIVES = {
    "d": r"(3[01]|[12][0-9]|0?[1-9]| [1-9])", "m": r"(1[0-2]|0?[1-9])",
    "Y": r"([0-9]{4})", "y": r"([0-9]{2})",
    "H": r"(2[0-3]|[01]?[0-9])", "I": r"(1[0-2]|0?[1-9])", "M": r"([0-5]?[0-9])",
    "S": r"(6[01]|[0-5]?[0-9])", "f": r"([0-9]{1,6})", "p": _either(["am", "pm"]),
    "B": _either(MONTHS), "b": _either([m[:3] for m in MONTHS]),
    "A": _either(WEEKDAYS), "a": _either([w[:3] for w in WEEKDAYS]),
}


def format_pattern(fmt: str) -> tuple[str, dict[str, int]]:
    """(regular expression, directive -> group number) of a strptime format."""
    pattern, groups, i = "^", {}, 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            directive = fmt[i + 1]
            if directive == "%":
                pattern += "%"
            elif directive in _DIRECTIVES and directive not in groups:
                groups[directive] = len(groups) + 1
                pattern += _DIRECTIVES[directive]
            else:
                raise ValueError(f"unsupported date format {fmt}")
            i += 2
        elif fmt[i].isspace():
            pattern += r"\s+"
            while i < len(fmt) and fmt[i].isspace():
                i += 1
        else:
            pattern += re.escape(fmt[i])
            i += 1
    return pattern + "$", groups


def parse_with(text: Column, fmt: str) -> Column:
    """Date of an already stripped text, NULL when it does not follow the format."""
    pattern, groups = format_pattern(fmt)

    def part(directive: str) -> Column:
        return F.regexp_extract(text, pattern, groups[directive])

    if "Y" in groups:
        year = part("Y")
    elif "y" in groups:
        year = F.when(part("y") >= "69", F.concat(F.lit("19"), part("y"))).otherwise(F.concat(F.lit("20"), part("y")))
    else:
        year = F.lit("1900")
    if "m" in groups:
        month = part("m")
    elif "B" in groups or "b" in groups:
        names = F.array(*[F.lit(m[:3]) for m in MONTHS])
        month = F.array_position(names, F.lower(F.substring(part("B" if "B" in groups else "b"), 1, 3))).cast("string")
    else:
        month = F.lit("1")
    day = F.ltrim(part("d")) if "d" in groups else F.lit("1")
    if set(groups) == {"d", "m", "Y"}:
        iso = F.regexp_replace(text, pattern, f"${groups['Y']}-${groups['m']}-${groups['d']}")
        iso = F.replace(iso, F.lit(" "), F.lit(""))
    else:
        iso = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    odd = F.when(text.rlike(pattern), iso.try_cast("date"))
    layout = re.sub("%([dmY])", r"\1", fmt)
    if set(groups) == {"d", "m", "Y"} and not re.search(r"[dmY%\s]", re.sub("%[dmY]", "", fmt)):
        return F.coalesce(fixed_date(text, layout), odd)
    return odd


def serial_number(text: Column) -> Column:
    """Spreadsheet day number, NULL unless it is a number in the plausible range. No number has a slash, which is found without a pattern."""
    number = F.when(~F.contains(text, F.lit("/")) & ~text.rlike(PARTS_RE), parse_float(text))
    return F.when(number.between(SERIAL_MIN, SERIAL_MAX), number)


def serial_date(text: Column, epoch: str = "1900") -> Column:
    return F.date_add(F.lit(EPOCHS[epoch]).cast("date"), F.floor(serial_number(text)).cast("int"))


def parts_above_12(text: Column) -> tuple[Column, Column]:
    """Whether the first and the second part of a stripped day/month text are above 12.

    Where marks stand behind two and five characters, a part that is at most 12 is told by its two characters, without the pattern.
    """

    def mark(at: int) -> Column:
        return F.substring(text, at, 1).isin("/", "-", ".")

    first = F.when(mark(3) & (text < "13"), F.lit(False)).otherwise(text.rlike(FIRST_ABOVE_12_RE))
    second = F.when(mark(3) & mark(6) & (F.substring(text, 4, 2) < "13"), F.lit(False)).otherwise(text.rlike(SECOND_ABOVE_12_RE))
    return first, second


def ambiguous_pair(formats: list[str]) -> tuple[str, str] | None:
    """(day first, month first) when the two candidates differ in nothing else."""
    for pair in AMBIGUOUS_PAIRS:
        if len(formats) == 2 and set(pair) == set(formats):
            return pair
    return None


def parse_resolved(text: Column, resolution: Column, formats: list[str]) -> Column:
    """Date of a text in the (mode, format) its column's evidence settled."""
    epochs = [F.when((resolution["mode"] == "serial") & (resolution["format"] == e), serial_date(text, e)) for e in EPOCHS]
    parsed = [F.when((resolution["mode"] == "format") & (resolution["format"] == f), parse_with(text, f)) for f in formats]
    return F.coalesce(*parsed, *epochs)


def resolved_error(text: Column, parsed: Column, resolution: Column) -> Column:
    reason = (
        F.when(resolution["error"].isNotNull(), resolution["error"])
        .when(resolution["mode"] == "serial", F.concat(F.lit("not a plausible serial date: '"), text, F.lit("'")))
        .otherwise(F.concat(F.lit("time data '"), text, F.lit("' does not match format '"), resolution["format"], F.lit("'"))))
    return F.when(text.isNotNull() & parsed.isNull(), reason)
