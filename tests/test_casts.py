"""Column conversions against plain Python on awkward values."""

import datetime as dt
import math
import sys
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions.casts import cast_to, field_value
from siftwell.functions.dates import parse_with, serial_date, serial_number
from siftwell.functions.text import blank_to_null, fold_accents, identifier, strip

NUMBERS = ["12", " 12.9 ", "-12.9", "1e3", "1_000", "1__0", "_1", "1_", ".5", "5.", ".", "", "  ", None, "nan", "-NaN", "inf", "+Infinity", "-inf",
           "5d", "5f", "0x1p3", "1e", "e5", "+-1", "1.234,50", "1234.50", "1e400", "12345678901234567890", "abc", "1 2", "\xa07　", "infinit", "INF"]
TEXTS = NUMBERS + ["\t x \n", "a ", "\x1cx\x1f", "é ", "​x"]


def column(spark, values, *expressions):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in frame.select("i", *expressions).orderBy("i").collect()]


def python(function, value):
    try:
        return function(value), False
    except (ValueError, OverflowError):
        return None, True


def blank(v):
    return v is None or v.strip() == ""


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def check(spark, values, expression, function):
    value, error = expression
    for v, (got, message) in zip(values, column(spark, values, value, error)):
        want, failed = (None, False) if blank(v) else python(function, v.strip())
        assert same(got, want) and (message is not None) == failed, (v, got, message, want, failed)


def test_strip(spark):
    got = column(spark, TEXTS, strip(F.col("s")), blank_to_null(F.col("s")))
    for v, (stripped, filled) in zip(TEXTS, got):
        assert stripped == (None if v is None else v.strip()) and filled == (None if blank(v) else v.strip()), repr(v)


def test_double(spark):
    check(spark, NUMBERS, cast_to(F.col("s"), "double"), float)


def test_double_es(spark):
    check(spark, NUMBERS, cast_to(F.col("s"), "double", "es"), lambda v: float(v.replace(".", "").replace(",", ".")))


def test_integer(spark):
    def whole(v):
        n = int(float(v))
        if abs(n) >= 2**63:
            raise OverflowError
        return n

    check(spark, NUMBERS, cast_to(F.col("s"), "integer"), whole)


def test_boolean(spark):
    def words(v):
        if v.lower() in {"true", "1", "si", "sí", "yes", "verdadero"}:
            return True
        if v.lower() in {"false", "0", "no", "falso"}:
            return False
        raise ValueError

    check(spark, [" Sí ", "NO", "verdadero", "2", "", None, "Falso", "on"], cast_to(F.col("s"), "boolean"), words)


DATES = ["2026-08-05", "20260805", "2026-8-5", "2026-02-30", "2024-02-29", "2026-W01", "2026-W53-7", "2026W017", "2027-W53", "2026-W00", "2026-08-05T10:30",
         "2026-08-05 10:30:15.123456", "2026-08-05T10", "20260805T103015", "2026-08-05T10:30Z", "2026-08-05T10:30+02:00", "2026-08-05T25:00", "2026-0805",
         "05/08/2026", "2026", "2026-08", "", None, " 2026-08-05 ", "2026-08-05T", "hoy", "+026-01-01", "0001-01-01", "9999-12-31", "2026-08-05x10:30"]


def test_iso_date(spark):
    check(spark, DATES, cast_to(F.col("s"), "date"), lambda v: dt.datetime.fromisoformat(v).date())


FORMATS = ["%d/%m/%Y", "%m/%d/%Y", "%d-%m-%y", "%Y%m%d", "%d.%m.%Y %H:%M:%S", "%d %b %Y", "%Y-%m-%d"]
WRITTEN = ["05/08/2026", "5/8/2026", "31/02/2026", "13/01/2026", "01/13/2026", "01-02-69", "01-02-68", "1-2-99", "20260805", "2026085", "05.08.2026 10:30:15",
           "05 Aug 2026", "5 AUG 2026", "05  aug 2026", "2026-08-05", "26-08-05", "05/08/26", "05/ 8/2026", "29/02/2024", "00/01/2026", "12026-01-01", "", "x"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_formats(spark, fmt):
    got = column(spark, WRITTEN, parse_with(F.col("s"), fmt))
    for v, (value,) in zip(WRITTEN, got):
        want = python(lambda x: dt.datetime.strptime(x, fmt).date(), v)[0]
        assert value == want, (fmt, v, value, want)


def test_serials(spark):
    values = ["46101", "46101.99", "1", "60000", "60001", "0", "05/08/2026", "x", None]
    got = [r[0] for r in column(spark, values, serial_date(F.col("s")))]
    day = lambda n: dt.date(1899, 12, 30) + dt.timedelta(days=n)
    assert got == [dt.date(2026, 3, 20), dt.date(2026, 3, 20), day(1), day(60000), None, None, None, None, None]
    assert column(spark, ["46101"], serial_date(F.col("s"), "1904"))[0][0] == dt.date(1904, 1, 1) + dt.timedelta(days=46101)


def test_identifiers(spark):
    values = ["Año Nº 1", "AÑO", "A�O", "  Código (Cliente)  ", "2ª vuelta", "---", "", None, "ﬁn ½", "Ⅷ ㎏", "a__b", "Łódź"]
    got = [r[0] for r in column(spark, values, identifier(F.col("s"), F.col("i")))]
    assert got == ["ano_no_1", "ano", "ao", "codigo_cliente", "c_2a_vuelta", "columna_5", "columna_6", "columna_7", "fin_1_2", "viii_kg", "a_b", "odz"]


def test_every_character_is_folded(spark):
    def folded(char):
        if unicodedata.combining(char) or char == "\ufffd":
            return ""
        plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        return plain if any(x.isascii() and x.isalnum() for x in plain) else char

    chars = [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn")]
    values = ["a\x7f" + "z".join(chars[i:i + 100]) + "\U000f0000 b" for i in range(0, len(chars), 100)] + ["", None, "plain"]
    got = [r[0] for r in column(spark, values, fold_accents(F.col("s")))]
    assert got == [v and "".join(map(folded, v)) for v in values]


def test_folding_is_looked_up(spark):
    """Each label holds a ligature; 40,000 of them took 14 s in one task when every character was searched in the table."""
    labels = spark.range(0, 40000, 1, 1).select(F.concat(F.lit("¿Part: "), F.col("id").cast("string"), F.lit(" — with a long name, Size (é/Ñ)  ﬁ! ")).alias("s"))
    started = time.perf_counter()
    assert labels.agg(F.sum(F.length(fold_accents(F.col("s"))))).first()[0] > 0
    assert time.perf_counter() - started < 5


def test_field_values(spark):
    values = ["1,5", "12.9", "7", "si", "yes", "2026-08-05", "2026-08-05T10:00", " ", None]

    def read(kind):
        value, error = field_value(F.col("s"), kind)
        return [(v, e is not None) for v, e in column(spark, values, value, error)]

    assert [v for v, _ in read("double")] == [1.5, 12.9, 7.0, None, None, None, None, None, None]
    assert [v for v, _ in read("integer")] == [None, None, 7, None, None, None, None, None, None]
    assert [v for v, _ in read("boolean")][3:5] == [True, None]
    assert [v for v, _ in read("date")][5:7] == [dt.date(2026, 8, 5), None]
    assert read("timestamp")[6] == (dt.datetime(2026, 8, 5, 10), False)
    assert all(read(k)[7:] == [(None, False), (None, False)] for k in ("double", "integer", "date"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.eE+-_ndfiax, \t\xa0", max_size=8), min_size=20, max_size=60))
def test_number_spellings(spark, values):
    check(spark, values, cast_to(F.col("s"), "double"), float)


def test_strip_of_texts_that_are_nearly_plain(spark):
    ends = ["", " ", "  ", "\t", "\x00", "\x1f", "\x7f", "\xa0", "　", "é", "!", "~", " \t ", " \xa0"]
    texts = [a + b + c for a in ends for b in ["", "x", "a b", "é"] for c in ends]
    got = column(spark, texts, strip(F.col("s")), blank_to_null(F.col("s")))
    assert got == [(t.strip(), t.strip() or None) for t in texts]


def test_serial_numbers_have_no_slash(spark):
    texts = ["46101", "46101.5", "1/2", "13/01/2020", "4610/1", "/", "+5", "1e3", "nan", "inf", "-1", "60001", "4.1.2020", "1-2-3", "i", "Next"]
    got = {t: number for t, (number,) in zip(texts, column(spark, texts, serial_number(F.col("s"))))}
    assert {t: n for t, n in got.items() if n is not None} == {"46101": 46101.0, "46101.5": 46101.5, "+5": 5.0, "1e3": 1000.0}
