"""Text expressions. All of them are built-in columns evaluated inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind; an empty text stays empty.

    An ASCII text that begins and ends with a printed character once its blanks are gone needs no search in a list of characters.
    """
    bare = F.trim(c)
    done = (bare > " ") & (F.substring(bare, -1, 1) > " ") & (F.octet_length(bare) == F.char_length(bare))
    return F.when(done, bare).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_blank(c: Column) -> Column:
    """NULL, empty or whitespace only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def match_key(c: Column) -> Column:
    """Form in which labels and values are compared."""
    return F.lower(strip(c))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Accent folding derived from the Unicode tables: (from, to, removed, expansions)."""
    source, target, removed, expansions = [], [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) in ("Cs", "Co", "Cn"):
            continue
        if unicodedata.combining(char):
            removed.append(char)
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        if folded == char or not any(x.isascii() and x.isalnum() for x in folded):
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions[char] = folded
    removed.append("\ufffd")
    return "".join(source), "".join(target), "".join(removed), expansions


SLOTS = 0xF0000  # private characters that number the expanded ones


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without the combining marks, for text outside ASCII only.

    Both tables are looked up by hash: an expanded character is translated to a private one, whose code is the place of
    its expansion. Runs of ASCII are one element of the looked-up array.
    """
    source, target, removed, expansions = _fold_tables()
    rare = "".join(expansions)
    slots = "".join(chr(SLOTS + i) for i in range(len(expansions)))
    folds = F.split(F.lit("\n".join(expansions.values())), "\n")

    def expand(x: Column) -> Column:
        slot = F.translate(x, rare, slots)
        return F.when(slot == x, x).otherwise(F.get(folds, F.ascii(slot) - SLOTS))

    pieces = F.regexp_extract_all(c, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0))
    wide = F.concat_ws("", F.transform(pieces, lambda x: F.when(x <= "\x7f", x).otherwise(expand(x))))
    expanded = F.when(F.translate(c, rare, "") != c, wide).otherwise(c)
    folded = F.translate(expanded, source + removed, target)
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


def identifier(name: Column, position: Column) -> Column:
    """Column name usable in SQL: folded, lower case, words joined by underscores."""
    words = F.regexp_replace(fold_accents(F.coalesce(name, F.lit(""))), "[^0-9a-zA-Z]+", "_")
    text = F.lower(F.btrim(words, F.lit("_")))
    return (
        F.when(text == "", F.concat(F.lit("columna_"), position.cast("string")))
        .when(text.rlike("^[0-9]"), F.concat(F.lit("c_"), text))
        .otherwise(text)
    )
