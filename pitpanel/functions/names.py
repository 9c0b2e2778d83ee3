"""Name keys and person checks, evaluated inside the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Generational suffixes dropped from names.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


def _fold(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding as tables: characters that become one ASCII letter or digit, the
    characters they become (anything past the end is deleted), and the few that become several.

    Every other character ends as a space in a name key, folded or not.
    """
    single_from, single_to, gone, many = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            gone.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        out = _fold(ch)
        if out == "":
            gone.append(ch)
        elif len(out) == 1:
            if out.isascii() and out.isalnum():
                single_from.append(ch)
                single_to.append(out)
        elif any(c.isascii() and c.isalnum() for c in out):
            many[ch] = out
    return "".join(single_from + gone), "".join(single_to), many


def fold(text: Column) -> Column:
    """ASCII-leaning form of any text; plain ASCII passes untouched."""
    src, dst, many = fold_tables()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    # Whether a character is in the table is asked of a hash table first; a class of hundreds of characters, and the map, are walked through.
    lacks = lambda c: F.translate(c, "".join(many), "")
    spread = F.when(
        F.length(lacks(text)) < F.length(text),
        F.array_join(
            F.transform(F.split(text, ""), lambda c: F.when(lacks(c) == "", F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), ""
        ),
    ).otherwise(text)
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.translate(spread, src, dst))


# What a name keeps, and what counts as two words of a person's name.
NOT_NAME = "[^a-z0-9 ]+"
TWO_WORDS = r"[A-Za-z]{2,}\s+[A-Za-z]"


def normalize_name(name: Column) -> Column:
    """Key for matching names: no marks, case, punctuation or generational suffix; '' for null."""
    s = F.lower(fold(F.coalesce(name.cast("string"), F.lit(""))))
    s = F.regexp_replace(s, NOT_NAME, " ")
    s = F.regexp_replace(s, r"\b(" + "|".join(SUFFIXES) + r")\b", "")
    return F.trim(F.regexp_replace(s, " +", " "))


def person_like(name: Column) -> Column:
    """At least two words and not a short all-capitals code."""
    s = F.trim(F.coalesce(name, F.lit("")))
    code = (s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) <= 5)
    return (F.length(s) >= 4) & F.contains(s, F.lit(" ")) & ~code & s.rlike(TWO_WORDS)
