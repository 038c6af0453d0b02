"""Text primitives with the white-space rules of the data model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
#: Written by the page parser where a block or ``<br>`` ends a line.
BREAK = "\x1f"

_SPACES = "[" + WHITE_SPACE + "]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Strip, then one space for every run of white space."""
    return F.regexp_replace(strip(c), _SPACES, " ")


# The markup characters and their names, ampersand last.
ENTITIES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;|&#39;|&apos;", "'"), ("&amp;?", "&"))


def unescape_markup(c: Column) -> Column:
    """Decode the five markup characters; for native use where no parser is involved."""
    for pattern, char in ENTITIES:
        c = F.regexp_replace(c, pattern, char)
    return c


def or_blank(*cs: Column) -> Column:
    return F.coalesce(*cs, F.lit(""))


def cut_before(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(value: str) -> str:
    """``value`` as a SQL string literal."""
    out = []
    for ch in value:
        if ch in "\\'":
            out.append("\\" + ch)
        elif " " <= ch <= "~":
            out.append(ch)
        else:
            out.append(f"\\u{ord(ch):04X}")
    return "'" + "".join(out) + "'"


# SQL spellings of the functions above, for use inside lambdas.
def sql_strip(x: str) -> str:
    return f"btrim({x}, {sql_literal(WHITE_SPACE)})"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, {sql_literal(_SPACES)}, ' ')"


def sql_non_blank(x: str) -> str:
    return f"get(filter(array({x}), v -> v != ''), 0)"


def sql_text_content(x: str) -> str:
    return f"translate({x}, {sql_literal(BREAK)}, '')"
