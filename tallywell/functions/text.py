"""Column expressions for id prefixes, composite keys and dotted node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word characters, as the mention pattern defines a word boundary.
WORD = "[0-9A-Za-z_]"
# An id body up to a word border. Possessive, so that neither length nor depth costs stack or time.
ID_BODY = rf"[0-9a-z]++(?!{WORD})(?:\.[0-9]++(?!{WORD}))*+"


def id_prefix(c: Column) -> Column:
    """Text before the first ``-``, or ``''`` when there is none."""
    return F.when(F.instr(c, "-") > 0, F.substring_index(c, "-", 1)).otherwise(F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def composite_key(*cols: Column) -> Column:
    """``a|b|...``; NULL when any part is NULL."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit("|"), c.cast("string")]
    return F.concat(*parts[1:])


def first_segment(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)
