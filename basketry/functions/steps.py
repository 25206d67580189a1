"""Cleaning of texts as lists of steps, run as column expressions or written as SQL.

A step is (replace, old, new), (regex, pattern, new), (translate, from, to) or (trim,). Patterns keep to what the regular
expressions of the JVM and of RE2 have in common: no look-around, Unicode classes by name, blanks as BLANK.
"""

from __future__ import annotations

import re
from itertools import zip_longest

from pyspark.sql import Column, functions as F

#: Blanks as Unicode text has them: the ASCII ones and the ideographic one.
BLANK = r"[\s　]"
TRIM = ("regex", rf"^{BLANK}+|{BLANK}+$", "")


def replaced(words, new: str = "") -> list[tuple]:
    return [("replace", w, new) for w in words]


def run(c: Column, steps: list[tuple]) -> Column:
    for kind, *how in steps:
        if kind == "replace":
            c = F.replace(c, F.lit(how[0]), F.lit(how[1]))
        elif kind == "regex":
            c = F.regexp_replace(c, *how)
        else:
            c = F.translate(c, *how)
    return c


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(expr: str, steps: list[tuple]) -> str:
    for kind, *how in steps:
        a, b = map(quoted, how)
        expr = f"regexp_replace({expr}, {a}, {b}, 'g')" if kind == "regex" else f"{kind}({expr}, {a}, {b})"
    return expr


def text(s: str, steps: list[tuple]) -> str:
    """The steps on one string, for keys of small tables."""
    for kind, *how in steps:
        s = s.replace(*how) if kind == "replace" else re.sub(how[0], how[1], s) if kind == "regex" else s.translate(str.maketrans(dict(zip_longest(*how, fillvalue=None))))
    return s


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def any_of_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value of c, null if it has none."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def mapped_sql(expr: str, table: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"


def entries(table: dict[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in table.items()))


def first_contained(c: Column, table: dict[str, str], either: bool = False) -> Column:
    """The value of the table's first key that c contains (either: or that contains c), null if there is none."""
    fits = lambda e: F.contains(c, e.key) | (F.contains(e.key, c) if either else F.lit(False))
    return F.get(F.transform(F.filter(entries(table), fits), lambda e: e.value), 0)


def first_contained_sql(expr: str, table: dict[str, str], either: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN contains({expr}, {quoted(k)})" + f" OR contains({quoted(k)}, {expr})" * either + f" THEN {quoted(v)}" for k, v in table.items()) + " END"


def values_sql(name: str, columns: str, rows) -> str:
    """A table of constants for WITH."""
    say = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + f") AS v({columns}))"
