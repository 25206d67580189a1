"""Scalar functions on names and texts, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FULL = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HIRAGANA, KATAKANA = ("".join(map(chr, range(a, a + 0x56))) for a in (0x3041, 0x30A1))


def first_text(*cols) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(F.col(c) if isinstance(c, str) else c) != "", c if isinstance(c, Column) else F.col(c)) for c in cols))


def half_width(c: Column) -> Column:
    """Full-width digits and letters to half-width, two look-alikes to the long-vowel mark, no blanks."""
    return F.regexp_replace(F.translate(c, FULL + "―ｰ", HALF + "ーー"), "[ 　\t]", "")


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def char_overlap_ratio(a: Column, b: Column) -> Column:
    """200 times the characters of a that b has, over both lengths, cut to an integer. Not symmetric; may pass 100."""
    both = F.size(F.filter(F.split(a, ""), lambda x: (x != "") & (F.instr(b, x) > 0)))
    return F.when(F.length(a) + F.length(b) > 0, F.floor(200 * both / (F.length(a) + F.length(b)))).otherwise(0).cast("long")


def partial_ratio(a: Column, b: Column) -> Column:
    return F.when(F.contains(b, a) | F.contains(a, b), F.lit(100).cast("long")).otherwise(char_overlap_ratio(a, b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    return char_overlap_ratio(order(a), order(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    return F.floor(100 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).cast("long")
