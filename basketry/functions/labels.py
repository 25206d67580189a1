"""What severities, sources, risks and priorities are called and shown as."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import steps as S
from .medicines import SEVERITY_CODES, SEVERITY_LABELS, SOURCE_LABELS

# Fixed values.
RISK_MARKS = {"critical": "🚨", "high": "⚠️", "medium": "⚡"}
PRIORITY_MARKS = {"critical": "🚨", "urgent": "🚨", "high": "⚠️", "medium": "📋", "low": "ℹ️"}
OTHER_LABEL, OTHER_RISK, OTHER_PRIORITY, NO_TARGETS = "⚠️ 併用注意", "⚠️", "ℹ️", "（対象薬の特定に失敗）"


def _or(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(S.mapped(c, table), F.lit(default))


def severity_label(c: Column) -> Column:
    return _or(c, SEVERITY_LABELS, OTHER_LABEL)


def severity_code(c: Column) -> Column:
    """The audit's code of a severity; one that it doesn't know stays as it is, null is empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(S.mapped(t, SEVERITY_CODES), t)


def source_label(c: Column) -> Column:
    """What is added for a finding's source: nothing for fixed rules and unknown sources."""
    return _or(c, SOURCE_LABELS, "")


def risk_mark(c: Column) -> Column:
    return _or(c, RISK_MARKS, OTHER_RISK)


def priority_mark(c: Column) -> Column:
    return _or(c, PRIORITY_MARKS, OTHER_PRIORITY)


def shown_targets(c: Column) -> Column:
    """An array of names as one text; null and empty ones have their own."""
    return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.trim(F.array_join(c, "、"))).otherwise(NO_TARGETS)
