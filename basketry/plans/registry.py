"""Where queries and the SQL that must give the same rows are put."""

from __future__ import annotations

from ..sources.tables import MENTIONS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_mentions: bool = True):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH {MENTIONS_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if with_mentions else sql
        return fn

    return put
