"""How a probe read is reduced by the keys of a side that was read before.

``choose`` is a pure function of what is known. Whatever it says, the caller applies the exact
semi-join afterwards, so the strategy changes what a source sends, never the result.
"""

from __future__ import annotations

from enum import Enum

#: The sizes and fractions at which the strategies change.
IN_LIST_KEYS = 2000
STAGED_KEYS = 2_000_000
MOST_OF_TABLE = {"postgres": 0.15}
MOST_OF_OTHER_TABLES = 0.40


class Strategy(Enum):
    NOTHING = "no keys: no rows"
    IN_LIST = "the keys as a list in the source's filter"
    SEMI_JOIN = "an in-process source: semi-join, no list"
    FULL_READ = "the whole table, then semi-join"
    FULL_PARALLEL_READ = "the whole table in parallel, then semi-join"
    STAGED_KEYS = "the keys staged at the source, which joins"


def choose(
    kind: str,
    n_keys: int,
    *,
    structured: bool = True,
    prerendered: bool = False,
    in_process: bool = False,
    ingestible: bool = True,
    indexed: bool = True,
    fraction: float | None = None,
) -> Strategy:
    """The first that applies; an unknown fraction (None) counts as small."""
    parallel = Strategy.FULL_PARALLEL_READ if kind == "postgres" else Strategy.FULL_READ
    most = MOST_OF_TABLE.get(kind, MOST_OF_OTHER_TABLES)
    rules = [
        (n_keys == 0, Strategy.NOTHING),
        (n_keys < IN_LIST_KEYS and not prerendered, Strategy.IN_LIST),
        (in_process, Strategy.SEMI_JOIN),
        (kind == "duckdb" and (n_keys > STAGED_KEYS or not ingestible), Strategy.FULL_READ),
        (kind == "postgres" and structured and not indexed, parallel),
        (structured and fraction is not None and fraction > most, parallel),
    ]
    return next((strategy for applies, strategy in rules if applies), Strategy.STAGED_KEYS)
