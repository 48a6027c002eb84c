"""What catalogues say about a table, as pure functions."""

from __future__ import annotations

OPEN_END = 2**32 - 1


def page_ranges(pages: int, partitions: int) -> list[tuple[int, int]]:
    """Half-open ranges of pages, at most ``partitions`` of them, that differ by a page at most.

    The last has an open end, so rows on pages added since the count was taken are read; an unknown
    count (0) gives one range.
    """
    n = max(1, min(partitions, pages))
    ends = [pages * k // n for k in range(n)]
    return list(zip(ends, [*ends[1:], OPEN_END], strict=True))


def distinct_values(rows: float | None, n_distinct: float | None) -> float | None:
    """Distinct values from a statistic that, if negative, is a fraction of the rows; None if unknown."""
    if not n_distinct or rows is None:
        return None
    return n_distinct if n_distinct > 0 else -n_distinct * rows


def fraction(n_keys: int, distinct: float | None) -> float | None:
    """Share of a table that a filter on so many keys keeps, 1 at most; None if unknown."""
    return min(1.0, n_keys / distinct) if distinct and distinct > 0 else None
