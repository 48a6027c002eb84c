import pytest

from crossquery.sources.reduction import Strategy as S
from crossquery.sources.reduction import choose
from crossquery.sources.statistics import OPEN_END, distinct_values, fraction, page_ranges


@pytest.mark.parametrize(
    ("kind", "n", "options", "expected"),
    [
        ("postgres", 0, {}, S.NOTHING),
        ("postgres", 1, {}, S.IN_LIST),
        ("duckdb", 1999, {}, S.IN_LIST),
        ("duckdb", 1999, {"prerendered": True}, S.STAGED_KEYS),
        ("duckdb", 2000, {}, S.STAGED_KEYS),
        ("postgres", 2001, {}, S.STAGED_KEYS),
        ("parquet", 2000, {"in_process": True}, S.SEMI_JOIN),
        ("duckdb", 2_000_000, {}, S.STAGED_KEYS),
        ("duckdb", 2_000_001, {}, S.FULL_READ),
        ("duckdb", 3000, {"ingestible": False}, S.FULL_READ),
        ("postgres", 3000, {"indexed": False}, S.FULL_PARALLEL_READ),
        ("postgres", 3000, {"indexed": False, "structured": False}, S.STAGED_KEYS),
        ("postgres", 3000, {"fraction": 0.15}, S.STAGED_KEYS),
        ("postgres", 3000, {"fraction": 0.1501}, S.FULL_PARALLEL_READ),
        ("duckdb", 3000, {"fraction": 0.40}, S.STAGED_KEYS),
        ("duckdb", 3000, {"fraction": 0.41}, S.FULL_READ),
        ("duckdb", 3000, {"fraction": 0.9, "structured": False}, S.STAGED_KEYS),
    ],
)
def test_choice(kind, n, options, expected):
    assert choose(kind, n, **options) is expected


@pytest.mark.parametrize(("pages", "partitions"), [(1000, 4), (3, 8), (15, 8), (1, 1), (7, 7)])
def test_page_ranges_cover_once(pages, partitions):
    ranges = page_ranges(pages, partitions)
    assert len(ranges) == min(pages, partitions)
    assert ranges[0][0] == 0 and ranges[-1][1] == OPEN_END
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_unknown_page_count_is_one_range():
    assert page_ranges(0, 8) == [(0, OPEN_END)]


@pytest.mark.parametrize(
    ("rows", "n_distinct", "keys", "expected"),
    [(3e6, 1e5, 10_000, 0.1), (6e5, -0.2, 72_000, 0.6), (1000, 10, 1_000_000, 1.0), (1000, None, 100, None), (1000, 0, 100, None)],
)
def test_fraction(rows, n_distinct, keys, expected):
    found = fraction(keys, distinct_values(rows, n_distinct))
    assert found == expected if expected is None else abs(found - expected) < 1e-9
