"""Property tests: the record rules (R1, R6-R8, R12) as Column expressions
agree with a plain-Python statement of the same rules on random rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from terrastat.functions import records as R

month = st.one_of(st.none(), st.integers(min_value=0, max_value=40))
row = st.tuples(st.lists(month, min_size=12, max_size=12),
                st.one_of(st.none(), st.integers(min_value=0, max_value=2_000_000)),
                st.floats(min_value=0, max_value=200, allow_nan=False))


def settlement(pop):
    if pop is None:
        return "Megalópolis"          # comparisons with a missing value are false
    return "Rural" if pop < 15000 else ("Urbano" if pop <= 250000 else "Megalópolis")


def peak(months):
    present = [(m, i + 1) for i, m in enumerate(months) if m is not None]
    if not present:
        return None
    best = max(m for m, _ in present)
    return min(i for m, i in present if m == best)


def trend(months):
    if any(m is None for m in months):
        return R.TREND_LABELS[3]
    s1, s2 = sum(months[:6]), sum(months[6:])
    return R.TREND_LABELS[0] if s2 > s1 else (R.TREND_LABELS[1] if s1 > s2 else R.TREND_LABELS[2])


def pattern(months):
    if all(m is None for m in months):
        return R.PATTERN_LABELS[4]
    n = sum(1 for m in months if m is not None and m > 0)
    if n >= 10:
        return R.PATTERN_LABELS[0]
    if n >= 4:
        return R.PATTERN_LABELS[1]
    return R.PATTERN_LABELS[2] if n >= 1 else R.PATTERN_LABELS[3]


def risk(rate):
    return "Alto" if rate >= 50 else ("Medio" if rate >= 20 else "Bajo")


@settings(max_examples=6, deadline=None)
@given(st.lists(row, min_size=1, max_size=80))
def test_record_rules_match_spec(spark, rows):
    ddl = ", ".join(f"m{i:02d} bigint" for i in range(1, 13)) + ", population bigint, rate_100k double"
    df = spark.createDataFrame([tuple(m) + (p, r) for m, p, r in rows], ddl)
    got = df.select(R.settlement_class().alias("s"), R.peak_month().alias("p"),
                    R.half_year_trend().alias("t"), R.occurrence_pattern().alias("o"),
                    R.risk_level().alias("k")).collect()
    for (m, p, r), g in zip(rows, got):
        assert (g.s, g.p, g.t, g.o, g.k) == (settlement(p), peak(m), trend(m), pattern(m), risk(r))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=6), min_size=1, max_size=300),
       st.integers(min_value=1, max_value=60))
def test_prefix_sum_and_rank_match_sort(spark, vals, rows_per_range):
    from terrastat.operators.scan import global_prefix
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k bigint, v bigint")
    out = global_prefix(df, [("v", False), ("k", True)], "v", rows_per_range=rows_per_range)
    got = {r.k: (r.rank, r.cum) for r in out.collect()}
    cum = 0
    for rank, (k, v) in enumerate(sorted(enumerate(vals), key=lambda kv: (-kv[1], kv[0])), start=1):
        cum += v
        assert got[k] == (rank, cum)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=200),
       st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_rank_quantiles_match_pandas(spark, xs, qs):
    import pandas as pd
    import pytest
    from terrastat.operators.scan import rank_quantiles
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k bigint, v double")
    got = spark.range(1).select(rank_quantiles(df, "v", qs, "k", rows_per_range=37).alias("q")).first().q
    want = [pd.Series(xs).quantile(q) for q in qs]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=1, max_value=3),
       st.lists(st.lists(st.integers(min_value=0, max_value=12), min_size=3, max_size=3),
                min_size=5, max_size=120),
       st.sampled_from([0.1, 0.25, 0.3, 0.5]), st.integers(min_value=2, max_value=8))
def test_dbscan_matches_bruteforce_on_lattice(spark, d, cells, eps, min_samples):
    """Lattice points (spacing 0.1): duplicates, dense cells and distances
    exactly at eps, against the row-order expansion."""
    import numpy as np
    from tests.test_ml import brute_dbscan
    from terrastat.operators import dbscan as DB
    X = np.array([[c * 0.1 for c in p[:d]] for p in cells])
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *[float(v) for v in x]) for i, x in enumerate(X)],
                               "k bigint, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: r.label for r in DB.dbscan_labels(df, "k", cols, eps, min_samples).collect()}
    assert [got[i] for i in range(len(X))] == list(brute_dbscan(X, eps, min_samples))
