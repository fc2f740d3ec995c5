import numpy as np
import pytest

from mergewell.plans import calibrate

AT = {"low": 0.0, "some": 0.01, "tail": 0.05, "half": 0.5, "most": 0.95, "top": 1.0}
ODD = [0.0, -0.0, 1e-45, -1e-45, 1.0, -1.0, 3.4e38, -3.4e38, float("inf"), float("-inf")]


@pytest.mark.parametrize("case", ["spread", "equal", "close", "odd", "one", "none", "nulls"])
def test_quantiles_are_those_of_the_sorted_scores(spark, case):
    draw = np.random.default_rng(3)
    scores = {
        "spread": draw.uniform(-1, 1, 3000), "equal": np.full(3000, 0.25), "close": np.nextafter(np.float32(0.5), np.float32(1)) * np.ones(999),
        "odd": np.array(ODD), "one": np.array([-0.75]), "none": np.array([]), "nulls": draw.choice([0.1, -0.2, 0.3], 500),
    }[case].astype(np.float32).tolist()
    if case == "close":
        scores += [0.5, float(np.nextafter(np.float32(0.5), np.float32(0)))] * 500
    rows = [(s,) for s in scores] + [(None,)] * (7 if case == "nulls" else 0)
    row = calibrate.quantiles(spark.createDataFrame(rows, "score float"), AT).first()
    n, ordered = len(scores), sorted(scores)
    assert row["n"] == n
    assert [row[name] for name in AT] == [ordered[min(n - 1, int(p * n))] if n else None for p in AT.values()]


def test_missed_matches_need_no_search(spark, monkeypatch):
    from mergewell import queries

    def searched(*_):
        raise AssertionError("all pairs are searched")

    monkeypatch.setattr(queries.search, "leave_one_out", searched)
    assert queries.threshold_missed(spark, "/root/testdata/sf0.001").count() > 0
