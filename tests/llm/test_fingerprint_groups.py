"""Coordinates of fingerprints are computed in small groups, whatever their number."""

from mergewell.llm import fingerprints


def _words(spark):
    return spark.createDataFrame([(1, "a b b c", "a b"), (2, "x y z", "")], "id long, text string, other string")


def test_an_aggregate_computes_a_group_of_coordinates(spark):
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        out = fingerprints.sample_words(_words(spark), ["id"], {"f": "text", "g": "other"}, 48)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)
    keys = [line.count("min(") for line in plan.splitlines() if "Aggregate" in line]
    assert 0 < max(keys) <= 8


def test_fewer_coordinates_are_the_first_ones(spark):
    found = {}
    for n in (6, 7, 48):
        rows = fingerprints.sample_words(_words(spark), ["id"], {"f": "text", "g": "other"}, n).collect()
        found[n] = {r["id"]: (r["f"], r["g"]) for r in rows}
    assert found[48][2][1] == ""
    for n in (6, 7):
        assert len(found[n][1][0]) == n * fingerprints.HEX
        assert found[n] == {k: tuple(f[: n * fingerprints.HEX] for f in fs) for k, fs in found[48].items()}
