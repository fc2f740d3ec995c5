"""A name's forms are taken of distinct texts, however often they come."""

from pyspark.sql import functions as F

from mergewell.functions import text
from mergewell.plans import profile


def _rows(spark, n):
    return spark.range(n).selectExpr("concat('Name ', id % 3) as name", "'b' as brand", "'c' as category", "id as record_index", "'s' as seller_name", "string(id) as seller_product_id")


def test_forms_are_taken_of_distinct_texts(spark, monkeypatch):
    rows, products = _rows(spark, 3000), _rows(spark, 2).withColumn("id", F.col("record_index"))
    calls = spark.sparkContext.accumulator(0)

    def key(c):
        @F.udf("string")
        def form(s):
            calls.add(1)
            return s.lower()

        return form(c)

    monkeypatch.setitem(text.LADDER, "alphanumeric", key)
    monkeypatch.setattr(text, "match_key", key)
    found = {r["level"]: (r["names"], r["products"]) for r in profile.match_funnel(rows, products).collect()}
    assert set(found.values()) == {(2000, 2000)}
    assert profile.drift(rows, products).count() == 0
    assert sorted(r["entries"] for r in profile.duplicate_names(rows).collect()) == [1000] * 3
    assert sorted(r["ids"] for r in profile.same_seller_product(rows).collect()) == [1000] * 3
    assert calls.value < 300
