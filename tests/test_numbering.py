"""Places and running totals against plain Python."""

import random

from pyspark.sql import functions as F

from reedbed.operators.numbering import running_totals


def test_running_totals(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k, draw.choice(["a", "b", None, "é"]), draw.choice([None, 0, 3, 10**12])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, word string, n long").repartition(7)
    out = running_totals(df, [F.col("word").asc_nulls_last(), F.col("id").desc()], f"{tmp_path}/a", {"place": None, "total": F.col("n")})
    want, total = {}, 0
    for place, (k, _, n) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[0]))):
        want[k] = (place, total)
        total += n or 0
    assert {r["id"]: (r["place"], r["total"]) for r in out.collect()} == want
    assert out.columns == ["id", "word", "n", "place", "total"]
    assert running_totals(df.limit(0), [F.col("id")], f"{tmp_path}/b", {"place": None}).count() == 0
