import pytest
from pyspark.sql import functions as F

from riskweave.operators import evaluation
from riskweave.sources import ledger

ROWS = "note long, word string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_append_once(spark, tmp_path):
    place = str(tmp_path / "t")
    first = [(1, "a"), (1, "b"), (None, "n")]
    ledger.append_once(spark, place, spark.createDataFrame(first, ROWS), "note")
    ledger.append_once(spark, place, spark.createDataFrame([*first, (2, "c"), (2, "c")], ROWS), "note")
    ledger.append_once(spark, place, spark.createDataFrame(first, ROWS), "note")
    assert rows_of(ledger.read(spark, place, ROWS)) == sorted([*first, (2, "c"), (2, "c")], key=repr)
    assert [b.rows for b in ledger.batches(spark, place)] == [3, 2]


def test_a_part_that_dies_does_not_count(spark, tmp_path):
    """A failing task leaves files that the manifest does not name; the next call adds everything."""
    place = str(tmp_path / "t")
    good = spark.createDataFrame([(k, "w") for k in range(20)], ROWS).repartition(4)
    fail = F.udf(lambda w: 1 // 0, "string")
    with pytest.raises(Exception, match="division"):
        ledger.append_once(spark, place, good.withColumn("word", F.when(F.col("note") < 19, F.col("word")).otherwise(fail("word"))), "note")
    assert ledger.batches(spark, place) == [] and ledger.read(spark, place, ROWS).count() == 0
    ledger.append_once(spark, place, good, "note")
    assert ledger.read(spark, place, ROWS).count() == 20


def test_two_writers(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a")], ROWS)
    ledger.publish(spark, place, frame)
    monkeypatch.setattr(ledger, "batches", lambda *_: [])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        ledger.publish(spark, place, frame)


def test_vocabulary(spark, tmp_path):
    place = str(tmp_path / "v")
    names = lambda *x: spark.createDataFrame([("S", n) for n in x], "source string, feature string")
    assert rows_of(ledger.grow_vocabulary(spark, place, names("m", "b", "m"))) == [("S", "b", 0), ("S", "m", 1)]
    grown = rows_of(ledger.grow_vocabulary(spark, place, names("z", "a", "b")))
    assert grown == [("S", "a", 2), ("S", "b", 0), ("S", "m", 1), ("S", "z", 3)]
    assert rows_of(ledger.grow_vocabulary(spark, place, names("a"))) == grown


@pytest.mark.parametrize("parts", [1, 7])
def test_auroc_of_scores(spark, parts):
    rows = [("x", float(k * 7 % 5), float(k % 3 == 0)) for k in range(40)] + [("y", 1.0, 1.0), ("y", 2.0, 1.0), ("x", None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, score double, label double").repartition(parts)
    got = {r.g: r.auroc for r in evaluation.auroc(frame, by=("g",)).collect()}
    pairs = [(a, b) for g, a, l in rows if g == "x" and l and a is not None for h, b, m in rows if h == "x" and not m]
    assert got["x"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    assert got["y"] is None
