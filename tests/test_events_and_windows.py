import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.operators import events as ev
from riskweave.operators import runtime, windows
from riskweave.operators.words import note_word_counts
from riskweave.plans import catalog, pipelines
from riskweave.sources import star

END = datetime.date(2010, 1, 1)


def day(shift):
    return END + datetime.timedelta(days=shift)


def test_bounds(spark):
    days = [day(s) for s in (0, -1, -1999, -2000, 1, -2001)]
    events = spark.createDataFrame([("p", "c", d) for d in days], "subject_id string, code string, event_date date")
    spans = spark.createDataFrame([("p", day(-2000), END)], "subject_id string, start_date date, end_date date")

    def kept(closed):
        return {r["event_date"] for r in windows.in_window(events, spans, closed).collect()}

    assert kept("neither") == {day(-1), day(-1999)}
    assert kept("left") == {day(-1), day(-1999), day(-2000)}
    assert kept("right") == {day(-1), day(-1999), END}
    assert kept("both") == {day(-1), day(-1999), day(-2000), END}
    with pytest.raises(ValueError):
        kept("open")


def two_kinds(spark):
    admissions = spark.createDataFrame(
        [
            ("dead", END, "1"),
            ("alive", None, "0"),
            ("both", None, "0"),
            ("both", END, "1"),
        ],
        "subject_id string, deathtime date, hospital_expire_flag string",
    )
    events = spark.createDataFrame(
        [(who, "DIAG", "DIAG1", 1.0, day(s)) for who in ("dead", "alive", "both", "unknown") for s in (-5, -100)],
        "subject_id string, source string, code string, value double, event_date date",
    )
    return admissions, events


def spans_of(frame):
    return sorted((r["subject_id"], r["start_date"], r["end_date"]) for r in frame.collect())


def test_policies(spark):
    admissions, events = two_kinds(spark)
    death = [(who, day(-2030), day(-30)) for who in ("both", "dead")]
    last = lambda *who: [(w, day(-2005), day(-5)) for w in who]
    got = lambda policy: spans_of(windows.observation_windows(admissions, events, policy))
    assert got("disjoint") == sorted(death + last("alive", "unknown"))
    assert got("survivor_rows") == sorted(death + last("alive", "both"))
    assert got("all_entities") == sorted(death + last("alive", "both", "dead", "unknown"))
    with pytest.raises(ValueError):
        got("none")


def test_lengths(spark):
    admissions, events = two_kinds(spark)
    spans = windows.observation_windows(
        admissions, events, lead_days=10, length_days=100, survivor_lead_days=7
    )
    assert set(spans_of(spans)) == {
        ("both", day(-110), day(-10)),
        ("dead", day(-110), day(-10)),
        ("alive", day(-112), day(-12)),
        ("unknown", day(-112), day(-12)),
    }


def test_events_without_day_or_window(spark):
    admissions, events = two_kinds(spark)
    undated = events.limit(1).withColumn("event_date", F.lit(None).cast("date"))
    stranger = events.limit(1).withColumn("subject_id", F.lit("nobody"))
    spans = windows.observation_windows(admissions, events, "disjoint")
    assert windows.in_window(undated, spans).count() == 0
    assert windows.in_window(stranger, spans).count() == 0


def test_hot_entity_is_cut_and_nothing_is_lost(spark):
    """A third of the events and of the windows' matches belong to one entity."""
    random.seed(1)
    rows = [("hot", f"c{random.randrange(3)}", day(-random.randrange(1, 40))) for _ in range(2000)]
    rows += [(f"p{random.randrange(300)}", "c0", day(-random.randrange(1, 40))) for _ in range(4000)]
    spans_rows = [(who, day(-30), END) for who in {r[0] for r in rows}] + [("hot", day(-20), day(-10))]
    events = spark.createDataFrame(rows, "subject_id string, code string, event_date date").repartition(6)
    spans = spark.createDataFrame(spans_rows, "subject_id string, start_date date, end_date date")
    hot = windows.hot_entities(events, min_rows=100)
    assert spark.range(1).select(hot.alias("m")).first()["m"] == {"hot": 20}
    expected = Counter(
        (who, code, d) for who, code, d in rows for w, start, end in spans_rows if w == who and start < d < end
    )
    got = Counter(tuple(r) for r in windows.in_window(events, spans, hot=hot).collect())
    assert got == expected
    joined = runtime.spread_join(events, spans, "subject_id", hot, runtime.row_salt("event_date", "code"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert runtime.SALT in plan


def test_hot_keys_are_bounded(spark):
    sizes = spark.createDataFrame([(i, 10) for i in range(500)], "k int, n long")
    assert spark.range(1).select(runtime.hot_keys(sizes, "k", "n", 1, 100).alias("m")).first()["m"] == {}
    uneven = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000, 100)], "k int, n long")
    found = spark.range(1).select(runtime.hot_keys(uneven, "k", "n", 1, 100).alias("m")).first()["m"]
    assert found == {1000: 50}
    assert spark.range(1).select(F.coalesce(runtime.hot_keys(sizes.limit(0), "k", "n"), F.create_map()).alias("m")).first()["m"] == {}


def test_listed_rows_of_a_hot_key(spark):
    random.seed(4)
    rows = [("hot" if i % 3 == 0 else f"k{random.randrange(40)}", i % 7) for i in range(3000)]
    frame = spark.createDataFrame(rows, "code string, x int").repartition(5)
    wanted = spark.createDataFrame([("hot",), ("hot",), ("k1",), ("none",)], "code string")
    got = Counter(tuple(r) for r in runtime.keep_listed(frame, wanted, "code", min_rows=50, listed_rows=0).collect())
    assert got == Counter(r for r in rows if r[0] in ("hot", "k1"))
    assert Counter(tuple(r) for r in runtime.keep_listed(frame, wanted, "code").collect()) == got


def test_null_keys_meet_nothing(spark):
    rows = [(None, "c", END)] * 5 + [("p", "c", day(-1))]
    events = spark.createDataFrame(rows, "subject_id string, code string, event_date date")
    spans = spark.createDataFrame(
        [("p", day(-9), END), (None, day(-9), END)], "subject_id string, start_date date, end_date date"
    )
    for least in (2, 1_000_000):
        hot = windows.hot_entities(events, least)
        assert windows.in_window(events, spans, "both", hot=hot).count() == 1
        wanted = spans.select("subject_id")
        assert runtime.keep_listed(events, wanted, "subject_id", least, listed_rows=0).count() == 1
    assert runtime.keep_listed(events, spans, "subject_id").count() == 1


def test_event_helpers(spark):
    admissions, events = two_kinds(spark)
    assert ev.fatal(admissions).count() == 2 and ev.survived(admissions).count() == 2
    assert ev.event_dates(events.unionByName(events)).count() == 8
    frame = spark.createDataFrame([("a", 1.0), ("b", None)], "code string, value double")
    assert ev.drop_incomplete(frame).count() == 1
    wanted = spark.createDataFrame([("b",)], "anything string")
    assert [r["code"] for r in ev.keep_codes(frame, wanted).collect()] == ["b"]
    assert [r["code"] for r in ev.keep_codes(frame, ["a"]).collect()] == ["a"]


# Measured on the given tables with another engine.
GOLDEN = {
    # policy: windows, diagnoses, medication, labs, tuples, sum of values, words of notes
    "all_entities": (161, 1295, 5135, 5167, 3999, 29020.5756, 39732),
    "survivor_rows": (157, 1262, 5008, 5034, 3993, 28871.4563, 36554),
    "disjoint": (150, 1208, 4785, 4821, 3984, 28569.1090, 34132),
}


@pytest.mark.parametrize("policy", windows.POLICIES)
def test_golden_counts(spark, small, policy):
    tables = catalog.event_tables(spark, small)
    chosen = pipelines.Settings(policy=policy, stop_words=None)
    spans = pipelines.pipeline_windows(tables, chosen)
    kept = windows.in_window(tables.events, spans)
    per_source = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    tuples = pipelines.event_tuples(tables, chosen).agg(F.count("*"), F.sum("value")).first()
    words = note_word_counts(pipelines.windowed_notes(tables, chosen), stop=None).count()
    expected = GOLDEN[policy]
    assert (spans.count(), per_source["DIAG"], per_source["MED"], per_source["LAB"]) == expected[:4]
    assert (tuples[0], round(tuples[1], 4), words) == expected[4:]


def test_admissions(spark, small):
    got = star.admissions(spark, small).agg(
        F.count("*"), F.countDistinct("subject_id"), F.count_if(F.col("hospital_expire_flag") == "1")
    )
    assert tuple(got.first()) == (1500, 150, 11)


def test_one_window_per_entity(spark, small):
    spans = catalog.queries()["windows_disjoint"](spark, small)
    assert spans.groupBy("subject_id").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("closed", ["neither", "left", "right", "both"])
@pytest.mark.parametrize("min_rows", [2, 1_000_000])
def test_many_windows(spark, closed, min_rows):
    """Against all windows of an entity, with windows of a day, of centuries, empty, reversed, repeated and without bounds."""
    r = random.Random(5)
    origin = datetime.date(1969, 11, 1)
    day = lambda n: origin + datetime.timedelta(n)
    events = [(r.choice([1, 1, 1, 1, 2, 3, None]), day(r.randint(0, 300)), i) for i in range(300)]
    events += [(1, None, -1), (9, day(3), -2), *events[:20]]
    spans = []
    for i in range(80):
        start = r.randint(-40, 300)
        spans.append((r.choice([1, 1, 2, 3, 4]), day(start), day(start + r.choice([0, 1, 7, 8, 9, 30, 64, 200, 90_000])), i))
    spans += [(1, day(50), day(40), 100), (1, None, day(40), 101), (None, day(0), day(300), 102), (2, day(0), None, 103), *spans[:5]]
    left = spark.createDataFrame(events, "subject_id int, event_date date, code int")
    right = spark.createDataFrame(spans, "subject_id int, start_date date, end_date date, _bucket int")
    got = windows.in_many_windows(left, right, closed, min_rows)
    assert got.columns == ["subject_id", "event_date", "code", "start_date", "end_date", "_bucket"]
    expected = [
        (s, d, c, a, b, w)
        for s, d, c in events
        for t, a, b, w in spans
        if s is not None and s == t and None not in (d, a, b)
        and (d > a or d == a and closed in ("left", "both"))
        and (d < b or d == b and closed in ("right", "both"))
        and a <= b
    ]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert windows.in_many_windows(left, right.limit(0), closed).count() == 0
    assert windows.in_many_windows(left.limit(0), right, closed).count() == 0


def test_windows_meet_few_buckets_on_few_levels(spark):
    """Lengths of a day to a century: at most six buckets a window, and five lengths of buckets in all."""
    spans = spark.range(1, 36_500).select(F.date_sub(F.lit(END), F.col("id").cast("int")).alias("s"), F.lit(END).alias("e"))
    level = windows._level(F.col("s"), F.col("e"))
    n = windows._bucket(F.col("e"), level) - windows._bucket(F.col("s"), level) + 1
    row = spans.agg(F.max(n).alias("most"), F.count_distinct(level).alias("levels")).first()
    assert row.most <= 6 and row.levels <= 6


def test_only_busy_entities_have_counted_buckets(spark):
    """A busy day of one entity is cut, and every pair still comes out once."""
    rows = [("hot", f"c{i % 7}", day(-5)) for i in range(500)] + [(f"p{i}", "c0", day(-i % 30)) for i in range(300)]
    events = spark.createDataFrame(rows, "subject_id string, code string, event_date date").repartition(4)
    spans_rows = [(who, w, day(-40 + 3 * w), day(-2 * w)) for who in ("hot", "p1", "p2") for w in range(4)]
    spans = spark.createDataFrame(spans_rows, "subject_id string, w int, start_date date, end_date date")
    met = windows.in_many_windows(events, spans, "right", min_rows=20)
    expected = Counter((who, c, d, w) for who, c, d in rows for o, w, s, e in spans_rows if o == who and s < d <= e)
    assert Counter((r.subject_id, r.code, r.event_date, r.w) for r in met.collect()) == expected
