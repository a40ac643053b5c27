"""Observation windows of entities and the events inside them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators import events as ev
from riskweave.operators.runtime import HOT_MIN_ROWS, free_name, hot_keys, row_salt, spread_join

# Days between index day and death, and days under observation.
LEAD_DAYS = 30
LENGTH_DAYS = 2000

# Which entities get a window that ends with their last event, next to the
# windows before each fatal admission:
#   disjoint       entities without a fatal admission (one kind of window each)
#   survivor_rows  entities with at least one admission that they survived
#   all_entities   every entity
POLICIES = ("disjoint", "survivor_rows", "all_entities")


def entity_activity(events: DataFrame) -> DataFrame:
    """Last day and number of events per entity, combined before the shuffle."""
    return events.groupBy("subject_id").agg(
        F.max("event_date").alias("last_date"), F.count(F.lit(1)).alias("n_events")
    )


def last_event_dates(events: DataFrame) -> DataFrame:
    """Day of the last event per entity."""
    return last_days(entity_activity(events))


def last_days(activity: DataFrame) -> DataFrame:
    """The same from (subject_id, last_date, n_events)."""
    # The test on the count changes nothing; it keeps the aggregation equal to
    # the one in busy_entities, so that a plan with both runs it once.
    return _busy(activity).select("subject_id", "last_date")


def _busy(activity: DataFrame) -> DataFrame:
    return activity.filter((F.col("n_events") > 0) & F.col("last_date").isNotNull())


def hot_entities(events: DataFrame, min_rows: int = HOT_MIN_ROWS) -> Column:
    """The few entities whose events must be spread over several tasks, as a map to their parts."""
    return busy_entities(entity_activity(events), min_rows)


def busy_entities(activity: DataFrame, min_rows: int = HOT_MIN_ROWS) -> Column:
    """The same from (subject_id, last_date, n_events)."""
    return hot_keys(_busy(activity), "subject_id", "n_events", min_rows)


def _window_before(day: Column, lead_days: int, length_days: int) -> list[Column]:
    end = F.date_sub(day, lead_days)
    return [F.date_sub(end, length_days).alias("start_date"), end.alias("end_date")]


def observation_windows(
    admissions: DataFrame,
    events: DataFrame | None,
    policy: str = "disjoint",
    lead_days: int = LEAD_DAYS,
    length_days: int = LENGTH_DAYS,
    survivor_lead_days: int = 0,
    activity: DataFrame | None = None,
) -> DataFrame:
    """(subject_id, start_date, end_date), one row per window; see ``POLICIES``.

    ``activity`` is the :func:`entity_activity` of the events if the caller has
    it already; ``events`` is then not read.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    dead = ev.fatal(admissions)
    before_death = dead.select("subject_id", *_window_before(F.col("deathtime"), lead_days, length_days))
    last = last_days(entity_activity(events) if activity is None else activity)
    if policy == "disjoint":
        last = last.join(dead.select("subject_id"), "subject_id", "left_anti")
    elif policy == "survivor_rows":
        last = last.join(ev.survived(admissions).select("subject_id"), "subject_id", "left_semi")
    before_last = last.select("subject_id", *_window_before(F.col("last_date"), survivor_lead_days, length_days))
    return before_death.unionByName(before_last)


def _inside(closed: str) -> Column:
    day, start, end = F.col("event_date"), F.col("start_date"), F.col("end_date")
    after = day >= start if closed in ("left", "both") else day > start
    before = day <= end if closed in ("right", "both") else day < end
    return after & before


def in_window(
    events: DataFrame,
    windows: DataFrame,
    closed: str = "neither",
    hot: Column | None = None,
    salt_on: tuple[str, ...] | None = None,
) -> DataFrame:
    """Events inside a window of their entity, once per window that holds them.

    ``closed`` says which bounds belong to the window.  ``hot`` are the hot
    entities if the caller has them already; ``salt_on`` the columns that deal
    their events to tasks.
    """
    if closed not in ("neither", "left", "right", "both"):
        raise ValueError("closed must be neither, left, right or both")
    hot = hot_entities(events) if hot is None else hot
    salt = row_salt(*(salt_on or ("event_date", "code")))
    joined = spread_join(events, windows, "subject_id", hot, salt)
    return joined.filter(_inside(closed)).select(events.columns)


# A window of more days than this goes to a level whose buckets are LEVEL_GROWTH times as long.
LEVEL_DAYS = 4
LEVEL_GROWTH = 8


def _level(start: Column, end: Column) -> Column:
    """How often a bucket's length grows from a day, so that a window meets at most LEVEL_DAYS + 2 buckets."""
    days = F.greatest(F.datediff(end, start), F.lit(1))
    # Compared with whole numbers: a logarithm may land beside them.
    limits = [LEVEL_DAYS * LEVEL_GROWTH**k for k in range(9)]
    return sum(((days > limit).cast("int") for limit in limits[1:]), (days > limits[0]).cast("int"))


def _bucket(day: Column, level: Column) -> Column:
    return F.floor(F.unix_date(day.cast("date")) / F.pow(F.lit(float(LEVEL_GROWTH)), level)).cast("int")


def in_many_windows(
    events: DataFrame,
    windows: DataFrame,
    closed: str = "neither",
    min_rows: int = HOT_MIN_ROWS,
    salt_on: tuple[str, ...] | None = None,
) -> DataFrame:
    """Events with each window of their entity that holds them, for entities with many windows.

    Returns the columns of both, the entity once.  Where :func:`in_window` meets
    every event of an entity with every window, this one meets them by entity
    and bucket of time: a window stands in the at most six buckets that it
    reaches, whose length goes with its own, and an event in one bucket for each
    length in use (five for windows of a century).  Rows that meet are thus
    in proportion to the result, but for those in a window's outer buckets.
    Buckets with many events are cut into parts; only entities with many events
    have such, so no other bucket is counted.

    Null entities, days and bounds meet nothing, and neither do windows that end
    before they begin.  Equal windows and equal events all count.  ``salt_on``
    are the columns that deal events to parts, all by default.
    """
    if closed not in ("neither", "left", "right", "both"):
        raise ValueError("closed must be neither, left, right or both")
    taken = (set(events.columns) & set(windows.columns)) - {"subject_id"}
    if taken:
        raise ValueError(f"columns of both tables: {sorted(taken)}")
    name = free_name("_bucket", events, windows)
    level = free_name("_level", events, windows)
    start, end, day = F.col("start_date"), F.col("end_date"), F.col("event_date")

    spans = windows.filter(F.col("subject_id").isNotNull() & (start <= end)).withColumn(level, _level(start, end))
    # Day numbers have 22 bits, so there are at most eight levels whatever the table.
    levels = spans.agg(F.collect_set(level)).scalar()
    reached = F.explode(F.sequence(_bucket(start, F.col(level)), _bucket(end, F.col(level))))
    spans = spans.withColumn(name, reached)

    dated = events.filter(F.col("subject_id").isNotNull() & day.isNotNull())

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(level, F.explode(levels)).withColumn(name, _bucket(day, F.col(level)))

    n = free_name("n_events", events, windows)
    busy = hot_keys(dated.groupBy("subject_id").agg(F.count(F.lit(1)).alias(n)), "subject_id", n, min_rows)
    keys = ["subject_id", level, name]
    some = placed(dated.select("subject_id", "event_date").filter(F.try_element_at(busy, F.col("subject_id")).isNotNull()))
    sizes = some.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).select(F.struct(*keys).alias(name), n)
    hot = hot_keys(sizes, name, n, min_rows)
    salt = row_salt(*(salt_on or events.columns))
    met = spread_join(placed(dated), spans, keys, hot, salt)
    return met.filter(_inside(closed)).select(
        *events.columns, *[c for c in windows.columns if c != "subject_id"]
    )
