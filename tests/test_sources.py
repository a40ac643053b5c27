import datetime

import pytest
from pyspark.sql import functions as F

from riskweave.operators import runtime, words
from riskweave.sources import quoted, sinks, tables
from riskweave.streaming.notes import append_word_counts


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_malformed_rows_are_dropped(spark, tmp_path):
    path = write(tmp_path, "t.csv", "subject_id,x,code,t", "1,a,c1,2000", "2,a,c1", "3,a,c1,2000,extra", "4,a,,2000")
    table = tables.read_table(spark, path)
    # Also where only some columns, or none, are needed.
    assert table.count() == 2
    assert [r[0] for r in table.select("subject_id").collect()] == ["1", "4"]
    assert table.na.drop("any").count() == 1


def test_view_names():
    assert tables.infer_view_name("dir/file.csv") == "file"
    assert tables.infer_view_name("x.tsv") == "tsv"
    assert tables.infer_view_name("dir/") == "dir/"
    assert tables.infer_view_name("plain") == "plain"


def test_views(spark, tmp_path):
    path = write(tmp_path, "people.csv", "a,b", "1,2")
    tables.load_table_as_view(spark, path)
    assert [tuple(r) for r in spark.sql("SELECT a, b FROM people").collect()] == [("1", "2")]
    tables.load_table_as_view(spark, path, "others")
    assert spark.sql("SELECT * FROM others").count() == 1


def test_event_tables(spark, tmp_path):
    admissions = write(
        tmp_path, "admissions.csv", "subject_id,deathtime,hospital_expire_flag", "1,2084-07-03 06:20:00,1", "2,,0"
    )
    got = {tuple(r) for r in tables.read_admissions(spark, admissions).collect()}
    assert got == {("1", datetime.date(2084, 7, 3), "1"), ("2", None, "0")}

    coded = write(tmp_path, "diagnoses.csv", "s,h,c,t", "1,9,25000,2120-01-01 23:00:00", "2,9,,2120-01-02 00:00:00")
    got = {tuple(r) for r in tables.read_diagnoses(spark, coded).collect()}
    assert got == {("1", "DIAG25000", datetime.date(2120, 1, 1)), ("2", "DIAGnull", datetime.date(2120, 1, 2))}
    assert tables.read_diagnoses(spark, coded, drop_null_codes=True).count() == 1
    assert {r["code"] for r in tables.read_medication(spark, coded).collect()} == {"MED25000", "MEDnull"}

    labs = write(
        tmp_path, "labs.csv", "s,h,i,v,t",
        "1,9,50,1.5,2120-01-01 00:00:00", "1,9,50,,2120-01-01 00:00:00", "1,,50,2,2120-01-01 00:00:00",
    )
    assert [tuple(r) for r in tables.read_labs(spark, labs).collect()] == [
        ("1", "LAB50", 1.5, datetime.date(2120, 1, 1))
    ]
    bad = write(tmp_path, "bad.csv", "s,h,i,v,t", "1,9,50,high,2120-01-01 00:00:00")
    with pytest.raises(Exception):
        tables.read_labs(spark, bad).collect()


def test_id_list(spark, tmp_path):
    path = write(tmp_path, "ids.csv", "id,other", "1,a", "1,b", "2,c")
    assert {r[0] for r in tables.read_id_list(spark, path).collect()} == {"1", "2"}


NOTES = [
    "subject_id,charttime,text",
    '1,2084-07-03 06:20:00,"First line,',
    "second ""line"" line",
    'last"',
    "2,,plain words plain",
]


def test_notes_and_word_tables(spark, tmp_path):
    path = write(tmp_path, "notes.csv", *NOTES)
    notes = tables.read_notes(spark, path)
    rows = {r["subject_id"]: r for r in notes.collect()}
    assert set(rows) == {"1", "2"}
    assert "\n" in rows["1"]["text"] and rows["1"]["event_date"] == datetime.date(2084, 7, 3)
    assert rows["2"]["event_date"] is None

    counts = words.note_word_counts(notes, stop=None)
    folder = str(tmp_path / "counts")
    sinks.write_word_counts(counts, folder)
    back = {(r["subject_id"], r["word"]): (r["cnt"], r["event_date"]) for r in tables.read_word_counts(spark, folder).collect()}
    # The note without a time is written, and left out when read.
    assert back == {
        ("1", "first"): (1, datetime.date(2084, 7, 3)),
        ("1", "line"): (3, datetime.date(2084, 7, 3)),
        ("1", "second"): (1, datetime.date(2084, 7, 3)),
        ("1", "last"): (1, datetime.date(2084, 7, 3)),
    }
    assert tables.read_table(spark, folder).filter("charttime = 'nan'").count() == 2
    sinks.write_word_counts(counts, folder)
    assert tables.read_word_counts(spark, folder).count() == 8

    scores = words.entity_tfidf(words.entity_word_counts(counts))
    folder = str(tmp_path / "scores")
    sinks.write_tfidf(scores, folder)
    sinks.write_tfidf(scores, folder)
    assert tables.read_tfidf(spark, folder).count() == scores.count() == 6


def test_stored_cuts_lineage(spark):
    folder = runtime.checkpoint_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    frame = runtime.stored(spark.range(10).withColumn("x", F.rand()))
    assert [tuple(r) for r in frame.orderBy("id").collect()] == [tuple(r) for r in frame.orderBy("id").collect()]
    assert f"{folder}/riskweave-" in frame.inputFiles()[0]


class Conf:
    def __init__(self, named):
        self.named = named

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


@pytest.mark.parametrize("master", ["local[2]", "yarn"])
def test_checkpoint_folder(master):
    class Session:
        conf, sparkContext = Conf("shared/folder"), Context(master)

    assert runtime.checkpoint_folder(Session) == Session.sparkContext.folder == "shared/folder"
    Session.conf, Session.sparkContext = Conf(None), Context(master)
    if master == "yarn":
        with pytest.raises(ValueError):
            runtime.checkpoint_folder(Session)
    else:
        folder = runtime.checkpoint_folder(Session)
        assert folder and runtime.checkpoint_folder(Session) == folder == Session.sparkContext.folder


def test_stream_of_notes(spark, tmp_path):
    """Notes that arrive in two batches are counted like all at once, each once."""
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    notes = spark.createDataFrame(
        [(f"n{i}", f"p{i % 3}", f"word{i % 4} word{i % 4} other the") for i in range(20)],
        "note_id string, subject_id string, text string",
    ).withColumn("event_date", F.to_date(F.lit("2000-01-01")))
    first, second = notes.filter("note_id < 'n15'"), notes.filter("note_id >= 'n15'")
    stream = lambda: spark.readStream.schema(notes.schema).parquet(incoming)
    first.write.mode("append").parquet(incoming)
    append_word_counts(stream(), out, state).awaitTermination()
    second.write.mode("append").parquet(incoming)
    append_word_counts(stream(), out, state).awaitTermination()
    append_word_counts(stream(), out, state).awaitTermination()
    columns = ["note_id", "subject_id", "event_date", "word", "cnt"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(columns).collect())
    assert got == sorted(tuple(r) for r in words.note_word_counts(notes).select(columns).collect())


def test_notes_without_time(spark, tmp_path):
    path = write(tmp_path, "undated.csv", "subject_id,charttime,text", "1,nan,a", "2,,b", "3,2084-07-03,c")
    got = {r["subject_id"]: r["event_date"] for r in tables.read_notes(spark, path).collect()}
    assert got == {"1": None, "2": None, "3": datetime.date(2084, 7, 3)}
    spark.read.option("header", True).csv(path).write.parquet(str(tmp_path / "notes"))
    again = tables.read_note_table(spark, str(tmp_path / "notes"))
    assert {r["subject_id"]: r["event_date"] for r in again.collect()} == got
    assert again.select("note_id").distinct().count() == 3


QUOTED = [
    ("1", "2084-07-03 10:00:00", 'first, "quoted"\nsecond\r\nthird'),
    ("2", "nan", ""),
    (None, None, "plain"),
    ("3", "2084-07-03", "\n\n\n" + "long line\n" * 30 + '"'),
    ("4", "2084-07-04", '""\n,"'),
    ("5", None, None),
    ("6", "2084-07-05", "the end"),
    ("6", "2084-07-05", "the end"),
]


def quoted_file(place, rows, end="\n", last=True):
    def field(value):
        if value is None:
            return ""
        plain = value and not set(value) & set('",\r\n')
        return value if plain else '"' + value.replace('"', '""') + '"'

    lines = ["subject_id,charttime,text", *(",".join(map(field, row)) for row in rows)]
    place.write_bytes((end.join(lines) + (end if last else "")).encode())
    return str(place)


@pytest.mark.parametrize("size", [3, 40, 1 << 20])
def test_quoted_records_across_ranges(spark, tmp_path, size):
    """Ranges begin at every place: within fields, quotes and line breaks."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    folder = tmp_path / "notes"
    folder.mkdir()
    quoted_file(folder / "a.csv", QUOTED)
    quoted_file(folder / "b.csv", QUOTED[:5], end="\r\n", last=False)
    quoted_file(folder / "c.csv", [])
    got = quoted.read_quoted(session, str(folder))
    assert got.columns == ["subject_id", "charttime", "text"]
    # Empty fields are null, quoted or not, as in Spark's own reader.
    expected = [tuple(value or None for value in row) for row in [*QUOTED, *QUOTED[:5]]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    if size < 100:
        lines = quoted.read_lines(session, str(folder / "a.csv"))
        assert lines.rdd.getNumPartitions() > 5
        known = quoted.ranges(lines).collect()
        assert len(known) > 5 and any(r["inside"] for r in known)
        assert all((r["owner"] < r["block"]) for r in known if r["inside"])


def test_quoted_records_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "LISTED_ROWS", 0)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "40")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    path = quoted_file(tmp_path / "notes.csv", QUOTED)
    got = quoted.read_quoted(session, path).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(value or None for value in row)) for row in QUOTED)


def test_split_notes_are_the_same(spark, tmp_path):
    path = quoted_file(tmp_path / "notes.csv", QUOTED[:2] + QUOTED[4:])
    whole, split = (sorted(map(repr, tables.read_notes(spark, path, s).collect())) for s in (False, True))
    assert whole == split
