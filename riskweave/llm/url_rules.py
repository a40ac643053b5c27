"""URL filters as a sort-merge range join.

Rules and urls get keys in which the host is reversed, so that everything a
rule fits lies in one interval of the sorted keys.  A url has one key for each
suffix of its host that is as long as some rule's host; a rule has its start.
Both are dealt to ranges of keys, sorted, and swept once: the sweep keeps a
stack of the rules whose interval is still open, nested ones on top.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import ascii_lower, map_rows, partitions
from riskweave.operators.runtime import stored

# Keys sampled for each range in order to choose the cuts between ranges.
SAMPLE_PER_RANGE = 60
# Ranges for each shuffle partition: small ones even out.
RANGES_PER_PARTITION = 4
# Sorts behind everything that may follow a prefix.
LAST = "\U0010ffff"

RULE_SCHEMA = "host string, path string, verdict string"
_DEALT = "range int, key string, is_point boolean, host string, path string, verdict string"
_HITS = "host string, path string, length int, rule string, verdict string"


def host_of(url: Column | str) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column | str) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows from tuples."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def sort_key(labels: list[str], path: str) -> str:
    return ".".join(reversed(labels)) + ".\0" + path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    A rule fits its host and all its subdomains where the path starts with the
    rule's path.  The longest rule wins (host and path together); of equally
    long ones the first by name, and of one rule with several verdicts "block"
    before "allow".  Urls that no rule fits get ``default`` and no rule.

    Null urls and urls without ``://`` have an empty host and path, and no rule
    fits them.  Rules without a host are left out; a null path is an empty one,
    a null verdict is ``default``.  Repeated pages and null ids keep their rows;
    further columns are ignored.

    Each distinct (host, path) is judged once, so copies of one url do not meet
    in the sweep.  Ranges are cut by sampled (key, host) pairs, which are
    distinct, so no host can fill a range; a broad rule is repeated in each of
    the ranges its interval covers.
    """
    spark = pages.sparkSession
    parted = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    usable = rules.select(
        ascii_lower("host").alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    ).filter("host IS NOT NULL AND host != ''")
    usable = usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    widest = usable.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0]
    if widest is None:
        return parted.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    urls = stored(parted.filter("host != ''").select("host", "path").distinct())
    cuts = _cuts(urls, widest, partitions(spark) * RANGES_PER_PARTITION)
    dealt = map_rows(urls.select("host", "path"), _points(widest, cuts), _DEALT).unionByName(
        map_rows(usable, _intervals(cuts), _DEALT)
    )
    ordered = dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "key", "is_point")
    hits = map_rows(ordered, _sweep, _HITS)
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.col("length")).alias("length"), "rule", "verdict")).alias("best")
    )
    return parted.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _suffix_keys(host: str, path: str, widest: int) -> Iterator[str]:
    labels = host.split(".")
    for start in range(max(0, len(labels) - widest), len(labels)):
        yield sort_key(labels[start:], path)


def _cuts(urls: DataFrame, widest: int, ranges: int) -> list[tuple[str, str]]:
    """Sorted (key, host) pairs between the ranges, from a sample of a fixed size for each range."""
    wanted = ranges * SAMPLE_PER_RANGE
    rows = urls.count()
    part = urls if rows <= wanted else urls.sample(fraction=wanted / rows, seed=1)
    sample = sorted(
        (key, row.host) for row in part.toLocalIterator() for key in _suffix_keys(row.host, row.path, widest)
    )
    places = sorted({len(sample) * k // ranges for k in range(1, ranges)})
    return sorted({sample[p] for p in places if p < len(sample)})


def _points(widest: int, cuts: list[tuple[str, str]]):
    def deal(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [
                (bisect_right(cuts, (key, host)), key, True, host, path, None)
                for host, path in batch
                for key in _suffix_keys(host, path, widest)
            ]

    return deal


def _intervals(cuts: list[tuple[str, str]]):
    def deal(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for host, path, verdict in batch:
                key = sort_key(host.split("."), path)
                first = bisect_left(cuts, (key, ""))
                last = bisect_right(cuts, (key + LAST, LAST))
                rows += [(r, key, False, host, path, verdict) for r in range(first, last + 1)]
            yield rows

    return deal


def _sweep(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    at, open_rules = None, []
    for batch in batches:
        hits = []
        for place, key, is_point, host, path, verdict in batch:
            if place != at:
                at, open_rules = place, []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if not is_point:
                open_rules.append((key, host + path, verdict))
            elif open_rules:
                _, rule, found = open_rules[-1]
                hits.append((host, path, len(rule), rule, found))
        yield hits
