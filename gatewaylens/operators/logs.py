"""Access-log mining and load-test summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C

# The access-log line and the words that mark a failure. The path is written decoded and without quotes,
# so it may hold anything; what stands before and after it has a fixed form, and the last such end counts. The group is that end.
LINE = (
    r'(?s)^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \S+ .* (\d{3} \([^()]*\) ua="(?:[^"\\]|\\.)*" key=.*)$'
)
AT_LENGTH = 19
FAILURE_WORDS = "(?i)error|fail"


def _cut(lines: DataFrame, only_requests: bool) -> DataFrame:
    """`lines` with the fixed `end_` of each request line, empty for others; these go with `only_requests`.

    The one match of the whole line: it is generated as a column of its own, so it is neither repeated per field nor
    pushed into a filter. All other fields are cut by their places.
    """
    found = F.array(F.regexp_extract("line", LINE, 1))
    chosen = F.filter(found, lambda end: end != "") if only_requests else found
    return lines.select("*", F.explode(chosen).alias("end_"))


def _rest() -> Column:
    """What follows the time: method, path and end."""
    return F.substr("line", F.lit(AT_LENGTH + 2))


def _method() -> Column:
    return F.substring_index(_rest(), " ", 1)


def _path() -> Column:
    begin = F.length(_method()) + 2  # in the rest
    return F.substr(_rest(), begin, F.length("line") - AT_LENGTH - 1 - F.length("end_") - begin)


def _parsed() -> list[Column]:
    duration = F.substring_index(F.substr("end_", F.lit(6)), ")", 1)
    agent = F.substr("end_", F.length(duration) + F.lit(12))  # behind the quote that opens it
    # An agent ends at its first quote without a backslash; few have a backslash at all.
    written = F.when(F.contains(F.substring_index(agent, '" key=', 1), F.lit("\\")), F.regexp_extract(agent, r'^((?:[^"\\]|\\.)*)"', 1)).otherwise(
        F.substring_index(agent, '"', 1))
    plain = F.when(F.contains(written, F.lit("\\")), F.regexp_replace(written, r'\\(["\\])', "$1")).otherwise(written)
    return [
        F.try_to_timestamp(F.substr("line", F.lit(1), F.lit(AT_LENGTH)), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        _method().alias("method"),
        _path().alias("path"),
        F.substr("end_", F.lit(1), F.lit(3)).try_cast("int").alias("status"),
        C.duration_ms(duration).alias("duration_ms"),
        plain.alias("ua"),
        F.substr(agent, F.length(written) + F.lit(7)).alias("key"),
    ]


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Access-log text lines as columns. Lines of another shape are left out here; `unparsed_lines` has them."""
    others = [c for c in lines.columns if c != "line"]
    return _cut(lines, True).select(*others, *_parsed())


def unparsed_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no request lines, as they are."""
    return lines.where(~F.col("line").rlike(LINE) | F.col("line").isNull())


def filter_log(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that match a pattern."""
    return lines.where(F.col("line").rlike(pattern))


def log_errors(lines: DataFrame) -> DataFrame:
    """Failed requests by status and path: status 400 and above, or a line that speaks of a failure.

    A failure line that is no request line counts under an empty path and no status.
    """
    status = F.substr("end_", F.lit(1), F.lit(3)).try_cast("int")
    path = F.when(F.col("end_") != "", _path()).otherwise("")
    rows = _cut(lines.where("line IS NOT NULL"), False).select(
        status.alias("status"), path.alias("path"), F.col("line").rlike(FAILURE_WORDS).alias("speaks"))
    counts = rows.groupBy("status", "path").agg(F.count("*").alias("all"), F.count_if("speaks").alias("speaking"))
    # Chosen among counts, not rows: a filter on rows would be pushed down and parse every line again.
    failing = F.when(F.col("status") >= 400, F.col("all")).otherwise(F.col("speaking"))
    return counts.select("status", "path", failing.alias("lines")).where("lines > 0")


def log_key_counts(lines: DataFrame) -> DataFrame:
    """Requests per key text of the log."""
    return parse_access_log(lines).groupBy("key").agg(F.count("*").alias("requests"))


def latency_profile(parsed: DataFrame) -> DataFrame:
    """Exact latency percentiles per path.

    Latencies are whole milliseconds, so they are first reduced to a count per (path, value); the
    percentile then works on that histogram, whose size does not grow with the number of requests.
    """
    counts = parsed.groupBy("path", "duration_ms").agg(F.count("*").alias("c"))
    marks = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("c"))
    rows = counts.groupBy("path").agg(
        F.sum("c").alias("n"), marks.alias("marks"), F.max("duration_ms").alias("max")
    )
    return rows.select(
        "path", "n",
        F.get("marks", 0).alias("p50"), F.get("marks", 1).alias("p95"), F.get("marks", 2).alias("p99"), "max",
    )


def load_summary(results: DataFrame, target_rps: float = 500.0) -> DataFrame:
    """One row of load-test figures. Hits and misses count among successes, and so do their shares.

    Latencies are summed as whole hundredths of a millisecond, so that the sum does not depend on order.
    """
    total, ok = F.count("*"), F.count_if("ok")
    hits = F.count_if(F.col("ok") & F.coalesce(F.col("cache_status") == "hit", F.lit(False)))
    misses = F.count_if(F.col("ok") & F.coalesce(F.col("cache_status") == "miss", F.lit(False)))
    spent = F.sum(F.round(F.col("latency_ms") * 100).cast("bigint"))
    first, last = F.min(C.micros(F.col("ts"))), F.max(C.micros(F.col("ts")))
    sums = results.agg(
        total.alias("total"), ok.alias("ok"), hits.alias("hits"), misses.alias("misses"),
        spent.alias("spent"), (last - first).alias("elapsed_us"),
    )
    rps = F.when(F.col("elapsed_us") > 0, F.col("total").cast("double") / (F.col("elapsed_us") / 1_000_000.0))
    rps = rps.otherwise(F.lit(0.0))
    errors = F.col("total") - F.col("ok")
    return sums.select(
        "total", "ok", errors.alias("errors"), "hits", "misses",
        C.share_pct(F.col("ok"), F.col("total")).alias("ok_pct"),
        C.share_pct(errors, F.col("total")).alias("error_pct"),
        C.share_pct(F.col("hits"), F.col("ok")).alias("hit_pct"),
        F.when(F.col("total") > 0, F.col("spent").cast("double") / 100.0 / F.col("total").cast("double"))
        .otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        rps.alias("rps"),
        (rps >= F.lit(float(target_rps))).alias("target_met"),
    )


STEPS_PER_PART = 1000


def load_progress(results: DataFrame, step_s: int = 10) -> DataFrame:
    """Requests per time step with the running count and the rate since the start of the test.

    Every step from the first request to the last is a row, also one without requests. The rows become one per step
    before anything is ordered. The running count adds up steps within a part of the test and parts before it, so
    that no window runs over the whole length of the test.
    """
    width = int(step_s) * 1_000_000
    def step_of(column: str) -> Column:
        return F.expr(f"floor(unix_micros(CAST({column} AS TIMESTAMP)) / {width})")

    counted = results.where("ts IS NOT NULL").groupBy(step_of("ts").alias("step")).agg(F.count("*").alias("requests"))
    ends = results.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    ends = ends.select(step_of("low").alias("first"), step_of("high").alias("last"))
    parts = ends.where("first IS NOT NULL").select("first", "last", F.explode(F.expr(
        f"sequence(first div {STEPS_PER_PART}, last div {STEPS_PER_PART})")).alias("part"))
    inside = F.sequence(
        F.greatest("first", F.col("part") * STEPS_PER_PART), F.least("last", F.col("part") * STEPS_PER_PART + STEPS_PER_PART - 1))
    steps = parts.select("first", "part", F.explode(inside).alias("step"))
    buckets = steps.join(counted, "step", "left").withColumn("requests", F.coalesce("requests", F.lit(0).cast("bigint")))
    sums = buckets.groupBy("part").agg(F.sum("requests").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0).cast("bigint")).alias("before"))
    upto = Window.partitionBy("part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("requests").over(upto) + F.col("before")
    elapsed = (F.col("step") + 1 - F.col("first")) * width / 1_000_000.0
    bucket = F.timestamp_micros(F.col("step") * width).cast("timestamp_ntz")
    return buckets.join(sums, "part").select(
        bucket.alias("bucket"), "requests", running.alias("cumulative"), (running.cast("double") / elapsed).alias("rps")
    )
