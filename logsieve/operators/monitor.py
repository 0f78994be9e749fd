"""Monitoring aggregates over metric samples, decisions and latencies. The windowed ones also run on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.scalars import col
from logsieve.operators.quantiles import exact_quantiles
from logsieve.session import materialise

FLAGGED_WINDOW = "5 minutes"
DECISION_WINDOW = "1 hour"
SLICES = 64                 # of a window, that the samples of a series are dealt out by
REPEAT_HOURS = 4
FOLD_ROWS = 1_000_000


def _per_window(df: DataFrame, ts: str, length: str, slide: str | None, late: str | None,
                counts: dict[str, Column]) -> DataFrame:
    """Counters per tumbling or sliding window as `(w, ...)`; `late` sets the watermark of a stream.

    For a sliding window a batch is first counted per slide, so a row is not copied into every window it is in. The
    slide must divide the length.
    """
    df = df.withWatermark(ts, late) if late else df
    if slide is None or df.isStreaming:
        window = F.window(ts, length, slide) if slide else F.window(ts, length)
        return df.groupBy(window.alias("w")).agg(*[c.alias(n) for n, c in counts.items()])
    steps = df.groupBy(F.window(ts, slide).alias("s")).agg(*[c.alias(n) for n, c in counts.items()])
    steps = steps.withColumn("at", F.col("s.start"))
    return steps.groupBy(F.window("at", length, slide).alias("w")).agg(*[F.sum(n).alias(n) for n in counts])


def flagged_per_window(df: DataFrame, ts: str, length: str = FLAGGED_WINDOW, slide: str | None = None,
                       late: str | None = None) -> DataFrame:
    """Flagged events per tumbling or sliding window."""
    counted = _per_window(df, ts, length, slide, late, {"n": F.count("*")})
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def decision_rate(df: DataFrame, ts: str, decision: Column | str = "decision", length: str = DECISION_WINDOW,
                  slide: str | None = None, late: str | None = None) -> DataFrame:
    """Share of genuine findings among all decisions of a window."""
    counts = {"genuine": F.count_if(col(decision) == "genuine_bug"), "n": F.count("*")}
    counted = _per_window(df, ts, length, slide, late, counts)
    return counted.select(F.col("w.start").alias("window_start"), "genuine", "n",
                          (F.col("genuine") / F.col("n")).alias("rate"))


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


# Histograms and latencies --------------------------------------------------------------------------------------


def to_buckets(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative bucket counts `(by, le, n)` from raw samples in one pass; the last bucket is unbounded."""
    edges = [*bounds, float("inf")]
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)])
    return counts.select(*by, F.explode(rows).alias("row")).select(*by, "row.le", "row.n")


def histogram_quantile(buckets: DataFrame, quantiles: list[float], by: list[str], le: str = "le",
                       n: str = "n") -> DataFrame:
    """Quantiles from cumulative buckets by linear interpolation inside the bucket that holds the rank.

    The unbounded bucket answers with the highest finite bound, an empty histogram with null. A group has as many
    rows as there are bounds, so the window over it is small.
    """
    summed = buckets.groupBy(*by, F.col(le).cast("double").alias("le")).agg(F.sum(n).cast("double").alias("upto"))
    ordered = W.partitionBy(*by).orderBy("le")
    whole = W.partitionBy(*by)
    rows = (
        summed
        .withColumn("below", F.coalesce(F.lag("upto").over(ordered), F.lit(0.0)))
        .withColumn("from", F.lag("le").over(ordered))
        .withColumn("total", F.max("upto").over(whole))
        .withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("rank", F.col("quantile") * F.col("total"))
    )
    start = F.coalesce(F.col("from"), F.when(F.col("le") > 0, F.lit(0.0)).otherwise(F.col("le")))
    inside = F.try_divide(F.col("rank") - F.col("below"), F.col("upto") - F.col("below"))
    value = (
        F.when(F.col("total") == 0, F.lit(None))
        .when(F.col("le") == float("inf"), F.col("from"))
        .otherwise(start + (F.col("le") - start) * F.coalesce(inside, F.lit(0.0)))
    )
    first = F.min_by(value, F.col("le"))
    return (
        rows.filter(F.col("upto") >= F.col("rank"))
        .groupBy(*by, "quantile").agg(first.alias("value"))
    )


def latency_quantiles(df: DataFrame, value: str, quantiles: list[float], by: str | None = None,
                      method: str = "linear") -> DataFrame:
    """Exact quantiles of raw samples per group; `index` takes the sorted sample at position int(n * q)."""
    return exact_quantiles(df, value, quantiles, by, method)


# Counters and gauges -------------------------------------------------------------------------------------------


def counter_increase(df: DataFrame, series: list[str], ts: str, value: str, seconds: int,
                     extrapolate: bool = True, slices: int = SLICES) -> DataFrame:
    """Increase and per-second rate of a counter per series and aligned window of `seconds`.

    A drop of the value is a reset and counts from 0. With `extrapolate` the increase is scaled from the sampled
    interval to the window, as far as 1.1 times the mean sample distance, and not below a zero counter.

    Samples only meet samples of their own time slice, `slices` to a window, so a hot series is many groups within a
    window too. A slice leaves one row with its first and last sample, and the step from one slice to the next is taken
    from these: `slices` rows at most for a series and window.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    samples = df.select(*series, at.alias("_t"), F.col(value).cast("double").alias("_v"))
    samples = samples.withColumn("_start", (F.floor(F.col("_t") / seconds) * seconds).cast("double"))
    by = [*series, "_start"]
    samples = samples.withColumn("_slice", F.floor((F.col("_t") - F.col("_start")) * slices / seconds))

    def step(before: Column, value: str) -> Column:
        return F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))

    within = step(F.lag("_v").over(W.partitionBy(*by, "_slice").orderBy("_t", "_v")), "_v")
    sliced = samples.withColumn("_d", within).groupBy(*by, "_slice").agg(
        F.count("*").alias("n"), F.sum("_d").alias("raw"), F.min("_t").alias("t0"), F.max("_t").alias("t1"),
        F.min_by("_v", F.struct("_t", "_v")).alias("_first"), F.max_by("_v", F.struct("_t", "_v")).alias("_last"))
    carried = step(F.lag("_last").over(W.partitionBy(*by).orderBy("_slice")), "_first")
    grouped = sliced.withColumn("_carried", carried).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("raw") + F.col("_carried")).alias("raw"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.min_by("_first", "_slice").alias("v0"),
    ).filter("n > 1 and t1 > t0")
    sampled = F.col("t1") - F.col("t0")
    mean_gap = sampled / (F.col("n") - 1)

    def edge(gap: Column) -> Column:
        return F.when(gap >= mean_gap * 1.1, mean_gap / 2).otherwise(gap)

    to_zero = F.when((F.col("raw") > 0) & (F.col("v0") >= 0), sampled * F.col("v0") / F.col("raw"))
    lead = F.least(edge(F.col("t0") - F.col("_start")), F.coalesce(to_zero, F.lit(float("inf"))))
    tail = edge(F.col("_start") + seconds - F.col("t1"))
    factor = (sampled + lead + tail) / sampled if extrapolate else F.lit(1.0)
    return grouped.select(
        *series, F.timestamp_seconds(F.col("_start").cast("bigint")).alias("window_start"),
        (F.col("raw") * factor).alias("increase"), (F.col("raw") * factor / seconds).alias("rate"))


def busy_ratio(rates: DataFrame, by: list[str], mode: str, idle: str = "idle", rate: str = "rate") -> DataFrame:
    """Share of the summed rates that is not idle, per group."""
    return rates.groupBy(*by).agg(
        F.try_divide(F.coalesce(F.sum(F.when(F.col(mode) != idle, F.col(rate))), F.lit(0.0)),
                     F.sum(rate)).alias("busy"))


def used_ratio(gauges: DataFrame, by: list[str], name: str, value: str, available: str, total: str) -> DataFrame:
    """1 - available / total of two gauges per group."""
    def gauge(which: str) -> Column:
        return F.max(F.when(F.col(name) == which, F.col(value)))

    return gauges.groupBy(*by).agg((1 - F.try_divide(gauge(available), gauge(total))).alias("used"))


def all_ready(pods: DataFrame, pod: str, phase: str, containers: str, ready: str = "ready") -> DataFrame:
    """Phase and readiness of a pod given as one row with an array of container states; no container is ready."""
    return pods.select(
        pod, F.coalesce(F.col(phase), F.lit("Unknown")).alias("phase"),
        F.coalesce(F.forall(F.col(containers), lambda c: c[ready]), F.lit(True)).alias("ready"))


def all_ready_rows(containers: DataFrame, pod: str, ready: str) -> DataFrame:
    """The same for one row per container; a null row (a pod without containers) is ready."""
    return containers.groupBy(pod).agg(F.coalesce(F.bool_and(ready), F.lit(True)).alias("ready"))


def consumer_lag(offsets: DataFrame, by: list[str], end: str = "end_offset", committed: str = "committed") -> DataFrame:
    return offsets.groupBy(*by).agg((F.sum(end) - F.sum(F.coalesce(F.col(committed), F.lit(0)))).alias("lag"))


def last_success_age(runs: DataFrame, ts: str, now: Column, by: list[str] | None = None) -> DataFrame:
    """Seconds since the last success."""
    return runs.groupBy(*(by or [])).agg(
        (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max(ts).cast("timestamp"))).alias("seconds"))


def dead_letter_depth(df: DataFrame, queue: str) -> DataFrame:
    return df.groupBy(queue).agg(F.count("*").alias("depth"))


# Alert repeats -------------------------------------------------------------------------------------------------


def suppress_repeats(alerts: DataFrame, by: list[str], ts: str, hours: float = REPEAT_HOURS,
                     last_sent: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The alerts that are sent: the first of a group, then the first at least `hours` after the last one sent.

    `last_sent` (`by`, `ts`) carries the last alert of earlier batches. Equal times of a group collapse first. A
    group of at most `fold_rows` times is folded in order; the times of a larger group are chained by
    `_sent_by_jumps`, which never puts the group into one task.
    """
    gap = int(hours * 3600 * 1_000_000)
    kind = alerts.schema[ts].dataType.simpleString()
    # A struct as the group key keeps groups with a null member: its members compare null-safe.
    group, micros = F.struct(*by).alias("_g"), F.unix_micros(F.col(ts).cast("timestamp"))
    times = alerts.select(group, micros.alias("_t")).distinct()
    if last_sent is not None:
        known = last_sent.groupBy(group).agg(F.max(micros).alias("_last"))
        times = (
            times.join(known, "_g", "left")
            .filter(F.col("_last").isNull() | (F.col("_t") >= F.col("_last") + gap)).drop("_last")
        )
    sizes = times.groupBy("_g").agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n").alias("n")).first()["n"] or 0
    if largest <= fold_rows:
        sent = _sent_by_fold(times, gap)
    else:
        sized = times.join(sizes, "_g")
        cold = _sent_by_fold(sized.filter(F.col("_n") <= fold_rows).drop("_n"), gap)
        hot = _sent_by_jumps(sized.filter(F.col("_n") > fold_rows).drop("_n"), gap)
        sent = cold.unionByName(hot)
    return sent.select("_g.*", F.timestamp_micros("_t").cast(kind).alias(ts))


def _sent_by_fold(times: DataFrame, gap: int) -> DataFrame:
    def keep(sent: Column, t: Column) -> Column:
        due = (F.size(sent) == 0) | (t >= F.try_element_at(sent, F.lit(-1)) + gap)
        return F.when(due, F.array_append(sent, t)).otherwise(sent)

    none = F.array().cast("array<bigint>")
    ordered = F.array_sort(F.collect_list("_t"))
    folded = times.groupBy("_g").agg(F.aggregate(ordered, none, keep).alias("_s"))
    return folded.select("_g", F.explode("_s").alias("_t"))


def _sent_by_jumps(times: DataFrame, gap: int) -> DataFrame:
    """Follow the chain "first time at least `gap` later" by pointer doubling.

    The successor of a time lies in the slice of `t + gap` or opens the next slice that has any time, so windows are
    cut by (group, slice) and stay small. Doubling joins on the unique (group, time); the number of rounds is the
    logarithm of the chain length.
    """
    slices = F.floor(F.col("_t") / max(gap // 16, 1))
    times = materialise(times)
    wanted = times.select("_g", F.col("_t").alias("_from"), (F.col("_t") + gap).alias("_t"), F.lit(0).alias("_is"))
    offered = times.select("_g", F.lit(None).cast("bigint").alias("_from"), "_t", F.lit(1).alias("_is"))
    # Descending order and a growing frame: the least offered time at or after the wanted one, in linear time.
    later = (W.partitionBy("_g", "_s").orderBy(F.desc("_t"), F.desc("_is"))
             .rowsBetween(W.unboundedPreceding, -1))
    in_slice = (
        wanted.unionByName(offered).withColumn("_s", slices)
        .withColumn("_to", F.min(F.when(F.col("_is") == 1, F.col("_t"))).over(later)).filter("_is = 0")
    )
    # Where the slice has no later time: the first time of the next slice that has one. One row per slice.
    opening = times.withColumn("_s", slices).groupBy("_g", "_s").agg(F.min("_t").alias("_open"))
    asked = in_slice.filter("_to is null").select("_g", "_s", F.lit(None).cast("bigint").alias("_open")).distinct()
    ahead = W.partitionBy("_g").orderBy(F.desc("_s")).rangeBetween(W.unboundedPreceding, -1)
    following = (
        opening.unionByName(asked).withColumn("_after", F.min("_open").over(ahead))
        .groupBy("_g", "_s").agg(F.min("_after").alias("_after"))
    )
    jumps = materialise(
        in_slice.join(following, ["_g", "_s"], "left")
        .select("_g", F.col("_from").alias("_t"), F.coalesce("_to", "_after").alias("_to"))
        .filter("_to is not null")
    )
    sent = times.groupBy("_g").agg(F.min("_t").alias("_t"))
    while not jumps.isEmpty():
        reached = sent.join(jumps, ["_g", "_t"]).select("_g", F.col("_to").alias("_t"))
        sent = materialise(sent.unionByName(reached).distinct())
        second = jumps.select("_g", F.col("_t").alias("_to"), F.col("_to").alias("_to2"))
        jumps = materialise(jumps.join(second, ["_g", "_to"]).select("_g", "_t", F.col("_to2").alias("_to")))
    return sent
