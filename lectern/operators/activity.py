"""What event logs tell: heatmaps, recent items, streaks, rates, spaced repetition, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASE, LEAST_EASE = 2.5, 1.3


def heatmap(log: DataFrame, ts: str, last: str, days: int = 371) -> DataFrame:
    """(day, n): events of each day in the window that ends with last."""
    day = F.to_date(ts)
    end = F.to_date(F.lit(last))
    return log.where((day <= end) & (day > F.date_sub(end, days))).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def recent(log: DataFrame, key: str, ts: str, item: str, limit: int) -> DataFrame:
    """The latest items of each key: an item counts once, by its last event."""
    last = log.groupBy(key, item).agg(F.max(ts).alias("last"))
    w = Window.partitionBy(key).orderBy(F.desc("last"), item)
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def streaks(log: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, days, longest, current): distinct active days, the longest unbroken run and the one that ends last."""
    day = log.select(key, F.to_date(ts).alias("day")).distinct()
    run = day.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day"))))
    runs = run.groupBy(key, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.sum("n").alias("days"), F.max("n").alias("longest"), F.max_by("n", "last").alias("current"))


# Rates in words a minute that count as measured, and what an event of the two kinds weighs.
PLAUSIBLE_RATES = (80, 220)
PREACHED, REHEARSED = 2, 1


def speaking_rate(events: DataFrame, key: str, ts: str, words: str, seconds: str, preached: Column, latest: int = 10) -> DataFrame:
    """(key, rate, preachings, rehearsals): words a minute over the latest timed events of each key, preaching weighing double.

    Of the latest events with words and a duration (ties by event_id), those with an implausible rate are left out. Null with under
    two events left; keys without a plausible event have no row.
    """
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id"))
    timed = events.where((F.col(seconds) > 0) & (F.col(words) > 0)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= latest)
    rated = timed.withColumns({"rate": F.col(words) * 60.0 / F.col(seconds), "weight": F.when(preached, PREACHED).otherwise(REHEARSED), "is_preached": preached.cast("int")}).where(F.col("rate").between(*PLAUSIBLE_RATES))
    out = rated.groupBy(key).agg((F.sum(F.col("rate") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("is_preached").alias("preachings"), F.count("*").alias("n"))
    return out.select(key, F.when(F.col("n") >= 2, F.floor(F.round("mean", 6) + 0.5)).cast("long").alias("rate"), "preachings", (F.col("n") - F.col("preachings")).alias("rehearsals"))


def sm2(state: Column, quality: Column) -> Column:
    """One review by the SM-2 rules: state has ease, interval (days) and reps; quality under 3 starts again."""
    miss = F.lit(5) - quality
    ease = F.greatest(state["ease"] + 0.1 - miss * (miss * 0.02 + 0.08), F.lit(LEAST_EASE))
    interval = F.when(state["reps"] == 0, 1).when(state["reps"] == 1, 6).otherwise(F.round(state["interval"] * state["ease"]))
    failed = quality < 3
    return F.struct(ease.alias("ease"), F.when(failed, 1).otherwise(interval).cast("int").alias("interval"), F.when(failed, 0).otherwise(state["reps"] + 1).cast("int").alias("reps"))


def memory_state(reviews: DataFrame, key: str, ts: str, quality: str) -> DataFrame:
    """(key, ease, interval, reps, due): each card after all its reviews, folded in order of time."""
    ordered = reviews.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col("event_id").alias("id"), F.col(quality).cast("int").alias("q")))).alias("log"))
    start = F.struct(F.lit(EASE).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("reps"))
    end = F.aggregate("log", start, lambda s, r: sm2(s, r["q"]))
    out = ordered.select(key, end.alias("s"), F.to_date(F.element_at("log", -1)["ts"]).alias("day"))
    return out.select(key, F.round("s.ease", 6).alias("ease"), F.col("s.interval").alias("interval"), F.col("s.reps").alias("reps"), F.date_add("day", F.col("s.interval")).alias("due"))


def passage_parts(first: int, last: int, size: int) -> list[tuple[int, int]]:
    """A passage in parts of at most size verses; a lone last verse joins the part before."""
    starts = list(range(first, last + 1, size))
    if len(starts) > 1 and starts[-1] == last:
        starts.pop()
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], last + 1], strict=True)]


def next_part(parts: list[tuple[int, int]], successes: list[int], learned: int = 2) -> tuple[int, int] | None:
    """The first part without enough successes; the whole passage once all have them; none when that has them too."""
    for part, n in zip(parts, successes, strict=False):
        if n < learned:
            return part
    if len(parts) > 1 and (len(successes) <= len(parts) or successes[len(parts)] < learned):
        return parts[0][0], parts[-1][1]
    return None


def weekday_schedule(start: Column, days: Column, weekdays: list[int]) -> Column:
    """The first `days` dates from start that fall on the weekdays (0 Monday to 6 Sunday)."""
    span = F.sequence(start, F.date_add(start, (days * 7 + 7).cast("int")))
    on = F.filter(span, lambda d: F.weekday(d).isin(weekdays))
    return F.slice(on, F.lit(1), days.cast("int"))


def spread(items: DataFrame, place: Column, total: Column, dates: Column) -> DataFrame:
    """Items dealt evenly over an array of dates: item i of n goes to date i * m div n."""
    return items.withColumn("date", F.get(dates, F.floor(place * F.size(dates) / total).cast("int")))


def distinct_days(log: DataFrame, key: str, ts: str, last: str, days: int = 30) -> DataFrame:
    """(key, days): distinct active days in the window that ends with last."""
    day = F.to_date(ts)
    end = F.to_date(F.lit(last))
    return log.where((day <= end) & (day > F.date_sub(end, days))).groupBy(key).agg(F.countDistinct(day).alias("days"))


def weekly(log: DataFrame, ts: str) -> DataFrame:
    """(week, weekday, n): the activity grid; weeks start on Monday."""
    return log.groupBy(F.to_date(F.date_trunc("week", ts)).alias("week"), F.weekday(ts).alias("weekday")).agg(F.count("*").alias("n"))


def dashboard(log: DataFrame, ts: str, kind: str, key: str) -> DataFrame:
    """(kind, n, users, days): one row for each kind of event."""
    return log.groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct(key).alias("users"), F.countDistinct(F.to_date(ts)).alias("days"))
