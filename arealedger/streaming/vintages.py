"""Streams over landed vintages and events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quarters import quarter_ord


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts by event type and window; rows later than `late` are left out when streamed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def quarter_counts(events: DataFrame) -> DataFrame:
    """Counts by calendar quarter, which no window duration can say."""
    return events.groupBy(quarter_ord(F.to_date("ts")).alias("q"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def append_new(stream: DataFrame, keys: list[str], target: str, checkpoint: str):
    """Append rows whose key `target` doesn't hold yet; rows of one key that come together all go in.

    What is there already is looked up in `target` itself, batch by batch, so no key is kept as state. Each micro-batch is
    written once under its number, so a repeated batch replaces itself.
    """
    def put(batch: DataFrame, number: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(target).where(F.col("batch") < number).select(*keys).distinct()
            batch = batch.join(known, keys, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_manifest(stream: DataFrame, target: str, checkpoint: str):
    """Counts (as_of, kind, ym, n) of landed records: a batch writes those of its own rows under its number, and a day's
    manifest is their sum, so a repeated batch replaces its own part. `ingest_days` recounts a day whole instead."""
    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("as_of", "kind", "ym").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark, target: str) -> DataFrame:
    """(as_of, kind, ym, n) over all batches."""
    return spark.read.parquet(target).groupBy("as_of", "kind", "ym").agg(F.sum("n").alias("n"))


def put_days(batch: DataFrame, number: int, keys: list[str], target: str, counts: str) -> None:
    """Write the rows of batch `number` whose key earlier batches don't hold, and recount each day (as_of) that it has rows of.

    Rows lie by day and batch, so a batch that runs again, after a failure anywhere, replaces its own part; it looks up its
    days only. A day's counts (as_of, kind, ym, n) are taken from all of its rows and replace the day's partition whole.
    """
    spark, batch = batch.sparkSession, batch.persist()
    days = [r["as_of"] for r in batch.select("as_of").distinct().collect()]  # a batch has a few days
    fresh = batch
    try:
        held = spark.read.parquet(target)
        held = held.withColumn("as_of", F.col("as_of").cast(batch.schema["as_of"].dataType)).where(F.col("as_of").isin(days))
        fresh = batch.join(held.where(F.col("batch") < number).select(*keys).distinct(), keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    part = lambda df, path, *by: df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    part(fresh.withColumn("batch", F.lit(number)), target, "as_of", "batch")
    whole = spark.read.parquet(target).withColumn("as_of", F.col("as_of").cast(batch.schema["as_of"].dataType))
    whole = whole.where(F.col("as_of").isin(days) & (F.col("batch") <= number))
    part(whole.groupBy("as_of", "kind", "ym").agg(F.count(F.lit(1)).alias("n")), counts, "as_of")
    batch.unpersist()


def ingest_days(stream: DataFrame, keys: list[str], target: str, counts: str, checkpoint: str):
    """Land a stream by day and recount its days, batch by batch, as `put_days` does. Rows of one key that come together all go in."""
    put = lambda batch, number: put_days(batch, number, keys, target, counts)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_eligibility(sales: DataFrame, least: int = 20, width: int = 4, ahead: int = 0, first: int | None = None, keep: int = 12, ts: str | None = None):
    """(dong, q, n_4q, eligible) as sales (dong, q) stream in: a row for every quarter that new sales change.

    State of a dong are its counts of the last `keep` quarters and of the window before them; later rows are lost. Quarters
    from the dong's first sale to its latest come out without gaps, and `ahead` more, of which it says what is known. Before
    `width` quarters have passed since `first` a count is null and nothing is eligible. With ts (a time with a watermark) a
    dong without sales for `keep` quarters is forgotten. A row replaces an earlier one of its dong and quarter.
    """
    import pandas as pd

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        before = max(counts, default=None)
        new: dict[int, int] = {}
        for pdf in batches:
            for q, n in pdf["q"].value_counts().items():
                new[int(q)] = new.get(int(q), 0) + int(n)
        last = max([*new, *([] if before is None else [before])])
        new = {q: n for q, n in new.items() if q > last - keep}
        for q, n in new.items():
            counts[q] = counts.get(q, 0) + n
        start = min([*new, *([] if before is None else [before + 1 + ahead])], default=last)
        counts = {q: n for q, n in counts.items() if q > last - keep - width}
        state.update((list(counts), list(counts.values())))
        if ts:
            end = pd.Timestamp(year=(last + keep + 1) // 4, month=(last + keep + 1) % 4 * 3 + 1, day=1)
            state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        qs = list(range(start, last + ahead + 1))
        totals = [sum(counts.get(q - i, 0) for i in range(width)) for q in qs]
        known = [first is None or q >= first + width - 1 for q in qs]
        yield pd.DataFrame({"dong": key[0], "q": qs, "n_4q": pd.array([n if k else None for n, k in zip(totals, known, strict=True)], "Int64"), "eligible": [k and n >= least for n, k in zip(totals, known, strict=True)]})

    return sales.groupBy("dong").applyInPandasWithState(update, "dong string, q int, n_4q bigint, eligible boolean", "qs array<int>, ns array<bigint>", "update", "EventTimeTimeout" if ts else "NoTimeout")


def latest_rows(stream: DataFrame, target: str, checkpoint: str):
    """Write an update stream's batches; `latest` reads the last row of each key."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, keys: list[str], target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_r")).select(*keys, "_r.*")


def arrival_curve(arrivals: DataFrame) -> DataFrame:
    """Share of a quarter's final count that was visible by each day (q, day, n)."""
    from pyspark.sql import Window

    w = Window.partitionBy("q")
    return arrivals.select("q", "day", (F.sum("n").over(w.orderBy("day")) / F.sum("n").over(w)).alias("share"))
