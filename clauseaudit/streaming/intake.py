"""Auditing documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from clauseaudit.operators import rules
from clauseaudit.sources.reference import ReferenceData


def stream_audit(spark: SparkSession, source: str, schema: StructType, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Read Parquet files of documents (doc_id, text, intake_ts) as they appear and append each batch's findings to ``sink``.  Without an
    intake_ts the time is that of the file's last change.

    A document that arrives again within the delay is taken once.  A document is one row, so document-scope rules see all of it
    in one batch.  A batch overwrites its own folder when it is run again after a failure, so findings appear once."""
    docs = spark.readStream.schema(schema).parquet(source)
    if "intake_ts" not in schema.names:
        docs = docs.withColumn("intake_ts", F.col("_metadata.file_modification_time"))
    docs = docs.withWatermark("intake_ts", delay).dropDuplicatesWithinWatermark(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gather_pages(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of pages (doc_id, page_number, page_count, text, intake_ts) to whole documents: all pages of a document at once, with ``complete``.

    State keeps a document's pages until there are ``page_count`` of them (the greatest that its pages name), or until event time has passed its
    newest page by ``delay``; then what is there is given, not complete.  A page that arrives again is taken once: the first one counts.  A document
    that was given is remembered for another delay, so its repeated and late pages open no second one; pages older than the watermark
    are left out.  Pages without a document, number or time are left out.  A document's pages are held in one task, as a document must be to be assembled."""
    doc = pages.schema["doc_id"].dataType.simpleString()
    wait_ms = int(pd.Timedelta(delay) / pd.Timedelta(milliseconds=1))

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, wanted, newest, given = state.get if state.exists else ([], [], 0, 0, False)
        held = dict(zip(numbers, texts))
        over = state.hasTimedOut
        if over and given:
            state.remove()
            return
        for p in parts:
            for number, count, text, ts in zip(p["page_number"], p["page_count"], p["text"], p["intake_ts"]):
                held.setdefault(int(number), text)
                wanted, newest = max(wanted, 0 if pd.isna(count) else int(count)), max(newest, int(ts.timestamp() * 1000))
        complete = 0 < wanted <= len(held)
        out = None
        if not given and (complete or over):
            order = sorted(held)
            out = pd.DataFrame({"doc_id": [key[0]] * len(order), "page_number": order, "text": [held[n] for n in order], "complete": complete})
            given = True
        if given:
            held = {}
        state.update((list(held), list(held.values()), wanted, newest, given))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + wait_ms + 1)
        if out is not None:
            yield out

    sound = pages.where("doc_id is not null and page_number is not null and intake_ts is not null").select("doc_id", F.col("page_number").cast("int"), F.col("page_count").cast("int"), "text", "intake_ts")
    return sound.withWatermark("intake_ts", delay).groupBy("doc_id").applyInPandasWithState(
        gather, f"doc_id {doc}, page_number int, text string, complete boolean", "numbers array<int>, texts array<string>, wanted int, newest bigint, given boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_pages(
    spark: SparkSession, source: str, schema: StructType, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], reference: Callable[[], ReferenceData], sink: str, checkpoint: str,
    delay: str = "1 hour", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Audit documents whose pages arrive as Parquet files, under all rules, and append their findings to ``sink``, once each.

    ``extract`` makes clauses, citations and mentions of a batch's pages (doc_id, page_number, text, complete); ``reference`` is read once a batch, so a
    batch sees one version of it.  A document comes whole in one batch, so the rules that look at whole documents see all of it.  A batch
    that is run again after a failure overwrites its own folder."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            known = reference()
            rules.room_for_texts(known, batch.sparkSession)
            f = rules.shared(rules.build_facts(*extract(batch), known))
            rules.evaluate(f, tuple(rules.RULES), share=False).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            rules.release(f)
        batch.unpersist()

    return gather_pages(pages, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
