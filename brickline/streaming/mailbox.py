"""Mailbox sync: a stream of messages into tables of offers, statuses and projects.

Each micro-batch writes its rows of every table to that table's folder of the batch, and
overwrites what an earlier attempt at the same batch left there; tables are read without
the batch at hand and later ones.  So a batch that is repeated, or was cut off between two
tables, leaves the same rows.  A message counts once by its key: of a batch's the first that came,
whatever the order in which its files are read, and none whose key the tables of processed
and failed messages have.  So no state of the stream has to be kept, and no message is too
late.  A message that can't be read goes to the table of failures instead of being lost.

Messages: message_id, subject, sender, body, sent_at, n_attachments, content_hash (of an
attached document, or null), and may have arrived, their number in the mail box.  They count in
the order of arrival, as a box is read; without a number in a batch, of sent_at and key: an
inquiry is answered by its first offer, a document makes one project.

Nulls: a message without subject, body and document is a failure; a null sent_at comes
first.  Repeated messages count once; an empty batch writes empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickline.functions.text import message_key
from brickline.operators.export import PENDING, RECEIVED
from brickline.operators.inquiries import inquiry_references
from brickline.streaming.ingest import classified, is_own_copy

c = F.col
TABLES = {
    "inbox": "message_key string, subject string, sender string, body string, sent_at timestamp, n_attachments int, content_hash string, arrived long, category string, problem string",
    "offers": "inquiry_id long, message_key string, sender string, text string, sent_at timestamp",
    "statuses": "inquiry_id long, status string, sent_at timestamp",
    "projects": "content_hash string, message_key string, subject string",
    "failed": "message_key string, subject string, sender string, problem string",
    "processed": "message_key string, category string, result string",
}
#: Why a message is no one's.
OWN_COPY, EMPTY = "outbound_demo_copy", "empty message"


class Mailbox:
    """The tables of a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, own_address: str = ""):
        self.spark, self.folder, self.own_address = spark, folder.rstrip("/"), own_address
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}/batch=-1")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table, or what was in it before a batch."""
        rows = self.spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{self.folder}/{name}")
        return (rows if before is None else rows.where(c("batch") < before)).drop("batch")

    def write(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write a batch's rows of a table in place of any there, and read them back."""
        path = f"{self.folder}/{name}/batch={batch}"
        columns = [x.strip().split()[0] for x in TABLES[name].split(",")]
        rows.select(*columns).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def receive(self, batch: DataFrame, number: int, inquiries: DataFrame) -> None:
        """One micro-batch; inquiries: inquiry_id, status, as they were before the first batch."""
        if "arrived" not in batch.columns:
            batch = batch.withColumn("arrived", F.lit(None).cast("long"))
        order = Window.partitionBy("message_key").orderBy("arrived", "sent_at", "subject", "sender", "body")
        first = batch.withColumn("nth", F.row_number().over(order)).where("nth = 1")
        fresh = first.join(self.table("processed", number).select("message_key"), "message_key", "left_anti").join(
            self.table("failed", number).select("message_key"), "message_key", "left_anti"
        )
        kind = classified(c("subject"), c("body"), c("content_hash").isNotNull())
        own = is_own_copy(c("subject"), c("sender"), c("body"), c("n_attachments"), self.own_address)
        nothing = c("subject").isNull() & c("body").isNull() & c("content_hash").isNull()
        read = fresh.withColumns({
            "category": F.when((kind == "offer") & own, "ignored").otherwise(kind),
            "problem": F.when(nothing, EMPTY).when((kind == "offer") & own, OWN_COPY),
        })
        inbox = self.write("inbox", number, read)
        good = inbox.where(~c("problem").eqNullSafe(EMPTY))
        self.write("failed", number, inbox.where(c("problem").eqNullSafe(EMPTY)))
        named = good.where("category = 'offer'").withColumn("inquiry_id", F.explode(inquiry_references(F.concat_ws("\n", "subject", "body"))))
        answered = self.table("statuses", number).select("inquiry_id").distinct()
        waiting = inquiries.where(c("status").isin(*PENDING)).select("inquiry_id").distinct().join(answered, "inquiry_id", "left_anti")
        by_time = lambda key: Window.partitionBy(key).orderBy("arrived", "sent_at", "message_key")
        hits = named.join(waiting, "inquiry_id").withColumn("nth", F.row_number().over(by_time("inquiry_id"))).where("nth = 1")
        offers = self.write("offers", number, hits.withColumn("text", F.substring(F.coalesce("body", "subject"), 1, 2200)))
        self.write("statuses", number, offers.withColumn("status", F.lit(RECEIVED)))
        documents = good.where("category = 'new_document'").withColumn("nth", F.row_number().over(by_time("content_hash"))).where("nth = 1")
        known = self.table("projects", number).select("content_hash").distinct()
        projects = self.write("projects", number, documents.join(known, "content_hash", "left_anti"))
        counts = offers.groupBy("message_key").agg(F.count("*").alias("n")).unionByName(projects.select("message_key", F.lit(1).cast("long").alias("n")))
        done = good.join(counts, "message_key", "left").withColumn("result", (
            F.when(c("category") == "offer", F.when(c("n").isNull(), F.lit("unmatched")).otherwise(F.format_string("matched %d", "n")))
            .when(c("category") == "new_document", F.when(c("n").isNull(), F.lit("known")).otherwise(F.lit("created"))).otherwise(F.coalesce("problem", F.lit("ignored")))
        ))
        # last: what stands here is done
        self.write("processed", number, done)


def sync(messages: DataFrame, mailbox: Mailbox, inquiries: DataFrame, checkpoint: str) -> None:
    """Receive all that a stream has and stop; a later call goes on where this one ended."""
    keyed = messages.withColumn("message_key", message_key(c("message_id"), c("subject"), c("sender"), c("body")))
    query = (
        keyed.writeStream.foreachBatch(lambda batch, number: mailbox.receive(batch, number, inquiries))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
