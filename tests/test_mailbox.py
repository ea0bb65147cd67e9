"""The mailbox sync: repeated and cut-off batches, repeated and unreadable messages."""

import datetime

import pytest

from brickline.streaming import ingest, mailbox

MESSAGES = "message_id string, subject string, sender string, body string, sent_at timestamp, n_attachments int, content_hash string"
FILES = [
    [("m1", "Angebot TBX-INQ:1", "a@x.de", "unser Preis", 1, 0, None), ("m1", "Angebot TBX-INQ:1", "a@x.de", "unser Preis", 1, 0, None), ("m2", "Ausschreibung", "b@x.de", None, 2, 1, "h1")],
    [("m3", "Angebot TBX-INQ:2 und TBX-INQ:1", "a@x.de", "", 3, 0, None), (None, None, "c@x.de", None, 4, 0, None), ("m2", "Ausschreibung", "b@x.de", None, 4, 1, "h1")],
    [("m4", "Ausschreibung neu", "b@x.de", None, 5, 1, "h1"), ("m5", "[DEMO] Anfrage: X TBX-INQ:3", "wir@x.de", "[Demo-Weiterleitung]", 6, 0, None), (None, "Newsletter", None, "Hallo", 7, 0, None)],
]
PROCESSED = {("m1", "offer", "matched 1"), ("m2", "new_document", "created"), ("m3", "offer", "matched 1"), ("m4", "new_document", "known"), ("m5", "ignored", mailbox.OWN_COPY)}


def tables(box):
    return {n: sorted(map(repr, box.table(n).collect())) for n in mailbox.TABLES}


def start(spark, folder):
    rows = [[(*m[:4], datetime.datetime(2024, 1, m[4]), *m[5:]) for m in file] for file in FILES]
    for i, file in enumerate(rows):
        spark.createDataFrame(file, MESSAGES).coalesce(1).write.parquet(f"{folder}/in/file={i}")
    stream = ingest.message_stream(spark, f"{folder}/in/*", spark.createDataFrame([], MESSAGES).schema, files_per_batch=1)
    inquiries = spark.createDataFrame([(1, "offen"), (2, "angefragt"), (3, "offen")], "inquiry_id long, status string")
    return stream, inquiries


def test_a_cut_off_batch_leaves_the_same_tables(spark, tmp_path):
    stream, inquiries = start(spark, tmp_path / "a")
    whole = mailbox.Mailbox(spark, str(tmp_path / "a/box"), "wir@x.de")
    mailbox.sync(stream, whole, inquiries, str(tmp_path / "a/checkpoint"))
    want = tables(whole)
    got = {tuple(r) for r in whole.table("processed").collect()}
    assert {r for r in got if not r[0].startswith("fallback-")} == PROCESSED and len(got) == 6
    assert sorted(tuple(r)[:2] for r in whole.table("offers").collect()) == [(1, "m1"), (2, "m3")] and whole.table("failed").count() == 1

    class CutOff(mailbox.Mailbox):
        left = 1

        def write(self, name, batch, rows):
            out = super().write(name, batch, rows)
            if batch == 1 and name == "offers" and self.left:
                self.left = 0
                raise RuntimeError("cut off")
            return out

    stream, inquiries = start(spark, tmp_path / "b")
    box = CutOff(spark, str(tmp_path / "b/box"), "wir@x.de")
    with pytest.raises(Exception, match="cut off"):
        mailbox.sync(stream, box, inquiries, str(tmp_path / "b/checkpoint"))
    assert box.table("offers").count() == 2 and box.table("processed").count() == 2
    mailbox.sync(stream, box, inquiries, str(tmp_path / "b/checkpoint"))
    assert tables(box) == want
    # a batch that comes once more
    again = spark.read.schema(MESSAGES).parquet(f"{tmp_path}/b/in/file=1").withColumn("message_key", mailbox.message_key(*[mailbox.c(x) for x in ("message_id", "subject", "sender", "body")]))
    box.receive(again, 1, inquiries)
    assert tables(box) == want
    box.receive(again.limit(0), 9, inquiries)
    assert tables(box) == want


def test_a_batch_of_events_is_dealt_over_many_files(spark, tmp_path):
    from pathlib import Path

    from brickline.plans import log_queries

    kinds = "element_at(array('purchase', 'error', 'signup', 'view', 'click'), cast(1 + id % 5 as int))"
    spark.range(900).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id) as ts", "id % 90 as user_id", f"{kinds} as event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(90).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    box = log_queries.received(spark, str(tmp_path))
    for i in range(3):
        assert len(list(Path(box.folder, "in", f"batch={i}").glob("*.parquet"))) >= spark.sparkContext.defaultParallelism
    assert sorted(f.name for f in Path(box.folder, "processed").glob("batch=*")) == ["batch=-1", "batch=0", "batch=1", "batch=2"]
    import duckdb

    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("mailbox_sync", "mailbox_offers"):
        df = log_queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({log_queries.ORACLE[name]})").fetchall())


def test_messages_count_in_the_order_of_arrival_whatever_their_times(spark, tmp_path):
    import duckdb

    from brickline.plans import log_queries

    kinds = "element_at(array('purchase', 'error', 'signup', 'view', 'click'), cast(1 + id % 5 as int))"
    # times fall and repeat as numbers rise
    spark.range(900).selectExpr("id as event_id", "timestamp_seconds(1700000000 - id div 2) as ts", "id % 40 as user_id", f"{kinds} as event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(90).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("mailbox_sync", "mailbox_offers"):
        df = log_queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({log_queries.ORACLE[name]})").fetchall())
