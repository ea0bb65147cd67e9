"""Logs that are folded in order: inquiries and projects, with recursive DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickline.functions.session import materialised, shared_folder, spread
from brickline.operators import statuslog, tenders
from brickline.operators.extraction import descriptions
from brickline.plans.tally_queries import POS, positions
from brickline.streaming import ingest, mailbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return put


# -- the log of inquiries: users are projects, their events the log's -----------------------

#: Expressions that Spark and DuckDB both read, of e (the event) and made (the user's last create).
KIND = "case event_type when 'signup' then 'create' when 'click' then 'status' when 'purchase' then 'offer' when 'view' then case when e % 2 = 0 then 'cleanup' else 'open' end else case when e % 7 = 0 then 'export' else 'content' end end"
COLUMNS = {
    "seq": "e", "project": "user_id", "kind": KIND,
    "inquiry_id": "case when event_type = 'signup' then e when e % 5 = 0 then -1 else made end",
    "position_id": "case when e % 17 = 0 and event_type = 'signup' then null else e % 3 end",
    "supplier_id": "e % 2", "number": "case when e % 4 = 0 then '1.1' end",
    "status": "case when event_type = 'signup' then case when e % 4 = 1 then 'angefragt' else 'offen' end else case e % 4 when 0 then 'angefragt' when 1 then 'angebot_erhalten' when 2 then 'offen' else 'quatsch' end end",
    "notes": "case when e % 3 <> 0 then concat('n', e) end",
}
FOLD = f"""ev AS (SELECT {', '.join(f'{x} AS {n}' for n, x in COLUMNS.items())}, row_number() OVER (PARTITION BY user_id ORDER BY e) AS n
FROM (SELECT event_id AS e, user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS made FROM events)),
st AS (SELECT DISTINCT project, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, pos BIGINT, sup BIGINT, number VARCHAR, status VARCHAR, notes VARCHAR)[]) AS inqs, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS code, false AS seen, false AS counted FROM ev
UNION ALL SELECT project, n, CASE WHEN code IS NOT NULL THEN inqs WHEN kind = 'create' THEN list_append(inqs, {{'id': inquiry_id, 'pos': position_id, 'sup': supplier_id, 'number': number, 'status': status, 'notes': CAST(NULL AS VARCHAR)}})
  WHEN kind = 'status' THEN list_transform(inqs, lambda x: CASE WHEN x.id = inquiry_id THEN {{'id': x.id, 'pos': x.pos, 'sup': x.sup, 'number': x.number, 'status': status, 'notes': coalesce(notes, x.notes)}} ELSE x END)
  WHEN kind = 'content' THEN list_transform(inqs, lambda x: CASE WHEN x.id = inquiry_id THEN {{'id': x.id, 'pos': x.pos, 'sup': x.sup, 'number': x.number, 'status': x.status, 'notes': coalesce(notes, x.notes)}} ELSE x END)
  WHEN kind = 'offer' THEN list_transform(inqs, lambda x: CASE WHEN x.id = inquiry_id THEN {{'id': x.id, 'pos': x.pos, 'sup': x.sup, 'number': x.number, 'status': 'angebot_erhalten', 'notes': x.notes}} ELSE x END)
  WHEN kind = 'cleanup' THEN list_filter(inqs, lambda x: NOT (x.pos IS NOT DISTINCT FROM position_id AND x.status = 'offen')) ELSE inqs END, seq, code, seen OR kind = 'open', counted OR kind = 'export'
FROM (SELECT st.project, ev.n, st.inqs, ev.seq, ev.kind, ev.inquiry_id, ev.position_id, ev.supplier_id, ev.number, ev.status, ev.notes, st.seen, st.counted,
  CASE WHEN ev.kind = 'create' THEN CASE WHEN ev.position_id IS NOT NULL AND len(list_filter(st.inqs, lambda x: x.pos = ev.position_id AND x.sup = ev.supplier_id AND x.status IN ('offen', 'angefragt'))) > 0 THEN 409 END
  WHEN ev.kind IN ('status', 'content') THEN CASE WHEN len(list_filter(st.inqs, lambda x: x.id = ev.inquiry_id)) = 0 THEN 404 WHEN ev.kind = 'status' AND ev.status = 'quatsch' THEN 400 END END AS code
  FROM st JOIN ev ON ev.project = st.project AND ev.n = st.n + 1)),
done AS (SELECT * FROM st WHERE n = (SELECT max(n) FROM ev WHERE ev.project = st.project)),
inq AS (SELECT project, unnest(inqs, recursive := true) FROM done)"""


def inquiry_log(spark: SparkSession, sf: str) -> DataFrame:
    last = Window.partitionBy("user_id").orderBy("event_id")
    made = F.last(F.when(c("event_type") == "signup", c("event_id")), ignorenulls=True).over(last)
    rows = spark.read.parquet(f"{sf}/events.parquet").select(c("event_id").alias("e"), "user_id", "event_type", made.alias("made"))
    return rows.selectExpr(*[f"{x} as {n}" for n, x in COLUMNS.items()])


@query(f"WITH RECURSIVE {FOLD} SELECT seq, code FROM st WHERE code IS NOT NULL")
def refused_events(spark, sf):
    log = inquiry_log(spark, sf)
    return statuslog.refused(log, statuslog.folded(log))


@query(f"WITH RECURSIVE {FOLD} SELECT project, pos AS position_id, sup AS supplier_id, id AS inquiry_id, number, status, notes FROM inq")
def inquiry_states(spark, sf):
    log = inquiry_log(spark, sf)
    return statuslog.inquiries(log, materialised(statuslog.folded(log)))


@query(f"""WITH RECURSIVE {FOLD}, p AS (SELECT project, count(*) AS n FROM inq a WHERE status IN ('offen', 'angefragt') AND NOT (status = 'offen' AND EXISTS (SELECT 1 FROM inq b WHERE b.project = a.project AND b.pos IS NOT DISTINCT FROM a.pos
  AND b.sup = a.sup AND b.number IS NOT DISTINCT FROM a.number AND b.status IN ('angefragt', 'angebot_erhalten'))) GROUP BY 1)
SELECT project, CAST(len(inqs) AS BIGINT) AS n_inquiries, coalesce(p.n, 0) AS n_pending, CASE WHEN p.n > 0 THEN 'anfrage_offen' WHEN counted THEN 'gerechnet' WHEN seen THEN 'offen' ELSE 'neu' END AS status FROM done LEFT JOIN p USING (project)""")
def project_states(spark, sf):
    log = inquiry_log(spark, sf)
    return statuslog.project_states(log, materialised(statuslog.folded(log)))


# -- the mailbox: events as messages of three batches ------------------------------------------

#: Expressions that Spark and DuckDB both read, of e (the event).
MESSAGE = {
    "message_id": "concat('m', case when e % 11 = 0 then e % 77 when e % 5 = 0 then e - 1 else e end)",
    "subject": "case when e % 101 = 0 then null when event_type = 'purchase' then concat('Re: TBX-INQ:', user_id) when event_type = 'error' then 'Unser Angebot' when event_type = 'signup' then 'Ausschreibung' when event_type = 'view' then 'Rechnung' else 'Newsletter' end",
    "sender": "concat('s', user_id, '@firma.de')",
    "body": "case when e % 101 = 0 then null when event_type = 'purchase' and e % 3 = 0 then concat('auch TBX-INQ ', user_id + 1) else 'Guten Tag' end",
    "sent_at": "ts",
    "n_attachments": "cast(0 as int)",
    "content_hash": "case when e % 101 = 0 then null when event_type in ('signup', 'view') then concat('h', e % 40) end",
}
MAIL = f"""m AS (SELECT e, {', '.join(f'{x} AS {n}' for n, x in MESSAGE.items())} FROM (SELECT event_id AS e, * FROM events)),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY e) = 1),
k AS (SELECT *, CASE WHEN subject LIKE 'Re:%' OR subject = 'Unser Angebot' THEN 'offer' WHEN subject = 'Ausschreibung' THEN 'new_document' ELSE 'ignored' END AS category FROM f WHERE subject IS NOT NULL),
named AS (SELECT DISTINCT message_id, e, unnest(list_transform(regexp_extract_all(subject || ' ' || body, 'TBX-INQ[: ]([0-9]+)', 1), lambda x: CAST(x AS BIGINT))) AS inquiry_id FROM k WHERE category = 'offer'),
hits AS (SELECT n.* FROM named n JOIN supplier ON s_suppkey = inquiry_id AND s_suppkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY inquiry_id ORDER BY e) = 1),
docs AS (SELECT * FROM k WHERE category = 'new_document' QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY e) = 1)"""


def received(spark: SparkSession, sf: str) -> mailbox.Mailbox:
    """The mailbox after the events, as messages that come in three batches.

    A batch is as many files as its rows are dealt to; the sync is called for each, and goes on
    where it ended, so that a batch is read, sorted and written by all cores."""
    folder = f"{shared_folder(spark)}/mailbox-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumns({"e": c("event_id"), "ts": c("ts").cast("timestamp")})
    # times may repeat or fall between messages: events count in the order of their numbers
    messages = rows.selectExpr("e as arrived", *[f"{x} as {n}" for n, x in MESSAGE.items()])
    last = rows.agg(F.max("e")).first()[0] or 0
    inquiries = spark.read.parquet(f"{sf}/supplier.parquet").select(
        c("s_suppkey").alias("inquiry_id"), F.when(c("s_suppkey") % 4 == 0, "angebot_erhalten").when(c("s_suppkey") % 4 == 1, "offen").otherwise("angefragt").alias("status")
    )
    box = mailbox.Mailbox(spark, folder, "wir@firma.de")
    for i in range(3):
        part = messages.where((c("arrived") >= last * i // 3 + (i > 0)) & (c("arrived") <= last * (i + 1) // 3))
        spread(part).write.parquet(f"{folder}/in/batch={i}")
        stream = ingest.message_stream(spark, f"{folder}/in/*", messages.schema, files_per_batch=None)
        mailbox.sync(stream, box, inquiries, f"{folder}/checkpoint")
    return box


@query(f"""WITH {MAIL} SELECT message_id AS message_key, category, CASE category WHEN 'offer' THEN CASE WHEN n IS NULL THEN 'unmatched' ELSE 'matched ' || n END
WHEN 'new_document' THEN CASE WHEN message_id IN (SELECT message_id FROM docs) THEN 'created' ELSE 'known' END ELSE 'ignored' END AS result FROM k LEFT JOIN (SELECT message_id, count(*) AS n FROM hits GROUP BY 1) USING (message_id)
UNION ALL SELECT message_id, 'failed', 'empty message' FROM f WHERE subject IS NULL""")
def mailbox_sync(spark, sf):
    box = received(spark, sf)
    return box.table("processed").unionByName(box.table("failed").select("message_key", F.lit("failed").alias("category"), c("problem").alias("result")))


@query(f"WITH {MAIL} SELECT inquiry_id, message_id AS message_key FROM hits")
def mailbox_offers(spark, sf):
    return received(spark, sf).table("offers").select("inquiry_id", "message_key")


# -- descriptions that refer to the line before ------------------------------------------------


@query(f"""WITH RECURSIVE {POS}, l AS (SELECT project, line, row_number() OVER (PARTITION BY project ORDER BY line) AS n, service, k % 5 <> 0 AND k % 7 <> 0 AS material, CASE k % 3 WHEN 0 THEN 'Bauteil ' || k WHEN 1 THEN 'wie zuvor' ELSE '' END AS own,
CASE k % 4 WHEN 0 THEN 'Abwasserkanal' WHEN 1 THEN 'Entwässerungsrinne' END AS label, CASE WHEN k % 2 = 0 THEN ', DN ' || (100 + k % 5 * 25) ELSE '' END || CASE WHEN k % 11 = 0 THEN ', PP' ELSE '' END AS details FROM kinds),
st AS (SELECT DISTINCT project, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS carry, CAST(NULL AS VARCHAR) AS text FROM l
UNION ALL SELECT project, n, line, CASE WHEN material THEN text ELSE carry END, text FROM (SELECT st.project, l.n, CAST(l.line AS BIGINT) AS line, l.material, st.carry, CASE WHEN service THEN own WHEN own LIKE 'Bauteil%' THEN own || details
ELSE coalesce(CASE WHEN carry NOT LIKE 'wie zuvor%' THEN split_part(carry, ',', 1) END, label, nullif(own, ''), 'Position') || details END AS text FROM st JOIN l ON l.project = st.project AND l.n = st.n + 1))
SELECT project, line, text AS description FROM st WHERE n > 0""")
def finalised_lines(spark, sf):
    rows = positions(spark, sf).selectExpr(
        "project", "line", "position_type", "case k % 3 when 0 then concat('Bauteil ', k) when 1 then 'wie zuvor' else '' end as description", "cast(null as string) as raw_text",
        "case k % 4 when 0 then 'Kanalrohre' when 1 then 'Rinnen' end as product_category", "cast(null as string) as product_subcategory",
        "cast(case when k % 2 = 0 then 100 + k % 5 * 25 end as int) as nominal_diameter_dn", "cast(null as int) as secondary_nominal_diameter_dn", "case when k % 11 = 0 then 'PP' end as material",
        "cast(null as int) as stiffness_class_sn", *[f"cast(null as string) as {n}" for n in ("norm", "load_class", "dimensions", "system_family", "reference_product")],
    )
    return descriptions.finalised(rows, "project", "line").select("project", c("line").cast("long").alias("line"), "description")


# -- two refreshes of the tenders --------------------------------------------------------------

#: Expressions that Spark and DuckDB both read, of k (a customer as a notice) and i (a city).
NOTICE = {
    "k": "k", "external_id": "concat('X', k % 700)", "title": "concat('Titel ', k)", "city": "case when k % 23 = 0 then null else concat(' Stadt ', k % 30) end",
    "relevance": "cast(k % 60 as int)", "source": "case when k % 5 = 0 then 'nrw' else 'ted' end",
}
STORED = {"external_id": "concat('S', k)", "title": "'alt'", "city": "concat('Stadt ', 9 + k % 8)", "lat": "50.7 + (k % 8 - 1) * 0.1e0", "lng": "7.1e0", "relevance": "cast(k as int)", "source": "'ted'"}
_NEAR = "(city = ' Stadt 25' OR CAST(trim(city[7:]) AS INTEGER) BETWEEN 0 AND 4 OR CAST(trim(city[7:]) AS INTEGER) BETWEEN 6 AND 14)"


def _saved(name: str, now: str, run: str, source: str) -> str:
    """One source's notices of one run put into now."""
    return f"""{name}_n AS (SELECT * FROM near WHERE source = '{source}' AND {run}),
{name} AS (SELECT coalesce(o.external_id, g.external_id) AS external_id, CASE WHEN o.external_id IS NULL THEN g.title ELSE o.title END AS title, coalesce(g.score, o.relevance) AS relevance, o.external_id IS NULL AS is_new
FROM {now} o FULL JOIN (SELECT external_id, arg_min(title, k) AS title, arg_max(relevance, k) AS score FROM {name}_n GROUP BY 1) g ON o.external_id = g.external_id)"""


_TENDERS = f"""near AS (SELECT k, external_id, title, CASE WHEN source = 'nrw' THEN greatest(relevance, 15) ELSE relevance END AS relevance, source FROM (SELECT {', '.join(f'{x} AS {n}' for n, x in NOTICE.items())} FROM (SELECT c_custkey AS k FROM customer))
WHERE {_NEAR} AND (source = 'nrw' OR relevance >= 10)),
s0 AS (SELECT {', '.join(f'{x} AS {n}' for n, x in STORED.items())} FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey <= 20)), s AS (SELECT * FROM s0 WHERE lat < 51.15),
{_saved('a', 's', 'k % 3 <> 0', 'nrw')}, {_saved('b', 'a', 'k % 3 <> 0', 'ted')}, {_saved('d', 'b', 'k % 3 = 0', 'nrw')}, {_saved('e', 'd', 'k % 3 = 0', 'ted')}"""


def refreshes(spark: SparkSession, sf: str) -> list[tenders.Refresh]:
    """Two refreshes, the second with other notices and the first one's tenders and places."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(c("c_custkey").alias("k"))
    notices = customers.selectExpr(*[f"{x} as {n}" for n, x in NOTICE.items()])
    stored = customers.where("k <= 20").selectExpr(*[f"{x} as {n}" for n, x in STORED.items()])
    cities = customers.selectExpr("k % 30 as i").distinct()
    # the cache has five cities, at the centre; the gazetteer twenty, these elsewhere
    places = cities.where("i < 5").selectExpr("concat('stadt ', i) as place", "50.7e0 as lat", "7.1e0 as lng")
    gazetteer = cities.where("i < 20").selectExpr("concat('Stadt ', i) as city", "case when i < 5 then 60e0 else 50.7e0 + (i - 10) * 0.1e0 end as lat", "7.1e0 as lng")
    out: list[tenders.Refresh] = []
    for part in ("k % 3 <> 0", "k % 3 = 0"):
        now, known = (out[-1].tenders, out[-1].places) if out else (stored, places)
        out.append(tenders.refresh(now, notices.where(part), known, gazetteer, "k", ("nrw", "ted"), (50.7, 7.1), 50.0, ("stadt 25",)))
    return out


@query(f"WITH {_TENDERS} SELECT external_id, title, relevance FROM e")
def tender_refresh(spark, sf):
    return refreshes(spark, sf)[-1].tenders.select("external_id", "title", "relevance")


@query(f"""WITH {_TENDERS}, n AS (SELECT 1 AS run, 'nrw' AS source, (SELECT count(*) FROM a_n) AS fetched, (SELECT count(*) FROM a WHERE is_new) AS new UNION ALL SELECT 1, 'ted', (SELECT count(*) FROM b_n), (SELECT count(*) FROM b WHERE is_new)
UNION ALL SELECT 2, 'nrw', (SELECT count(*) FROM d_n), (SELECT count(*) FROM d WHERE is_new) UNION ALL SELECT 2, 'ted', (SELECT count(*) FROM e_n), (SELECT count(*) FROM e WHERE is_new))
SELECT run, source, fetched, new, CASE run WHEN 1 THEN (SELECT count(*) FROM b) ELSE (SELECT count(*) FROM e) END AS total, CASE run WHEN 1 THEN (SELECT count(*) FROM s0) - (SELECT count(*) FROM s) ELSE 0 END AS removed
FROM (SELECT * FROM n UNION ALL SELECT run, NULL, CAST(sum(fetched) AS BIGINT), CAST(sum(new) AS BIGINT) FROM n GROUP BY 1)""")
def tender_refresh_counts(spark, sf):
    first, second = refreshes(spark, sf)
    return first.counts.withColumn("run", F.lit(1)).unionByName(second.counts.withColumn("run", F.lit(2)))
