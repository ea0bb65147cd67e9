"""The current state of inquiries and projects, folded from a log of events.

Events: seq (the order), project, kind and what the kind needs:

- create: inquiry_id (new), position_id, supplier_id, number, status (offen or angefragt).
  Refused (409) while the position has an inquiry to that supplier that is open or sent;
- status: inquiry_id, status, notes.  Refused for an unknown inquiry (404) or status (400);
- content: inquiry_id, notes.  Refused for an unknown inquiry (404);
- offer: inquiry_id.  The inquiry is answered; an unknown one changes nothing;
- cleanup: position_id.  Its open inquiries are deleted;
- open, export: of the project.

What an event does depends only on the inquiries of its position and supplier, so those
are the groups that are folded in order, side by side; a clean-up goes to each supplier of
its position.  A create without a position is never refused and is a group of its own.
A group is what one position asked of one supplier, so its events are few.

Nulls: an event without a project or a kind is left out; an inquiry_id that several creates
have belongs to the first.  Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickline.operators.export import PENDING, PROGRESSED, RECEIVED, WAITING
from brickline.operators.relational import without_superseded

c = F.col
#: An inquiry's statuses, and those that bar another inquiry.
STATUSES = ("offen", "angefragt", "angebot_erhalten")
BARRING = ("offen", "angefragt")
#: A project's statuses.
NEW, SEEN, ASKED, COUNTED = "neu", "offen", "anfrage_offen", "gerechnet"
INQUIRY = "array<struct<id:bigint,status:string,number:string>>"
LOG = "array<struct<seq:bigint,code:int>>"


def grouped(events: DataFrame) -> DataFrame:
    """Each event of an inquiry with its group: position_id, supplier_id, alone (the inquiry
    of a create without a position).  Events of unknown inquiries have no group."""
    known = events.where(c("project").isNotNull() & c("kind").isNotNull())
    made = known.where("kind = 'create'")
    first = made.groupBy("inquiry_id").agg(F.min_by(F.struct("project", "position_id", "supplier_id"), "seq").alias("g"))
    where = first.select(
        c("inquiry_id").alias("at_id"), c("g.project").alias("g_project"), c("g.position_id").alias("g_position"), c("g.supplier_id").alias("g_supplier"),
        F.when(c("g.position_id").isNull(), c("inquiry_id")).alias("g_alone"),
    )
    own = known.where(c("kind").isin("create", "status", "content", "offer")).join(where, c("inquiry_id") == c("at_id"), "left")
    sides = where.where("g_position is not null").select("g_project", "g_position", "g_supplier").distinct()
    swept = known.where("kind = 'cleanup'").join(sides, (c("project") == c("g_project")) & (c("position_id") == c("g_position")))
    return own.drop("at_id").unionByName(swept.withColumn("g_alone", F.lit(None).cast("bigint")))


def step(state: Column, event: Column) -> Column:
    """A group's inquiries and refusals after one more event."""
    inquiries, kind, id_ = state["inquiries"], event["kind"], event["inquiry_id"]
    there = F.exists(inquiries, lambda x: x["id"] == id_)
    set_to = lambda status: F.transform(inquiries, lambda x: F.when(x["id"] == id_, F.struct(x["id"].alias("id"), status.alias("status"), x["number"].alias("number"))).otherwise(x))
    barred = event["position_id"].isNotNull() & F.exists(inquiries, lambda x: x["status"].isin(*BARRING))
    code = (
        F.when(kind == "create", F.when(there | barred, 409))
        .when(kind.isin("status", "content") & ~there, 404)
        .when((kind == "status") & ~F.coalesce(event["status"].isin(*STATUSES), F.lit(False)), 400)
    )
    fresh = F.array(F.struct(id_.alias("id"), F.coalesce(event["status"], F.lit(WAITING)).alias("status"), event["number"].alias("number")))
    after = (
        F.when(code.isNotNull(), inquiries)
        .when(kind == "create", F.concat(inquiries, fresh))
        .when(kind == "status", set_to(event["status"]))
        .when(kind == "offer", set_to(F.lit(RECEIVED)))
        .when(kind == "cleanup", F.filter(inquiries, lambda x: x["status"] != WAITING))
        .otherwise(inquiries)
    )
    log = F.when(code.isNotNull(), F.concat(state["log"], F.array(F.struct(event["seq"].alias("seq"), code.alias("code"))))).otherwise(state["log"])
    return F.struct(after.cast(INQUIRY).alias("inquiries"), log.cast(LOG).alias("log"))


def folded(events: DataFrame) -> DataFrame:
    """g_project, g_position, g_supplier, g_alone, state (inquiries, log) of each group."""
    keys = ["g_project", "g_position", "g_supplier", "g_alone"]
    one = F.struct("seq", "kind", "inquiry_id", "position_id", "number", "status")
    rows = grouped(events).where("g_project is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("events"))
    start = F.struct(F.expr(f"cast(array() as {INQUIRY})").alias("inquiries"), F.expr(f"cast(array() as {LOG})").alias("log"))
    return rows.select(*keys, F.aggregate("events", start, step).alias("state"))


def refused(events: DataFrame, state: DataFrame) -> DataFrame:
    """seq, code of every event that changed nothing because it isn't allowed."""
    lost = grouped(events).where(c("g_project").isNull() & c("kind").isin("status", "content")).select("seq", F.lit(404).alias("code"))
    return state.select(F.explode("state.log").alias("x")).select("x.seq", "x.code").unionByName(lost)


def inquiries(events: DataFrame, state: DataFrame) -> DataFrame:
    """project, position_id, supplier_id, inquiry_id, number, status, notes: what there is in the
    end; notes are the last that an accepted event gave."""
    now = state.select(c("g_project").alias("project"), c("g_position").alias("position_id"), c("g_supplier").alias("supplier_id"), F.explode("state.inquiries").alias("x")).select(
        "project", "position_id", "supplier_id", c("x.id").alias("inquiry_id"), c("x.number").alias("number"), c("x.status").alias("status")
    )
    noted = events.where(c("notes").isNotNull() & c("kind").isin("status", "content")).join(refused(events, state).select("seq"), "seq", "left_anti")
    return now.join(noted.groupBy("inquiry_id").agg(F.max_by("notes", "seq").alias("notes")), "inquiry_id", "left")


def project_states(events: DataFrame, state: DataFrame) -> DataFrame:
    """project, n_inquiries, n_pending, status: pending inquiries go before a counted offer,
    that before having been seen."""
    keys = ["project", "position_id", "supplier_id", "number"]
    now = inquiries(events, state).select(*keys, "status")
    left = without_superseded(now, keys, c("status") == WAITING, c("status").isin(*PROGRESSED))
    pending = left.groupBy("project").agg(F.count_if(c("status").isin(*PENDING)).alias("n_pending"))
    every = now.groupBy("project").agg(F.count("*").alias("n_inquiries"))
    own = events.where(c("project").isNotNull() & c("kind").isNotNull()).groupBy("project").agg(F.bool_or(c("kind") == "export").alias("counted"), F.bool_or(c("kind") == "open").alias("seen"))
    all_ = own.join(every, "project", "left").join(pending, "project", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_inquiries", "n_pending")})
    status = F.when(c("n_pending") > 0, ASKED).when(c("counted"), COUNTED).when(c("seen"), SEEN).otherwise(NEW)
    return all_.select("project", "n_inquiries", "n_pending", status.alias("status"))
