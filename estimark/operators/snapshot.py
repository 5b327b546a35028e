"""The room view: persons, tasks and their votes as one nested row per room.

Built bottom-up with one aggregation per level (votes per task, tasks per
room, persons per room); ``collect_list`` has no order of its own, so each
list is sorted by its ordinal with ``array_sort``.  Rooms that are unknown or
inactive get ``error = 'UnknownRoom'`` and NULL elsewhere, as the view's
ISNULL fallback does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators.members import connected_persons, person_ordinals
from estimark.operators.scan import running
from estimark.operators.votes import vote_ordinals

UNKNOWN_ROOM = "UnknownRoom"


def _sorted_list(struct_col, key: str):
    """``collect_list`` sorted by ``key``, which must be the struct's first
    field: structs order field by field, so ``sort_array`` (no lambda) does it."""
    return F.sort_array(F.collect_list(struct_col))


PAGE_CELLS = 10000


def room_snapshot(rooms: DataFrame, persons: DataFrame, connections: DataFrame, tasks: DataFrame,
                  votes: DataFrame, results: DataFrame, page_cells: int = PAGE_CELLS) -> DataFrame:
    """Room views, one row per (room, page):
    room_id, page, error, NameRoom, Persons ARRAY<STRUCT<Id, UserName>>,
    Tasks ARRAY<STRUCT<Id, NameTask, Completed, IsCurrentActive, TimeDiscussion, Median, Continued,
    PersonTask ARRAY<STRUCT<PersonId, Vote, Score>>>>.

    A room's view is cut into pages so that no row (and no task building it)
    grows with the room: the (task, vote) cells of a room are numbered in view
    order (task ordinal, then vote ordinal) and each page holds at most
    ``page_cells`` cells; persons are paged the same way.  A task whose votes
    run over a page boundary appears again on the next page with
    ``Continued = true``.  Concatenating the pages in order gives the single
    document of the original view.

    ``tasks`` may carry ``completed`` / ``on_active`` (default false);
    ``votes`` may carry ``vote`` (default true); ``results`` is (task_id, median).
    """
    if "vote" not in votes.columns:
        votes = votes.withColumn("vote", F.lit(True))
    for c in ("completed", "on_active"):
        if c not in tasks.columns:
            tasks = tasks.withColumn(c, F.lit(False))
    page_of = lambda ix: (F.floor((F.col(ix) - 1) / F.lit(page_cells)) + 1).cast("int")

    ppl = person_ordinals(connected_persons(persons, connections)).withColumn("page", page_of("person_ord"))
    persons_pages = ppl.groupBy("room_id", "page").agg(
        _sorted_list(F.struct(F.col("person_ord").alias("Id"), F.col("login_name").alias("UserName")), "Id")
        .alias("Persons"))

    pv = vote_ordinals(votes.select("task_id", "person_id", "vote", "score")).select(
        "task_id", F.col("person_ord").alias("vote_ord"), "vote", "score")
    # Cells of a room in view order: a task with n votes has n cells, one with
    # none has one.  One running scan over the tasks gives each task both its
    # ordinal and the number of cells before it; a cell's index is then that
    # offset plus its vote ordinal - no scan over the cells themselves.
    n_votes = pv.groupBy("task_id").agg(F.max("vote_ord").alias("__nv"))
    t = (tasks.select("room_id", "task_id", "name", "minutes", "completed", "on_active")
         .join(n_votes, "task_id", "left")
         .withColumn("__cells", F.greatest(F.coalesce("__nv", F.lit(0)), F.lit(1))))
    t = running(t, ["room_id"], ["task_id"], None,
                {"task_ord": ("count", None), "__upto": ("sum", "__cells")})
    t = (t.withColumn("task_ord", F.col("task_ord").cast("int"))
         .withColumn("__offset", F.col("__upto") - F.col("__cells"))
         .join(results.select("task_id", "median"), "task_id", "left"))
    voted = t.join(pv, "task_id").withColumn("cell_ix", F.col("__offset") + F.col("vote_ord"))
    silent = t.filter(F.col("__nv").isNull()).select(
        "*", F.lit(None).cast("int").alias("vote_ord"), F.lit(None).cast("boolean").alias("vote"),
        F.lit(None).cast("int").alias("score"), (F.col("__offset") + 1).alias("cell_ix"))
    cells = (voted.unionByName(silent).withColumn("__vo", F.coalesce("vote_ord", F.lit(0)))
             .withColumn("page", page_of("cell_ix")))
    vote_struct = F.when(F.col("vote_ord").isNotNull(), F.struct(
        F.col("vote_ord").alias("PersonId"), F.col("vote").alias("Vote"), F.col("score").alias("Score")))
    frag = cells.groupBy("room_id", "page", "task_id").agg(
        F.first("task_ord").alias("task_ord"), F.first("name").alias("name"),
        F.first("completed").alias("completed"), F.first("on_active").alias("on_active"),
        F.first("minutes").alias("minutes"), F.first("median").alias("median"),
        F.min("__vo").alias("first_vote"), _sorted_list(vote_struct, "PersonId").alias("PersonTask"))
    task_struct = F.struct(
        F.col("task_ord").alias("Id"), F.col("name").alias("NameTask"), F.col("completed").alias("Completed"),
        F.col("on_active").alias("IsCurrentActive"), F.col("minutes").alias("TimeDiscussion"),
        F.col("median").alias("Median"), (F.col("first_vote") > 1).alias("Continued"),
        F.col("PersonTask"))
    tasks_pages = frag.groupBy("room_id", "page").agg(_sorted_list(task_struct, "Id").alias("Tasks"))

    pages = persons_pages.join(tasks_pages, ["room_id", "page"], "full")
    base = rooms.select("room_id", "name_room", "is_active")
    j = base.join(pages, "room_id", "left")
    ok = F.coalesce(F.col("is_active"), F.lit(False))
    j = j.filter(ok | F.col("page").isNull() | (F.col("page") == 1))
    return j.select(
        "room_id",
        F.when(ok, F.coalesce("page", F.lit(1))).otherwise(F.lit(1)).alias("page"),
        F.when(~ok, F.lit(UNKNOWN_ROOM)).alias("error"),
        F.when(ok, F.col("name_room")).alias("NameRoom"),
        F.when(ok, F.coalesce("Persons", F.array().cast(persons_pages.schema["Persons"].dataType))).alias("Persons"),
        F.when(ok, F.coalesce("Tasks", F.array().cast(tasks_pages.schema["Tasks"].dataType))).alias("Tasks"),
    )


def snapshot_summary(snap: DataFrame) -> DataFrame:
    """Flat, comparable digest of paged room views, read from the arrays and
    summed over the pages of each room (continued tasks counted once)."""
    lead = lambda t: ~F.coalesce(t["Continued"], F.lit(False))
    n_tasks = F.aggregate("Tasks", F.lit(0), lambda acc, t: acc + F.when(lead(t), 1).otherwise(0))
    pt = F.aggregate("Tasks", F.lit(0), lambda acc, t: acc + F.size(t["PersonTask"]))
    sc = F.aggregate("Tasks", F.lit(0).cast("bigint"),
                     lambda acc, t: acc + F.aggregate(t["PersonTask"], F.lit(0).cast("bigint"),
                                                      lambda a, p: a + p["Score"]))
    med = F.aggregate("Tasks", F.lit(0),
                      lambda acc, t: acc + F.when(t["Median"].isNotNull() & lead(t), 1).otherwise(0))
    per_page = snap.select(
        "room_id", "error", "NameRoom", F.size("Persons").alias("np"), n_tasks.alias("nt"), pt.alias("npt"),
        sc.alias("ss"), med.alias("nm"), F.array_max(F.transform("Persons", lambda p: p["Id"])).alias("lp"))
    return per_page.groupBy("room_id").agg(
        F.first("error").alias("error"), F.first("NameRoom").alias("name_room"),
        F.sum("np").cast("int").alias("n_persons"), F.sum("nt").cast("int").alias("n_tasks"),
        F.sum("npt").cast("int").alias("n_person_tasks"), F.sum("ss").alias("sum_scores"),
        F.sum("nm").cast("int").alias("n_medians"), F.max("lp").alias("last_person_id"))


def snapshot_cells(snap: DataFrame) -> DataFrame:
    """The contents of paged room views as flat rows: one per (task, vote), and
    one without a vote for a task that has none.  The same rows whatever the
    page size."""
    t = snap.select("room_id", F.explode("Tasks").alias("t"))
    return t.select("room_id", "t", F.explode_outer("t.PersonTask").alias("p")).select(
        "room_id", F.col("t.Id").alias("task_ord"), F.col("t.NameTask").alias("name"), F.col("t.Completed").alias("completed"),
        F.col("t.IsCurrentActive").alias("on_active"), F.col("t.TimeDiscussion").alias("minutes"),
        F.col("t.Median").alias("median"), F.col("p.PersonId").alias("vote_ord"), F.col("p.Vote").alias("vote"),
        F.col("p.Score").alias("score"))


def snapshot_persons(snap: DataFrame) -> DataFrame:
    """The persons of paged room views as flat rows."""
    return snap.select("room_id", F.explode("Persons").alias("p")).select(
        "room_id", F.col("p.Id").alias("person_ord"), F.col("p.UserName").alias("login_name"))


def _bit(c):
    return F.when(c, 1).when(~c, 0)


def view_document():
    """A page of a room view as the nested struct that ``to_xml`` and the XML files write."""
    persons = F.transform("Persons", lambda p: F.struct(p["UserName"].alias("_UserName"), p["Id"].alias("_Id")))
    tasks = F.transform("Tasks", lambda t: F.struct(
        t["Id"].alias("_Id"), t["NameTask"].alias("_NameTask"), _bit(t["Completed"]).alias("_Completed"),
        _bit(t["IsCurrentActive"]).alias("_IsCurrentActive"), t["TimeDiscussion"].alias("_TimeDiscussion"),
        t["Median"].alias("_Median"), F.when(t["Continued"], 1).alias("_Continued"),
        F.transform(t["PersonTask"], lambda v: F.struct(
            v["PersonId"].alias("_PersonId"), _bit(v["Vote"]).alias("_Vote"), v["Score"].alias("_Score")))
        .alias("PersonTask")))
    return F.struct(
        F.col("error").alias("_Error"), F.col("NameRoom").alias("_NameRoom"), F.col("page").alias("_Page"),
        F.when(F.col("error").isNull(), F.struct(persons.alias("Person"))).alias("Persons"),
        F.when(F.col("error").isNull(), F.struct(tasks.alias("Task"))).alias("Tasks"))


def room_snapshot_xml(snap: DataFrame) -> DataFrame:
    """Serialise each room view to XML text (``to_xml``), attribute-only
    elements as the view procedure writes them:
    ``<Room NameRoom=..><Persons><Person UserName=.. Id=../>..</Persons>
    <Tasks><Task Id=.. ..><PersonTask PersonId=.. Vote=.. Score=../></Task></Tasks></Room>``;
    unknown rooms become ``<Room Error="UnknownRoom"/>``.  NULL attributes are
    left out."""
    return snap.select("room_id", "page", F.to_xml(view_document(), {"rowTag": "Room"}).alias("xml"))


XML_VIEW_SCHEMA = ("_Error STRING, _NameRoom STRING, _Page INT, "
                   "Persons STRUCT<Person: ARRAY<STRUCT<_UserName: STRING, _Id: INT>>>, "
                   "Tasks STRUCT<Task: ARRAY<STRUCT<_Id: INT, _NameTask: STRING, _Completed: INT, "
                   "_IsCurrentActive: INT, _TimeDiscussion: INT, _Median: DECIMAL(9,2), _Continued: INT, "
                   "PersonTask: ARRAY<STRUCT<_PersonId: INT, _Vote: INT, _Score: INT>>>>>")


def parse_room_xml(xml_rows: DataFrame) -> DataFrame:
    """Read view XML back into the nested room columns (``from_xml``)."""
    return view_from_document(xml_rows.select("room_id", F.from_xml("xml", XML_VIEW_SCHEMA, {"rowTag": "Room"}).alias("r")))


def view_from_document(p: DataFrame) -> DataFrame:
    """View rows from (room_id, r), ``r`` as ``view_document`` writes it."""
    persons = F.transform(F.coalesce(F.col("r.Persons.Person"), F.array()),
                          lambda x: F.struct(x["_Id"].alias("Id"), x["_UserName"].alias("UserName")))
    tasks = F.transform(F.coalesce(F.col("r.Tasks.Task"), F.array()), lambda t: F.struct(
        t["_Id"].alias("Id"), t["_NameTask"].alias("NameTask"), (t["_Completed"] == 1).alias("Completed"),
        (t["_IsCurrentActive"] == 1).alias("IsCurrentActive"), t["_TimeDiscussion"].alias("TimeDiscussion"),
        t["_Median"].alias("Median"), F.coalesce(t["_Continued"] == 1, F.lit(False)).alias("Continued"),
        F.transform(F.coalesce(t["PersonTask"], F.array()), lambda v: F.struct(
            v["_PersonId"].alias("PersonId"), (v["_Vote"] == 1).alias("Vote"), v["_Score"].alias("Score")))
        .alias("PersonTask")))
    err = F.col("r._Error")
    return p.select("room_id", F.col("r._Page").alias("page"), err.alias("error"),
                    F.col("r._NameRoom").alias("NameRoom"),
                    F.when(err.isNull(), persons).alias("Persons"), F.when(err.isNull(), tasks).alias("Tasks"))


def fanout_updates(snap: DataFrame, connections: DataFrame) -> DataFrame:
    """Deliver each room's current view to every live connection of the room:
    an equi-join on room_id (one view row per room on the build side)."""
    s = snapshot_summary(snap).select("room_id", "error", "n_persons", "n_tasks")
    return connections.select("room_id", "person_id", "ts").join(s, "room_id")


def coalesce_default(tasks: DataFrame, results: DataFrame, rooms: DataFrame) -> DataFrame:
    """Display values with defaults: a task without a median shows 'Unknown';
    a task of an unknown or inactive room shows the room error."""
    t = (tasks.select("room_id", "task_id").join(results.select("task_id", "median"), "task_id", "left")
         .join(rooms.select("room_id", "is_active"), "room_id", "left"))
    ok = F.coalesce("is_active", F.lit(False))
    return t.select("room_id", "task_id",
                    F.when(~ok, F.lit(UNKNOWN_ROOM)).otherwise(
                        F.coalesce(F.col("median").cast("string"), F.lit("Unknown"))).alias("median_text"))
