"""Rooms, members, tasks: ordinals, presence, slots, roles, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.functions.rules import key_text
from estimark.operators.scan import ordinal


def task_ordinals(tasks: DataFrame) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY room ORDER BY task_id) -> task_ord.
    The ordinal is what messages and views call a task's Id."""
    return ordinal(tasks, ["room_id"], ["task_id"], "task_ord")


def room_members(connections: DataFrame) -> DataFrame:
    """Distinct (room, person) pairs of the connection log: reconnects collapse."""
    return connections.select("room_id", "person_id").distinct()


def connected_persons(persons: DataFrame, connections: DataFrame) -> DataFrame:
    """``P.Id IN (SELECT PersonId FROM Connections WHERE RoomId = r)`` for every
    room at once: persons joined to the distinct members of each room."""
    return room_members(connections).join(persons.select("person_id", "login_name"), "person_id").select(
        "room_id", "person_id", "login_name")


def person_ordinals(connected: DataFrame) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY room ORDER BY person_id) -> person_ord."""
    return ordinal(connected, ["room_id"], ["person_id"], "person_ord")


def zero_fill_votes(connections: DataFrame, tasks: DataFrame, votes: DataFrame) -> DataFrame:
    """Slots the connect procedure fills with (vote 0, score 0): every member of
    a room gets one per task of the room unless a vote row exists.

    Reported per task as counts (``n_slots`` members, ``n_voted`` members with a
    vote row, ``n_zero_filled`` the rest) - the member x task pairs themselves
    are never materialised, so a big room costs its members plus its votes,
    not their product."""
    members = room_members(connections)
    room_size = members.groupBy("room_id").agg(F.count(F.lit(1)).alias("n_slots"))
    voted = (votes.select("room_id", "task_id", "person_id").distinct()
             .join(members, ["room_id", "person_id"], "left_semi")
             .groupBy("room_id", "task_id").agg(F.count(F.lit(1)).alias("n_voted")))
    return (tasks.select("room_id", "task_id").join(room_size, "room_id")
            .join(voted, ["room_id", "task_id"], "left")
            .select("room_id", "task_id", "n_slots", F.coalesce("n_voted", F.lit(0)).alias("n_voted"))
            .withColumn("n_zero_filled", F.col("n_slots") - F.col("n_voted")))


SLOT_BITS = 63  # members a bitmap word holds (the sign bit stays free)
SLOT_BLOCK = 256  # bitmap words of a room that are opened as one
SLOT_GROUP = 32  # blocks that a task's votes are joined with as one
SLOT_TASKS = 2048  # tasks of a room (about) that meet its words in one place


def _member_words(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmap words of the persons of each key: (keys, bucket, bits).  ``bit_or`` is aggregated partially, so a busy
    key is a word per input partition before it is shuffled."""
    bit = F.expr(f"shiftleft(1L, int(pmod(person_id, {SLOT_BITS})))")
    bucket = F.floor(F.col("person_id") / SLOT_BITS).cast("bigint")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def slot_bitmaps(connections: DataFrame, tasks: DataFrame, votes: DataFrame) -> DataFrame:
    """The slots that connecting fills with (vote 0, score 0), as bitmaps: (room_id, task_id, bucket, slots, n_slots),
    where bit ``b`` of ``slots`` is set if member ``63 * bucket + b`` of the room has no vote row on the task.

    Members are a few words a room and voters a few words a task; the rest is ``members AND NOT voted``.  A task costs
    a 63rd of its members, and no (member, task) row is made.  Words without a slot are left out.

    The result itself grows with tasks times members, so its rows are made last and are never shuffled, and neither is
    a row a (task, block).  A room's words come in blocks of ``SLOT_BLOCK`` buckets.  What is shuffled is a row a (task,
    ``SLOT_GROUP`` blocks) with its words that have votes, and the blocks once per ``SLOT_TASKS`` tasks of their room:
    a busy room is dealt out by its tasks, and its blocks go where they are.  A block meets its tasks one after the
    other (it is the left side), which also keeps like words together in the files of the result.

    Votes are joined by task alone, with room and group as a condition: the two are compared by ``between``, since an
    equality would become a join key, and votes that lie by task (they come from a join on it) would be shuffled again."""
    first = lambda n: F.col("bucket") - F.pmod("bucket", F.lit(n))
    block, group = first(SLOT_BLOCK), first(SLOT_BLOCK * SLOT_GROUP)
    packed = F.collect_list(F.struct("bucket", "bits"))
    words = _member_words(connections.select("room_id", "person_id").filter("person_id IS NOT NULL"), "room_id")
    voted = _member_words(votes.select("room_id", "task_id", "person_id").filter("person_id IS NOT NULL"), "room_id", "task_id")
    voted = voted.groupBy("room_id", "task_id", group.alias("__group")).agg(F.map_from_entries(packed).alias("__voted"))
    shares = tasks.groupBy("room_id").agg(F.ceil(F.count(F.lit(1)) / SLOT_TASKS).alias("__shares"))
    groups = words.select("room_id", group.alias("__group")).distinct()
    t = (tasks.select("room_id", "task_id").join(groups.join(shares, "room_id"), "room_id")
         .select("room_id", "task_id", "__group", F.pmod(F.xxhash64("task_id"), "__shares").alias("__share")))
    same = F.col("t.task_id") == F.col("v.task_id")
    for c in ("room_id", "__group"):
        same &= F.col(f"v.{c}").between(F.col(f"t.{c}"), F.col(f"t.{c}"))
    t = t.alias("t").join(voted.alias("v"), same, "left").select("t.*", "__voted")
    blocks = (words.groupBy("room_id", group.alias("__group"), block.alias("__block")).agg(packed.alias("__words")).join(shares, "room_id")
              .withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))))
    j = blocks.alias("b").join(t.alias("t"), [F.col(f"b.{c}") == F.col(f"t.{c}") for c in ("room_id", "__group", "__share")])
    here = F.map_filter("__voted", lambda b, _: b.between(F.col("__block"), F.col("__block") + (SLOT_BLOCK - 1)))
    j = (j.select("t.room_id", "task_id", here.alias("__here"), "__words")
         .select("room_id", "task_id", "__here", F.inline("__words").alias("bucket", "__members")))
    found = F.coalesce(F.try_element_at("__here", F.col("bucket")), F.lit(0).cast("bigint"))
    slots = F.col("__members").bitwiseAND(F.bitwise_not(found))
    return j.select("room_id", "task_id", "bucket", slots.alias("slots"), F.bit_count(slots).cast("int").alias("n_slots")).filter("slots <> 0")


def slots_of(bitmaps: DataFrame) -> DataFrame:
    """The (room_id, task_id, person_id) pairs of slot bitmaps, for the rooms or tasks that a caller has picked."""
    bits = F.expr(f"filter(sequence(0, {SLOT_BITS - 1}), b -> (shiftright(slots, b) & 1) = 1)")
    return bitmaps.select("room_id", "task_id", "bucket", F.explode(bits).alias("__b")).select(
        "room_id", "task_id", (F.col("bucket") * SLOT_BITS + F.col("__b")).alias("person_id"))


def creator_role(rooms: DataFrame, persons: DataFrame, pairs: DataFrame) -> DataFrame:
    """'Creator' when the person's email equals the email of the room's creator,
    else 'User' (also for an unknown room or creator: NULL never equals)."""
    creator_mail = (rooms.select("room_id", "creator")
                    .join(persons.select(F.col("person_id").alias("creator"), F.col("email").alias("creator_email")),
                          "creator", "left"))
    p = pairs.select("room_id", "person_id").join(persons.select("person_id", "email"), "person_id", "left")
    j = p.join(creator_mail.select("room_id", "creator_email"), "room_id", "left")
    same = F.lower(F.rtrim("email")) == F.lower(F.rtrim("creator_email"))
    return j.select("room_id", "person_id",
                    F.when(F.coalesce(same, F.lit(False)), "Creator").otherwise("User").alias("role"))


def room_exists(rooms: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """Existence probe by room GUID after the 36-character length check; the
    active flag is not looked at.  GUIDs compare without case (links carry
    them lower-cased)."""
    guids = rooms.select(key_text(F.col("room_guid")).alias("__g")).distinct().withColumn("__hit", F.lit(True))
    p = probes.select(probe).distinct()
    j = p.join(guids, key_text(p[probe]) == guids["__g"], "left")
    return j.select(probe, ((F.length(probe) == 36) & F.coalesce("__hit", F.lit(False))).alias("room_exists"))


def task_id_bounds(tasks: DataFrame) -> DataFrame:
    """First and last task id of each room."""
    return tasks.groupBy("room_id").agg(F.min("task_id").alias("first_task_id"),
                                        F.max("task_id").alias("last_task_id"))


def latest_room(rooms: DataFrame, creator: str = "creator", key: str = "room_id", ts: str = "created") -> DataFrame:
    """``TOP(1) Id ... ORDER BY Id DESC`` per creator: the newest room key of
    each creator with its creation time (``max_by``, a partial aggregate)."""
    return rooms.groupBy(creator).agg(F.max(key).alias("latest_room_id"),
                                      F.max_by(ts, key).alias("latest_created"))


def cascade_delete(deleted_rooms: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """ON DELETE CASCADE: each child table without the rows of deleted rooms."""
    gone = deleted_rooms.select("room_id").distinct()
    return {name: df.join(gone, "room_id", "left_anti") for name, df in children.items()}


def resolve_rooms(log: DataFrame, rooms: DataFrame, guid: str = "room_guid") -> DataFrame:
    """Natural key to surrogate key for rooms: ``guid`` to room_id by a left
    join on a one-row-per-GUID lookup; unknown GUIDs get reason 'unknown_room'."""
    look = rooms.groupBy(key_text(F.col("room_guid")).alias("__g")).agg(F.min("room_id").alias("room_id"))
    j = log.join(look, key_text(log[guid]) == look["__g"], "left").drop("__g")
    return j.withColumn("reason", F.when(F.col("room_id").isNull(), "unknown_room"))


KEY_COLLATION = "UTF8_LCASE_RTRIM"  # keys compare as the source's database does: case and trailing blanks don't count


def resolve_messages(log: DataFrame, rooms: DataFrame, persons: DataFrame) -> DataFrame:
    """Messages as they arrive, with a room's GUID and a sender's e-mail (``room_guid``, ``email``), resolved to keys:
    adds ``room_id``, ``person_id`` and the ``reason`` why a key is missing.

    Both are equi-joins on collated columns, so the comparison form is the column's and not a projection of every
    query.  Each lookup has one row a key (the smallest id), so no message is multiplied; messages without a key get
    a null id and a reason."""
    key = lambda c: F.collate(F.col(c), KEY_COLLATION)
    r = rooms.select(key("room_guid").alias("__guid"), "room_id").groupBy("__guid").agg(F.min("room_id").alias("room_id"))
    p = persons.select(key("email").alias("__email"), "person_id").groupBy("__email").agg(F.min("person_id").alias("person_id"))
    j = log.join(r, key("room_guid") == F.col("__guid"), "left").join(p, key("email") == F.col("__email"), "left")
    reason = (F.when(F.col("room_id").isNull() & F.col("person_id").isNull(), "unknown_room_and_person")
              .when(F.col("room_id").isNull(), "unknown_room").when(F.col("person_id").isNull(), "unknown_person"))
    return j.withColumn("reason", reason).drop("__guid", "__email")
