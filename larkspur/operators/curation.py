"""A reference table that people curate: merges in chains, exact unmerges, and files that ship into a table edited elsewhere.

Tables have ``key, name, aliases (array), status, merged_into``. A merged row stays, points to the row that it was merged
into and keeps its own spellings; pointers may form chains of any length, which :func:`roots` follows by doubling.
Nothing is gathered: every step is a join by key, and each round of doubling is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..written import cut

MERGED = "merged"


def roots(pointers: DataFrame) -> DataFrame:
    """``key, root, steps`` of every row that points somewhere (``key, into``, one row a key); a null root is that of a row on the way into a cycle.

    Each round jumps twice as far, so a chain of n rows takes log2(n) rounds; after as many as there could be, whoever
    has not arrived goes in circles.
    """
    at = cut(pointers.where("key is not null and into is not null").select("key", F.col("into").alias("root"), F.lit(1).cast("long").alias("steps")), "roots")
    rounds = max(at.count(), 1).bit_length() + 1
    far = at.select(F.col("key").alias("_k"), F.col("root").alias("_r"), F.col("steps").alias("_s"))
    for _ in range(rounds):
        moving = at.join(far, F.col("root") == F.col("_k"), "left")
        moved = cut(moving.select("key", F.coalesce("_r", "root").alias("root"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.col("_k").isNotNull().alias("_on")), "roots")
        at = moved.drop("_on")
        far = at.select(F.col("key").alias("_k"), F.col("root").alias("_r"), F.col("steps").alias("_s"))
        if not moved.where("_on").limit(1).count():
            return at
    lost = at.join(far, F.col("root") == F.col("_k"), "left")
    return lost.select("key", F.when(F.col("_k").isNull(), F.col("root")).alias("root"), F.when(F.col("_k").isNull(), F.col("steps")).alias("steps"))


def judged(table: DataFrame, merges: DataFrame) -> DataFrame:
    """``loser, winner, verdict`` of every wanted merge; only ``ok`` ones may be applied.

    ``unknown``: a row that is not there; ``self``; ``merged``: the loser was merged before; ``gone``: the winner was
    merged away before; ``twice``: the loser has another winner too; ``cycle``: following the winners never ends.
    """
    rows = table.select("key", (F.col("status") == MERGED).alias("away"))
    wanted = merges.select("loser", "winner").distinct()
    twice = wanted.where("loser is not null").groupBy("loser").agg(F.count("*").alias("_n"))
    single = wanted.where("loser <> winner").join(twice.where("_n = 1").select("loser"), "loser")
    round_trip = roots(single.select(F.col("loser").alias("key"), F.col("winner").alias("into"))).where("root is null").select(F.col("key").alias("loser"), F.lit(True).alias("_c"))
    known = wanted.join(twice, "loser", "left").join(round_trip, "loser", "left")
    known = known.join(rows.select(F.col("key").alias("loser"), F.col("away").alias("_la")), "loser", "left").join(rows.select(F.col("key").alias("winner"), F.col("away").alias("_wa")), "winner", "left")
    verdict = (
        F.when(F.col("_la").isNull() | F.col("_wa").isNull(), "unknown").when(F.col("loser") == F.col("winner"), "self").when(F.col("_la"), "merged")
        .when(F.col("_wa"), "gone").when(F.col("_n") > 1, "twice").when(F.col("_c"), "cycle").otherwise("ok")
    )
    return known.select("loser", "winner", verdict.alias("verdict"))


def _spellings(name: str = "name", aliases: str = "aliases") -> Column:
    return F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.isNotNull())


def _ancestors(pointers: DataFrame) -> DataFrame:
    """``key, above`` for everybody that a row's chain passes, by doubling; ``pointers`` (key, into) have no cycle."""
    reach = cut(pointers.select("key", F.col("into").alias("above")), "ancestors")
    jump = reach
    while True:
        further = jump.select("key", F.col("above").alias("_m")).join(jump.select(F.col("key").alias("_m"), "above"), "_m").select("key", "above")
        new = cut(further, "ancestors")
        if not new.limit(1).count():
            return reach
        beyond = reach.select("key", F.col("above").alias("_m")).join(new.select(F.col("key").alias("_m"), "above"), "_m").select("key", "above")
        reach, jump = cut(reach.union(new).union(beyond).distinct(), "ancestors"), new


def merged(table: DataFrame, merges: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """The table after the merges that may be applied, and the record of what each took: ``seq, loser, target, status, took``.

    Merges of one call happen from the losers up: in a chain a row has taken its losers' spellings before it is merged
    itself. ``took`` are the spellings that the target had not; the loser keeps its own. What the target has when the call
    ends does not depend on the order of rows.
    """
    ok = cut(judged(table, merges).where("verdict = 'ok'").select(F.col("loser").alias("key"), F.col("winner").alias("into")), "merges")
    rows = table.join(ok.withColumnRenamed("into", "_into"), "key", "left")
    # of every row the spellings of all that are merged into it, directly or over others
    given = _ancestors(ok).join(table.select("key", F.explode(_spellings()).alias("s")), "key").select(F.col("above").alias("key"), "s").distinct()
    gets = given.groupBy("key").agg(F.collect_set("s").alias("_gets"))
    after = rows.join(gets, "key", "left").withColumn("_all", F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array_except(F.coalesce("_gets", F.array().cast("array<string>")), F.array("name"))))))
    after = cut(after, "merged")
    had = table.select(F.col("key").alias("_into"), _spellings().alias("_had"))
    record = after.where("_into is not null").join(had, "_into").select(F.lit(seq).alias("seq"), F.col("key").alias("loser"), F.col("_into").alias("target"), "status", F.array_sort(F.array_except(F.array_distinct(_spellings("name", "_all")), "_had")).alias("took"))
    lost = F.col("_into").isNotNull()
    out = after.select(*[
        F.when(F.col("_gets").isNotNull(), F.col("_all")).otherwise(F.col("aliases")).alias(c) if c == "aliases"
        else F.when(lost, F.lit(MERGED)).otherwise(F.col("status")).alias(c) if c == "status"
        else F.coalesce("_into", "merged_into").alias(c) if c == "merged_into" else F.col(c)
        for c in table.columns
    ])
    return out, record


def unmerged(table: DataFrame, record: DataFrame, losers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with ``losers`` (key) back as they were, and the record without their merges.

    A target gives back what a loser took to it, unless another row that stays merged into it brought the same; the
    aliases that the target got since then stay. Rows that are not merged are left alone.
    """
    going = record.join(losers.select(F.col("key").alias("loser")).distinct(), "loser", "left_semi")
    staying = record.join(losers.select(F.col("key").alias("loser")).distinct(), "loser", "left_anti")
    taken = lambda r: r.select(F.col("target").alias("key"), F.explode("took").alias("s")).distinct()
    back = taken(going).join(taken(staying), ["key", "s"], "left_anti").groupBy("key").agg(F.collect_set("s").alias("_back"))
    rows = table.join(back, "key", "left").join(going.select(F.col("loser").alias("key"), F.col("status").alias("_status")), "key", "left")
    again = F.col("_status").isNotNull()
    out = rows.select(*[
        F.when(F.col("_back").isNotNull(), F.array_except("aliases", "_back")).otherwise(F.col("aliases")).alias(c) if c == "aliases"
        else F.coalesce("_status", "status").alias(c) if c == "status"
        else F.when(~again, F.col("merged_into")).alias(c) if c == "merged_into" else F.col(c)
        for c in table.columns
    ])
    return out, staying


def resolved(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the key of a merged row replaced by that of the row it ended up in; links need no move, so an unmerge brings them back."""
    ends = roots(table.where(F.col("status") == MERGED).select("key", F.col("merged_into").alias("into"))).select(F.col("key").alias("_k"), F.col("root").alias("_r"))
    return rows.join(ends, F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("_r", key)).drop("_k", "_r")


# -------------------------------------------------------------------------------------------------------- shipped files
def _blank(c: Column, kind: str) -> Column:
    """Null, the empty text and the empty list say the same."""
    return F.when((F.size(c) > 0) if kind.startswith("array") else (c != "") if kind == "string" else c.isNotNull(), c)


def reconciled(last: DataFrame, new: DataFrame, current: DataFrame, key: str = "key", prune: bool = False) -> DataFrame:
    """What a newly shipped file does to a table that is edited in its own place as well: one row for each key of the three.

    ``last``: what shipped the time before; ``new``: the file; ``current``: the table; all with the same columns. Field by
    field: what was not edited since ``last`` takes the file's value; what the file did not change keeps the edit; where
    both changed to different values the edit stays and the field is named in ``conflicts``. A row that the file no longer
    has goes only with ``prune``, and only unedited; a row that was deleted in the table comes back only where the file changed it.

    ``key, action, changed, conflicts, before, after``: action is added, updated, deleted, orphan, absent or same; before and
    after are the whole rows (structs, null where there is none).
    """
    fields = [c for c in current.columns if c != key]
    kinds = dict(current.dtypes)
    a, b, c = (df.select(key, F.struct(*fields).alias(n)) for df, n in ((last, "_l"), (new, "_n"), (current, "_c")))
    rows = a.join(b, key, "full_outer").join(c, key, "full_outer")
    shipped, here, before = F.col("_n").isNotNull(), F.col("_c").isNotNull(), F.col("_l").isNotNull()
    value = lambda side, f: _blank(F.col(f"{side}.{f}"), kinds[f])
    edited = {f: ~value("_c", f).eqNullSafe(value("_l", f)) for f in fields}
    moved = {f: ~value("_n", f).eqNullSafe(value("_l", f)) for f in fields}
    apart = {f: ~value("_n", f).eqNullSafe(value("_c", f)) for f in fields}
    # a row that both sides have made on their own counts as edited wherever it says something
    take = {f: apart[f] & F.when(before, ~edited[f]).otherwise(value("_c", f).isNull()) for f in fields}
    clash = {f: apart[f] & ~take[f] & F.when(before, moved[f]).otherwise(value("_n", f).isNotNull()) for f in fields}
    named = lambda tests, when: F.when(when, F.array_compact(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]))).otherwise(F.array().cast("array<string>"))
    any_of = lambda tests: F.greatest(*[t.cast("int") for t in tests.values()], F.lit(0)) > 0
    untouched, file_moved = ~any_of(edited), any_of(moved)
    action = (
        F.when(shipped & ~here, F.when(~before | file_moved, "added").otherwise("absent"))
        .when(~shipped & here, F.when(before & untouched & F.lit(prune), "deleted").when(before, "orphan").otherwise("same"))
        .when(shipped & here, F.when(any_of(take), "updated").otherwise("same"))
        .otherwise("absent")
    )
    mixed = F.struct(*[F.when(take[f], F.col(f"_n.{f}")).otherwise(F.col(f"_c.{f}")).alias(f) for f in fields])
    after = F.when(action == "added", F.col("_n")).when(action == "deleted", F.lit(None)).when(here & shipped, mixed).otherwise(F.col("_c"))
    both = shipped & here
    return rows.select(key, action.alias("action"), named(take, both).alias("changed"), named(clash, both).alias("conflicts"), F.col("_c").alias("before"), after.alias("after"))


def synced(plan: DataFrame, key: str = "key") -> DataFrame:
    """The table after a plan of :func:`reconciled`."""
    return plan.where("after is not null").select(key, "after.*")


def sync_events(plan: DataFrame, seq: int, key: str = "key") -> DataFrame:
    """``seq, key, action, before, after`` for each row that a sync adds, updates or deletes: what an undo needs, as JSON."""
    kept = {"ignoreNullFields": "false"}
    return plan.where(F.col("action").isin("added", "updated", "deleted")).select(F.lit(seq).alias("seq"), key, "action", F.to_json("before", kept).alias("before"), F.to_json("after", kept).alias("after"))


def undone(table: DataFrame, events: DataFrame, key: str = "key") -> DataFrame:
    """``table`` without what the events did: added rows go, updated and deleted ones are as before.

    A row that was edited after the event is left as it is: taking it back would lose the edit.
    """
    fields = [c for c in table.columns if c != key]
    kind = table.select(*fields).schema
    told = events.select(key, "action", F.from_json("before", kind).alias("_b"), F.from_json("after", kind).alias("_a"))
    rows = table.select(key, F.struct(*fields).alias("_c")).join(told, key, "full_outer")
    as_told = F.to_json("_c", {"ignoreNullFields": "false"}).eqNullSafe(F.to_json("_a", {"ignoreNullFields": "false"}))
    back = F.when(F.col("action").isNull(), F.col("_c")).when(F.col("action") == "deleted", F.coalesce("_c", "_b")).when(as_told, F.col("_b")).otherwise(F.col("_c"))
    return rows.select(key, back.alias("x")).where("x is not null").select(key, "x.*")
