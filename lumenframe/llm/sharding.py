"""Sharding by balanced label propagation [native].

Documents of equal text are linked. Links pull a document to the shard that holds most of its neighbours; a shard takes no more than its room.
Members of one group in one shard are interchangeable, so the state that is iterated is a count for each (group, shard): at most one row a
shard for each group, however large the group. Documents are dealt to the counts at the end; documents without links fill the room that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import before, dropped, ranked, written

SALTS = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, g, h): size is the text's UTF-8 bytes plus 16; (g, h) is equal for equal texts. A null text has no bytes and is a group of its own."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g"), F.xxhash64(F.lit(1), text).alias("h"),
    )


def rooms(load: DataFrame, n: int, shards: int) -> DataFrame:
    """(shard, load, room): what each shard holds and may still take when sizes are at most one row apart; one row a shard."""
    every = load.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    most = F.lit(n // shards) + (F.col("shard") < n % shards).cast("long")
    held = load.groupBy(F.col("shard").alias("at")).agg(F.sum("n").alias("held"))
    return every.join(F.broadcast(held), F.col("shard") == F.col("at"), "left").select("shard", F.coalesce("held", F.lit(0)).alias("load"), (most - F.coalesce("held", F.lit(0))).alias("room"))


def propagate(state: DataFrame, n: int, shards: int) -> DataFrame:
    """One round: (g, h, shard, n) -> the counts after the moves, with `moved`, the rows that came.

    A group of `total` rows needs `anchors` shards; its anchors are the shards with room that hold most of it. What it has elsewhere asks to
    move to one of them. A shard admits requests, the largest first, up to its room; the last one may be admitted in part.
    """
    room = F.broadcast(rooms(state, n, shards))
    by_group = Window.partitionBy("g", "h")
    best = by_group.orderBy(F.desc("open"), F.desc("n"), "shard")
    placed = state.join(room, "shard").withColumn("open", ((F.col("room") > 0) | (F.col("n") >= n // shards)).cast("int"))
    placed = placed.withColumn("total", F.sum("n").over(by_group)).withColumn("place", F.row_number().over(best))
    placed = placed.withColumn("anchors", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(max(1, n // shards))))).withColumn("order", F.collect_list("shard").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.get("order", F.pmod(F.col("place") - 1, F.col("anchors")).cast("int"))
    asks = placed.filter((F.col("place") > F.col("anchors")) & (F.size("order") > 1)).select("g", "h", "shard", "n", target.alias("to"))
    to_room = room.select(F.col("shard").alias("to"), "room")
    queued = before(asks, ["to"], "n", ["g", "h", "shard"], F.col("g"), SALTS, "before", largest_first=True)
    admitted = queued.join(to_room, "to")
    admitted = admitted.withColumn("m", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("before")))).filter("m > 0")
    same = F.col("n"), F.lit(0).cast("long").alias("moved")
    gone = admitted.select("g", "h", "shard", (-F.col("m")).alias("n"), F.lit(0).cast("long").alias("moved"))
    come = admitted.select("g", "h", F.col("to").alias("shard"), F.col("m").alias("n"), F.col("m").alias("moved"))
    return state.select("g", "h", "shard", *same).unionByName(gone).unionByName(come).groupBy("g", "h", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).filter("n > 0")


def shard(docs: DataFrame, shards: int = 40, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows, group_shards) for every row of docs, under the law `rows`.

    Shards hold counts at most one apart. group_rows: rows with this text; group_shards: shards that hold them (1: no link is cut).
    Null ids and repeated rows are rows like others; a null text equals other null texts; an empty table gives an empty result. Only id_col
    and text_col are read; keys adds the text's hashes g and h. The result depends on ids and texts alone, not on the order of rows; equal rows may trade slots.
    """
    base = written(sized(docs, id_col, text_col), "shard-rows")
    n = base.count()
    # Group sizes without bringing a group's rows together: counted by key first, told back to rows by way of the salted pieces of ranked().
    counts = base.groupBy("g", "h").agg(F.count(F.lit(1)).alias("rows"))
    linked_groups = counts.filter("rows > 1")
    members = written(ranked(base, ["g", "h"], ["doc_id", "size"], F.col("doc_id"), SALTS, "p", counts), "shard-members")
    linked, alone = members.filter("rows > 1"), members.filter("rows = 1")

    # The first labels are dealt evenly at random, so that no shard starts beyond its room.
    first = ranked(linked.select("g", "h", "p"), [], [F.xxhash64("g", "p"), "h"], F.xxhash64("h", "p"), SALTS * 4, "r").select("g", "h", F.pmod("r", F.lit(shards)).cast("int").alias("shard"))
    state = written(first.groupBy("g", "h", "shard").agg(F.count(F.lit(1)).alias("n")), "shard-state")
    for _ in range(rounds):
        new = written(propagate(state, n, shards), "shard-state")
        dropped(state)
        state = new.drop("moved")
        if not new.agg(F.sum("moved")).first()[0]:
            break

    # Slots: a shard's linked rows first, group by group, then the others.
    by_group = Window.partitionBy("g", "h").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = before(state.withColumn("from", F.coalesce(F.sum("n").over(by_group), F.lit(0))), ["shard"], "n", ["g", "h"], F.col("g"), SALTS, "slot0")
    lists = ranges.groupBy("g", "h").agg(F.sort_array(F.collect_list(F.struct("from", "shard", "slot0"))).alias("ranges"))
    own = F.element_at(F.filter("ranges", lambda x: x["from"] <= F.col("p")), -1)
    pieces = linked.withColumn("part", F.floor(F.col("p") / F.lit(4096)).cast("long"))
    most = linked_groups.select("g", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.lit(4096)).cast("long"))).alias("part"))
    lists = most.join(lists, ["g", "h"])
    tied = pieces.join(lists, ["g", "h", "part"]).withColumn("own", own).select(
        "g", "h", "doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.slot0") + F.col("p") - F.col("own.from")).alias("slot"), F.col("rows").alias("group_rows"), F.size("ranges").alias("group_shards")
    )
    left = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    holes = rooms(state, n, shards).withColumn("from", F.coalesce(F.sum("room").over(left), F.lit(0))).filter("room > 0")
    holes = holes.agg(F.sort_array(F.collect_list(F.struct("from", "shard", "load"))).alias("holes"))
    hole = F.element_at(F.filter("holes", lambda x: x["from"] <= F.col("r")), -1)
    loose = ranked(alone.select("doc_id", "size", "text_crc32", "g", "h"), [], ["g", "h"], F.col("g"), SALTS * 4, "r").crossJoin(F.broadcast(holes)).withColumn("own", hole)
    loose = loose.select("g", "h", "doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.load") + F.col("r") - F.col("own.from")).alias("slot"), F.lit(1).cast("long").alias("group_rows"), F.lit(1).alias("group_shards"))
    return tied.unionByName(loose).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "group_rows", "group_shards", *(("g", "h") if keys else ()))


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns and two more, shard and slot, which replace columns of these names; equal rows are told apart by number.

    Null texts are one group, null ids ids like others; an empty table gives an empty result; a long text is one row.
    """
    docs = docs.drop("shard", "slot")
    same = Window.partitionBy("__id", "__g", "__h")
    placed = shard(docs, shards, id_col=id_col, text_col=text_col, keys=True).select(F.col("doc_id").alias("__id"), F.col("g").alias("__g"), F.col("h").alias("__h"), "shard", "slot")
    placed = placed.withColumn("__row", F.row_number().over(same.orderBy("shard", "slot")))
    text = F.col(text_col)
    rows = docs.withColumns({"__id": F.col(id_col), "__g": F.xxhash64(text), "__h": F.xxhash64(F.lit(1), text)}).withColumn("__row", F.row_number().over(same.orderBy(F.lit(0))))
    on = [rows["__id"].eqNullSafe(placed["__id"]), *(rows[c] == placed[c] for c in ("__g", "__h", "__row"))]
    return rows.join(placed, on).select(*(rows[c] for c in docs.columns), placed["shard"], placed["slot"])
