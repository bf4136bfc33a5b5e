"""Sharding by balanced label propagation.

Documents linked by a hub (here: equal texts) should share a shard, while shard
counts stay at most one apart. Linked rows start out dealt evenly in hash order. In
each round a hub's counts per shard tell where most of its documents are (ties by
a hash that changes with the round); a small hub holds on to that shard, a large one
to the fewest such shards whose room takes all its documents. A join brings these
shards to the hub's documents, and those elsewhere ask to move there. A shard admits
as many as leave it and as it has free room for: of the counts of asking rows for each
pair of shards, swaps, cycles of shards and chains that end in free room are admitted
(a table of shards x shards on the driver). Rounds go on until none asks or a round
lowers the cut by less than a thousandth of what it was at the start. Documents
without a link fill the shards up to their exact quotas at the end, so sizes stay even
and no unlinked document costs a cut.

What meets is small: counts per (hub, shard), so a hub holding a third of all rows
adds one row a shard. Its documents are joined without sending them to one task
and ranked in slices. No link is written out as a pair; a hub of n documents
stands for its n(n-1)/2 links, and a cut is counted from its shard counts.

Defined cases: a null text has no link, 16 bytes and a null CRC; empty texts are
linked to each other; rows that repeat an id are placed one by one; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import hash32, join_skewed, ranked_in_groups, save

SHARDS = 40
OVERHEAD = 16
#: A hub of up to this share of a shard's quota wants to be in one shard.
SMALL_HUB = 1 / 16
#: A round must lower the cut by this share of the first one, or it is the last.
WORTH = 0.001


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hub (null without a link) and an even hash of each row."""

    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("hub"),
    ).withColumn("h", hash32(F.col("doc_id"), F.col("hub"), F.lit(29)))


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cut_links(state: DataFrame) -> float:
    """The number of links between rows of different shards."""

    n = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = n.groupBy("hub").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return per.agg(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2)).first()[0] or 0.0


def held_rows(state: DataFrame, shards: int) -> list[int]:
    """Rows in each shard (one row a shard reaches the driver)."""

    held = [0] * shards
    for r in state.groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    return held


def pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def admitted(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to move from one shard to another may: no shard
    gains more than it loses and has room for. Chains into free room first, then
    cycles of shards; when neither is left, nothing more could move."""

    left, room, out = {k: n for k, n in asks.items() if n > 0}, list(room), {}

    def admit(pair: tuple[int, int], n: int) -> None:
        out[pair] = out.get(pair, 0) + n
        left[pair] -= n
        if not left[pair]:
            del left[pair]

    def swaps() -> None:
        for i, j in sorted(left):
            if i < j and (j, i) in left:
                n = min(left[i, j], left[j, i])
                admit((i, j), n)
                admit((j, i), n)

    def chains() -> bool:
        moved = False
        while pairs := [p for p in sorted(left) if room[p[1]] > 0]:
            for i, j in pairs:
                n = min(left.get((i, j), 0), room[j])
                if n:
                    admit((i, j), n)
                    room[j], room[i], moved = room[j] - n, room[i] + n, True
        return moved

    def cycle() -> list[tuple[int, int]] | None:
        """Some cycle of asking pairs, by a walk that sets aside shards that lead nowhere."""

        dead: set[int] = set()
        for start in sorted({i for i, _ in left}):
            path = [start]
            while path:
                onward = [j for i, j in sorted(left) if i == path[-1] and j not in dead]
                if not onward:
                    dead.add(path.pop())
                elif onward[0] in path:
                    ring = path[path.index(onward[0]) :]
                    return list(zip(ring, [*ring[1:], ring[0]]))
                else:
                    path.append(onward[0])
        return None

    swaps()
    while True:
        if chains():
            continue
        ring = cycle()
        if ring is None:
            return out
        n = min(left[p] for p in ring)
        for p in ring:
            admit(p, n)


def propagate(state: DataFrame, quota: list[int], turn: int) -> tuple[DataFrame, int]:
    """One round over ``state`` (doc_id, size, text_crc32, h, hub, shard): the new
    state and how many rows asked to move."""

    room = [max(0, q - h) for q, h in zip(quota, held_rows(state, len(quota)))]
    counts = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("hub").orderBy(F.desc("n"), F.xxhash64("hub", "shard", F.lit(turn)))
    earlier = best.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "t": F.sum("n").over(Window.partitionBy("hub")),
        "taken": F.coalesce(F.sum(F.greatest(F.col("n") + pick(room, F.col("shard")), F.lit(int(max(quota) * SMALL_HUB)))).over(earlier), F.lit(0)),
    })
    # At most one entry a shard for each hub; hubs whole already have nothing to ask.
    hubs = counts.groupBy("hub").agg(F.first("t").alias("t"), F.sort_array(F.collect_list(F.when(F.col("taken") < F.col("t"), F.col("shard")))).alias("keep"))
    hubs = save(hubs.select("hub", "t", "keep"), "shard-hubs")
    asked = join_skewed(state, hubs, "hub", "t")
    to = F.when(F.array_contains("keep", F.col("shard")), F.col("shard")).otherwise(F.element_at("keep", (F.pmod(F.col("h"), F.size("keep")) + 1).cast("int")))
    asked = save(asked.withColumn("to", to).drop("keep"), "shard-asked")
    movers = asked.filter("to <> shard")
    n = movers.count()
    if n == 0:
        return state, 0
    # Documents of a hub ask next to each other, so a quota cuts through few hubs; a
    # hub takes a stretch of the hash range as wide as its share of all rows, so the
    # slices that are ranked stay even.
    stretch = F.floor(F.col("h") * (F.col("t") / F.lit(max(1, sum(quota)))))
    movers = movers.withColumn("turn_", F.pmod(hash32(F.col("hub"), F.lit(turn)) + stretch, F.lit(2**32)))
    pairs = {(r["shard"], r["to"]): r["count"] for r in movers.groupBy("shard", "to").count().collect()}
    may = admitted(pairs, room)
    shards = len(quota)
    flat = [may.get((i, j), 0) for i in range(shards) for j in range(shards)]
    ranked = ranked_in_groups(movers, ["shard", "to"], ["turn_", "hub", "h", "doc_id"], None, rows=n)
    moves = F.col("rank") < pick(flat, F.col("shard") * F.lit(shards) + F.col("to"))
    moved = ranked.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard")))
    columns = state.columns
    return save(asked.filter("to = shard").select(*columns).unionByName(moved.select(*columns)), "shard-state"), n


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; counts of any two
    shards differ by at most one."""

    rows = save(described(docs), "shard-rows")
    hubs = save(rows.filter("hub IS NOT NULL").groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    sized = save(join_skewed(rows.filter("hub IS NOT NULL"), hubs, "hub", "n"), "shard-sized")
    linked = sized.filter("n > 1").drop("n")
    in_all = linked.count()
    # Dealt in hash order, exactly even, so that no shard ever holds more than its quota.
    linked = ranked_in_groups(linked.withColumn("all_", F.lit(0)), ["all_"], ["h", "hub", "doc_id"], None, rows=in_all)
    linked = linked.withColumn("shard", F.floor(F.col("rank") * F.lit(shards) / F.lit(max(1, in_all))).cast("int")).drop("all_", "rank")
    quota = quotas(rows.count(), shards)
    state = save(linked, "shard-state")
    cut = first = cut_links(state)
    for turn in count():
        new, movers = propagate(state, quota, turn)
        if not movers or (left := cut_links(new)) >= cut:
            break
        state, fall, cut = new, cut - left, left
        if fall < WORTH * first:
            break
    columns = ["doc_id", "size", "text_crc32", "h"]
    n = state.count()
    placed = ranked_in_groups(state.select(*columns, "hub", "shard"), ["shard"], ["h", "hub", "doc_id"], None, rows=n)
    placed = save(placed, "shard-placed")
    fits = F.col("rank") < pick(quota, F.col("shard"))
    stays = placed.filter(fits).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
    # Rows that a full shard can't hold join the unlinked ones, which take what room is left.
    others = placed.filter(~fits).select(*columns).unionByName(sized.filter("n = 1").select(*columns)).unionByName(rows.filter("hub IS NULL").select(*columns))
    kept = [min(q, h) for q, h in zip(quota, held_rows(state, shards))]
    ends, total = [], 0
    for q, k in zip(quota, kept):
        total += q - k
        ends.append(total)
    queue = ranked_in_groups(others.withColumn("all_", F.lit(0)), ["all_"], ["h", "doc_id", "text_crc32", "size"], None, rows=max(1, total))
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    queue = queue.withColumn("shard", shard.cast("int"))
    slot = F.col("rank") - pick([0, *ends[:-1]], F.col("shard")) + pick(kept, F.col("shard"))
    return stays.unionByName(queue.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot")))
