"""Equal shards by balanced label propagation over linked documents (operator 4).

Documents with equal texts are linked. Each document starts in a shard that its number decides, so
all shards are full but none is over its quota. In each round the members of a group look at how many
of their neighbours are in which shard and ask to move to the shard that holds most. Requests that
close a ring of shards are granted, and beyond them those along a path that ends in a shard with room, so
the quotas hold after every round. Documents without links want nothing and fill what is left, exactly.

Rounds work on counts, how many members of a group are in a shard, and only on groups that are still
cut. They end when none is, or when rounds bring nothing more: groups may not fit into full shards
without a cut. Where a round brings nothing, groups ask in the next for any shard that holds some of them.

Groups larger than half a shard, or than ``GROUP_ROWS``, start together: they are laid side by side over
the shards and stay there, so one that can't fit into one shard takes up one more than it has to at most.
The others start spread over the room that is left, and move.

Only sums go to the driver: at most shards² · ``TICKETS`` rows in a round.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.numbering import number_rows
from ratewell.session import materialize

#: Requests between two shards are granted in so many lots; of the last one a part may be granted.
TICKETS = 64
#: Rows of a group that moves: what a task holds of a digest when they are dealt in the end.
GROUP_ROWS = 50_000
#: Rounds end when so many in a row leave more than 98 of 100 groups cut that were.
PATIENCE = 6
#: Rows of a digest meet in at least so many tasks, and in one per so many rows of the table.
SLICES = 16
SLICE_ROWS = 1_000_000


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard; at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def grant(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from one shard to another.

    Moves along a ring of shards change no shard's size. Beyond rings, moves along a path are granted
    while the shard at its end has room. Short rings and paths, and pairs that want most, go first.
    """
    left, room = {k: n for k, n in wanted.items() if n > 0}, list(room)
    out = dict.fromkeys(wanted, 0)

    def way(i: int, j: int, longest: int) -> list[int] | None:
        """The shortest way from j on that ends in i or in a shard with room."""
        back, line = {j: (None, 1)}, deque([j])
        while line:
            at = line.popleft()
            if at == i or room[at] > 0:
                path = [at]
                while (before := back[path[-1]][0]) is not None:
                    path.append(before)
                return path[::-1]
            steps = back[at][1]
            if steps < longest:
                for to in sorted((k for (h, k), n in left.items() if h == at and n), key=lambda k: -left[at, k]):
                    if to not in back:
                        back[to] = (at, steps + 1)
                        line.append(to)
        return None

    for longest in (2, 3, len(room) + 1):
        for i, j in sorted(left, key=lambda k: (-left[k], k)):
            while left[i, j] and (path := way(i, j, longest)):
                steps = list(zip([i, *path], path))
                n = min(left[x] for x in steps)
                if path[-1] != i:
                    n = min(n, room[path[-1]])
                    room[path[-1]] -= n
                    room[i] += n
                for x in steps:
                    left[x] -= n
                    out[x] += n
    return out


def propagate(entries: DataFrame, room: list[int], rounds: int | None = None) -> DataFrame:
    """Move the members of groups to their neighbours' shards.

    ``entries`` (digest, shard, n) say how many members of a group are in a shard; the result says the
    same after the moves. ``room`` is how many of them each shard may hold, and none holds more at the
    start.
    """
    spark, columns = entries.sparkSession, ["digest", "shard", "n"]
    used = {r["shard"]: r["n"] for r in entries.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [c - used.get(s, 0) for s, c in enumerate(room)]
    whole, active = None, entries
    least, waited, any_shard, turn = float("inf"), 0, False, 0
    while rounds is None or turn < rounds:
        turn += 1
        tie = F.xxhash64("digest", "shard", F.lit(turn))  # else all would ask for the same shards
        most = F.lit(0).cast("long") if any_shard else -F.col("n")
        order = F.struct(most.alias("n"), tie.alias("tie"), "shard")
        best = active.groupBy("digest").agg(F.min(order)["shard"].alias("target"), F.count(F.lit(1)).alias("held"))
        ticket = F.pmod(F.xxhash64(F.lit(turn), "digest"), F.lit(TICKETS))
        asked = active.join(best, "digest").select(
            *columns, "target", ticket.alias("ticket"), (F.col("held") == 1).alias("whole")
        )
        asked = materialize(asked, "requests")
        done = asked.where("whole").select(*columns)
        whole = done if whole is None else whole.unionByName(done)
        asked = asked.where("not whole")
        sums = asked.groupBy("shard", "target", "ticket").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")
        )
        sums = sums.orderBy("shard", "target", "ticket").collect()
        cut = sum(r["groups"] for r in sums if r["shard"] == r["target"])  # each asks for a shard it is in
        wanted: dict[tuple[int, int], int] = {}
        for r in sums:
            if r["shard"] != r["target"]:
                pair = r["shard"], r["target"]
                wanted[pair] = wanted.get(pair, 0) + r["n"]
        active = asked.select(*columns)
        waited = 0 if turn == 1 or cut < 0.98 * least else waited + 1
        least = min(least, cut)
        if not wanted or waited >= PATIENCE:
            break
        granted = grant(wanted, free)
        left, lots = dict(granted), []
        for r in sums:
            pair = r["shard"], r["target"]
            if left.get(pair):
                take = min(left[pair], r["n"])
                left[pair] -= take
                lots.append((*pair, r["ticket"], take, take < r["n"]))
        for (i, j), n in granted.items():
            free[i] += n
            free[j] -= n
        any_shard = not lots
        if not lots:
            continue
        at = ["shard", "target", "ticket"]
        lots = spark.createDataFrame(lots, "shard int, target int, ticket long, take long, part boolean")
        met = asked.join(F.broadcast(lots), at, "left")  # bounded, see above
        full = met.where("not coalesce(part, false)").withColumn("go", F.when(F.col("take") > 0, F.col("n")).otherwise(0))
        before = Window.partitionBy(*at).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
        some = met.where("part").withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0)))
        some = some.withColumn("go", F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("past")))).drop("past")
        both = F.array(
            F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("go").alias("n"))
        )
        moved = full.unionByName(some).select("digest", F.explode(both).alias("e"))
        moved = moved.groupBy("digest", "e.shard").agg(F.sum("e.n").alias("n")).where("n > 0")
        active = materialize(moved.select(*columns), "labels")
    return active if whole is None else whole.unionByName(active)


def shard(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rounds: int | None = None
) -> DataFrame:
    """Every row with size, text_crc32, law (``rows``), shard, slot and grown_shard (null).

    Row counts of shards are at most one apart and slots run from 0 without gaps. A null text has no
    bytes and is linked with empty ones. Repeated rows and null keys are rows like others. Columns
    other than key and text are ignored. An empty table gives no rows. ``rounds`` ends the moves early.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "rows")
    n = rows.count()
    room = quotas(n, shards)
    copies = _with_copies(rows.select("row", "digest"), n, min(GROUP_ROWS, max(1, n // shards // 2)))
    copies = materialize(copies, "copies")
    large, linked = copies.where("start is not null"), copies.where("start is null and copies > 1")
    large_rows, m = large.count(), linked.count()
    large = number_rows(large, "row", "number", ["digest"], large_rows)
    large = materialize(large.select("row", _shard_at(F.col("start") + F.col("number"), room).alias("shard")), "large")
    room = _left(room, large.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))

    linked = number_rows(linked.select("row", "digest"), "row", "number", [], m)
    spread = F.expr(f"cast(number as decimal(18, 0)) * cast({sum(room)} as decimal(18, 0)) div {max(1, m)}")
    linked = materialize(linked.select("row", "digest", _shard_at(spread, room).alias("shard")), "linked")
    entries = linked.groupBy("digest", "shard").agg(F.count(F.lit(1)).alias("n"))
    entries = materialize(propagate(materialize(entries, "labels"), room, rounds), "labels")
    room = _left(room, entries.groupBy("shard").agg(F.sum("n").alias("n")))

    single = number_rows(copies.where("copies = 1").select("row"), "row", "number", [], n - m - large_rows)
    single = single.select("row", _shard_at(F.col("number"), room).alias("shard"))
    placed = number_rows(_dealt(linked, entries).unionByName(single).unionByName(large), "row", "slot", ["shard"], n)
    return rows.join(placed, "row").select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _shard_at(place, room: list[int]):
    """The shard of a place, where the places of all shards lie side by side."""
    ends = [sum(room[: s + 1]) for s in range(len(room))]
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place))


def _left(room: list[int], used: DataFrame) -> list[int]:
    held = {r["shard"]: r["n"] for r in used.collect()}
    return [c - held.get(s, 0) for s, c in enumerate(room)]


def _with_copies(rows: DataFrame, n: int, limit: int) -> DataFrame:
    """Add ``copies``, rows with the same digest, and ``start``: rows in larger groups before a group of
    more than ``limit``, null for others. Rows meet by digest and slice, so none is hot.

    Starts are summed up in one task, over at most rows / ``limit`` groups.
    """
    slices = max(SLICES, n // SLICE_ROWS)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    parts = materialize(rows.groupBy("digest", "slice").agg(F.count(F.lit(1)).alias("n")), "parts")
    totals = parts.groupBy("digest").agg(F.sum("n").alias("copies"))
    before = Window.orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    large = totals.where(F.col("copies") > limit)
    large = large.withColumn("start", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    small = totals.where(F.col("copies") <= limit).withColumn("start", F.lit(None).cast("long"))
    totals = parts.drop("n").join(large.unionByName(small), "digest")
    return rows.join(totals, ["digest", "slice"]).drop("slice")


def _dealt(linked: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, shard): the rows of each group, which are at most ``GROUP_ROWS``, dealt by its entries."""
    ends = entries.groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("ends")  # at most one per shard
    )
    turn = F.row_number().over(Window.partitionBy("digest").orderBy("row")) - 1
    ranked = linked.select("row", "digest", turn.alias("turn")).join(ends, "digest")
    none = F.struct(F.lit(0).cast("long").alias("past"), F.lit(-1).alias("shard"))
    last = F.aggregate(
        "ends", none,
        lambda a, e: F.when(
            a["past"] <= F.col("turn"), F.struct((a["past"] + e["n"]).alias("past"), e["shard"].alias("shard"))
        ).otherwise(a),
    )
    return ranked.select("row", last["shard"].alias("shard"))
