"""Balanced label propagation: linked documents move into their neighbours' shards, counts stay at most one apart.

Documents are linked through a shared group key (equal texts, here); a group is a hyperedge, so no pairs are made. Slices of a
group, made by a hash of the document, are the nodes, and their label is a shard. In each round a slice counts its
neighbours by shard, which is one aggregation by group and shard, and wants the shard where most of them are; in every other
round, of those that have room for all, and where none has, one elsewhere that has. Moves are granted in the order of a hash, as many into each shard
as its quota and the moves out of it allow. Rounds end when hardly any group gets whole by them.

What is left is repaired on the driver, which needs the numbers of groups by shard and size alone: groups leave shards beyond
their quota, and each group that is still cut goes where there is room, after exchanges of groups between shards if need be.
Groups larger than a shard are laid over as few shards as hold them; groups for which no exchange finds room stay cut. The
unlinked have no edges to cut, so they fill what is left, which makes the counts exact.

Documents are ranked once, in salted slices of their group; a group of a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

SLICES, SLICE_ROWS = 64, 1_000_000  # of a group, by document: so many at least, and so many that the largest has about as many rows


def _prefix(df: DataFrame, by: str, n: str, key: list[str], out: str, buckets: int) -> DataFrame:
    """Append `out`: the sum of n over the rows of the same `by` that come before, in the order of a hash of key.

    Totals by bucket are summed first, so that no task holds all rows of one `by`, which must have few values."""
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    totals = d.groupBy(by, "_bucket").agg(F.sum(n).alias("_n"))  # a few values times `buckets` rows
    w = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(by, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(by, "_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(starts), [by, "_bucket"]).withColumn(out, F.col("_start") + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop("_bucket", "_start")


def _exchange(room: list[int], groups: list[Counter], s: int, t: int, log: list) -> bool:
    """Move a group of s to t, for a smaller one or none: the exchange that gives s most of the room of t, if there is one."""
    ours = np.array(sorted(groups[s]), np.int64)
    theirs = np.array([0, *sorted(groups[t])], np.int64)
    at = np.searchsorted(theirs, ours - room[t])  # the smallest that t can give and still take ours
    gain = np.where(at < len(theirs), ours - theirs[np.minimum(at, len(theirs) - 1)], 0)
    if not len(gain) or gain.max() < 1:
        return False
    k = int(gain.argmax())
    log.append((s, t, int(ours[k]), int(theirs[at[k]])))
    _apply(room, groups, *log[-1])
    return True


def _apply(room: list[int], groups: list[Counter], s: int, t: int, ours: int, theirs: int) -> None:
    for a, b, n in ((s, t, ours), (t, s, theirs)):
        if n:
            groups[a][n] -= 1
            if not groups[a][n]:
                del groups[a][n]
            groups[b][n] += 1
    room[s] += ours - theirs
    room[t] -= ours - theirs


def _make_room(n: int, room: list[int], groups: list[Counter]) -> int | None:
    """A shard with room for n after exchanges with others; None, and nothing changed, if none is found."""
    order = sorted(range(len(room)), key=lambda k: (-room[k], k))
    for s in order if sum(room) >= n else []:
        log: list = []
        for t in order:
            while t != s and room[s] < n and room[t] and _exchange(room, groups, s, t, log):
                pass
        if room[s] >= n:
            return s
        for s_, t, ours, theirs in reversed(log):
            _apply(room, groups, s_, t, theirs, ours)
    return None


def place(sizes: dict[int, int], quota: list[int], held: list[Counter] | None = None) -> tuple[list[Counter], list[tuple[int, list[tuple[int, int]]]], list[int]]:
    """sizes: groups without a shard, by size; held: whole groups in shards already (by shard: size -> count).

    Returns whole groups (by shard: size -> count), those cut (size, [(shard, n)]), room left. All groups together fit the
    quotas. At most one group a shard is cut, as each fills one at least."""
    groups = [Counter(x) for x in held] if held else [Counter() for _ in quota]
    todo = Counter(sizes)
    cut = []
    # The largest go first over as few shards as hold them, and what stands in their way is placed anew.
    large = [n for n in sorted(todo, reverse=True) for _ in range(todo[n]) if n > max(quota)]
    taken = [0] * len(quota)
    if large:
        free = list(quota)
        for n in large:
            pieces, left = [], n
            while left:
                s = max(range(len(free)), key=lambda k: (free[k], -sum(m * c for m, c in groups[k].items()), -k))
                take = min(left, free[s])
                pieces.append((s, take))
                free[s] -= take
                left -= take
            cut.append((n, pieces))
        taken = [q - f for q, f in zip(quota, free, strict=True)]
        for n in set(large):
            del todo[n]
    room = [q - t - sum(n * c for n, c in g.items()) for q, t, g in zip(quota, taken, groups, strict=True)]
    for s, g in enumerate(groups):
        for n in sorted(g):  # the smallest leave first
            if room[s] >= 0:
                break
            leave = min(g[n], -(room[s] // n))
            todo[n] += leave
            room[s] += leave * n
            g[n] -= leave
        groups[s] = +g

    def split(n):
        pieces, left = [], n
        while left:
            s = max(range(len(room)), key=lambda k: (room[k], -k))
            take = min(left, room[s])
            pieces.append((s, take))
            room[s] -= take
            left -= take
        cut.append((n, pieces))

    def put(n, s, count=1):
        groups[s][n] += count
        room[s] -= n * count

    over: Counter = Counter()
    for n in sorted(todo, reverse=True):
        left = todo[n]
        lo, hi = 0, max(room)  # the highest level that shards can be filled to, down from their room, if all n-groups fit
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if sum(max(0, r - mid) // n for r in room) >= left:
                lo = mid
            else:
                hi = mid - 1
        for s in sorted(range(len(room)), key=lambda k: (-room[k], k)):
            take = min(left, max(0, room[s] - lo) // n)
            if take:
                put(n, s, take)
                left -= take
        while left and (s := _make_room(n, room, groups)) is not None:
            put(n, s)
            left -= 1
        if left:
            over[n] = left
    found = True
    while found:  # smaller groups, placed since, allow other exchanges
        found = False
        for n in sorted(over):
            while over[n] and (s := _make_room(n, room, groups)) is not None:
                put(n, s)
                over[n] -= 1
                found = True
    for n in sorted(over, reverse=True):
        for _ in range(over[n]):
            split(n)
    return groups, cut, room


def _granted_shares(room: list[int], wanted: dict[tuple[int, int], int]) -> list[float]:
    """The share of the moves into each shard that can be granted at once; wanted: documents by (from, to). What comes fits
    the room and what leaves by granted moves."""
    share = [1.0] * len(room)
    comes = [sum(n for (_, t), n in wanted.items() if t == s) for s in range(len(room))]
    for _ in range(100):
        leaves = [0.0] * len(room)
        for (s, t), n in wanted.items():
            leaves[s] += share[t] * n
        now = [max(0.0, min(x, (r + o) / c)) if c else 0.0 for x, r, o, c in zip(share, room, leaves, comes, strict=True)]
        if max((a - b for a, b in zip(share, now, strict=True)), default=0) < 1e-3:
            return now
        share = now
    return share


def propagate(slices: DataFrame, quota: list[int], slack: float = 0.02, most_rounds: int = 10, least_share: float = 0.05) -> DataFrame:
    """slices (group, slice, n) -> (group, slice, n, shard) after rounds of label propagation.

    Groups must be no larger than a quota. While labels move, a shard may hold `slack` of its quota more than that, which
    lets full shards exchange groups; moves into it count against those out of it. The rounds end when none, or less than `least_share` of the cut groups, became whole in one,
    and after `most_rounds`."""
    shards, spark = len(quota), slices.sparkSession
    buckets = 8 * partitions(spark)
    state = written(slices.withColumn("shard", F.pmod(F.xxhash64("group", "slice"), F.lit(shards)).cast("int")), "shard-labels")
    for k in range(most_rounds):
        held = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        rooms = [q - held.get(s, 0) for s, q in enumerate(quota)]
        free = F.array(*[F.lit(r).cast("long") for r in rooms])
        room = lambda s: F.element_at(free, s + 1)
        votes = state.groupBy("group", "shard").agg(F.sum("n").alias("votes"))
        g = votes.groupBy("group").agg(F.sum("votes").alias("size"), F.array_sort(F.collect_list(F.struct("votes", F.xxhash64("group", "shard", F.lit(k)).alias("tie"), "shard"))).alias("by")).where("size(by) > 1")  # one entry a shard
        # In every other round groups go where most of their members are, so that full shards exchange theirs; in between, where there is room.
        fits = lambda x: room(x["shard"]) + x["votes"] >= F.col("size")
        near = F.element_at(F.concat("by", F.filter("by", fits)) if k % 2 else F.col("by"), -1)
        far = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: room(s) >= F.col("size"))
        elsewhere = F.lit(k % 2 == 1) & ~fits(near) & (F.size(far) > 0)
        target = F.when(elsewhere, F.get(far, F.pmod(F.xxhash64("group", F.lit(1)), F.size(far)).cast("int"))).otherwise(near["shard"])
        wanted = written(g.select("group", "by", target.alias("target")), "shard-wanted", narrow=True)
        cut = wanted.count()
        if not cut:
            break
        flows = wanted.select("target", F.inline("by")).where("shard <> target").groupBy("shard", "target").agg(F.sum("votes").alias("n")).collect()  # a row a pair of shards
        flows = {(r.shard, r.target): r.n for r in flows}
        shares = _granted_shares([r + int(q * slack) for r, q in zip(rooms, quota, strict=True)], flows)
        limit = F.array(*[F.lit(x * sum(n for (_, t), n in flows.items() if t == s)) for s, x in enumerate(shares)])
        comes = F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == F.col("target"), 0).otherwise(x["votes"]))
        asked = _prefix(wanted.select("group", "target", comes.alias("comes")), "target", "comes", ["group"], "before", buckets)
        granted = written(asked.where(F.col("before") + F.col("comes") <= F.element_at(limit, F.col("target") + 1)).select("group", "target"), "shard-moves", narrow=True)
        moved = granted.count()
        if moved:
            state = written(state.join(granted, "group", "left").select("group", "slice", "n", F.coalesce("target", "shard").alias("shard")), "shard-labels")
        if moved <= cut * least_share:
            break
    return state


def cut_links(placed: DataFrame, group: Column) -> DataFrame:
    """One row: links (pairs of documents of one group) and n_cut, those with ends in two shards, of rows with a shard.
    Counted from the numbers of documents by group and shard."""
    n = placed.groupBy(F.xxhash64(group).alias("group"), "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    pairs = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return n.agg(pairs(F.expr("n * (n - 1) div 2")).alias("links"), pairs(F.expr("(n * n - inside) div 2")).alias("n_cut"))


def _flows(counted: dict[tuple[int, int], int], whole: list[Counter], cut: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple]:
    """(size, at, first, end, [(shard, n)]): where the groups of a size that are at a shard (-1: none), numbered, belong.
    As many as can stay; the others go where groups of their size are missing, and those to be cut come last."""
    out = []
    for n in {n for n, _ in counted}:
        left = {at: c for (m, at), c in counted.items() if m == n}
        used: Counter = Counter()

        def take(at, count, held, n=n, left=left, used=used):
            out.append((n, at, used[at], used[at] + count, held))
            used[at] += count
            left[at] -= count

        missing = {}
        for s, g in enumerate(whole):
            if stay := min(g[n], left.get(s, 0)):
                take(s, stay, [(s, n)])
            if g[n] > stay:
                missing[s] = g[n] - stay
        for s, count in missing.items():
            for at in sorted(left):
                if go := min(count, left[at]):
                    take(at, go, [(s, n)])
                    count -= go
        for _, pieces in (x for x in cut if x[0] == n):
            take(next(at for at in sorted(left) if left[at]), 1, pieces)
    return out


def balanced_shards(docs: DataFrame, group: Column, tie: list[Column], shards: int = 40) -> DataFrame:
    """docs with shard (from 0) and slot (from 0, without gaps in a shard). Counts of shards are at most one apart.

    Rows with an equal `group` are linked (a null group links its rows too); `tie` columns order the rows of a group. Rows
    equal in all of these, repeated rows for instance, are separate members. An empty table gives an empty table; columns
    of docs called shard or slot are replaced. docs is read three times and must give the same rows each time.
    """
    spark = docs.sparkSession
    buckets = 8 * partitions(spark)
    d = docs.drop("shard", "slot").withColumn("_group", F.xxhash64(group))
    n_slices = max(SLICES, -(-docs.count() // SLICE_ROWS))
    d = d.withColumn("_tie", F.xxhash64(*tie)).withColumn("_slice", F.pmod(F.col("_tie"), F.lit(n_slices)).cast("int"))
    slices = written(d.groupBy(F.col("_group").alias("group"), F.col("_slice").alias("slice")).agg(F.count(F.lit(1)).alias("n")), "shard-slices")
    total = slices.agg(F.sum("n")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = written(slices.groupBy("group").agg(F.sum("n").alias("size")), "shard-groups")
    largest = max(quota)
    # Labels are propagated among groups that fit a shard; the rest has none (-1).
    fits = slices.join(sizes.where((F.col("size") > 1) & (F.col("size") <= largest)).select("group"), "group", "left_semi")
    labels = propagate(fits, quota).groupBy("group").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    label = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1)
    linked = written(sizes.where("size > 1").join(labels, "group", "left").select("group", "size", F.coalesce(label, F.lit(-1)).cast("int").alias("at")), "shard-linked")
    counted = {(r["size"], r["at"]): r["n"] for r in linked.groupBy("size", "at").agg(F.count(F.lit(1)).alias("n")).collect()}  # sqrt(2 * total) sizes at most, a shard
    held = [Counter({n: c for (n, at), c in counted.items() if at == s}) for s in range(shards)]
    whole, cut, free = place({n: c for (n, at), c in counted.items() if at == -1}, quota, held)
    used = [q - f for q, f in zip(quota, free, strict=True)]
    steps = spark.createDataFrame(_flows(counted, whole, cut), "size long, at int, first long, end long, held array<struct<shard: int, n: long>>")  # sizes * shards rows, or twice as many
    linked = linked.withColumn("kind", F.col("size") * (shards + 1) + F.col("at") + 1).withColumn("one", F.lit(1))
    linked = _prefix(linked, "kind", "one", ["group"], "number", buckets).drop("kind", "one")
    linked = linked.join(F.broadcast(steps), ["size", "at"]).where("number >= first and number < end").select("group", F.inline("held"))
    # Each (group, shard) takes a run of slots; the unlinked are a pool that takes the rest.
    runs = _prefix(linked, "shard", "n", ["group"], "slot", buckets)
    single = sizes.where("size = 1").select("group", F.col("size").alias("n"))
    pool = _prefix(single.withColumn("_all", F.lit(0)), "_all", "n", ["group"], "slot", buckets)
    pieces = written(runs.select("group", "shard", "n", "slot").unionByName(pool.select("group", F.lit(-1).alias("shard"), "n", "slot")), "shard-pieces")
    plan = pieces.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "slot", "n"))).alias("pieces"))
    before = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # n_slices rows a group
    offsets = slices.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(plan, "group")
    d = d.join(offsets.select(F.col("group").alias("_group"), F.col("slice").alias("_slice"), F.col("offset").alias("_offset"), F.col("pieces").alias("_pieces")), ["_group", "_slice"])
    d = d.withColumn("_rank", F.col("_offset") + F.row_number().over(Window.partitionBy("_group", "_slice").orderBy("_tie", *tie)) - 1)
    found = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot")),
        lambda a, p: F.struct(
            (a["seen"] + p["n"]).alias("seen"),
            F.when((F.col("_rank") >= a["seen"]) & (F.col("_rank") < a["seen"] + p["n"]), p["shard"]).otherwise(a["shard"]).alias("shard"),
            F.when((F.col("_rank") >= a["seen"]) & (F.col("_rank") < a["seen"] + p["n"]), p["slot"] + F.col("_rank") - a["seen"]).otherwise(a["slot"]).alias("slot"),
        ),
    )
    d = d.withColumn("_at", found).withColumn("_shard", F.col("_at.shard")).withColumn("_slot", F.col("_at.slot"))
    # Pool places fill the free slots of shard 0, then those of shard 1, and so on.
    ends = list(accumulate(free))
    into_shard, into_slot = F.lit(shards - 1), F.col("_slot") - (ends[-1] - free[-1]) + used[-1]
    for s in range(shards - 2, -1, -1):
        into_shard = F.when(F.col("_slot") < ends[s], s).otherwise(into_shard)
        into_slot = F.when(F.col("_slot") < ends[s], F.col("_slot") - (ends[s] - free[s]) + used[s]).otherwise(into_slot)
    pooled = F.col("_shard") == -1
    d = d.withColumn("shard", F.when(pooled, into_shard).otherwise(F.col("_shard")).cast("int")).withColumn("slot", F.when(pooled, into_slot).otherwise(F.col("_slot")).cast("long"))
    return d.drop("_group", "_tie", "_slice", "_offset", "_pieces", "_rank", "_at", "_shard", "_slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"))
    r = balanced_shards(written(d, "shard-docs"), F.col("text_key"), [F.col("doc_id")])
    return r.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
