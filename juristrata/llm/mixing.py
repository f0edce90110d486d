"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Rows of a source are put in a fixed pseudo-random order (MD5 of the id) and cut into blocks. A lane of weight p/Q
releases its i-th block (from 0) at slot floor(i Q / p) and must place it by slot ceil((i + 1) Q / p) - 1. At every
slot the released block with the earliest deadline goes first. The weights add up to 1, so every block meets its
window, and after any number of slots each lane has had its share p/Q to within less than one block. The schedule
repeats after Q slots, so only one frame of Q slots is ever computed (one row, by SQL's aggregate()); a block's slot
follows by arithmetic. No task holds a source: rows are numbered inside small ranges of the MD5, whose sizes are
summed up first.

Each of the LANES - 1 sources of largest weight is a lane of its own, and so are all sources if there are at most
LANES. All others share the last lane, whose weight is the sum of theirs: in it, the i-th block of a source with share
v of the lane comes at the virtual time (i + phase) / v, with a phase by hash, and blocks go in the order of their
times, numbered inside ranges of the time. So any number of sources is scheduled.

The lanes' shares p are the largest remainders of Q times the target weights, so p/Q is within 1/Q of the target (a
lane of less than 1/Q gets one slot, for which the others pay). Q follows the number of blocks, up to a bound by the
work of one frame; as long as one frame holds all blocks, a lane is less than two blocks away from its exact target.
A longer stream adds at most one block a frame.

What is scheduled is never dropped: when a source has no more blocks its later slots stay empty and the others move
up in the same order (`within` marks the rows before the first source ran out, where the bound holds).

Defined cases: a null source is a source of its own; without weights each source's natural share (its rows) is the
target; a source without a weight (or with one below 0) gets 1/Q; repeated rows are rows; an empty table gives an
empty result; a frame whose length the caller fixes must have a slot for each source, else ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristrata.llm.common import materialize

SLOTS = 1000
"""Slots of the shortest frame that is chosen by itself."""
MOST_SLOTS = 16_000
FRAME_WORK = 1_500_000
"""Bounds of a frame's slots, and of its slots times its lanes."""
BLOCK_ROWS = 8
LANES = 256
TAIL = "tail"
"""The lane of the sources without a lane of their own; no source's key is called so."""
TAIL_RANGE = 10_000
RANGE_ROWS = 50_000
"""Rows that one range of a source should hold; the number of ranges follows from the number of rows."""


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def weighed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 1.0, source_col: str = "source") -> DataFrame:
    """(key, n, w): rows and weight of each source. Without weights, the weight is the number of rows to the given power
    (1: its natural share; less: flatter)."""
    n = docs.groupBy(_source_key(F.col(source_col)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        return n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    names = {("null" if k is None else f"={k}"): float(v) for k, v in weights.items()}
    if not names:
        return n.withColumn("w", F.lit(0.0))
    given = docs.sparkSession.createDataFrame(list(names.items()), "key string, w double")
    return n.join(given, "key", "left").select("key", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))


def shares(lanes: DataFrame, slots: int) -> DataFrame:
    """The rows (key, w, more) of lanes with p, their integer shares of the frame: largest remainders of slots * w, at least 1.

    Where every lane's target is at least one slot these are the plain largest remainders; else what smaller lanes have
    too much is taken from the others in proportion to what they have beyond one slot."""
    everything = Window.partitionBy(F.lit(1))  # one row a lane, at most LANES or as many as a fixed frame has slots
    ideal = F.lit(slots) * F.coalesce(F.try_divide("w", F.sum("w").over(everything)), F.lit(0.0))
    rows = lanes.withColumn("beyond", F.greatest(ideal - 1, F.lit(0.0))).withColumn("all_beyond", F.sum("beyond").over(everything)).withColumn("lanes", F.count(F.lit(1)).over(everything))
    free = F.lit(slots) - F.col("lanes")
    even = F.try_divide(F.lit(1.0), F.col("lanes"))  # without any weight: equal shares
    rows = rows.withColumn("ideal", F.round(free * F.coalesce(F.try_divide("beyond", "all_beyond"), even), 9))
    rows = rows.withColumn("base", F.floor("ideal")).withColumn("rest", F.round(F.col("ideal") - F.floor("ideal"), 9))
    spare = free - F.sum("base").over(everything)
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "key"))
    rows = rows.withColumn("spare", spare).withColumn("nth", nth)
    return rows.select(*lanes.columns, (1 + F.col("base") + (F.col("nth") <= F.col("spare")).cast("long")).cast("long").alias("p"))


def targets(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 1.0, slots: int = SLOTS, source_col: str = "source") -> DataFrame:
    """(key, n, w, p): rows and weight of each source and its integer share of a frame of so many slots."""
    return shares(weighed(docs, weights, power, source_col), slots)


def frame(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, i, slot): the slot of each source's i-th block in one frame, by earliest deadline among released blocks."""
    one = shares.agg(F.sort_array(F.collect_list(F.struct("key", "p"))).alias("s"))
    plan = F.expr(f"""
        aggregate(
          IF(size(s) > 0, sequence(0, {slots - 1}), cast(array() AS array<int>)),
          named_struct('had', transform(s, x -> 0L), 'order', cast(array() AS array<int>)),
          (a, t) -> transform(array(
              array_min(transform(
                filter(sequence(1, size(s)), j -> a.had[j - 1] < s[j - 1].p AND a.had[j - 1] * {slots} div s[j - 1].p <= t),
                j -> named_struct('deadline', ((a.had[j - 1] + 1) * {slots} + s[j - 1].p - 1) div s[j - 1].p, 'j', j))).j),
            k -> named_struct('had', transform(a.had, (c, i) -> IF(i + 1 = k, c + 1L, c)), 'order', concat(a.order, array(k))))[0],
          a -> a.order)""")
    order = one.where(F.size("s") > 0).select("s", plan.alias("picks")).select("s", F.posexplode("picks").alias("slot", "j"))
    named = order.where("j IS NOT NULL").select(F.expr("s[j - 1].key").alias("key"), "slot")
    return named.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 1.0, slots: int | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", keep: list[str] | None = None, lanes: int = LANES) -> DataFrame:
    """For each row: doc_id, source, the columns in keep (under a struct `row`), block (of its source, from 0), place (in the block), slot, release,
    deadline (of its lane's block), within. Ordered by (slot, place) the rows are the mixture.

    The frame's length follows the input unless slots fixes it; then every source is a lane."""
    sources = materialize(weighed(docs, weights, power, source_col), "mixing-weights")
    total, count, n_blocks, total_w = sources.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.expr(f"(n + {block_rows - 1}) div {block_rows}")), F.sum("w")).first()
    if slots is not None and count > slots:
        raise ValueError(f"{count} sources do not fit in a frame that is fixed at {slots} slots")
    tailed = slots is None and count > lanes
    if slots is None:
        slots = max(SLOTS, min(n_blocks or 0, MOST_SLOTS, FRAME_WORK // max(1, min(count, lanes))))
    own = sources
    if tailed:
        first = sources.orderBy(F.desc("w"), "key").limit(lanes - 1).select("key")
        own = sources.join(F.broadcast(first), "key", "left_semi")  # at most lanes - 1 rows
        rest = sources.join(F.broadcast(first), "key", "left_anti")
        # A source without a weight has a slot's share of the lane.
        rest = rest.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit((total_w or 1.0) / slots)))
        rest = materialize(rest.withColumn("phase", (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) + 0.5) / (1 << 20)), "mixing-tail")
        tail_w = rest.agg(F.sum("w")).first()[0]
        own = own.select("key", "n", "w").unionByName(rest.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select(F.lit(TAIL).alias("key"), "n", "w"))
    plan = materialize(shares(own, slots), "mixing-targets")
    digits = 1
    while 16**digits * RANGE_ROWS < (total or 0) and digits < 8:
        digits += 1
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("key"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")]
    if keep:
        columns.append(F.struct(*keep).alias("row"))
    rows = docs.select(*columns).withColumn("range", F.substring("h", 1, digits))
    sizes = rows.groupBy("key", "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("key", "range", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("key", "range").orderBy("h", "doc_id")) - 1
    numbered = rows.withColumn("nth", nth).join(offsets, ["key", "range"]).withColumn("seq", F.col("nth") + F.col("before"))
    blocks = numbered.withColumn("block", F.expr(f"seq div {block_rows}")).withColumn("place", F.expr(f"seq % {block_rows}"))
    horizon = plan.where(F.col("key") != TAIL).agg(F.min(F.expr(f"n div {block_rows} * {slots} div p"))).first()[0] or 0
    known = F.broadcast(plan.select("key", "p"))  # at most as many rows as lanes
    if tailed:
        order, full = _tail_order(rest, tail_w, block_rows)
        tail_p = plan.where(F.col("key") == TAIL).first()["p"]
        horizon = min(horizon, full * slots // tail_p)
        placed = blocks.join(known, "key").withColumn("nth_block", F.col("block")).withColumn("lane", F.col("key"))
        shared = blocks.join(order, ["key", "block"]).withColumn("p", F.lit(tail_p)).withColumn("lane", F.lit(TAIL))
        placed = placed.unionByName(shared.select(*placed.columns))
    else:
        placed = blocks.join(known, "key").withColumn("nth_block", F.col("block")).withColumn("lane", F.col("key"))
    cycle = frame(plan, slots).withColumnRenamed("key", "lane").withColumnRenamed("slot", "slot_")
    out = placed.withColumn("i", F.expr("cast(nth_block % p AS int)")).join(F.broadcast(cycle), ["lane", "i"])  # at most `slots` rows
    slot = F.expr(f"nth_block div p * {slots}") + F.col("slot_")
    return out.select(
        "doc_id", "source", *(["row"] if keep else []), "block", "place", slot.alias("slot"),
        F.expr(f"nth_block * {slots} div p").alias("release"), F.expr(f"((nth_block + 1) * {slots} + p - 1) div p").alias("deadline"),
        (slot < F.lit(horizon)).alias("within"),
    )


def _tail_order(rest: DataFrame, total: float, block_rows: int) -> tuple[DataFrame, int]:
    """(key, block, nth_block): the order of all blocks of the last lane's sources (key, n, w, phase), and how many come
    before the first of these sources has no more full block. No task holds all blocks."""
    time = (F.col("block") + F.col("phase")) * F.lit(total) / F.col("w")
    each = rest.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {block_rows})"))).withColumn("time", time).withColumn("part", F.floor(F.col("time") / TAIL_RANGE))
    sizes = each.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for thousands of blocks
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("time", "key", "block")) - 1
    order = each.withColumn("nth", nth).join(offsets, "part").select("key", "block", "time", (F.col("nth") + F.col("before")).alias("nth_block"))
    order = materialize(order, "mixing-tail-order")
    ends = rest.agg(F.min((F.expr(f"n div {block_rows}") + F.col("phase")) * F.lit(total) / F.col("w"))).first()[0]
    return order.select("key", "block", "nth_block"), order.where(F.col("time") < F.lit(ends)).count()


def in_mixture_order(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 1.0) -> DataFrame:
    """The rows of docs, with all their columns, written out in the order of the mixture."""
    mixed = mix(docs, weights, power, keep=docs.columns)
    ordered = mixed.repartitionByRange("slot", "place", "doc_id").sortWithinPartitions("slot", "place", "doc_id")
    return ordered.select("row.*")
