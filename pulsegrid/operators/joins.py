"""Interval and nearest joins as equi-joins and windows on stretches of time.

A plain range condition makes Spark compare every pair of rows. Here an interval is listed under the buckets of time that it
touches and a point has one bucket, so the join shuffles on the bucket and the exact condition filters what
meets; no pair appears twice. The nearest join needs no pairs at all: both sides are merged in order of time.
Nor do sums over the points of intervals: they are differences of running sums, so their work grows with intervals and points, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import epoch

#: Bucket sizes in seconds: an hour, a day, thirty days.
SIZES = (3600, 86_400, 2_592_000)
#: An interval is listed under the smallest size of which it touches about this many buckets at most.
LISTED = 8
#: Points of one bucket are dealt over so many parts, and intervals listed in each of them.
SALTS = 8
#: Points of a part are packed into arrays of so many, in order of time.
PACK = 128
STRETCH = 3600
#: Running sums begin anew each day and are taken in stretches of ten minutes, so that a crowded hour is several tasks.
DAY, SUM_STRETCH = 86_400, 600


def _bucket(c: str | Column, seconds: int | Column) -> Column:
    return F.floor(epoch(c) / seconds)


def _no_clash(left: DataFrame, right: DataFrame, *, but: tuple[str, ...] = ()) -> None:
    clash = set(left.columns) & set(right.columns) - set(but)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")


def listed_intervals(intervals: DataFrame, start: str, end: str, sizes: tuple[int, ...], salts: int) -> DataFrame:
    """Each interval with its bucket size, once for each bucket that it touches and each part of it."""
    length = epoch(end) - epoch(start)
    size = F.lit(sizes[-1])
    for s in reversed(sizes[:-1]):
        size = F.when(length <= s * (LISTED - 1), s).otherwise(size)
    sized = intervals.filter(F.col(start) <= F.col(end)).withColumn("_size", size.cast("long"))
    buckets = F.explode(F.sequence(_bucket(start, F.col("_size")), _bucket(end, F.col("_size"))))
    every = sized.withColumn("_bucket", buckets)
    return every.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else every.withColumn("_salt", F.lit(0))


def dealt_points(points: DataFrame, ts: str, sizes: Column, salts: int) -> DataFrame:
    """Each point once for each bucket size, in its bucket and, by a hash of the row, in one part of it."""
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    return points.withColumn("_salt", salt).withColumn("_size", F.explode(sizes)).withColumn("_bucket", _bucket(ts, F.col("_size")))


def interval_join(
    intervals: DataFrame, points: DataFrame, start: str = "start_ts", end: str = "end_ts", ts: str = "ts", sizes: tuple[int, ...] = SIZES, salts: int = SALTS
) -> DataFrame:
    """Pairs of an interval and a point inside it, both ends included.

    Short and long intervals lie in buckets of different sizes. Points are listed only for sizes that some interval has: with several
    ``sizes`` these come from an aggregate of the intervals, one row that is broadcast to the points within the same plan. However many points fall into
    one bucket, a task gets about one in ``salts`` of them; intervals, the fewer rows, are listed in every part. What meets an interval are arrays of points that
    reach into it, of which only those at its ends hold others too, so that a pair costs little more than the row that it returns.
    """
    _no_clash(intervals, points)
    listed = listed_intervals(intervals, start, end, sizes, salts)
    timed = points.filter(F.col(ts).isNotNull())
    if len(sizes) == 1:
        dealt = dealt_points(timed, ts, F.array(F.lit(sizes[0]).cast("long")), salts)
    else:
        used = listed_intervals(intervals.select(start, end), start, end, sizes, 1).agg(F.collect_set("_size").alias("_sizes"))  # no more than there are sizes
        dealt = dealt_points(timed.crossJoin(F.broadcast(used)), ts, F.col("_sizes"), salts).drop("_sizes")
    packs = packed_points(dealt, ts, points.columns, ["_size", "_bucket", "_salt"])
    reaching = (F.col("_from") <= F.col(end)) & (F.col("_to") >= F.col(start))
    pairs = listed.join(packs, ["_size", "_bucket", "_salt"]).filter(reaching).select(*intervals.columns, F.inline("_points"))
    return pairs.filter(F.col(ts).between(F.col(start), F.col(end)))


def packed_points(points: DataFrame, ts: str, columns: list[str], part: list[str], size: int = PACK) -> DataFrame:
    """The points of each part in order of time, packed into arrays ``_points`` of at most ``size``, with the moments ``_from`` and ``_to`` of their ends."""
    pack = F.floor((F.row_number().over(Window.partitionBy(*part).orderBy(ts)) - 1) / size)
    packed = points.withColumn("_pack", pack).groupBy(*part, "_pack")
    return packed.agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.collect_list(F.struct(*columns)).alias("_points")).drop("_pack")


def neighbours(left: DataFrame, right: DataFrame, by: list[str], ts: str, other_ts: str, tolerance: int, stretch: int = STRETCH) -> DataFrame:
    """Each left row with ``_before`` and ``_after``: the last right row up to its time and the first from it on, as structs that begin with their time.

    Both sides are one table, dealt by ``by`` and stretches of time, and merged in order of time from both ends: nothing is paired, and a row is
    shuffled once. A left row lies in its stretch, a right row also in a neighbouring one that its tolerance reaches into; rows beyond the
    tolerance may be missing. Of right rows at the same moment the one with the greatest other columns comes before, with the least after.
    """
    _no_clash(left, right, but=tuple(by))
    own = [c for c in left.columns if c not in by]
    other = [other_ts, *[c for c in right.columns if c not in by and c != other_ts]]
    none = lambda df, names: F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType).alias
    step = lambda c, shift=0: F.floor((epoch(c) + shift) / stretch)
    here = left.select(*by, step(ts).alias("_stretch"), epoch(ts).alias("_at"), F.struct(*own).alias("_left"), none(right, other)("_right"))
    reached = F.explode(F.sequence(step(other_ts, -tolerance), step(other_ts, tolerance))).alias("_stretch")
    there = right.select(*by, reached, epoch(other_ts).alias("_at"), none(left, own)("_left"), F.struct(*other).alias("_right"))
    order = Window.partitionBy(*by, "_stretch")
    both = here.unionByName(there)
    both = both.withColumn("_before", F.max("_right").over(order.orderBy("_at"))).withColumn("_after", F.min("_right").over(order.orderBy(F.desc("_at"))))
    return both.filter("_left is not null").select(*by, *[F.col(f"_left.{c}") for c in own], "_before", "_after")


def nearer(ts: str, other_ts: str, tolerance: int, before: Column, after: Column) -> Column:
    """Of two neighbours the one within the tolerance that is nearer, the earlier on ties; null if there is none."""
    gap = lambda c: F.abs(epoch(c[other_ts]) - epoch(ts))
    near = F.when(gap(before) <= F.coalesce(gap(after), F.lit(float("inf"))), before).otherwise(after)
    return F.when(gap(near) <= tolerance, near)


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, other_ts: str, tolerance: int, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """For each distinct ``keys`` of the left side the nearest right row within ``tolerance`` seconds, the earlier on ties."""
    names = [other_ts, *[c for c in right.columns if c not in by and c != other_ts]]
    found = neighbours(left.dropDuplicates(keys), right, by, ts, other_ts, tolerance, stretch)
    found = found.withColumn("_near", nearer(ts, other_ts, tolerance, F.col("_before"), F.col("_after"))).filter("_near is not null")
    return found.select(*left.columns, *[F.col(f"_near.{c}") for c in names])


def cut(at: Column, after: bool = False) -> Column:
    """A place on the time line: just before the points of a moment (in seconds), or just after them; null without a moment."""
    return F.when(at.isNotNull(), F.struct(at.cast("double").alias("at"), F.lit(after).alias("after")))


def piece(part: str, low: Column, high: Column, then: str | None = None, begun: bool = False, **by: Column) -> Column:
    """A part of an interval between two cuts; ``then`` names the part that begins where this one ends and is ``begun`` by it, so that both share that cut."""
    named = [F.lit(part).alias("part"), F.lit(then).cast("string").alias("then"), F.lit(begun).alias("begun")]
    return F.struct(*named, *[v.alias(k) for k, v in by.items()], low.alias("low"), high.alias("high"))


def measured(*names: str) -> list[Column]:
    """Columns of points whose sums tell the means of these values, also as differences of longer sums: decimals, which lose nothing, and apart from them what these cannot hold.

    ``_odd`` counts values without a finite sum: infinite ones in its lower half, negative infinite ones in its upper half, others that are no numbers in both.
    """
    out = []
    for x in names:
        plain, none, infinite = f"abs({x}) < 1e15", f"isnan({x})", f"abs({x}) = double('Infinity')"
        odd = f"bigint(if({none} or {x} = double('Infinity'), 1, 0)) + if({none} or {x} = double('-Infinity'), 4294967296, 0)"
        out += [
            f"if({x} is null, 0L, 1L) as {x}_n",
            f"cast(if({plain}, {x}, 0D) as decimal(38,18)) as {x}_sum",
            f"if(not {plain} and not {none} and not {infinite}, {x}, 0D) as {x}_rest",
            f"coalesce({odd}, 0L) as {x}_odd",
        ]
    return [F.expr(x) for x in out]


def counted(name: str, when: Column) -> Column:
    return F.when(when, 1).otherwise(0).cast("long").alias(name)


def _total(name: str, parts: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"coalesce({p}_{name}, 0)" for p in parts) + ")"


def total(name: str, *parts: str) -> Column:
    """The sum of a column of points over parts of an interval; 0 without points."""
    return F.expr(_total(name, parts))


def mean(name: str, *parts: str) -> Column:
    """The mean of a measured value over parts of an interval, null without values."""
    n, sum_, rest, odd = (_total(f"{name}_{x}", parts) for x in ("n", "sum", "rest", "odd"))
    up, down = f"{odd} % 4294967296 > 0", f"{odd} >= 4294967296"
    strange = f"if({up} and {down}, double('NaN'), if({up}, double('Infinity'), double('-Infinity')))"
    return F.expr(f"if({n} = 0, null, if({odd} > 0, {strange}, (double({sum_}) + {rest}) / {n}))")


def cuts_of(intervals: DataFrame, pieces: Column, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The cuts at both ends of each piece, one for two pieces that share it, and one more for each day between."""
    slots = DAY // SUM_STRETCH
    slot = lambda at: F.floor(at / SUM_STRETCH)
    day = lambda at: F.floor(at / DAY)
    # a piece without a length tells nothing, unless it begins the next one
    found = intervals.select(*keys, F.explode(pieces).alias("_p")).filter("_p.low < _p.high or (_p.then is not null and _p.low <= _p.high)")
    low, high = F.col("_p.low"), F.col("_p.high")
    last = day(high["at"])
    at_end = lambda d: F.struct(
        F.lit(1).alias("sign"),
        F.when(d == last, F.col("_p.then")).alias("then"),
        F.when(d < last, (d + 1) * slots - 1).otherwise(slot(high["at"])).alias("slot"),
        F.when(d < last, float("inf")).otherwise(high["at"]).alias("at"),
        F.when(high["after"], 2).otherwise(0).alias("order"),
    )
    at_begin = F.struct(F.lit(-1).alias("sign"), F.lit(None).cast("string").alias("then"), slot(low["at"]).alias("slot"), low["at"].alias("at"), F.when(low["after"], 2).otherwise(0).alias("order"))
    ends = F.transform(F.sequence(day(low["at"]), last), at_end)
    both = F.when(F.col("_p.begun"), ends).otherwise(F.array_append(ends, at_begin))
    ended = found.select(*keys, F.col("_p.part").alias("_part"), *[F.col(f"_p.{b}").alias(b) for b in by], F.explode(both).alias("_c"))
    return ended.select(*keys, "_part", F.col("_c.then").alias("_then"), *by, F.col("_c.sign").alias("_sign"), F.col("_c.slot").alias("_slot"), F.col("_c.at").alias("_at"), F.col("_c.order").alias("_order"))


def interval_sums(intervals: DataFrame, pieces: Column, points: DataFrame, keys: list[str], parts: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """For each ``keys`` the sums of the points' columns inside the pieces of its intervals, as ``<part>_<column>``; no row without a piece that has a length.

    ``pieces`` is an array of ``piece``; points have ``_at`` in seconds, the columns of ``by``, on which a piece meets its points, and columns of numbers. A sum is what the
    running sum of a day gained between two cuts. Cuts and points are merged in order of time within stretches of a day; what earlier stretches of
    the day hold comes from a table of one row a stretch. A piece that ends on a later day than it begins has one more cut for each day between.
    """
    values = [c for c in points.columns if c not in ("_at", *by)]
    kinds = dict(points.dtypes)
    slots = DAY // SUM_STRETCH
    point = points.filter("_at is not null").withColumn("_slot", F.floor(F.col("_at") / SUM_STRETCH))
    cuts = cuts_of(intervals, pieces, keys, by)
    texts = ", ".join
    none = [F.lit(None).cast(kind).alias(c) for c, kind in cuts.dtypes if c in (*keys, "_part", "_then", "_sign")]
    merged = cuts.select("*", *[F.expr(f"cast(0 as {kinds[v]}) as {v}") for v in values]).unionByName(point.select(*none, *by, "_slot", "_at", F.lit(1).alias("_order"), *values))
    upto = f"(partition by {texts([*by, '_slot'])} order by _at, _order rows between unbounded preceding and current row)"
    here = merged.selectExpr(*keys, "_part", "_then", "_sign", *by, "_slot", *[f"sum({v}) over {upto} as {v}" for v in values]).filter("_sign is not null")

    # what a day's stretches hold together before each later one
    held = point.groupBy(*by, "_slot").agg(*[F.sum(v).alias(v) for v in values]).withColumn("_day", F.floor(F.col("_slot") / slots))
    ordered = f"partition by {texts([*by, '_day'])} order by _slot"
    until = f"coalesce(lead(_slot) over ({ordered}), (_day + 1) * {slots} - 1) as _until"
    sofar = [f"sum({v}) over ({ordered} rows between unbounded preceding and current row) as _{v}" for v in values]
    earlier = held.selectExpr(*by, "_slot + 1 as _from", until, *sofar).filter("_from <= _until")
    earlier = earlier.selectExpr(*by, "explode(sequence(_from, _until)) as _slot", *[f"_{v}" for v in values])
    every = here.join(earlier, [*by, "_slot"], "left")
    gained = every.selectExpr(*keys, "_part", "_then", *[f"if(_sign > 0, {v} + coalesce(_{v}, 0), -({v} + coalesce(_{v}, 0))) as {v}" for v in values])
    return gained.groupBy(*keys).agg(*[F.expr(f"sum(case when _part = '{p}' then {v} when _then = '{p}' then -{v} end) as {p}_{v}") for p in parts for v in values])
