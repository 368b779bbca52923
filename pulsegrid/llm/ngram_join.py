"""N-gram Jaccard join: an exact metric-space join of shingle sets by pivots and Voronoi regions.

Jaccard distance is a metric, and two sets link when their distance is at most ``T = 1 - SIMILARITY``. Equal sets are one class,
stood for by its least document.

* **Opening.** From almost any pivot almost all sets lie at distance 1, where no triangle inequality tells them apart. So
  the first regions are opened by shingles: two linked sets share one of the first ``n - ceil(SIMILARITY * n) + 1`` shingles of each in
  any fixed order. The pivot of a shingle is the least document that has it in this prefix; a region gathers the members of all
  shingles with the same pivot. Linked sets meet in a region at least once.
* **Voronoi regions.** A region of over ``SMALL`` members draws ``PIVOTS`` pivots among them and computes the exact distance of every member to
  each. A member within ``CORE`` of its nearest pivot has its home there. It visits each other pivot's region where a link may reach across
  the boundary: where its distance exceeds that to its nearest pivot by at most ``2 T``, and ``CORE`` by at most ``T``.
  Members further out have their home in a region of their own, and visit alike. So any two linked members meet at the home of one.
* **Recursion.** New regions above ``LEAF_ROWS`` members or ``BLOCK_SHINGLES`` shingles are divided again, unless nearly all of the members of the region
  came along, which new pivots would not part.
* **Leaves.** Members whose distances to a common pivot differ by over ``T`` are not compared (window). A leaf of many shingles is cut into bands
  of distance and parts of bounded size; parts of bands within ``T`` meet pairwise. Many leaves share a task, and each task holds a bounded number of
  shingles. Members first meet with only their shared prefix shingles, whose number bounds what two sets can have in common; those with no partner
  left go no further (first regions of up to ``LIGHT_ROWS`` members are thinned out like this before they are divided). The rest meet with whole sets. A task gives a row for each member with its number of links and the least member that it
  reaches, not a row for each pair.

A pair is compared where it belongs alone: in the least first region that both share, and there at one home (``_valid``). So
links are counted once.

The order of shingles goes by how often a hash sample of one in ``SAMPLE`` documents holds them, as far as that is more than once, and then by hash: so
texts put together from a stock of sentences meet where one sentence follows another, not within the sentences. The order
decides how large first regions get, not what is found.

Null text and text without words have no shingles and no links. Repeated rows count as documents. Rows with a null doc_id are never
linked. Rows of one doc_id are one node of the links, so they share a component, also if their texts differ. Very long texts
take part whole, as one set. Ties between pivots go to the least document; an empty table gives an empty result; other columns
are ignored. Shingles are told apart by 64-bit hashes, equal sets by two 64-bit sums of these.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.llm.shared import written
from pulsegrid.llm.textops import SPACED, grams, mix, slices, word_hashes, words

N = 5
SIMILARITY = 80  # per cent
T = 1 - SIMILARITY / 100
CORE = 0.5
SAMPLE = 16
HOT_SEEN = 2
MAX_HOT = 300_000
SMALL = 32
PIVOTS = 8
LIGHT_ROWS = 4096
LEAF_ROWS = 256
STUCK = 0.75  # a new region with more than this share of the old one's members is a leaf
BLOCK_SHINGLES = 200_000
BANDS = 20
#: Bits for each key of a filter, and the most 64-bit words of one: 16 MB. A fuller filter lets more rows through to the exact join.
KEY_BITS, FILTER_WORDS = 12, 1 << 21
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_EPS = 1e-9
HOME, VISITOR_FAR, VISITOR = 2, 1, 0


def shingle_sets(s, n: int = N):
    """Sorted distinct shingle hashes of each row of a slice."""
    starts, _, bounds = words(s, SPACED)
    h = word_hashes(s, starts, SPACED)
    g = grams(h, n)
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    whole = {int(i): grams(h[bounds[i] : bounds[i + 1]], int(sizes[i])) for i in short}
    for i in range(len(sizes)):
        if sizes[i] >= n:
            yield np.unique(g[bounds[i] : bounds[i + 1] - n + 1])
        else:
            yield whole.get(i, g[:0])


class Hot(NamedTuple):
    """Frequent shingles, sorted, and how often the sample holds each."""

    shingles: np.ndarray
    counts: np.ndarray


def prefix(shingles: np.ndarray, hot: Hot) -> np.ndarray:
    """The first shingles in the common order: rare ones by hash, then hot ones by count and hash."""
    n = len(shingles)
    size = n - -(-SIMILARITY * n // 100) + 1 if n else 0
    if len(hot.shingles):
        at = np.minimum(np.searchsorted(hot.shingles, shingles), len(hot.shingles) - 1)
        is_hot = hot.shingles[at] == shingles
        rare = shingles[~is_hot]
        if len(rare) < size:
            order = np.argsort(hot.counts[at[is_hot]], kind="stable")
            return np.concatenate([rare, shingles[is_hot][order[: size - len(rare)]]])
        return rare[:size]
    return shingles[:size]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate([np.zeros(0, np.uint64), *found])))


def _sum(x: np.ndarray) -> int:
    return int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0


def hot_shingles(docs: DataFrame) -> Hot:
    """At most MAX_HOT shingles that are frequent in a hash sample of documents."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                found = [x for x in shingle_sets(s)]
                yield pa.record_batch([_signed(np.concatenate(found))], ["shingle"])

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    seen = sampled.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(MAX_HOT).toArrow()
    shingles = np.asarray(rows.column("shingle")).view(np.uint64)
    order = np.argsort(shingles)
    return Hot(shingles[order], np.asarray(rows.column("n"))[order])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two sums that equal sets share, and the prefix shingles: texts are read for these once."""
    order = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs))

    def run(batches):
        hot = order.value
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for s in slices(batch.column("text")):
                found = list(shingle_sets(s))
                yield pa.record_batch(
                    [
                        ids.slice(s.first, len(found)),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([_sum(x) for x in found], pa.int64()),
                        pa.array([_sum(x ^ _OTHER) for x in found], pa.int64()),
                        _lists([prefix(x, hot) for x in found]),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


class BitFilter:
    """A Bloom filter over longs: each key sets three bits of one 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(x.astype(np.int64).view(np.uint64) ^ _OTHER)
        bit = lambda k: np.uint64(1) << (h >> np.uint64(k) & np.uint64(63))
        return (h & np.uint64(size - 1)).astype(np.int64), bit(40) | bit(46) | bit(52)

    def might_hold(self, x: np.ndarray) -> np.ndarray:
        word, mask = self.places(x, len(self.bits))
        return self.bits[word] & mask == mask


def bit_filter(keys: DataFrame) -> BitFilter:
    """The filter over the only column of ``keys``, a written table; each task sends the words that it has set."""
    size = min(FILTER_WORDS, 1 << max(6, (keys.count() * KEY_BITS // 64).bit_length()))

    def run(batches):
        for batch in batches:
            word, mask = BitFilter.places(np.asarray(batch.column(0)), size)
            order = np.argsort(word)
            at, first = np.unique(word[order], return_index=True)
            bits = np.bitwise_or.reduceat(mask[order], first) if len(first) else mask
            yield pa.record_batch([pa.array(at), _signed(bits)], ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size, np.uint64)
    bits[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return BitFilter(bits)


def shared_keys(signed: DataFrame, only) -> DataFrame:
    """(key, doc_id, s1, n_shingles) of the prefix shingles that a filter may hold."""

    def run(batches):
        wanted = only.value
        for batch in batches:
            lists = batch.column("keys")
            keys = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            keep = wanted.might_hold(keys)
            owner = pa.array(owner[keep])
            yield pa.record_batch([pa.array(keys[keep]), *(batch.column(c).take(owner) for c in ("doc_id", "s1", "n_shingles"))], ["key", "doc_id", "s1", "n_shingles"])

    return signed.select("keys", "doc_id", "s1", "n_shingles").mapInArrow(run, "key long, doc_id long, s1 long, n_shingles long")


def sets_of(docs: DataFrame, rows: DataFrame, single: bool) -> DataFrame:
    """(doc_id, s1, shingles), sorted as longs, a table that holds all documents of ``rows``; a bit filter finds them in the texts.

    ``single``: no doc_id occurs twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(written(rows.select("doc_id").distinct())))

    def run(batches):
        wanted = shared.value
        for batch in batches:
            keep = wanted.might_hold(np.asarray(batch.column("doc_id").cast(pa.int64())))
            batch = batch.filter(pa.array(keep))
            names = batch.column("doc_id").cast(pa.int64())
            for s in slices(batch.column("text")):
                found = [np.sort(x.view(np.int64)).view(np.uint64) for x in shingle_sets(s)]
                yield pa.record_batch([names.slice(s.first, len(found)), pa.array([_sum(x) for x in found], pa.int64()), _lists(found)], ["doc_id", "s1", "shingles"])

    found = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, s1 long, shingles array<long>")
    return written(found if single else found.dropDuplicates(["doc_id", "s1"]))


def first_regions(signed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (g, doc_id, s1, n_shingles, copies) of first regions, classes by their representatives; and of each its regions ``gs`` and shared prefix shingles ``ks``."""
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    keys = known.select(F.explode("keys").alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("g"), F.max("doc_id").alias("last"))
    keys = written(keys.filter("g < last").select("key", "g"))
    only = signed.sparkSession.sparkContext.broadcast(bit_filter(keys.select("key")))
    reps = classes.select(F.col("class_id").alias("doc_id"), "s1", "copies")
    found = written(shared_keys(known, only).join(keys, "key").join(reps, ["doc_id", "s1"]))
    members = written(found.groupBy("g", "doc_id", "s1").agg(F.first("n_shingles").alias("n_shingles"), F.first("copies").alias("copies")))
    several = members.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total")).filter("rows > 1")
    # a document has at most its prefix in shared shingles and in regions
    held = found.groupBy("doc_id", "s1").agg(F.sort_array(F.collect_set("key")).alias("ks"), F.sort_array(F.collect_set("g")).alias("gs"))
    return written(members.join(written(several), "g")), written(held)


def _distances(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows with their exact distances ``at`` to the pivots of their region and salt, the nearest first."""
    names = rows.columns
    schema = f"{UNITS.split(', i int')[0]}, old_rows long, at array<struct<d:double,i:int,name:string>>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in zip(columns, kinds)})
        sets = left.column("shingles").combine_chunks()
        flat, bounds = np.asarray(sets.flatten()), np.asarray(sets.offsets, np.int64)
        bounds, size = bounds - bounds[0], np.asarray(left.column("n_shingles"))
        right = right.sort_by([("pivot", "ascending"), ("pivot_s1", "ascending")])
        found, labels = [], []
        for q in right.to_pylist():
            own = np.array(q["set"], np.int64)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), bounds[:-1])
            found.append(1 - common / (len(own) + size - common))
            labels.append(f"{q['pivot']}:{q['pivot_s1']}")
        found = np.stack(found, 1)
        order = np.argsort(found, axis=1, kind="stable")
        at = [[{"d": float(found[k, i]), "i": i, "name": labels[i]} for i in row] for k, row in enumerate(order.tolist())]
        kept = [left.column(c) for c in names if c in columns]
        return pa.table([*kept, pa.array([q["old"]] * len(left), pa.int64()), pa.array(at, kinds[-1])], names=columns)

    columns = [*[c for c in names if c not in ("salt", "shingles")], "old_rows", "at"]
    place = pa.struct([("d", pa.float64()), ("i", pa.int32()), ("name", pa.string())])
    types = {"region": pa.string(), "roles": pa.list_(pa.int32()), "d": pa.float64(), "at": pa.list_(place)}
    kinds = [types.get(c, pa.int64()) for c in columns]
    return rows.groupBy("region", "salt").cogroup(pivots.groupBy("around", "part")).applyInArrow(run, schema)


def divided(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The members of new regions around pivots drawn in each region of ``rows``, at their homes and where they visit."""
    sizes = written(rows.groupBy("region").agg(F.count("*").alias("old_rows"), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("salts")))
    draw = F.xxhash64("doc_id", "s1", F.lit(level))
    drawn = rows.groupBy("region", F.pmod(draw, F.lit(PIVOTS)).alias("part")).agg(F.min_by(F.struct("doc_id", "s1"), F.struct(draw, "doc_id")).alias("q"))
    pivots = (
        drawn.select("region", F.col("q.doc_id").alias("doc_id"), F.col("q.s1").alias("s1"))
        .join(sets, ["doc_id", "s1"])
        .join(sizes, "region")
        .select(F.col("region").alias("around"), F.col("old_rows").alias("old"), F.col("doc_id").alias("pivot"), F.col("s1").alias("pivot_s1"), F.col("shingles").alias("set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("part"))
    )
    dealt_ = rows.join(sizes.select("region", "salts"), "region").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts")).drop("salts")
    met = written(_distances(dealt_.join(sets, ["doc_id", "s1"]).select(*rows.columns, "salt", "shingles"), pivots))
    least = F.col("at")[0]["d"]
    at_home = least <= CORE + _EPS
    visits = F.filter("at", lambda q: (q.d <= F.least(least + 2 * T, F.lit(CORE + T)) + _EPS) & ~(at_home & (q.i == F.col("at")[0]["i"])))
    spot = lambda q, role: F.struct(q["name"].alias("name"), q["d"].alias("d"), role.alias("role"))
    # those without a near pivot stay together, and know their distance to the first pivot
    first = F.filter("at", lambda q: q.i == 0)[0]
    home = F.when(at_home, spot(F.col("at")[0], F.lit(HOME))).otherwise(F.struct(F.lit("-").alias("name"), first["d"].alias("d"), F.lit(HOME).alias("role")))
    places = F.concat(F.array(home), F.transform(visits, lambda q: spot(q, F.when(at_home, VISITOR).otherwise(VISITOR_FAR))))
    return met.withColumn("place", F.explode(places)).select(
        "g", "doc_id", "s1", "n_shingles", "copies", F.concat_ws("/", "region", "place.name").alias("region"), F.array_append("roles", F.col("place.role")).alias("roles"), F.col("place.d").alias("d"), "old_rows"
    )


def _as_leaves(members: DataFrame) -> DataFrame:
    """First regions as leaves: no home, no pivot known."""
    return members.withColumn("region", F.col("g").cast("string")).withColumn("roles", F.array().cast("array<int>")).withColumn("d", F.lit(None).cast("double")).select(*LEAF)


LEAF = ["g", "region", "doc_id", "s1", "n_shingles", "copies", "roles", "d", "total"]


def voronoi(docs: DataFrame, open_: DataFrame, single: bool) -> DataFrame | None:
    """The members of all leaf regions that first regions are divided into; none if there is nothing to divide."""
    if open_.isEmpty():
        return None
    sets, done, level = sets_of(docs, open_, single), None, 0
    open_ = open_.select(*LEAF[:-1])
    while not open_.isEmpty():
        new = written(divided(open_, sets, level))
        sizes = new.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total"), F.max("old_rows").alias("old"), F.max(F.element_at("roles", -1)).alias("role"))
        again = ((F.col("rows") > LEAF_ROWS) | (F.col("total") > BLOCK_SHINGLES)) & (F.col("rows") <= STUCK * F.col("old")) & (F.col("rows") > SMALL)
        # a region of one member, or of visitors alone, has no pair
        sizes = written(sizes.filter((F.col("rows") > 1) & (F.col("role") == HOME)).select("region", "total", again.alias("again")))
        new = written(new.join(sizes, "region"))
        closed = new.filter("not again").select(*LEAF)
        done = closed if done is None else done.unionByName(closed)
        open_ = new.filter("again").select(*LEAF[:-1])
        level += 1
    return done


def dealt(rows: DataFrame) -> DataFrame:
    """Leaf members in units of bounded size: pairs (i, j) of parts, each of a band of distances, that may hold a link."""
    bands = F.when(F.col("d").isNull(), 1).otherwise(F.least(F.lit(BANDS), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    rows = rows.withColumn("bands", bands.cast("int")).withColumn("band", F.least(F.floor(F.coalesce("d", F.lit(0.0)) * F.col("bands")), F.col("bands") - 1).cast("int"))
    parts = rows.groupBy("region", "band").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("parts"))
    large = written(rows.filter(F.col("total") > BLOCK_SHINGLES).select("region").distinct())
    parts = parts.join(large, "region")
    known = written(parts.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("band", "parts"))).alias("known")))  # at most BANDS
    small = rows.join(known.select("region"), "region", "left_anti").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"))
    big = rows.join(known, "region")
    before = lambda band: F.aggregate(F.filter("known", lambda k: k.band < band), F.lit(0), lambda a, k: a + k.parts)
    mine = F.filter("known", lambda k: k.band == F.col("band"))[0]["parts"]
    big = big.withColumn("own", (before(F.col("band")) + F.pmod(F.xxhash64("doc_id", "s1"), mine)).cast("int"))
    # bands whose least distance is within T
    near = lambda k: (F.abs(k.band - F.col("band")) - 1) / F.col("bands") <= T + _EPS
    others = F.flatten(F.transform(F.filter("known", near), lambda k: F.sequence(before(k.band), before(k.band) + k.parts - 1)))
    big = big.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "known")
    return small.unionByName(big)


def _valid(x: np.ndarray, others: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Whether a pair of roles belongs here at each level: at the common home, at the one home, or at the home of the less of two."""
    ok = np.ones(len(others), bool)
    for level in range(len(x)):
        y = others[:, level]
        if x[level] == HOME:
            ok &= (y == HOME) | (y == VISITOR_FAR) | ((y == VISITOR) & less)
        elif x[level] == VISITOR_FAR:
            ok &= y == HOME
        else:
            ok &= (y == HOME) & ~less
    return ok


class Unit:
    """The members of one unit of comparison, with sorted longs of each: its set, or the shared part of its prefix."""

    def __init__(self, table: pa.Table, payload: str):
        get = lambda c: np.asarray(table.column(c))
        self.g = int(get("g")[0])
        self.ids, self.s1, self.n = get("doc_id"), get("s1"), get("n_shingles")
        self.own, self.i, self.j = get("own"), int(get("i")[0]), int(get("j")[0])
        self.d = table.column("d").to_numpy(zero_copy_only=False).astype(float)
        column = table.column(payload).combine_chunks()
        bounds = np.asarray(column.offsets, np.int64)
        self.flat, self.bounds = np.asarray(column.values)[bounds[0] : bounds[-1]], bounds - bounds[0]
        self.size = np.diff(self.bounds)
        roles = table.column("roles").combine_chunks()
        self.roles = np.asarray(roles.flatten()).reshape(len(self.ids), -1)
        self.lower = [[h for h in gs if h < self.g] for gs in table.column("gs").to_pylist()]

    def pairs(self, enough) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that belong to this unit and have enough in common, as row numbers."""
        a, b = [], []
        for k in range(len(self.ids)):
            if self.i == self.j:
                c = np.arange(k + 1, len(self.ids))
            elif self.own[k] == self.i:
                c = np.flatnonzero(self.own == self.j)
            else:
                continue
            n = self.n[k]
            ok = 100 * np.minimum(n, self.n[c]) >= SIMILARITY * np.maximum(n, self.n[c])
            apart = np.abs(self.d[k] - self.d[c])
            ok &= np.isnan(apart) | (apart <= T + _EPS)
            if self.roles.shape[1] and ok.any():
                less = (self.ids[k] < self.ids[c]) | ((self.ids[k] == self.ids[c]) & (self.s1[k] < self.s1[c]))
                ok &= _valid(self.roles[k], self.roles[c], less)
            c = c[ok]
            if not len(c):
                continue
            own, m = self.flat[self.bounds[k] : self.bounds[k + 1]], self.size[c]
            starts = np.concatenate([[0], np.cumsum(m)])
            held = self.flat[np.repeat(self.bounds[c] - starts[:-1], m) + np.arange(starts[-1])]
            hit = own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held
            common = np.add.reduceat(hit.astype(np.int64), starts[:-1])
            c = c[enough(n, self.n[c], common)]
            if self.lower[k]:  # pairs that share a lesser first region are counted there
                mine = set(self.lower[k])
                c = c[[mine.isdisjoint(self.lower[x]) for x in c.tolist()]] if len(c) else c
            a.append(np.full(len(c), k)), b.append(c)
        none = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linked(n, m, common):
    return 100 * common >= SIMILARITY * (n + m - common)


def _hopeful(n, m, shared):
    """Whether as many shared prefix shingles are enough: behind the shorter of both prefixes two sets share no more than what is left of one."""
    up = lambda x, by: -(-x // by)
    behind = np.maximum(up(SIMILARITY * n, 100) - 1, up(SIMILARITY * m, 100) - 1)
    return shared >= up((n + m) * SIMILARITY, 100 + SIMILARITY) - behind


def _least(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least id that it reaches over pairs (a, b)."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (before == label).all():
            return label


LINKS = "doc_id long, s1 long, links long, root long"
UNITS = "g long, region string, doc_id long, s1 long, n_shingles long, copies long, roles array<int>, d double, i int, j int, own int"


def _units(table: pa.Table):
    """Begin and end of each unit of a task's table, sorted by unit."""
    region = np.unique(np.array(table.column("region").to_pylist(), str), return_inverse=True)[1]
    i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
    change = (np.diff(region) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(region)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _tasked(units: DataFrame, size: Column) -> DataFrame:
    """Units grouped into tasks of about BLOCK_SHINGLES longs."""
    total = units.agg(F.sum(size)).first()[0] or 0
    tasks = max(1, -(-int(total) // BLOCK_SHINGLES))
    return units.withColumn("task", F.pmod(F.xxhash64("region", "i", "j"), F.lit(tasks)))


_BY_UNIT = [("region", "ascending"), ("i", "ascending"), ("j", "ascending")]


def hopeful(units: DataFrame, held: DataFrame) -> DataFrame:
    """The members of units that may have a link there, by their shared prefix shingles."""
    names = UNITS.replace(",", "").split()[::2]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_BY_UNIT)
        keep = np.zeros(len(table), bool)
        for begin, end in _units(table):
            a, b = Unit(table.slice(begin, end - begin), "ks").pairs(_hopeful)
            keep[begin + a] = keep[begin + b] = True
        return table.select(names).filter(pa.array(keep))

    dealt_ = _tasked(units.select(*names), F.lit(0.2) * F.col("n_shingles"))
    return written(dealt_.join(held, ["doc_id", "s1"]).groupBy("task").applyInArrow(run, UNITS))


def compared(units: DataFrame, pairs: bool = False) -> DataFrame:
    """For each member with links in a unit: how many documents it is linked with, and the least that it reaches; or all linked pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(_BY_UNIT)
        copies = np.asarray(table.column("copies"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for begin, end in _units(table):
            unit = Unit(table.slice(begin, end - begin), "shingles")
            a, b = unit.pairs(_linked)
            if not len(a):
                continue
            if pairs:
                columns = [np.maximum(unit.ids[a], unit.ids[b]), np.minimum(unit.ids[a], unit.ids[b])]
            else:
                weight = copies[begin:end]
                links = np.bincount(a, weight[b], minlength=end - begin) + np.bincount(b, weight[a], minlength=end - begin)
                found = np.flatnonzero(links)
                root = _least(end - begin, a, b, unit.ids)
                columns = [unit.ids[found], unit.s1[found], links[found].astype(np.int64), root[found]]
            for x, c in zip(out, columns):
                x.append(c)
        columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in out]
        return pa.table(dict(zip(("a", "b") if pairs else ("doc_id", "s1", "links", "root"), columns)))

    return units.groupBy("task").applyInArrow(run, "a long, b long" if pairs else LINKS)


def _classes(signed: DataFrame) -> DataFrame:
    return written(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))


def _repeated(signed: DataFrame) -> DataFrame:
    """doc_ids of more than one row."""
    return written(signed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))


def _links(docs: DataFrame, signed: DataFrame, classes: DataFrame, repeated: DataFrame, pairs: bool = False) -> DataFrame:
    members, held = first_regions(signed, classes)
    single = repeated.isEmpty()
    light = hopeful(dealt(_as_leaves(members.filter(F.col("rows") <= LIGHT_ROWS))), held).select(*LEAF[:-1]).dropDuplicates(["g", "doc_id", "s1"])
    sizes = light.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total"))
    light = written(light.join(sizes, "g"))
    small = dealt(light.filter(F.col("rows") <= SMALL).select(*LEAF))
    names = UNITS.replace(",", "").split()[::2]
    large = light.filter(F.col("rows") > SMALL).select(*LEAF).unionByName(_as_leaves(members.filter(F.col("rows") > LIGHT_ROWS)))
    divided_ = voronoi(docs, large, single)
    units = written(small.select(*names)) if divided_ is None else written(small.select(*names).unionByName(hopeful(dealt(divided_), held)))
    sets = sets_of(docs, units, single).join(held.select("doc_id", "s1", "gs"), ["doc_id", "s1"])
    return written(compared(_tasked(units, F.col("n_shingles")).join(sets, ["doc_id", "s1"]), pairs))


def ngram_links(docs: DataFrame) -> DataFrame:
    """(a, b) with a > b: every link between different sets, by the least document of each; classes of equal sets are in ``ngram_join``."""
    signed = written(signatures(docs))
    return _links(docs, signed, _classes(signed), _repeated(signed), pairs=True).filter("a <> b").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links (other documents linked with it, equal ones included) of each document."""
    signed = written(signatures(docs))
    classes, repeated = _classes(signed), _repeated(signed)
    links = _links(docs, signed, classes, repeated)
    edges = links.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    if not repeated.isEmpty():  # rows of one doc_id are one node
        nodes = signed.join(repeated, "doc_id").join(classes, ["n_shingles", "s1", "s2"])
        edges = edges.union(nodes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    labels = components(edges.filter("a <> b")).withColumnRenamed("node", "class_id")
    near = links.groupBy(F.col("doc_id").alias("class_id"), "s1").agg(F.sum("links").alias("near"))
    n_links = F.col("copies") - 1 + F.coalesce("near", F.lit(0))
    told = classes.join(labels, "class_id", "left").join(near, ["class_id", "s1"], "left")
    told = told.select("n_shingles", "s1", "s2", "class_id", F.coalesce("component", "class_id").alias("component_id"), n_links.alias("n_links"))
    found = signed.drop("keys").join(told, ["n_shingles", "s1", "s2"], "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    links_of = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")
    return found.select("doc_id", "n_shingles", own("component_id"), own("class_id"), links_of)
