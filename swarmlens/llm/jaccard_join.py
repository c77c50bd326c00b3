"""N-gram Jaccard join (7): an exact join in the Jaccard metric space by pivots and regions.

A document is its set of distinct five-word shingles (64-bit hashes), and
documents link when ``100 * |A & B| >= 80 * |A | B|``, i.e. within distance
r = 0.2 of 1 - Jaccard, which is a metric.

1.  Texts with one and the same set are one point of the space (`sid`).
2.  Outer regions.  The pivots are the singletons {s}, in one fixed order of
    all shingles: rare ones first, by hash within.  A point's home in the
    Voronoi diagram, ties going to the first pivot, is its first shingle.  By
    the triangle inequality of the symmetric difference a point within r
    lacks at most ``n - ceil(0.8 n)`` of its shingles, so the window that
    replicates a point is its first ``n - ceil(0.8 n) + 1`` pivots: two linked
    points meet in the region of their first common pivot.  What either has
    behind that pivot bounds what they share, and rules most pairs out.
    "Rare" comes from a counting table of fixed size over all documents;
    whatever it says, the order is the same for all documents and the join
    exact - it only keeps passages that many documents share from becoming
    regions.  Regions of the same points are one.
3.  Inner regions.  A region of up to ``block`` points joins its points.  A
    larger one takes some of its own points as pivots and measures everybody's
    distance to these: exactly within r, by a lower bound from class counts
    where that is beyond r.  A pivot's inner region is what lies within r of
    it; all of that is linked through the pivot, so of these points only the
    ones in the triangle-inequality window of a point outside
    (``d(y, q) >= d(z, q) - r`` for some z) are replicated to the rest.
    The rest and its windows are a region again, and so on while that shrinks
    it; what doesn't shrink is dealt by size into blocks of bounded size, and
    the pivots that two points of a pair of blocks have in common bound what
    they share.  A pair of blocks with many possible links measures its points
    instead and gives a spanning forest of its links, never its pairs.
4.  Pairs are cut by upper bounds of the intersection: from class counts, then
    from 16 bits of every shingle.  Then the exact sizes decide.

Links are pairs of points; components of them come from `components`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.components import connected, least_reached
from swarmlens.llm.overlaps import common_counts
from swarmlens.llm.rows import parted, without
from swarmlens.llm.scratch import Scratch
from swarmlens.llm.sketch import among, counted_bits, hashed, marked_bits
from swarmlens.llm.wordhash import blocks, shingles, words

CLASSES, FEW, MANY = 512, 128, 1024  #: classes of shingles of a point; of one with fewer than MANY shingles FEW do
RADIUS = 0.2
BLOCK_POINTS = 1024
DENSE = 4  #: possible links a point from which on a pair of blocks measures them itself
#: whether two points can be linked that meet at places ia, ib of their na, nb shingles, all before being different
MEET = "5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * least(na - ia, nb - ib) >= 4 * (na + nb)"


def shingle_sets(texts, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in blocks(texts):
        code, offset = shingles(words(texts[a:b]), width)
        for k in range(b - a):
            part = np.sort(code[offset[k] : offset[k + 1]])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
            yield part


def _common_shingles(docs: DataFrame, bits: int) -> np.ndarray:
    def hashes(batch):
        return shingle_sets(batch.column(0).to_pylist())

    def common(counts):
        mean = counts.mean()
        return mean + 8 * mean**0.5 + 32

    return counted_bits(docs.select("text"), hashes, common, bits)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _points(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, n, sid, pivots, classes) of every row of ``docs``; sid is null for an empty set."""
    shift = np.uint64(64 - int(len(common)).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, pivots, classes = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(s))
                sid.append(None)
                window = len(s) - -(-4 * len(s) // 5) + 1 if len(s) else 0
                if len(s):
                    sid[-1] = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                late = common[(s >> shift).astype(np.int64)]
                pivots.append(np.concatenate((s[~late], s[late]))[:window].view(np.int64))
                some = FEW if len(s) < MANY else CLASSES
                classes.append(np.bincount((s % np.uint64(some)).astype(np.int64), minlength=some))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), _lists(pivots, pa.int64()), _lists([np.minimum(c, 32767).astype(np.int16) for c in classes], pa.int16())],
                names=["doc_id", "n", "sid", "pivots", "classes"],
            )

    schema = "doc_id long, n long, sid long, pivots array<long>, classes array<short>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Space:
    """Exact distances between points; their sets are read again from the texts when asked for."""

    def __init__(self, docs: DataFrame, points: DataFrame, scratch: Scratch):
        self.docs, self.points, self.scratch = docs, points, scratch

    @staticmethod
    def _shared(both: DataFrame) -> DataFrame:
        """``both`` with ``most``, the intersection at most by the class counts ca, cb of na, nb shingles."""
        fold = lambda c: F.transform(F.sequence(F.lit(0), F.lit(FEW - 1)), lambda i: sum((F.get(c, i + k).cast("int") for k in range(FEW, CLASSES, FEW)), F.get(c, i).cast("int")))
        both = both.withColumn("fa", F.when(F.size("ca") > F.size("cb"), fold("ca")).otherwise(F.col("ca").cast("array<int>")))
        both = both.withColumn("fb", F.when(F.size("cb") > F.size("ca"), fold("cb")).otherwise(F.col("cb").cast("array<int>")))
        shared = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        # counts stop at 32767, which a set of so many shingles may pass
        return both.withColumn("most", F.when(F.least("na", "nb") > 30000, F.least("na", "nb")).otherwise(F.least(shared, "na", "nb"))).drop("ca", "cb", "fa", "fb")

    def possible(self, met: DataFrame) -> DataFrame:
        """The distinct (a, b) of ``met`` that class counts don't rule out."""
        side = self.points.select("sid", "n", "classes")
        pairs = self.scratch.keep(met.select("a", "b").distinct(), "met")
        both = self._shared(pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b"))
        return both.where("100 * most >= 80 * (na + nb - most)").select("a", "b")

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(a, b, d, link) for distinct kept ``pairs``; where sizes or class counts rule a link out, d is a lower bound."""
        side = self.points.select("sid", "n", "classes")
        both = self._shared(pairs.join(side.toDF("a", "na", "ca"), "a").join(side.toDF("b", "nb", "cb"), "b"))
        low = both.select("a", "b", (1 - F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))).alias("low"))
        low = self.scratch.keep(low, "bounds")
        near = self.scratch.keep(low.where(F.col("low") <= RADIUS + 1e-9).select("a", "b"), "near-pivots")
        exact = self.measured(near, screen=True)
        known = self.scratch.keep(low.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("d", "low").alias("d"), F.coalesce("link", F.lit(False)).alias("link")), "pivot-distances")
        self.scratch.drop(low, near, exact, pairs)
        return known

    def sets(self, needed: DataFrame) -> DataFrame:
        """(sid, set) of the sids in ``needed``."""
        # the documents to read again, as a bit array of bounded size; the join after it is exact
        names = self.scratch.keep(self.points.join(needed, "sid").select(F.xxhash64("doc_id").alias("h")), "needed")
        wanted = marked_bits(names)
        self.scratch.drop(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pick = np.flatnonzero(among(wanted, hashed(batch.column(0))))
                texts = batch.column(1).take(pa.array(pick)).to_pylist()
                for a, b in blocks(texts):
                    sid, sets = [], []
                    for s in shingle_sets(texts[a:b]):
                        if len(s):
                            sid.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                            sets.append(s.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), _lists(sets, pa.int64())], names=["sid", "set"])

        found = self.docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "sid long, set array<long>")
        # equal texts and what the bit array lets through give more rows than one a sid
        return self.scratch.keep(found.join(needed, "sid", "left_semi").dropDuplicates(["sid"]), "sets")

    def blocks(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs, links) within each region of ``members``, by pairs of blocks of bounded size: what may be linked, and a forest of what is.

        A block has points of sizes within a factor of 1.25, so it meets the
        blocks of its own and of the next range of sizes only.
        """
        sized = members.select("region", "sid", "n", "pivot", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("band"))
        many = sized.groupBy("region", "band").agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("k"))
        many = self.scratch.keep(many, "bands")
        own = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("k")).cast("int").alias("own")
        dealt = None
        for step in (0, 1, -1):  # with blocks of the own band, the next and the one before
            other = many.select("region", (F.col("band") - step).alias("band"), F.col("k").alias("others"))
            some = sized.join(many, ["region", "band"]).join(other, ["region", "band"]).select("*", own, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("with"))
            i, j = (F.least("own", "with"), F.greatest("own", "with")) if step == 0 else (F.col("own"), F.col("with")) if step == 1 else (F.col("with"), F.col("own"))
            some = some.select("region", (F.col("band") + min(step, 0)).alias("low"), F.lit(step != 0).alias("next"), i.alias("i"), j.alias("j"), "sid", "n", "pivot", (F.col("own") if step == 0 else F.lit(0 if step == 1 else 1)).alias("side"))
            dealt = some if dealt is None else dealt.unionByName(some)
        key = ["region", "low", "next", "i", "j"]
        windows = dealt.join(self.points.select("sid", "pivots"), "sid")
        found = windows.groupBy(*key).applyInPandas(_pairs_of_blocks, _BLOCK_PAIRS)
        found = self.scratch.keep(found, "block-pairs")
        dense = found.where("dense").select(*key, F.col("a").alias("sid"), "side")
        if dense.isEmpty():
            links = None
        else:
            sets = self.sets(dense.select("sid").distinct())
            links = dense.join(sets, "sid").groupBy(*key).applyInPandas(_links_of_blocks, "a long, b long").distinct()
            links = self.scratch.keep(links, "block-links")
            self.scratch.drop(sets)
        self.scratch.drop(many)
        return found.where("not dense").select("a", "b"), links

    def measured(self, pairs: DataFrame, screen: bool = False) -> DataFrame:
        """(a, b, d, link) for distinct kept ``pairs`` of sids; ``screen`` leaves out most pairs that don't link."""
        scratch = self.scratch
        sets = self.sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
        full = sets
        if screen:
            pairs = scratch.keep(self._screened(pairs, sets), "screened-pairs")
            full = _rows_of(sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "sid long, set array<long>", scratch)
        left = full.toDF("a", "sa")
        right = full.toDF("b", "sb")
        both = pairs.join(left, "a").join(right, "b")
        sized = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        result = sized.select(
            "a",
            "b",
            (1 - F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("d"),
            (100 * F.col("i").cast("long") >= 80 * (F.col("na") + F.col("nb") - F.col("i")).cast("long")).alias("link"),
        )
        result = scratch.keep(result, "distances")
        scratch.drop(sets, *([pairs] if screen else []))
        return result

    @staticmethod
    def _screened(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose sets, cut to 16 bits a shingle, can still link.

        Shingles that share their 16 bits are one code, so the intersection is
        at most that of the codes and the lesser number of shingles cut away.
        """
        codes = F.array_distinct(F.transform("set", lambda x: F.shiftright(F.shiftleft(x, 48), 48).cast("short")))
        short = sets.select("sid", F.size("set").alias("n"), codes.alias("codes"))
        both = pairs.join(short.toDF("a", "na", "ca"), "a").join(short.toDF("b", "nb", "cb"), "b")
        most = F.size(F.array_intersect("ca", "cb")) + F.least(F.col("na") - F.size("ca"), F.col("nb") - F.size("cb"))
        both = both.select("a", "b", "na", "nb", F.least(most, "na", "nb").cast("long").alias("most"))
        return both.where("100 * most >= 80 * (na + nb - most)").select("a", "b")


def _inner_pairs(members: DataFrame) -> DataFrame:
    """Pairs within regions of bounded size that can be linked, without those of two points of one pivot's inner region."""
    left = members.select("region", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("pivot").alias("pa"))
    right = members.select("region", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("pivot").alias("pb"))
    return left.join(right, "region").where(f"a < b and not (pa <=> pb and pa is not null) and {MEET}").select("a", "b")


def _pairs_of_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of points of two blocks, or of one, whose common pivots and sizes allow a link."""
    windows, n, sid = list(group["pivots"]), group["n"].to_numpy(), group["sid"].to_numpy()
    pivot, side = group["pivot"].astype("Int64"), group["side"].to_numpy()
    size = len(windows)
    shared = common_counts(windows)
    i, j = np.nonzero(np.triu(shared, 1))
    known = pivot.notna().to_numpy()
    name = pivot.fillna(0).to_numpy(np.int64)
    two = group["next"].iloc[0] or group["i"].iloc[0] != group["j"].iloc[0]
    fits = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & ~(known[i] & known[j] & (name[i] == name[j]))
    if two:
        fits &= side[i] != side[j]
    # shingles behind the end of the window that ends first may all be common
    width = np.array([len(x) for x in windows])
    most = shared[i, j].astype(np.int64) + np.maximum(n[i] - width[i], n[j] - width[j])
    fits &= 9 * most >= 4 * (n[i] + n[j])
    dense = fits.sum() > DENSE * size
    a, b = (sid, sid) if dense else (sid[i[fits]], sid[j[fits]])
    out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "side": side if dense else 0, "dense": bool(dense)})
    for k in ("region", "low", "next", "i", "j"):
        out[k] = group[k].iloc[0]
    return out[["region", "low", "next", "i", "j", "a", "b", "side", "dense"]]


_BLOCK_PAIRS = "region long, low int, next boolean, i int, j int, a long, b long, side int, dense boolean"


def _links_of_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between two blocks of points, or within one, from their sets."""
    sets, sid = [np.asarray(x) for x in group["set"]], group["sid"].to_numpy()
    n, size = np.array([len(x) for x in sets]), len(sets)
    shared = common_counts(sets)
    i, j = np.nonzero(np.triu(shared, 1))
    both = shared[i, j].astype(np.int64)
    linked = 100 * both >= 80 * (n[i] + n[j] - both)
    root = least_reached(size, i[linked], j[linked])
    other = np.flatnonzero(root != np.arange(size))
    a, b = sid[root[other]], sid[other]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def jaccard_links(docs: DataFrame, scratch: Scratch, block: int = 64, pivots: int = 4, sketch_bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """(points, links): a row (doc_id, n, sid) per document, and links (a, b) that connect all linked sids.

    Links between points that are both linked to one pivot may be left out:
    they don't change what is connected.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = _common_shingles(docs, sketch_bits)
    rows = scratch.keep(_points(docs, common), "points")
    ids = scratch.keep(rows.select("doc_id", "n", "sid"), "ids")
    # most sets are those of one document, whose rows need no shuffle
    first = ids.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count("*").alias("rows"))
    first = scratch.keep(first.where("rows > 1").select("sid", "first.doc_id"), "first")
    some, single = parted(rows.where("sid is not null"), F.col("sid"), first.select("sid"))
    points = some.join(first, [some.sid == first.sid, some.doc_id.eqNullSafe(first.doc_id)], "left_semi").dropDuplicates(["sid"])
    points = points.unionByName(some.join(first.select("sid"), "sid", "left_anti").select(*some.columns))
    points = points if single is None else points.unionByName(single)
    points = scratch.keep(points.select("sid", "doc_id", "n", "pivots", "classes"), "distinct-points")
    scratch.drop(rows, first)
    space = _Space(docs, points, scratch)

    members = _regions(points, scratch)
    met = [_inner_pairs(members.where(F.col("size") <= block))]
    links = []
    large = members.where(F.col("size") > block)
    while not large.isEmpty():
        inner, linked = _split(large, space, scratch, pivots)
        links.append(linked)
        met.append(_inner_pairs(inner.where(F.col("size") <= block)))
        some, forest = space.blocks(inner.where((F.col("size") > block) & ~F.col("shrunk")))
        met.append(some)
        if forest is not None:
            links.append(forest)
        large = inner.where((F.col("size") > block) & F.col("shrunk"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    if links:  # pairs of one component need no measuring
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        links = [scratch.keep(found.distinct(), "links-so-far")]
        roots = scratch.keep(connected(links[0], scratch), "roots-so-far")
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    pairs = scratch.keep(space.possible(pairs), "pairs")
    scratch.drop(members)
    links.append(space.measured(pairs, screen=True).where("link").select("a", "b"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return ids, scratch.keep(found.distinct(), "links")


def _regions(points: DataFrame, scratch: Scratch) -> DataFrame:
    """(region, sid, n, i, size, pivot) of the points of every region that may hold a link; i is the least place of its pivots.

    Regions of the same points are one.
    """
    entries = points.select(F.explode("pivots").alias("region"), "sid")
    # a point has each of its pivots once
    shared = entries.groupBy("region").agg(F.count("*").alias("points")).where("points > 1").select("region")
    shared = scratch.keep(shared, "regions")
    wanted = marked_bits(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                lists = part.column(2)
                region = lists.flatten().to_numpy(zero_copy_only=False)
                length = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), length)
                place = np.arange(len(region)) - np.repeat(np.cumsum(length) - length, length)
                pick = np.flatnonzero(among(wanted, region.view(np.uint64)))
                row = pa.array(row[pick])
                yield pa.RecordBatch.from_arrays([pa.array(region[pick]), part.column(0).take(row), part.column(1).take(row), pa.array(place[pick], pa.int64())], names=["region", "sid", "n", "i"])

    entries = points.select("sid", "n", "pivots").mapInArrow(run, "region long, sid long, n long, i long").join(shared, "region", "left_semi")
    entries = scratch.keep(entries, "entries")
    # the shorter of two linked points has their first common pivot within its first n - ceil(8 n / 9) + 1
    mark = F.struct(F.count("*"), F.min("sid"), F.max("sid"), F.bit_xor(F.xxhash64("sid")), F.bit_xor(F.xxhash64("sid", F.lit(1))))
    size = entries.groupBy("region").agg(F.count("*").alias("size"), F.xxhash64(mark).alias("same"), F.max(F.col("i") <= F.col("n") - F.ceil(8 * F.col("n") / 9)).alias("short"))
    members = entries.join(size.where("short"), "region").groupBy("same", "sid").agg(F.min("i").alias("i"), F.first("n").alias("n"), F.first("size").alias("size"))
    members = scratch.keep(members.select(F.col("same").alias("region"), "sid", "n", "i", "size", F.lit(None).cast("long").alias("pivot")), "members")
    scratch.drop(entries, shared)
    return members


def _rows_of(table: DataFrame, ids: DataFrame, schema: str, scratch: Scratch) -> DataFrame:
    """The rows of ``table`` whose first column may be in ``ids``, by a bit array of bounded size."""
    kept = scratch.keep(ids.select(F.xxhash64(ids.columns[0]).alias("h")), "wanted")
    wanted = marked_bits(kept)
    scratch.drop(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(range(1, batch.num_columns)).filter(pa.array(among(wanted, hashed(batch.column(0)))))

    return table.select(F.xxhash64(table.columns[0]), *table.columns).mapInArrow(run, schema)


def _split(large: DataFrame, space: _Space, scratch: Scratch, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One level of the recursion: members (region, sid, n, i, size, pivot, shrunk) of what is left, and links to pivots."""
    chosen = large.groupBy("region", F.pmod("sid", F.lit(pivots)).alias("k")).agg(F.min("sid").alias("q")).select("region", "q")
    chosen = scratch.keep(chosen, "pivots")
    star = large.join(chosen, "region").where("sid <> q").select("region", "sid", "n", "i", "q", F.col("size").alias("was"))
    star = scratch.keep(star, "star")
    distance = space.distances(scratch.keep(star.select(F.least("sid", "q").alias("a"), F.greatest("sid", "q").alias("b")).distinct(), "star-pairs"))
    # pivots have met everybody in their region and leave it
    rest = star.join(chosen.select("region", F.col("q").alias("sid")), ["region", "sid"], "left_anti")
    rest = rest.withColumn("a", F.least("sid", "q")).withColumn("b", F.greatest("sid", "q")).join(distance, ["a", "b"])
    near = F.when(F.col("link"), F.struct("d", "q"))
    home = rest.groupBy("region", "sid").agg(F.min(near).alias("home"), F.max("was").alias("was"), F.max("n").alias("n"), F.max("i").alias("i"))
    home = home.select("region", "sid", "n", "i", "was", F.col("home.q").alias("pivot"), F.col("home.d").alias("own"))
    home = scratch.keep(home, "homes")
    outside = rest.join(home.select("region", "sid", "pivot"), ["region", "sid"]).where("not (pivot <=> q)")
    outer = outside.groupBy("region", F.col("q").alias("pivot")).agg(F.min("d").alias("outer"))
    left = home.join(outer, ["region", "pivot"], "left").where((F.col("pivot").isNull()) | (F.col("own") >= F.col("outer") - RADIUS - 1e-9))
    size = left.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    members = left.join(size, "region").select("region", "sid", "n", "i", "size", "pivot", (F.col("size") <= 0.7 * F.col("was")).alias("shrunk"))
    members = scratch.keep(members, "members")
    links = scratch.keep(distance.where("link").select("a", "b"), "pivot-links")
    scratch.drop(star, chosen, home, distance)
    return members, links


def jaccard_classes(docs: DataFrame, scratch: Scratch | None = None, **settings) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and stand alone; a text of fewer
    than five words is one shingle; repeated rows and equal texts share a
    component; an empty table gives no rows; other columns are not looked at.
    A null doc_id is kept as a row, and stands for nothing smaller.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    points, links = jaccard_links(docs, scratch, **settings)
    roots = connected(links, scratch).toDF("sid", "root")
    rooted = points.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # as a table, so that the join can split a component of very many documents
    least = scratch.keep(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller doc_id.

    Rows that repeat a doc_id stay or go together; a null doc_id stays.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    kept = without(docs, jaccard_classes(docs, scratch).where("component_id < doc_id").select("doc_id"))
    scratch.leave()
    return kept


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
