"""MinHash near-duplicates (11): an inverted join over coordinates of signatures.

A document is its set of distinct three-word shingles (64-bit hashes) and has
a signature of 40 MinHash coordinates.  Documents link when ``100 * |A & B| >=
85 * |A | B|``.  Candidates are pairs that agree in 24 coordinates at least;
of pairs at a Jaccard of 0.85 all but 0.00003 do (binomial), of those above
more.  Full sets decide.

1.  Texts with one and the same set are one point (`sid`).
2.  Postings.  A point is posted under each of its coordinate-value pairs.
    Pairs that only one point has can't collide; a point with fewer than 24
    others collides with nobody.
3.  Prefix merging.  All coordinate-value pairs have one order, rare ones
    first.  Of its c pairs that others have, a point's first c - 24 + 1 are
    its prefix: two points that agree in 24 share one in both prefixes, so the
    lists of the prefixes are all that is merged.  Lists of the same points
    are one.
4.  A list is dealt into cells of bounded size; each gives a spanning forest
    of its collisions, the strongest first, so a group of copies costs as many
    confirmations as it has points.  Confirmed links give components.
5.  Skip merging.  What is left to compare in a list are the points outside its
    largest component, with all others; a list of one component is skipped.
    Where many are left, the list is merged with the next pair of its points
    instead (two points that agree in 24 share two in the next longer prefix,
    and so on), which parts those that only share a few common passages; the
    last such level, and lists with few left, compare signatures in pairs of
    blocks of bounded size.  A pair of blocks with many collisions measures its
    full sets at once and gives a spanning forest of its links, never its pairs.

Each pair of two components whose signatures agree in enough coordinates is
confirmed on the full sets or has been; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.components import connected, least_reached
from swarmlens.llm.overlaps import common_counts
from swarmlens.llm.rows import without
from swarmlens.llm.scratch import Scratch
from swarmlens.llm.sketch import among, hashed, marked_bits
from swarmlens.llm.wordhash import blocks, mix, shingles, words

WIDTH, SHARE = 3, 85
COORDINATES, MATCHES = 40, 24
CELL, BLOCK, LEVELS = 256, 512, 3
BLOCK_SHINGLES = 1 << 19  #: of a block, in the mean, so that very long texts make smaller blocks
TEXTS = 256  #: texts that are Python strings at a time
DENSE = 2  #: collisions a point from which on a pair of blocks measures its sets itself
_FACTORS = np.random.Generator(np.random.PCG64(1111)).integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)


def _sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of the column ``texts``, (shingles, offset): the sorted distinct shingles of each."""
    for part in (texts.slice(k, TEXTS).to_pylist() for k in range(0, len(texts), TEXTS)):
        yield from _sets_of(part)


def _sets_of(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in blocks(texts):
        code, offset = shingles(words(texts[a:b]), WIDTH)
        doc = np.repeat(np.arange(b - a), np.diff(offset))
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        code, doc = code[fresh], doc[fresh]
        yield code, np.searchsorted(doc, np.arange(b - a + 1))


def _name(code: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(code.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(code: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) int32 of non-empty sets; a coordinate is 32 bits of the least product of a shingle and its factor."""
    out = np.empty((len(offset) - 1, COORDINATES), np.int32)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(code * factor, offset[:-1]) if len(out) else code
        out[:, k] = (mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _points(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sid, signature) of every row of ``docs``; sid and signature are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for code, offset in _sets(batch.column(1)):
                n = np.diff(offset)
                full = n > 0
                sid = [_name(code[a:b]) if b > a else None for a, b in zip(offset[:-1], offset[1:])]
                own = signatures(code, np.concatenate((offset[:-1][full], offset[-1:])))
                ends = np.concatenate(([0], np.cumsum(full))) * COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.reshape(-1), pa.int32()), mask=pa.array(~full))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), lists], names=["doc_id", "n", "sid", "signature"])
                at += len(n)

    return docs.mapInArrow(run, "doc_id long, n long, sid long, signature array<int>")


def _orders(points: DataFrame, scratch: Scratch, matches: int) -> DataFrame:
    """(sid, posted): a point's coordinate-value pairs that others have, rare ones first; points with too few are left out."""
    pairs = points.select("sid", F.posexplode("signature").alias("k", "value"))
    pairs = pairs.select("sid", (F.shiftleft(F.col("k").cast("long"), 32) + F.pmod(F.col("value").cast("long"), F.lit(1 << 32))).alias("pair"))
    often = scratch.keep(pairs.groupBy("pair").agg(F.count("*").alias("often")).where("often > 1"), "pairs")
    posted = pairs.join(often, "pair").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("often", "pair"))).alias("posted"))
    return posted.where(F.size("posted") >= matches).select("sid", F.transform("posted", lambda x: x["pair"]).alias("posted"))


def _merged(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(list, sid, place, size) of ``entries`` (list, sid, place) in lists of two points or more; lists of the same points are one."""
    mark = F.struct(F.count("*").alias("size"), F.min("sid"), F.max("sid"), F.bit_xor(F.xxhash64("sid")), F.bit_xor(F.xxhash64("sid", F.lit(1))))
    sizes = entries.groupBy("list").agg(F.count("*").alias("size"), F.xxhash64(mark).alias("same")).where("size > 1")
    found = entries.join(scratch.keep(sizes, "sizes"), "list").groupBy("same", "sid").agg(F.min("place").alias("place"), F.first("size").alias("size"))
    return scratch.keep(found.withColumnRenamed("same", "list"), "lists")


def _next(entries: DataFrame, orders: DataFrame, level: int, matches: int) -> DataFrame:
    """(list, sid, place) of the next level: under the list and a later pair of the prefix that is one longer."""
    longer = entries.select("list", "sid", "place").join(orders, "sid").withColumn("end", F.size("posted") - matches + level)
    longer = longer.where("place + 1 < end")
    later = longer.select("list", "sid", "place", F.posexplode(F.slice("posted", F.col("place") + 2, F.col("end") - F.col("place") - 1)).alias("k", "pair"))
    return later.select(F.xxhash64("list", "pair").alias("list"), "sid", (F.col("place") + 1 + F.col("k")).alias("place"))


def _by_cell(rows: DataFrame, kernel: Callable) -> DataFrame:
    """(a, b, cell) that ``kernel`` finds in the rows of each cell, which has a bounded number; kernel gets a dict of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cell = held.column("cell").to_numpy()
            edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if len(edges):
                yield from found(held.slice(0, edges[-1]), np.concatenate(([0], edges)))
                held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from found(held, np.array([0, held.num_rows]))

    def found(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        columns = {name: table.column(name).to_numpy() for name in table.column_names if name != "signature"}
        flat = table.column("signature").combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        columns["signature"] = flat.to_numpy().reshape(-1, COORDINATES)
        out = []
        for low, high in zip(edges[:-1], edges[1:]):
            x, y = kernel({k: v[low:high] for k, v in columns.items()})
            out.append((np.minimum(x, y), np.maximum(x, y), np.full(len(x), columns["cell"][low])))
        out = [np.concatenate(x) for x in zip(*out)]
        for k in range(0, len(out[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)], pa.int64()) for x in out], names=["a", "b", "cell"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, cell long")


def _agreement(x: dict, y: dict) -> np.ndarray:
    """How many coordinates agree, for every two of two bounded cells; -1 where the sizes rule a link out."""
    total = np.zeros((len(x["n"]), len(y["n"])), np.int16)
    for k in range(COORDINATES):
        total += x["signature"][:, k][:, None] == y["signature"][:, k][None, :]
    n, m = x["n"][:, None], y["n"][None, :]
    total[100 * np.minimum(n, m) < SHARE * np.maximum(n, m)] = -1
    return total


def _forest(matches: int) -> Callable:
    def run(cell: dict) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the collisions within a cell, of most agreement (Prim)."""
        agree = _agreement(cell, cell)
        size = len(agree)
        best, near, a, b = agree[0].copy(), np.zeros(size, np.int64), [], []
        best[0] = -2
        for _ in range(size - 1):
            j = int(best.argmax())
            if best[j] >= matches:
                a.append(near[j])
                b.append(j)
            row = agree[j]
            nearer = (row > best) & (best > -2)
            best[nearer], near[nearer] = row[nearer], j
            best[j] = -2
        return cell["sid"][np.array(a, np.int64)], cell["sid"][np.array(b, np.int64)]

    return run


def _across(matches: int) -> Callable:
    def run(cell: dict) -> tuple[np.ndarray, np.ndarray]:
        """The collisions of points left (side 1) with all points (side 0) of other components; every point with itself if they are many."""
        left = cell["side"] == 1
        x, y = ({k: v[pick] for k, v in cell.items()} for pick in (left, ~left))
        i, j = np.nonzero((_agreement(x, y) >= matches) & (x["root"][:, None] != y["root"][None, :]))
        if len(i) > DENSE * len(left):
            every = np.unique(cell["sid"])
            return every, every
        return x["sid"][i], y["sid"][j]

    return run


def _links_of_cell(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links within a cell, from its sets."""
    sets, sid = [np.asarray(x) for x in group["set"]], group["sid"].to_numpy()
    n = np.array([len(x) for x in sets])
    shared = common_counts(sets)
    i, j = np.nonzero(np.triu(shared, 1))
    both = shared[i, j].astype(np.int64)
    linked = 100 * both >= SHARE * (n[i] + n[j] - both)
    root = least_reached(len(sets), i[linked], j[linked])
    other = np.flatnonzero(root != np.arange(len(sets)))
    a, b = sid[root[other]], sid[other]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


class _Confirmed:
    """Pairs of points measured on full sets, which are made again from the texts."""

    def __init__(self, docs: DataFrame, points: DataFrame, scratch: Scratch):
        self.docs, self.points, self.scratch = docs, points, scratch

    def sets(self, needed: DataFrame) -> DataFrame:
        """(sid, set) of the sids in ``needed``."""
        names = self.scratch.keep(self.points.join(needed, "sid").select(F.xxhash64("doc_id").alias("h")), "needed")
        wanted = marked_bits(names)  # holds most other documents back; the join after it decides

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen = batch.filter(pa.array(among(wanted, hashed(batch.column(0)))))
                for code, offset in _sets(chosen.column(1)):
                    offset = offset[np.concatenate(([True], np.diff(offset) > 0))]  # empty sets have no name
                    sid = [_name(code[a:b]) for a, b in zip(offset[:-1], offset[1:])]
                    lists = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(code.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), lists], names=["sid", "set"])

        found = self.docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "sid long, set array<long>")
        found = self.scratch.keep(found.join(needed, "sid", "left_semi").dropDuplicates(["sid"]), "sets")
        self.scratch.drop(names)
        return found

    def links(self, pairs: DataFrame, dense: DataFrame | None = None) -> DataFrame:
        """Those of the kept, distinct ``pairs`` (a, b) that link, and a forest of the links within the kept cells ``dense`` (cell, sid)."""
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))
        ends = ends if dense is None else ends.union(dense.select("sid"))
        needed = self.scratch.keep(ends.distinct(), "ends")
        sets = self.sets(needed)
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        sized = both.select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("n"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
        found = sized.where(f"100 * i >= {SHARE} * (n - i)").select("a", "b")
        if dense is not None:
            found = found.unionByName(dense.join(sets, "sid").groupBy("cell").applyInPandas(_links_of_cell, "a long, b long"))
        found = self.scratch.keep(found.distinct(), "links")
        self.scratch.drop(needed, sets)
        return found


def minhash_links(docs: DataFrame, scratch: Scratch, cell: int = CELL, block: int = BLOCK, levels: int = LEVELS, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """(ids, links): a row (doc_id, n, sid) per document, and links (a, b) that connect all linked sids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(_points(docs), "points")
    points = scratch.keep(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "distinct-points")
    ids = scratch.keep(rows.select("doc_id", "n", "sid"), "ids")
    scratch.drop(rows)
    orders = scratch.keep(_orders(points, scratch, matches), "orders")
    prefix = orders.select("sid", F.posexplode(F.slice("posted", F.lit(1), F.size("posted") - matches + 1)).alias("place", "list"))
    lists = _merged(scratch.keep(prefix.select("list", "sid", "place"), "postings"), scratch)
    confirmed = _Confirmed(docs, points, scratch)
    signed = points.select("sid", "n", "signature")

    # a second dealing of the larger lists brings the cells of a group together
    dealt = lists.withColumn("salt", F.explode(F.when(F.col("size") > cell, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    number = F.pmod(F.xxhash64("sid", "salt"), F.ceil(F.col("size") / cell))
    cells = dealt.select("sid", F.xxhash64("list", "salt", number).alias("cell")).join(signed, "sid")
    tried = scratch.keep(_by_cell(cells, _forest(matches)).select("a", "b").distinct(), "forest")
    links = confirmed.links(tried)

    roots = scratch.keep(connected(links, scratch).toDF("sid", "root"), "roots")
    lists = lists.where("size > 2")  # the forest of two points is all of them
    across = None
    for level in range(1, levels + 1):
        rooted = lists.select("list", "sid", "place").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rooted = scratch.keep(rooted.join(points.select("sid", "n"), "sid"), "rooted")
        parts = rooted.groupBy("list", "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        left = parts.groupBy("list").agg(F.sum("m").alias("size"), F.sum("n").alias("shingles"), F.max(F.struct("m", "root")).alias("most"))
        left = scratch.keep(left.select("list", "size", "shingles", F.col("most.root").alias("main"), (F.col("size") - F.col("most.m")).alias("left")).where("left > 0"), "left")
        now = left if level == levels else left.where(F.col("left") <= block)
        found = scratch.keep(_by_cell(_block_pairs(rooted.drop("n").join(now, "list"), block).join(signed, "sid"), _across(matches)), "across")
        across = found if across is None else across.unionByName(found)
        more = left.where(F.col("left") > block)
        if level == levels or more.isEmpty():
            break
        lists = _merged(_next(rooted.join(more, "list", "left_semi"), orders, level + 1, matches), scratch)
    pairs = across.where("a < b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    dense = across.where("a = b").select("cell", F.col("a").alias("sid"))
    more = confirmed.links(scratch.keep(pairs, "pairs-across"), scratch.keep(dense, "dense"))
    links = scratch.keep(links.unionByName(more), "all-links")
    return ids, links


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """(sid, root, side, cell): points left meet all points of their list in pairs of blocks."""
    smaller = F.greatest(F.lit(1.0), F.col("shingles") / F.col("size") * block / BLOCK_SHINGLES)  # long texts
    all_blocks, left_blocks = F.ceil(F.col("size") / block * smaller), F.ceil(F.col("left") / block * smaller)
    own = lambda n: F.pmod(F.xxhash64("sid", F.lit(7)), n)
    every = rows.select("*", own(all_blocks).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), left_blocks - 1)).alias("j"), F.lit(0).alias("side"))
    others = rows.where("root <> main").select("*", F.explode(F.sequence(F.lit(0).cast("long"), all_blocks - 1)).alias("i"), own(left_blocks).alias("j"), F.lit(1).alias("side"))
    return every.unionByName(others).select("sid", "root", "side", F.xxhash64("list", "i", "j").alias("cell"))


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, **settings) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and stand alone; a text of one or two
    words is one shingle; repeated rows and equal texts share a component, of
    which the rows with the least doc_id are kept; an empty table gives no
    rows; other columns are not looked at.  A null doc_id stands for nothing
    smaller and is kept where it stands alone.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    ids, links = minhash_links(docs, scratch, **settings)
    roots = connected(links, scratch).toDF("sid", "root")
    rooted = ids.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # as a table, so that the join can split a component of very many documents
    least = scratch.keep(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    found = rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller doc_id; a null doc_id stays."""
    scratch = Scratch(docs.sparkSession, "minhash")
    found = scratch.keep(near_duplicates(docs, scratch), "found")
    return without(docs, found.where("component_id < doc_id").select("doc_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
