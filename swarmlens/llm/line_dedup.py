"""Line dedup (3): a deletion-neighbourhood join over the words of lines.

A line is its sequence of words, A-Z in lower case.  Two lines match when they
are equal or within the edit bound of their length: one word put in, left out
or replaced where that leaves them 0.8 alike, which it does from ``MIN_WORDS``
words on.  A line goes if an earlier line of the corpus (by doc_id, then line)
matches it that stays: of a group of copies the earliest stays, and of a chain
in which each line matches only the one before every second.  (The earlier
lines looked at are the first of each group of step 2.)  Lines without a word
are left alone.

1.  Emit variants.  A variant of a line is what is left after at most one
    deletion, and lines within the bound share a variant.  A first key of a
    variant is its length and its four words that come first in a fixed
    order of words (long ones first, by hash within): equal variants have
    equal keys, and a line's variants have six keys, whatever its length.
    Lines that share no key with a different line are done.
2.  The rest, read again, emit the hash of every variant with the place of
    the deletion.  Lines with one variant and one place differ in that word
    only; a line that is itself a variant of another lacks one word of it.
    The earliest line of each group comes from a min-aggregation that combines
    before the shuffle: no pairs are made, however many copies a line has.
3.  Verify.  A line and the earliest of its group are compared word by word:
    without the word of that place they have to be equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.rows import numbered, parted
from swarmlens.llm.scratch import Scratch
from swarmlens.llm.sketch import among, hashed, marked_bits
from swarmlens.llm.wordhash import blocks, mix, power_tables, words

U64 = np.uint64
MIN_WORDS = 5  #: words of the shortest lines that match with one word changed
SELECTED = 4


class LineWords:
    """Lines with a word of a block of texts: text, number, word range and hash of each."""

    def __init__(self, texts: list[str | None]):
        w = words(texts)
        newline = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate((w.first[:-1], newline + 1)))
        end = np.sort(np.concatenate((w.first[1:] - 1, newline)))
        doc = np.searchsorted(w.first, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
        left, right = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = right > left
        self.doc, self.number, self.left, self.right = doc[has], number[has], left[has], right[has]
        self.words = w
        self.size = self.right - self.left
        power, self.inverse = power_tables(len(w.hash) + 1)
        self.total = np.zeros(len(w.hash) + 1, U64)
        np.cumsum(w.hash * power[: len(w.hash)], out=self.total[1:])
        self.hash = self._named((self.total[self.right] - self.total[self.left]) * self.inverse[self.left], self.size)

    @staticmethod
    def _named(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value ^ mix(size.astype(U64)))

    def keys(self) -> np.ndarray:
        """(lines, SELECTED + 2) first keys of the variants of every line."""
        n = len(self.size)
        return np.concatenate([self._keys(k, min(n, k + (1 << 20))) for k in range(0, n, 1 << 20)] or [np.zeros((0, SELECTED + 2), U64)])

    def _keys(self, a: int, b: int) -> np.ndarray:
        w, n, sizes = self.words, b - a, self.size[a:b]
        line = np.repeat(np.arange(n), sizes)
        at = np.repeat(self.left[a:b] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(line))
        order = mix(w.hash[at] ^ U64(0x5851F42D4C957F2D)) >> U64(25)
        order |= ((w.end[at] - w.start[at]) <= 4).astype(U64) << U64(39)
        order |= line.astype(U64) << U64(40)
        order.sort()
        order = order[np.concatenate((order[:1] == order[:1], order[1:] != order[:-1]))]
        line = (order >> U64(40)).astype(np.int64)
        order &= U64((1 << 40) - 1)
        place = np.arange(len(line)) - np.searchsorted(line, np.arange(n))[line]
        table = np.zeros((n, SELECTED + 1), U64)  # 0 where a line has fewer different words
        pick = place <= SELECTED
        table[line[pick], place[pick]] = mix(order[pick])
        whole = table[:, :SELECTED].sum(1, dtype=U64)
        more = whole + table[:, SELECTED]
        size = sizes.astype(U64)
        out = np.empty((n, SELECTED + 2), U64)
        out[:, 0] = self._named(whole, size)
        out[:, 1] = self._named(whole, size - U64(1))
        for k in range(SELECTED):
            out[:, 2 + k] = self._named(more - table[:, k], size - U64(1))
        return out

    def variants(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, offset): of each line of ``pick`` its own, then without its first, second, ... word."""
        size, left, right = self.size[pick], self.left[pick], self.right[pick]
        line = np.repeat(np.arange(len(pick)), size)
        at = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(len(line))
        before = self.total[at] - self.total[left[line]]
        after = (self.total[right[line]] - self.total[at + 1]) * self.inverse[1]
        offset = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.empty(offset[-1], U64)
        out[offset[:-1]] = self.hash[pick]
        out[np.arange(len(line)) + line + 1] = self._named((before + after) * self.inverse[left[line]], size[line] - 1)
        return out, offset

    def text(self, k: int) -> bytes:
        """The words of line k with a space between."""
        raw = self.words.data[self.words.start[self.left[k]] : self.words.end[self.right[k] - 1]].tobytes()
        return b" ".join(raw.split())  # at the same six bytes that words end at


def _numbers(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Callable]:
    """(doc_id, hash, text, h) of ``docs``, and what gives the row of each in a batch of that.

    A row is 0, but a hash of the text where rows of different texts may share a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = scratch.keep(docs.groupBy("doc_id").count().where("count > 1").select(F.xxhash64("doc_id").alias("h")), "repeated-ids")
    wanted = marked_bits(repeated)  # ids that it lets through as well get a hash for a row, which changes nothing
    scratch.drop(repeated)

    def rows(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(np.where(among(wanted, hashed(batch.column(3))), batch.column(1).to_numpy(zero_copy_only=False), 0), pa.int64())

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", F.xxhash64("doc_id").alias("h")), rows


def _lines(docs: DataFrame, rows_of: Callable) -> DataFrame:
    """(doc_id, row, line, lid, keys) of every line that has a word; keys are empty below MIN_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, every = batch.column(2).to_pylist(), rows_of(batch)
            for a, b in blocks(texts):
                lines = LineWords(texts[a:b])
                keys = lines.keys() if len(lines.size) else np.zeros((0, SELECTED + 2), U64)
                offsets = np.zeros(len(keys) + 1, np.int32)
                long = lines.size >= MIN_WORDS
                np.cumsum(long * (SELECTED + 2), out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=None), pa.array(keys[long].reshape(-1).view(np.int64)))
                ids, rows = (c.slice(a, b - a).take(pa.array(lines.doc)) for c in (batch.column(0), every))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(lines.number, pa.int32()), pa.array(lines.hash.view(np.int64)), lists], names=["doc_id", "row", "line", "lid", "keys"])

    return docs.mapInArrow(run, "doc_id long, row long, line int, lid long, keys array<long>")


def _occurrence(doc_id: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.view(U64) + row.view(U64) * U64(3)) + line.astype(U64))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _alike(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """lids of lines that share a key with a different line."""
    shared = lines.select("lid", F.explode("keys").alias("key")).groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a < b").select("key")
    shared = scratch.keep(shared, "shared-keys")
    wanted = marked_bits(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            key = lists.flatten().to_numpy(zero_copy_only=False)
            lid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            pick = among(wanted, key.view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(lid[pick])], names=["key", "lid"])

    entries = lines.select("lid", "keys").mapInArrow(run, "key long, lid long").distinct()
    found = scratch.keep(entries.join(shared, "key", "left_semi").select("lid").distinct(), "alike")
    scratch.drop(shared)
    return found


def _variants(docs: DataFrame, rows_of: Callable, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row, line, words, n, variants) of the lines of ``near`` (doc_id, row, line); ``variants`` begins with the line's own hash.

    ``words`` are the line's n words with a space between.

    Lines that a bit array of bounded size lets through come with them, which changes nothing but the work.
    """

    def run_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _occurrence(_ids(batch.column(0)), _ids(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], names=["h"])

    names = scratch.keep(near.select("doc_id", "row", "line").mapInArrow(run_names, "h long"), "occurrences")
    wanted = marked_bits(names)
    scratch.drop(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, every = batch.column(2).to_pylist(), _ids(batch.column(0)), rows_of(batch)
            rows = every.to_numpy()
            for a, b in blocks(texts):
                block = LineWords(texts[a:b])
                pick = np.flatnonzero(among(wanted, _occurrence(ids[a:b][block.doc], rows[a:b][block.doc], block.number)) & (block.size >= MIN_WORDS))
                if not len(pick):
                    continue
                variant, offset = block.variants(pick)
                lists = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(variant.view(np.int64)))
                said = pa.array([block.text(k) for k in pick.tolist()], pa.binary()).cast(pa.string())
                doc, row = (c.slice(a, b - a).take(pa.array(block.doc[pick])) for c in (batch.column(0), every))
                yield pa.RecordBatch.from_arrays([doc, row, pa.array(block.number[pick], pa.int32()), said, pa.array(block.size[pick], pa.int32()), lists], names=["doc_id", "row", "line", "words", "n", "variants"])

    found = docs.mapInArrow(run, "doc_id long, row long, line int, words string, n int, variants array<long>")
    if wanted is None:  # no array could hold them
        found = found.join(near.toDF("d", "r", "l"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("line") == F.col("l")), "left_semi")
    return scratch.keep(found, "variants")


def _verified(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """(at, with) of the ``pairs`` (at, with, place, kind) whose words bear the match out.

    ``said`` has the (at, words, n) of all lines in them, as a table, so that
    the many lines whose partner is one and the same can be split.
    Kind 0: both lines lack the word at ``place``; 1: the line has it, its
    partner is the rest; -1: the other way round.  In each case the words
    before the place are equal, and so are those after it.
    """
    both = pairs.join(said.toDF("at", "a", "na"), "at").join(said.toDF("with", "b", "nb"), "with")
    part = lambda c, n: F.call_function("substring_index", F.col(c), F.lit(" "), n)
    before, after = F.col("place"), F.col("place") + 1 - F.greatest("na", "nb")
    same = (F.col("na") - F.col("nb") == F.col("kind")) & (part("a", before) == part("b", before)) & (part("a", after) == part("b", after))
    return both.where(same).select("at", "with")


def _matched(pairs: DataFrame, texts: DataFrame, scratch: Scratch, made_of: tuple[DataFrame, ...]) -> DataFrame:
    """(doc_id, row, line) of the lines that one of their ``pairs`` bears out whose partner stays.

    The first partner of each is compared; where that fails, or goes itself,
    all of them are.  ``made_of`` are the tables that both come from, which nothing else reads.
    """
    pairs = scratch.keep(pairs, "pairs")
    texts = scratch.keep(texts.select(F.struct("doc_id", "row", "line").alias("at"), "words", "n").dropDuplicates(["at"]), "texts")
    scratch.drop(*made_of)
    first = pairs.groupBy("at").agg(F.min(F.struct("with", "place", "kind")).alias("p")).select("at", "p.*")
    first = scratch.keep(first, "first-partners")
    good = scratch.keep(_verified(first, texts), "verified")
    others = first.select("at").join(good, "at", "left_anti").unionByName(good.join(good.select(F.col("at").alias("with")).distinct(), "with", "left_semi").select("at"))
    others = scratch.keep(others, "to-verify")
    links = good
    if not others.isEmpty():
        links = good.unionByName(_verified(pairs.join(others, "at", "left_semi"), texts)).distinct()
        links = scratch.keep(links, "verified-others")
    return _decided(links, scratch).select("at.doc_id", "at.row", "at.line")


def _decided(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(at) of the lines that go, given the kept ``links`` (at, with) of lines to earlier ones: those with a partner that stays.

    A round decides the lines whose partners are all decided, and the first
    lines of all chains stay, so the rounds are as many as the longest chain
    has lines; most lines are decided in the first.
    """
    # what has no earlier partner stays
    gone = scratch.keep(links.join(links.select(F.col("at").alias("with")).distinct(), "with", "left_anti").select("at").distinct(), "gone")
    open_links = scratch.keep(links.join(gone, "at", "left_anti"), "open-links")
    while not open_links.isEmpty():
        # partners that are open are not decided yet; of the others those that aren't gone stay
        lines = open_links.select(F.col("at").alias("with")).distinct()
        known = open_links.join(gone.select(F.col("at").alias("with"), F.lit(True).alias("goes")), "with", "left").join(lines.withColumn("open", F.lit(True)), "with", "left")
        state = known.groupBy("at").agg(F.bool_and(F.coalesce("goes", F.lit(False))).alias("stays"), F.bool_or(F.col("goes").isNull() & F.col("open").isNull()).alias("goes"))
        state = scratch.keep(state, "decided")
        gone = gone.unionByName(state.where("goes").select("at"))
        # a line that stays is no longer open, so that those after it go
        open_links = scratch.keep(open_links.join(state.where("stays or goes").select("at"), "at", "left_anti"), "open-links")
    return gone


def dropped_lines(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): all lines with a word (doc_id, row, line), and those that an earlier line matches."""
    docs, rows_of = _numbers(docs, scratch)
    lines = scratch.keep(_lines(docs, rows_of), "lines")
    first = lines.groupBy("lid").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n"))
    first = scratch.keep(first, "first")
    again = lines.select("doc_id", "row", "line", "lid").join(first.where("n > 1").drop("n"), "lid").where("not (doc_id <=> first.doc_id and row = first.row and line = first.line)").select("doc_id", "row", "line")
    again = scratch.keep(again, "again")
    alike = _alike(lines, scratch)
    near = scratch.keep(first.join(alike, "lid", "left_semi").select("first.doc_id", "first.row", "first.line"), "near")
    count = scratch.keep(lines.select("doc_id", "row", "line"), "numbers")
    scratch.drop(first, alike, lines)
    texts = _variants(docs, rows_of, near, scratch)
    scratch.drop(near)
    at = F.struct("doc_id", "row", "line").alias("at")
    # the line's own hash is at place -1
    each = texts.select(at, F.posexplode("variants").alias("place", "variant")).withColumn("place", F.col("place") - 1)
    groups = each.groupBy("variant", "place").agg(F.min("at").alias("earliest"), F.count("*").alias("members"))
    groups = scratch.keep(groups, "variant-groups")
    # a group matters if it has two members, or if its variant is also a line
    whole = groups.where("place < 0").select("variant", F.col("earliest").alias("line_at"))
    useful = groups.where("place >= 0").join(whole, "variant", "left").where("members > 1 or line_at is not null").select("variant", "place", "earliest", "line_at")
    useful = scratch.keep(useful, "useful-groups")
    scratch.drop(groups)
    shorter = useful.where("earliest < line_at").select(F.col("line_at").alias("at"), F.col("earliest").alias("with"), "place", F.lit(-1).alias("kind"))
    keys = scratch.keep(useful.select("variant"), "useful-variants")
    wanted = marked_bits(keys)
    scratch.drop(keys)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                lists = part.column(3)
                length = lists.value_lengths().to_numpy(zero_copy_only=False)
                variant = lists.flatten().to_numpy(zero_copy_only=False)
                place = np.arange(len(variant)) - np.repeat(np.cumsum(length) - length, length) - 1
                pick = np.flatnonzero(among(wanted, variant.view(U64)) & (place >= 0))
                row = pa.array(np.repeat(np.arange(part.num_rows), length)[pick])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in range(3)), pa.array(variant[pick]), pa.array(place[pick], pa.int32())], names=["doc_id", "row", "line", "variant", "place"])

    some = texts.select("doc_id", "row", "line", "variants").mapInArrow(grouped, "doc_id long, row long, line int, variant long, place int")
    met = scratch.keep(some.select(at, "variant", "place").join(useful, ["variant", "place"]), "met")
    fellow = met.where("earliest < at").select("at", F.col("earliest").alias("with"), "place", F.lit(0).alias("kind"))
    longer = met.where("line_at < at").select("at", F.col("line_at").alias("with"), "place", F.lit(1).alias("kind"))
    near_lines = _matched(fellow.unionByName(longer).unionByName(shorter), texts, scratch, (texts, met, useful))
    return count, scratch.keep(again.unionByName(near_lines).distinct(), "dropped")


def line_report(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row (doc_id, n_lines, n_dropped, dropped) per doc_id of ``docs``; ``dropped`` are line numbers from 0.

    Null and empty texts have no lines; equal rows are one; rows of different
    texts that repeat a doc_id are told apart, in an order by hash, and counted
    together; a null doc_id is before all others; an empty table gives no rows; other
    columns are not looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines, dropped = dropped_lines(docs, scratch)
    total = lines.distinct().groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    gone = dropped.groupBy("doc_id").agg(F.count("*").alias("n_dropped"), F.array_sort(F.collect_list("line")).alias("dropped"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = every.join(total, every.doc_id.eqNullSafe(total.doc_id), "left").join(gone, every.doc_id.eqNullSafe(gone.doc_id), "left")
    return rows.select(
        every.doc_id,
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def without_repeated_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the matched lines taken out of ``text``, and ``n_chars`` counted again if there is one.

    A document that had words and has none left is itself a repeat and goes.
    Equal rows stay or go together; of rows that repeat a doc_id with different
    texts each loses its own matched lines; null texts stay as they are, and an
    empty table gives no rows.
    """
    own = scratch is None
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    _, dropped = dropped_lines(docs, scratch)
    gone = dropped.groupBy("doc_id", "row").agg(F.concat(F.array(F.lit(-1)), F.array_sort(F.collect_set("line"))).alias("gone")).withColumnRenamed("doc_id", "key")
    gone = scratch.keep(gone, "gone-lines")
    if own:
        scratch.leave(gone)
    rows, place = numbered(docs)
    rows, whole = parted(rows, rows[place["doc_id"]].cast("long"), gone.select("key"))
    rows = rows.withColumn("hash", F.xxhash64(place["text"]))
    same = rows[place["doc_id"]].cast("long").eqNullSafe(F.col("key"))
    rows = rows.join(gone.where("row = 0").select("key", "gone"), same, "left").drop("key")
    told = gone.where("row <> 0").select("key", "row", F.col("gone").alias("told"))  # rows that share a doc_id with others
    rows = rows.join(told, rows[place["doc_id"]].cast("long").eqNullSafe(F.col("key")) & (rows["hash"] == told["row"]), "left").withColumn("gone", F.coalesce("gone", "told")).drop("key", "row", "told")

    def kept_of(lines):
        def piece(k):
            before = F.get("gone", k)
            return F.slice(lines, before + 2, F.coalesce(F.get("gone", k + 1), F.size(lines)) - before - 1)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone") - 1), piece)), "\n")

    # split above the join, which then shuffles each text once; as an argument, so that it is split once and not for every piece
    left = F.get(F.transform(F.array(F.split(place["text"], "\n")), kept_of), F.lit(0))
    rows = rows.withColumn("left", F.when(F.col("gone").isNull(), F.col(place["text"])).otherwise(left))
    rows = rows.where(F.col("gone").isNull() | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {place["text"]: F.col("left")}
    if "n_chars" in place:
        changed[place["n_chars"]] = F.length("left").cast(dict(docs.dtypes)["n_chars"])
    rows = rows.withColumns(changed).select(*place.values())
    return (rows if whole is None else rows.unionByName(whole)).toDF(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
