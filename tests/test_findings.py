"""What a reviewer found on larger tables, on small ones that show the same."""

import sqlite3
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmlens.operators import mentions
from swarmlens.plans import ranked, tools
from swarmlens.sources import paged
from swarmlens.streaming import actions as streams
from swarmlens.streaming import stateful


def test_tools_list_all_that_there_is(spark):
    nodes = spark.range(140).select(F.format_string("n%03d", "id").alias("id"), F.format_string("name %03d", "id").alias("name"), F.array(F.lit("Entity"), F.lit("Nation")).alias("labels"))
    edges = nodes.select(F.concat(F.lit("e"), "id").alias("id"), F.lit("BORDERS").alias("name"), F.concat("name", F.lit(" borders name 000")).alias("fact"), F.col("id").alias("source"), F.lit("n000").alias("target"))
    assert tools.run_tool("get_entity_summary", {"entity_name": "Name 000"}, nodes, edges).split("\n") == [f"name {k:03d} borders name 000" for k in range(140)]
    assert tools.run_tool("get_entities_by_type", {"entity_type": "Nation"}, nodes, edges).split("\n") == [f"name {k:03d}" for k in range(140)]
    assert tools.run_tool("get_entities_by_type", {"entity_type": "Nation", "limit": 2}, nodes, edges) == "name 000\nname 001"
    assert tools.run_tool("get_entity_summary", {"entity_name": "nobody"}, nodes, edges) == ""


def drained(frame, path):
    """The rows of a stream over what is there."""
    rows = []
    query = frame.writeStream.outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True)
    query.foreachBatch(lambda df, n: rows.extend(df.collect())).start().awaitTermination()
    return rows


def test_batches_of_a_long_log_take_time_in_proportion(spark, tmp_path):
    n = 400_003  # slicing off the front of what waits takes minutes here
    spark.range(n).select(F.lit("p").alias("platform"), F.col("id").cast("string").alias("text")).coalesce(1).write.json(f"{tmp_path}/in")
    began = time.time()
    rows = drained(streams.count_batches(spark.readStream.schema("platform string, text string").json(f"{tmp_path}/in")), tmp_path)
    assert time.time() - began < 40
    assert [(r["batch"], r["n"]) for r in rows] == [(k, 5) for k in range(n // 5)]
    assert sorted(int(x) for r in rows for x in r["text"].split("\n")) == list(range(n // 5 * 5))


def test_timed_batches_of_a_long_log_are_in_order(spark, tmp_path):
    n = 300_002
    seq = F.lit(n - 1) - F.col("id")  # the newest come first
    ends = spark.createDataFrame([("p", "s", n, None)], "platform string, simulation string, seq long, text string")
    told = spark.range(n).select(F.lit("p").alias("platform"), F.lit("s").alias("simulation"), seq.alias("seq"), seq.cast("string").alias("text"))
    told.unionByName(ends).coalesce(1).write.json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        began = time.time()
        rows = drained(stateful.timed_batches(spark.readStream.schema(told.schema).json(f"{tmp_path}/in")), tmp_path)
        assert time.time() - began < 40
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r["batch"], r["n"], r["reason"]) for r in rows] == [*((k, 5, "full") for k in range(n // 5)), (n // 5, 2, "end")]
    assert [int(x) for r in rows for x in r["text"].split("\n")] == list(range(n))


def test_queries_with_the_same_frequent_words_share_their_work(spark, tmp_path):
    """Every query has three words of all documents; a join of queries and documents makes 200 * 4000 rows a word."""
    docs = spark.range(4000).select(F.format_string("d%05d", "id").alias("doc"), F.concat(F.lit("order of customer "), (F.col("id") % 400).cast("string"), F.when(F.col("id") % 7 == 0, " late").otherwise("")).alias("text"))
    index = ranked.build(docs, f"file://{tmp_path}/index", slab=200)
    asked = spark.range(200).select(F.col("id").alias("q"), F.concat(F.lit("customer order of late "), (F.col("id") * 3).cast("string")).alias("text"))
    rows = {rare: sorted(map(tuple, ranked.search_many(index, asked, 12, rare=rare).collect())) for rare in (0, 50, 10**9)}
    assert len(rows[50]) == 200 * 12
    assert rows[50] == rows[0] == rows[10**9]
    before = set((tmp_path / "index" / "asked").iterdir())
    ranked.search_many(index, asked, 12, rare=50).collect()
    made = [spark.read.parquet(f"file://{p}") for p in set((tmp_path / "index" / "asked").iterdir()) - before]
    assert max(t.count() for t in made) <= 200 * 12  # no table of queries by documents
    shared = [t for t in made if "words" in t.columns]
    assert shared[0].select("words").distinct().count() == 1


def test_queries_that_differ_in_unknown_words_are_one(spark, tmp_path):
    """Each query has a word of its own that no document has; 300 of them meet 500 documents by a rare word."""
    docs = spark.range(1000).select(F.format_string("d%05d", "id").alias("doc"), F.concat(F.lit("order "), F.when(F.col("id") % 2 == 0, "nation 7 7").otherwise("nation")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([("e0", ""), ("e1", None), ("e2", "-")], "doc string, text string"))
    index = ranked.build(docs, f"file://{tmp_path}/index", slab=100)
    assert index.totals == (1003, 500 * 4 + 500 * 2) and index.table("postings").count() == 500 * 3 + 500 * 2
    asked = spark.range(300).select(F.col("id").alias("q"), F.concat(F.lit("order 7 nation 7 "), F.when(F.col("id") % 3 == 0, "7 ").otherwise(""), F.format_string("own%d", "id")).alias("text"))
    before = set((tmp_path / "index").glob("asked/*"))
    rows = sorted(map(tuple, ranked.search_many(index, asked, 4, rare=600).collect()))
    made = [spark.read.parquet(f"file://{p}") for p in set((tmp_path / "index").glob("asked/*")) - before]
    assert max(t.count() for t in made) <= 1000  # two queries by 500 documents, not 300
    assert [r[:2] for r in rows] == [(q, place) for q in range(300) for place in range(1, 5)]
    for q in (0, 1):  # each as if it were asked alone
        alone = sorted(map(tuple, ranked.search_many(index, asked.where(F.col("q") == q), 4, rare=600).collect()))
        assert alone == [r for r in rows if r[0] == q] and [r[1:] for r in rows if r[0] == q + 3] == [r[1:] for r in alone]
    assert rows[0][3] > rows[4][3]


def test_only_pieces_of_names_leave_a_text(spark):
    """A text of 40,000 different pieces holds two names; the others, a null and an empty one are nowhere."""
    long = "".join(f"{k:05d}é" for k in range(7000)) + " Straße NR 12345 ok"
    texts = [(1, long), (2, "nothing"), (3, None), (4, ""), (5, long), (6, "ÀB ok")]
    names = [("a", "straße nr 1"), ("b", "OK"), ("c", "straße nr 2"), ("d", None), ("e", ""), ("f", "nothing more"), ("g", "thing"), ("h", "àb"), ("i", "Nothing")]
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id string, name string")
    expected = sorted((i, k) for i, name in names for k, text in texts if name and text and name.lower() in text.lower())
    assert sorted(map(tuple, mentions.mentions(n, t).collect())) == expected
    counts = {i: sum(1 for j, _ in expected if j == i) for i, _ in names}
    assert {r["name_id"]: r["n_texts"] for r in mentions.mention_counts(n, t).collect()} == counts
    bits = mentions._filter(mentions._cut(n.where("name <> ''").select(F.lower("name").alias("key"), F.lower("name").alias("text")), lambda x: min(8, len(x))))
    assert mentions._cut(t.where("text_id = 1").select(F.col("text_id").alias("key"), F.lower("text")), [2, 5, 7, 8], bits).count() < 12


def test_only_texts_with_candidates_are_shuffled(spark):
    """Four of 3004 texts may hold a name; two of them are equal."""
    texts = spark.range(3000).select(F.col("id").alias("text_id"), F.concat(F.repeat(F.col("id").cast("string"), 50), F.when(F.col("id") == 7, " Straße NR").otherwise("")).alias("text"))
    some = spark.createDataFrame([(3001, "the Old Bridge of X"), (3002, "the Old Bridge of X"), (3003, "old bridge."), (3004, None)], "text_id long, text string")
    names = spark.createDataFrame([("a", "old bridge of x"), ("b", "straße nr"), ("c", "Old bridge"), ("d", None)], "name_id string, name string")
    met, _, rows = mentions._met(names, texts.unionByName(some), 8)
    assert sorted(r["text_id"] for r in rows.collect()) == [7, 3001, 3002, 3003]
    assert sorted((r["low"], r["copies"]) for r in met.collect()) == [("old bridge", 1), ("old bridge", 2), ("old bridge of x", 2), ("straße nr", 1)]


def test_pages_are_found_by_their_index(tmp_path):
    """Pages and ranges cost steps in proportion to their rows, with null keys, unique ones and a run of one key."""
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE edge (source TEXT, uuid TEXT)")
    keys = [None if k % 3 == 0 else "k" if k % 3 == 1 else f"{'az'[k % 2]}{k:06d}" for k in range(60_000)]
    con.executemany("INSERT INTO edge VALUES (?, ?)", ((key, str(k)) for k, key in enumerate(keys)))
    con.execute("CREATE INDEX by_source ON edge (source)")
    con.commit()
    con.close()
    schema = T.StructType([T.StructField("uuid", T.StringType())])
    reader = paged._PagedReader({"path": str(tmp_path / "a.db"), "table": "edge", "key": "source", "page": "37", "rows": "1000"}, schema)
    steps, opened = [0], sqlite3.connect(f"file:{tmp_path}/a.db?mode=ro", uri=True)
    opened.set_progress_handler(lambda: steps.__setitem__(0, steps[0] + 1), 1000)
    reader._run = lambda path, sql, args=(): opened.execute(sql, args).fetchall()
    parts = reader.partitions()
    assert len(parts) > 20 and steps[0] < 2 * 60  # instructions in thousands
    assert sorted(int(r[0]) for p in parts for r in reader.read(p)) == list(range(60_000))
    assert steps[0] < 60 * 60  # some dozens a row; entering each range at its lower end takes more than ten times that
    opened.close()
