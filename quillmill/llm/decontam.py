"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores a posting (term, document, position) for every training token that is a term of some test
item; tokens of other terms are never asked for. A search takes, for every window of an item, the corpus-wide
rarest terms, intersects their postings after subtracting the terms' offsets (a match of item position i at
document position p lies on diagonal p - i), and reads the other terms' postings on the surviving diagonals
only. Runs of consecutive matches as long as a window are the exact phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._rows import without
from ._store import mark, save, settle

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: No word: stands after a document's last token, so that the index also knows every document's length.
_END = "\u0000"
#: Rows of terms, tokens or ids that may be broadcast (under 64 bytes each); beyond, joins are shuffled.
BROADCAST_ROWS = 1_000_000


def _split(text: Column) -> Column:
    """ASCII lower-cased words; an empty string may stand first and last."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.split(low, _SEPARATORS, -1)


def _term(word: Column) -> Column:
    """A term's number; 0 is the end mark's."""
    h = F.xxhash64(word)
    return F.when(word == _END, F.lit(0).cast("long")).when(h == 0, F.lit(1).cast("long")).otherwise(h)


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the rows (already written) are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def read_items(items: DataFrame, window: int) -> DataFrame:
    """item_id, item, n, need and ip, word, term for every token; items without a word have no rows.

    ``item`` numbers an item by id and text; ``need`` is the length of its windows.
    """
    words = F.filter(_split(F.col("text")), lambda w: w != "")
    rows = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words.alias("_w")).dropDuplicates(["item"])
    rows = rows.select("item_id", "item", F.size("_w").alias("n"), F.least(F.size("_w"), F.lit(window)).alias("need"), F.posexplode("_w").alias("ip", "word"))
    return save(rows.withColumn("term", _term(F.col("word"))), "decontam-items")


def build_index(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The stored postings doc_id, key, pos, term of all tokens whose word is in ``tokens``; the whole texts are read.

    ``key`` is a hash of the text: rows that share an id are apart unless their texts are equal. The row with
    term 0 has the number of words as its pos.
    """
    vocabulary = tokens.select("word", "term").distinct().unionByName(docs.sparkSession.createDataFrame([(_END, 0)], "word string, term long"))
    vocabulary = _small(save(vocabulary, "decontam-terms"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), _split(F.col("text")).alias("_w"))
    first, last = F.col("_w")[0] == "", F.element_at("_w", -1) == ""
    count = F.greatest(F.lit(0), F.size("_w") - first.cast("int") - last.cast("int"))
    rows = rows.select("doc_id", "key", count.alias("_n"), F.concat("_w", F.array(F.lit(_END))).alias("_w"))
    rows = rows.select("doc_id", "key", "_n", F.posexplode("_w").alias("pos", "word")).join(vocabulary, "word")
    return save(rows.select("doc_id", "key", F.when(F.col("term") == 0, F.col("_n")).otherwise(F.col("pos")).alias("pos"), "term"), "decontam-index")


def _anchors(index: DataFrame, tokens: DataFrame, rarest: int) -> DataFrame:
    """item, ip, term, need: in every window that can occur, the ``rarest`` least frequent tokens."""
    frequency = index.where("term <> 0").groupBy("term").agg(F.count("*").alias("freq"))
    rows = tokens.join(frequency, "term", "left").select("item", "need", "n", F.struct("ip", "term", F.coalesce("freq", F.lit(0)).alias("freq")).alias("_t"))
    rows = rows.groupBy("item", "need", "n").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("need") + 1)))
    window = F.slice("_t", F.col("_s"), F.col("need"))
    ranked = F.array_sort(F.transform(window, lambda t: F.struct(t["freq"].alias("freq"), t["ip"].alias("ip"), t["term"].alias("term"))))
    rows = rows.select("item", "need", ranked.alias("_w")).where(F.col("_w")[0]["freq"] > 0)
    rows = rows.select("item", "need", F.explode(F.slice("_w", 1, rarest)).alias("_a"))
    return save(rows.select("item", "need", "_a.ip", "_a.term").distinct(), "decontam-anchors")


def phrases(index: DataFrame, tokens: DataFrame, rarest: int = 2) -> DataFrame:
    """doc_id, key, item, start, end (word positions, end exclusive) of every maximal run of matches that holds a window."""
    anchors = _small(_anchors(index, tokens, rarest))
    hits = index.join(anchors, "term").withColumn("diagonal", F.col("pos") - F.col("ip"))
    diagonals = hits.groupBy("doc_id", "key", "item", "diagonal").agg(F.count("*").alias("_n"), F.first("need").alias("need"))
    diagonals = save(diagonals.where(F.col("_n") >= F.least("need", F.lit(rarest))).select("doc_id", "key", "item", "diagonal"), "decontam-diagonals")
    asked = diagonals.join(_small(tokens.select("item", "ip", "term", "need")), "item").withColumn("pos", F.col("diagonal") + F.col("ip"))
    own = _small(save(diagonals.select("doc_id", "key").distinct(), "decontam-candidates"))
    postings = index.where("term <> 0").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("pos").alias("_p"), F.col("term").alias("_t"))
    postings = postings.join(own, F.col("_d").eqNullSafe(own["doc_id"]) & (F.col("_k") == own["key"]), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("pos") == F.col("_p")) & (F.col("term") == F.col("_t"))
    found = asked.join(postings, same).select("doc_id", "key", "item", "diagonal", "ip", "pos", "need")
    # Consecutive item positions keep ip - rank constant; repeated rows of a document have equal ranks.
    diagonal = Window.partitionBy("doc_id", "key", "item", "diagonal").orderBy("ip")
    runs = found.withColumn("_run", F.col("ip") - F.dense_rank().over(diagonal)).groupBy("doc_id", "key", "item", "diagonal", "_run")
    runs = runs.agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("need").alias("need"))
    return runs.where(F.col("end") - F.col("start") >= F.col("need")).select("doc_id", "key", "item", "start", "end").distinct()


def proximity(index: DataFrame, tokens: DataFrame, within: int = 20, rarest: int = 3) -> DataFrame:
    """doc_id, key, item, start: where an item's ``rarest`` least frequent terms all occur within ``within`` words.

    Items with fewer distinct terms that occur need all of those. Positions are dealt into overlapping stretches
    of twice ``within`` words, so each candidate group is as small as a stretch. Terms of equal frequency go by
    their number; null texts have no terms; empty tables give no rows.
    """
    frequency = index.where("term <> 0").groupBy("term").agg(F.count("*").alias("freq"))
    terms = tokens.select("item", "term").distinct().join(frequency, "term")
    place = Window.partitionBy("item").orderBy("freq", "term")
    terms = terms.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= rarest)
    wanted = terms.groupBy("item").agg(F.count("*").alias("need"))
    terms = _small(save(terms.select("item", "term").join(wanted, "item"), "decontam-near"))
    hits = index.join(terms, "term").withColumn("_b", F.expr(f"pos div {within}"))
    hits = hits.withColumn("_b", F.explode(F.array("_b", F.col("_b") - 1)))
    spots = hits.groupBy("doc_id", "key", "item", "need", "_b").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("_t"))
    # A start is a hit from which the stretch of ``within`` words has all the terms.
    begin = F.filter("_t", lambda x: F.size(F.array_distinct(F.transform(F.filter("_t", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + within)), lambda y: y["term"]))) == F.col("need"))
    return spots.select("doc_id", "key", "item", F.explode(begin).alias("_x")).select("doc_id", "key", "item", F.col("_x.pos").alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, rarest: int = 2) -> DataFrame:
    """doc_id, key, n_words, n_hit, items (sorted ids as strings) for every row of docs.

    Words are runs of ASCII letters and digits and of non-ASCII code points, ASCII lower-cased. A window is
    ``window`` consecutive words of an item, or the whole of a shorter one; n_hit counts the document's words
    inside any occurrence of a window. Null texts have no words; items without words match nothing; repeated
    items count once for each id; repeated documents each get the same row. Empty tables are fine, and columns
    other than doc_id, text and item_id, text are ignored.
    """
    tokens = read_items(items, window)
    index = build_index(docs, tokens)
    found = save(phrases(index, tokens, rarest), "decontam-phrases")
    ids = _small(save(tokens.select("item", F.col("item_id").cast("string").alias("_id")).distinct(), "decontam-ids"))
    listed = found.join(ids, "item").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("_id")).alias("items"))
    earlier = Window.partitionBy("doc_id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.col("start"))))
    spans = found.select("doc_id", "key", "start", "end").distinct()
    hit = spans.withColumn("_new", new).groupBy("doc_id", "key").agg(F.sum("_new").alias("n_hit"))
    marks = hit.join(listed, hit["doc_id"].eqNullSafe(listed["doc_id"]) & (hit["key"] == listed["key"])).select(hit["doc_id"].alias("_d"), hit["key"].alias("_k"), "n_hit", "items")
    every = index.where("term = 0").select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    return every.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a window of any item; all columns stay.

    Null and empty texts hold none and stay; repeated rows go or stay together; without items every row stays.
    """
    since = mark()
    marks = contamination(docs, items, window)
    return without(docs, settle(marks.where("n_hit > 0").select("doc_id", "key"), "decontam-gone", since))
