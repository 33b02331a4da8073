"""Benchmark decontamination: an exact, prefix-filtered set join in DataFrame operations.

A window is `size` consecutive words of an item, or all words of a shorter
one. Its shingles are its pairs of neighbouring words (its only word, if it
has one). One scan lists the places in all documents where some window's
shingle stands, and from them shingles are counted; a window's prefix is its
rarest shingle, because a document that holds the window must hold that
shingle, at a known distance from the window's start. So only places with some
window's prefix are starts to try; the positional and length bounds discard
one before the text's first word or with an end behind its last. Windows with
a shingle that no document has cannot occur and are left out. Starts to try
meet their document once, as a list, and are verified there word by word; other
documents are not read again for it.

Shingles, and ids of documents with starts, are broadcast only while their
measured size stays under a bound; above it the same joins are shuffled. Rows
that are shuffled by shingle hold a place, never a text.

Defined results: null or empty texts have no words and no hits; an item
without words has no windows; items with equal texts all count; an item whose
id is null counts for hits, not among items; rows of equal id with different
texts are told apart by a hash of the text and each get their own result;
repeated rows each get a row; empty tables on either side give no hits; very
long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import WORD_ALNUM, ascii_lower, removed, shared_dir, stored

#: Words, as bytes of window text, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_ALNUM), F.lit(0))


def shingle(first: Column, second: Column) -> Column:
    """A pair's key; hashing skips a missing second word."""
    return F.xxhash64(first, second)


def positions(docs: DataFrame, single: bool) -> DataFrame:
    """(id, h, n, pos, key, top): a row for each word of each document (id, h, words); top marks one row of each document, also of empty ones."""
    at = docs.select("*", F.posexplode_outer("words").alias("pos", "word"))
    pair, top = shingle(F.col("word"), F.get("words", F.col("pos") + 1)), F.coalesce(F.col("pos") == 0, F.lit(True))
    at = at.select("id", "h", F.coalesce(F.size("words"), F.lit(0)).alias("n"), "pos", "word", pair.alias("pair"), top.alias("top"))
    if not single:
        return at.select("id", "h", "n", "pos", F.col("pair").alias("key"), "top")
    both = at.select("id", "h", "n", "pos", "top", F.posexplode(F.array_distinct(F.array("pair", F.xxhash64("word")))).alias("k", "key"))
    return both.select("id", "h", "n", "pos", "key", (F.col("top") & (F.col("k") == 0)).alias("top"))


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(win, items): distinct windows and the sorted ids of the items that have them."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    wins = F.expr(f"if(size(w) <= {size}, array(w), transform(sequence(1, size(w) - {size - 1}), i -> slice(w, i, {size})))")
    return w.select("item", F.explode(wins).alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def shingles(wins: DataFrame) -> DataFrame:
    """(win, items, off, key): each window's shingles and where they stand in it."""
    return wins.select("win", "items", F.posexplode(F.expr("if(size(win) = 1, array(xxhash64(win[0])), transform(sequence(0, size(win) - 2), i -> xxhash64(win[i], win[i + 1])))")).alias("off", "key"))


def prefixed(offs: DataFrame, spots: DataFrame) -> DataFrame:
    """(win, items, key, off): each window's rarest shingle over all documents (ties: smaller key), and where it stands in the window."""
    counts = spots.groupBy("key").agg(F.count("*").alias("n"))
    ranked = offs.join(counts, "key", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("p"), F.first("items").alias("items"))
    return ranked.where("p.n > 0").select("win", "items", F.col("p.key").alias("key"), F.col("p.off").alias("off"))


def _maybe_broadcast(rows: DataFrame, size: int, bound: int) -> DataFrame:
    return F.broadcast(rows) if size <= bound else rows


class _Spots:
    """Windows, and one scan of the documents: where their shingles stand, and a row with each document's words."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text_col: str, bound: int):
        self.folder, self.bound = shared_dir(docs.sparkSession), bound
        self.texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        self.wins = stored(item_windows(items, item_col, item_text_col, size), self.folder, "windows")
        facts = self.wins.agg(F.coalesce(F.sum(F.size("win")), F.lit(0)).alias("keys"), F.coalesce(F.bool_or(F.size("win") == 1), F.lit(False)).alias("single")).first()
        keys = shingles(self.wins).select(F.col("key").alias("wanted")).distinct()
        worded = self.texts.select("id", "h", words(F.col("text")).alias("words"))
        met = positions(worded, facts["single"]).join(_maybe_broadcast(keys, 16 * facts["keys"], bound), F.expr("key = wanted"), "left").where("top OR wanted IS NOT NULL")
        self.all = stored(met.select("id", "h", "n", "pos", F.col("wanted").alias("key"), "top"), self.folder, "spots")

    def hits(self) -> DataFrame:
        """(id, h, n_hit, items) of the documents with some hit."""
        spark, spots = self.texts.sparkSession, self.all.where("key IS NOT NULL").select("id", "h", "n", "pos", "key")
        tries = spots.join(prefixed(shingles(self.wins), spots), "key").where("pos >= off AND pos - off + size(win) <= n")
        tries = tries.groupBy("id", "h").agg(F.collect_set(F.struct((F.col("pos") - F.col("off")).alias("at"), "win", "items")).alias("tries"))
        tries = stored(tries, self.folder, "tries")
        some = tries.select(F.col("id").alias("tid"), F.col("h").alias("th"))
        some = _maybe_broadcast(some, some.count(), BROADCAST_DOCS)
        # only these documents' words are shuffled to their lists
        picked = self.texts.join(some, F.expr("id <=> tid AND h = th"), "left_semi").select("id", "h", words(F.col("text")).alias("words"))
        picked = stored(picked, self.folder, "picked")
        met = picked.join(tries.select(F.col("id").alias("tid"), F.col("h").alias("th"), "tries"), F.expr("id <=> tid AND h = th"))
        met = met.select("id", "h", F.expr("filter(tries, t -> slice(words, t.at + 1, size(t.win)) = t.win)").alias("hits")).where("size(hits) > 0")
        n_hit = "size(array_distinct(flatten(transform(hits, t -> sequence(t.at, t.at + size(t.win) - 1)))))"
        found = met.select("id", "h", F.expr(n_hit).cast("long").alias("n_hit"), F.expr("array_sort(array_distinct(flatten(transform(hits, t -> t.items))))").alias("items"))
        found = stored(found.dropDuplicates(["id", "h"]), self.folder, "found")
        removed(spark, *(f"{self.folder}/{x}" for x in ("tries", "picked", "windows")))
        return found


#: Documents with hits that may be broadcast to where all documents are read.
BROADCAST_DOCS = 500_000


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) for each document."""
    spots = _Spots(docs, items, size, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    every = spots.all.where("top").select("id", "h", F.col("n").cast("long").alias("n_words"))
    found = spots.hits().select(F.col("id").alias("hid"), F.col("h").alias("hh"), "n_hit", "items")
    # more than that, or many items each, and rows of (id, h, n_words) are shuffled
    weight = found.agg(F.coalesce(F.sum(1 + F.size("items") / 8), F.lit(0))).first()[0]
    out = every.join(_maybe_broadcast(found, weight, BROADCAST_DOCS), F.expr("id <=> hid AND h = hh"), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, all columns, without any hit."""
    spots = _Spots(docs, items, size, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    found = spots.hits().select(F.col("id").alias("__hid"), F.col("h").alias("__hh"))
    removed(docs.sparkSession, f"{spots.folder}/spots")
    found = _maybe_broadcast(found, found.count(), BROADCAST_DOCS)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__hid")) & (F.xxhash64(text_col) == F.col("__hh")), "left_anti")
