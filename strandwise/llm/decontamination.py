"""Benchmark decontamination by spaced seeds.

A seed hashes the words at the selected positions of a fixed mask and ignores the others.  The two masks together
are lossless for the overlap that is looked for: whichever two of 13 aligned words are substituted, one of the masks
fits beside them.  Training and test seeds meet in an equi-join, and around each hit the words of the two texts are
compared position by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialize

WINDOW = 13
MATCHES = 11
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 7, 9))
_OFFSETS = sorted({o for m in MASKS for o in m})
_BEFORE = max(WINDOW - 1 - m[-1] for m in MASKS)  # words before a seed in the windows that hold it


def plain_words(text: Column) -> Column:
    """Words in lower case without their signs; what has neither letter nor digit is no word."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")
    return F.array_remove(F.split(bare, SPACE + "+"), "")


def _seeds(words: Column, starts: Column) -> Column:
    """An array of structs, one a seed start, of the words at all offsets that a mask uses; null past the end."""
    return F.arrays_zip(*(F.slice(words, o + 1, starts).alias(f"w{o}") for o in _OFFSETS))


def _hashes(at: str) -> Column:
    """Seed hashes of one start, with the mask's number hashed in; null where the mask runs past the end."""
    return F.array(*(F.when(F.col(f"{at}.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"{at}.w{o}") for o in m))) for k, m in enumerate(MASKS)))


def _equal_words(doc: Column, at: Column, item: Column, start: Column) -> Column:
    """The most equal words in any window of 13 aligned positions that holds the seed; positions outside differ."""
    same = F.transform(
        F.sequence(F.lit(-_BEFORE), F.lit(WINDOW - 1)),
        lambda j: F.when(F.get(doc, at + j) == F.get(item, start + j), 1).otherwise(0),
    )
    sums = F.transform(F.array(same), lambda s: F.array_max(F.transform(
        F.sequence(F.lit(1), F.lit(_BEFORE + 1)), lambda i: F.aggregate(F.slice(s, i, WINDOW), F.lit(0), lambda a, x: a + x))))
    return sums[0]


def overlaps(docs: DataFrame, items: DataFrame, piece: int = 4096, broadcast_rows: int = 1 << 20, shortest: int = 5) -> DataFrame:
    """(doc_id, item_id, matched, first_word) for every pair of a document and a test item that align with at least
    11 equal words in some 13 successive positions; ``matched`` is the most found, ``first_word`` the earliest seed.
    An item of ``shortest`` to 10 words must occur whole; ``matched`` is then its number of words.  Shorter ones are
    everyday phrases, which overlap with nothing.

    docs needs doc_id and text, items item_id and text; other columns are ignored.  Words are compared in
    lower case and by their letters and digits only.  Null, empty and shorter texts overlap with nothing; rows with a null id are left out; repeated rows
    count as one; empty tables give no rows.  Texts are cut into pieces of ``piece`` seed starts with a margin, so a
    very long one is never one array of seeds.

    Test seeds are broadcast up to ``broadcast_rows``; seeds of a larger test set are joined by a shuffle on their hash.
    Hits are places only; those of one piece, item and diagonal become one row before the words are attached, so text and
    item of repeated words, where every place hits every other, meet once a diagonal.
    """
    named = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text").cast("string")).alias("item"))
    tests = named.where(F.size("item") > min(m[-1] for m in MASKS))  # the others have no seed
    starts = tests.select("item_id", F.posexplode(_seeds(F.col("item"), F.size("item"))).alias("item_at", "seed"))
    known = starts.select("item_id", "item_at", F.explode(_hashes("seed")).alias("hash")).where("hash is not null").distinct()
    hint = F.broadcast if known.count() <= broadcast_rows else (lambda df: df)

    text = F.col("text").cast("string")
    words = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), plain_words(text).alias("words"))
    cut = words.select("doc_id", "key", "words", F.explode(F.sequence(F.lit(0), F.size("words"), F.lit(piece))).alias("from"))
    # a piece starts with the margin before its first seed start
    first = F.greatest(F.lit(0), F.col("from") - _BEFORE)
    cut = cut.select("doc_id", "key", "from", first.alias("first"), F.slice("words", first + 1, F.col("from") - first + piece + WINDOW).alias("piece"))
    seeds = cut.select("doc_id", "key", "from", "first", F.posexplode(_seeds(F.col("piece"), F.lit(piece + WINDOW + _BEFORE))).alias("at", "seed"))
    inside = (F.col("first") + F.col("at") >= F.col("from")) & (F.col("first") + F.col("at") < F.col("from") + piece)
    seeds = seeds.where(inside).select("doc_id", "key", "from", "at", F.explode(_hashes("seed")).alias("hash"))
    met = seeds.join(hint(known), "hash").groupBy("doc_id", "key", "from", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = materialize(met.agg(F.array_sort(F.collect_set("at")).alias("ats")), "hits")
    few = F.broadcast if (hits.agg(F.sum(F.size("ats"))).first()[0] or 0) <= broadcast_rows else (lambda df: df)
    near = cut.join(few(hits), ["doc_id", "key", "from"]).join(tests, "item_id")
    each = F.transform("ats", lambda at: F.struct(_equal_words(F.col("piece"), at, F.col("item"), at - F.col("shift")).alias("matched"), (F.col("first") + at).alias("word")))
    checked = near.select("doc_id", "item_id", F.inline(each)).where(F.col("matched") >= MATCHES)
    found = checked.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.min("word").alias("first_word"))

    whole = named.where(F.size("item").between(shortest, MATCHES - 1))
    sizes = sorted(r[0] for r in whole.select(F.size("item")).distinct().collect())  # at most six
    if not sizes:
        return found
    spelt = whole.select("item_id", F.array_join("item", " ").alias("run")).distinct()
    runs = F.array(*(F.when(F.size(F.slice("piece", F.col("at") + 1, n)) == n, F.array_join(F.slice("piece", F.col("at") + 1, n), " ")) for n in sizes))
    places = cut.select("doc_id", "from", "first", "piece", F.explode(F.sequence(F.lit(0), F.lit(piece - 1))).alias("_at"))
    places = places.withColumn("at", F.col("from") - F.col("first") + F.col("_at")).where(F.col("at") < F.size("piece"))
    met = places.select("doc_id", (F.col("first") + F.col("at")).alias("word"), F.explode(runs).alias("run")).where("run is not null")
    exact = met.join(F.broadcast(spelt) if spelt.count() <= broadcast_rows else spelt, "run").groupBy("doc_id", "item_id")
    exact = exact.agg(F.max(F.size(F.split("run", " "))).alias("matched"), F.min("word").alias("first_word"))
    return found.unionByName(exact)


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, all columns kept.  Rows without a doc_id stay.

    The ids that go are broadcast up to ``broadcast_rows``, so texts are shuffled beyond that only."""
    leak = free_name(docs, "_leak")
    leaks = materialize(overlaps(docs, items).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    hint = F.broadcast if leaks.count() <= broadcast_rows else (lambda df: df)
    return docs.join(hint(leaks), F.col("doc_id").cast("long") == F.col(leak), "left_anti")
