"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprint of a window of words is the least hash among its k-grams. Sliding over a document, neighbouring windows
mostly share their least hash, so a document keeps few distinct fingerprints, yet every window shared with a
benchmark item has the fingerprint that the item's window has: no shared span of a window or more is missed. Fingerprints
of documents meet those of the benchmark in a semi-join; hits are extended to whole windows by comparing words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.session import cut

from .frames import bounded

WINDOW = 10
GRAM = 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed by the task: ASCII other than digits and lower-case letters


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; NULL has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def fingerprints(hashes: Column, length: int) -> Column:
    """For each window of `length` word hashes, by start: the least hash of its k-grams. Empty for shorter arrays."""
    k = min(GRAM, length)
    grams = _let(hashes, lambda h: _sliding(h, k, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
    if length == k:
        return grams
    return _let(grams, lambda g: _sliding(g, length - k + 1, lambda i: F.least(*[F.get(g, i + j) for j in range(length - k + 1)])))


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once for a row, not once for each time it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sliding(array: Column, width: int, make) -> Column:
    starts = F.slice(array, 1, F.greatest(F.size(array) - width + 1, F.lit(0)))
    return F.transform(starts, lambda _, i: make(i))


def _hashed(w: Column | str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _row_keys() -> list[Column]:
    """128 bits that tell rows apart by id and text, NULL or not; equal rows have equal keys and equal results."""
    return [F.xxhash64("doc_id", "text").alias("__a"), F.xxhash64(F.lit(1), F.col("text"), F.lit(2), F.col("doc_id")).alias("__b")]


def _hit_windows(n: int):
    """From words: (at, window) of the windows of n words whose fingerprint is among column `f`."""

    def pick(w: Column) -> Column:
        places = F.transform(fingerprints(_hashed(w), n), lambda x, i: F.when(F.array_contains("f", x), i))
        return F.transform(F.array_compact(places), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("window")))

    return pick


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(length, fingerprint, window, items) for each distinct window: 10 words, or all of an item with fewer words.

    Items without id or without words have none. An item that is repeated counts once.
    """
    own = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    own = own.withColumn("length", F.least(F.size("w"), F.lit(WINDOW))).filter("length > 0")
    short = F.col("length") < WINDOW
    starts = F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0))))
    windows = own.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.col("length")))).alias("part"))
    marks = [F.when(F.col("length") == n, F.get(fingerprints(_hashed("part"), n), F.lit(0))) for n in range(1, WINDOW + 1)]
    return windows.select("item", "length", F.coalesce(*marks).alias("fingerprint"), F.array_join("part", " ").alias("window")).groupBy(
        "length", "fingerprint", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contaminated_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    Rows stay apart when repeated or when doc_id is NULL. NULL and empty texts have no words and no hits. Other columns
    are not read. Without documents the result is empty; without items nothing is hit.
    """
    marked, result = _hits(docs, items)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return marked.select("doc_id", "__a", "__b", "n_words").join(result, ["__a", "__b"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, with their columns."""
    _, result = _hits(docs, items)
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("__row"), *_row_keys()).join(result.select("__a", "__b"), ["__a", "__b"], "left_anti")
    return keyed.select(*[F.col("__row").getField(c).alias(c) for c in names])


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows by their keys with n_words; and n_hit and items of the keys with hits."""
    against = cut(benchmark_windows(items))
    lengths = [r[0] for r in against.select("length").distinct().collect()] or [WINDOW]  # ten numbers at most
    marks = bounded(against.select("length", "fingerprint").distinct(), 32)
    kept = lambda h: F.array(*[F.struct(F.lit(n).alias("length"), F.array_distinct(fingerprints(h, n)).alias("f")) for n in lengths])
    own = _let(_hashed(words(F.col("text"))), lambda h: F.struct(F.size(h).cast("bigint").alias("n_words"), kept(h).alias("kept")))
    marked = cut(docs.select("doc_id", *_row_keys(), own.alias("own")).select("doc_id", "__a", "__b", "own.n_words", "own.kept"))

    each = marked.select("__a", "__b", F.explode("kept").alias("k")).select("__a", "__b", F.col("k.length").alias("length"), F.explode("k.f").alias("fingerprint"))
    hits = each.join(marks, ["length", "fingerprint"], "left_semi").groupBy("__a", "__b", "length").agg(F.collect_set("fingerprint").alias("f"))
    hits = bounded(cut(hits), 48 + 8 * F.size("f"))

    # Extend: of documents with hits, the windows with a hit fingerprint, word by word.
    again = docs.select(*_row_keys(), "text").join(hits, ["__a", "__b"])
    found = None
    for n in lengths:
        own = again.filter(F.col("length") == n)
        pieces = _let(words(F.col("text")), _hit_windows(n))
        # A document that is repeated has its windows once for each row: the same ones, so sets suffice below.
        rows = own.select("__a", "__b", "length", F.explode(pieces).alias("x")).select("__a", "__b", "length", "x.at", "x.window")
        found = rows if found is None else found.union(rows)
    exact = bounded(against.select("length", "window", "items"), 64 + F.length("window") * 4 + 32 * F.size("items"))
    matched = found.join(exact, ["length", "window"]).groupBy("__a", "__b").agg(
        F.collect_set(F.struct("at", "length")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    return marked, bounded(cut(matched.select("__a", "__b", F.size(covered).cast("bigint").alias("n_hit"), "items")), 64 + 32 * F.size("items"))
