"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words, which are its parts between spaces and tabs. It goes if an earlier line of any document
equals it or has a Jaccard similarity of at least 0.8 with it; earlier means a smaller (doc_id, row, line number), judged
on the input. Lines without words stay.

Words are ordered by rarity, the same order for all lines. Words of a prefix alone would meet in lists that grow with the
corpus, so a prefix holds groups of three neighbours in that order. If linked sets of n and m words share T, then T is at
least 0.8 (n + what the other has alone). A word that the one of n words has alone breaks at most three of its groups, one
that the other has alone at most two, at most 0.6 n in all: of its first 0.6 n + 1 groups one is whole, and the first whole
group is the same for both. Sets of up to six words have pairs too, of which 0.4 n may be broken; sets of fewer than four
are linked with equal ones only. Size and position filters go with each group, and 128 bits of each set that bound the words in which two sets differ; what remains
is verified on the whole sets. All this is done for distinct lines. Lines are met in two rounds: first with two lines of each list, the
most frequent and the earliest; only lines not yet removed meet all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towline.session import cut, drop

from .frames import bounded
from .winnow import _row_keys

SLOTS = 1 << 15  # counters of the frequency sketch that ranks words; any common ranking gives the same result
LAST = (1 << 63) - 1
_HASH_BITS = 58
PAIRED = 6  # words of a set that has pairs too: the least size with a whole group of three


def _parts(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\t"), F.lit(" ")), " ")


def _slot(h: Column) -> Column:
    return h.bitwiseAND(SLOTS - 1).cast("int")


def _levels(docs: DataFrame) -> Column:
    """For each slot the binary logarithm of how many words of the corpus fall into it, as a constant array."""
    words = docs.select(F.explode(_parts(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
    counts = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).count()
    level = [0] * SLOTS
    for slot, n in counts.select("slot", F.log2("count").cast("int")).collect():  # SLOTS rows at most
        level[slot] = n
    return F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")  # the optimiser makes it one literal


def _tokens(line: str, levels: Column) -> Column:
    """Distinct words of a line as numbers, from rare to frequent; ties by hash."""
    hashes = F.transform(F.array_remove(_parts(F.col(line)), ""), lambda x: F.xxhash64(x))
    level = lambda h: F.coalesce(F.get(levels, _slot(h)), F.lit(0).cast("bigint"))  # noqa: E731  (numbers without NULL are sorted faster)
    return F.sort_array(F.transform(F.array_distinct(hashes), lambda h: F.shiftleft(level(h), _HASH_BITS) + F.shiftrightunsigned(h, 64 - _HASH_BITS)))


def _keyed(lines: DataFrame, *columns: str) -> DataFrame:
    """`columns`, and key and spot of each group of the prefix of the tokens `t`; a spot is n and the group's place in one number."""
    n, i = F.size("t"), F.col("i")
    groups = lambda size, share: F.least(n - size + 1, F.floor(share * n).cast("int") + 1)
    threes = min(PAIRED - 2, 6 * PAIRED // 10 + 1)  # of a set with pairs too, these come first
    many = F.when(n > PAIRED, groups(3, 0.6)).when(n == PAIRED, threes + groups(2, 0.4)).when(n >= 4, groups(2, 0.4)).otherwise(1)
    # Numbers are exploded and not keys, so that no function of higher order runs for each group.
    each = lines.select(*columns, "t", F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
    at = F.when((n == PAIRED) & (i >= threes), i - threes).otherwise(i)
    two = F.get("t", at), F.get("t", at + 1)
    key = F.when(n < 4, F.xxhash64("t")).when((n > PAIRED) | ((n == PAIRED) & (i < threes)), F.xxhash64(*two, F.get("t", at + 2))).otherwise(F.xxhash64(*two))
    return each.select(*columns, key.alias("key"), (F.shiftleft(n.cast("bigint"), 32) + at).alias("spot"))


def _can_match(spot: Column, other: Column) -> Column:
    """Size filter, and position filter: what stands before the shared group and what stands from there on bounds the intersection."""
    n, m = F.shiftright(spot, 32), F.shiftright(other, 32)
    at, to = (x.bitwiseAND((1 << 32) - 1) for x in (spot, other))
    most = F.least(at, to) + F.least(n - at, m - to)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m))


def _bits(high: bool) -> Column:
    """A bit for each of 64 classes of the tokens `t`: whether an odd number of them fall into it. Each word that one of
    two sets has alone changes one bit, so that they differ in at least as many words as their bits do."""
    of = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))
    mine = lambda x: x.bitwiseAND(64) == (64 if high else 0)
    return F.aggregate(F.filter("t", mine), F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseXOR(of(x)))


def _may_be_alike(x: str, y: str) -> Column:
    """Similar sets of n and m words differ in at most (n + m) / 9 words, and so in as many of their bits at most."""
    c = lambda side, name: F.col(f"{side}{name}")
    differ = sum(F.bit_count(c(x, name).bitwiseXOR(c(y, name))) for name in ("low", "high"))
    return _can_match(c(x, "spot"), c(y, "spot")) & (9 * differ <= F.shiftright(c(x, "spot"), 32) + F.shiftright(c(y, "spot"), 32))


def _has_words(line: str) -> Column:
    return F.trim(F.replace(F.col(line), F.lit("\t"), F.lit(" "))) != ""


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per document row (keys __a, __b): the numbers of its removed lines, as written."""
    levels = _levels(docs)
    split = docs.select("doc_id", *_row_keys(), F.posexplode(F.split("text", "\n")).alias("number", "words")).filter(_has_words("words"))
    place = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), "__a", "__b", "number")
    lines = cut(split.select(F.xxhash64("words").alias("line"), place.alias("place")))
    first = cut(lines.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")))

    # Distinct lines with their words. Only copies are gathered, and those of one task are one row before the shuffle.
    several = bounded(cut(first.filter("times > 1").select("line")), 16)
    every = docs.select(F.explode(F.split("text", "\n")).alias("words")).filter(_has_words("words")).select(F.xxhash64("words").alias("line"), "words")
    copied = cut(every.join(several, "line", "left_semi").groupBy("line").agg(F.min("words").alias("words")))
    distinct = every.join(several, "line", "left_anti").unionByName(copied)

    postings = _keyed(distinct.select("line", _tokens("words", levels).alias("t")), "line")
    x, y = postings.alias("x"), postings.alias("y")
    matches = (F.col("x.key") == F.col("y.key")) & (F.col("x.line") != F.col("y.line")) & _can_match(F.col("x.spot"), F.col("y.spot"))
    # Only the groups that another line has are met again below.
    shared = cut(x.join(y.hint("merge"), matches, "left_semi").select("line", "key", "spot"))
    live = cut(shared.select("line").distinct())
    few = bounded(live, 16)
    words = distinct.join(few, "line", "left_semi").select("line", _tokens("words", levels).alias("t"))
    sets = cut(words.select("line", "t", _bits(False).alias("low"), _bits(True).alias("high")))
    order = cut(first.join(few, "line", "left_semi"))
    drop(several, copied, live)
    named = sets.select("line", "low", "high").join(order.select("line", "times", F.col("first.id").alias("id")), "line")
    listed = cut(shared.join(named, "line"))
    drop(shared)
    gone = _matched(listed, sets, order)

    copies = lines.join(first.filter("times > 1").select("line", "first"), "line").filter(F.col("place") != F.col("first")).select("place")
    near = lines.join(gone, "line").select("place")
    parts = copies.union(near).groupBy(F.col("place.__a").alias("__a"), F.col("place.__b").alias("__b"))
    found = cut(parts.agg(F.collect_set("place.number").alias("gone")))
    drop(lines, first, listed, sets, order, gone)
    return bounded(found, 64 + 4 * F.size("gone"))


def _matched(listed: DataFrame, sets: DataFrame, order: DataFrame) -> DataFrame:
    """The lines that have an earlier match, from the groups (line, times, id, key, spot and bits) they share with others, their words and places."""
    row = F.struct("line", "id", "spot", "low", "high")
    # Lists are laid out by key before they are aggregated, as a task holds few rows of a key and two heads are wider than a row.
    by_key = listed.repartition("key")
    heads = by_key.groupBy("key").agg(F.min_by(row, F.struct(-F.col("times"), "id", "line")).alias("most"), F.min_by(row, F.struct("id", "line")).alias("first"))
    heads = heads.select("key", F.explode(F.array_distinct(F.array("most", "first"))).alias("h"))
    met = _pairs(by_key, heads)
    gone = _later(met, sets, order)
    rest = _pairs(listed.join(gone, "line", "left_anti"), listed.select("key", row.alias("h")))
    late = _later(cut(rest.join(met, ["line", "other"], "left_anti")), sets, order)
    both = cut(gone.union(late))
    drop(met, gone, late)
    return both


def _pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs (line, other) that share a group and may be similar. Ids bound the order; lines of one document are told apart later."""
    both = later.join(earlier.select("key", "h.*").select("key", *[F.col(c).alias(f"h_{c}") for c in ("line", "id", "spot", "low", "high")]), "key")
    may = (F.col("h_id") <= F.col("id")) & (F.col("h_line") != F.col("line")) & _may_be_alike("", "h_")
    return cut(both.filter(may).select("line", F.col("h_line").alias("other")).distinct())


def _later(pairs: DataFrame, sets: DataFrame, order: DataFrame) -> DataFrame:
    """The lines whose other line is similar and stands earlier."""
    after, before = order.select("line", "first"), order.select(F.col("line").alias("other"), F.col("first").alias("before"))
    left, right = sets.select("line", "t"), sets.select(F.col("line").alias("other"), F.col("t").alias("u"))
    alike = 9 * F.size(F.array_intersect("t", "u")) >= 4 * (F.size("t") + F.size("u"))
    turned = bounded(cut(pairs.join(after, "line").join(before, "other").filter("before < first").select("line", "other")), 24)
    found = cut(turned.join(left, "line").join(right, "other").filter(alike).select("line").distinct())
    drop(turned)
    return found


def _without(docs: DataFrame, columns: list[Column | str]) -> DataFrame:
    """`columns` of each row, with `__lines` all its lines and `__kept` those that stay."""
    gone = removed_lines(docs)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), *_row_keys()).join(gone, ["__a", "__b"], "left")
    parts = keyed.select("__row", "gone", F.split("__row.text", "\n").alias("__lines"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("__lines")).otherwise(F.transform(numbers, lambda i: F.get("__lines", i)))
    return parts.select("__row", "__lines", kept.alias("__kept")).select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for each row of `docs`; the digest is of the kept lines joined by a line feed.

    A NULL text has no lines, an empty one has one without words. Rows without doc_id come after all others. Rows with the
    same id and text are one document. Other columns are not read. An empty table gives an empty result.
    """
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    return _without(docs.select("doc_id", "text"), [
        F.col("__row.doc_id").alias("doc_id"), size("__lines").alias("n_lines"), (size("__lines") - size("__kept")).alias("n_removed"),
        F.sha2(F.coalesce(F.array_join("__kept", "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    ])


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without later matches of lines, with the same columns; a document of which no line is left goes."""
    other = [F.col("__row").getField(c).alias(c) if c != "text" else F.array_join("__kept", "\n").alias("text") for c in docs.columns]
    kept = _without(docs, [*other, (F.size("__kept") > 0).alias("__some"), F.col("__row.text").isNull().alias("__none")])
    return kept.filter("__some or __none").drop("__some", "__none")
