"""N-gram Jaccard join by T-occurrence search over inverted lists.

A document is its set of 5-word shingles. Documents with equal sets form one class, and the search is among classes.

1. Shingles that stand in one class only have no inverted list. They are found by dealing all shingles out by hash, as
   packed arrays, after each task has merged its own: a shingle that is in many documents of a task is shipped once. A
   class with fewer listed shingles than three quarters of its size cannot be linked and is done.
2. The others divide their lists as DivideSkip does: by rarity, the n - T longest lists that cannot alone hold a partner
   are set aside as long, and every partner must be met in one of the short lists. Rarity comes from a count sketch of fixed size; any
   order that all classes share gives the same links.
3. Short lists are merged by sorting, in rounds. First each class meets only one class of each of its lists, the one that has
   the smallest share of shingles of its own, so that a large group of near copies is tied to its original with few pairs for each
   copy. Then only classes of different components that share a short list meet, which are few.
4. A pair that was met is verified by binary probes of the long lists' shingles in the partner's sorted set, and of the
   short ones only if those can still make up the required overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from towline.session import cut, drop

from .components import components
from .frames import bounded
from .text import FOLDED, Words, blocks, from_planes, mix, shingles, to_planes, whole

K = 5
PART, WHOLE = 75, 100  # linked if WHOLE * intersection >= PART * union
BUCKET_POSTINGS = 2_000_000  # counted as one for every WORD_BYTES of text
WORD_BYTES = 6
SKETCH_BITS = 18
# Heads of lists in the rounds: first the set with the fewest shingles of its own, as the original of a group of near copies has.
HEADS = (("plain / n", "set_id"), ("set_id",))


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    grams, out = shingles(words.hash, K), []
    for d in range(len(words.first) - 1):
        low, high = words.first[d], words.first[d + 1]
        out.append(np.unique(grams[low : high - K + 1]) if high - low >= K else whole(words.hash[low:high]) if high > low else grams[:0])
    return out


def set_id(hashes: np.ndarray) -> np.uint64:
    total = np.array([len(hashes)], np.uint64)
    total += np.sum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return mix(total)[0]


def least_overlap(n: np.ndarray | int, m: np.ndarray | int):
    """The least intersection of linked sets of n and m shingles."""
    return -(-PART * (n + m) // (PART + WHOLE))


def least_shared(n):
    """The least intersection of a set of n shingles with any linked one."""
    return -(-PART * n // WHOLE)


def _top(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


_PACKED = "bucket int, listed boolean, sets binary, sizes binary, counts binary, hashes binary"
_NAMES = [f.split()[0] for f in _PACKED.split(", ")]


def _packed(bucket: np.ndarray, sets: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, listed: bool, rank: np.ndarray | None = None) -> list[tuple]:
    """Postings (set, its size, hash) as one row per bucket, each set named once per row; `rank` are small numbers that tell the sets apart."""
    if not len(hashes):
        return []
    order = np.lexsort((sets if rank is None else rank, bucket))
    bucket, sets, sizes, hashes = bucket[order], sets[order], sizes[order], hashes[order]
    change = np.flatnonzero((sets[1:] != sets[:-1]) | (bucket[1:] != bucket[:-1])) + 1
    heads = np.concatenate([[0], change])
    counts = np.diff(np.append(heads, len(sets)))
    edges = np.flatnonzero(bucket[heads][1:] != bucket[heads][:-1]) + 1
    out = []
    for low, high in zip(np.concatenate([[0], edges]), np.append(edges, len(heads))):
        own, to = heads[low:high], heads[high] if high < len(heads) else len(hashes)
        out.append((int(bucket[own[0]]), listed, sets[own].tobytes(), to_planes(sizes[own]), to_planes(counts[low:high]), to_planes(hashes[own[0] : to], "<u8")))
    return out


def _fill(columns: dict[str, pa.Array], schema: pa.Schema, n: int) -> pa.RecordBatch:
    """A batch of `n` rows with these columns; the others are NULL."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return _fill({name: pa.array(list(c), schema.field(name).type) for name, c in zip(_NAMES, zip(*rows))}, schema, len(rows))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sets = np.frombuffer(b"".join(table.column("sets").to_pylist()), np.uint64)
    joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *(from_planes(x, kind) for x in table.column(name).to_pylist())])
    counts = joined("counts", "<i4")
    return np.repeat(sets, counts), np.repeat(joined("sizes", "<i4"), counts), joined("hashes", "<u8")


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1]) if len(sorted_values) else np.zeros(0, int)


def _ship(batches, bits: int, schema: pa.Schema, keep: list[str], extra):
    """One row per text, and the postings of a task's texts. What stands in several of its sets is known to be listed and is shipped once, unowned."""
    seen = 0
    for batch in batches:
        for rows, data, offsets in blocks(batch, "__text"):
            n = rows.stop - rows.start
            words = Words(data, offsets, FOLDED)
            sets = shingle_sets(words)
            ids = np.array([set_id(x) if len(x) else 0 for x in sets], np.uint64)
            counts = np.array([len(x) for x in sets], np.int64)
            texts = {c: batch.column(c).slice(rows.start, n) for c in keep}
            # Rows are dealt out evenly, also those without words.
            texts |= {"bucket": pa.array(_top(mix(np.arange(seen, seen + n)), bits), pa.int32()), "n_shingles": pa.array(counts),
                      "set_id": pa.array(ids.view(np.int64), mask=counts == 0)}
            texts |= {name: pa.array(x) for name, x in extra(words, data, offsets).items()} if extra else {}
            yield _fill(texts, schema, n)
            seen += n
            own = {i: x for i, x in zip(ids, sets) if len(x)}
            if own:
                yield _table(_posted(own, bits), schema)


def _posted(own: dict[np.uint64, np.ndarray], bits: int) -> list[tuple]:
    """Packed postings of distinct sets."""
    ids, sizes = np.array(list(own), np.uint64), np.array([len(s) for s in own.values()], np.int32)
    hashes, owner = np.concatenate(list(own.values())), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    heads = _runs(hashes)
    length = np.diff(np.append(heads, len(hashes)))
    single = length == 1
    first, to = hashes[heads], np.where(single, ids[owner[heads]], np.uint64(0))
    rank = np.where(single, owner[heads] + 1, 0).astype(np.uint16 if len(ids) < 1 << 16 else np.int64)
    out = _packed(_top(first, bits), to, np.where(single, sizes[owner[heads]], 0), first, False, rank)
    several = np.repeat(~single, length)
    here = np.full(np.count_nonzero(several), _top(ids[:1], bits)[0])
    return out + _packed(here, ids[owner[several]], sizes[owner[several]], hashes[several], True)


def _listed(table: pa.Table, bits: int, schema: pa.Schema) -> pa.Table:
    """Of one bucket: the rows of texts, and the postings whose shingle stands in two sets or more, dealt by set."""
    rows, texts = [], table.filter(pc.is_null(table.column("listed"))).select(schema.names).cast(schema)
    for known in (True, False):
        mask = table.column("listed") if known else pc.invert(table.column("listed"))
        sets, sizes, hashes = _unpacked(table.filter(mask))
        if not known and len(hashes):
            order = np.argsort(hashes, kind="stable")
            hashes, sets = hashes[order], sets[order]
            heads = _runs(hashes)
            several = np.minimum.reduceat(sets, heads) != np.maximum.reduceat(sets, heads)
            keep = np.repeat(several, np.diff(np.append(heads, len(hashes)))) & (sets != 0)
            sets, sizes, hashes = sets[keep], sizes[order[keep]], hashes[keep]
        rows += _packed(_top(sets, bits), sets, sizes, hashes, True)
    return pa.concat_tables([texts, pa.Table.from_batches([_table(rows, schema)])])


def _survivors(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of one bucket: the rows of texts, and of its sets those with enough listed shingles, and these."""
    text = pc.is_null(table.column("listed"))
    texts, table = table.filter(text), table.filter(pc.invert(text))
    sets, sizes, hashes = _unpacked(table)
    order = np.lexsort((hashes, sets))
    sets, sizes, hashes = sets[order], sizes[order], hashes[order]
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (hashes[1:] != hashes[:-1])
    sets, sizes, hashes = sets[fresh], sizes[fresh], hashes[fresh]
    heads = _runs(sets)
    ends = np.append(heads[1:], len(sets))
    good = [(a, b) for a, b in zip(heads, ends) if b - a >= least_shared(int(sizes[a]))]
    found = {
        "set_id": pa.array([int(sets[a].astype(np.int64)) for a, _ in good], pa.int64()), "n": pa.array([int(sizes[a]) for a, _ in good], pa.int32()),
        "hashes": pa.array([hashes[a:b].tobytes() for a, b in good], pa.binary()),
    }
    none = {"n": pa.nulls(len(texts), pa.int32()), "hashes": pa.nulls(len(texts), pa.binary())}
    own = pa.table([none[f.name] if f.name in none else texts.column(f.name).cast(f.type) for f in schema], schema=schema)
    return pa.concat_tables([own, pa.Table.from_batches([_fill(found, schema, len(good))])])


def _slots(hashes: np.ndarray) -> np.ndarray:
    return _top(mix(hashes), SKETCH_BITS)


def _sketch(sets: DataFrame) -> np.ndarray:
    """Rarity of shingles: the binary logarithm of how many stand in a slot, for 2 ** SKETCH_BITS slots."""

    def count(batches):
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
            slot, n = np.unique(_slots(joined), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n, pa.int64())], names=["slot", "n"])

    rows = sets.select("hashes").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    level = np.zeros(1 << SKETCH_BITS, np.int8)
    level[rows["slot"].to_numpy()] = np.log2(rows["n"].to_numpy(float)).astype(np.int8)
    return level


def _by_rarity(hashes: np.ndarray, n: int, level: np.ndarray) -> tuple[np.ndarray, int]:
    """Listed shingles from rare to frequent, and how many of them have short lists."""
    return hashes[np.lexsort((hashes, level[_slots(hashes)]))], len(hashes) - int(least_shared(n)) + 1


def _postings(batches, level: np.ndarray):
    """(shingle, set_id, n, rest, plain) of short lists: `rest` counts the listed shingles from this one on, `plain` those unlisted."""
    for batch in batches:
        shingle, owner, size, rest, plain = [], [], [], [], []
        for s, n, h in zip(*(batch.column(c).to_pylist() for c in ("set_id", "n", "hashes"))):
            ordered, short = _by_rarity(np.frombuffer(h, np.uint64), n, level)
            shingle.append(ordered[:short])
            owner.append(np.full(short, s, np.int64))
            size.append(np.full(short, n, np.int32))
            rest.append(np.arange(len(ordered), len(ordered) - short, -1, dtype=np.int32))
            plain.append(np.full(short, n - len(ordered), np.int32))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cat(shingle, np.uint64).view(np.int64)), pa.array(cat(owner, np.int64)), *(pa.array(cat(x, np.int32)) for x in (size, rest, plain))],
            names=["shingle", "set_id", "n", "rest", "plain"])


def _probe(batches, level: np.ndarray):
    for batch in batches:
        linked = []
        for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "ha", "hb"))):
            ordered, short = _by_rarity(np.frombuffer(a, np.uint64), n, level)
            other, need = np.frombuffer(b, np.uint64), least_overlap(n, m)
            found = _found(ordered[short:], other)
            linked.append(found + short >= need and found + _found(ordered[:short], other) >= need)
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _found(wanted: np.ndarray, among: np.ndarray) -> int:
    return int(np.count_nonzero(among[np.minimum(np.searchsorted(among, wanted), len(among) - 1)] == wanted))


def _verified(pairs: DataFrame, sets: DataFrame, level: np.ndarray) -> DataFrame:
    """The linked ones of distinct pairs (a, b)."""
    left = sets.select(F.col("set_id").alias("a"), "n", F.col("hashes").alias("ha"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("hashes").alias("hb"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "ha", "hb").mapInArrow(partial(_probe, level=level), "a bigint, b bigint"))


def _can_link() -> Column:
    """Size and position filters on a shingle that sets of n and m shingles share.

    If it is the rarest that they share, no more than the listed shingles from there on are shared.
    """
    near = WHOLE * F.least("n", "m") >= PART * F.greatest("n", "m")
    return near & ((PART + WHOLE) * F.least("rest", "left") >= PART * (F.col("n") + F.col("m")))


def _other(short: DataFrame, *more: Column) -> DataFrame:
    return short.select("shingle", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("rest").alias("left"), *more)


def _read_texts(docs: DataFrame, keep: list[str], extra, fields: str) -> tuple[DataFrame, DataFrame]:
    """In one pass over the texts: a row for each text (`keep`, n_shingles, set_id and `fields`), and one for each shingle set that
    may be linked with another (set_id, n, hashes). The rows of texts travel with the postings, so that no text is parsed twice."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size) / WORD_BYTES / BUCKET_POSTINGS))))
    names = [f"__keep{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(name) for c, name in zip(keep, names)], F.col("text").alias("__text"))
    texts = ", ".join([f"{name} {docs.schema[c].dataType.simpleString()}" for c, name in zip(keep, names)] + ["n_shingles bigint, set_id bigint"] + ([fields] if fields else []))
    sent, end = f"{texts}, {_PACKED}", f"{texts}, n int, hashes binary"
    arrow = [to_arrow_schema(StructType.fromDDL(x)) for x in (sent, end)]
    shipped = source.mapInArrow(partial(_ship, bits=bits, schema=arrow[0], keep=names, extra=extra), sent)
    listed = cut(shipped.groupBy("bucket").applyInArrow(lambda rows: _listed(rows, bits, arrow[0]), sent))
    done = cut(listed.groupBy("bucket").applyInArrow(lambda rows: _survivors(rows, arrow[1]), end))
    drop(listed)
    return done.withColumnsRenamed(dict(zip(names, keep))), done


def linked_sets(sets: DataFrame) -> DataFrame:
    """(node, root) for those of the sets (set_id, n, hashes) that are linked with another."""
    level = _sketch(sets)
    short = cut(sets.mapInArrow(partial(_postings, level=level), "shingle bigint, set_id bigint, n int, rest int, plain int"))

    ties, met, roots, written = None, None, None, [short]
    for order in HEADS:
        placed = short.withColumn("root", F.col("set_id")) if roots is None else _mixed(short, roots)
        heads = placed.groupBy("shingle").agg(F.min_by(F.struct("set_id", "n", "rest", "root"), F.struct(*[F.expr(x) for x in order])).alias("h"))
        heads = heads.select("shingle", F.col("h.set_id").alias("b"), F.col("h.n").alias("m"), F.col("h.rest").alias("left"), F.col("h.root").alias("other"))
        pairs = placed.join(heads, "shingle").filter((F.col("root") != F.col("other")) & _can_link())
        pairs = pairs.select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")).distinct()
        pairs = cut(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"))
        found = _verified(pairs, sets, level)
        met, ties = (pairs, found) if met is None else (met.union(pairs), ties.union(found))
        roots = components(ties)
        written += [pairs, found, roots]

    placed = cut(_mixed(short, roots))
    rest = placed.join(_other(placed, F.col("root").alias("other")), "shingle").filter(
        (F.col("set_id") < F.col("b")) & (F.col("root") != F.col("other")) & _can_link())
    rest = rest.select(F.col("set_id").alias("a"), "b").distinct().join(met, ["a", "b"], "left_anti")
    last = _verified(rest, sets, level)
    drop(placed)
    result = components(ties.union(last))
    drop(last, *written)
    return result


def _mixed(short: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of the lists that hold sets of several components, with the component."""
    placed = short.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).filter("__low <> __high").select("shingle")
    return placed.join(mixed, "shingle")


def clusters(
    docs: DataFrame, keep: list[str], least: str | Column, extra: Callable[[Words, np.ndarray, np.ndarray], dict[str, np.ndarray]] | None = None, fields: str = "",
) -> DataFrame:
    """`keep`, n_shingles, cluster and least for each row of `docs`, and `fields`, which `extra` gives for a block of texts.

    `cluster` is a number that linked rows share, and `least` the least value of that expression of `keep` among them. Both are NULL
    for rows that are linked with no other, as those without words are. Rows with equal sets are linked.
    """
    done, written = _read_texts(docs, keep, extra, fields)
    added = [f.split()[0] for f in fields.split(", ")] if fields else []
    own = done.filter("hashes is null").select(*keep, "n_shingles", "set_id", *added)
    classes = own.filter("set_id is not null").groupBy("set_id").agg(F.min(least).alias("__least"))
    roots = linked_sets(written.filter("hashes is not null").select("set_id", "n", "hashes"))
    named = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = cut(named)
    groups = named.groupBy("root").agg(F.min("__least").alias("least"), F.count(F.lit(1)).alias("__classes"))
    # Only classes with several documents or links need a look-up; the others name themselves.
    many = own.filter("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("__rows"))
    look = named.join(groups, "root").join(many, "set_id").filter("__rows > 1 or __classes > 1").select("set_id", F.col("root").alias("cluster"), "least")
    look = bounded(cut(look), 40)
    drop(roots, named)
    result = own.join(look, "set_id", "left").select(*keep, "n_shingles", "cluster", "least", *added)
    result._written_to = written._written_to  # so that the caller can drop it
    return result


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`.

    Documents without words are linked with nothing and their component is their own doc_id. Rows with equal sets are
    linked, so repeated rows share a component. A NULL doc_id is never the least of a component; a component of NULL ids
    only has a NULL id. Other columns are not read. An empty table gives an empty result.
    """
    component = F.when(F.col("cluster").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return clusters(docs, ["doc_id"], "doc_id").select("doc_id", "n_shingles", component)
