"""Relative Lempel-Ziv parsing: documents are factored against indexed reference blocks, long factors are duplicate spans.

The reference of a document is all text that starts earlier: documents of a smaller doc_id, and its own text up to there.
It is indexed by phrases of 20 words, the least length of a factor that counts. Phrases are dealt into reference blocks by hash, and a
block knows the first place (document, word) of each of its phrases. The distinct phrases of a document meet every block that
holds one of them; blocks without any would find nothing. A block answers with stretches of phrases, in the order of the text, whose
first places lie in one document at one distance, so that a copied passage is a few numbers for each block and not one for each phrase.

A document is then parsed from left to right. A factor starts at the first phrase that has an earlier place, and goes on while the
next phrase has the place one word further in the same document; it is a copy of the words found there. Where the match ends, the phrases
across the boundary are looked at too, one word after another, so a factor may start within the last words of the one before, and
no repeated window is missed at a boundary. Factors of fewer than 20 words are the words that stay.

Before shipping, a task keeps of each phrase only its first document; later documents of the task point to that one. A passage
that stands in a third of all documents is thus shipped once per task and block of text, and a number per later document.
Phrases are compared by hashes of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.session import cut, drop

from .text import Words, blocks, from_planes, mix, shingles, to_planes

PHRASE = 20
BLOCK_PHRASES = 4_000_000
LAST = np.iinfo(np.int64).max  # the place of rows without id: after all others
_NONE = np.iinfo(np.int32).min  # the shift of a stretch of phrases without an earlier place


def _block(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


def _runs(*values: np.ndarray) -> np.ndarray:
    """Where a new value begins in any of several arrays of the same length."""
    if not len(values[0]):
        return np.zeros(0, int)
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1])


def _lengths(heads: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(heads, total))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class _Phrases:
    """The phrases of a block of texts (doc, at), and which of the distinct ones of its text each one is.

    Distinct phrases (doc, first, hash) are in the order of text, hash block and first start.
    """

    def __init__(self, words: Words, bits: int):
        self.counts = np.maximum(words.counts() - PHRASE + 1, 0)
        places = _ranges(words.first[:-1], self.counts)
        hashes = shingles(words.hash, PHRASE)[places]
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.at = places - words.first[doc]
        by_hash = np.argsort(hashes, kind="stable")
        heads = _runs(hashes[by_hash], doc[by_hash])
        entry = by_hash[heads]
        block = _block(hashes[entry], bits)
        order = np.lexsort((entry, block, doc[entry]))
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        self.which = np.empty(len(hashes), np.int64)
        self.which[by_hash] = np.repeat(to, _lengths(heads, len(hashes)))
        entry = entry[order]
        self.doc, self.first, self.hash, self.block = doc[entry], self.at[entry], hashes[entry], block[order]


_SHIPPED = "block int, keys binary, places binary, counts binary, known binary, same binary, starts binary, hashes binary"


def _ship(batches, bits: int):
    """Per reference block: rows by key and place, how many distinct phrases each has there and where they start; which stand in an
    earlier document of the same task and as which phrase of it, and the hashes of the others."""
    for batch in batches:
        places, keys = batch.column("place").to_numpy(), batch.column("key").to_numpy()
        for rows, data, offsets in blocks(batch):
            all_ = _Phrases(Words(data, offsets), bits)
            own, key = places[rows], keys[rows]
            if not len(all_.hash):
                continue
            place = own[all_.doc]
            order = np.argsort(all_.hash, kind="stable")
            heads = _runs(all_.hash[order])
            sizes = _lengths(heads, len(order))
            first = np.repeat(np.minimum.reduceat(place[order], heads), sizes)
            leads = np.where(place[order] == first, order, len(order))
            lead, known = np.empty(len(order), np.int64), np.empty(len(order), bool)
            lead[order] = np.repeat(np.minimum.reduceat(leads, heads), sizes)
            known[order] = place[order] > first
            # From here on by block, row and start.
            order = np.argsort(all_.block, kind="stable")
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            doc, start, hashes, block, known = all_.doc[order], all_.first[order], all_.hash[order], all_.block[order], known[order]
            lead = to[lead[order]]
            shipped = np.cumsum(~known) - 1
            out, edges = [], np.append(_runs(block), len(block))
            for low, high in zip(edges[:-1], edges[1:]):
                head, part = low + _runs(doc[low:high]), known[low:high]
                same = shipped[lead[low:high][part]] - (shipped[low - 1] + 1 if low else 0)
                out.append((int(block[low]), key[doc[head]].tobytes(), own[doc[head]].tobytes(), to_planes(_lengths(head, high)),
                            np.packbits(part).tobytes(), to_planes(same), to_planes(start[low:high]), hashes[low:high][~part].tobytes()))
            yield _batch(out, _SHIPPED)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names))


_ANSWERED = "part int, block int, keys binary, sizes binary, lengths binary, shifts binary, places binary"


def _answer(table: pa.Table, bits: int) -> pa.Table:
    """Of one block: for each row with a repeated phrase, its phrases there as stretches of one place and distance; dealt by row."""
    keys, places, counts, same, starts, hashes, known, n = [], [], [], [], [], [], [], 0
    for k, p, c, b, s, a, h in zip(*(table.column(x).to_pylist() for x in ("keys", "places", "counts", "known", "same", "starts", "hashes"))):
        keys.append(np.frombuffer(k, np.int64))
        counts.append(from_planes(c).astype(np.int64))
        places.append(np.repeat(np.frombuffer(p, np.int64), counts[-1]))
        known.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(places[-1])).astype(bool))
        same.append(from_planes(s).astype(np.int64) + n)
        starts.append(from_planes(a).astype(np.int64))
        hashes.append(np.frombuffer(h, np.uint64))
        n += len(hashes[-1])
    keys, places, counts, known, same, starts, hashes = (np.concatenate(x) for x in (keys, places, counts, known, same, starts, hashes))
    order = np.argsort(hashes, kind="stable")
    heads = _runs(hashes[order])
    group = np.empty(len(hashes), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), _lengths(heads, len(order)))
    owner, at = places[~known][order], starts[~known][order]
    first = np.minimum.reduceat(owner, heads)
    start = np.minimum.reduceat(np.where(owner == first[group[order]], at, LAST), heads)
    of = np.empty(len(places), np.int64)
    of[~known], of[known] = group, group[same]
    place, shift = first[of], start[of] - starts
    none = place >= places
    place[none], shift[none] = 0, _NONE

    row = np.repeat(np.arange(len(keys)), counts)
    stretch = _runs(row, place, shift)
    length, row, place, shift = _lengths(stretch, len(row)), row[stretch], place[stretch], shift[stretch]
    heads = _runs(row)
    some = np.flatnonzero(np.add.reduceat(shift != _NONE, heads) > 0)
    part = _block(mix(keys[some].view(np.uint64)), bits)
    some, part = some[np.argsort(part, kind="stable")], np.sort(part)
    sizes, out, block = _lengths(heads, len(row)), [], table.column("block")[0].as_py()
    edges = np.append(_runs(part), len(part))
    for low, high in zip(edges[:-1], edges[1:]):
        own = some[low:high]
        at = _ranges(heads[own], sizes[own])
        out.append((int(part[low]), block, keys[own].tobytes(), to_planes(sizes[own]), to_planes(length[at]), shift[at].astype(np.int32).tobytes(), place[at].tobytes()))
    return pa.Table.from_batches([_batch(out, _ANSWERED)])


_GATHERED = "key bigint, blocks binary, lengths binary, shifts binary, places binary"


def _gather(table: pa.Table) -> pa.Table:
    """The answers of all blocks to each row of one part, by block."""
    keys, block, sizes, lengths, shifts, places = [], [], [], [], [], []
    for n, k, c, s, d, p in zip(*(table.column(x).to_pylist() for x in ("block", "keys", "sizes", "lengths", "shifts", "places"))):
        keys.append(np.frombuffer(k, np.int64))
        sizes.append(from_planes(c).astype(np.int64))
        block.append(np.full(len(keys[-1]), n, np.int32))
        lengths.append(from_planes(s))
        shifts.append(np.frombuffer(d, np.int32))
        places.append(np.frombuffer(p, np.int64))
    keys, block, sizes, lengths, shifts, places = (np.concatenate(x) for x in (keys, block, sizes, lengths, shifts, places))
    order = np.lexsort((block, keys))
    order = order[_runs(keys[order], block[order])]  # a row that is repeated has the same answer once for each
    starts = (np.cumsum(sizes) - sizes)[order]
    keys, block, sizes = keys[order], block[order], sizes[order]
    at = _ranges(starts, sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    edges, out = np.append(_runs(keys), len(keys)), []
    for a, b in zip(edges[:-1], edges[1:]):
        own = at[ends[a] : ends[b]]
        out.append((int(keys[a]), block[a:b].tobytes(), lengths[own].tobytes(), shifts[own].tobytes(), places[own].tobytes()))
    return pa.Table.from_batches([_batch(out, _GATHERED)])


def parsed(phrases: _Phrases, own: np.ndarray, answers: list[tuple]) -> tuple[np.ndarray, ...]:
    """Factors of a block of texts: row, first word, end, place of the reference, its first word; greedily from the left."""
    place, start = np.zeros(len(phrases.hash), np.int64), np.full(len(phrases.hash), -1)
    limits = np.searchsorted(phrases.doc, np.arange(len(own) + 1))
    for d, (held, lengths, shifts, places) in enumerate(answers):
        if held is None:
            continue
        low, high = limits[d], limits[d + 1]
        at = low + np.flatnonzero(np.isin(phrases.block[low:high], np.frombuffer(held, np.int32)))
        lengths = np.frombuffer(lengths, np.int32)
        shift = np.repeat(np.frombuffer(shifts, np.int32), lengths)
        place[at] = np.repeat(np.frombuffer(places, np.int64), lengths)
        start[at] = np.where(shift == _NONE, -1, phrases.first[at] + shift)
    place, start = place[phrases.which], start[phrases.which]
    doc = phrases.doc[phrases.which]
    inside = (start < 0) & (phrases.first[phrases.which] < phrases.at)  # only an earlier start in the text itself
    place[inside], start[inside] = own[doc[inside]], phrases.first[phrases.which][inside]
    found = np.flatnonzero(start >= 0)
    doc, at, place, start = doc[found], phrases.at[found], place[found], start[found]
    # A factor goes on as long as the text and the reference both go one word further.
    heads = _runs(doc, place, start - at, np.cumsum(np.diff(found, prepend=-1) != 1))
    return doc[heads], at[heads], at[heads] + _lengths(heads, len(found)) + PHRASE - 1, place[heads], start[heads]


def _parse(batches, bits: int, spans: bool):
    for batch in batches:
        answers = list(zip(*(batch.column(c).to_pylist() for c in ("blocks", "lengths", "shifts", "places"))))
        places = batch.column("place").to_numpy()
        for rows, data, offsets in blocks(batch):
            words, own = Words(data, offsets), places[rows]
            doc, low, high, place, start = parsed(_Phrases(words, bits), own, answers[rows])
            limits = np.searchsorted(doc, np.arange(len(own) + 1))
            n_words, n_removed, digest, found = [], [], [], []
            for d in range(len(own)):
                text = data[offsets[d] : offsets[d + 1]].tobytes().split()
                keep, mine = np.ones(len(text), bool), range(limits[d], limits[d + 1])
                for i in mine:
                    keep[low[i] : high[i]] = False
                kept = [w for w, k in zip(text, keep.tolist()) if k] if mine else text
                n_words.append(len(text))
                n_removed.append(len(text) - len(kept))
                joined = b" ".join(kept)
                digest.append(joined.decode() if spans else hashlib.sha256(joined).hexdigest())
                if spans:
                    found.append([(int(low[i]), int(high[i]), None if place[i] == LAST else int(place[i]), int(start[i])) for i in mine])
            columns = [batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_text" if spans else "kept_sha256"]
            if spans:
                kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("reference", pa.int64()), ("reference_start", pa.int32())])
                columns.append(pa.array([[dict(zip(("start", "end", "reference", "reference_start"), f)) for f in row] for row in found], pa.list_(kind)))
                names.append("factors")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def without_repeats(docs: DataFrame, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of `docs`; with `spans` the kept text and the factors instead of the digest.

    A factor has its words in the text (start, end), the doc_id of its reference, and the word it starts at there. Of several earlier
    places of a phrase the reference is the one in the smallest doc_id, and there the first; a document's own text comes last.

    NULL and empty texts have no words; the kept words are joined by one space. Very long texts are parsed whole. Rows with the same
    doc_id are one place: they are not earlier than one another. Rows without doc_id, or with one that is no number, come after all
    others and are no reference but to themselves (NULL). Other columns are not read. An empty table gives an empty result.
    """
    place = F.coalesce(F.col("doc_id").try_cast("bigint"), F.lit(LAST)).alias("place")
    own = docs.select("doc_id", place, F.xxhash64("doc_id", "text").alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # about six bytes a word
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6) / BLOCK_PHRASES))))
    shipped = own.select("place", "key", "text").mapInArrow(lambda b: _ship(b, bits), _SHIPPED)
    answers = cut(shipped.groupBy("block").applyInArrow(lambda t: _answer(t, bits), _ANSWERED))
    each = cut(answers.groupBy("part").applyInArrow(lambda t: _gather(t), _GATHERED))
    drop(answers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "kept_text string, factors array<struct<start:int,end:int,reference:bigint,reference_start:int>>" if spans else "kept_sha256 string"
    return own.join(each, "key", "left").select("doc_id", "place", "text", "blocks", "lengths", "shifts", "places").mapInArrow(
        lambda b: _parse(b, bits, spans), f"doc_id {kind}, n_words bigint, n_removed bigint, {last}")
