"""Periodic runs of words, found as maximal pairs of suffixes.

A run of period q and length L is a stretch whose words q apart are equal and that neither neighbour extends. Its first
two periods begin suffixes that agree on exactly L - q words and follow different words: a maximal pair of distance q.
In turn a maximal pair of distance q whose ends agree on l >= 3 q words spans a stretch of l + q >= 4 q words with that
period, which ends where the pair ends. So runs of at least four periods are the maximal pairs with l >= 3 q, and of
those with the same stretch the one of smallest distance has the smallest period. No pair needs to be extended.

Pairs are listed bottom-up over the intervals of the LCP array of a document's suffixes. A node of depth l is the union
of its children; a pair of suffixes of two children agrees on exactly l words. A node keeps its suffixes in text order
and in classes by the word on their left. The smaller child asks the larger one, for each suffix, for those at most l / 3
away with another word on the left: in the stretch of text order or in the class lists, whichever is the shorter way.

Suffixes that cannot be in such a pair are left out first: the five words after each end of a pair stand at a distance of
at most q from it once more, and so do all that follow it in the pair. Sorting is by prefix doubling over the texts of
one Arrow block. Words are numbered by 64-bit hashes; every run found is compared word by word, and a document in which
two words share a hash is done again with words numbered exactly.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, blocks, mix, shingles

EXPONENT = 4  # periods in a run, at least
LEAST_WORDS = 6  # words in a run, at least
GRAM = LEAST_WORDS - 1  # words that the two ends of a pair share at least: of period 1 five, of longer ones more
_FAR = np.int64(1) << 62


def _suspects(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions that may start one end of a pair with l >= 3 q, among all words of a block."""
    n = len(words)
    if n < LEAST_WORDS:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n - GRAM + 1) + GRAM <= end[: n - GRAM + 1])
    gram = mix(shingles(words, GRAM)[at] ^ mix(doc[at].astype(np.uint64)))
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    a, b = at[order[same]], at[order[same + 1]]
    near = np.full(n, _FAR)
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    again = np.flatnonzero(near < _FAR)
    if not len(again):
        return again
    # Neighbouring positions that are all met again form a stretch, which bounds l and so the distance.
    cuts = np.flatnonzero(np.diff(again) > 1) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(again)]]))
    return again[(EXPONENT - 1) * near[again] <= np.repeat(sizes, sizes) + GRAM - 1]


def _sorted_suffixes(word: np.ndarray, doc: np.ndarray, end: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen positions in the order of their suffixes, and how many words each shares with the one before."""
    m = len(word)
    place = np.arange(m)
    rank = np.unique(doc * np.int64(m + 1) + word, return_inverse=True)[1].astype(np.int32)
    levels, step = [rank], 1
    while np.bincount(rank)[rank[chosen]].max() > 1:
        inside = place + step < end
        following = np.zeros(m, np.int64)
        following[inside] = rank[place[inside] + step] + 1
        rank = np.unique(rank * np.int64(m + 1) + following, return_inverse=True)[1].astype(np.int32)
        levels.append(rank)
        step *= 2
    order = chosen[np.argsort(rank[chosen], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (levels[k][np.minimum(x, m - 1)] == levels[k][np.minimum(y, m - 1)])
        shared[1:] += equal.astype(np.int64) << k
    return order, shared


class _Node:
    """Suffixes of one interval in text order, and the same in classes by the word on their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def _joined(a: _Node, b: _Node, depth: int, left: list[int], found: list[tuple[int, int, int]]) -> _Node:
    """The node of both children; pairs of one suffix of each go to `found` as (first, distance, shared words)."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = depth // (EXPONENT - 1)
    for x in b.places:
        own = left[x]
        low, high = bisect_left(a.places, x - reach), bisect_right(a.places, x + reach)
        if high - low <= len(a.classes):
            met = [y for y in a.places[low:high] if left[y] != own]
        else:
            met = [y for c, places in a.classes.items() if c != own
                   for y in places[bisect_left(places, x - reach) : bisect_right(places, x + reach)]]
        for y in met:
            found.append((x, y - x, depth) if x < y else (y, x - y, depth))
    _merge(a.places, b.places)
    for c, places in b.classes.items():
        if c in a.classes:
            _merge(a.classes[c], places)
        else:
            a.classes[c] = places
    return a


def _merge(into: list[int], more: list[int]) -> None:
    if len(more) < 8:
        for x in more:
            insort(into, x)
    else:
        into += more
        into.sort()  # two sorted parts: one linear merge


def _pairs(order: list[int], shared: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Maximal pairs at most a third of their length apart, over the LCP intervals from the deepest up."""
    found: list[tuple[int, int, int]] = []
    nodes: list[_Node] = []
    depths: list[int] = []
    for place, depth in zip([*order, -1], [*shared, 0]):
        while depths and depths[-1] >= max(depth, GRAM):
            b, a = nodes.pop(), nodes.pop()
            nodes.append(_joined(a, b, depths.pop(), left, found))
        if depth < GRAM:
            nodes.clear()
            depths.clear()
        else:
            depths.append(depth)
        if place >= 0:
            nodes.append(_Node(place, left[place]))
    return found


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts whose words are numbered, in order of text, start and period.

    Text d holds words first[d]:first[d + 1]; starts count from the beginning of the text.
    """
    none = (np.zeros(0, np.int64),) * 4
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = first[1:][doc]
    chosen = _suspects(words, doc, end)
    if not len(chosen):
        return none
    # Only texts with a suspect are sorted.
    texts = np.unique(doc[chosen])
    here = np.zeros(len(counts), bool)
    here[texts] = True
    index = np.flatnonzero(here[doc])
    offset = np.zeros(len(counts), np.int64)
    offset[texts] = first[texts] - np.concatenate([[0], np.cumsum(counts[texts])[:-1]])
    number = np.unique(words[index], return_inverse=True)[1].astype(np.int64)
    own, ends = np.searchsorted(texts, doc[index]), end[index] - offset[doc[index]]
    order, shared = _sorted_suffixes(number, own, ends, chosen - offset[doc[chosen]])
    left = np.where(np.concatenate([[True], own[1:] != own[:-1]]), -1, np.concatenate([[0], number[:-1]]))
    found = _pairs(order.tolist(), shared.tolist(), left.tolist())
    if not found:
        return none
    start, period, depth = np.array(found, np.int64).T
    length = depth + period
    sort = np.lexsort((period, length, start))
    start, length, period = start[sort], length[sort], period[sort]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[least], length[least], period[least]
    sort = np.lexsort((period, start))
    start, length, period = start[sort], length[sort], period[sort]
    text = texts[own[start]]
    return text, start + offset[text] - first[text], length, period


def _exact_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    _, *runs = find_runs(mix(ids), np.array([0, len(words)]))  # mixing is one-to-one
    return list(zip(*(x.tolist() for x in runs)))


def _planted(first: np.ndarray, hashes: list[int | None]) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """For each word of a block the word that takes its place, and (a, p) of each text that is changed."""
    source, changed = np.arange(first[-1]), {}
    for d, h in enumerate(hashes):
        n = int(first[d + 1] - first[d])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        changed[d] = (a, p)
        source[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return source, changed


_FIELDS = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
           ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_MORE = [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]


def _report(words: list[bytes], runs: list[tuple[int, int, int]], whole: bool) -> tuple:
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    kept = words
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        kept = [words[i] for i in np.flatnonzero(stays).tolist()]
    text = b" ".join(kept)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    row = (len(words), len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
           hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())
    return (*row, [dict(zip(("start", "length", "period"), r)) for r in runs], text.decode()) if whole else row


def periodic_runs(docs: DataFrame, planted: Column | None = None, whole: bool = False) -> DataFrame:
    """Runs of at least four periods and six words in each row of `docs`, and the text without their repetitions.

    Per row: doc_id, n_words, n_runs; start, length, period and exponent_milli of the run with the most periods (NULL
    without runs); SHA-256 of the list of runs and of the text in which every run is left with its first period. With
    `whole` also `runs` and `collapsed`, the list and the text. `planted` gives a number per row from which some texts
    are made periodic first, as tests do.

    A NULL or empty text has no words and no run. Rows stay apart when repeated or without doc_id, in which case nothing
    is planted; other columns are not read. An empty table gives an empty result. A text of any length is one piece of
    work of its task: it takes about 150 bytes a word if it may hold a run, and little otherwise.
    """
    fields = _FIELDS + (_MORE if whole else [])
    hashes = F.lit(None).cast("bigint") if planted is None else planted.cast("bigint")
    source = docs.select("doc_id", hashes.alias("planted"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    more = ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if whole else ""
    schema = f"doc_id {kind}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                n = rows.stop - rows.start
                words = Words(data, offsets)
                origin, changed = _planted(words.first, batch.column("planted").slice(rows.start, n).to_pylist())
                text, *found = find_runs(words.hash[origin], words.first)
                found = list(zip(*(x.tolist() for x in found)))
                ranges = np.searchsorted(text, np.arange(n + 1)).tolist()
                out, raw = [], data.tobytes()
                for d in range(n):
                    own = raw[offsets[d] : offsets[d + 1]].split()
                    if d in changed:
                        a, p = changed[d]
                        own = own[:a] + [own[a + i % p] for i in range(len(own) - a)]
                    runs = found[ranges[d] : ranges[d + 1]]
                    if any(own[s : s + k - p] != own[s + p : s + k] for s, k, p in runs):
                        runs = _exact_runs(own)
                    out.append(_report(own, runs, whole))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, n), *columns], names=["doc_id", *(f for f, _ in fields)])

    return source.mapInArrow(run, schema)
