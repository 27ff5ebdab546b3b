"""Best-fit packing with conflicts: pieces of documents into bins of a fixed number of words.

Two pieces may not share a bin if they are of the same source or of the same duplicate cluster, which is one of near copies as `jaccard`
links them, or of equal texts only where the near copies are known to be gone. Pieces are dealt into
shards of bounded size by a hash of their document, so that a hot source or a large cluster spreads over all shards,
and each shard is packed by itself: bins are kept ordered by residual capacity with bitmaps of their sources and clusters, a piece is
offered to the bin of the least sufficient residual, and the search goes on to the successors until a bin without
conflict is found; if there is none, a bin is opened. No bin of a shard that a piece fits in is tighter and compatible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.session import cut, drop

from .jaccard import clusters
from .text import FOLDED, Words, sequences

CAPACITY = 2048  # words
SHARD_PIECES = 20_000
_SCAN = 256  # bins looked at together


class Bins:
    """Open bins in order of residual, each with a bitmap of sources and clusters."""

    def __init__(self, capacity: int, n_bits: int):
        self.capacity = capacity
        self.width = max(1, -(-n_bits // 64))
        self.n = 0
        self.residual, self.number = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.bits = np.zeros((1024, self.width), np.uint64)  # by bin number
        self.opened = 0

    def _remove(self, at: int) -> None:
        self.residual[at : self.n - 1] = self.residual[at + 1 : self.n]
        self.number[at : self.n - 1] = self.number[at + 1 : self.n]
        self.n -= 1

    def _insert(self, residual: int, number: int) -> None:
        if self.n == len(self.residual):
            self.residual, self.number = np.append(self.residual, np.zeros(self.n, np.int64)), np.append(self.number, np.zeros(self.n, np.int64))
        at = int(np.searchsorted(self.residual[: self.n], residual))
        self.residual[at + 1 : self.n + 1] = self.residual[at : self.n]
        self.number[at + 1 : self.n + 1] = self.number[at : self.n]
        self.residual[at], self.number[at] = residual, number
        self.n += 1

    def place(self, size: int, own: list[int]) -> tuple[int, int]:
        """Put a piece with bits `own` into the tightest compatible bin: its number and what it held before."""
        words, masks = np.array([b // 64 for b in own]), [np.uint64(1 << (b % 64)) for b in own]
        at = int(np.searchsorted(self.residual[: self.n], size))
        while at < self.n:
            number = self.number[at : at + _SCAN][: self.n - at]
            clash = np.zeros(len(number), bool)
            for w, m in zip(words, masks):
                clash |= (self.bits[number, w] & m) != 0
            free = int(clash.argmin())
            if not clash[free]:
                at += free
                chosen, held = int(self.number[at]), self.capacity - int(self.residual[at])
                left = int(self.residual[at]) - size
                self._remove(at)
                break
            at += len(number)
        else:
            chosen, held, left = self.opened, 0, self.capacity - size
            self.opened += 1
            if self.opened > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        for w, m in zip(words, masks):
            self.bits[chosen, w] |= m
        if left > 0:
            self._insert(left, chosen)
        return chosen, held


def pack(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One shard: largest pieces first; ties by document and piece. A full-size piece is a bin of its own."""
    f = pieces.sort_values(["n_tokens", "doc_id", "__row", "piece"], ascending=[False, True, True, True], na_position="last").reset_index(drop=True)
    source = f["source"].where(f["source"].notna(), None)
    source = pd.factorize(source.fillna("\0none"))[0]
    own, n_bits = [[int(s)] for s in source], int(source.max(initial=-1)) + 1
    for column in f.columns.intersection(["__cluster", "__folded"]):
        repeated = f[column].duplicated(keep=False) & f[column].notna()
        if repeated.any():
            codes, names = pd.factorize(f.loc[repeated, column])
            for at, code in zip(np.flatnonzero(repeated), codes):
                own[at].append(n_bits + int(code))
            n_bits += len(names)
    bins = Bins(capacity, n_bits)
    placed = [bins.place(int(n), bits) for n, bits in zip(f["n_tokens"], own)]
    f["__bin"], f["start"] = [p[0] for p in placed], [p[1] for p in placed]
    return f


def _text_keys(words: Words, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    """Per text: its number of words, and a hash of its words in lower case, NULL without any. `words` are those with A-Z as a-z."""
    folded = sequences(words)
    for d in np.flatnonzero(np.add.reduceat(np.append(data > 127, False), offsets[:-1]) * (np.diff(offsets) > 0)):
        text = data[offsets[d] : offsets[d + 1]].tobytes()
        lower = text.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")
        if lower != text.lower():  # capitals beyond A-Z
            folded[d] = sequences(Words(np.frombuffer(lower, np.uint8), np.array([0, len(lower)]), FOLDED))[0]
    n = words.counts()
    return {"n_words": pa.array(n, pa.int64()), "folded": pa.array(folded.view(np.int64), mask=n == 0)}


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, cluster: str | None = None, near: bool = False) -> DataFrame:
    """(doc_id, piece, n_tokens, source, shard, bin, start): each piece, its bin within its shard, and where it starts there.

    A text is cut into pieces of `capacity` words, the last one shorter; words are runs without ASCII white space. A NULL,
    empty or blank text is one piece of no words, which takes no room but still conflicts. Duplicate clusters are column
    `cluster`, or equal texts up to case and white space; with `near`, documents that `jaccard.clusters` links conflict too. NULL sources are one source; NULL clusters conflict with nothing.
    Pieces of one document conflict with one another. Repeated rows are packed one by one. An empty table gives an empty
    result.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("__row"), "text", *([F.col(cluster).cast("string").alias("__given")] if cluster else []))
    kept = [c for c in rows.columns if c != "text"]
    if near:
        linked = clusters(rows, kept, "__row", _text_keys, "n_words bigint, folded bigint")
        equal = F.col("__given") if cluster else F.col("folded").cast("string")
        rows = cut(linked.select("doc_id", "source", "__row", F.col("n_words").alias("__n"), equal.alias("__folded"), F.col("cluster").alias("__cluster")))
        drop(linked)
    else:
        folded = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ")))
        n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        key = F.col("__given") if cluster else F.when(n > 0, F.xxhash64(folded).cast("string"))
        rows = cut(rows.select("doc_id", "source", n.cast("bigint").alias("__n"), key.alias("__cluster"), "__row"))
    keys = [c for c in ("__cluster", "__folded") if c in rows.columns]
    last = F.greatest(F.ceil(F.col("__n") / capacity).cast("int") - 1, F.lit(0))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("__n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint"))
    n_pieces = rows.agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    # By document and piece, so that a document of any length spreads too; its pieces conflict through their source and stay apart in any shard.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("__row", "piece"), F.lit(shards)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, n_tokens bigint, source string, shard int, bin int, start bigint"
    columns = ["doc_id", "piece", "n_tokens", "source", "shard", "bin", "start"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pack(frame, capacity).rename(columns={"__bin": "bin"})[columns]

    return dealt.select("doc_id", "source", *keys, "__row", "piece", "n_tokens", "shard").groupBy("shard").applyInPandas(run, schema)
