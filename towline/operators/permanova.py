"""Permutational analysis of variance on Bray-Curtis dissimilarity.

With orthonormal, centred design rows q_i the sum of squares of a term is -sum over pairs i<j of
d_ij^2 (q_i . q_j) over its columns, so one pass over tiles gives all terms, and permuting the rows of
q in the same pass gives the reference distribution. Pairs are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Community, Tile, block_tiles, blocks_of, community, copies_of, map_tiles, tiles_of
from .design import design, factor, gram, term_variables
from .dissimilarity import group_labels, group_sums

BROADCAST_BYTES = 128 * 2**20
JOINED_PERMUTATIONS = 64
_RESULT = "term string, df bigint, ss double, ms double, f double, r2 double, p double"


_MASK = 0xFFFFFFFF
_SEED_STEP, _MIX = 0x9E3779B1, 0x45D9F3B
_TURNS = 7
INDEX_CELLS = 1 << 16  # places permuted at once


def permuted_index(index: np.ndarray, n: int, seed: int, permutation: np.ndarray) -> np.ndarray:
    """Where each permutation sends each of 0..n-1: a keyed bijection, so no task holds a permutation.

    A balanced network of mixing rounds permutes the next power of four; values that land outside 0..n-1 are sent round
    again. Permutation 0 is the identity. All numbers fit signed 64-bit integers, so SQL draws the same (`permutation_sql`).
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint32((1 << half) - 1)

    def mix(v):
        for _ in range(2):
            v = (v ^ (v >> 16)) * np.uint32(_MIX)  # 32 bits are kept
        return v ^ (v >> 16)

    start = (seed * _SEED_STEP) & _MASK
    keys = [mix(((permutation.astype(np.int64) * 8 + r + start) & _MASK).astype(np.uint32)) for r in range(_TURNS)]

    def turn(v, row):
        left, right = (v >> half).astype(np.uint32), (v & int(low)).astype(np.uint32)
        for key in keys:
            left, right = right, left ^ (mix(right + key[row]) & low)
        return (left.astype(np.int64) << half) | right

    index = index.astype(np.int64)
    value = np.empty((len(permutation), len(index)), np.int64)
    step = max(1, INDEX_CELLS // max(1, len(index)))
    for first in range(0, len(permutation), step):
        rows = np.arange(first, min(first + step, len(permutation)))
        drawn = turn(index[None, :], rows[:, None]).ravel()
        at = np.flatnonzero(drawn >= n)
        while len(at):  # only those outside are sent on
            drawn[at] = turn(drawn[at], rows[at // len(index)])
            at = at[drawn[at] >= n]
        value[rows] = drawn.reshape(len(rows), -1)
    value[permutation == 0] = index
    return value


def permutation_sql(units: str, seed: int, permutations: int) -> str:
    """Tables `placed` (unit, pos) and `sent` (perm, pos, too) in SQL, for the units of a table: what `permuted_index` draws, without the identity."""
    mix = lambda v: f"list_reduce([{v}, 1, 1, 2], lambda x, step: CASE WHEN step = 1 THEN (xor(x, x >> 16) * {_MIX}) & {_MASK} ELSE xor(x, x >> 16) END)"
    turn = f"list_reduce(list_prepend({{v}}, keys), lambda s, k: ((s & low) << half) | xor(s >> half, {mix(f'((s & low) + k) & {_MASK}')} & low))"
    return f"""placed AS (SELECT unit, CAST(row_number() OVER (ORDER BY unit) - 1 AS BIGINT) AS pos FROM {units}),
dims AS (SELECT count(*) AS n, greatest(1, (CAST(floor(log2(greatest(count(*) - 1, 1))) AS INTEGER) + 2) // 2) AS half FROM placed),
drawn AS (SELECT CAST(p AS BIGINT) AS perm, n, half, CAST((1 << half) - 1 AS BIGINT) AS low,
  list_transform(CAST(range({_TURNS}) AS BIGINT[]), lambda r: {mix(f'(CAST(p AS BIGINT) * 8 + r + {(seed * _SEED_STEP) & _MASK}) & {_MASK}')}) AS keys
  FROM dims, range(1, {permutations + 1}) g(p)),
walk AS (
  SELECT perm, pos, {turn.format(v='pos')} AS too FROM drawn, placed
  UNION ALL SELECT w.perm, w.pos, {turn.format(v='w.too')} FROM walk w JOIN drawn USING (perm) WHERE w.too >= n
), sent AS (SELECT perm, pos, too FROM walk, dims WHERE too < n)"""


def _positions(units: DataFrame) -> DataFrame:
    """`(unit, at)`: the place of each unit in their order, from 0, however they are laid out."""
    ordered = cut(units.select("unit").orderBy("unit").select("unit", F.monotonically_increasing_id().alias("__id")))
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    offsets, total = {}, 0
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # one row per partition
        offsets[r["part"]], total = total, total + r["count"]
    before = F.element_at(F.map_from_arrays(F.array([F.lit(b).cast("bigint") for b in offsets]), F.array([F.lit(v).cast("bigint") for v in offsets.values()])), part)
    return ordered.select("unit", (before + row).alias("at"))


def _squares(tile: Tile) -> np.ndarray:
    """Squared dissimilarity of a tile, zero where the pair belongs to another cell."""
    d2 = np.empty((len(tile.a), len(tile.b)))
    for rows, mask in tile.strips():
        d = tile.dissimilarity(rows)
        d2[rows] = d * d * mask
    return d2


_SUMS = "perm int, term int, v double"


def _emit(totals: np.ndarray, perms: np.ndarray) -> dict:
    """Sums as rows; term -1 is the total."""
    width = totals.shape[1]
    return {"perm": np.repeat(perms, width), "term": np.tile(np.arange(width) - 1, len(perms)), "v": totals.ravel()}


def _in_order(rows: DataFrame, width: int) -> np.ndarray:
    """The rows `z` in order of their first value, fetched as bytes."""

    def pack(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"z": [np.concatenate(batch["z"].to_numpy()).astype(float).tobytes()]})

    z = np.concatenate([np.zeros((0, width)), *(np.frombuffer(r["z"]).reshape(-1, width) for r in rows.select("z").mapInPandas(pack, "z binary").collect())])
    return z[np.argsort(z[:, 0])]


def _sums_with_broadcast(com, rows, n, terms_of, n_terms, permutations, seed) -> DataFrame:
    """Sums for all permutations in one pass over pairs of profiles; the design rows of all units, in order of their places, are broadcast.

    With d the same for all units of two profiles, the sum over their pairs is d^2 times the product of their sums of design rows.
    """
    spark = com.profiles.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    member = np.equal.outer(np.array(terms_of), np.arange(n_terms)).astype(float)

    def kernel(tiles: Iterator[Tile]):
        q = shared.value
        width = q.shape[1]
        totals = np.zeros((permutations + 1, n_terms + 1))
        seen = False
        for tile in tiles:
            seen = True
            d2 = _squares(tile)
            copies_a, copies_b = np.frombuffer(tile.row.copies_a), np.frombuffer(tile.row.copies_b)
            at_a, at_b = (np.frombuffer(v).astype(np.int64) for v in (tile.row.places_a, tile.row.places_b))
            totals[:, 0] += copies_a @ d2 @ copies_b
            step = max(1, (1 << 22) // max(1, len(at_a) * max(width, 1), len(at_b) * max(width, 1)))
            for low in range(0, permutations + 1, step):
                perms = np.arange(low, min(low + step, permutations + 1))
                qa, qb = (_added(q[permuted_index(at, n, seed, perms)], copies) for at, copies in ((at_a, copies_a), (at_b, copies_b)))
                moved = d2 @ qb.transpose(1, 0, 2).reshape(len(tile.b), -1)
                product = (moved.reshape(len(tile.a), len(perms), width) * qa.transpose(1, 0, 2)).sum(0)
                totals[perms, 1:] -= product @ member
        if seen:
            yield _emit(totals, np.arange(permutations + 1))

    return map_tiles(tiles_of(com), kernel, _SUMS)


def _added(q: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Rows added up over the units of each profile."""
    if q.shape[1] == len(copies):
        return q
    return np.add.reduceat(q, np.concatenate([[0], np.cumsum(copies[:-1])]).astype(np.int64), axis=1)


def _sums_with_join(com, rows, n, terms_of, n_terms, permutations, seed, means, inverse, kept) -> DataFrame:
    """The same sums when the design rows are too large to broadcast.

    Permuted rows reach their unit by a join on the permuted position, a slice of permutations at a
    time, and then travel inside the blocks. Sizes after the expansion are hidden from the planner, so
    these joins are told to merge.
    """
    width = len(kept)
    positions = cut(rows.select("unit", F.get("z", F.lit(0)).cast("bigint").alias("at"), "z"))
    targets = positions.select(F.col("at").alias("to"), "z")
    member = np.equal.outer(np.array(terms_of), np.arange(n_terms)).astype(float)
    parts = []
    for low in range(0, permutations + 1, JOINED_PERMUTATIONS):
        perms = np.arange(low, min(low + JOINED_PERMUTATIONS, permutations + 1))

        def send(batches, perms=perms):
            for batch in batches:
                to = permuted_index(batch["at"].to_numpy(), n, seed, perms)
                yield pd.DataFrame({"at": np.tile(batch["at"].to_numpy(), len(perms)),
                                    "perm": np.repeat(perms, len(batch)), "to": to.ravel()})

        moves = positions.select("at").mapInPandas(send, "at bigint, perm int, to bigint")
        gathered = (
            moves.join(targets.hint("merge"), "to").groupBy("at")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("perm", "z"))), lambda s: s.z)).alias("z"))
        )
        carried = positions.select("unit", "at").join(gathered.hint("merge"), "at").select("unit", "z").hint("merge")

        def kernel(tiles: Iterator[Tile], perms=perms):
            totals = np.zeros((len(perms), n_terms + 1))
            seen = False
            for tile in tiles:
                seen = True
                d2 = _squares(tile)
                totals[:, 0] += d2.sum()
                za = np.frombuffer(tile.row.z_a).reshape(len(tile.a), len(perms), -1)[:, :, 1:]
                zb = np.frombuffer(tile.row.z_b).reshape(len(tile.b), len(perms), -1)[:, :, 1:]
                qa, qb = ((z[:, :, kept] - means[kept]) @ inverse for z in (za, zb))
                moved = (d2 @ qb.reshape(len(tile.b), -1)).reshape(len(tile.a), len(perms), width)
                totals[:, 1:] -= (moved * qa).sum(0) @ member
            if seen:
                yield _emit(totals, perms)

        packed, n_blocks = blocks_of(com, carried)
        parts.append(map_tiles(block_tiles(packed, n_blocks), kernel, _SUMS).groupBy("perm", "term").agg(F.sum("v").alias("v")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def permanova(
    long: DataFrame | Community,
    env: DataFrame,
    terms: Sequence,
    permutations: int = 999,
    seed: int = 1,
    unit: str = "unit",
    taxon: str = "taxon",
    x: str = "x",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sequential test of terms: `(term, df, ss, ms, f, r2, p)` with `residual` and `total` rows.

    Terms are taken in order, numeric, categorical or interactions; columns that earlier ones explain
    are dropped from the degrees of freedom. `env` has one row per unit; units without catch or with
    an unknown variable are left out. `p` is NULL when no permutations are asked for.
    """
    com = long if isinstance(long, Community) else community(long, unit, taxon, x)
    names = dict.fromkeys(["unit", *term_variables(terms)])
    named = env.withColumn("unit", F.col(unit)).select(*names)
    # Written once: levels, means and products are read from it, not from whatever made `env`.
    used = cut(named.join(com.profiles.select("unit"), "unit", "left_semi"))
    spec = design(used, terms)
    complete = spec.complete(used)
    matrix = gram(complete, [F.lit(1.0), *[c.shifted() for c in spec.columns]])[()]
    fit = factor(matrix)
    n = int(round(fit.n))
    terms_of = [spec.terms.index(spec.columns[k].term) for k in fit.kept]
    # The place of a unit goes before its design row.
    rows = complete.join(_positions(complete), "unit").select("unit", F.array(F.col("at").cast("double"), *[c.shifted() for c in spec.columns]).alias("z"))
    means, inverse, kept = fit.means, fit.inverse, fit.kept
    if n * max(1, len(kept)) * 8 <= broadcast_bytes:
        rows = cut(rows)
        in_order = _in_order(rows, len(spec.columns) + 1)
        placed = com.profiles.join(rows.select("unit", F.get("z", F.lit(0)).alias("at")), "unit")
        sums = _sums_with_broadcast(copies_of(placed, place="at"), (in_order[:, 1:][:, kept] - means[kept]) @ inverse, n, terms_of, len(spec.terms), permutations, seed)
    else:
        sums = _sums_with_join(com, rows, n, terms_of, len(spec.terms), permutations, seed, means, inverse, kept)
    # One row per permutation and term.
    table = np.zeros((permutations + 1, len(spec.terms) + 1))
    for r in sums.groupBy("perm", "term").agg(F.sum("v").alias("v")).collect():
        table[r["perm"], r["term"] + 1] = r["v"]
    total = table[:, 0] / n
    explained = table[:, 1:]
    dfs = np.array([terms_of.count(k) for k in range(len(spec.terms))])
    df_residual = n - 1 - int(dfs.sum())
    residual = total - explained.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (explained / dfs) / (residual / df_residual)[:, None]
    out = []
    for k, name in enumerate(spec.terms):
        if dfs[k] == 0:
            out.append((name, 0, None, None, None, None, None))
            continue
        p = (1 + int((f[1:, k] >= f[0, k] * (1 - 1e-12)).sum())) / (permutations + 1) if permutations else None
        out.append((name, int(dfs[k]), float(explained[0, k]), float(explained[0, k] / dfs[k]), float(f[0, k]),
                    float(explained[0, k] / total[0]), p))
    out.append(("residual", df_residual, float(residual[0]),
                float(residual[0] / df_residual) if df_residual else None, None, float(residual[0] / total[0]), None))
    out.append(("total", n - 1, float(total[0]), None, None, 1.0, None))
    return complete.sparkSession.createDataFrame(out, _RESULT)


def permanova_oneway(
    long: DataFrame | Community, groups: DataFrame, group: str = "group", unit: str = "unit", taxon: str = "taxon", x: str = "x"
) -> DataFrame:
    """One factor, from within-group and overall sums of squared dissimilarity."""
    com = long if isinstance(long, Community) else community(long, unit, taxon, x)
    labels = group_labels(groups, group).join(com.profiles.select("unit"), "unit", "left_semi")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sums = group_sums(com, groups, group)
    within = sums.filter("g1 = g2").select(F.col("g1").alias("label"), "sum_d2")
    # A group of one unit has no pair: it counts in n and in the number of groups only.
    inside = sizes.join(within, "label", "left").agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.coalesce("sum_d2", F.lit(0.0)) / F.col("size")).alias("within"),
    )
    numbers = inside.withColumn("all_d2", sums.agg(F.sum("sum_d2")).scalar()).select(
        F.lit(group).alias("term"), (F.col("k") - 1).alias("df"), (F.col("n") - F.col("k")).alias("df_residual"),
        (F.col("all_d2") / F.col("n")).alias("ss_total"), F.col("within").alias("ss_residual"),
    )
    explained = F.col("ss_total") - F.col("ss_residual")
    return numbers.withColumns({
        "ss": explained,
        "f": F.try_divide(F.try_divide(explained, "df"), F.try_divide("ss_residual", "df_residual")),
        "r2": F.try_divide(explained, "ss_total"),
    })


def explained(result: DataFrame) -> DataFrame:
    """Share of variance per term and residual, without the total row."""
    return result.filter(F.col("term") != "total").select(F.col("term").alias("predictor"), "r2")
