"""Approximate nearest neighbours by collision counting over query-centred windows of sorted projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Projections, growth of a window in middle spreads of a projection, share of the possible collisions that enough vectors must reach before windows stop.
PROJECTIONS, STEP, THRESHOLD = 64, 0.5, 0.7
#: Vectors of a shard that are enough: so many for each neighbour asked for, and this share of the shard.
ENOUGH, ENOUGH_SHARE = 10, 0.02
#: Different vectors of a shard, queries of a block, queries counted at a time.
SHARD, BLOCK, COUNTED = 16_384, 4_096, 256
#: Accuracy of the medians that cut the space into cells.
ACCURACY = 1_000


def lines(size: int, seed: int = 11) -> np.ndarray:
    """Unit vectors to project on, in random orthogonal bases: their collisions tell more of a distance than those of independent lines."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS]


class Shard:
    """Sorted arrays of single projections over the different vectors of one shard."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.lines = vectors, lines(vectors.shape[1])
        values = vectors @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.sort(values, axis=0).T.copy()
        n = len(vectors)
        spread = self.values[:, min(n - 1, int(n * 0.75))] - self.values[:, int(n * 0.25)]
        self.step = float(np.median(spread)) * STEP / 2 or 1e-9

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """A lower bound of each query's distance to any vector: what its projections lack to the ends of the sorted arrays."""
        at = queries @ self.lines
        gap = np.maximum(0, np.maximum(self.values[:, 0] - at, at - self.values[:, -1]))
        bases = -(-PROJECTIONS // self.vectors.shape[1])
        return np.sqrt((gap * gap).sum(axis=1) / bases) * (1 - 1e-9) - 1e-12

    def nearest(self, queries: np.ndarray, k: int):
        """For each query the places of the vectors to verify."""
        return [hits for at in range(0, len(queries), COUNTED) for hits in self._grow(queries[at : at + COUNTED], k)]

    def _grow(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Virtual rehashing: windows around a query's projections grow step by step, and every window counts the vectors in it.

        They stop when enough vectors have collided in THRESHOLD of all windows so far; the collision
        threshold is then the highest that enough vectors exceed or reach. A grown window looks up only what it gains at its two ends.
        """
        n, m = len(self.vectors), len(queries)
        enough = min(n, ENOUGH * k + int(ENOUGH_SHARE * n))
        centres = (queries @ self.lines).T
        todo = np.arange(m)
        inside, counts = np.zeros((m, n), np.int16), np.zeros((m, n), np.int32)
        begun = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres)])
        seen = np.stack((begun, begun))
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * m
        turn = 0
        while len(todo):
            turn += 1
            # Windows grow in proportion once they are wide, so that a query far from all vectors is soon through.
            width = self.step * (turn if turn < 32 else 32 * 1.5 ** (turn - 32))
            low, high = (
                np.stack([np.searchsorted(v, c[todo] + sign * width, side) for v, c in zip(self.values, centres)])
                for sign, side in ((-1, "left"), (1, "right"))
            )
            left = []
            for t, q in enumerate(todo.tolist()):
                lo, hi, a, b = low[:, t], high[:, t], seen[0, :, q], seen[1, :, q]
                gained = [o[x:y] for o, x, y in zip(self.order, lo.tolist(), a.tolist()) if x < y] + [o[x:y] for o, x, y in zip(self.order, b.tolist(), hi.tolist()) if x < y]
                if gained:
                    inside[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int16)
                seen[0, :, q], seen[1, :, q] = lo, hi
                counts[q] += inside[q]
                if (hi - lo).sum() >= THRESHOLD * PROJECTIONS * enough / 2:
                    bar = np.partition(counts[q], n - enough)[n - enough]
                    if bar >= THRESHOLD * PROJECTIONS * turn or (hi - lo).min() == n:
                        found[q] = np.flatnonzero(counts[q] >= bar)
                        continue
                left.append(q)
            todo = np.array(left, np.int64)
        return found


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that take part: not null, not zero, all components finite; rows that repeat once."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).distinct()


def _different(candidates: DataFrame, k: int) -> DataFrame:
    """(v, ids): each different vector with the k + 1 least ids that have it, more than which no answer can hold."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _cells(points: DataFrame, more: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """points and more with dim, the number of components, cell, on which side of the medians a vector's first projections fall, and gaps, how far from them."""

    def sides(df: DataFrame, cuts: dict) -> DataFrame:
        def code(batches):
            for batch in batches:
                dim = np.array([len(x) for x in batch.column("v")], np.int32)
                cell, gaps = np.zeros(len(dim), np.int64), np.zeros((len(dim), bits))
                for size in np.unique(dim).tolist():
                    at = np.flatnonzero(dim == size)
                    gaps[at] = _matrix(batch.column("v").take(pa.array(at))) @ lines(size)[:, :bits] - np.array(cuts.get(size, [0.0] * bits))
                    cell[at] = (gaps[at] > 0) @ (1 << np.arange(bits))
                offsets = pa.array(np.arange(len(dim) + 1, dtype=np.int32) * bits)
                extra = [pa.array(dim), pa.array(cell), pa.ListArray.from_arrays(offsets, pa.array(gaps.ravel()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "dim", "cell", "gaps"])

        return df.mapInArrow(code, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", dim int, cell long, gaps array<double>")

    def project(batches):
        for batch in batches:
            dim = np.array([len(x) for x in batch.column("v")], np.int32)
            p = np.zeros((len(dim), bits))
            for size in np.unique(dim).tolist():
                at = np.flatnonzero(dim == size)
                p[at] = _matrix(batch.column("v").take(pa.array(at))) @ lines(size)[:, :bits]
            yield pa.RecordBatch.from_arrays([pa.array(dim), *(pa.array(p[:, j]) for j in range(bits))], names=["dim", *(f"p{j}" for j in range(bits))])

    cuts = {}
    if bits:
        seen = points.select("v").mapInArrow(project, ", ".join(["dim int", *(f"p{j} double" for j in range(bits))]))
        medians = seen.groupBy("dim").agg(*(F.percentile_approx(f"p{j}", 0.5, ACCURACY).alias(f"p{j}") for j in range(bits)))
        cuts = {r["dim"]: [r[f"p{j}"] for j in range(bits)] for r in medians.collect()}  # a row for each length of vector
    return sides(points, cuts), sides(more, cuts)


def search(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest candidates found for each query: (query_id, rank, vec_id, score), score the Euclidean distance.

    candidates and queries: (vec_id, v) as usable() gives them; a candidate with the query's vec_id
    is left out. Equal vectors are one point with its k + 1 least ids, all that an answer can need. Medians
    of the first projections cut the space into cells of about SHARD points; larger cells are split by
    hash. A query first visits the shards of its own cell; its k-th distance there bounds the rest: of the
    other shards only those are asked whose cell, and searched whose projections, come nearer than that. In a shard,
    windows around a query's projections grow (virtual rehashing) and count collisions; vectors over the
    collision threshold are verified by their exact distance and the k best sent on. Shards and
    blocks of queries have bounded size; a shard's sorted arrays are built in each task of a block, a
    fraction of a second against a block's search.

    Only vectors of the query's length are compared with it. Ties go to the smaller vec_id. Rows that repeat count once; an
    id with several vectors counts for each of them, as a candidate and as a query (the nearest of either). Empty tables give no rows.
    """
    points = materialise(_different(candidates, k))
    bits = min(PROJECTIONS, max(0, math.ceil(math.log2((points.count() or 1) / SHARD))))
    points, asked = (materialise(t) for t in _cells(points, queries.distinct(), bits))
    parts = F.ceil(F.col("held") / SHARD).cast("int")
    held = materialise(points.groupBy("dim", "cell").agg(F.count("*").alias("held")).withColumn("parts", parts))
    shards = points.join(held, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("dim", "cell", "part", "v", "ids")
    n_blocks = -(-asked.count() // BLOCK) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    columns = ["query_id", "vec_id", "score"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, owner = left.column("ids").combine_chunks(), None
        owner = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
        ids, first = ids.flatten().to_numpy(), np.searchsorted(owner, np.arange(len(left) + 1))
        shard, own, vectors = Shard(_matrix(left.column("v"))), right.column("vec_id").to_numpy(), _matrix(right.column("v"))
        bound = right.column("bound").to_numpy(zero_copy_only=False)
        near = np.flatnonzero(shard.reach(vectors) <= bound)
        out = []
        for q, hits in zip(near.tolist(), shard.nearest(vectors[near], k + 1)):
            gap = shard.vectors[hits] - vectors[q]
            apart = np.sqrt((gap * gap).sum(axis=1))
            if len(hits) > 4 * k:
                some = apart <= np.partition(apart, k + 1)[k + 1]
                hits, apart = hits[some], apart[some]
            who = np.concatenate([ids[first[h] : first[h + 1]] for h in hits])
            score = np.repeat(apart, first[hits + 1] - first[hits])
            other = who != own[q]
            who, score = who[other], score[other]
            best = np.lexsort((who, score))[:k]
            out.append((np.full(len(best), own[q]), who[best], score[best]))
        parts = [np.concatenate(x) for x in zip(*out)] or [[], [], []]
        return pa.Table.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema)], schema=schema)

    def visit(routes: DataFrame) -> DataFrame:
        """routes: (block, dim, cell, part, vec_id, v, bound), the shards that each query is sent to."""
        key = ["dim", "cell", "part", "block"]
        blocks = materialise(routes.select(*key).distinct())
        return shards.join(blocks, ["dim", "cell", "part"]).groupBy(*key).cogroup(routes.groupBy(*key)).applyInArrow(task, "query_id long, vec_id long, score double")

    places = held.select("dim", F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = asked.join(places.withColumnRenamed("c", "cell"), ["dim", "cell"]).select("dim", "cell", "part", "block", "vec_id", "v", F.lit(float("inf")).alias("bound"))
    found = materialise(best(visit(home)).select(*columns))
    if bits:
        bounds = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound")).withColumnRenamed("query_id", "vec_id")
        # A shard is a few numbers here; a query's vector goes only to those whose cell comes near enough.
        rooms = places.groupBy("dim").agg(F.collect_list(F.struct("c", "part")).alias("rooms"))
        sent = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).join(rooms, "dim")
        apart = f"aggregate(sequence(0, {bits - 1}), 0D, (s, j) -> s + if(shiftright(r.c ^ cell, j) & 1 = 1, gaps[j] * gaps[j], 0D))"
        sent = sent.withColumn("room", F.explode(F.expr(f"filter(rooms, r -> r.c <> cell and {apart} * (1 - 1e-9) / ceil({bits} / dim) <= bound * bound)")))
        away = sent.select("dim", F.col("room.c").alias("cell"), F.col("room.part").alias("part"), "block", "vec_id", "v", "bound")
        found = best(found.unionByName(visit(materialise(away)))).select(*columns)
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(vectors, vectors.where("vec_id % 100 = 0"))
