"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table

CAPACITY, END_ID = 1024, 2
#: The added token of byte_bpe_50k.json, which its tokenizer reads inside texts too.
ADDED = {"<|endoftext|>": 50256}
#: Pieces of a shard, islands of each shard, migrations between them, solutions of an island.
SHARD, ISLANDS, MIGRATIONS, POPULATION = 4096, 2, 2, 4
#: An island goes on until so many generations in a row, or as many as deal with so many items, have brought its best
#: solution less than this gain, in bins or in squared fill.
PATIENCE, DEALT, GAIN = 3, 4096, 0.05
#: Bins of a shard that are emptier than this are packed again together with those of other shards.
POOR = 0.97


def pieces(docs: DataFrame, capacity: int, vocabulary: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, END_ID last; only the first piece of a longer one may be short."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if vocabulary else ADDED)
        for batch in slices(batches):
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoding.encode(text or "", allowed_special="all"), END_ID], "<u4")
                start, k = 0, 0
                while start < len(ids):
                    end = start + ((len(ids) - start - 1) % capacity + 1 if not k else capacity)
                    rows.append((k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    owner.append(i)
                    start, k = end, k + 1
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of items 0..n-1 (largest first) as an array that gives each item's bin."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.size_list = sizes, capacity, sizes.tolist()

    def best_fit(self, bins: list[list[int]], items) -> list[list[int]]:
        """Puts items, in their order (ascending: largest first), each into the fullest bin that has room, or a new one."""
        room = [self.capacity - sum(self.size_list[i] for i in b) for b in bins]
        free = sorted((r, k) for k, r in enumerate(room) if r)
        for i in items:
            at = bisect_left(free, (self.size_list[i], -1))
            if at < len(free):
                r, k = free.pop(at)
                bins[k].append(i)
            else:
                r, k = self.capacity, len(bins)
                bins.append([i])
            if r > self.size_list[i]:
                insort(free, (r - self.size_list[i], k))
        return bins

    def fill(self, genes: np.ndarray) -> np.ndarray:
        return np.bincount(genes, weights=self.sizes) / self.capacity

    def fitness(self, genes: np.ndarray) -> tuple[float, float]:
        fill = self.fill(genes)
        return -len(fill), float((fill * fill).sum())

    def genes(self, bins: list[list[int]]) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for k, b in enumerate(bins):
            out[b] = k
        return out

    def bins(self, genes: np.ndarray) -> list[list[int]]:
        order = np.argsort(genes, kind="stable")
        return [b.tolist() for b in np.split(order, np.cumsum(np.bincount(genes))[:-1])]

    def seed(self, rng: np.random.Generator) -> np.ndarray:
        """A random start: some items are placed in random order first, the rest by best fit decreasing."""
        early = np.flatnonzero(rng.random(len(self.sizes)) < rng.choice([0.0, 0.02, 0.1]))
        bins: list[list[int]] = []
        for i in rng.permutation(early).tolist():
            bins = self.best_fit(bins, [i]) if len(bins) < 64 else bins + [[i]]
        return self.genes(self.best_fit(bins, sorted(set(range(len(self.sizes))) - set(early.tolist()))))

    def cross(self, mother: np.ndarray, father: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The father's well-filled bins enter whole; the mother's bins that share an item with them go, and the items that lose their place are best-fitted."""
        fill = self.fill(father)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.4))), replace=False)
        enters = np.isin(father, chosen)
        broken = np.isin(mother, np.unique(mother[enters]))
        return self._rebuild(mother, father, enters, broken, rng)

    def mutate(self, genes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The emptiest bins and a few others are emptied and their items best-fitted."""
        fill = self.fill(genes)
        drop = np.union1d(np.argsort(fill)[: max(2, len(fill) // 50)], rng.choice(len(fill), min(len(fill), rng.integers(1, max(3, len(fill) // 50) + 1)), replace=False))
        return self._rebuild(genes, genes, np.zeros(len(genes), bool), np.isin(genes, drop), rng)

    def _rebuild(self, mother, father, enters, broken, rng) -> np.ndarray:
        kept = ~broken & ~enters
        bins = [b for part, mask in ((mother, kept), (father, enters)) for b in self._groups(part, mask)]
        bins, free = self._swap(bins, np.flatnonzero(broken & ~enters))
        return self.genes(self.best_fit(bins, rng.permutation(free).tolist() if rng.random() < 0.2 else sorted(free)))

    def _swap(self, bins: list[list[int]], free: np.ndarray) -> tuple[list[list[int]], list[int]]:
        """Displaced items take the place of one item, or of two, of a bin that they fill better, which is displaced instead; the largest choose first."""
        if not bins or not len(free):
            return bins, free.tolist()
        order = np.fromiter((i for b in bins for i in b), np.int64)
        many = np.fromiter(map(len, bins), np.int64, len(bins))
        owner = np.repeat(np.arange(len(bins)), many)
        room = self.capacity - np.bincount(owner, weights=self.sizes[order], minlength=len(bins)).astype(np.int64)
        first, second = [np.arange(len(order))], [np.full(len(order), -1)]
        for step in (1, 2):
            at = np.flatnonzero(owner[step:] == owner[:-step]) if len(order) > step else np.zeros(0, np.int64)
            first.append(at)
            second.append(at + step)
        first, second = np.concatenate(first), np.concatenate(second)
        # Only bins with room can gain; out and most are what they lose at least and at most for it.
        some = room[owner[first]] > 0
        first, second = first[some], second[some]
        out = self.sizes[order[first]] + np.where(second >= 0, self.sizes[order[second]], 0)
        most = out + room[owner[first]]
        left, loose = sorted(free.tolist()), []
        for i in left:
            size = self.size_list[i]
            gain = np.where((out < size) & (size <= most), size - out, 0)
            k = int(gain.argmax()) if len(gain) else 0
            if not len(gain) or not gain[k]:
                loose.append(i)
                continue
            b = int(owner[first[k]])
            gone = {int(order[j]) for j in (first[k], second[k]) if j >= 0}
            bins[b] = [j for j in bins[b] if j not in gone] + [i]
            loose += gone
            most[owner[first] == b] = -1
        return bins, loose

    @staticmethod
    def _groups(genes: np.ndarray, mask: np.ndarray) -> list[list[int]]:
        items = np.flatnonzero(mask)
        if not len(items):
            return []
        order = items[np.argsort(genes[items], kind="stable")]
        return [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(genes[order])) + 1)]


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """One island: a child replaces the worst solution if it is better, as long as that gains something; stops at the lower bound."""
    packing, rng = Packing(sizes, capacity), np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    while len(population) < POPULATION:
        population.append(packing.genes(packing.best_fit([], range(len(sizes)))) if not population else packing.seed(rng))
    scored = sorted(((packing.fitness(g), k, g) for k, g in enumerate(population)), key=lambda x: x[:2], reverse=True)[:POPULATION]
    turn, idle = 0, 0
    while idle < max(PATIENCE, DEALT // len(sizes)) and -scored[0][0][0] > least:
        turn += 1
        a, b = rng.choice(len(scored), 2, replace=False)
        child = packing.mutate(packing.cross(scored[min(a, b)][2], scored[max(a, b)][2], rng), rng)
        best, made = scored[0][0], packing.fitness(child)
        if made not in [f for f, _, _ in scored]:  # as good as another is mostly the same, and would crowd the island
            scored = sorted([*scored, (made, -turn, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
        idle = 0 if scored[0][0][0] > best[0] or scored[0][0][1] > best[1] + GAIN else idle + 1
    return [g for _, _, g in scored]


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)


def genetic_packing(items: DataFrame, capacity: int, shard: str) -> DataFrame:
    """(shard, uid, length, bin, fill) for items (shard, uid, length): the best solution of each shard's islands.

    Each (shard, island) evolves its own population from its own seed; then its elite moves on to
    the next island, which evolves again; last the best island's solution places the shard's items.
    A shard is a hash class of about SHARD items, so groups do not grow with the input.
    """
    spread = items.select(shard, "uid", "length", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    schema = f"{shard} long, island int, rank int, genes binary"

    def rows(key: tuple, solutions: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({shard: key[0], "island": np.int32(key[1]), "rank": np.arange(len(solutions), dtype=np.int32), "genes": [g.tobytes() for g in solutions]})

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return rows(key, evolve(_sorted(pdf)["length"].to_numpy(), capacity, [], int(key[0]) * 1009 + int(key[1])))

    def go_on(key: tuple, pdf: pd.DataFrame, genes: pd.DataFrame) -> pd.DataFrame:
        population = [np.frombuffer(g, np.int32) for g in genes.sort_values("rank")["genes"]]
        return rows(key, evolve(_sorted(pdf)["length"].to_numpy(), capacity, population, int(key[0]) * 1009 + int(key[1]) + 500_009))

    def place(pdf: pd.DataFrame, genes: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        packing = Packing(pdf["length"].to_numpy(), capacity)
        best = max((np.frombuffer(g, np.int32) for g in genes.sort_values("island")["genes"]), key=packing.fitness)
        return pdf.assign(bin=best.astype(np.int64), fill=packing.fill(best)[best])[[shard, "uid", "length", "bin", "fill"]]

    state = spread.groupBy(shard, "island").applyInPandas(start, schema)
    for _ in range(MIGRATIONS):
        state = materialise(state)
        elite = state.where("rank = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("rank", F.lit(-1))
        state = spread.groupBy(shard, "island").cogroup(state.unionByName(elite).groupBy(shard, "island")).applyInPandas(go_on, schema)
    return items.select(shard, "uid", "length").groupBy(shard).cogroup(state.where("rank = 0").groupBy(shard)).applyInPandas(place, f"{shard} long, uid long, length long, bin long, fill double")


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs whole documents, cut only where longer than a sequence, into as few sequences as it can.

    Returns a row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
    Texts are read and tokenised once; the pieces are thin rows. Pieces of full length are
    sequences of their own. The others are packed shard by shard (genetic_packing); items of bins
    emptier than POOR are dealt into new shards over all old ones and packed once more.

    vocabulary: path of the rank file, by default that of the installed public tokenizers. A null
    text counts as empty; an empty one is the end id alone. Rows that repeat, also those of a null
    doc_id, are packed row by row. An empty table gives no rows. Other columns are ignored.
    """
    cut = materialise(pieces(docs, capacity, vocabulary, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    small = cut.where(F.col("length") < capacity)
    n = small.count()
    items = small.select(F.pmod(F.xxhash64("uid"), F.lit(-(-n // SHARD) or 1)).alias("shard"), "uid", "length")
    first = materialise(genetic_packing(items, capacity, "shard"))
    poor = first.where(F.col("fill") < POOR)
    again = poor.select(F.pmod(F.xxhash64("uid", F.lit("again")), F.lit(-(-poor.count() // SHARD) or 1)).alias("pool"), "uid", "length")
    second = genetic_packing(again, capacity, "pool")
    # Sequence ids: 3 k for first bins, 3 k + 1 for pooled ones, 3 uid + 2 for full pieces; k counts up to 2**24 bins of a shard.
    number = lambda c, tail: (3 * (F.col(c) * 2**24 + F.col("bin")) + tail).alias("sequence_id")
    placed = first.where(F.col("fill") >= POOR).select("uid", number("shard", 0)).unionByName(second.select("uid", number("pool", 1)))
    rows = small.join(placed, "uid").unionByName(cut.where(F.col("length") == capacity).withColumn("sequence_id", 3 * F.col("uid") + 2))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
