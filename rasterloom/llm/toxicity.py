"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .kernels import WordHasher

#: Bound of the labelled rows that are fitted (those of least digest), folds, bytes of a word beginning.
MAX_TRAIN, FOLDS, PREFIX = 20_000, 3, 5
#: From what score on a document is predicted toxic.
CUT = 0.3
#: Texts that a worker holds and measures at a time.
SLICE = 256
#: Insults, and words that address the reader, in English, German, French and Spanish.
INSULTS = (
    "asshole", "bastard", "clown", "crap", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "hate", "idiot", "idiots", "imbecile", "kill", "liar", "loser", "losers",
    "moron", "morons", "pathetic", "pig", "rat", "scum", "shit", "sick", "stupid", "suck", "sucks", "trash", "ugly", "vermin", "worthless",
    "abschaum", "arschloch", "dumm", "dreck", "idiotisch", "trottel", "versager", "widerlich", "wertlos",
    "abruti", "connard", "crétin", "débile", "imbécile", "minable", "nul", "ordure", "pathétique", "raclure", "stupide",
    "asco", "asqueroso", "basura", "cabrón", "escoria", "estúpido", "idiota", "imbécil", "inútil", "patético", "perdedor", "tonto",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "thou", "thee",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre",
    "tú", "ti", "usted", "ustedes", "vosotros", "eres",
)
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NEAR = 5


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Words(WordHasher):
    """Words are runs of letters, digits, non-ASCII bytes, @ and $, hashed with A-Z lowered and LEET read as letters."""

    def __init__(self):
        super().__init__()
        for sign, letter in LEET.items():
            self.table[ord(sign)] = self.table[ord(letter)]
        for b in range(128):
            self.space[b] = not (chr(b).isalnum() or chr(b) in "@$")

    def one(self, word: str) -> int:
        return int(self._chunk([word.encode()])[0][0])


def _in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def _spread(owner: np.ndarray, n: int, mask: np.ndarray) -> np.ndarray:
    return np.bincount(owner[mask], minlength=n).astype(float)


def _prefixes(texts: list[bytes], starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, words: Words) -> np.ndarray:
    """The hash of each word's first PREFIX bytes, 0 for words that are no longer than these."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[owner] + starts
    out = np.full(len(starts), 0x1F3D5B79, np.uint64)
    long = ends - starts > PREFIX
    for j in range(PREFIX):
        out[long] = (out[long] ^ words.table[joined[base[long] + j]]) * np.uint64(0x9FB21C651E98DF25)
    out[~long] = 0
    return out


def scan(texts: list[bytes], words: Words):
    """For blocks of texts: (index of the first, number, word hashes, prefix hashes, text of each word)."""
    for first, hashes, starts, ends, owner, n in words(texts):
        yield first, n, hashes, _prefixes(texts[first : first + n], starts, ends, owner, words), starts, ends, owner


def features(texts: list[bytes], words: Words, insults: np.ndarray, second: np.ndarray, learned: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """One row of dense features for each text, from the text alone."""
    rows = []
    for first, n, h, p, starts, ends, owner in scan(texts, words):
        block = texts[first : first + n]
        size = np.array([max(1, len(t)) for t in block], float)
        joined = np.frombuffer(b"".join(block), np.uint8)
        of_byte = np.repeat(np.arange(n), [len(t) for t in block])
        kind = np.zeros(256, np.int8)
        kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
        kind[[ord("!"), ord("?")]] = 5
        kind[[ord(c) for c in "*#@$%&_~^+=<>|"]] = 6
        kind[[ord(c) for c in ".,;:'\"-()"]] = 7
        kinds = np.bincount(of_byte * 8 + kind[joined], minlength=8 * n).reshape(n, 8).astype(float)
        count = np.maximum(1, np.bincount(owner, minlength=n)).astype(float)
        fixed, you, lex, stem = _in(insults, h), _in(second, h), _in(learned, h), _in(stems, p) & (p != 0)
        bad = fixed | lex | stem
        near = np.zeros(len(h), bool)
        for d in range(1, NEAR + 1):
            same = owner[d:] == owner[:-d]
            near[d:] |= you[:-d] & same
            near[:-d] |= you[d:] & same
        base = np.concatenate(([0], np.cumsum([len(t) for t in block])))[owner] + starts
        digit = np.concatenate(([0], np.cumsum((kind[joined] == 3) | (joined == 64) | (joined == 36))))
        letter = np.concatenate(([0], np.cumsum((kind[joined] == 1) | (kind[joined] == 2) | (kind[joined] == 4))))
        stop = base + ends - starts
        mixed = (digit[stop] > digit[base]) & (letter[stop] > letter[base])
        single = ends - starts == 1
        hits = [_spread(owner, n, m) for m in (fixed, lex, stem, bad)]
        rows.append(np.column_stack([
            np.log1p(count), *hits, *(x / count for x in hits), _spread(owner, n, you) / count, _spread(owner, n, bad & near), _spread(owner, n, bad & near) / count,
            kinds[:, 1] / np.maximum(1, kinds[:, 1] + kinds[:, 2]), kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size, kinds[:, 3] / size, kinds[:, 4] / size,
            _spread(owner, n, mixed) / count, _spread(owner, n, mixed & bad), _spread(owner, n, single) / count,
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, 21))


class Trees:
    """Logistic gradient boosting with shallow trees over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.edges = [np.unique(np.concatenate((e, c[c > 0][:1] * 0 + 1e-12))) for e, c in zip(self.edges, x.T)]
        b, n_bins = self._bin(x), bins + 2
        rate_of = (y.sum() + 0.5) / (len(y) + 1)
        self.depth, self.start = depth, float(np.log(rate_of / (1 - rate_of)))
        score, self.trees = np.full(len(y), self.start), []
        columns = np.arange(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                width = 2**level
                sums = np.zeros((2, width, len(columns), n_bins))
                for k, w in enumerate((g, hess)):
                    for c in columns:
                        sums[k, :, c] = np.bincount(leaf * n_bins + b[:, c], weights=w, minlength=width * n_bins).reshape(width, n_bins)
                left = sums.cumsum(axis=3)[..., :-1]
                total = sums.sum(axis=3)[..., None]
                right = total - left
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
                gain[(left[1] < 0.5) | (right[1] < 0.5)] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                feature, cut = best // (n_bins - 1), best % (n_bins - 1)
                splits.append((feature, cut))
                leaf = 2 * leaf + (b[np.arange(len(y)), feature[leaf]] > cut[leaf])
            up = np.bincount(leaf, weights=g, minlength=2**depth)
            down = np.bincount(leaf, weights=hess, minlength=2**depth)
            value = rate * up / (down + ridge)
            score += value[leaf]
            self.trees.append((splits, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, score, rows = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                leaf = 2 * leaf + (b[rows, feature[leaf]] > cut[leaf])
            score += value[leaf]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and their non-decreasing rates, a prior of half a row at each pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order], y[order]):
        pools.append([t, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2], high]
    mean = y.mean()
    knots = np.array([k for t, n, low, high in pools for k in (low, high)])
    rates = np.array([r for t, n, _, _ in pools for r in [(t + 0.5 * mean) / (n + 0.5)] * 2])
    return knots, np.maximum.accumulate(rates)


class Model:
    """A fitted scorer; small and of bounded size, it travels inside the tasks."""

    def __init__(self, train: DataFrame):
        words = Words()
        self.insults = np.unique(np.array([words.one(w) for w in INSULTS], np.uint64))
        self.second = np.unique(np.array([words.one(w) for w in SECOND_PERSON], np.uint64))
        lexicons = _lexicons(train)
        self.learned, self.stems = lexicons[FOLDS]
        insults, second = self.insults, self.second

        def measure(batches):
            words = Words()
            for batch in batches:
                fold = np.array(batch.column("fold").to_pylist(), np.int64)
                x = np.zeros((len(fold), 21))
                for k in range(FOLDS):
                    own = np.flatnonzero(fold == k)
                    for at in range(0, len(own), SLICE):
                        some = own[at : at + SLICE]
                        x[some] = features(_bytes(batch.column("text").take(pa.array(some))), words, insults, second, *lexicons[k])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "fold", "toxic", "x"])

        rows = train.mapInArrow(measure, "doc_id long, fold int, toxic int, x array<double>").orderBy("doc_id").toPandas()
        self.trees = None
        y = rows["toxic"].to_numpy(float)
        if len(y) and 0 < y.sum() < len(y):
            x, fold = np.stack(rows["x"].to_numpy()), rows["fold"].to_numpy()
            out = np.zeros(len(y))
            for k in range(FOLDS):
                rest = fold != k
                if rest.any() and (~rest).any():
                    out[~rest] = Trees(x[rest], y[rest])(x[~rest])
            self.trees, (self.knots, self.rates) = Trees(x, y), isotonic(out, y)
        else:
            self.flat = float(y.mean()) if len(y) else 0.0

    def __call__(self, texts: list[bytes], words: Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.flat)
        return np.interp(self.trees(features(texts, words, self.insults, self.second, self.learned, self.stems)), self.knots, self.rates)


def _lexicons(train: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and word beginnings that mark toxic rows: for each fold those learned without it, and last those of all folds.

    All that two toxic rows have at log odds over 1.5 are taken; the training rows, of bounded number, bound them.
    """

    def tally(batches):
        words, counts = Words(), {}
        for batch in slices(batches, SLICE):
            texts = _bytes(batch.column("text"))
            fold, toxic = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("fold", "toxic"))
            for first, n, h, p, _, _, owner in scan(texts, words):
                for kind, keys in ((0, h), (1, p)):
                    own = np.unique(np.column_stack((keys.view(np.int64), owner)), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
                    place = fold[first + own[:, 1]] * 2 + toxic[first + own[:, 1]]
                    keyed, many = np.unique(np.column_stack((own[:, 0], place)), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"kind": np.full(len(many), kind, np.int32), "key": keyed[:, 0], "fold": (keyed[:, 1] // 2).astype(np.int32), "toxic": (keyed[:, 1] % 2).astype(np.int32), "n": many.astype(np.int64)})

    rows = train.groupBy("fold", "toxic").count().collect()
    total = {(r["fold"], r["toxic"]): r["count"] for r in rows}
    seen = train.mapInArrow(tally, "kind int, key long, fold int, toxic int, n long")
    cells = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{k}{t}") for k in range(FOLDS) for t in (0, 1)]
    wide = seen.groupBy("kind", "key").agg(*cells).where(" + ".join(f"n{k}1" for k in range(FOLDS)) + " >= 2")
    marked = []
    for out in range(FOLDS + 1):
        inside = [k for k in range(FOLDS) if k != out]
        bad, good = (sum(total.get((k, t), 0) for k in inside) for t in (1, 0))
        hit = sum((F.col(f"n{k}1") for k in inside), F.lit(0))
        miss = sum((F.col(f"n{k}0") for k in inside), F.lit(0))
        odds = F.log((hit + 0.5) / (bad + 1.0)) - F.log((miss + 0.5) / (good + 1.0))
        marked.append(F.when((hit >= 2) & (odds > 1.5), odds).alias(f"w{out}"))
    weighed = wide.select("kind", "key", *marked).where(F.coalesce(*(f"w{k}" for k in range(FOLDS + 1))).isNotNull())
    top = weighed.toPandas()
    pick = lambda kind, out: np.sort(top.loc[(top["kind"] == kind) & top[f"w{out}"].notna(), "key"].to_numpy(np.int64).view(np.uint64))
    return [(pick(0, out), pick(1, out)) for out in range(FOLDS + 1)]


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic, fold) of labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    Of more than max_train such labels those of least digest are used; this bounded table is
    broadcast to the scan of the texts. Contradicting labels of a doc_id count as toxic; of rows that
    repeat a doc_id the least text is learned from, so there are no more rows than labels.
    """
    name = F.col("doc_id").cast("string")
    use = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(name) % 4 != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    use = use.orderBy(F.md5(name), "doc_id").limit(max_train).withColumn("fold", (F.crc32(F.concat(F.lit("fold:"), name)) % FOLDS).cast("int"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(use), "doc_id")
    return found.groupBy("doc_id", "toxic", "fold").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(materialise(training_rows(docs, labels)))


def score(model: Model, text_col: str = "text") -> F.Column:
    """The score, 0 to 1, of each row's whole text; a null text counts as empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        words = Words()
        # Some texts at a time: a batch of long ones is large already, and their features are larger.
        parts = [model(_bytes(texts.slice(at, SLICE)), words) for at in range(0, len(texts), SLICE)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return scored(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = CUT) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold), from the whole text of each row.

    A null text counts as empty and is scored like it. Rows that repeat are scored alike; an empty
    table gives no rows; all columns of docs are kept, but for older ones named score or predicted.
    Without labels of both kinds every score is the share of toxic labels (0 without labels).
    """
    out = docs.drop("score", "predicted").withColumn("score", score(model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
