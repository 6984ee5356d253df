"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .kernels import WordHasher, fmix

#: Words of a window whose least gear value is a cut, bits that the gear shifts at each word.
WINDOW, SHIFT = 16, 22
#: Least words of whole repeated chunks, numbers of words beside them that are compared too, and least words of a repeat with these.
LEAST, BESIDE, REPEAT = 16, (5, 10, 15), 43
#: Places of a chunk as high and low halves of a long; a text has under 2^31 bytes.
PLACES = (("word", "words"), ("byte", "bytes"), *((f"l{k}", f"r{k}") for k in BESIDE))


def chunk_bounds(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the chunks of texts whose words stand one after the other.

    The gear value of a word is the last one shifted by SHIFT bits plus the word's hash, so it depends
    on the last three words only. A chunk starts at the least value of each window of WINDOW
    words: no chunk inside a text is longer than that, and an insertion moves cuts only near it.
    """
    n = len(hashes)
    starts = np.cumsum(counts) - counts
    gear = hashes.copy()
    for back in (1, 2):
        if n > back:
            same = owner[back:] == owner[:-back]
            gear[back:] += np.where(same, hashes[:-back] << np.uint64(back * SHIFT), np.uint64(0))
    gear = fmix(gear)
    cuts = [starts[counts > 0]]
    if n >= WINDOW:
        whole = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
        least = np.lib.stride_tricks.sliding_window_view(gear, WINDOW)
        for at in range(0, len(whole), 1 << 16):
            low = least[at : at + (1 << 16)].argmin(axis=1) + np.arange(at, min(at + (1 << 16), len(whole)))
            cuts.append(np.unique(low[whole[at : at + (1 << 16)]]))
    first = np.unique(np.concatenate(cuts)).astype(np.int64)
    return first, np.concatenate((first[1:], [n])).astype(np.int64)


def chunks(docs: DataFrame, places: bool) -> DataFrame:
    """The chunks of every whole text of docs (doc_id, text): (doc_id, a, b), a and b the 128-bit digest.

    With places also body (digest of all words of the text), word and words (first word and
    number of words), byte and bytes (the same in the UTF-8 text), and l5, r5, ... (32-bit digests of as many words
    before and after the chunk, 0 where the text has fewer).
    """
    return _unpacked(_packed(docs, True)) if places else _packed(docs, False)


def _packed(docs: DataFrame, places: bool) -> DataFrame:
    """chunks, the places two by two in longs (see PLACES), which shuffle in fewer bytes than columns of their own."""

    def cut(batches):
        hasher = WordHasher()
        bases = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = batch.column("doc_id")
            for first_text, h, starts, ends, owner, n_texts in hasher(texts):
                if not len(h):
                    continue
                counts = np.bincount(owner, minlength=n_texts)
                first, end = chunk_bounds(h, owner, counts)
                digests = []
                for base in bases:
                    power, inverse = (np.full(len(h) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
                    power[0] = inverse[0] = 1
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fmix(h ^ np.uint64(base)) * np.cumprod(power, dtype=np.uint64)[:-1], dtype=np.uint64)))
                    inverse = np.cumprod(inverse, dtype=np.uint64)
                    digests.append(fmix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)).view(np.int64))
                    of_text = np.cumsum(counts) - counts
                    body = fmix((sums[of_text + counts] - sums[of_text]) * inverse[of_text] + counts.astype(np.uint64)).view(np.int64)
                digest = lambda a, b: (fmix((sums[b] - sums[a]) * inverse[a]) >> np.uint64(32)).astype(np.uint32).view(np.int32)  # noqa: B023, E731
                text = owner[first]
                columns = {"doc_id": ids.take(pa.array(first_text + text)), "a": digests[0], "b": digests[1]}
                if places:
                    columns |= {"body": body[text], "word": first - of_text[text], "words": end - first, "byte": starts[first], "bytes": ends[end - 1] - starts[first]}
                    low, high = of_text[text], of_text[text] + counts[text]
                    for k in BESIDE:
                        columns[f"l{k}"] = np.where(first - k >= low, digest(np.maximum(first - k, 0), first), 0)
                        columns[f"r{k}"] = np.where(end + k <= high, digest(end, np.minimum(end + k, len(h))), 0)
                    pair = lambda high, low: (columns[high].astype(np.int64) << 32) | (columns[low].astype(np.int64) & 0xFFFFFFFF)  # noqa: B023, E731
                    columns = {c: columns[c] for c in ("doc_id", "a", "b", "body")} | {f"{h}_{w}": pair(h, w) for h, w in PLACES}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(cut, "doc_id long, a long, b long" + (", body long, " + ", ".join(f"{h}_{w} long" for h, w in PLACES) if places else ""))


def _unpacked(packed: DataFrame) -> DataFrame:
    """chunks with places, each place in a column of its own."""
    half = lambda c, high: F.shiftright(c if high else F.shiftleft(c, 32), 32)
    kind = lambda c: "long" if c in ("byte", "bytes") else "int"
    places = {c: half(f"{h}_{w}", c == h).cast(kind(c)) for h, w in PLACES for c in (h, w)}
    return packed.withColumns(places).drop(*(f"{h}_{w}" for h, w in PLACES))


def _long_enough(spans: DataFrame, found: DataFrame, repeat: int) -> DataFrame:
    """Spans whose whole chunks, with the words beside them that another document has there too, are at least so many words.

    Only the chunks of shorter spans are looked up, by map-side combined counts of documents; their tables are written
    first, so that small ones are known to be small and the chunks need no further shuffle. Each of a span's chunks may
    tell how far the run reaches: one at its end may be a chance match of few words.
    """
    span = ["doc_id", "body", "first_word"]
    weak = materialise(spans.where(F.col("n_words") < repeat).select(*span, "n_words"))
    beside = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), F.col(f"{side}{k}").alias("digest")) for side in "lr" for k in BESIDE])).alias("n")
    inside = found.join(weak, ["doc_id", "body"]).where("word >= first_word and word < first_word + n_words")
    asked = materialise(inside.select(*span, "word", "words", "a", "b", beside).select(*span, "word", "words", "a", "b", "n.*").where("digest <> 0").distinct())
    ends = materialise(asked.select("a", "b").distinct())
    seen = found.join(ends, ["a", "b"], "left_semi").select("doc_id", "a", "b", beside).select("doc_id", "a", "b", "n.*").where("digest <> 0")
    key = ["a", "b", "side", "k", "digest"]
    both = materialise(seen.groupBy(*key).agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).where("one <> other").select(*key))
    low, high = F.min(F.when(F.col("side") == "l", F.col("word") - F.col("k"))), F.max(F.when(F.col("side") == "r", F.col("word") + F.col("words") + F.col("k")))
    reach = asked.join(both, key).groupBy(*span).agg(low.alias("low"), high.alias("high"))
    end = F.col("first_word") + F.col("n_words")
    whole = F.greatest(end, F.coalesce("high", end)) - F.least(F.col("first_word"), F.coalesce("low", "first_word"))
    return spans.join(reach, span, "left").where(whole >= repeat).drop("low", "high")


def repeated_spans(docs: DataFrame, *, least_words: int = LEAST, repeat: int = REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word spans of documents that other documents have too: a row for each span.

    (doc_id, body, first_word, n_words, first_byte, n_bytes, first_doc_id, kept, cuts): body tells apart
    different texts of one doc_id; byte places are those of the UTF-8 text; first_doc_id is
    the least document with one of the span's chunks; kept, whether all of its chunks are here
    first; cuts, the (first_byte, n_bytes) of its runs of chunks that another document has first,
    which may be shorter than least_words. What is in no cut stays, so each chunk stays in its first document. Words are compared with A-Z lowered and white space ignored. Neighbouring repeated chunks
    are joined; spans under least_words are dropped, and those that with 5, 10 or 15 repeated words beside each end
    have fewer than repeat. A shared passage of at least 2 * WINDOW + 3 words contains a whole chunk; one of
    over 50 words at least LEAST words of them, and counts at least 43 (four words at each end may not count), so
    all such passages are found; a shared run of fewer than 43 words is not.

    First the digests that at least two doc_ids have are found: counts combine before the shuffle,
    so a very common passage costs a row of each task. Then the chunks are cut again, now with their
    places, and meet those digests in a sort-merge join whose hot keys AQE splits. Texts are never
    shuffled. Null, empty and blank texts have no chunks; rows with a null doc_id are left out; rows
    that repeat count once; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    shared = materialise(chunks(rows, False).groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("a", "b", "first"))
    found = materialise(_unpacked(_packed(rows, True).join(shared.hint("merge"), ["a", "b"])))
    order = Window.partitionBy("doc_id", "body").orderBy("word")
    once = found.dropDuplicates(["doc_id", "body", "word"])
    gap = F.coalesce(F.lag(F.col("word") + F.col("words")).over(order) != F.col("word"), F.lit(True)).cast("int")
    own = F.col("first") == F.col("doc_id")
    turn = F.greatest(gap, (own != F.lag(own).over(order)).cast("int"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    spans = once.withColumn("gap", gap).withColumn("turn", turn).withColumn("span", F.sum("gap").over(running)).withColumn("run", F.sum("turn").over(running))
    runs = spans.groupBy("doc_id", "body", "span", "run").agg(
        F.min("word").alias("word"), F.sum("words").alias("words"), F.min("byte").alias("byte"), F.max(F.col("byte") + F.col("bytes")).alias("end"),
        F.min("first").alias("first"), F.bool_and(own).alias("own"),
    )
    place = F.struct(F.col("byte").alias("first_byte"), (F.col("end") - F.col("byte")).alias("n_bytes"))
    joined = materialise(
        runs.groupBy("doc_id", "body", "span")
        .agg(
            F.min("word").cast("long").alias("first_word"), F.sum("words").alias("n_words"), F.min("byte").alias("first_byte"), (F.max("end") - F.min("byte")).alias("n_bytes"),
            F.min("first").alias("first_doc_id"), F.bool_and("own").alias("kept"), F.array_sort(F.collect_list(F.when(~F.col("own"), place))).alias("cuts"),
        )
        .where(F.col("n_words") >= least_words)
        .drop("span")
    )
    return _long_enough(joined, found, repeat)


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (with doc_id and text) without the bytes of the spans' cuts; every row stays, with its other columns."""
    gone = spans.select("doc_id", F.explode("cuts").alias("cut")).groupBy("doc_id").agg(F.collect_set("cut").alias("_gone"))

    @F.udf("string", useArrow=True)
    def without(text, gone):
        data, out, at = (text or "").encode(), [], 0
        for start, size in sorted((g[0], g[1]) for g in gone or ()):
            out.append(data[at:start])
            at = max(at, start + size)
        return b"".join([*out, data[at:]]).decode() if gone else text

    return docs.join(gone, "doc_id", "left").withColumn("text", without("text", "_gone")).drop("_gone").select(docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
