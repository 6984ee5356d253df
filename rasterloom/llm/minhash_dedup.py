"""Near-duplicate documents by an inverted join on signature coordinates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, slices, table
from .kernels import WordHasher, coordinate_keys, shingle_sets, signature

#: A pair at similarity 0.8 shares 25.6 of 32 coordinates on average, fewer than 14 once in a million pairs.
COORDINATES, MATCHES = 32, 14
#: Columns of 64 bits each that sketch a document's shared differences.
BITS = ("b0", "b1", "b2", "b3")
#: How often a document passes on to its anchor's own anchor.
JUMPS = 2
#: By how much the leaders of a list grow from round to round.
LEADERS = 256


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): size, digest and signature of each row's shingle set."""

    def sketch(batches):
        hasher, (mult, mask) = WordHasher(), coordinate_keys(coordinates)
        for batch in slices(batches):
            n, a, b, sigs = [], [], [], []
            for s in shingle_sets(hasher, _texts(batch), shingle):
                n.append(len(s))
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                b.append(int(np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))).view(np.int64)) if len(s) else 0)
                sigs.append(signature(s, mult, mask))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            offsets = pa.array(np.arange(0, (len(sigs) + 1) * coordinates, coordinates, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, shingles): the whole shingle set of each row of docs (doc_id, text), as 64-bit hashes."""

    def sets(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            found = list(shingle_sets(hasher, _texts(batch), shingle))
            ids, at = batch.column("doc_id"), 0
            while at < len(found):
                end, size = at, 0
                while end < len(found) and (end == at or size + len(found[end]) < 1 << 19):
                    size += len(found[end])
                    end += 1
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in found[at:end]]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found[at:end]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), lists], names=["rep", "shingles"])
                at = end

    return docs.mapInArrow(sets, "rep long, shingles array<long>")


def prefix_postings(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """The postings (key, rep, fame) that any pair with at least `matches` equal coordinates must meet in.

    Each document orders its coordinate-value pairs from rare to frequent lists (ties by coordinate)
    and posts the first coordinates - matches + 1; the rest, the long lists, are skipped. Lists
    of one document give nothing, and they come first in that order, so that a document with s
    shared lists posts s - matches + 1 of them and one with fewer than `matches` drops out. key is a
    hash of coordinate and value; fame, the length of all of its lists, is largest for the
    document that a family of copies comes from.
    """
    postings = reps.select("rep", F.posexplode("sig").alias("coord", "value")).select("rep", F.xxhash64("coord", "value").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(lists, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"), F.sum("df").alias("fame"))
    shared = shared.where(F.size("p") >= matches).select("rep", "fame", F.explode(F.slice("p", 1, F.size("p") - matches + 1)).alias("p"))
    return shared.select("p.key", "rep", "fame")


def _equal(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have percent of their union in common."""
    near = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    return near.where(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def _join_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (rep, comp) after new links (a, b): components of the graph of the components that the links connect."""
    ends = parts.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), parts.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    moved = materialise(components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    renamed = parts.join(moved.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))
    return materialise(renamed)


def _meet(asked: DataFrame, posted: DataFrame, key: list[str], near: F.Column, confirm: Callable, parts: DataFrame) -> DataFrame:
    """parts joined by all confirmed pairs of rows that meet in a list and are near, without making the pairs inside a component.

    asked, posted: (key, rep, company, ...), the rows of a list that look for partners and those that
    are looked for; near: a condition on x of asked and y of posted, symmetric where both are in both.
    In round 0 each list's posted row of most company leads, in round r its next LEADERS ** r or so,
    drawn by hash. Rows of a list meet its leaders of other components only; pairs are confirmed and components
    joined. A row whose list holds nothing but its own component drops out of the list, but a linked row
    goes on meeting others. The rounds end when every posted row has led, so no pair between two components is left out.
    """
    lists = materialise(posted.groupBy(*key).agg(F.count("*").alias("many"), F.max(F.struct("company", (-F.col("rep")).alias("rep"))).alias("top")))
    draw = (F.xxhash64("rep", *key).bitwiseAND((1 << 52) - 1) / float(1 << 52)) * F.col("many")
    level = F.when(-F.col("top").getField("rep") == F.col("rep"), 0).otherwise(1 + F.floor(F.log(float(LEADERS), F.greatest(draw, F.lit(1.0))))).cast("int")
    asked, posted = (materialise(t.join(lists, key).withColumn("level", level).drop("many", "top", "company")) for t in (asked, posted))
    last = posted.agg(F.max("level")).first()[0]
    for turn in range(0 if last is None else last + 1):
        y = materialise(posted.where(F.col("level") >= turn).join(parts, "rep"))
        held = materialise(y.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high")))
        waits = materialise(asked.join(parts, "rep").join(held, key).where("low <> high or comp <> low").drop("low", "high"))
        if waits.isEmpty():
            break
        leads = y.where(F.col("level") == turn)
        both = near & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.rep") != F.col("y.rep"))
        for k in key:
            both = both & (F.col(f"x.{k}") == F.col(f"y.{k}"))
        met = waits.alias("x").join(leads.hint("merge").alias("y"), both).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        met = materialise(met)
        links = met if met.isEmpty() else materialise(confirm(met))
        if not links.isEmpty():
            parts = _join_parts(parts, links)
    return parts


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| over their word shingles.

    Returns a row for each row of docs: (doc_id, n_shingles, component_id, kept). Rows of equal
    shingle sets first collapse to one, that of the least doc_id. The rest post their rare
    coordinates (prefix_postings). Lists of a large family of copies would make all of its pairs, so
    each document takes as its anchor the one with most company that it meets. Documents of one
    anchor are linked by their differences from it (_family_links), exactly; those of different
    anchors from `matches` equal coordinates on, confirmed on full sets. In both, the documents of a list
    meet its leaders in rounds (_meet), and pairs inside one component are never made. Lost links: a
    pair of different anchors at exactly 0.8 has fewer than 14 of 32 equal coordinates with
    probability 1e-6, a pair at 0.85 with 1e-8; a component loses nothing if other links hold it.

    A text with fewer words than a shingle has its whole sequence as its one shingle; a null,
    empty or blank text has none and is linked with nothing. Rows with a null doc_id are linked with
    nothing either (component_id null, kept). Rows that repeat a doc_id count as one document whose
    links are those of any of them. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(sketches(texts, shingle, coordinates))
    key = ["set_a", "set_b", "n_shingles"]
    reps = materialise(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"))
    )
    shared = materialise(prefix_postings(reps, coordinates, matches))
    active = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(full_sets(texts.join(active.hint("merge"), "doc_id", "left_semi"), shingle))
    anchors = _anchors(shared)
    parts = _other_links(shared, anchors, reps, sets, matches, percent, _family_links(anchors, sets, percent))
    groups = reps.join(parts, "rep", "left").select(*key, F.coalesce("comp", "rep").alias("component"), "rep", "copies").where("copies > 1 or component <> rep").drop("rep", "copies")
    groups = materialise(groups)  # both sides of the last join are then plain shuffles, whose hot keys AQE splits
    out = rows.select("doc_id", *key).join(groups, key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _anchors(shared: DataFrame) -> DataFrame:
    """(rep, anchor): the document with most company among those that rep meets in its lists, then that one's anchor in turn."""
    tops = shared.groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("rep"))).alias("top"))
    own = materialise(shared.join(tops, "key").groupBy("rep").agg((-F.max("top").getField("rep")).alias("anchor")))
    out = own
    for _ in range(JUMPS):
        out = out.join(own.select(F.col("rep").alias("anchor"), F.col("anchor").alias("next")), "anchor").select("rep", F.col("next").alias("anchor"))
    return materialise(out)


def _family_links(anchors: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, comp): components of the links of documents with their anchor and of all links between documents of one anchor.

    A document is told by its delta d, the symmetric difference from its anchor h. With s = |x| + |y| and
    p the percentage, x and y are linked when (100 + p) |x ^ y| <= (100 - p) s, and |x ^ y| = |dx| + |dy| - 2 |dx & dy|.
    Documents near h (linked with it) need no pairs among themselves. If x is not near h, then any y
    linked with x shares more than p / (100 + p) of dy with dx, so y must have one of dx among the
    rarest |dy| - floor(p |dy| / (100 + p)) elements of dy. If y is not near h either, the same holds for x.
    Only these prefixes meet, by anchor and element (_meet), and the join tests the inequality with an upper
    bound of |dx & dy| from bit sketches; the pairs left are few more than the links, and are
    confirmed by the elements of their deltas that another document of the family has too.
    """
    x = anchors.join(sets, "rep").withColumnRenamed("shingles", "xs")
    h = sets.select(F.col("rep").alias("anchor"), F.col("shingles").alias("hs"))
    delta = materialise(
        x.join(h, "anchor").select("anchor", "rep", F.size("xs").alias("n"), F.size("hs").alias("nh"), F.concat(F.array_except("xs", "hs"), F.array_except("hs", "xs")).alias("d"))
    ).where(F.size("d") > 0).withColumn("near", (100 + percent) * F.size("d") <= (100 - percent) * (F.col("n") + F.col("nh")))
    direct = components(delta.where("near").select(F.col("rep").alias("a"), F.col("anchor").alias("b")))
    parts = materialise(anchors.join(direct.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp")))
    items = delta.select("anchor", "rep", F.explode("d").alias("e"))
    often = items.groupBy("anchor", "e").agg(F.count("*").alias("df")).where("df > 1")
    common = items.join(often, ["anchor", "e"]).groupBy("anchor", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("c"), F.sum("df").alias("company"))
    rows = delta.join(common, ["anchor", "rep"]).select("anchor", "rep", "n", "nh", "near", "company", F.size("d").alias("size"), F.transform("c", lambda c: c.e).alias("c"))
    # A document this far from h has no link with one near h, whose size is at most 100 / p of either.
    reach = (100 + percent) * F.col("size") <= (100 - percent) * (F.col("n") + F.col("nh") + F.lit(200.0 / percent) * F.least("n", "nh"))
    bits = {b: F.expr(f"aggregate(filter(c, e -> (e & {len(BITS) - 1}) = {i}), 0L, (s, e) -> s | shiftleft(1L, cast(shiftright(e, 3) & 63 as int)))") for i, b in enumerate(BITS)}
    # Elements of one document come first in the order from rare to frequent and meet nothing.
    head = F.col("size") - F.floor(percent * F.col("size") / (100 + percent)) - (F.col("size") - F.size("c"))
    rows = materialise(rows.withColumns(bits | {"reach": reach, "head": F.greatest(F.lit(0), F.least(head, F.size("c"))).cast("int")}))
    thin = ["anchor", "rep", "n", "size", "near", "head", "company", F.size("c").alias("nc"), *BITS]
    posted = rows.where("head > 0").select(*thin, F.explode(F.slice("c", F.lit(1), F.col("head"))).alias("e"))
    asks = F.when(F.col("reach"), F.size("c")).otherwise(F.col("head"))
    asked = rows.where(~F.col("near") & (asks > 0)).select(*thin, F.posexplode(F.slice("c", F.lit(1), asks)).alias("place", "e"))
    s, gap = F.col("x.n") + F.col("y.n"), F.col("x.size") + F.col("y.size")
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}.{b}").bitwiseAND(F.bitwise_not(f"{q}.{b}"))) for b in BITS), F.lit(0))
    most = F.least(F.col("x.nc") - only("x", "y"), F.col("y.nc") - only("y", "x"))
    # Of two that are both far, the one that leads first meets the other.
    later = F.struct("x.level", "x.rep") > F.struct("y.level", "y.rep")
    near = (
        (F.col("y.near") | later & (F.col("x.place") < F.col("x.head")))
        & ((100 + percent) * F.abs(F.col("x.size") - F.col("y.size")) <= (100 - percent) * s)
        & ((100 + percent) * (gap - 2 * most) <= (100 - percent) * s)
    )
    deltas = rows.select("rep", "n", "size", "c")

    def confirm(pairs: DataFrame) -> DataFrame:
        ends = (deltas.select(F.col("rep").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in ("n", "size", "c"))) for i in "ab")
        both = pairs.join(next(ends), "a").join(next(ends), "b")
        apart = F.col("a_size") + F.col("b_size") - 2 * F.size(F.array_intersect("a_c", "b_c"))
        return both.where((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b")

    return _meet(asked, posted, ["anchor", "e"], near, confirm, parts)


def _other_links(shared: DataFrame, anchors: DataFrame, reps: DataFrame, sets: DataFrame, matches: int, percent: int, parts: DataFrame) -> DataFrame:
    """parts joined by the links of documents of different anchors that meet in a list, similar enough in size and signature.

    A pair is made in one list only, the least key that both have; the join drops the rest itself.
    """
    placed = shared.join(anchors, "rep")
    mixed = placed.groupBy("key").agg(F.min("anchor").alias("low"), F.max("anchor").alias("high")).where("low <> high").select("key")
    keys = placed.join(mixed, "key").groupBy("rep", "anchor").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.max("fame").alias("company"))
    full = materialise(keys.join(reps.select("rep", "n_shingles", "sig"), "rep"))
    rows = full.select("*", F.explode("keys").alias("key"))
    near = (
        (F.struct("x.level", "x.rep") > F.struct("y.level", "y.rep")) & (F.col("x.anchor") != F.col("y.anchor"))
        & (100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
        & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")) & (_equal("x.sig", "y.sig") >= matches)
    )
    return _meet(rows, rows, ["key"], near, lambda pairs: _linked(pairs, sets, percent), parts)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * both_have >= 80 * (na.n + nb.n - both_have)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
