from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder))
        seen.append(docs)
    return seen


def test_all_but_the_last_return_documents(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_stages_drop_what_they_should(stages):
    before, calm, exact, near, mixed, packed = stages
    assert calm.count() > 0.85 * before.count()
    texts = [r["text"] or "" for r in exact.select("text").collect()]
    lower = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in texts]
    assert len(set(lower)) == len(lower)
    left = {r["text"] for r in calm.select("text").collect()}
    assert {t.lower() for t in left if t} == {t.lower() for t in texts if t}
    sets = {}
    for r in near.select("doc_id", "text").collect():
        w = r["text"].split()
        sets[r["doc_id"]] = {tuple(x.lower() for x in w[j : j + 5]) for j in range(len(w) - 4)}
    index: dict = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in index[g] if j > i}:
            assert len(s & sets[j]) < 0.8 * len(s | sets[j])
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} <= set(sets)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_an_empty_table_passes(spark, data_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


HARD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, times int, id long, row string, digest string, kept string, many long"


def hard_rows() -> list[tuple]:
    """Repeated rows, ids with several texts, null ids and texts, ties, a very long text, columns that the stages use themselves."""
    texts = [(5, "Same text here"), (5, "same text here"), (5, "Same text here"), (2, "same text HERE"), (7, None), (8, ""), (9, " \t"), (None, "same text here"), (None, "alone"), (None, "alone")]
    texts += [(20, "first of two texts"), (20, "other text of that id"), (21, "first of two TEXTS"), (30, "word " * 150_000), (31, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3), (32, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "w1")]
    return [(i, t, "en", (None, "a", "b")[k % 3], k, 7.5, 9, 3, 1, "r", "d", "k", 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def hard(spark, data_dir):
    return spark.createDataFrame(hard_rows(), HARD).repartition(4)


def test_hard_rows_at_each_stage(spark, hard, data_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, hard, data_dir)
        assert got.columns == hard.columns, name
        assert stage(spark, hard.limit(0), data_dir).count() == 0, name
        for r in got.collect():
            assert (r.score, r.predicted, r.times, r.id, r.row, r.digest, r.kept, r.many) == (7.5, 9, 3, 1, "r", "d", "k", 2), name
    packed = corpus_pipeline.pack(spark, hard, data_dir)
    assert packed.where("piece = 0").count() == len(hard_rows())


def test_copies_leave_one_row_of_each_text(spark, hard, data_dir):
    got = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.drop_copies(spark, hard, data_dir).collect()]
    want = {}
    for i, t, *_ in hard_rows():
        t = (t or "").lower()
        want[t] = max(want.get(t, (False, 0)), (i is not None, i or 0))
    assert Counter(t for _, t in got) == Counter(want.keys())
    assert {(i, t) for i, t in got} == {(i if known else None, t) for t, (known, i) in want.items()}


def test_toxicity_keeps_what_the_model_does(spark, stages, data_dir):
    from rasterloom.llm import toxicity
    from rasterloom.llm.registry import QUERIES

    folder = data_dir.replace("sf0.001", "sf0.01")
    kept = {r.doc_id for r in QUERIES["op7_toxicity"](spark, folder).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == kept
    assert toxicity.CUT == 0.3


def test_mixing_against_plain_water_filling(stages):
    near, mixed = stages[3].select("doc_id", "text", "source").collect(), stages[4].groupBy("doc_id").count().collect()
    sizes, by = {}, {}
    for r in near:
        sizes[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        by.setdefault(r.source, []).append(r.doc_id)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(sizes[i] for i in by[s]) for s in by}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * total[s]}
        if not above:
            break
        target |= {s: 2 * total[s] for s in above}
        left -= sum(2 * total[s] for s in above)
        free -= above
    target |= {s: level * weight[s] for s in free}
    times = {r.doc_id: r["count"] for r in mixed}
    for s in order:
        assert abs(sum(sizes[i] * times.get(i, 0) for i in by[s]) - target[s]) <= max(sizes[i] for i in by[s])
        assert all(times.get(i, 0) <= 2 or sizes[i] == 0 for i in by[s])


def test_packing_holds_all_ids_of_the_mixed_documents(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, packed = stages[4].select("doc_id", "text").collect(), stages[5].toPandas()
    want = Counter()
    for r in docs:
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packed.groupby("doc_id")["length"].sum().to_dict() == dict(want)
    placed = packed.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packed["sequence_id"].nunique() <= 1.01 * sum(want.values()) / 1024 + 2


def test_the_whole_pipeline_deletes_what_it_wrote_on_the_way(spark, data_dir):
    from rasterloom.scratch import written

    before = written(spark)
    out = corpus_pipeline.run(spark, data_dir)
    assert len(set(written(spark)) - set(before)) == 1 and out.count() == out.where(F.col("length") > 0).count() > 0
