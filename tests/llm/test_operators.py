from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ann_search, chat_format, exact_dedup, html_extract, licence_scan, minhash_dedup, mixing, packing, substring_dedup, toxicity
from rasterloom.llm.registry import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, shingles string, score string, kept string"


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("ka", "lo", "mi", "tu", "re", "so", "ny", "be")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def hard_texts() -> list[tuple]:
    """Nulls, blanks, exact and near copies, a family of near copies, repeated rows, a very long text, non-ASCII."""
    rng = random.Random(3)
    base, long = prose(rng, 90), " ".join(prose(rng, 60_000))
    texts = [None, "", " \t\n", "one two", "ONE TWO", "one two three", "É é ß ☃ 𝄞 ﬁ", "É É ß ☃ 𝄞 ﬁ", long, long + " end"]
    for k in range(40):
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = " ".join(prose(rng, 55))
    texts += [" ".join(prose(rng, 80)) + " " + passage + " " + " ".join(prose(rng, 80)) for _ in range(3)]
    texts += [" ".join(prose(rng, rng.randint(3, 200))) for _ in range(60)]
    return [(i, t, "en", ("a", "b", None, "hot", "hot", "hot")[i % 6], None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "x", "y", "z", "s", "k") for r in hard_texts()]
    return spark.createDataFrame(rows + rows[12:14], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, data_dir, same_rows, name):
    same_rows(QUERIES[name](spark, data_dir), ORACLES[name], data_dir)


@pytest.mark.parametrize("name", ["op3_mix_sources", "op8_licence_scan", "op10_exact_dedup"])
def test_hard_tables_give_the_rows_of_the_sql(spark, docs, empty, same_rows, tmp_path, name):
    for k, df in enumerate((docs, empty)):
        folder = f"{tmp_path}/{k}"
        df.write.parquet(f"{folder}/documents.parquet")
        same_rows(QUERIES[name](spark, folder), ORACLES[name], folder)


# 3: mixing


def test_mix_meets_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else "small" if i < 30 else "tiny" if i == 33 else "mid") for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {}
    sources = {r[0]: r[2] for r in rows}
    for r in out.collect():
        taken, target, size = by.get(sources[r.doc_id], (0, r.target, r.source_size))
        by[sources[r.doc_id]] = (taken + r.taken, target, size)
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken - target) <= 0.5 and target <= 2 * size for taken, target, size in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for *_, s in by.values()))


# 4: near duplicates


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_against_brute_force(spark, docs, empty, shingle):
    sets = {}
    for i, t, *_ in hard_texts():
        w = words(t)
        sets[i] = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = minhash_dedup.near_duplicates(docs, shingle=shingle).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert minhash_dedup.near_duplicates(empty).collect() == []


def test_a_large_family_of_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    base, rows, sets = prose(rng, 120), [], {}
    for i in range(160):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 7, 8, 12))):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
        sets[i] = {tuple(copy[j : j + 4]) for j in range(117)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values())) < 160


def test_a_family_linked_among_itself_makes_few_pairs(spark, monkeypatch):
    """Copies of a text that is not there itself: nearly all pairs are links, but few are made."""
    rng, made, plain = random.Random(12), [], minhash_dedup._meet
    base, rows, sets = prose(rng, 150), [], {}
    for i in range(700):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5))):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        sets[i] = {hash(tuple(copy[j : j + 4])) for j in range(147)}

    def counted(asked, posted, key, near, confirm, parts):
        def confirmed(pairs):
            made.append(pairs.count())
            return confirm(pairs)

        return plain(asked, posted, key, near, confirmed, parts)

    monkeypatch.setattr(minhash_dedup, "_meet", counted)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == components(links, sets)
    assert len(links) > 20 * len(rows) and sum(made) < 10 * len(rows)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_in_one_task_and_by_steps(spark, monkeypatch, one_task):
    from rasterloom.llm import common

    monkeypatch.setattr(common, "ONE_TASK", one_task)
    rng = random.Random(14)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 90)] + [(k, k + 1) for k in range(700, 760)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {n: c for n, c in components(links, {n for link in links for n in link}).items() if any(n in link and link[0] != link[1] for link in links)}
    if one_task:
        assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_ids_are_linked_with_nothing(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True)]


# 5: packing


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    once = out.drop_duplicates(["doc_id", "piece"])
    for i, t, *_ in hard_texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = once[once["doc_id"] == i].sort_values("piece")
        assert list(own["piece"]) == list(range(-(-len(ids) // 1024))) and (own["length"][1:] == 1024).all()
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own["start"], own["length"])] == list(own["ids_crc32"])
        assert own["length"].sum() == len(ids)
    assert len(out) == len(once) + 2  # the repeated rows have a piece each
    assert packing.pack(empty).collect() == []


def test_ids_are_those_of_the_tokenizer_file_with_its_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark, rng = "<|endoftext|>", random.Random(4)
    texts = [mark, f"a {mark} b", f"a  {mark}  \n b{mark}{mark}c", f"<|{mark}|> <|endoftext|", f"É☃ {mark}\u00a0𝄞 it's {mark}'s", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice((mark, " ", "\n", "ab", "12", "é", "'s", "<|", "|>")) for _ in range(60)) for _ in range(40)]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert tokenizer.encode(texts[1], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_packing_comes_close_to_the_bound(spark, data_dir):
    out = QUERIES["op5_best_fit_packing"](spark, data_dir).toPandas()
    assert out["sequence_id"].nunique() <= 1.01 * out["length"].sum() / 1024 + 2


def islands(sizes, capacity=1024):
    population = []
    for k in range(3):
        population = packing.evolve(sizes, capacity, population, k)
    return packing.Packing(sizes, capacity), population[0]


def test_evolution_beats_best_fit_decreasing_where_that_is_far_from_the_optimum():
    rng = np.random.default_rng(5)
    for n in (30, 100, 400):
        # Triplets that fill a bin exactly: the optimum is n bins.
        a = rng.integers(380, 490, n)
        b = np.array([rng.integers(250, 1024 - x - 249) for x in a])
        sizes = np.sort(np.concatenate((a, b, 1024 - a - b)))[::-1]
        made, best = islands(sizes)
        greedy = made.genes(made.best_fit([], range(len(sizes))))
        assert made.fill(best).max() <= 1 and len(best) == len(sizes) and made.fill(best).sum() * 1024 == sizes.sum()
        assert made.fill(greedy).size >= 1.1 * n and made.fill(best).size <= 1.04 * n + 1


def test_evolution_against_the_optimum_of_small_instances():
    def optimum(sizes, capacity):
        # Least (bins, room used in the last) over subsets.
        best = [(0, capacity)] + [(len(sizes) + 1, 0)] * (2 ** len(sizes) - 1)
        for mask in range(1, 2 ** len(sizes)):
            for i, x in enumerate(sizes):
                if mask >> i & 1:
                    bins, used = best[mask ^ (1 << i)]
                    best[mask] = min(best[mask], (bins, used + x) if used + x <= capacity else (bins + 1, x))
        return best[-1][0]

    rng, off = np.random.default_rng(6), 0
    for _ in range(30):
        sizes = np.sort(rng.integers(3, 14, 11))[::-1]
        made, best = islands(sizes, 20)
        off += made.fill(best).size - optimum(sizes.tolist(), 20)
        assert made.fill(best).max() <= 1
    assert off <= 1


# 6: chat


def test_chat_round_trip_of_hard_conversations(spark, tmp_path, same_rows):
    marks = "<|end|> [INST] <s> <~s> [~~/INST] <|turn|>user<|text|> \\ $1 [ < é𝄞"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", marks), (1, 2, None, None), (1, 2, "user", "b"), (2, None, "assistant", ""), (2, 0, "<|text|>", "x"), (3, 0, "system", "s")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(70)]
    for k, use in enumerate((rows, [])):
        clash = [(*r, "t", 3, 4, "f", "r") for r in use]
        spark.createDataFrame(clash, "conv_id long, turn long, role string, text string, tree string, node long, parent long, formatted string, turns string").write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        same_rows(QUERIES["op6_chat_format"](spark, f"{tmp_path}/{k}"), ORACLES["op6_chat_format"], f"{tmp_path}/{k}")


def test_branches_are_ranked_by_score(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", None), ("t", 5, 9, "user", "orphan", 0.2), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    best = {(r.tree, r.leaf): [t.text for t in r.turns] for r in chat_format.read_back(chat_format.format_conversations(nodes, 2)).collect()}
    assert best == {("t", 4): ["q", "good", "more"], ("t", 5): ["orphan"], ("c", 2): ["x", "y"]}
    assert chat_format.format_conversations(nodes.limit(0)).collect() == []


def test_cycles_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "[INST] word " * 200_000
    rows = [("a", 3, 1, "user", "c", 1.0), ("a", 1, 2, "user", "a", 1.0), ("a", 2, 3, "user", "b", 1.0), ("a", 9, 2, "user", "tail", 2.0), ("a", None, 1, "user", "lost", 9.0)]
    rows += [("b", 1, None, "user", long, 0.0), ("b", 1, None, "user", "z", 0.0), ("b", 2, 1, "assistant", None, None), ("b", 2, 1, "assistant", None, None), (None, 1, None, None, "n", None)]
    clash = [(*r, "x", "y", 1) for r in rows]
    nodes = spark.createDataFrame(clash, "tree string, node long, parent long, role string, text string, score double, turns string, formatted string, depth int")
    got = {(r.tree, r.leaf): [t.text for t in r.turns] for r in chat_format.read_back(chat_format.format_conversations(nodes, None)).collect()}
    assert got == {("a", 9): ["a", "c", "b", "tail"], ("b", 2): [long, ""]}


# 7: toxicity


def test_toxicity_on_held_out_rows(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.1")
    out = QUERIES["op7_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    r = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    right, wrong = ((r["predicted"] == 1) & (r["toxic"] == t) for t in (1, 0))
    assert right.sum() >= 0.9 * (r["toxic"] == 1).sum() and wrong.sum() <= 0.02 * (r["toxic"] == 0).sum()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0


def test_toxicity_of_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(0, 60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).select("score").collect()} == {0.0}


def plain_words(text: str) -> list[tuple[bytes, bytes]]:
    """(as written, as read) of the words of a text."""
    read = bytes.maketrans(bytes(range(65, 91)) + b"013457@$", bytes(range(97, 123)) + b"oieastas")
    return [(w, w.translate(read)) for w in re.findall(rb"[A-Za-z0-9@$\x80-\xff]+", text.encode())]


def test_features_against_a_plain_version():
    rng, words = random.Random(21), toxicity.Words()
    parts = ["you", "YOU", "idiot", "1d10t", "scum", "Idiots!", "hello", "x", "b", "é", "$uck", "great", "greatest", "a1", "42", "…", "*", "sh!t", "du", "@"]
    texts = ["", "  ", "x", "long " * 5000 + "you idiot"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    learned, stem = {b"hello", b"a1", b"b"}, {b"great"}
    learned = {w.translate(bytes.maketrans(b"013457@$", b"oieastas")) for w in learned}
    key = lambda ws: np.unique(np.array([words.one(w.decode()) for w in ws], np.uint64))
    scanned = next(iter(toxicity.scan([b"greatest"], words)))
    insults, second = {w.encode() for w in toxicity.INSULTS}, {w.encode() for w in toxicity.SECOND_PERSON}
    got = toxicity.features([t.encode() for t in texts], words, key(insults), key(second), key(learned), np.unique(scanned[3]))
    for text, row in zip(texts, got):
        data, found = text.encode(), plain_words(text)
        n, size = max(1, len(found)), max(1, len(data))
        fixed, lex, stems = [w in insults for _, w in found], [w in learned for _, w in found], [len(w) > 5 and w[:5] in stem for _, w in found]
        bad, you = [any(x) for x in zip(fixed, lex, stems)], [w in second for _, w in found]
        near = [any(you[j] for j in range(max(0, i - 5), min(len(found), i + 6)) if j != i) for i in range(len(found))]
        close = sum(x and y for x, y in zip(bad, near))
        mixed = [bool(re.search(rb"[0-9@$]", w) and re.search(rb"[A-Za-z\x80-\xff]", w)) for w, _ in found]
        count = lambda signs: sum(data.count(c.encode()) for c in signs)
        upper, lower = sum(65 <= c < 91 for c in data), sum(97 <= c < 123 for c in data)
        hits = [sum(x) for x in (fixed, lex, stems, bad)]
        want = [np.log1p(n), *hits, *(x / n for x in hits), sum(you) / n, close, close / n, upper / max(1, upper + lower), count("!?") / size, count("*#@$%&_~^+=<>|") / size]
        want += [count(".,;:'\"-()") / size, sum(48 <= c < 58 for c in data) / size, sum(c >= 128 for c in data) / size]
        want += [sum(mixed) / n, sum(x and y for x, y in zip(mixed, bad)), sum(len(w) == 1 for w, _ in found) / n]
        assert np.allclose(row, want), text[:80]


def test_trees_against_a_plain_version():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 2)
    y = (x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300) > 0).astype(float)
    made = toxicity.Trees(x, y, rounds=3, depth=2, ridge=2.0, rate=0.2)
    b, score = made._bin(x), np.full(300, made.start)
    assert (b == np.array([[sum(v > e for e in made.edges[c]) for c, v in enumerate(row)] for row in x])).all()
    for splits, value in made.trees:
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        # The root's split has the best gain of all features and cuts.
        gains = {}
        for c in range(4):
            for cut in range(int(b[:, c].max())):
                left = b[:, c] <= cut
                if h[left].sum() >= 0.5 and h[~left].sum() >= 0.5:
                    gains[c, cut] = g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2)
        root = (int(splits[0][0][0]), int(splits[0][1][0]))
        assert gains[root] == pytest.approx(max(gains.values()))
        leaf = []
        for row in b:
            at = 0
            for feature, cut in splits:
                at = 2 * at + int(row[feature[at]] > cut[at])
            leaf.append(at)
        leaf = np.array(leaf)
        for k in range(4):
            own = leaf == k
            assert value[k] == pytest.approx(0.2 * g[own].sum() / (h[own].sum() + 2))
        score += value[leaf]
    assert np.allclose(made(x), score)


def test_lexicons_against_plain_counts(spark):
    rng, words = random.Random(5), toxicity.Words()
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        bag = [rng.choice(("kind", "neutral", "weather", "station")) for _ in range(6)] + [rng.choice(("nastily", "vile", "neutral")) for _ in range(3 * toxic)]
        rows.append((i, " ".join(bag), int(toxic), i % 5 % toxicity.FOLDS))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int").repartition(3)
    got = toxicity._lexicons(train)
    for out in range(toxicity.FOLDS + 1):
        own = [r for r in rows if r[3] != out]
        bad, good = (sum(r[2] == t for r in own) for t in (1, 0))
        want = set()
        for w in {w for r in own for w in r[1].split()}:
            hit, miss = (sum(r[2] == t and w in r[1].split() for r in own) for t in (1, 0))
            if hit >= 2 and np.log((hit + 0.5) / (bad + 1)) - np.log((miss + 0.5) / (good + 1)) > 1.5:
                want.add(w)
        assert want == {"nastily", "vile"} and set(got[out][0].tolist()) == {words.one(w) for w in want} and len(got[out][1]) == 1


def test_training_rows_are_one_for_each_label(spark):
    docs = spark.createDataFrame([(i % 40, f"t{i}" if i % 7 else None, "a") for i in range(400)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert {r.doc_id for r in rows} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2} and len(rows) == len({r.doc_id for r in rows})
    assert len(toxicity.training_rows(docs, labels, 10).collect()) <= 10


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    score = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * score))).astype(float)
    knots, rates = toxicity.isotonic(score, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(rates) >= 0).all() and abs(np.interp(score, knots, rates).mean() - y.mean()) < 0.01


# 8: licences


def test_licences_in_other_spellings(spark):
    mit = licence_scan.LICENCES["MIT"].replace("License", "LICENCE").replace("<year> <copyright holders>", "2019 Ann & Co.").replace("\n\n", "\n \n * ")
    rows = [(1, mit), (2, mit + " more"), (3, None), (4, licence_scan.LICENCES["BSD-3-Clause"].upper())]
    got = {r.doc_id: r.licence_id for r in licence_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: "BSD-3-Clause"}


# 9: substrings


def test_repeated_passages_are_found_and_others_left(spark, docs, empty):
    rng = random.Random(8)
    found = substring_dedup.repeated_spans(docs)
    ids = {r["doc_id"] for r in found.select("doc_id").collect()}
    texts = {i: t for i, t, *_ in hard_texts()}
    grams = {}
    for i, t in texts.items():
        w = words(t)
        for j in range(len(w) - 50):
            grams.setdefault(tuple(w[j : j + 51]), set()).add(i)
    must = set().union(*(d for d in grams.values() if len(d) > 1))
    assert must <= ids
    short = {}
    for i, t in texts.items():
        w = words(t)
        for j in range(len(w) - 42):
            short.setdefault(tuple(w[j : j + 43]), set()).add(i)
    assert ids <= set().union(*(d for d in short.values() if len(d) > 1))
    for r in found.collect():
        part = texts[r.doc_id].encode()[r.first_byte : r.first_byte + r.n_bytes].decode()
        assert len(words(part)) == r.n_words >= 16
    assert substring_dedup.repeated_spans(empty).collect() == []
    cut = substring_dedup.cut_repeats(docs, found)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert sum(len(r["text"] or "") for r in cut.collect()) < sum(len(r["text"] or "") for r in docs.collect())
    del rng


def test_passages_over_50_words_are_found_and_those_under_43_left(spark):
    """Passages of each length from 20 to 70 words, at the start, in the middle and at the end of two documents each."""
    rng, rows, want = random.Random(19), [], {}
    for n in [*range(20, 71)] * 2:
        for before, after in ((0, 30), (40, 40), (30, 0)):
            passage = prose(rng, n)
            for _ in range(2):
                want[len(rows)] = n
                rows.append((len(rows), " ".join(prose(rng, before) + passage + prose(rng, after))))
    found = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r.doc_id for r in found}
    assert all(n <= 50 or i in ids for i, n in want.items()) and all(want[i] >= 43 for i in ids)
    assert all(16 <= r.n_words <= want[r.doc_id] for r in found)


def test_every_chunk_stays_in_a_document(spark):
    rng = random.Random(9)
    shared, copied = prose(rng, 60), prose(rng, 200)
    whole = " ".join(copied[:100] + shared + copied[100:])
    rows = [(1, " ".join(prose(rng, 30) + shared + prose(rng, 30))), (2, whole), (3, whole), *((10 + i, t) for i, t, *_ in hard_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [" " + " ".join(words(r["text"])) + " " for r in substring_dedup.cut_repeats(docs, substring_dedup.repeated_spans(docs)).collect()]
    texts = dict(rows)
    parts = {r["doc_id"]: [] for r in docs.collect()}
    for r in substring_dedup.chunks(docs, True).collect():
        parts[r["doc_id"]].append(" ".join(words(texts[r["doc_id"]].encode()[r["byte"] : r["byte"] + r["bytes"]].decode())))
    assert all(any(f" {part} " in text for text in left) for part in set().union(*parts.values()))
    assert sum(" ".join(copied[:100]) in text for text in left) == 1 and sum(" ".join(shared[20:40]) in text for text in left) == 1


def test_an_insertion_moves_only_cuts_near_it():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    moved = np.concatenate((h[:1000], rng.integers(0, 2**63, 7, dtype=np.uint64), h[1000:]))
    cuts = [set(substring_dedup.chunk_bounds(x, np.zeros(len(x), int), np.array([len(x)]))[0].tolist()) for x in (h, moved)]
    assert {c for c in cuts[0] if c > 1040} == {c - 7 for c in cuts[1] if c > 1047}
    assert max(np.diff(sorted(cuts[0]))) <= substring_dedup.WINDOW


# 10: exact copies


def test_binary_fuse_has_no_false_negatives():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 1000, 60_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        made = exact_dedup.BinaryFuse.build(keys)
        assert made.contains(keys).all()
        assert made.contains(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_copies_of_an_earlier_snapshot(spark):
    old = spark.createDataFrame([(1, "A b"), (2, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(7, "a B"), (8, "a b"), (9, "d"), (10, None), (11, "")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(new, old).collect()}
    digest = hashlib.sha256(b"a b").hexdigest()
    assert got[7] == (8, 3, False, digest) and got[8] == (8, 3, True, digest) and got[9][:3] == (9, 1, True) and got[10][:3] == (11, 2, False)


# 1: html


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain  &amp; text", "plain & text"),
        ("<body><nav>menu</nav><article><h1>T &lt;1&gt;</h1><p>a<br>b <i>c</i>d<p>e&nbsp; f<ul><li>x<li>y</ul></article><footer>f</footer></body>", "T <1>\na b cd\ne f\nx\ny"),
        ("<body><div class='cookie-notice'>c</div><main><p>one<script>var p='</p>'</script></p><aside>s</aside><form>q</form><p>two</p></main><div id=comments><p>hm</p></div></body>", "one\ntwo"),
        ("<body class='has-sidebar'><div class='post-12'><p>long text of the post</p><div class='ad-box'>buy</div></div><!-- <p>no</p> -->", "long text of the post"),
        ("<article><p title=\"a > b\">in</p><p>&#8364; &#x41; &copy &unknown;</p></article>", "in\n€ A © &unknown;"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page, None) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><script>for(i=0;i<n;i++){f(i)}</script><article><p>Body</p></article>", "Body"),
        ("<script>for(i=0;i<n;i++){f(i)}</script><p>Body</p><script>x()</script><p>more</p>", "Body\nmore"),
        ("<script><!-- x=1; </script><p>Body</p>", "Body"),
        ("<head><style>/* <!-- */ a<b{}</style><script>if(a<b)s='</head>'</script></head><p>a<script>i<n</script>b</p>", "ab"),
        ("<svg><script>i<n</script><path d='M0'/></svg><p>Body</p>", "Body"),
        ("<head><meta x=y><body><header>h</header><p>Body</p>", "Body"),
        ("<p>a <span hidden><!-- x</span> b</p>", "a b"),
    ],
)
def test_raw_elements_end_at_their_closing_tag(page, want):
    assert html_extract.main_text(page, None) == want


def test_titles_and_leads_beside_the_body_stay():
    lead, body, teaser = "lead " * 3, "body " * 17, "teaser"
    page = f"<article><h1>T</h1><div class=lead>{lead}</div><div class=body>{body}</div></article>"
    want = f"T\n{lead.strip()}\n{body.strip()}"
    assert html_extract.own_path(page) == ">article"
    assert html_extract.main_text(page, None) == html_extract.main_text(page, ">article>div.body") == want
    other = f"<body><div class=box><p>{teaser}</p></div><section><p>{body}</p></section></body>"
    assert html_extract.main_text(other, ">body>div.box") == f"{teaser}\n{body.strip()}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><body><header>top</header><article><p>main text here</p></article>", "main text here"),
        ("<p>a <span class='share'><span>x</span> Share this</span> b</p>", "a b"),
        ("<p>a <a class='share-link' href=x>Share</a> b <button>Copy</button>c</p>", "a b c"),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
        ("<body><article><header><h1>Title</h1></header><p>text of it</p><footer>f</footer></article>", "Title\ntext of it"),
        ("<body><article><p>text</p><div class='social-history'><p>long enough</p></div><div class='social-buttons'>s</div></article>", "text\nlong enough"),
        ("<body><div><a href=1>Home</a> <a href=2>About</a></div><div class=c><h1>T</h1><p>Some text that is long</p></div><div>(c) 2020</div>", "T\nSome text that is long"),
        ("<body><div class='sponsored-story'><p>The only long text of this page.</p></div><div class=ad>buy</div>", "The only long text of this page."),
        ("<body><div class='ad-box'><p>An advert longer than the text.</p></div><p>Text.</p>", "Text."),
        ("<body><main><p>one</p></main><section id=comments><article class=comment><p>hm, a much longer remark</p></article></section>", "one"),
        ("<body><p>one<ul><li><a href=x>two</a> and more<li>three</ul><table><tr><td>four<td>five</table>", "one\ntwo and more\nthree\nfour\nfive"),
        ("<table><tr><td><div>a</td></div><td>b</table>c", "a\nb\nc"),
        ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><p data-hidden=true>seen</p>", "seen"),
    ],
)
def test_containers_marks_and_missing_ends(page, want):
    assert html_extract.main_text(page, None) == want


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000, "<script>" * 100_000, "<span hidden><span></span>" * 20_000, "<svg><script>" * 20_000, "<head><script></head></script>" * 20_000, "<table><tr><td><div>" * 20_000 + "</td>" * 20_000, "<p class='" * 20_000 + "'>", "<!-- x <![CDATA[ y" * 20_000 + ">"],
)
def test_long_and_deep_pages_end_soon(page):
    import time

    began = time.process_time()
    assert html_extract.main_text(page + "<p>deep &amp; long</p>", None).endswith("deep & long")
    assert time.process_time() - began < 5


def test_every_page_against_a_plain_parser(spark, data_dir):
    """The pages of the test table have their text in an article of headings and paragraphs, with missing end tags."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.found, self.now = False, [], []

        def end(self):
            if text := " ".join("".join(self.now).split()):
                self.found.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "p", "h1", "h2", "li", "ul", "div"):
                self.end()
            self.inside = self.inside or tag == "article"
            self.now.append(" " if tag == "br" else "")

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "h2", "li", "ul", "div"):
                self.end()
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.now += [data] * self.inside

    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op1_html_extract"](spark, data_dir).collect()}
    pages = spark.read.parquet(f"{data_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.end()
        assert got[r.page_id] == ("\n".join(plain.found), len("\n".join(plain.found)))


def test_a_host_of_two_layouts(spark):
    one = "<body><div class=menu><a href=1>a</a></div><div class=post><h1>T{0}</h1><p>text {0} of the first layout</p></div></body>"
    two = "<body><div class=post>teaser {0}</div><section class=story><p>text {0} of the second layout, longer</p></section></body>"
    rows = [(i, "http://h/", (one if i < 5 else two).format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\ntext {i} of the first layout" if i < 5 else f"teaser {i}\ntext {i} of the second layout, longer" for i in range(8)}


def test_hosts_vote_and_pages_without_the_path_use_their_own(spark):
    body = "<body><div class='a{}'><p>text of page {} is here</p></div></body>"
    rows = [(i, f"http://H.example.org/{i}", body.format(i, i), "x") for i in range(4)] + [(9, "http://h.example.org/9", "<body><section><p>other page</p></section></body>", "x"), (10, None, None, None), (11, "no url", "<p>t</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {**{i: f"text of page {i} is here" for i in range(4)}, 9: "other page", 10: "", 11: "t"}
    assert {r.host: r.winner for r in html_extract.winning_paths(pages.withColumn("host", html_extract.host_of(F.col("url")))).collect()}["h.example.org"] == ">body>div.a#"
    assert html_extract.extract(pages.limit(0)).collect() == []


# 2: neighbours


def test_neighbours_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 64))
    v[400:700] = v[400]
    rows = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]
    rows += [(1000, None, 0), (1100, [0.0] * 64, 0), (1200, [float("nan")] + [1.0] * 63, 0), (1300, [None] + [1.0] * 63, 0), (1400, [1.0] * 3, 0)]
    again = rows[:20] + rows[-3:]
    spark.createDataFrame(rows + again, "vec_id long, embedding array<double>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op2_ann_search"](spark, str(tmp_path)).toPandas()
    hits = total = 0
    for q in range(0, 900, 100):
        gap = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        ids = np.arange(900)
        keep = ids != q
        want = ids[keep][np.lexsort((ids[keep], gap[keep]))[:10]]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.array_equal(own["score"], gap[own["vec_id"]])
        hits, total = hits + len(set(want) & set(own["vec_id"])), total + 10
        if q == 400:
            assert list(own["vec_id"]) == list(range(401, 411))
    assert set(got["query_id"]) == set(range(0, 900, 100)) and hits / total >= 0.9
    few = ann_search.usable(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int"), "vec_id", "embedding")
    assert ann_search.search(few, few).count() == 6
    assert ann_search.search(few.limit(0), few.limit(0)).count() == 0


def test_recall_above_a_shard_with_a_hot_vector_and_two_lengths(spark):
    """20,000 and more different vectors in two cells, a third of the rows one vector, a tenth of them of another length."""
    rng = np.random.default_rng(7)
    hot, n = rng.normal(size=24), 24_000
    v = [*rng.normal(size=(n - 2_000, 24)), *rng.normal(size=(2_000, 16)), *[hot] * 12_000]
    rows = pa.table({"vec_id": np.arange(len(v)), "v": pa.array(v, pa.list_(pa.float64()))})
    vectors = ann_search.usable(spark.createDataFrame(rows).repartition(8), "vec_id", "v")
    asked = [*range(0, n, 400), n + 5, n + 6]
    got = ann_search.search(vectors, vectors.where(F.col("vec_id").isin(asked))).toPandas()
    hits = 0
    for q in asked:
        ids = np.array([i for i in (range(n - 2_000, n) if n - 2_000 <= q < n else [*range(n - 2_000), *range(n, len(v))]) if i != q])
        gap = np.sqrt(((np.stack([v[i] for i in ids]) - v[q]) ** 2).sum(axis=1))
        want = ids[np.lexsort((ids, gap))[:10]]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.array_equal(own["score"], [np.sqrt(((v[i] - v[q]) ** 2).sum()) for i in own["vec_id"]])
        assert q < n or list(own["vec_id"]) == list(want)
        hits += len(set(want) & set(own["vec_id"]))
    assert hits >= 0.95 * 10 * len(asked)


def test_a_shard_verifies_few_vectors_and_finds_the_nearest():
    v = np.random.default_rng(8).normal(size=(16_384, 64))
    shard, asked = ann_search.Shard(v), v[:40] + 0.01
    found = shard.nearest(asked, 11)
    want = [set(np.argsort(((v - q) ** 2).sum(axis=1))[:10].tolist()) for q in asked]
    assert np.mean([len(w & set(f.tolist())) for w, f in zip(want, found)]) >= 9.5
    assert np.mean([len(f) for f in found]) < 0.05 * len(v)
    assert (shard.reach(asked * 3) <= np.sqrt(((v[:, None] - asked * 3) ** 2).sum(axis=2)).min(axis=0)).all()
