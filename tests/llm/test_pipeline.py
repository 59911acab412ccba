"""The corpus pipeline: registration, each stage's effect, and near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomgrid.llm import registry, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registry():
    names = set(registry.queries())
    parts = {"shard_law", "fingerprint_components", "quality_base_counts"}  # of operators, for SQL to check
    assert sorted(n.split("_")[0] for n in names - parts) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"]) and parts <= names
    assert set(registry.oracle_sql()) <= names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mix", "shards"]


def corpus():
    rnd = random.Random(21)
    vocabulary = {"en": [f"{a}{b}" for a in ("the", "ing", "and", "sh") for b in ("er", "on", "at", "es", "ly")], "de": [f"{a}{b}" for a in ("sch", "über", "keit", "ge") for b in ("ung", "ein", "ß", "au", "en")]}
    words = lambda lang, n: [rnd.choice(vocabulary[lang]) + rnd.choice("aeiou") for _ in range(n)]
    rows, near = [], []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        own = words(lang, 200)
        rows.append((i, " ".join(own), lang, f"s{i % 4}", 0))
        if i % 10 == 0:  # two copies with a changed word, one with other case
            for j, at in enumerate((20, 150)):
                rows.append((1000 + 10 * i + j, " ".join(own[:at] + ["changed"] + own[at + 1 :]), lang, "s1", 0))
            if lang == "en":
                rows.append((1000 + 10 * i + 5, " ".join(own).upper(), lang, "s2", 0))
            near.append(i)
    item = words("en", 40)
    rows.append((900, " ".join(words("en", 80) + item[5:20] + words("en", 80)), "en", "s0", 0))
    rows += [(901, "12 34 !!", "en", "s0", 0), (902, None, None, None, None), (903, "", None, "s0", 0)]
    return rows, near, " ".join(item)


def test_stages(spark, tmp_path):
    rows, near, item = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {901, 902, 903}
    one = stage["near_dedup"](spark, kept, str(tmp_path))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {*range(120), 900}
    clean = stage["decontamination"](spark, one, str(tmp_path))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(120))
    mixed = stage["mix"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns and 100 <= mixed.count() <= 140
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == mixed.count() and {r.doc_id for r in out} == {r.doc_id for r in mixed.select("doc_id").collect()}


def test_many_near_copies_of_one_text(spark):
    rnd = random.Random(22)
    own = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(own[:at] + [f"c{i}"] + own[at + 1 :])) for i in range(400) for at in [rnd.randrange(300)]]
    rows += [(1000 + i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 300)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {0, *range(1000, 1200)}


def test_near_copies_within_families_of_templates(spark):
    """Of each pair of copies one goes, as often as pairs meet under a key at all, though all texts of a family are near each other."""
    rnd = random.Random(23)
    rows, grams = [], {}
    for family in range(2):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        for _ in range(300):
            own = list(base)
            for at in rnd.sample(range(400), 8):
                own[at] = f"o{rnd.randrange(10**6)}"
            for _ in range(2):
                copy = list(own)
                for at in rnd.sample(range(400), 3):
                    copy[at] = f"c{rnd.randrange(10**6)}"
                grams[len(rows)] = {tuple(copy[i : i + 5]) for i in range(396)}
                rows.append((len(rows), " ".join(copy)))
    rnd.shuffle(rows)
    alike = [(i, j) for i in grams for j in range(i + 1, i + 600 - i % 600) if len(both := grams[i] & grams[j]) >= 0.83 * (len(grams[i]) + len(grams[j]) - len(both))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert len(alike) > 400 and len(kept) > 400
    assert sum(kept >= set(p) for p in alike) <= 0.01 * len(alike)


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """Columns named as the stages name their own, with dots, backticks and in other case."""
    names = ["__h", "__nth", "__d", "__lang", "__all", "__times", "__copy", "__text", "h", "H_", "d", "nth", "copy", "times", "rows", "everything", "kept_id", "own_id", "lang_pred", "lang_score", "held_out", "a.b", "c`d", "item", "start", "n_hit"]
    rows, near, item = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, str(tmp_path)), stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns
        assert sorted(str(r.doc_id) for r in plain.collect()) == sorted(str(r.doc_id) for r in out.collect())
        assert all(r["a.b"] == f"a.b{r.doc_id}" and r["__h"] == f"__h{r.doc_id}" for r in out.collect() if r.doc_id is not None)


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    from .test_operators import ODD, odd

    docs = odd(spark).drop("score").withColumns({c: F.col("n_chars") for c in ("a", "shard", "slot", "size", "sketch", "fingerprint", "bucket", "repeats", "n_hit")})
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
        assert out.count() <= 3 * (len(ODD) + 1)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chains_of_sketches_stay_whole(spark, monkeypatch):
    """Under one key for all: ends of a chain of three links, whose middle ones hang on different references."""
    monkeypatch.setattr(simhash, "keys_for", lambda classes: np.array([[0]]))
    rng = np.random.default_rng(31)
    rows = []
    for family in range(40):
        sketch, places = rng.random(simhash.SKETCH_BITS) < 0.5, 1 + rng.permutation(simhash.SKETCH_BITS - 1)
        sketch[0] = False
        for k, c in enumerate((0, 2, 3, 1)):  # the middle ones have the larger ids
            if k:
                sketch = sketch.copy()
                sketch[places[170 * (k - 1) : 170 * k]] ^= True
            rows.append((1000 * c + family, np.packbits(sketch, bitorder="little").view("<i8").tolist()))
    found = simhash.similar(spark.createDataFrame(rows, "c long, sketch array<bigint>").repartition(3))
    tree = {r.node: r.root for r in simhash.components(found).collect()}
    assert tree == {1000 * c + family: family for family in range(40) for c in (1, 2, 3)}


def test_texts_are_compared_beside_a_reference_that_fails(spark, monkeypatch):
    """Two texts at 0.8 or more of each other, each near a third by sketch but not by shingles."""
    monkeypatch.setattr(simhash, "keys_for", lambda classes: np.array([[0]]))
    rnd = random.Random(32)
    rows, want = [], set()
    for family in range(60):
        first = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        second = list(first)
        for at in range(10, 400, 40):  # 50 of 396 shingles: 0.776
            second[at] = f"x{rnd.randrange(10**6)}"
        third = list(second)
        third[200] = f"y{rnd.randrange(10**6)}"
        texts = [" ".join(t) for t in (first, second, third)]
        u = np.array([simhash.sketch_of(t) for t in texts]).view(np.uint64)
        if len({int(x[0]) & 1 for x in u}) == 1 and all(np.bitwise_count(u[0] ^ x).sum() <= 176 for x in u[1:]):
            rows += [(1000 * k + family, t) for k, t in enumerate(texts)]
            want |= {family, 1000 + family}
    assert len(want) > 20
    assert {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


def test_pivot_distances_discard_pairs():
    """Sets in groups: links connect what brute force connects, and most pairs go by the triangle inequality alone."""
    rng = np.random.default_rng(33)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 10**9, 200)
        for _ in range(25):
            sets.append(np.unique(np.where(rng.random(200) < rng.choice([0.01, 0.05, 0.09, 0.2]), rng.integers(0, 10**9, 200), base)))
    chain = [np.arange(at, at + 1000) for at in (0, 240, 80, 160)]  # its ends are pivots; only the middle ones link them
    sets = [sets[i] for i in rng.permutation(len(sets))] + chain + [np.zeros(0, dtype=np.int64)]
    i, j, verified = simhash.within(len(sets), simhash.shingle_distances(np.concatenate(sets), np.array([len(s) for s in sets])), simhash.WIDE_DISTANCE)
    brute = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 8 * (len(sets[a]) + len(sets[b]) - n) > 0]
    assert set(zip(i.tolist(), j.tolist())) <= set(brute) | {(b, a) for a, b in brute}
    parts = [simhash._least_reachable(len(sets), *np.array(p, dtype=np.int64)) for p in ((i, j), tuple(zip(*brute)))]
    assert (parts[0] == parts[1]).all() and len(i) == len(sets) - len(set(parts[1].tolist()))
    assert 0 < verified <= 0.01 * len(sets) * (len(sets) - 1) / 2


def test_shingle_distances_of_any_sets():
    """Sets that share much, little, all and nothing, against Python's sets."""
    rng = np.random.default_rng(34)
    for most, n, size in ((100, 40, 60), (5000, 40, 60), (10**9, 5, 30), (3, 6, 3), (10**6, 1, 10)):
        sets = [np.unique(rng.integers(0, most, rng.integers(0, size))) for _ in range(n)] + [np.zeros(0, dtype=np.int64)] * 2
        distance = simhash.shingle_distances(np.concatenate(sets), np.array([len(s) for s in sets]))
        plain = [set(s.tolist()) for s in sets]
        for k, a in enumerate(plain):
            assert distance(k).tolist() == [1 - len(a & b) / len(a | b) if a | b else 0 for b in plain]
