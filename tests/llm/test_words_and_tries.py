"""Subword lattice, collocations and the prefix trie: brute force, and defined results in odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import chunks, collocations, lattice, prefix_trie

ODD = [(None, None, None), (1, None, "en"), (2, "", "en"), (2, "", "en"), (3, " \t\n", None), (4, "One", "en"), (5, "a b. A b", "en"), (6, "x y   z\x85w\x00", "de"), (7, "w" * 3000, "en"), (8, "Áİ K ▁ é", "en"), (9, "!?;", "en")]


def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return made.withColumns({"chunk": F.lit("clash"), "part": F.lit(1), "word": F.lit(2), "n": F.lit("x"), "mark": F.lit(0), "id": F.lit(0)})


# chunks


def test_chunks_hold_the_texts(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcdefg") * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 30))), "t") for i in range(200)]
    made = docs(spark, rows).select("doc_id", F.lit(True).alias("mark"), F.col("lang").alias("part"), "text")
    got = {}
    for r in chunks.encoded(made, chunks.words).collect():
        words = [b""] + chunks.zstandard.decompress(r["words"]).split(b"\n")
        stream, at = chunks.unpack(r["stream"], np.uint32), 0
        for doc, size in zip(r["doc_ids"], r["sizes"]):
            got[doc] = b" ".join(words[i] for i in stream[at : at + size]).decode()
            assert stream[at + size] == chunks.BREAK
            at += size + 1
    assert got == {i: t for i, t, _ in rows}


@pytest.mark.parametrize("text", ["", "A,b", "..", " a\tB;c\r\nd ", "x\x85y \x00.\x0b"])
def test_pieces_split_like_the_pattern(text):
    want = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.translate({i: i + 32 for i in range(65, 91)}))]
    got = b"\x01".join(chunks.pieces(text.encode())).decode().split("\n")
    assert [[w for w in p.split("\x01") if w] for p in got] == want


# lattice


def spell(word: bytes, known: dict[bytes, float]) -> float:
    """Sum over all segmentations, one by one."""
    return sum(math.exp(known[word[:i]]) * (spell(word[i:], known) if i < len(word) else 1.0) for i in range(1, len(word) + 1) if word[:i] in known)


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(lattice.VOCABULARY)


def test_forward_sums_all_segmentations(pieces):
    names = {}
    prefixes = {0: b""}
    for a, b, c in pieces.steps.tolist():
        prefixes[c] = prefixes[a] + bytes([b])
    for node, i in enumerate(pieces.final.tolist()):
        if i >= 0:
            names[prefixes[node]] = pieces.first[i]
    words = [w.encode() for w in ("the", "international", "straße", "a", "\x00zq", "日本", "!!!", "ununun")]
    got = lattice.Lattice(words, pieces.table(), pieces.final).likelihood(pieces.first)
    assert got.tolist() == pytest.approx([math.log(spell(b" " + w, names)) for w in words])


def test_expected_counts_are_the_slope_of_the_likelihood(pieces):
    words, counts = [b"nation", b"on", b"station", "é".encode()], np.array([3, 1, 2, 5])
    built = lattice.Lattice(words, pieces.table(), pieces.final)
    n = built.expected(pieces.first, counts)
    for piece in np.argsort(-n)[:5].tolist():
        step = np.zeros(len(n))
        step[piece] = 1e-5
        slope = ((built.likelihood(pieces.first + step) - built.likelihood(pieces.first - step)) * counts).sum() / 2e-5
        assert n[piece] == pytest.approx(slope, rel=1e-4)


def test_long_words_keep_their_probability(pieces):
    got = lattice.Lattice([b"w" * 5000, b"ab" * 2500], pieces.table(), pieces.final).likelihood(pieces.first)
    assert np.isfinite(got).all() and (got < -1000).all()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_scores_match_plain_python(spark, pieces):
    rnd = random.Random(4)
    vocabulary = [rnd.choice(["the", "ra", "tion", "é", "Un"]) + rnd.choice(["s", "ing", "o", "ü"]) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 25))), "en") for i in range(150)] + [(i, t, g) for i, t, g in ODD if i is not None]
    table = docs(spark, rows)
    out = lattice.score(table, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, rounds=2)
    tokens = [chunks.words((t or "").encode()) for _, t, _ in rows]
    train = Counter(w for (i, _, _), ws in zip(rows, tokens) if not held_out(i) for w in ws)
    n_texts = sum(not held_out(i) for i, _, _ in rows)
    n = sum(train.values()) + n_texts
    kinds = len(train) + 1
    words = sorted(set(w for ws in tokens for w in ws))
    built, score = lattice.Lattice(words, pieces.table(), pieces.final), pieces.first
    for _ in range(2):
        found = built.expected(score, np.array([train[w] for w in words])) + lattice.PRIOR
        found[-1] += n_texts
        score = np.log(found / found.sum())
    own = dict(zip(words, built.likelihood(score) / math.log(10)))
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))
    want = Counter()
    for (i, _, _), ws in zip(rows, tokens):
        want[(i, held_out(i), len(ws) + 1, sum(train[w] > 0 for w in ws) + 1, n, round(sum(base(train[w]) for w in ws) + base(n_texts), 6), round(sum(own[w] for w in ws) + score[-1] / math.log(10), 5))] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 5)) for r in out.collect())
    assert got == want


def test_scores_of_odd_tables(spark):
    out = lattice.score(docs(spark, ODD), F.lit(False), rounds=1).collect()
    assert len(out) == len(ODD) and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in out)
    assert lattice.score(docs(spark, ODD).limit(0), F.lit(False), rounds=1).count() == 0
    untrained = lattice.score(docs(spark, ODD), F.lit(True), rounds=1).collect()
    assert len(untrained) == len(ODD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in untrained)


# collocations


def plain_phrases(rows, least, absorb, top):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    out = defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = set()
    for (lang, *ws), a in candidates.items():
        for k in range(2, len(ws)):
            gone |= {(lang, *ws[i : i + k]) for i in range(len(ws) - k + 1) if 100 * a >= absorb * f[(lang, *ws[i : i + k])]}
    for (lang, *ws), a in candidates.items():
        if (lang, *ws) in gone:
            continue
        score, _, left, right = min((2000000 * a // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k, f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("seed", range(3))
def test_phrases_match_plain_python(spark, seed, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    rnd = random.Random(seed)
    words = [*"abcdefgh", "é", "\x01", "a\x01", "z\x85"]
    rows = [(i, "".join(rnd.choices(words, weights=[9, 9, 4, 4, 2, 2, 1, 1, 2, 1, 1, 1])[0] + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",\n"]) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "de", None])) for i in range(120)]
    rows += [(500 + i, "the quick brown fox jumps", "en") for i in range(12)] + ODD
    table = docs(spark, rows).repartition(5)
    got = {tuple(r) for r in collocations.phrases(table, 4, 80, 15).collect()}
    assert got == plain_phrases(rows, 4, 80, 15)


def test_phrases_of_odd_tables(spark):
    assert collocations.phrases(docs(spark, ODD)).count() == 0
    assert collocations.phrases(docs(spark, ODD).limit(0)).count() == 0


def test_runs_meet_across_partitions():
    rnd = np.random.default_rng(3)
    hi, lo, n = keys = collocations.keys_of(rnd.integers(0, 4, 3000))
    whole, parts = Counter(), Counter()
    for cuts, into in (([0, len(hi)], whole), ([0, 1, 2, 30, 31, 60, len(hi)], parts)):
        for i, j in zip(cuts, cuts[1:]):
            batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + 7]) for x in (hi[i:j], lo[i:j], n[i:j])], names=["hi", "lo", "n"]) for a in range(0, j - i, 7)]
            for out in collocations._phrases(10)(iter(batches)):
                for r in out.to_pylist():
                    into[r["size"], r["hi"], r["lo"]] += r["n"]
    often = {k: v for k, v in whole.items() if v >= 10}
    assert often and often == {k: v for k, v in parts.items() if v >= 10} and len(keys[0]) == len(set(zip(hi.tolist(), lo.tolist())))


# prefix trie


def plain_trie(seqs):
    """seqs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        own = ",".join(map(str, sorted(c for c in ids if len(seqs[c]) == len(node))))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(own.encode()).hexdigest()))
    return out


def random_conversations(rnd, n):
    return {c: [(rnd.choice("ua"), rnd.choice(["x", "yy", ""])) for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9]))] for c in rnd.sample(range(1000), n)}


def as_sequences(spark, seqs):
    rows = [(c, [(i, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32], len(t)) for i, (r, t) in enumerate(s)]) for c, s in seqs.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<turn: long, h: string, chars: long>>")


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 2), (2, 9), (3, 70), (4, 150)])
def test_trie_matches_plain_python(spark, seed, n):
    seqs = random_conversations(random.Random(seed), n)
    got = [tuple(r) for r in prefix_trie.trie(as_sequences(spark, seqs)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(seqs)


@pytest.mark.parametrize("seed", range(30))
def test_parts_of_blocks_meet_in_their_nodes(seed):
    """Any cut into blocks gives the same sums, blocks of one conversation and of copies included."""
    rnd = random.Random(seed)
    seqs = random_conversations(rnd, rnd.randrange(2, 40))
    if seed % 3 == 0:
        seqs |= {2000 + i: [("u", "x")] * 4 for i in range(12)}
    key = lambda s: b"".join(hashlib.sha256(f"{r}{t}".encode()).digest()[:16] for r, t in s)
    order = sorted((key(s), c, [len(t) for _, t in s]) for c, s in seqs.items())
    cuts = sorted({0, len(order), *rnd.sample(range(len(order)), min(len(order), rnd.randrange(1, 9)))})
    rows = []
    for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
        some = order[i:j]
        rows += prefix_trie.block_nodes(3 * b, np.array([c for _, c, _ in some]), [k for k, _, _ in some], np.array([x for *_, k in some for x in k], dtype=np.int64), np.cumsum([0, *(len(k) for *_, k in some)])).to_pylist()
    edges = prefix_trie.Edges([r for r in rows if r["kind"] == prefix_trie._EDGE])
    names = ["kind", "block", "depth", "n_children", "n_leaves", "saved", "extends", "conv_id", "n_convs", "before", "ends"]
    parts = pa.Table.from_pylist([{c: r[c] for c in names} for r in rows if r["kind"] in (prefix_trie._LEFT, prefix_trie._RIGHT)], schema=pa.schema([prefix_trie._ROWS.field(c) for c in names]))
    met = defaultdict(list)
    for r in pa.Table.from_batches(edges.resolve(parts.to_batches())).to_pylist():
        met[r["home"], r["side"], r["depth"]].append(r)
    got = {(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["sha"]) for r in rows if r["kind"] == prefix_trie._INSIDE}
    for (_, _, depth), some in met.items():
        n = sum(r["n_convs"] for r in some)
        ends = ",".join(r["ends"] for r in sorted(some, key=lambda r: r["block"]) if r["ends"] is not None)
        got.add((min(r["conv_id"] for r in some), depth, n, sum(r["n_children"] for r in some), sum(r["n_leaves"] for r in some) + 1, sum(r["saved"] for r in some) - (n - 1) * some[0]["before"], hashlib.sha256(ends.encode()).hexdigest()))
    assert got == {(c, d, n, k, leaves, saved, sha) for c, d, _, n, k, leaves, saved, sha in plain_trie(seqs)}


def test_raw_turns_are_ordered_and_shared(spark):
    rows = [(0, 2, "u", "c"), (0, None, None, None), (0, 1, "a", "b"), (0, 1, "a", "b"), (1, 1, "u", "x"), (1, 2, "a", "y"), (1, 3, "u", "z" * 9000), (202, 1, "u", "q"), (None, 1, "u", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "h": F.lit("x"), "key": F.lit(2)})
    own = {0: [("", ""), ("a", "b"), ("a", "b"), ("u", "c")], 1: [("u", "x"), ("a", "y"), ("u", "z" * 9000)], 202: [("u", "q")]}
    want = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + s[h:]
    got = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(turns)))
    assert {tuple(r) for r in got.collect()} == plain_trie(want)
    assert prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(turns.limit(0)))).count() == 0
