"""Whitening against an eigendecomposition, SimHash links against all pairs, alignment against a walk over bytes."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import queries, simhash, token_alignment, whitening

SF = "/root/testdata/sf0.001"


def exact(vectors):
    """The kept vectors as whole numbers with the offset, by the definition."""
    return [[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors]


def plain_whitening(vectors, k):
    x = exact(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[float(Fraction(n * r[i] - sums[i], n)) for i in range(d)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    return n, deviation, centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def same_whitening(got, ids, vectors, k):
    n, deviation, white, explained = plain_whitening(vectors, k)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert set(by) == set(ids) and len(got) == k * len(ids)
    ours = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in ids])
    signs = np.sign((ours * white).sum(axis=0))
    assert np.allclose(ours * signs, white, atol=1e-6)
    for i, far in zip(ids, deviation, strict=True):
        assert {(r.n, r.deviation) for r in by[i]} == {(n, far)}
        assert np.allclose([r.explained for r in sorted(by[i], key=lambda r: r.component)], explained, rtol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, 7)) @ r.normal(size=(7, 7))).tolist()
    vectors[3] = vectors[4]
    bad = [(900, None, 1), (901, [1.0] * 6 + [None], 1), (902, [float("nan")] * 7, 2), (903, [float("inf")] + [0.0] * 6, 2)]
    df = spark.createDataFrame([*[(i, v, 0) for i, v in enumerate(vectors)], *bad], "vec_id long, embedding array<double>, component int").repartition(5)
    same_whitening(whitening.whiten(df, components=4).collect(), list(range(300)), vectors, 4)
    same_whitening(whitening.whiten(df, components=32).collect(), list(range(300)), vectors, 7)


def test_whitening_of_the_table(spark):
    got = queries.op11_whitening(spark, SF).collect()
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    same_whitening(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_whitening_merges_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    monkeypatch.setattr(whitening, "BLOCK", 5)
    vectors = np.random.default_rng(6).normal(size=(90, 4)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(11)
    same_whitening(whitening.whiten(df).collect(), list(range(90)), np.array(vectors, np.float32).tolist(), 4)


def test_whitening_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    of = lambda *rows: whitening.whiten(spark.createDataFrame(list(rows), kind)).collect()
    assert of() == of((1, [1.0, 2.0])) == of((1, [1.0, 2.0]), (2, [1.0, 2.0])) == of((1, None)) == of((1, []), (2, [])) == []
    with pytest.raises(ValueError, match="lengths"):
        of((1, [1.0]), (2, [1.0, 2.0]))
    # fewer rows than dimensions: two components have variance; repeated and null ids keep their rows
    got = of((None, [1.0, 2.0, 3.0, 9.0]), (7, [2.0, 2.0, 5.0, 1.0]), (7, [0.0, 1.0, 0.0, 4.0]))
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    far = whitening.Whitening(3, [0], np.eye(1), np.ones(1), np.ones(1)).deviation(np.array([[1 << 40]]))
    assert far == [9 << 80]  # exact beyond a long


def test_jacobi(spark):
    r = np.random.default_rng(1)
    for a in (r.normal(size=(9, 9)), np.diag([1e8, 1.0, 1e-8]) @ r.normal(size=(3, 3)), np.zeros((4, 4)), r.normal(size=(5, 1)), np.ones((6, 6))):
        sigma, v = whitening.jacobi_svd(a)
        assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-9, atol=1e-12 * max(sigma[0], 1))
        assert np.allclose(v.T @ v, np.eye(a.shape[1])) and np.allclose(np.linalg.norm(a @ v, axis=0), sigma, atol=1e-12 * max(sigma[0], 1))


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    """prints: (id, fingerprint); the smallest id that each reaches."""
    unique = sorted({f for _, f in prints})
    parent = {f: f for f in unique}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, f in enumerate(unique):
        for g in unique[i + 1 :]:
            if (f ^ g).bit_count() <= distance:
                parent[find(g)] = find(f)
    least = {}
    for i, f in prints:
        least[find(f)] = min(least.get(find(f), i), i)
    return {(i, f"{f:016x}", least[find(f)]) for i, f in prints}


def near_texts(seed):
    r = random.Random(seed)
    words = [f"Wort{i}É" for i in range(300)]
    texts = [None, "", " \t\n", "one", "ONE two", "a b c", "a b c d", "é\x1f\x85\xa0b " * 5]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(3, 150))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append("".join(x + r.choice([" ", "\n", "  "]) for x in w))
    return [*texts, texts[9], texts[9], " ".join(words * 40)]


def test_simhash(spark):
    texts = near_texts(2)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, f int").repartition(3)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in enumerate(texts)], 4)
    got = lambda **x: {tuple(r) for r in simhash.simhash(df, **x).collect()}
    assert got() == want
    assert got(most=1) == want  # all that share an entry meet by balls
    assert len({c for *_, c in want}) < len(texts) - 10


def test_simhash_of_the_table(spark):
    got = {tuple(r) for r in queries.op12_simhash(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows], 4)


@pytest.mark.parametrize("distance", [1, 3, 4])
@pytest.mark.parametrize("most", [2, 4096])
def test_hamming_edges(spark, distance, most):
    r = random.Random(distance)
    found = [r.getrandbits(64) for _ in range(20)]
    for _ in range(120):
        f = r.choice(found)
        for b in r.sample(range(64), r.randrange(1, distance + 3)):
            f ^= 1 << b
        found.append(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in set(found)], "f long")
    want = plain_components([(f, f) for f in found], distance)
    for count in range(2, distance + 2):
        edges = simhash.hamming_edges(df, distance, most=most, plan=simhash.segments(distance, count)).collect()
        parent = {f: f for f in set(found)}

        def find(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for e in edges:
            a, b = find(e.u & (1 << 64) - 1), find(e.v & (1 << 64) - 1)
            parent[max(a, b)] = min(a, b)
        assert {(f, f"{f:016x}", find(f)) for f in found} == want


def test_segments():
    for distance in range(1, 9):
        for count in range(2, distance + 2):
            plan = simhash.segments(distance, count)
            assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == distance + 1
    assert len(simhash.segments_for(1000, 4)) > len(simhash.segments_for(10**11, 4))


def test_simhash_odd_tables(spark):
    df = spark.createDataFrame([(None, "same text"), (5, "same text"), (None, None), (5, None)], "doc_id long, text string")
    same, zero = f"{plain_fingerprint('same text'):016x}", "0" * 16
    assert sorted(map(str, simhash.simhash(df).collect())) == sorted(f"Row(doc_id={i}, fingerprint='{f}', component_id=None)" for i in (None, 5) for f in (same, zero))
    assert simhash.simhash(df.limit(0)).collect() == []


def plain_alignment(rows):
    """rows: (id, text). Walks over the bytes of each text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.MODEL_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=token_alignment.MODEL_B)
    signs = token_alignment._byte_signs()
    out, links, docs = {}, {}, defaultdict(int)
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(signs[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.IdToPiece(x)[3:5], 16)]) if b.IsByte(x) else b.IdToPiece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out[i], links[i] = (0, 0, 0, ""), []
            continue
        owner_a, owner_b = ([n for n, t in enumerate(ts) for _ in t] for ts in (bytes_a, bytes_b))
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))
        links[i] = [(ids_a[x], ids_b[y]) for x, y in pairs]
        groups, mine, theirs = [], [], []
        for at in range(len(owner_a)):
            mine.append(owner_a[at])
            theirs.append(owner_b[at])
            if at + 1 == len(owner_a) or (owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]):
                groups.append(",".join(str(ids_a[x]) for x in dict.fromkeys(mine)) + "|" + ",".join(str(ids_b[x]) for x in dict.fromkeys(theirs)))
                mine, theirs = [], []
        out[i] = (len(ids_a), len(ids_b), len(groups), ";".join(groups))
        for pair in set(links[i]):
            docs[pair] += 1
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return {i: (*out[i][:3], len(p), sum(docs[q] == most[q[0]] for q in p), sum(docs[q] for q in p), out[i][3]) for i, p in links.items()}


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(4)
    words = ["the", "Straße", "naïve", "日本語", "👩‍👩‍👧", "<|endoftext|>", "<s>", "<0x41>", "▁", "don't", "x" * 70, "3.14", "́", "  ", "\n\n", "\t", "\x00", "\x85", "\xa0", "﻿", "é"]
    return [(0, None), (1, ""), (2, " "), (3, "▁a"), (4, "plain words here"), (5, "plain words here"), *[(10 + i, r.choice(["", " "]).join(r.choice(words) for _ in range(r.randrange(1, 60)))) for i in range(60)], (90, "word " * 20000)]


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_alignment(spark, odd_texts, most):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in odd_texts], "doc_id long, text string, row int, groups string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.align(df, most_pairs=most).collect()}
    assert got == plain_alignment(odd_texts)
    assert sum(v[0] == 0 for v in got.values()) >= 3


def test_alignment_of_the_table(spark):
    from hashlib import sha256

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (*v[:6], sha256(v[6].encode()).hexdigest() if v[0] else "") for i, v in plain_alignment(rows).items()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, SF).collect()} == want


def test_both_ways_of_encoding(tmp_path, odd_texts):
    """Merging by ids gives what the tokenizers library gives."""
    import json

    quick = token_alignment.byte_level(token_alignment.MODEL_A)
    with open(token_alignment.MODEL_A, encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"]["add_prefix_space"] = True  # not the usual form; the texts begin with a space anyway
    (tmp_path / "other.json").write_text(json.dumps(told))
    slow = token_alignment.byte_level(str(tmp_path / "other.json"))
    texts = [" " + (t or "") for _, t in odd_texts]
    assert all((x == y).all() for x, y in zip(quick.encode(texts), slow.encode(texts), strict=True))


def test_alignment_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    got = token_alignment.align(df).select("doc_id", "n_a", F.try_divide("count_sum", "n_links"), "groups").collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == ["(3, 2, 3.0)", "(3, 2, 3.0)", "(None, 0, None)", "(None, 2, 3.0)"]
    assert token_alignment.align(df.limit(0)).collect() == []
