"""Deduplication operators against brute force, with nulls, ties, repeated rows, clashing columns and empty tables."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import components, exact_dedup, line_dedup, ngram_join, repeats, sketch

WORDS = [f"w{i}" for i in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines long, rep long, word string"


def corpus(seed, n=60):
    """Texts with shared passages, near copies, exact copies, null and empty ones, one long, and odd white space."""
    r = random.Random(seed)
    some = lambda k: [r.choice(WORDS) + r.choice(["", "", "x", "y", str(r.randrange(50))]) for _ in range(k)]
    passage, base = some(30), some(80)
    texts = [None, "", " \t\n ", "one", "one two"]
    for i in range(n):
        w = some(r.randrange(1, 90))
        if i % 4 == 0:
            at = r.randrange(len(w))
            w = w[:at] + passage + w[at:]
        if i % 5 == 0:
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append("".join(x + r.choice([" ", " ", "\n", "  ", "\t", "  "]) for x in w))
    texts += [texts[9], texts[9], texts[12], "\n".join(texts[10:14]) * 6]
    return [(i, t, "en", "s", 0, True, 5, 7, "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(spark, rows, docs):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, prefix_chars=3).collect()}
    assert got == {i: (max(g), len(g), i == max(g)) for g in by.values() for i in g}
    null = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b"), (4, "b")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.exact_dedup(null).select("keep_id", "group_size", "kept").collect())) == ["Row(keep_id=4, group_size=2, kept=True)"] * 2 + ["Row(keep_id=None, group_size=2, kept=True)"] * 2
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def plain_repeats(rows, k):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words_of(t)
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), (i, j))
    out = {}
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] != (i, j) for x in range(j, j + k)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window", [1, 5, 20])
def test_repeats(rows, docs, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(docs, window=window).collect()}
    assert got == plain_repeats(rows, window)


def test_repeats_edges(spark, docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    d = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "x y z x y z"), (3, "q r s"), (3, "q r s")], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(d, window=3).collect()))
    assert got == [(False, 0, 0), (True, 1, 4), (True, 2, 3), (True, 3, 0), (True, 3, 0)]


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_join(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = defaultdict(set)
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {i: (len(sets[i]), find(i), len(links[i])) for i in sets}


@pytest.mark.parametrize("k,percent,group", [(3, 90, 512), (2, 60, 2), (5, 80, 3)])
def test_ngram_join(rows, docs, k, percent, group):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(docs, k=k, percent=percent, group_size=group).collect()}
    assert got == plain_join(rows, k, percent)


def test_ngram_join_edges(spark, docs):
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    d = spark.createDataFrame([(None, "A b c d e f"), (5, "a b c d e f"), (6, None), (7, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(d).collect()}
    assert got == {None: (2, None), 5: (2, None), 6: (0, 6), 7: (0, 7)}


def plain_lines(rows, percent):
    seen, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        lines, gone = (t or "").split("\n"), set()
        for j, line in enumerate(lines):
            s = {w for w in re.split("[ \t\x0b\x0c\r]+", line.lower()) if w}
            if s:
                if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    gone.add(j)
                seen.append(s)
        out[i] = (len(lines), len(gone), None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_line_dedup(rows, docs, percent):
    out = line_dedup.dedup_lines(docs, percent=percent)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == plain_lines(rows, percent)


def test_line_dedup_edges(spark, docs):
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    d = spark.createDataFrame([(None, "a b\nA  B\n\n\n"), (2, "b a\nc"), (3, "z z"), (3, "z z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.dedup_lines(d).collect())
    assert got == [(0, "a b\n\n\n", 1), (2, "c", 1), (3, "z z", 0), (3, "z z", 0)]


def test_line_dedup_where_lines_crowd(spark, monkeypatch):
    """One very common line, a large family of near ones, and lines that share a frequent word only."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(20)]

    def near():
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(20)] = f"n{r.randrange(400)}"
        return " ".join(w)

    def line():
        return r.choice([near, near, lambda: " ".join(base), lambda: "all " + " ".join(f"x{r.randrange(3000)}" for _ in range(12))])()

    rows = [(i, "\n".join(line() for _ in range(3))) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_lines(rows, 80)
    for crowd in (3, 20, 10_000):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        assert {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in line_dedup.dedup_lines(d).collect()} == want
    assert sum(w[1] for w in want.values()) > 200


SHARED = [(None, "p q r s t u v w x y z " * 3 + "a b c d"), (None, "k l"), (None, "a b c d"), (None, None), (4, "m n o p q r s t u"), (4, "e f g\nh i j"), (4, "e f g\nh i j"), (9, "h i j"), (9, "1 2 3 4 5\ne f g")]


def test_texts_that_share_an_id_are_apart(spark):
    """Each id and text goes by an id of its own in the plain versions, in the order of id and hash."""
    d = spark.createDataFrame(SHARED, "doc_id long, text string").repartition(3)
    order = d.distinct().orderBy(F.coalesce("doc_id", F.lit(-1)), F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    number = {(r.doc_id, r.text): i for i, r in enumerate(order)}
    rows = [(i, t) for (_, t), i in number.items()]
    count = lambda xs: sorted(map(str, xs))

    plain = plain_repeats(rows, 3)
    got = repeats.remove_repeats(d, window=3).collect()
    assert count((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == count((i, *plain[number[i, t]]) for i, t in SHARED)
    assert any(r.doc_id is None and r.n_removed for r in got)

    plain = plain_lines(rows, 80)
    got = line_dedup.dedup_lines(d).collect()
    assert count((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == count((i, *plain[number[i, t]]) for i, t in SHARED)

    near = [*SHARED, (None, "K l"), (12, "k L"), (13, "M n o p q r s t u"), (14, "A b c d")]
    out = ngram_join.ngram_join(spark.createDataFrame(near, "doc_id long, text string").repartition(3), k=2).collect()
    assert count((r.doc_id, r.n_shingles) for r in out) == count((i, len(set(zip(w, w[1:])))) for i, t in near for w in [words_of(lowered(t))])
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id and r.doc_id != r.component_id} == {(12, None), (13, 4), (14, None)}
    assert sum(r.first for r in out) == 9 and not any(r.first for r in out if r.doc_id in (12, 13, 14))


def test_near_documents_of_shared_ids(spark):
    import corpus_pipeline as cp

    rows = [(None, "A b c d e f"), (None, "a b c d e f"), (None, "u v w x y z"), (5, "a b c d e f"), (5, "q r s t u v"), (6, "Q r s t u v")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.lower()) for r in cp.near_documents(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted([(None, "a b c d e f"), (None, "u v w x y z"), (5, "q r s t u v")], key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in up}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketch_never_estimates_low(spark):
    import numpy as np

    df = spark.range(3000).select((F.col("id") % 1500).alias("x")).repartition(5)
    items_of = lambda batch: iter([batch.column(0).to_numpy().astype(np.uint64)])
    for levels, want in (((2,), 1), ((1, 2, 16), 2), (tuple(range(1, 16)), 2)):
        s = sketch.count_min(df, items_of, 3000, levels=levels).value
        assert (s.levels(np.arange(1500, dtype=np.uint64)) >= want).all()
        assert (s.levels(np.arange(10**6, 10**6 + 1000, dtype=np.uint64)) > 0).mean() < 0.05


def test_gaps_round_trip():
    import numpy as np

    for x in ([], [0], [0, 1, 254, 255, 256, 511, 5000], [1000]):
        assert sketch.unpack_gaps(sketch.pack_gaps(np.array(x, np.int64))).tolist() == x
