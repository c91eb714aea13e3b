"""N-gram Jaccard join through a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import LOWER, Scratch, blocks, input_bytes, mix, partitions, text_buffer, text_or_empty, word_bounds, word_hashes
from docweave.llm.components import connected_components
from docweave.llm.sketch import count_min

SHINGLE, PERCENT = 5, 80
#: Texts per group of the matrix.
GROUP = 512
WORD_BYTES = 6
_NO_ID = -(1 << 63)
_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (A-Z lower-cased), and for each text the number before it (n + 1 values). A text of
    fewer words has its whole sequence as its only one; a text without words has none."""
    buf, offsets = text_buffer(texts)
    buf = LOWER[buf]
    starts, ends, upto = word_bounds(buf, offsets)
    words = word_hashes(buf, starts, ends, seed=4)
    n = np.diff(upto)
    counts = np.where(n >= k, n - k + 1, n > 0)
    at = np.repeat(upto[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    left = np.repeat(upto[1:], counts) - at
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        ok = left > i
        out[ok] = mix(out[ok] * _MUL[0] + words[at[ok] + i] + _MUL[1])
    return out, np.concatenate([[0], np.cumsum(counts)])


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    hashes, upto = shingle_hashes(texts, k)
    for a, b in zip(upto, upto[1:], strict=False):
        yield np.unique(hashes[a:b])


def least_overlap(n: int, percent: int) -> int:
    """What a set of n shares at least with any set that it links with."""
    return -(-percent * n // 100)


_SIGNED = "doc_id long, text_key long, n int, set_key binary, home long, prefix array<long>, rest array<int>, tokens binary"


def _signatures(sketch: Broadcast, k: int, percent: int):  # noqa: ANN202
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("set_key", pa.binary()), ("home", pa.int64()), ("prefix", pa.list_(pa.int64())), ("rest", pa.list_(pa.int32())), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch]):
                sets = list(_sets(block.column(1), k))
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                levels = sketch.value.levels(flat)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                rows = []
                for i, (doc_id, told, s) in enumerate(zip(block.column(0).to_pylist(), block.column(2).to_pylist(), sets, strict=True)):
                    if not len(s):
                        rows.append((doc_id, told, 0, None, None, None, None, None))
                        continue
                    raw = s.tobytes()
                    key = hashlib.blake2b(raw, digest_size=16).digest()
                    level = levels[upto[i] : upto[i + 1]]
                    m = len(s) - least_overlap(len(s), percent) + 1
                    # rarest first, then by hash; the set is sorted by hash already
                    head = np.argsort(level, kind="stable")[:m]
                    at = np.flatnonzero(level[head] >= 2)  # a token that is surely alone links with nothing
                    if len(at):
                        home = int(mix(s).min() >> np.uint64(1))
                        rows.append((doc_id, told, len(s), key, home, s[head[at]].view(np.int64), (len(s) - at).astype(np.int32), raw))
                    else:
                        rows.append((doc_id, told, len(s), key, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _open_groups(percent: int):  # noqa: ANN202
    """Rows come sorted by group, its own members before its visitors. Members of one group (GROUP or about so many) are
    held; visitors pass one by one."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int32()), ("opened", pa.int32())])

    class Group:
        def __init__(self) -> None:
            self.ids, self.sets, self.out = [], [], []
            self.links: dict[int, int] = {}
            self.union = None

        def close(self) -> None:
            """Builds the matrix row (the union of tokens) and compares the members with each other."""
            sizes = np.array([len(s) for s in self.sets])
            self.sizes = sizes
            flat = np.concatenate(self.sets)
            self.union, self.at = np.unique(flat, return_inverse=True)
            self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            parent = list(range(len(sizes)))
            marked = np.zeros(len(self.union), np.int32)
            for i in range(len(sizes) - 1):
                mine = self.at[self.starts[i] : self.starts[i] + sizes[i]]
                marked[mine] = 1
                for j in self.linked(marked, sizes[i], i + 1):
                    self.count(self.ids[i], self.ids[j])
                    a, b = _find(parent, i), _find(parent, int(j))
                    if a != b:
                        parent[b] = a
                        self.out.append((self.ids[i], self.ids[j], 0, 0))
                marked[mine] = 0
            self.marked = marked

        def count(self, a: int, b: int) -> None:
            self.links[a] = self.links.get(a, 0) + 1
            self.links[b] = self.links.get(b, 0) + 1

        def linked(self, marked: np.ndarray, n: int, least: int) -> np.ndarray:
            """Members from number ``least`` on that link with the marked set of n tokens."""
            shared = np.add.reduceat(marked[self.at[self.starts[least] :]], self.starts[least:] - self.starts[least])
            return np.flatnonzero(100 * shared >= percent * (n + self.sizes[least:] - shared)) + least

        def visit(self, doc_id: int, tokens: np.ndarray) -> None:
            if self.union is None:
                self.close()
            where = np.searchsorted(self.union, tokens)
            hit = where[self.union[np.minimum(where, len(self.union) - 1)] == tokens]
            n = len(tokens)
            if len(hit) < least_overlap(n, percent):  # no member can share more than the union does
                return
            self.marked[hit] = 1
            roots = set()
            for j in self.linked(self.marked, n, 0):
                self.count(doc_id, self.ids[j])
                roots.add(int(j))
            self.marked[hit] = 0
            self.out += [(doc_id, self.ids[j], 0, 1) for j in self.first_of_each(roots)]

        def first_of_each(self, found: set[int]) -> list[int]:
            """Members that already hang together need one edge only."""
            if not hasattr(self, "parent"):
                number = {d: i for i, d in enumerate(self.ids)}
                self.parent = list(range(len(self.ids)))
                for u, v, _, visited in self.out:
                    if not visited:
                        self.parent[_find(self.parent, number[v])] = _find(self.parent, number[u])
            seen, out = set(), []
            for j in sorted(found):
                if (r := _find(self.parent, j)) not in seen:
                    seen.add(r)
                    out.append(j)
            return out

        def result(self) -> Iterator[pa.RecordBatch]:
            if self.ids and self.union is None:
                self.close()
            rows = self.out + [(d, None, c, None) for d, c in self.links.items()]
            for lo in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 8192], strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, Group()
        for batch in batches:
            for key, visitor, doc_id, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at:
                    yield from group.result()
                    at, group = key, Group()
                tokens = np.frombuffer(raw, np.uint64)
                if not visitor:
                    group.ids.append(doc_id)
                    group.sets.append(tokens)
                elif group.ids:
                    group.visit(doc_id, tokens)
        yield from group.result()

    return run


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, group_size: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``n_links``, ``text_key``, ``first`` of every row: two documents link when
    ``100 * intersection >= percent * union`` of their sets of k-word shingles; a component is named by its smallest id;
    ``n_links`` counts the other *different* sets that a document's set links with. ``text_key`` (the text's xxhash64)
    tells documents of one id apart, and ``first`` is true for the first document of each component, by id and then
    by ``text_key``.

    1. Every whole text becomes a set of 64-bit shingle hashes. A count-min sketch of all of them gives each a level of
       frequency; sets list their tokens rarest first, and only a prefix can hold the first token shared with a
       partner. Tokens that are surely unique drop out; a set with none left is done.
    2. Equal sets form classes; one representative each goes on, so thousands of copies cost one row.
    3. Representatives with the same smallest hash form a group, split when larger than ``group_size``. The token-group
       matrix holds, for each prefix token and group, the range of set sizes and the most tokens left after it.
    4. A representative meets the rows of its own prefix tokens there. Groups whose size range or bound rules out the
       threshold stay closed. To those left it travels with its tokens; if the group's token union shares too few
       with it, it is turned away; else the group opens and each member is verified exactly.
    5. Links within and across groups come back as one edge for each two parts newly joined, never as all pairs, and
       meet in connected components.

    A group holds at most about ``group_size`` sets in a task; its visitors pass by. Texts without words have no
    shingle, no link and are their own component. Rows repeated with the same id are one class if equal. Sets are
    told apart by what they hold, never by ids, so texts that share an id (null too) are documents of their own. A null id is
    the smallest and comes back as null. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    expected = input_bytes(df, text_col) // WORD_BYTES

    def items_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks([batch]):
            yield np.concatenate([*_sets(block.column(1), k), np.zeros(0, np.uint64)])

    sketch = count_min(rows, items_of, expected, depth=1, load=1.0, levels=(1, 2, 16))
    scratch = Scratch(spark, "ngram-join")
    signed = scratch.put("sets", rows.mapInArrow(_signatures(sketch, k, percent), _SIGNED))
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("head")).withColumn("rep", F.xxhash64("set_key"))
    able = signed.filter("home is not null").select("doc_id", "text_key", "set_key", "home", "n")
    small = able.groupBy("set_key", "home", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("head")).withColumn("rep", F.xxhash64("set_key"))
    crowded = small.groupBy("home").agg(F.count("*").alias("size")).filter(F.col("size") > group_size)
    homes = small.join(crowded, "home", "left").select("set_key", "rep", "head.doc_id", "head.text_key", "n", F.xxhash64("home", F.when(F.col("size").isNotNull(), F.pmod(F.xxhash64("set_key"), F.ceil(F.col("size") / group_size)))).alias("grp"))
    reps = scratch.put("reps", homes.join(signed.select("set_key", "doc_id", "text_key", "prefix", "rest", "tokens").filter("tokens is not null"), ["set_key", "doc_id", "text_key"]).drop("doc_id", "text_key").dropDuplicates(["rep", "set_key"]))
    entry = reps.select("rep", "grp", "n", F.explode(F.arrays_zip("prefix", "rest")).alias("t")).select("rep", "grp", "n", F.col("t.prefix").alias("token"), F.col("t.rest").alias("rest"))
    matrix = entry.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("left"))
    shared = matrix.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
    matrix = matrix.join(shared, "token", "left_semi")
    need = F.ceil(F.greatest(F.col("n"), F.col("least")) * percent / 100)
    met = entry.join(matrix.withColumnRenamed("grp", "other"), "token").filter((F.col("other") < F.col("grp")) & (F.col("least") * percent <= F.col("n") * 100) & (F.col("most") * 100 >= F.col("n") * percent) & (F.least("rest", "left") >= need))
    visits = met.select("rep", "other").distinct()
    tokens = reps.select("rep", "tokens")
    seats = reps.select("grp", F.lit(False).alias("visitor"), "rep", "tokens").union(visits.join(tokens, "rep").select("other", F.lit(True), "rep", "tokens"))
    seats = seats.repartition(4 * partitions(spark), "grp").sortWithinPartitions("grp", "visitor")
    found = scratch.put("links", seats.mapInArrow(_open_groups(percent), "u long, v long, links int, opened int"))
    scratch.drop("reps")
    parts = connected_components(found.filter("v is not null").select("u", "v"))
    links = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    joined = parts.join(classes.select("rep", "head"), F.col("rep") == F.col("node")).groupBy("component").agg(F.min("head").alias("least"))
    parts = parts.join(joined, "component").select("node", "least")
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").join(links, "rep", "left").select("set_key", F.coalesce("least", "head").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "text_key", "n", "set_key").join(named, "set_key", "left")
    first = F.col("set_key").isNull() | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    own = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    out = out.withColumn("component", F.coalesce("least.doc_id", "doc_id")).select(own("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), own("component").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", first.alias("first"))
    out = scratch.put("groups", out)
    scratch.drop("sets", "links")
    return out
