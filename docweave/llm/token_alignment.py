"""Alignment of two tokenizers over a corpus: groups between common cuts, links of overlapping tokens, and how many
documents hold each linked pair of ids."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, batch_of, blocks, text_or_empty

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids that reach every worker, the most frequent ones: 17 bytes each, 68 MB.
MOST_PAIRS = 4 << 20
#: Pairs that a task adds up before it hands them on.
FLUSH = 4 << 20
SALTS = 16
_BLOCK = 2 << 20
_CODE = 32
_SLICE = 1 << 20
#: The pattern by which byte-level BPE of this kind cuts a text before merging; a fixed value of the format.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Vocabulary:
    """Encodes texts and knows the bytes of every id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.kind = np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32

    def same_bytes(self, ids: np.ndarray, upto: np.ndarray, want: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text whether its ids (``ids[upto[i]:upto[i + 1]]``) joined are its bytes."""
        total = np.concatenate([[0], np.cumsum(self.size[ids])])
        ok = np.diff(total[upto]) == np.diff(offsets)
        text = np.repeat(np.arange(len(ok)), np.diff(upto))
        at = np.flatnonzero(ok[text])  # tokens of texts of the right length
        where = offsets[text[at]] + total[at] - total[upto[text[at]]]  # where in ``want`` each begins
        for lo in range(0, len(at), _SLICE):
            some = ids[at[lo : lo + _SLICE]]
            n = self.size[some]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differs = self.flat[np.repeat(self.start[some], n) + step] != want[np.repeat(where[lo : lo + _SLICE], n) + step]
            ok[text[at[lo : lo + _SLICE]][np.repeat(np.arange(len(some)), n)[differs]]] = False
        return ok


def _byte_signs() -> dict[str, int]:
    """The signs that stand for bytes in byte-level vocabularies: visible Latin-1 signs for themselves, the other bytes in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> Vocabulary:
    """Byte-level BPE from a tokenizer's JSON. Where the ids follow the order of the merges, as they do in vocabularies of
    this kind, and the text is cut by the usual pattern, tiktoken merges by id; else the tokenizers library encodes."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    signs, vocab = _byte_signs(), told["model"]["vocab"]
    added = {x["content"]: x["id"] for x in told["added_tokens"]}
    tokens = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, i in vocab.items():
        tokens[i] = token.encode() if token in added else bytes(signs[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    cut = told["pre_tokenizer"] or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and told["normalizer"] is None
    if usual and None not in made and made == sorted(set(made)) and (not made or max(vocab[c] for c in signs) < made[0]) and not told["model"].get("ignore_merges"):
        import tiktoken

        ranks = {tokens[i]: i for token, i in vocab.items() if token not in added}
        own = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(lambda texts: [own.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts], tokens)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return Vocabulary(lambda texts: [np.array(e.ids, np.int64) for e in own.encode_batch(texts, add_special_tokens=False)], tokens)


def pieces(path: str) -> Vocabulary:
    """A sentencepiece model, which adds the leading space itself; the text is handed over without it."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(own.IdToPiece(i)[3:5], 16)]) if own.IsByte(i) else own.IdToPiece(i).replace("▁", " ").encode() for i in range(own.GetPieceSize())]
    return Vocabulary(lambda texts: [np.array(x, np.int64) for x in own.encode([t[1:] for t in texts], num_threads=1)], tokens)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """By the file's kind; loaded once a process."""
    if path not in _LOADED:
        _LOADED[path] = byte_level(path) if path.endswith(".json") else pieces(path)
    return _LOADED[path]


def _both(models: tuple[str, str]) -> tuple[Vocabulary, Vocabulary]:
    return tuple(vocabulary(SparkFiles.get(m)) for m in models)


_ENCODED = "row long, doc_id long, n_a int, n_b int, a binary, b binary"
_ENCODED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _encode(models: tuple[str, str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _both(models)
        for batch in batches:
            for part in blocks([batch], limit=_BLOCK):
                texts = [" " + t for t in part.column(2).to_pylist()]
                raw = [t.encode() for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                want = np.frombuffer(b"".join(raw), np.uint8)
                good, found = np.array([len(t) > 1 for t in texts]), []
                for v in vocabularies:
                    ids = v.encode(texts)
                    upto = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    good &= v.same_bytes(np.concatenate(ids), upto, want, offsets)
                    found.append(ids)
                sizes = [[len(x) if ok else 0 for x, ok in zip(ids, good, strict=True)] for ids in found]
                packed = [[pa.compress(x.astype(v.kind).tobytes(), "zstd", asbytes=True) if n else None for x, n in zip(ids, size, strict=True)] for v, ids, size in zip(vocabularies, found, sizes, strict=True)]
                yield batch_of(_ENCODED_ARROW, part.column(0), part.column(1), *sizes, *packed)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], vocabularies: tuple[Vocabulary, Vocabulary], most: int = 1 << 20) -> Iterator[tuple[list, list, list[np.ndarray], list[np.ndarray]]]:
    """Rows again with ids, some ``most`` tokens at a time: rows, ids of documents, both texts' token ids."""
    held, n = ([], [], [], []), 0
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in ("row", "doc_id", "n_a", "n_b", "a", "b")}
        for row, doc, n_a, n_b, *packed in zip(*columns.values(), strict=True):
            ids = [np.frombuffer(pa.decompress(raw, k * v.kind(0).itemsize, "zstd", asbytes=True), v.kind).astype(np.int64) if k else np.zeros(0, np.int64) for raw, k, v in zip(packed, (n_a, n_b), vocabularies, strict=True)]
            for to, x in zip(held, (row, doc, *ids), strict=True):
                to.append(x)
            n += n_a + n_b
            if n >= most:
                yield held
                held, n = ([], [], [], []), 0
    if held[0]:
        yield held


class Alignment:
    """Some documents at once: their tokens lie one after the other, and as both tokenizers give a document's own bytes, its
    end is a cut that both have."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> None:
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.ends_a, self.ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        begins = self.ends_a - size_a[self.a]
        first = np.searchsorted(self.ends_b, begins, "right")
        self.times = np.searchsorted(self.ends_b, self.ends_a, "left") - first + 1  # B tokens that each A token meets
        before = np.cumsum(self.times) - self.times
        self.link_a = np.repeat(np.arange(len(self.a)), self.times)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(first - before, self.times)
        self.doc_a = np.repeat(np.arange(len(a)), self.n_a)

    def codes(self) -> np.ndarray:
        """The id pair of each link, A's id above B's."""
        return self.a[self.link_a] << _CODE | self.b[self.link_b]

    def link_docs(self) -> np.ndarray:
        return self.doc_a[self.link_a]

    def of_each(self, weights: np.ndarray) -> np.ndarray:
        """Exact sums of the links' numbers, for each document."""
        upto = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        cuts = np.concatenate([[0], np.cumsum(self.times)])[np.concatenate([[0], np.cumsum(self.n_a)])]
        return np.diff(upto[cuts])

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """For each document the number of its groups, and the groups as ``a1,a2|b1;a3|b2,b3``."""
        common = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, self.ends_a), np.searchsorted(common, self.ends_b)
        tokens_a, tokens_b = (np.cumsum(np.bincount(g, minlength=len(common))) for g in (group_a, group_b))
        order = np.empty(len(self.a) + len(self.b), np.int64)  # ids, with the sign behind each in the two lowest bits
        last_a, last_b = np.isin(np.arange(len(self.a)) + 1, tokens_a, assume_unique=True), np.isin(np.arange(len(self.b)) + 1, tokens_b, assume_unique=True)
        order[np.arange(len(self.a)) + np.concatenate([[0], tokens_b])[group_a]] = self.a << 2 | last_a
        order[np.arange(len(self.b)) + tokens_a[group_b]] = self.b << 2 | 2 * last_b
        text, lengths = _decimal(order >> 2, np.array([44, 124, 59], np.uint8)[order & 3])  # , | ;
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        at = np.concatenate([[0], np.cumsum(self.n_a)])
        counted = np.concatenate([[0], group_a + 1])[at]
        return np.diff(counted), [text[lo : max(lo, hi - 1)].tobytes().decode() for lo, hi in zip(ends, ends[1:], strict=False)]


def _decimal(numbers: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in decimal, a sign behind each, as bytes; and the bytes that each takes."""
    width = len(str(int(numbers.max()))) if len(numbers) else 1
    digits = np.empty((len(numbers), width + 1), np.uint8)
    left = numbers.copy()
    for i in range(width - 1, -1, -1):
        digits[:, i] = 48 + left % 10
        left //= 10
    digits[:, width] = sign
    lengths = 1 + np.searchsorted(10 ** np.arange(1, width), numbers, "right") + 1 if width > 1 else np.full(len(numbers), 2)
    return digits[np.arange(width + 1) >= width + 1 - lengths[:, None]], lengths


def encoded(df: DataFrame, id_col: str, text_col: str, models: tuple[str, str]) -> DataFrame:
    """One row per row of ``df`` with both tokenizers' ids, packed; none where the tokens do not give space and text."""
    for m in models:
        df.sparkSession.sparkContext.addFile(m)
    names = tuple(m.rsplit("/", 1)[-1] for m in models)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).try_cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_encode(names), _ENCODED)


def pair_counts(tokens: DataFrame, models: tuple[str, str] = (MODEL_A, MODEL_B)) -> DataFrame:
    """``a``, ``b``, ``docs`` (how many rows of ``encoded`` hold the two ids linked) and ``best`` (no other b has more with
    this a). Each task adds its rows up first; partial counts then meet by pair and salt, and again by pair."""
    names = tuple(m.rsplit("/", 1)[-1] for m in models)
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("salt", pa.int32()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _both(names)
        salt, held, waiting = TaskContext.get().partitionId() % SALTS, [], 0
        codes, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([codes, *held]), return_inverse=True)
            total = np.bincount(at[len(codes) :], minlength=len(every))
            total[at[: len(codes)]] += docs
            return every, total

        def out() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(codes), 1 << 16):
                some = codes[lo : lo + (1 << 16)]
                yield batch_of(schema, (some >> _CODE).astype(np.int32), (some & (1 << _CODE) - 1).astype(np.int32), np.full(len(some), salt, np.int32), docs[lo : lo + (1 << 16)])

        for _, _, a, b in _unpacked(batches, vocabularies):
            found = Alignment(a, b, vocabularies[0].size, vocabularies[1].size)
            every, where = np.unique(found.codes(), return_inverse=True)
            once = np.unique(found.link_docs() * len(every) + where)  # a document counts a pair once
            held.append(every[once % max(len(every), 1)])
            waiting += len(held[-1])
            if waiting >= FLUSH:
                codes, docs = merged()
                held, waiting = [], 0
                if len(codes) >= FLUSH:
                    yield from out()
                    codes, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, docs = merged()
        yield from out()

    parts = tokens.filter("n_a > 0").mapInArrow(run, "a int, b int, salt int, docs long")
    summed = parts.groupBy("a", "b", "salt").agg(F.sum("docs").alias("docs")).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    most = summed.groupBy(F.col("a").alias("of")).agg(F.max("docs").alias("most"))
    return summed.join(most, F.col("a") == F.col("of")).select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


@dataclass
class Counts:
    """Pairs' counts in the order of their codes."""

    codes: np.ndarray
    docs: np.ndarray
    best: np.ndarray

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each code is here, its count and whether it is its A id's best; zero and False if it is not."""
        if not len(self.codes):
            return (np.zeros(len(codes), bool),) * 2 + (np.zeros(len(codes), np.int64),)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = self.codes[at] == codes
        return here, np.where(here, self.best[at], False), np.where(here, self.docs[at], 0)


def frequent(counts: DataFrame, most: int = MOST_PAIRS) -> tuple[Counts, int]:
    """The pairs with at least so many documents that no more than ``most`` pairs have as many; and that number (0: all)."""
    by_size = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = 0, 0
    for r in by_size:  # 63 powers at most
        total += r["count"]
        if total > most:
            least = 1 << r["power"] + 1
            break
    got = counts.filter(F.col("docs") >= least).toArrow()
    codes = got["a"].to_numpy().astype(np.int64) << _CODE | got["b"].to_numpy()
    order = np.argsort(codes)
    return Counts(codes[order], got["docs"].to_numpy()[order], got["best"].to_numpy(zero_copy_only=False)[order]), least


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _aligned(names: tuple[str, str], counts: Broadcast):  # noqa: ANN202
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _ALIGNED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _both(names)
        for rows, docs, a, b in _unpacked(batches, vocabularies):
            found = Alignment(a, b, vocabularies[0].size, vocabularies[1].size)
            every, where = np.unique(found.codes(), return_inverse=True)
            _, best, n = counts.value.of(every)
            n_groups, groups = found.groups()
            yield batch_of(kinds, rows, docs, found.n_a, found.n_b, n_groups, found.of_each(np.ones(len(where), np.int64)), found.of_each(best[where]), found.of_each(n[where]), groups)

    return run


def _left_over(names: tuple[str, str], counts: Broadcast):  # noqa: ANN202
    schema = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _both(names)
        for rows, _, a, b in _unpacked(batches, vocabularies):
            found = Alignment(a, b, vocabularies[0].size, vocabularies[1].size)
            every, where = np.unique(found.codes(), return_inverse=True)
            rare = ~counts.value.of(every)[0]
            links = rare[where]
            each, times = np.unique(found.link_docs()[links] * len(every) + where[links], return_counts=True)
            code = every[each % max(len(every), 1)]
            yield batch_of(schema, np.array(rows, np.int64)[each // max(len(every), 1)], (code >> _CODE).astype(np.int32), (code & (1 << _CODE) - 1).astype(np.int32), times)

    return run


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_a`` and ``n_b`` (tokens of space and text by either tokenizer), ``n_groups``
    (stretches between cuts that both have), ``n_links`` (pairs of tokens that overlap), ``n_best`` (links whose ids are
    linked in as many documents as any pair of that A id), ``count_sum`` (over the links, the documents that hold their
    ids linked) and ``groups`` (``a1,a2|b1;a3|b2,b3``).

    1. Texts are encoded once, checked byte by byte against space and text, and their ids written to the shared folder:
       later steps never encode again, whatever executors are lost.
    2. Ends of tokens are running sums; common cuts are their intersection; each A token's B tokens follow from two
       searches, and repeats make the links. Pairs are counted once a document, added up in each task, then by pair and
       salt, then by pair. No row leaves a task for each link.
    3. The most frequent pairs, at most ``most_pairs``, reach every worker and are looked up beside the scan. Pairs rarer
       than those, if there are any, are joined by a shuffle; a pair that is a hot key is never among them.

    A row counts as a document: repeated rows count each. Null and empty texts, and texts whose tokens do not give space
    and text, have no tokens: zeros and empty ``groups``. Ids are cast to long (null where they are no numbers); a null
    id stays null. Strings of special tokens are plain text. Texts are encoded whole, whatever their length. An empty
    table gives no rows. Other columns are left out, so their names cannot clash.
    """
    spark, models = df.sparkSession, (model_a, model_b)
    names = tuple(m.rsplit("/", 1)[-1] for m in models)
    scratch = Scratch(spark, "alignment")
    tokens = scratch.put("tokens", encoded(df, id_col, text_col, models))
    counts = scratch.put("pairs", pair_counts(tokens, models))
    known, least = frequent(counts, most_pairs)
    known = spark.sparkContext.broadcast(known)
    out = tokens.mapInArrow(_aligned(names, known), _ALIGNED)
    if least:
        rare = tokens.filter("n_a > 0").mapInArrow(_left_over(names, known), "row long, a int, b int, times long")
        rest = rare.join(counts.filter(F.col("docs") < least), ["a", "b"])
        rest = rest.groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more"))
        out = out.join(rest, F.col("row") == F.col("of"), "left")
        added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
        out = out.withColumns(added).drop("of", "more_best", "more")
    return out.drop("row")
