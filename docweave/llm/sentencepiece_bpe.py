"""SentencePiece encoding and decoding with seeded merge-dropout."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import blocks, free_name, kept_in_worker, make_room, mix, with_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for that sign itself in a text; as two signs at one place it is never part of a piece.
_LITERAL = "\ue000\ue001"
#: Segmentations of words that a worker keeps, over all its tasks; beyond it starts anew.
CACHE = 300_000
_M64 = (1 << 64) - 1
#: Signs of a unit that is segmented together with others, and units that go together (fewer than _FEW go one by one).
_LONG, _TOGETHER, _FEW = 64, 20_000, 100
#: Units of about one length that step together.
_STEPS_TOGETHER = 4_000
#: Signs of a unit whose segmentations are kept; longer ones are segmented for each occurrence.
_KEPT = 20
#: Bytes of text that are encoded at a time.
_BLOCK = 1 << 20
#: A run of accepted candidates is drawn up to this length at once.
_RUN = 1024
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Draws:
    """Runs of accepted candidates between two skipped ones, each candidate skipped with probability ``dropout`` apart from
    all others: the i-th run of a place is a function of its key and i."""

    def __init__(self, dropout: float) -> None:
        self.dropout = dropout
        at_least, chance = [], 1.0
        for _ in range(_RUN):
            chance *= 1 - dropout
            at_least.append(int(chance * (1 << 53)))
        self.at_least = np.array(at_least[::-1], np.uint64)

    def runs(self, keys: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        """The i-th run of each key; _RUN stands for so many accepted and no skip yet."""
        draw = mix(keys + np.asarray(i, np.uint64) * _STEP) >> np.uint64(11)
        return _RUN - np.searchsorted(self.at_least, draw, side="right")

    def drops(self, key: np.uint64, tests: int) -> list[int]:
        """Numbers of the skipped candidates among the first ``tests`` of one place."""
        out: list[int] = []
        at, i = 0, 0
        while self.dropout and at < tests:
            for run in self.runs(np.full(64, key), np.arange(i, i + 64)).tolist():
                at += run
                if at >= tests:
                    break
                if run < _RUN:
                    out.append(at)
                    at += 1
            i += 64
        return out


class Memo:
    """Segmentations of short units as trees. A node is a unit and the numbers of its skipped candidates (under 256, as bytes); it has the ids and
    how many candidates come after the last skip. An occurrence walks from the unit's root by its own draws, so what is
    kept saves work and ties no two occurrences together."""

    def __init__(self) -> None:
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.made: list[tuple[str, bytes]] = []
        self.ids: list[bytes] = []
        self.more = np.zeros(1024, np.int64)

    def add(self, pieces: Pieces, made: list[tuple[str, bytes]]) -> range:
        first = len(self.made)
        for lo in range(0, len(made), _TOGETHER):
            units, drops = zip(*made[lo : lo + _TOGETHER], strict=True)
            ids, tests = pieces.segment_many(units, drops)
            at = len(self.ids)
            self.ids += ids
            if len(self.ids) > len(self.more):
                self.more = np.concatenate([self.more, np.zeros(len(self.ids), np.int64)])
            self.more[at : len(self.ids)] = [n - d[-1] - 1 if d else n for n, d in zip(tests, drops, strict=True)]
        self.made += made
        return range(first, len(self.made))

    def roots(self, pieces: Pieces, units: list[str]) -> np.ndarray:
        """Nodes of the units, -1 for those that are too long to be kept."""
        new = [u for u in set(units).difference(self.root) if len(u) <= _KEPT]
        self.root.update(zip(new, self.add(pieces, [(u, b"") for u in new]), strict=True))
        return np.array([self.root.get(u, -1) for u in units], np.int64)

    def children(self, pieces: Pieces, nodes: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Nodes where after those of ``nodes`` so many more candidates are accepted and the next one is skipped."""
        keys = (nodes << 8 | runs).tolist()
        new = list(set(keys).difference(self.child))
        made = []
        for key in new:
            unit, drops = self.made[key >> 8]
            made.append((unit, drops + bytes([(drops[-1] + 1 if drops else 0) + (key & 255)])))
        self.child.update(zip(new, self.add(pieces, made), strict=True))
        return np.array([self.child[k] for k in keys], np.int64)


class Pieces:
    """A byte-fallback BPE vocabulary: piece -> id and score, byte -> id, id -> bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.bytes_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(self.bytes_ids) != 256:
            raise ValueError("lossless decoding needs a vocabulary with byte fallback")
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {x: r for r, x in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {sp.id_to_piece(i): order[sp.get_score(i)] for i in plain}
        # For many words at once: a sign's id by code point, and the pairs of ids that make a piece, sorted, with its id and rank.
        self.sign_id = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.sign_id[ord(piece)] = i
        self.sign_id[ord(" ")], self.sign_id[ord(SPACE)] = self.sign_id[ord(SPACE)], -1
        made = [(self.ids[x[:k]] << 32 | self.ids[x[k:]], i, self.rank[x]) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in self.ids and x[k:] in self.ids]
        made.sort()
        self.pair, self.pair_id, self.pair_rank = (np.array(c, np.int64) for c in zip(*made, strict=True))
        self.raw: list[bytes] = [b""] * len(ids)
        for i in plain:
            self.raw[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.bytes_ids.items():
            self.raw[i] = bytes([b])
        #: Where no piece has a space after another sign, and none holds a line feed, words can be cut one by one.
        by_word = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) for p in self.ids)
        self.units = re.compile(r"\n| +[^ \n]*|[^ \n]+" if by_word else r"(?s).+")

    def segment(self, unit: str, drops: Sequence[int] = ()) -> tuple[list[int], int]:
        """Ids of one unit (spaces still spaces), and how many candidates had their turn. The agenda holds neighbours whose
        union is a piece, best score first, leftmost on ties; a candidate whose number (in order of turns, from 0) is
        in ``drops``, which ascend, is skipped, and its neighbours go on."""
        # A literal U+2581 must not turn into a space when decoded: it goes through byte fallback, whole.
        sign = [SPACE if c == " " else c if c != SPACE else _LITERAL for c in unit]
        n = len(sign)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        turn, skips = 0, set(drops)
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        # An entry is rank and left place; it holds as long as that place and its neighbour still make that piece.
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank.get(sign[i] + sign[i + 1], -1)) >= 0]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            a = entry & 0xFFFFFFFF
            b = nxt[a]
            if b < 0:
                continue
            piece = sign[a] + sign[b]
            if rank.get(piece, -1) != entry >> 32:
                continue
            turn += 1
            if turn - 1 in skips:
                continue
            sign[a] = piece
            after = nxt[a] = nxt[b]
            nxt[b] = -1
            if after >= 0:
                prev[after] = a
                if (r := rank.get(piece + sign[after], -1)) >= 0:
                    push(agenda, r << 32 | a)
            before = prev[a]
            if before >= 0 and (r := rank.get(sign[before] + piece, -1)) >= 0:
                push(agenda, r << 32 | before)
        out: list[int] = []
        ids, i = self.ids, 0
        while 0 <= i < n:
            found = ids.get(sign[i])
            if found is not None:
                out.append(found)
            else:
                out += [self.bytes_ids[x] for x in (SPACE if sign[i] == _LITERAL else sign[i]).encode()]
            i = nxt[i]
        return out, turn

    def segment_many(self, units: Sequence[str], drops: Sequence[Sequence[int]]) -> tuple[list[bytes], list[int]]:
        """What segment() gives for each unit and its drops, the ids as int32 bytes: all units step together, each taking the
        first entry of its own agenda at every step. Long units and those with signs outside of the vocabulary go one by one."""
        out: list[bytes] = [b""] * len(units)
        turns = [0] * len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        sign = self.sign_id[points]
        at = np.cumsum(size) - size
        known = np.minimum.reduceat(sign, at) >= 0 if len(units) else np.zeros(0, bool)
        some = np.flatnonzero(known & (size <= _LONG)) if len(units) >= _FEW else np.zeros(0, np.int64)
        for i in np.setdiff1d(np.arange(len(units)), some, assume_unique=True).tolist():
            ids, turns[i] = self.segment(units[i], drops[i])
            out[i] = array("i", ids).tobytes()
        if not len(some):
            return out, turns
        some = some[np.argsort(size[some], kind="stable")]
        # short units are done after a few steps, and do not wait for long ones
        for part in np.array_split(some, max(1, len(some) // _STEPS_TOGETHER)):
            self._step_together(part, sign, size, at, drops, out, turns)
        return out, turns

    def _step_together(self, some: np.ndarray, sign: np.ndarray, size: np.ndarray, at: np.ndarray, drops: Sequence[Sequence[int]], out: list[bytes], turns: list[int]) -> None:
        size, old = size[some], at[some]
        at = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(at, size)
        sign = sign[np.repeat(old, size) + place].astype(np.int64)
        n = len(sign)
        # one position more, so that a missing neighbour can be written to and never makes a pair
        sign = np.append(sign, -1)
        nxt, prev = np.arange(1, n + 2), np.arange(-1, n)
        last = at + size - 1
        nxt[last], prev[at], nxt[n], prev[n] = n, n, n, n
        asked = [drops[i] for i in some.tolist()]
        many = np.fromiter(map(len, asked), np.int64, len(asked))
        due = np.full((len(some), int(many.max()) + 1), -1)
        due[np.arange(due.shape[1]) < many[:, None]] = np.fromiter(chain.from_iterable(asked), np.int64, int(many.sum()))
        upto, taken, step = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), 0
        none = np.int64((1 << 62) - 1)
        entry, makes = np.full(n + 1, none), np.zeros(n + 1, np.int64)

        def offer(a: np.ndarray) -> None:
            """The entries of the pairs that begin at these positions."""
            b = nxt[a]
            pair = sign[a] << 32 | np.maximum(sign[b], 0)
            found = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            ok = (self.pair[found] == pair) & (b < n) & (a < n)
            entry[a] = np.where(ok, self.pair_rank[found] << 32 | a, none)
            makes[a] = self.pair_id[found]

        offer(np.arange(n))
        while True:
            first = np.minimum.reduceat(entry[:n], at)
            live = np.flatnonzero(first < none)
            a = first[live] & 0xFFFFFFFF
            if not len(a):
                break
            taken[live] += 1
            skip = due[live, upto[live]] == step
            upto[live[skip]] += 1
            step += 1
            entry[a[skip]] = none
            a = a[~skip]
            b = nxt[a]
            sign[a] = makes[a]
            entry[b], sign[b] = none, -1
            nxt[a] = nxt[b]
            prev[nxt[a]] = a
            offer(a)
            before = prev[a]
            offer(before[before < n])
        live = sign[:n] >= 0
        flat = sign[:n][live].astype(np.int32).tobytes()
        ends = np.cumsum(np.add.reduceat(live, at)) * 4
        lo = 0
        for i, hi, n in zip(some.tolist(), ends.tolist(), taken.tolist(), strict=True):
            out[i], turns[i] = flat[lo:hi], n
            lo = hi

    def encode_many(self, texts: list[str], draws: Draws | None = None, keys: Sequence[int] = (), memo: Memo | None = None) -> list[np.ndarray]:
        """Ids of each text behind the usual leading space; ``keys`` has a number for each text, from which the draws of its
        words follow by their places. An empty text has no ids."""
        draws, memo = draws or Draws(0.0), memo or Memo()
        cut = [self.units.findall(" " + t) if t else [] for t in texts]
        units = [u for mine in cut for u in mine]
        size = np.array([len(mine) for mine in cut], np.int64)
        nodes = memo.roots(self, units)
        place = np.zeros(len(units), np.uint64)
        if draws.dropout:
            at = (np.arange(len(units)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
            place = np.repeat(np.array(keys, np.uint64), size) + at * _PLACE
            open_, i = np.flatnonzero(nodes >= 0), 0
            while len(open_):
                run = draws.runs(place[open_], i)
                hit = run < memo.more[nodes[open_]]
                open_ = open_[hit]
                nodes[open_] = memo.children(self, nodes[open_], run[hit])
                i += 1
        long = np.flatnonzero(nodes < 0).tolist()
        found = [memo.ids[k] for k in nodes.tolist()] if memo.ids else [b""] * len(units)
        alone = [units[k] for k in long]
        drops = [draws.drops(place[k], 3 * len(units[k])) for k in long]  # each union offers two new pairs at most
        for lo in range(0, len(long), _TOGETHER):
            for k, got in zip(long[lo : lo + _TOGETHER], self.segment_many(alone[lo : lo + _TOGETHER], drops[lo : lo + _TOGETHER])[0], strict=True):
                found[k] = got
        ends = np.cumsum(size).tolist()
        return [np.frombuffer(b"".join(found[hi - len(mine) : hi]), np.int32) for mine, hi in zip(cut, ends, strict=True)]

    def decode(self, ids) -> str:  # noqa: ANN001
        """The text again, byte by byte, less the leading space."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode()


_LOADED: dict[str, Pieces] = {}
#: What a worker has segmented with each vocabulary. It depends on no seed, document or place.
_MEMOS: dict[str, Memo] = kept_in_worker("sentencepiece_bpe")


def _pieces(name: str) -> Pieces:
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = Pieces(f.read())
    return _LOADED[name]


def _memo(name: str) -> Memo:
    """The worker's own, as long as it is not full."""
    if name not in _MEMOS or len(_MEMOS[name].made) > CACHE:
        _MEMOS[name] = Memo()
    return _MEMOS[name]


def key_of(doc_id: int | None, text: str | None, copy: int | None, seed: int) -> int:
    """What the draws of a row follow from."""
    head = repr((doc_id, copy)).encode()
    return int.from_bytes(hashlib.blake2b(head + b"\0" + (text or "").encode(), digest_size=8, key=(seed & _M64).to_bytes(8, "little")).digest(), "little")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 7, copy_col: str | None = None, verify: bool = True) -> DataFrame:
    """All columns of ``df`` and ``token_ids`` array<int>, ``n_tokens`` int, ``lossless`` boolean.

    The model file goes to the executors once, through Spark's own files. Every candidate merge of every occurrence of
    a word is skipped with probability ``dropout``, apart from all others, by a hash keyed with ``seed``, the row (its
    id, its text and, if ``copy_col`` is given, its number among the copies of a document) and the word's place in it:
    a rerun or a lost executor gives the same ids, and another seed, document, copy or place another segmentation.
    Rows that are equal in all of these get equal ids.
    ``dropout=0`` is plain encoding. With ``verify`` each text is decoded and compared. There is no shuffle; what a
    worker keeps of words is bounded. Null texts have no ids (an empty array), as empty ones. Columns of ``df`` with one
    of the new names are replaced.
    """
    spark = df.sparkSession
    spark.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]
    new = ("token_ids", "n_tokens", "lossless")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    n, (fed, text_name) = len(kept.columns), with_text(kept, text_col)
    at, of = fed.columns.index(text_name), len(fed.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("sentencepiece_bpe")
        pieces, draws = _pieces(name), Draws(dropout)
        for batch in batches:
            for part in blocks([batch], text_name, limit=_BLOCK):
                kept = part.select(range(n))
                ids, copies, texts = (part.column(k).to_pylist() for k in (of, of + 1, at))
                texts = [t or "" for t in texts]
                keys = [key_of(i, t, c, seed) for i, t, c in zip(ids, texts, copies, strict=True)]
                ids_of = pieces.encode_many(texts, draws, keys, _memo(name))
                ok = [not verify or pieces.decode(got.tolist()) == text for got, text in zip(ids_of, texts, strict=True)]
                flat = np.concatenate(ids_of) if ids_of else np.zeros(0, np.int32)
                sizes = np.array([len(x) for x in ids_of])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists, pa.array(sizes, pa.int32()), pa.array(ok)], names=[*kept.schema.names, "token_ids", "n_tokens", "lossless"])
            pa.default_memory_pool().release_unused()

    copy = F.col(copy_col).cast("long") if copy_col else F.lit(None).cast("long")
    fed = fed.select("*", F.col(id_col).cast("long").alias(free_name(fed, "__id")), copy.alias(free_name(fed, "__copy")))
    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("lossless", T.BooleanType())])
    return fed.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "token_ids", model: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the decoded text. Null ids give a null text, no ids the empty one."""
    df.sparkSession.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        pieces = _pieces(name)
        return ids.map(lambda x: None if x is None else pieces.decode(x))

    return df.withColumn(out_col, text(F.col(ids_col)))
