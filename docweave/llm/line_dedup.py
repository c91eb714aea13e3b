"""Line dedup by an exact set-similarity join: prefix, positional, length and bitmap filters, then verified Jaccard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, row_key, text_or_empty

PERCENT = 80
#: Words are counted in 2 ** CELL_BITS cells, whatever the input. The table is a literal of the plan, which the driver copies and
#: prints for every job: four times the cells made its texts of over a megabyte each.
CELL_BITS = 16
#: Bits of a word that hold its level of rarity; the others hold its hash.
LEVEL_BITS = 7
#: Sets of at least this size have their bitmap in two halves.
WIDE = 64
#: Rows that a join is about are told in so many cells, so that most others need not meet it.
CELLS = 1 << 20
#: Lines of about one size that chose the same word are first held against a few of them if they are so many.
CROWD, HEADS = 64, 4
_NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    """Lower-cased lines, with blanks for other white space (looked for first: few texts have any)."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.split(F.lower(F.when(other, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)), "\n")


def _cell(told: Column) -> Column:
    return told.bitwiseAND((1 << CELL_BITS) - 1).cast("int")


def _rarity(texts: DataFrame) -> Column:
    """How often words occur, over all texts: for each cell of word hashes the rounded logarithm of its count."""
    words = texts.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    counts = words.groupBy(_cell(F.xxhash64("w")).alias("cell")).count()
    level = F.least(F.floor(F.log2("count") * 1.5), F.lit((1 << LEVEL_BITS - 1) - 1)).cast("int")
    table = [0] * (1 << CELL_BITS)
    found = counts.select("cell", level.alias("level")).toArrow()
    for cell, of in zip(found["cell"].to_pylist(), found["level"].to_pylist(), strict=True):
        table[cell] = of
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # Spark folds it into one literal


def _told(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def _set(line: Column, levels: Column) -> Column:
    """A line's distinct words as longs, rarest first: level above, hash below."""

    def ranked(told: Column) -> Column:
        level = F.coalesce(F.get(levels, _cell(told)).cast("long"), F.lit(0))  # never null, which makes the list of plain longs below
        return F.shiftleft(level, 64 - LEVEL_BITS).bitwiseOR(F.shiftrightunsigned(told, LEVEL_BITS))

    words = F.array_distinct(F.transform(_told(line), ranked))
    gaps = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.sort_array(F.when(gaps, F.array_remove(words, ranked(F.xxhash64(F.lit(""))))).otherwise(words))


def _signed(texts: DataFrame, levels: Column, percent: int) -> DataFrame:
    """A row for each line with words: its place, two hashes of its set, its size, its bitmap and its prefix."""
    place = [c for c in texts.columns if c != "text"]
    lines = texts.select(*place, F.posexplode(_lines(F.col("text"))).alias("pos", "line")).filter(F.trim("line") != "")
    sets = lines.select(*place, "pos", _set(F.col("line"), levels).alias("s")).withColumn("n", F.size("s"))
    n = F.col("n")
    flip = lambda bit, x: F.call_function("shiftleft", bit, x.bitwiseAND(63).cast("int"))
    all_bits = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(flip(F.lit(1).cast("long"), x)))
    odd_bits = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(flip(F.shiftright(x, 6).bitwiseAND(1), x)))
    # A set that no unequal set can be like (n shared of n + 1) has no prefix: equal ones meet by their hashes.
    able = (n * 100 >= (n + 1) * percent) | F.lit(percent == 100)
    length = F.when(able, n - F.ceil(n * percent / 100).cast("int") + 1).otherwise(0)
    prefix = F.transform(F.slice("s", F.lit(1), length), lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    wide = F.when(n >= WIDE, odd_bits).otherwise(F.lit(0).cast("long"))
    return sets.select(*place, "pos", "n", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), all_bits.alias("bits"), wide.alias("odd"), prefix.alias("prefix"))


def _may_match(percent: int, n: Column, m: Column) -> Column:
    """Bitmap and length filters: the words that differ are not too many, and the sizes allow it. Each word flips one bit,
    so the bits that differ never outnumber the words that do. The bitmap comes first: it is cheap and refuses most."""
    # shared <= (n + m - apart) / 2, and shared * (100 + percent) >= percent * (n + m) is asked for
    close = lambda apart: (n + m - apart) * (100 + percent) >= (n + m) * (2 * percent)
    whole = F.col("a.bits").bitwiseXOR(F.col("b.bits"))
    odd = F.col("a.odd").bitwiseXOR(F.col("b.odd"))
    halves = F.bit_count(odd) + F.bit_count(whole.bitwiseXOR(odd))
    return close(F.bit_count(whole)) & (m * 100 >= n * percent) & (n * 100 >= m * percent) & ((F.least(n, m) < WIDE) | close(halves))


def _earlier(parts: list[tuple[Column, Column]]) -> Column:
    """Whether the second of each pair comes before the first, in order of the pairs."""
    (mine, other), *rest = parts
    return (other < mine) | ((other == mine) & _earlier(rest)) if rest else other < mine


def _before(names: list[str]) -> Column:
    return _earlier([(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in names])


def _near_heads(reps: DataFrame, place: list[str], percent: int, scratch: Scratch) -> DataFrame | None:
    """Pairs of a line and a few earlier ones where lines crowd: those that chose the same word (the least or the greatest
    hash of their prefix) and are of about one size. None where none crowd."""
    traits = [*place, "n", "bits", "odd"]
    step = F.log2("n") * 2
    chosen = F.array_distinct(F.array(*[F.struct(w.alias("word"), F.floor(s).cast("int").alias("of_size")) for w, s in ((F.array_min("prefix"), step), (F.array_max("prefix"), step + 0.5))]))
    keyed = reps.filter(F.size("prefix") > 0).select(*traits, F.explode(chosen).alias("x")).select(*traits, "x.word", "x.of_size")
    on = ["word", "of_size"]
    crowds = scratch.put("crowds", keyed.groupBy(*on).count().filter(F.col("count") >= CROWD).select(*on))
    if crowds.isEmpty():
        return None
    part = F.pmod(F.xxhash64(*place), F.lit(HEADS)).alias("part")
    crowded = keyed.join(crowds, on)
    heads = crowded.groupBy(*on, part).agg(F.min(F.struct(*traits)).alias("h")).select(*on, "h.*")
    near = crowded.alias("a").join(heads.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.of_size") == F.col("b.of_size")) & _before(place) & _may_match(percent, F.col("a.n"), F.col("b.n")))
    return scratch.put("heads", _pairs(near, [(f"a.{c}", f"b.{c}") for c in place], place))


def _pairs(met: DataFrame, columns: list[tuple[str, str]], place: list[str]) -> DataFrame:
    """(place, place_0) of joined lines, each pair once."""
    return met.select(*[F.col(a).alias(c) for (a, _), c in zip(columns, place, strict=True)], *[F.col(b).alias(f"{c}_0") for (_, b), c in zip(columns, place, strict=True)]).distinct()


def _word_pairs(marked: DataFrame, place: list[str], percent: int) -> DataFrame:
    """Pairs of an open line and an earlier one that share a word of their prefixes and pass the filters. A row for each
    word of a prefix crosses the network, so it is narrow: word and index, position, size and mark share two longs."""
    high = lambda c: F.shiftleft(c.cast("long"), 32)
    of_word = high(F.col("word")).bitwiseOR(F.col("i").cast("long"))
    of_line = high(F.col("pos")).bitwiseOR(F.col("n").cast("long") * 2 + F.col("open"))
    doc = place[:-1]
    entry = marked.select(*place, "n", "bits", "odd", "open", F.posexplode("prefix").alias("i", "word"))
    entry = entry.select(*doc, "bits", "odd", of_word.alias("of_word"), of_line.alias("of_line"))
    top = lambda c: F.shiftright(F.col(c), 32)
    low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    n, m = F.shiftright(low("a.of_line"), 1), F.shiftright(low("b.of_line"), 1)
    room = F.least(n - low("a.of_word"), m - low("b.of_word")) * (100 + percent) >= (n + m) * percent
    # Both sides are written alike, so that one shuffle serves both; a settled line is a partner only, no later line any more.
    asks = F.col("a.of_line").bitwiseAND(1) * 2 + F.col("b.of_line").bitwiseAND(1) >= 2
    before = _earlier([*[(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in doc], (top("a.of_line"), top("b.of_line"))])
    met = entry.alias("a").join(entry.alias("b"), (top("a.of_word") == top("b.of_word")) & _may_match(percent, n, m) & before & asks & room)
    met = met.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in doc], *[top(f"{s}.of_line").cast("int").alias(f"{s}_pos") for s in "ab"])
    return _pairs(met, [(f"a_{c}", f"b_{c}") for c in place], place)


def _maybe(of: DataFrame, keys: list[str]) -> Column:
    """Whether a row's keys may be among those of ``of``: a look into a table of CELLS bits."""
    cell = lambda: F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")
    bits = np.zeros(CELLS, bool)
    bits[of.select(cell().alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    longs = np.packbits(bits, bitorder="little").view(np.int64)
    table = F.split(F.lit(",".join(map(str, longs.tolist()))), ",").cast("array<bigint>")
    return F.call_function("shiftrightunsigned", F.get(table, F.shiftright(cell(), 6)), cell().bitwiseAND(63)).bitwiseAND(1) == 1


def _marked(reps: DataFrame, settled: DataFrame | None, place: list[str], scratch: Scratch) -> DataFrame:
    """``reps`` with ``open`` 1, or 0 for settled lines. The few that may be settled are a table of their own, so that no
    join is left in the plan: both sides of the next join are then the same scans, which share one shuffle."""
    if settled is None:
        return reps.withColumn("open", F.lit(1))
    maybe = _maybe(settled, place)
    told = reps.filter(maybe).join(settled.withColumn("closed", F.lit(0)), place, "left").withColumn("open", F.coalesce("closed", F.lit(1)))
    return reps.filter(~maybe).withColumn("open", F.lit(1)).unionByName(scratch.put("marked", told.drop("closed")))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of ``pairs`` (place, place_0) the lines whose word sets really are that alike. The lines in question, and only they,
    are read again from the texts that hold them, and cross the network as text, which is smaller than hashes of its words.
    One pair of each line goes first, which settles most lines; the other pairs of those still open follow, with their lines."""
    place = [c for c in pairs.columns if not c.endswith("_0")]
    doc, other = place[:-1], [f"{c}_0" for c in place]
    both = lambda some: some.select(*place).union(some.select(*other))
    ends = scratch.put(f"{name}-ends", both(pairs).distinct())
    lines = texts.filter(_maybe(ends, doc)).select(*doc, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    asked = scratch.put(f"{name}-lines", lines.filter(_maybe(ends, place)).join(ends, place, "left_semi"))
    words = lambda line: F.array_remove(F.array_distinct(F.split(line, " ")), "")
    sets = F.array(F.struct(words("line").alias("a"), words("line_0").alias("b")))  # made once a pair

    def alike(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["a"], pair["b"]))
        return shared * 100 >= (F.size(pair["a"]) + F.size(pair["b"]) - shared) * percent

    def true_ones(some: DataFrame, lines: DataFrame) -> DataFrame:
        first = lines.select(*[F.col(c).alias(f"{c}_0") for c in place], F.col("line").alias("line_0"))
        return some.join(lines, place).join(first, other).filter(F.exists(sets, alike)).select(*place).distinct()

    one = pairs.groupBy(*place).agg(F.min(F.struct(*other)).alias("o")).select(*place, "o.*")
    most = scratch.put(f"{name}-first", true_ones(one, asked))
    rest = scratch.put(f"{name}-rest", pairs.join(most, place, "left_anti").join(one, [*place, *other], "left_anti"))
    out = scratch.put(name, most.union(true_ones(rest, asked.filter(_maybe(both(rest), place)))))
    scratch.drop(f"{name}-ends", f"{name}-lines", f"{name}-first", f"{name}-rest")
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """All columns of ``df`` with ``text_col`` less its removed lines, and ``n_lines`` and ``n_removed`` (longs).

    Texts are split at line feeds; a line's set holds its words, lower-cased. A line is removed if an earlier line
    (smaller id, or same document and earlier line) has a set with ``100 * intersection >= percent * union``; earlier lines
    count whether they stay or not. Lines without words always stay.

    1. Counts of all words, in a table of bounded size, order a line's words by rarity. Two sets that alike share a word
       among the rarest ``n - ceil(n * percent / 100) + 1`` of each: the prefix.
    2. Equal sets (by a 128-bit hash) meet the earliest of them, which stands for all from then on.
    3. Where many lines choose the same word of their prefix, they meet a few early ones of them, and those pairs are
       verified: nearly all members of a large family are settled by a few rows each, never by pairs among themselves.
    4. Lines still open join all distinct lines on each prefix word, with positional, length and bitmap filters; what is
       left is verified on the words themselves.

    Everything is DataFrame operations. Joins are plain equality joins, which adaptive execution splits where a key is
    hot; no list of a key's lines is ever built. Tables between the steps are dropped when the next ones stand. Null texts
    stay null. A null id comes before all others; rows repeated with the same id and text are one document, none earlier
    than the other. Different texts of one id (null too) are documents of their own, in the order of a hash of the text.
    Texts of any length are split whole. An empty table gives no rows. Other columns pass through, whatever their names;
    those named n_lines or n_removed are replaced.
    """
    rest = [c for c in df.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(text_col).isNull().alias("void"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)])
    key = row_key(rows)
    doc = ["doc_id"] if key is None else ["doc_id", "key"]
    rows = rows if key is None else rows.withColumn("key", key)
    texts, place = rows.select(*doc, "text"), [*doc, "pos"]
    scratch = Scratch(df.sparkSession, "line-dedup")

    signed = scratch.put("signed", _signed(texts, _rarity(texts), percent))
    same = ["h1", "h2"]
    shared = signed.groupBy(*same).agg(F.min(F.struct(*place)).alias("h"), F.count("*").alias("lines")).filter("lines > 1").select(*same, "h")
    lines = signed.join(shared, same, "left").withColumn("copy", F.col("h").isNotNull() & (F.struct(*place) != F.col("h")))
    lines = scratch.put("lines", lines.select(*place, "n", "bits", "odd", F.when(~F.col("copy"), F.col("prefix")).alias("prefix"), "copy"))
    scratch.drop("signed")
    reps = lines.filter("not copy")
    near = _near_heads(reps, place, percent, scratch)
    settled = _verified(near, texts, percent, scratch, "settled") if near is not None else None
    met = scratch.put("pairs", _word_pairs(_marked(reps, settled, place, scratch), place, percent))
    found = _verified(met, texts, percent, scratch, "found")
    gone = lines.filter("copy").select(*place).union(found)
    gone = scratch.put("gone", (gone if settled is None else gone.union(settled)).groupBy(*doc).agg(F.collect_set("pos").alias("gone")))
    scratch.drop("lines", "crowds", "heads", "marked", "pairs", "settled", "found")

    # What is removed grows with the input: never broadcast, it does not pass through the driver, and texts are not sorted for it.
    out = rows.join(gone.hint("shuffle_hash"), doc, "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    own = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).cast(df.schema[id_col].dataType)
    new = {id_col: own, text_col: F.when(~F.col("void"), kept)} | {c: F.col(f"_{i}") for i, c in enumerate(rest)}
    return out.select(*[new[c].alias(c) for c in df.columns if c in new], F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
