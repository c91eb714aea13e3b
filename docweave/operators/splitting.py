"""From raw text to elements, sections and chunks, as window and fold steps.

A document's elements are rows in order. Rules that look at neighbours are windows over a document; a heading's path is
the last heading of each level above it; runs (paragraphs, table regions, sections) are sums of start flags. Packing
is a fold over one document's blocks, which a task holds as one array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx

TARGET, MOST, OVERLAP = 850, 1000, 200
# Heading patterns of plain text with level and confidence (a numeric one has as many levels as parts), what
# no heading may look like, and lines that are noise in plain text and in page layouts.
HEADINGS = (
    ("chapter_cn", r"^第[0-9一二三四五六七八九十百千零]+[章节部分篇卷](?:\s*\S+.*)?$", 1, 0.97),
    ("numeric", r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})(?:[、.．)]|\s)\s*\S+.*$", None, 0.94),
    ("cn_enum", r"^[一二三四五六七八九十百千零]+[、.．)]\s*\S+.*$", 2, 0.87),
    ("paren_enum", r"^[(（][0-9一二三四五六七八九十百千零]+[)）]\s*\S+.*$", 2, 0.85),
)
DOT_LEADERS = r"\.{4,}|·{3,}|…{2,}"
NOISE = r"^(第?\s*[0-9]+\s*页|page\s*[0-9]+|[0-9]+|[ivxlcdm]+|[-_=]{3,})$"
PAGE_MARKS = r"^(page\s+[0-9]+|[0-9]+\s*/\s*[0-9]+|第\s*[0-9]+\s*页)$"
SENTENCE_END = "[。！？；.!?]$"
HEADING_LEAST = 0.85


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def check_options(target: int, most: int, overlap: int) -> None:
    if target <= 0 or most <= 0 or overlap < 0:
        raise ValueError("sizes must be positive and the overlap not negative")
    if target > most:
        raise ValueError("the target size may not exceed the maximum")
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the maximum")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line; line ends are normalised first."""
    clean = F.regexp_replace(F.col(text_col), "\r\n?", "\n")
    return docs.select(F.col(id_col), F.posexplode(F.split(clean, "\n")).alias("line_no", "line"))


def islands(rows: DataFrame, by: list[str], order: str, blank: Column, name: str) -> DataFrame:
    """Maximal runs of rows that are not blank, numbered from 0 within ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag("__blank", 1, True).over(w)
    r = rows.withColumn("__blank", blank).withColumn("__start", (~F.col("__blank") & before).cast("int"))
    r = r.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return r.filter(~F.col("__blank")).drop("__blank", "__start")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs (runs of lines that are not blank) with their first and last line."""
    runs = islands(lines(docs, id_col, text_col), [id_col], "line_no", F.trim("line") == "", "para_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))), lambda x: x["line"]), "\n")
    return runs.groupBy(id_col, "para_no").agg(text.alias("text"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


def heading_text(line: Column) -> Column:
    """A line as it is looked at for headings: spaces that OCR put into chapter marks, numbers and words of single CJK signs
    are removed."""
    s = fx.collapse(line)
    s = F.regexp_replace(s, "第\\s+([0-9一二三四五六七八九十百千零]+)\\s*([章节部分篇卷])", "第$1$2")
    s = F.regexp_replace(s, r"(?<=[0-9])\s*[.．]\s*(?=[0-9])", ".")
    spaced = "[一-鿿](?: [一-鿿])+"
    whole = F.replace(s, F.lit(" "), F.lit(""))
    mark = f"^(第[0-9一二三四五六七八九十百千零]+[章节部分篇卷]|[0-9]{{1,2}}(?:[.][0-9]{{1,2}}){{0,3}}) ({spaced})$"
    behind = F.concat(F.regexp_extract(s, mark, 1), F.lit(" "), F.replace(F.regexp_extract(s, mark, 2), F.lit(" "), F.lit("")))
    return F.when(s.rlike("^[一-鿿](?: [一-鿿]){2,}$"), whole).when(s.rlike(mark), behind).otherwise(s)


def is_noise(line: Column) -> Column:
    return F.lower(F.trim(line)).rlike(NOISE)


def heading_match(line: Column) -> Column:
    """struct(pattern, level, base) of a line that may be a heading, else null."""
    s = heading_text(line)
    out = F.lit(None)
    for name, pattern, level, base in reversed(HEADINGS):
        number = F.regexp_extract(s, pattern, 1) if level is None else None
        at = F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(6)).cast("int") if level is None else F.lit(level)
        hit = F.struct(F.lit(name).alias("pattern"), at.alias("level"), F.lit(base).alias("base"))
        out = F.when(s.rlike(pattern), hit).otherwise(out)
    odd = (s == "") | (F.length(s) > 60) | s.rlike(SENTENCE_END) | is_noise(s) | s.rlike(DOT_LEADERS)
    return F.when(~odd, out)


def body_like(line: Column) -> Column:
    s = heading_text(line)
    return (s != "") & (s.rlike(SENTENCE_END) | (F.length(s) >= 12))


def headings(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every line that may be a heading with its confidence, from the lines around it: ``keep`` tells those that score
    enough and have some line that is no noise before the next one that does."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    back = Window.partitionBy(id_col).orderBy(F.desc("line_no"))  # a frame that grows, where one that shrinks is evaluated anew for each row
    filled = F.nullif(F.trim(F.col("line")), F.lit(""))
    blank = F.trim(F.col("line")) == ""
    r = rows.withColumns(
        {
            "s": heading_text(F.col("line")),
            "m": heading_match(F.col("line")),
            "prev_blank": F.coalesce(F.lag(blank).over(w), F.lit(True)),
            "next_blank": F.coalesce(F.lead(blank).over(w), F.lit(True)),
            "prev": F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "next": F.last(filled, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    n = F.length("s")
    spaces = F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit("")))
    score = (
        F.col("m.base")
        + F.when(F.col("prev_blank"), 0.03).otherwise(0.0)
        + F.when(F.col("next_blank"), 0.03).otherwise(0.0)
        + F.when(F.coalesce(body_like(F.col("next")), F.lit(False)), 0.04).otherwise(0.0)
        + F.when(F.coalesce(F.col("prev").rlike(SENTENCE_END), F.lit(False)), 0.02).otherwise(0.0)
        + F.when(n <= 20, 0.02).when(n > 40, -0.06).otherwise(0.0)
        - F.when(spaces >= 5, 0.04).otherwise(0.0)
    )
    r = r.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)).withColumn("candidate", F.col("m").isNotNull())
    r = r.withColumn("sure", F.coalesce(F.col("candidate") & (F.col("score") >= HEADING_LEAST), F.lit(False)))
    r = r.withColumn("own", F.sum(F.col("sure").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("has_body", F.max(~F.col("sure") & (F.trim("line") != "") & ~is_noise(F.col("line"))).over(Window.partitionBy(id_col, "own")))
    return r.filter("candidate").select(id_col, "line_no", F.col("s").alias("heading"), F.col("m.pattern").alias("pattern"), F.col("m.level").alias("level"), "score", (F.col("sure") & F.col("has_body")).alias("keep"))


def markdown_lines(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Kind of each Markdown line (heading, code, table, list, blank, paragraph); between fences all is code."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    fence = F.trim("line").startswith("```")
    opened = F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = F.trim("line")
    kind = (
        F.when(F.col("__fence") | (F.col("__open") % 2 == 1), "code")
        .when(s == "", "blank")
        .when(s.rlike("^#{1,6}\\s+\\S"), "heading")
        .when(s.rlike("^\\|.*\\|$"), "table")
        .when(F.col("line").rlike("^\\s*([-*+]|[0-9]+[.)])\\s+\\S"), "list")
        .otherwise("paragraph")
    )
    r = rows.withColumns({"__fence": fence, "__open": opened}).withColumn("kind", kind)
    # a line indented behind a list item goes on with it
    before = F.lag("kind").over(w)
    return r.withColumn("kind", F.when((F.col("kind") == "paragraph") & (before == "list") & F.col("line").rlike("^\\s{2,}\\S"), "list").otherwise(F.col("kind"))).drop("__fence", "__open")


def markdown_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Elements in order: heading, paragraph, list, table or code, with level and heading_path.

    A heading of level L cuts the path to its first L - 1 parts and joins it; a skipped level leaves no gap.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    r = markdown_lines(lines(docs, id_col, text_col), id_col)
    change = (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("blank"))) | (F.col("kind") == "heading")
    fence_end = (F.col("kind") == "code") & (F.trim(F.coalesce(F.lag("line").over(w), F.lit(""))) == "```") & F.trim("line").startswith("```")
    r = r.withColumn("__new", (change | fence_end).cast("int")).withColumn("el", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.filter("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    e = r.groupBy(id_col, "el").agg(F.first("kind").alias("kind"), body.alias("text"), F.min("line_no").alias("line_start"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", "^\\s*(#+)", 1)))
    e = e.withColumn("level", level).withColumn("text", F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("text", "^\\s*#+\\s+|\\s+#+\\s*$", ""))).otherwise(F.rtrim("text")))
    return with_heading_paths(e, id_col, "line_start").select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("line_start")).alias("n"), "kind", "text", "level", "heading_path")


def with_heading_paths(elements: DataFrame, id_col: str, order: str) -> DataFrame:
    """Adds heading_path: one fold over each document's headings in order; the elements take the last one's path."""
    heads = elements.filter("kind = 'heading'").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "level", "text"))).alias("hs"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("path"), F.array().cast(f"array<struct<at:{dict(elements.dtypes)[order]},path:array<string>>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        path = F.concat(F.slice(a["path"], 1, h["level"] - 1), F.array(h["text"]))
        return F.struct(path.alias("path"), F.concat(a["out"], F.array(F.struct(h["at"].alias("at"), path.alias("path")))).alias("out"))

    paths = heads.select(id_col, F.explode(F.aggregate("hs", start, step, lambda a: a["out"])).alias("h")).select(id_col, F.col("h.at").alias(order), F.col("h.path").alias("__path"))
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return elements.join(paths, [id_col, order], "left").withColumn("heading_path", F.coalesce(F.last("__path", ignorenulls=True).over(w), none)).drop("__path")


def sections(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds section_no: sections start at headings of level 2 if the document has any, else 1; headings above the boundary
    that stand alone before it are context only."""
    doc = Window.partitionBy(id_col)
    w = doc.orderBy("n")
    boundary = F.when(F.max((F.col("level") == 2).cast("int")).over(doc) == 1, 2).otherwise(1)
    e = elements.withColumn("__b", boundary).withColumn("__start", F.coalesce((F.col("kind") == "heading") & (F.col("level") <= F.col("__b")), F.lit(False)).cast("int"))
    e = e.withColumn("section_no", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    only = F.min((F.col("kind") == "heading").cast("int")).over(Window.partitionBy(id_col, "section_no")) == 1
    above = F.max("level").over(Window.partitionBy(id_col, "section_no")) < F.col("__b")
    return e.withColumn("context_only", F.coalesce(only & above, F.lit(False))).drop("__b", "__start")


def split_units(text: Column, most: int = MOST) -> Column:
    """Sentences of a long text; a text that is one long sentence is cut in windows of ``most``."""
    s = fx.sentences(text, fx.PACKER_ENDS)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    return F.when(F.length(text) <= most, F.array(text)).when(F.size(s) > 1, s).otherwise(cut)


def pack(units: Column, target: int = TARGET, most: int = MOST, glue: str = "\n\n") -> Column:
    """Units joined greedily: a chunk ends when the next unit would take it over ``most``, or over ``target`` once it has
    reached it. Array of chunks."""
    check_options(target, most, 0)
    sep = len(glue)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, u: Column) -> Column:
        size, nxt = F.length(a["cur"]), F.length(a["cur"]) + sep + F.length(u)
        flush = (size > 0) & (((size >= target) & (nxt > target)) | (nxt > most))
        return F.struct(
            F.when(flush, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(flush | (size == 0), u).otherwise(F.concat(a["cur"], F.lit(glue), u)).alias("cur"),
        )

    return F.aggregate(F.filter(units, lambda u: F.trim(u) != ""), start, step, lambda a: F.when(F.length(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def overlapped(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Each chunk behind the last whole sentences of the one before it that fit in ``overlap``."""

    def tail(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("go"))

        def step(a: Column, s: Column) -> Column:
            fits = a["go"] & (a["n"] + F.length(s) + 2 <= overlap)
            return F.struct(F.when(fits, a["n"] + F.length(s) + 2).otherwise(a["n"]).alias("n"), F.when(fits, F.concat(F.array(s), a["kept"])).otherwise(a["kept"]).alias("kept"), fits.alias("go"))

        return F.aggregate(F.reverse(fx.sentences(c, fx.PACKER_ENDS)), start, step, lambda a: F.array_join(a["kept"], "\n\n"))

    def one(c: Column, i: Column) -> Column:
        before = F.when(i > 0, tail(F.get(chunks, i - 1))).otherwise("")
        return F.when(before == "", c).otherwise(F.concat(before, F.lit("\n\n"), c))

    return F.transform(chunks, one)


def list_items(text: Column) -> Column:
    """The items of a list, each with the lines that go on with it; what stands before the first item belongs to none."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(a: Column, r: Column) -> Column:
        item = F.trim(r).rlike(r"^([-*+]|[0-9]+\.)\s+")
        return F.struct(F.when(item & a["cur"].isNotNull(), F.concat(a["done"], F.array(F.trim(a["cur"])))).otherwise(a["done"]).alias("done"), F.when(item, r).when(a["cur"].isNotNull(), F.concat(a["cur"], F.lit("\n"), r)).alias("cur"))

    return F.aggregate(rows, start, step, lambda a: F.when(a["cur"].isNotNull(), F.concat(a["done"], F.array(F.trim(a["cur"])))).otherwise(a["done"]))


def block_parts(kind: Column, text: Column, most: int = MOST, overlap: int = OVERLAP, row_start: Column | None = None) -> Column:
    """A block in units (text, row_start, row_end, row_count) that are packed whole: itself if it fits; else a table by rows, code
    by lines, a list by items, all other text by sentences; text that is one sentence in windows that overlap."""
    check_options(most, most, overlap)
    plain = lambda t: F.when(F.size(fx.sentences(t, fx.PACKER_ENDS)) > 1, fx.sentences(t, fx.PACKER_ENDS)).otherwise(windows(t, most, overlap))
    items = list_items(text)
    listed = F.flatten(F.transform(items, lambda i: F.when(F.length(i) <= most, F.array(i)).otherwise(plain(i))))
    none = F.lit(None).cast("int")
    bare = lambda ts: F.transform(ts, lambda t: F.struct(t.alias("text"), none.alias("row_start"), none.alias("row_end"), none.alias("row_count")).cast(_PART))
    long = F.when(kind == "code", split_code(text, most, overlap)).when((kind == "list") & (F.size(items) > 1), listed).otherwise(plain(text))
    return F.when(kind == "table", table_parts(text, most, overlap, row_start)).when(F.length(text) <= most, bare(F.array(text))).otherwise(bare(long))


def block_units(kind: Column, text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """The texts of ``block_parts``."""
    return F.transform(block_parts(kind, text, most, overlap), lambda p: p["text"])


#: What a unit tells of the block that it comes from.
ABOUT = "row_start:int,row_end:int,row_count:int,page_start:int,page_end:int,paragraph:int,heading_path:array<string>,sheet_name:string"


def pack_blocks(units: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, about: str = "") -> Column:
    """Chunks of units (struct of text, kind and grp: the number of the block that was split, null for a whole one), packed as by
    ``pack``. Where a chunk ends inside a split block, the next one begins with the last whole sentences or items of it
    that fit in ``overlap``. With ``about`` (more fields of the units) each chunk is a struct of its content and the units
    that it really holds, those carried over too; else just the content."""
    check_options(target, most, overlap)
    unit = f"struct<text:string,kind:string,grp:int{',' + about if about else ''}>"
    more = [f.split(":", 1)[0] for f in about.split(",")] if about else []
    none = F.array().cast("array<struct<at:int,begin:int>>")
    kept = F.filter(F.transform(units, lambda u: u.cast(unit)), lambda u: F.trim(u["text"]) != "")

    def parts(u: Column) -> Column:
        cut = F.when(u["kind"] == "paragraph", fx.sentences(u["text"], fx.PACKER_ENDS)).when(u["kind"] == "list", list_items(u["text"])).otherwise(F.array().cast("array<string>"))
        cut = _let(cut, lambda c: F.when((F.size(c) == 0) & (u["kind"] == "paragraph"), F.array(u["text"])).otherwise(c))
        return F.transform(cut, lambda t: F.struct(t.alias("text"), u["kind"].alias("kind"), u["grp"].alias("grp"), *[u[c].alias(c) for c in more]).cast(unit))

    def sizes(u: Column, i: Column, ps: Column) -> Column:
        """A unit's length, what its parts measure (each with 2 signs behind it), and those that an overlap may hold: ``back`` from the
        part's begin to the unit's end."""
        lens = F.transform(ps, lambda p: F.length(p["text"]) + 2)
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
        few = F.least(F.size(lens), F.lit(overlap // 3 + 1))
        last = lambda xs: F.when(few > 0, F.slice(xs, -few, few)).otherwise(xs)
        ends = lambda xs: F.transform(xs, lambda x, j: F.struct(i.alias("at"), total(F.slice(xs, j + 1, F.size(xs))).alias("back")))
        return _let(lens, lambda xs: F.struct(F.length(u["text"]).alias("len"), u["grp"].alias("grp"), total(xs).alias("total"), _let(last(xs), ends).alias("parts")))

    def step(a: Column, u: Column) -> Column:
        nxt = a["len"] + F.when(a["len"] > 0, 2).otherwise(0) + u["len"]
        flush = (a["len"] > 0) & (((a["len"] >= target) & (nxt > target)) | (nxt > most))
        again = u["grp"].isNotNull() & a["grp"].eqNullSafe(u["grp"])
        carried = F.when(~flush | again, a["tail"]).otherwise(none)
        measured = a["sum"] + u["total"]
        size = F.when(~flush, nxt).otherwise(u["len"] + F.when(again, F.coalesce(a["sum"] - F.get(a["tail"], F.lit(0))["begin"], F.lit(0))).otherwise(0))
        cut = F.struct(a["i"].alias("first"), F.size(carried).alias("carried"), F.coalesce(F.get(carried, F.lit(0))["at"], a["i"]).alias("at"))
        more = F.concat(carried, F.transform(u["parts"], lambda p: F.struct(p["at"].alias("at"), (measured - p["back"]).alias("begin"))))
        return F.struct(
            size.cast("int").alias("len"), u["grp"].alias("grp"), measured.alias("sum"), (F.filter(more, lambda p: measured - p["begin"] <= overlap + 2) if overlap else none).alias("tail"),
            (a["i"] + 1).alias("i"), F.when(flush | (a["len"] == 0), F.concat(a["cuts"], F.array(cut))).otherwise(a["cuts"]).alias("cuts"),
        )

    def cuts(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("len"), F.lit(None).cast("int").alias("grp"), F.lit(0).alias("sum"), none.alias("tail"), F.lit(0).alias("i"), F.array().cast("array<struct<first:int,carried:int,at:int>>").alias("cuts"))
        return F.aggregate(F.transform(x["us"], lambda u, i: sizes(u, i, F.get(x["ps"], i))), start, step, lambda a: a["cuts"])

    def chunk(x: Column, cs: Column, c: Column, k: Column) -> Column:
        until = F.coalesce(F.get(cs, k + 1)["first"], F.size(x["us"]))
        own = F.slice(x["us"], c["first"] + 1, until - c["first"])
        held = F.when(c["carried"] > 0, F.concat(F.slice(F.flatten(F.slice(x["ps"], c["at"] + 1, c["first"] - c["at"])), -c["carried"], c["carried"]), own)).otherwise(own)
        return _let(held, lambda us: F.struct(F.array_join(F.transform(us, lambda u: u["text"]), "\n\n").alias("content"), us.alias("units")))

    # The fold keeps places only: Spark copies its state at each step, and with the texts in it that would grow with the square of their length.
    split = lambda us: F.exists(us, lambda u: u["grp"].isNotNull())
    cut = lambda us: F.when(split(us), F.transform(us, parts)).otherwise(F.transform(us, lambda u: F.array().cast(f"array<{unit}>"))) if overlap else F.transform(us, lambda u: F.array().cast(f"array<{unit}>"))
    out = _let(kept, lambda us: _let(F.struct(us.alias("us"), cut(us).alias("ps")), lambda x: _let(cuts(x), lambda cs: F.transform(cs, lambda c, k: chunk(x, cs, c, k)))))
    return out if about else F.transform(out, lambda c: c["content"])


def unit_metadata(units: Column) -> Column:
    """What a chunk's units say together: first starts, last ends, the most rows, the first sheet, the distinct kinds and heading
    paths in order."""
    each = lambda c: F.transform(units, lambda u: u[c])
    lists = F.array_distinct(F.filter(each("heading_path"), lambda p: F.size(p) > 0))
    firsts, lasts = {c: F.array_min(F.array_compact(each(c))).alias(c) for c in ("page_start", "row_start")}, {c: F.array_max(F.array_compact(each(c))).alias(c) for c in ("page_end", "row_end", "row_count")}
    return F.struct(
        F.array_distinct(each("kind")).alias("block_types"), lists.alias("heading_paths"), *firsts.values(), *lasts.values(),
        F.array_min(F.array_compact(each("paragraph"))).alias("paragraph_start"), F.array_max(F.array_compact(each("paragraph"))).alias("paragraph_end"),
        F.get(F.array_compact(each("sheet_name")), F.lit(0)).alias("sheet_name"),
    )


def align_sections(elements: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Elements (n, kind, text) with the block of a section that they are, both in order: an element that is the next block
    (same kind and text, ends stripped) takes its ``section_no`` and ``block_no`` and goes on to the following one; any other
    stands before the next block as context of its section. Behind the last block what is left belongs to the last
    section, without being context; a document without blocks has section 0."""
    line = F.struct(F.col("section_no").cast("int").alias("section_no"), F.col("block_no").cast("int").alias("block_no"), "kind", F.trim("text").alias("text"))
    b = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(line)).alias("bs"))
    e = elements.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "kind", F.trim("text").alias("text")))).alias("es"))
    row = "struct<n:int,section_no:int,block_no:int,context_only:boolean>"
    both = e.join(b, id_col, "left").withColumn("bs", F.coalesce("bs", F.expr("cast(array() as array<struct<section_no:int,block_no:int,kind:string,text:string>>)")))

    def step(a: Column, x: Column) -> Column:
        nxt = F.get(F.col("bs"), a["i"])
        hit = F.coalesce((nxt["kind"] == x["kind"]) & (nxt["text"] == x["text"]), F.lit(False))
        over = a["i"] >= F.size("bs")
        section = F.when(over, F.coalesce(F.get(F.col("bs"), F.size("bs") - 1)["section_no"], F.lit(0))).otherwise(nxt["section_no"])
        told = F.struct(x["n"].alias("n"), section.alias("section_no"), F.when(~over, nxt["block_no"]).alias("block_no"), (~over & ~hit).alias("context_only")).cast(row)
        return F.struct((a["i"] + hit.cast("int")).alias("i"), F.concat(a["out"], F.array(told)).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.array().cast(f"array<{row}>").alias("out"))
    placed = both.select(id_col, F.explode(F.aggregate("es", start, step, lambda a: a["out"])).alias("x")).select(id_col, "x.n", "x.section_no", "x.block_no", "x.context_only")
    return elements.join(placed, [id_col, "n"])


def heading_prefix(path: Column, content: Column) -> Column:
    """The last heading of the path in Markdown before the content, unless it is there already."""
    mark = F.concat(F.repeat(F.lit("#"), F.least(F.size(path), F.lit(6))), F.lit(" "), F.element_at(path, -1))
    return F.when((F.size(path) == 0) | content.startswith(mark), content).otherwise(F.concat(mark, F.lit("\n\n"), content))


def chunk_elements(elements: DataFrame, id_col: str = "doc_id", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of sections: a table stands alone, code goes with code only, other blocks are packed, each chunk under its
    heading. Long blocks are split by their kind, and chunks inside one overlap. ``metadata`` is merged of the units that a
    chunk holds: kinds, heading paths, pages, rows (where ``elements`` have page_start, page_end, row_start or sheet_name)
    and the first and last element."""
    check_options(target, most, overlap)
    e = sections(elements, id_col).filter("not context_only and not (kind = 'heading')")
    w = Window.partitionBy(id_col).orderBy("n")
    before = F.lag("kind").over(w)
    apart = (F.col("kind") == "table") | (before == "table") | ((F.col("kind") == "code") != (before == "code"))
    change = F.coalesce((F.lag("section_no").over(w) != F.col("section_no")) | apart, F.lit(True))
    e = e.withColumn("run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = F.when(F.length("text") > most, F.col("n").cast("int"))
    have = lambda c, kind: F.col(c).cast(kind) if c in elements.columns else F.lit(None).cast(kind)
    told = [have("page_start", "int").alias("page_start"), have("page_end", "int").alias("page_end"), F.col("n").cast("int").alias("paragraph"), F.col("heading_path"), have("sheet_name", "string").alias("sheet_name")]
    parts = block_parts(F.col("kind"), F.col("text"), most, overlap, have("row_start", "int"))
    unit = lambda p, g: F.struct(p["text"].alias("text"), F.col("kind").alias("kind"), g.alias("grp"), p["row_start"].alias("row_start"), p["row_end"].alias("row_end"), p["row_count"].alias("row_count"), *told)
    e = e.withColumn("units", _let(group, lambda g: F.transform(parts, lambda p: unit(p, g))))  # the block's length is worked out once, not for each unit
    runs = e.groupBy(id_col, "run").agg(F.min_by("heading_path", "n").alias("heading_path"), F.array_sort(F.collect_list(F.struct("n", "units"))).alias("blocks"))
    packed = pack_blocks(F.flatten(F.transform("blocks", lambda b: b["units"])), target, most, overlap, ABOUT)
    c = runs.select(id_col, "run", "heading_path", F.posexplode(packed).alias("piece", "chunk"))
    c = c.withColumns({"content": heading_prefix(F.col("heading_path"), F.col("chunk.content")), "metadata": unit_metadata(F.col("chunk.units"))})
    return c.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("run", "piece")) - 1).alias("chunk_index"), "heading_path", F.array_sort("metadata.block_types").alias("block_types"), "content", "metadata")


def blocks(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Elements that sections are made of, as blocks (section_no, block_no, kind, text, heading_path, section_heading_path,
    section_level): numbers are dense, context that belongs to no section is left out, and an element without a path of its own
    takes its section's."""
    e = sections(elements, id_col).filter("not context_only")
    w = Window.partitionBy(id_col, "section_no").orderBy("n")
    e = e.withColumns({"section_heading_path": F.first("heading_path").over(w), "section_level": F.coalesce(F.first(F.when(F.col("kind") == "heading", F.col("level"))).over(w), F.lit(0)), "block_no": F.row_number().over(w) - 1})
    dense = F.dense_rank().over(Window.partitionBy(id_col).orderBy("section_no")) - 1
    path = F.when(F.size("heading_path") > 0, F.col("heading_path")).otherwise(F.col("section_heading_path"))
    return e.select(id_col, dense.alias("section_no"), "block_no", "n", "kind", F.trim("text").alias("text"), path.alias("heading_path"), "section_heading_path", "section_level")


def under_title(title: Column, content: Column) -> Column:
    """A knowledge item's chunk under the item's title, unless it begins with a heading or there is no title."""
    bare = F.regexp_replace(content, r"(?U)^\s+", "")
    return F.when((F.trim(F.coalesce(title, F.lit(""))) != "") & ~bare.startswith("#"), F.concat(F.lit("# "), title, F.lit("\n\n"), content)).otherwise(content)


def item_chunks(items: DataFrame, id_col: str = "item_id", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of knowledge items (id, title, content), read as plain text, with the title before those without a heading, and
    ``metadata_json`` of what they hold. Items without text have none."""
    told = items.select(id_col, "title", F.col("content").alias("text"))
    c = chunk_elements(text_elements(told, id_col), id_col, target, most, overlap).join(told.select(id_col, "title"), id_col)
    path = F.when(F.size("heading_path") > 0, F.col("heading_path")).when(F.trim("title") != "", F.array("title"))
    meta = F.struct("metadata.*", path.alias("heading_path"), F.col(id_col).alias("knowledge_item_id"), F.col("title").alias("knowledge_item_title"), "chunk_index")
    return c.select(id_col, "chunk_index", under_title(F.col("title"), F.col("content")).alias("content"), F.to_json(meta).alias("metadata_json"))


def document_chunks(docs: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents (id, organization_id, knowledge_base_id, filename, file_type, text) by the parser of their type, with
    where they come from in ``metadata_json``. ``sinks.overwrite_documents`` puts them in place of what was there."""
    c = chunk_elements(elements_of(docs, id_col=id_col, pages=pages), id_col, target, most, overlap)
    c = c.join(docs.select(id_col, "organization_id", "knowledge_base_id", "filename", file_type(F.col("file_type")).alias("file_type")), id_col)
    meta = F.struct("metadata.*", "heading_path", F.col(id_col).alias("document_id"), "filename", "file_type", "chunk_index")
    return c.select("organization_id", "knowledge_base_id", id_col, "chunk_index", "content", F.to_json(meta).alias("metadata_json"))


def quality(chunks: DataFrame, content: str = "content", most: int = MOST) -> DataFrame:
    """Sizes and flaws of chunks, over all of them."""
    n = F.length(content)
    first = F.trim(F.get(F.split(content, "\n"), F.lit(0)))
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(n), 4).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.count_if(n > most).alias("oversized"),
        F.count_if(is_noise(fx.collapse(F.col(content)))).alias("noise"),
        F.count_if(first.rlike("^[,，。.;；:：、)）\\]】]")).alias("suspicious_starts"),
        F.count_if(first.rlike("^\\|[-:| ]+\\|$")).alias("table_fragments"),
    )


def table_markdown(cells: Column) -> Column:
    """Rows of cells as a Markdown table under its first row; pipes are escaped."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(fx.collapse(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(cells, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(F.get(cells, F.lit(0)))), F.array(rule), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), row)), "\n")


def header_votes(first: Column, second: Column) -> Column:
    """Whether a first row is a header: at least two of full, words over numbers, and unlike the second."""
    full = F.forall(first, lambda c: F.trim(c) != "")
    words_then_numbers = F.forall(first, lambda c: ~fx.is_number(c)) & F.exists(second, fx.is_number)
    return full.cast("int") + words_then_numbers.cast("int") + (first != second).cast("int") >= 2


_ENDS = "。！？；.!?;\\n，, "


def windows(text: Column, most: int | Column = MOST, overlap: int = OVERLAP, near: int = 80) -> Column:
    """A long text in windows: each ends at the last boundary within ``near`` signs before ``most``, else at the first one
    as far behind it, else right there; the next begins ``overlap`` earlier, moved on to a boundary, and always
    further than the last one began. ``most`` may differ from row to row."""
    if isinstance(most, int):
        check_options(most, most, overlap)
        most = F.lit(most)
    told = F.struct(text.alias("text"), most.cast("int").alias("most"), F.length(text).alias("n"))
    return _let(told, lambda x: _windows(x["text"], x["most"], x["n"], overlap, near))


def _windows(text: Column, most: Column, n: Column, overlap: int, near: int) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,end:int>>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        back_by = F.least(F.lit(near), most)
        left = F.length(F.regexp_extract(F.substring(text, a["at"] + most - back_by + 1, back_by), f"(?s)^(.*[{_ENDS}])", 1))
        right = F.length(F.regexp_extract(F.substring(text, a["at"] + most + 1, F.lit(near)), f"(?s)^([^{_ENDS}]*[{_ENDS}])", 1))
        end = F.when(a["at"] + most >= n, n).when(left > 0, a["at"] + most - back_by + left).when(right > 0, a["at"] + most + right).otherwise(a["at"] + most)

        def cut(end: Column) -> Column:
            back = F.greatest(end - overlap, F.lit(0))
            skip = F.length(F.regexp_extract(F.substring(text, back + 1, F.lit(max(overlap, 1))), f"(?s)^([^{_ENDS}]*[{_ENDS}]\\s*)", 1))
            nxt = F.when(end >= n, n).when(back + skip > a["at"], F.least(back + skip, end)).otherwise(end)
            return F.struct(nxt.cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), end.cast("int").alias("end")))).alias("out"))

        return F.when(a["at"] >= n, a).otherwise(_let(end, cut))

    rounds = F.floor(n / F.greatest(F.lit(1), most - overlap - near)).cast("int") + 2
    places = F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda a: a["out"])
    pieces = F.transform(places, lambda p: F.regexp_replace(F.substring(text, p["at"] + 1, p["end"] - p["at"]), r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


_ENTRY = "struct<text:string,row:int,alone:boolean>"


def _carried(entries: Column, room: Column, overlap: int, base: Column) -> Column:
    """Lines (text, row, alone) in groups that fit in ``room``, joined by line ends; behind a full group the next one begins with
    its last whole lines that fit in ``overlap`` along with ``base`` signs, if they leave room. Lines that are ``alone``
    (pieces of one that is too long) are groups of their own. No group exceeds the room."""
    none = F.array().cast(f"array<{_ENTRY}>")
    size = lambda xs: F.aggregate(xs, F.lit(-1), lambda a, x: a + F.length(x["text"]) + 1)

    def tail(cur: Column) -> Column:
        begin = F.struct(none.alias("kept"), base.cast("int").alias("n"), F.lit(True).alias("go"))

        def take(a: Column, x: Column) -> Column:
            go = a["go"] & (a["n"] + F.length(x["text"]) + 1 <= overlap)
            return F.struct(F.when(go, F.concat(F.array(x), a["kept"])).otherwise(a["kept"]).alias("kept"), F.when(go, a["n"] + F.length(x["text"]) + 1).otherwise(a["n"]).alias("n"), go.alias("go"))

        return F.aggregate(F.reverse(cur), begin, take, lambda a: a["kept"])

    def step(a: Column, x: Column) -> Column:
        empty = F.size(a["cur"]) == 0
        alone = x["alone"] | F.coalesce(F.get(a["cur"], F.lit(0))["alone"], F.lit(False))
        fits = ~alone & (size(a["cur"]) + 1 + F.length(x["text"]) <= room)
        kept = F.when(alone, none).otherwise(tail(a["cur"])) if overlap else none
        left = _let(kept, lambda k: F.when(size(k) + 1 + F.length(x["text"]) <= room, k).otherwise(none))
        joins = empty | fits
        whole = F.struct(F.when(joins, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"), F.concat(F.when(joins, a["cur"]).otherwise(left), F.array(x)).alias("cur"))
        return whole

    start = F.struct(F.array().cast(f"array<array<{_ENTRY}>>").alias("done"), none.alias("cur"))
    return F.aggregate(entries, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


_PART = "struct<text:string,row_start:int,row_end:int,row_count:int>"


def _entries(rows: Column, room: Column, overlap: int, first: Column) -> Column:
    """Lines with their number (from ``first``, null where that is null); one that is too long as windows of the same number."""

    def one(r: Column, i: Column) -> Column:
        number = (first + i).cast("int")
        whole = F.array(F.struct(r.alias("text"), number.alias("row"), F.lit(False).alias("alone")).cast(_ENTRY))
        cut = F.transform(windows(r, room, overlap), lambda t: F.struct(t.alias("text"), number.alias("row"), F.lit(True).alias("alone")).cast(_ENTRY))
        return F.when(F.length(r) <= room, whole).otherwise(cut)

    return F.flatten(F.transform(rows, one))


def table_parts(text: Column, most: int = MOST, overlap: int = 0, row_start: Column | None = None) -> Column:
    """A Markdown table in parts (text, row_start, row_end, row_count) that each keep the header. Rows stay whole; a part begins
    with the last whole rows of the one before that fit in ``overlap`` beside the header. ``row_start`` is the number of the
    first row below the header; without it rows have no numbers. A row that is too long is cut in windows."""
    first = F.lit(None).cast("int") if row_start is None else row_start
    rows = F.filter(F.transform(F.split(text, "\n"), lambda r: F.rtrim(r)), lambda r: F.trim(r) != "")

    def cut(rows: Column) -> Column:
        has = F.coalesce(F.get(rows, F.lit(1)).rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"), F.lit(False))
        return _let(F.struct(rows.alias("rows"), has.alias("has")), lambda t: F.struct(F.when(t["has"], F.concat(F.get(t["rows"], F.lit(0)), F.lit("\n"), F.get(t["rows"], F.lit(1)), F.lit("\n"))).otherwise("").alias("head"), F.slice(t["rows"], F.when(t["has"], 3).otherwise(1), F.greatest(F.size(t["rows"]), F.lit(1))).alias("body")))

    def part(g: Column, head: Column) -> Column:
        joined = F.concat(head, F.array_join(F.transform(g, lambda x: x["text"]), "\n"))
        return _let(F.array_compact(F.transform(g, lambda x: x["row"])), lambda n: F.struct(joined.alias("text"), F.array_min(n).alias("row_start"), F.array_max(n).alias("row_end"), F.nullif(F.size(F.array_distinct(n)), F.lit(0)).alias("row_count")).cast(_PART))

    def parts(t: Column) -> Column:
        room = F.greatest(F.lit(most) - F.length(t["head"]), F.lit(1))
        n = F.size(t["body"])
        whole = F.struct(text.alias("text"), first.alias("row_start"), (first + n - 1).alias("row_end"), F.when(first.isNotNull(), n).alias("row_count")).cast(_PART)
        several = _let(room, lambda r: F.transform(_carried(_entries(t["body"], r, overlap, first), r, overlap, F.greatest(F.length(t["head"]) - 1, F.lit(0))), lambda g: part(g, t["head"])))
        return F.when((F.length(text) <= most) | (n <= 0), F.array(whole)).otherwise(several)

    return _let(_let(rows, cut), parts)


def split_table(text: Column, most: int = MOST, overlap: int = 0) -> Column:
    """The texts of ``table_parts``."""
    return F.transform(table_parts(text, most, overlap), lambda p: p["text"])


def split_code(text: Column, most: int = MOST, overlap: int = 0) -> Column:
    """A fenced block in parts that each keep the fences. Lines stay whole unless one is too long; a part begins with the last
    whole lines of the one before that fit in ``overlap`` beside the fences."""
    def shells(rows: Column) -> Column:
        fenced = F.get(rows, F.lit(0)).startswith("```")
        closed = fenced & F.trim(F.element_at(rows, -1)).eqNullSafe("```") & (F.size(rows) > 1)
        body = F.slice(rows, F.when(fenced, 2).otherwise(1), F.size(rows) - F.when(fenced, 1).otherwise(0) - F.when(closed, 1).otherwise(0))
        return F.struct(F.when(fenced, F.concat(F.get(rows, F.lit(0)), F.lit("\n"))).otherwise("").alias("first"), F.when(fenced, "\n```").otherwise("").alias("last"), body.alias("body"))

    def parts(t: Column) -> Column:
        shell = F.length(t["first"]) + F.length(t["last"])
        groups = lambda r: _carried(_entries(t["body"], r, overlap, F.lit(None).cast("int")), r, overlap, shell)
        return _let(F.greatest(F.lit(most) - shell, F.lit(1)), lambda r: F.transform(groups(r), lambda g: F.concat(t["first"], F.array_join(F.transform(g, lambda x: x["text"]), "\n"), t["last"])))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(_let(_let(F.split(text, "\n"), shells), parts))


def merged_metadata(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Metadata of chunks from that of their blocks: first starts, last ends, the most rows, the first table keys, and the
    distinct heading paths and kinds in order."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("n", "heading_path"))), lambda x: x["heading_path"])
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"])
    return blocks.groupBy(*by).agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.max("row_count").alias("row_count"),
        F.min_by("sheet_name", F.when(F.col("sheet_name").isNotNull(), F.col("n"))).alias("sheet_name"), F.array_distinct(paths).alias("heading_paths"), F.array_distinct(kinds).alias("block_types"),
    )


def text_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """Plain text as sections: headings that stay (``least`` of them, else the document is one section without heading),
    with all lines up to the next one; what stands before the first is a preface."""
    rows = lines(docs, id_col, text_col)
    kept = headings(rows, id_col).filter("keep").withColumn("__n", F.count("*").over(Window.partitionBy(id_col))).filter(F.col("__n") >= least).select(id_col, "line_no", "heading", "level")
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.join(kept, [id_col, "line_no"], "left").withColumn("section_no", F.sum(F.col("heading").isNotNull().cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull() & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("line"))))), lambda x: x["line"]), "\n")
    return r.groupBy(id_col, "section_no").agg(F.max("heading").alias("heading"), F.max("level").alias("level"), body.alias("text")).filter("heading is not null or text <> ''")


def heading_levels(headings_: DataFrame, id_col: str, order: str) -> DataFrame:
    """Plain text's headings (order, heading, pattern, level) with ``level`` brought in line and ``heading_path``: a heading is at
    most one below the last one's depth, the first is at the top, and one of an enumeration follows its like as a sibling."""
    rows = headings_.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "heading", "pattern", "level"))).alias("hs"))
    part = "struct<heading:string,pattern:string>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("stack"), F.array().cast(f"array<struct<at:{dict(headings_.dtypes)[order]},heading:string,level:int,path:array<string>>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        depth = F.size(a["stack"])
        sibling = h["pattern"].isin("cn_enum", "paren_enum") & F.get(a["stack"], depth - 1)["pattern"].eqNullSafe(h["pattern"])
        level = F.when((h["level"] <= 1) | (depth == 0), 1).when(sibling, depth).otherwise(F.least(h["level"], depth + 1))
        stack = F.concat(F.slice(a["stack"], 1, level - 1), F.array(F.struct(h["heading"].alias("heading"), h["pattern"].alias("pattern")).cast(part)))
        row = F.struct(h["at"].alias("at"), h["heading"].alias("heading"), level.cast("int").alias("level"), F.transform(stack, lambda x: x["heading"]).alias("path"))
        return F.struct(stack.alias("stack"), F.concat(a["out"], F.array(row)).alias("out"))

    out = rows.select(id_col, F.explode(F.aggregate("hs", start, step, lambda a: a["out"])).alias("h"))
    return out.select(id_col, F.col("h.at").alias(order), "h.heading", "h.level", F.col("h.path").alias("heading_path"))


def _elements_of_lines(rows: DataFrame, kept: DataFrame, id_col: str, runs: list[Column] | None = None) -> DataFrame:
    """Headings among lines, and paragraphs (runs of lines that are not blank) between them, with the pages that they are on
    where the lines have any. ``runs`` tells what else ends a paragraph."""
    levels = heading_levels(kept.select(id_col, "line_no", "heading", "pattern", "level"), id_col, "line_no")
    w = Window.partitionBy(id_col).orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.join(levels, [id_col, "line_no"], "left").withColumn("kind", F.when(F.col("heading").isNotNull(), "heading").when(F.trim("line") == "", "blank").otherwise("paragraph"))
    new = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("blank")))
    for other in runs or []:
        new = new | ~other.eqNullSafe(F.lag(other).over(w))
    r = r.withColumns({"el": F.sum(new.cast("int")).over(so_far), "path": F.coalesce(F.last("heading_path", ignorenulls=True).over(so_far), F.array().cast("array<string>"))}).filter("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))), lambda x: x["line"]), "\n")
    pages = [F.min("page").alias("page_start"), F.max("page").alias("page_end")] if "page" in rows.columns else []
    e = r.groupBy(id_col, "el").agg(F.first("kind").alias("kind"), F.coalesce(F.max("heading"), body).alias("text"), F.max("level").alias("level"), F.min_by("path", "line_no").alias("heading_path"), *pages)
    return e.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("el")).alias("n"), "kind", "text", "level", "heading_path", *[c for c in ("page_start", "page_end") if pages])


def text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """Plain text as elements: its headings (where ``least`` of them stay) and the paragraphs between them, else its
    paragraphs only."""
    rows = lines(docs, id_col, text_col)
    kept = headings(rows, id_col).filter("keep").withColumn("__n", F.count("*").over(Window.partitionBy(id_col))).filter(F.col("__n") >= least)
    return _elements_of_lines(rows, kept, id_col)


#: Lines that a page may have; a document's lines are numbered across its pages.
_PAGE_LINES = 1 << 24


def page_lines(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The lines of all pages (id, page_number, text) of a document in one sequence. A page that does not end blank has a blank
    line behind it, unless it is the last: no paragraph goes on over a page's end, but headings and what they rule do."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")
    last = F.max("page_number").over(Window.partitionBy(id_col)) == F.col("page_number")
    split = F.split(clean, "\n")
    kept = F.when(last | (clean == ""), split).otherwise(F.concat(split, F.array(F.lit(""))))
    rows = pages.select(id_col, F.col("page_number").alias("page"), kept.alias("__kept")).select(id_col, "page", F.posexplode("__kept").alias("__at", "line"))
    return rows.select(id_col, (F.col("page").cast("long") * _PAGE_LINES + F.col("__at")).alias("line_no"), "page", "line")


def page_text_elements(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Elements of documents given as text pages (id, page_number, text), with pages and ``splitter``, which says how a document
    was read: by its headings where any of them stays, their sections running across pages; else page by page, each
    being a section (``section_no``) of paragraphs without a heading."""
    rows = page_lines(pages, id_col)
    found = headings(rows, id_col).filter("keep")
    titled = found.select(id_col).distinct().withColumn("__titled", F.lit(True))
    told = rows.join(titled, id_col, "left")
    by_heading = _elements_of_lines(told.filter("__titled").drop("__titled"), found, id_col)
    none = found.limit(0)
    by_page = _elements_of_lines(told.filter("__titled is null").drop("__titled"), none, id_col, [F.col("page")])
    sections_ = F.sum((F.col("kind") == "heading").cast("int")).over(Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    places = (F.dense_rank().over(Window.partitionBy(id_col).orderBy("page_start")) - 1).cast("int")
    return by_heading.withColumns({"section_no": sections_, "splitter": F.lit("pdf_heading_structure")}).unionByName(by_page.withColumns({"section_no": places, "splitter": F.lit("pdf_page_structure")}))


def table_elements(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Table elements of rows of cells (id, sheet, row_no from 0, cells): a run of rows that are not blank is a region, its first
    row a header or not by vote. ``row_start`` and ``row_end`` count the data rows from 1, as in a sheet."""
    blank = F.forall("cells", lambda c: F.trim(c) == "")
    sheet = F.coalesce("sheet", F.lit(""))
    r = islands(cells.withColumn("__sheet", sheet), [id_col, "__sheet"], "row_no", blank, "region")
    t = r.groupBy(id_col, "__sheet", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"), F.min("row_no").alias("first"), F.max("row_no").alias("last"))
    width = F.array_max(F.transform("rows", F.size))
    even = F.transform("rows", lambda x: F.concat(x, F.array_repeat(F.lit(""), F.greatest(width - F.size(x), F.lit(0)))))
    t = t.withColumn("rows", even)
    t = t.withColumn("has_header", (F.size("rows") >= 2) & F.coalesce(header_votes(F.get("rows", F.lit(0)), F.get("rows", F.lit(1))), F.lit(False)))
    names = F.transform(F.sequence(F.lit(0), width - 1), column_name)
    t = t.withColumn("text", table_markdown(F.when(F.col("has_header"), F.col("rows")).otherwise(F.concat(F.array(names), F.col("rows")))))
    n = F.row_number().over(Window.partitionBy(id_col).orderBy("__sheet", "first"))
    none = F.array().cast("array<string>")
    return t.select(id_col, n.alias("n"), F.lit("table").alias("kind"), "text", F.lit(None).cast("int").alias("level"), none.alias("heading_path"), (F.col("first") + 1 + F.col("has_header").cast("int")).cast("int").alias("row_start"), (F.col("last") + 1).cast("int").alias("row_end"), F.nullif("__sheet", F.lit("")).alias("sheet_name"), "has_header")


def column_name(i: Column) -> Column:
    """0 is A, 25 Z, 26 AA; up to three letters."""
    letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(i / 26) - 1), letter(i % 26))).otherwise(F.concat(letter(F.floor((i - 702) / 676)), letter(F.floor((i - 702) / 26) % 26), letter(i % 26)))


#: File types and who reads them; a type is lower-cased, without blanks and a leading dot. Workbooks and word files whose bytes
#: are not at hand are read as the plain text that was extracted from them.
MARKDOWN, PLAIN, DELIMITED, PAGED = ("md", "markdown"), ("txt", "text", "xlsx", "docx"), ("csv",), ("pdf",)


def file_type(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), "^\\.", ""))


def elements_of(docs: DataFrame, type_col: str = "file_type", id_col: str = "doc_id", text_col: str = "text", pages: DataFrame | None = None) -> DataFrame:
    """Elements (id, n, kind, text, level, heading_path, pages, rows and sheet where there are any) of documents by the parser of
    their type: Markdown, plain text, delimited tables, and, for pdf, the ``pages`` (id, page_number, text) of the same ids; without
    any, a text of form feeds is cut at them. Types that none reads are refused when the rows are read."""
    from docweave.sources import files

    kind = file_type(F.col(type_col))
    known = F.when(kind.isin(*MARKDOWN, *PLAIN, *DELIMITED, *PAGED), kind).otherwise(F.raise_error(F.concat(F.lit("no parser for the file type "), F.coalesce(kind, F.lit("null")))))
    told = docs.select(id_col, text_col, known.alias("__type"))
    of = lambda types: told.filter(F.col("__type").isin(*types))
    if pages is None:
        pages = of(PAGED).select(id_col, F.posexplode(F.split(text_col, "\f")).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
    else:
        pages = pages.join(of(PAGED).select(id_col), id_col, "left_semi")
    tables = files.csv_cells(of(DELIMITED).select(F.col(id_col).cast("string").alias("path"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("content")))
    tables = table_elements(tables.withColumn(id_col, F.col("path").cast(docs.schema[id_col].dataType)), id_col).drop("has_header")
    parsed = [markdown_elements(of(MARKDOWN), id_col, text_col), text_elements(of(PLAIN), id_col, text_col), page_text_elements(pages, id_col).drop("section_no", "splitter"), tables]
    out = parsed[0]
    for other in parsed[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
