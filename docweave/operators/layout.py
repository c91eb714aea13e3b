"""Page geometry: words with boxes to lines, columns, repeated headers and footers, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import text as fx

GAP = 18.0
BUCKETS = 48
HEADER_ZONE, FOOTER_ZONE = 0.12, 0.88


def spans(words: DataFrame, by: list[str], gap: float = GAP) -> DataFrame:
    """Adds span: words of a row part where the space between two is wider than ``gap``."""
    w = Window.partitionBy(*by).orderBy("x0", "x1")
    apart = F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap, F.lit(True))
    return words.withColumn("__new", apart.cast("int")).withColumn("span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def line_text(words: DataFrame, by: list[str], least: float = 1.5) -> DataFrame:
    """One row per line: its words in order, a space only where the gap is wider than ``least``, and the box of all."""
    w = Window.partitionBy(*by).orderBy("x0", "x1")
    glue = F.when(F.coalesce(F.col("x0") - F.lag("x1").over(w) > least, F.lit(False)), " ").otherwise("")
    piece = F.struct("x0", "x1", F.concat(glue, "word").alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["w"]), "")
    return words.withColumn("piece", piece).groupBy(*by).agg(text.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def occupancy(words: DataFrame, by: list[str], width: Column, buckets: int = BUCKETS) -> DataFrame:
    """How many words cover each of ``buckets`` strips of the page's width."""
    b = lambda x: F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(x / width * buckets).cast("int")))
    strip = F.explode(F.sequence(b(F.col("x0")), b(F.col("x1")))).alias("bucket")
    return words.select(*by, strip).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def column_mode(spans_: DataFrame, by: list[str], width: Column) -> DataFrame:
    """double where a page has six spans or more, three wholly left and three wholly right of the middle, and at most a
    fifth across it."""
    mid = width / 2
    c = spans_.groupBy(*by).agg(F.count("*").alias("spans"), F.count_if(F.col("x1") <= mid).alias("left"), F.count_if(F.col("x0") >= mid).alias("right"))
    across = F.col("spans") - F.col("left") - F.col("right")
    double = (F.col("spans") >= 6) & (F.col("left") >= 3) & (F.col("right") >= 3) & (across <= F.col("spans") * 0.2)
    return c.withColumn("mode", F.when(double, "double").otherwise("single"))


def repeated_text(s: Column) -> Column:
    """The form under which headers and footers of different pages are the same."""
    low = fx.collapse(F.lower(s))
    return F.regexp_replace(F.regexp_replace(low, "page\\s+[0-9]+", "page n"), "[0-9]+", "<num>")


def headers_footers(lines: DataFrame, doc: str, height: Column) -> DataFrame:
    """Texts in the top or bottom zone of at least two pages of a document."""
    zone = F.when(F.col("bottom") <= height * HEADER_ZONE, "header").when(F.col("top") >= height * FOOTER_ZONE, "footer")
    z = lines.withColumn("zone", zone).filter("zone is not null").withColumn("norm", repeated_text(F.col("text")))
    return z.groupBy(doc, "zone", "norm").agg(F.count_distinct("page").alias("pages")).filter("pages >= 2")


def outside_tables(lines: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """Lines whose box meets no table's box of their page."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in (*by, "x0", "x1", "top", "bottom")])
    on = (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("top") < F.col("t_bottom")) & (F.col("bottom") > F.col("t_top"))
    for c in by:
        on &= F.col(c) == F.col(f"t_{c}")
    return lines.join(t, on, "left_anti")


def reading_order(lines: DataFrame, by: list[str], column: Column) -> DataFrame:
    return lines.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(column, "top", "x0")))


def lines_of_words(words: DataFrame, by: list[str], apart: float = 4.0) -> DataFrame:
    """Adds line: words from top to bottom start a new line when they lie more than ``apart`` below the line's first word.
    A fold over one page's words."""
    order = F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom", "word")))
    page = words.groupBy(*by).agg(order.alias("ws"))
    kind = "array<struct<line:int,top:double,x0:double,x1:double,bottom:double,word:string>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast(kind).alias("out"))

    def step(a: Column, w: Column) -> Column:
        new = F.coalesce(w["top"] - a["anchor"] > apart, F.lit(True))
        line = (a["line"] + new.cast("int")).cast("int")
        item = F.struct(line.alias("line"), *[w[c].alias(c) for c in ("top", "x0", "x1", "bottom", "word")])
        return F.struct(F.when(new, w["top"]).otherwise(a["anchor"]).alias("anchor"), line.alias("line"), F.concat(a["out"], F.array(item)).cast(kind).alias("out"))

    return page.select(*by, F.explode(F.aggregate("ws", start, step)["out"]).alias("w")).select(*by, "w.*")


#: Signs that open and close, and spaces that joining lines leaves behind.
_OPENING, _CLOSING, _ASCII_ENDS, _ASCII_WORD = r"[(\[{<“‘]", r"[，。！？；：、,.!?;:)\]}>”’]", r"[.!?;:,)\]}]", r"[A-Za-z0-9_\-/]"
_LEFT_SPACES = (
    (r"(?<=[0-9])\s+\.(?=\s*\S)", "."),
    (r"(?<=[一-鿿])\s+(?=[一-鿿])", ""),
    (r"(?<=[A-Za-z0-9])\s+(?=[一-鿿])", ""),
    (r"(?<=[一-鿿])\s+(?=[A-Za-z0-9])", ""),
    (r"(?<=[一-鿿])\s+(?=[，。！？；：、])", ""),
    (r"(?<=[（【《“‘])\s+(?=[一-鿿A-Za-z0-9])", ""),
    (r"(?<=[A-Za-z])\s+(?=[,.!?;:])", ""),
)


def join_lines(texts: Column) -> Column:
    """The lines of a paragraph as one text: a space between two words of ASCII letters and behind ASCII punctuation before
    such a word, none elsewhere; what depends on the line before is told by its last sign, so no line waits for all before it.
    Spaces left between CJK signs, before punctuation and in split numbers are removed."""
    kept = F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")

    def glued(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(xs, i - 1))
            tight = before.isNull() | before.rlike(_OPENING + "$") | x.rlike("^" + _CLOSING)
            spaced = x.rlike("^" + _ASCII_WORD) & (before.rlike(_ASCII_WORD + "$") | before.rlike(_ASCII_ENDS + "$"))
            return F.when(tight | ~spaced, x).otherwise(F.concat(F.lit(" "), x))

        return F.array_join(F.transform(xs, one), "")

    out = fx.collapse(F.get(F.transform(F.array(kept), glued), F.lit(0)))
    for pattern, by in _LEFT_SPACES:
        out = F.regexp_replace(out, pattern, by)
    return fx.collapse(out)


def without_headers_footers(lines: DataFrame, doc: str, height: Column) -> DataFrame:
    """Lines less those in a top or bottom zone whose text stands in that zone on two pages or more of the document. The repeated
    texts come from one aggregate; lines meet them by document, zone and text."""
    zone = F.when(F.col("bottom") <= height * HEADER_ZONE, "header").when(F.col("top") >= height * FOOTER_ZONE, "footer")
    told = lines.withColumns({"__zone": zone, "__norm": repeated_text(F.col("text"))})
    found = headers_footers(lines, doc, height).select(F.col(doc).alias("__doc"), F.col("zone").alias("__z"), F.col("norm").alias("__n"))
    return told.join(found, (F.col(doc) == F.col("__doc")) & (F.col("__zone") == F.col("__z")) & (F.col("__norm") == F.col("__n")), "left_anti").drop("__zone", "__norm")


def page_elements(lines: DataFrame, doc: str, page: str = "page") -> DataFrame:
    """Lines (doc, page, position, text, size, top, bottom) as headings and paragraphs: a line is a heading if it is short
    and larger than its page's median by 1.2; a paragraph ends at a heading, a new page, or a wide gap."""
    p = Window.partitionBy(doc, page)
    w = Window.partitionBy(doc).orderBy(page, "position")
    m = lines.withColumns({"median": F.median("size").over(p), "height": F.median(F.col("bottom") - F.col("top")).over(p)})
    m = m.withColumn("heading", (F.col("size") >= F.col("median") + 1.2) & (F.length("text") <= 40))
    gap = F.col("top") - F.lag("bottom").over(w)
    tall = F.greatest(F.col("bottom") - F.col("top"), F.col("height"))
    new = F.coalesce(F.col("heading") | F.lag("heading").over(w) | (F.lag(page).over(w) != F.col(page)) | (gap > 1.65 * tall), F.lit(True))
    m = m.withColumn("__new", new.cast("int")).withColumn("element", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = join_lines(F.transform(F.array_sort(F.collect_list(F.struct(page, "position", "text"))), lambda x: x["text"]))
    return m.groupBy(doc, "element").agg(F.when(F.first("heading"), "heading").otherwise("paragraph").alias("kind"), joined.alias("text"), F.min(page).alias("page_start"), F.max(page).alias("page_end"))
