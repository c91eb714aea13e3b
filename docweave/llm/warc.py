"""WARC: records from and to bytes, and not-modified revisits resolved to the response that they stand for."""

from __future__ import annotations

import http
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headers that a 304 response may update (RFC 9110, section 15.4.5), lower-cased.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that never name another page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Ranges of time with about as many captures each, so that one URL's history never meets in one task: PARTS of them, each
#: cut in up to PARTS again, for about RANGE_ROWS captures in a range.
PARTS, RANGE_ROWS = 32, 1_000_000

RECORD = "record_id string, warc_type string, target_uri string, warc_date long, http_status int, profile string, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Without scheme, user's ``www.``, default port, fragment, tracking parameters and closing slashes; host in lower
    case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, f"{scheme}([^/?]*)", 1)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(bare, f"{scheme}[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _validator(headers: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.element_at(headers, name), "^W/", "")), F.lit(""))


def _range_of(rows: DataFrame) -> Column:
    """The number of a row's range: bounds are quantiles of the dates, found in two looks."""
    n = rows.count()
    fine = min(PARTS, max(2, -(-n // (PARTS * RANGE_ROWS))))
    at = rows.agg(F.percentile_approx("at", [i / (PARTS * fine) for i in range(1, PARTS * fine)], 100_000).alias("q")).first().q or []
    bounds = sorted(set(at))
    coarse = bounds[fine - 1 :: fine]
    parts = [bounds[i * fine : (i + 1) * fine - 1] for i in range(len(coarse) + 1)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("at")))
    part = below(longs(coarse))
    return F.coalesce(part * PARTS + below(F.get(F.array(*map(longs, parts)), part)), F.lit(-1))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` (record_id, warc_type response/revisit, target_uri, warc_date long, headers with
    lower-case names; http_status int and profile string where there are such columns): ``record_id``, ``url``
    (canonical), ``refers_to``, ``status`` and ``headers``.

    An as-of join finds the latest full response (status 200, or none known) of the same canonical URL with an earlier
    date (on equal dates the greater record id). A revisit whose profile is another than not-modified stands for equal
    bytes, not for a validator: its status is ``other`` and it refers to nothing. Else status is ``resolved`` if an entity tag (weak comparison) or, where either side has none, a date of last
    change is equal on both sides; ``changed`` if they differ or are missing; ``unresolved`` without an earlier
    response. A resolved revisit's headers are the response's, with those updated that a 304 may update; otherwise
    they are its own.

    Histories are cut into ranges of time that hold about as many captures each: a window within each range, then one row
    per range carried forward; a URL with a third of all captures is spread over the ranges. Bodies are not read. Records
    without URL or date resolve to nothing (and are dealt out by their ids); repeated revisits each give a row; null
    headers are none. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    none = F.from_json(F.lit("{}"), "map<string,string>")
    known = lambda c, kind: F.col(c).cast(kind) if c in records.columns else F.lit(None).cast(kind)
    rows = records.filter(F.col("warc_type").isin("response", "revisit")).select(
        "record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url"), F.col("warc_date").cast("long").alias("at"), known("http_status", "int").alias("code"), known("profile", "string").alias("profile"), F.coalesce("headers", none).alias("headers")
    )
    dated = F.col("at").isNotNull() & F.col("url").isNotNull()
    rows = rows.withColumns({"range": _range_of(rows.filter(dated)), "group": F.when(dated, F.col("url")).otherwise(F.concat(F.lit("\x00"), F.coalesce("record_id", F.lit(""))))})
    full = (F.col("warc_type") == "response") & dated & (F.coalesce("code", F.lit(200)) == 200)
    able = rows.withColumn("full", F.when(full, F.struct("at", "record_id", "headers")))
    # A response of the same date is no earlier one: revisits come first.
    before = Window.partitionBy("group", "range").orderBy("at", (F.col("warc_type") == "response").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = able.withColumn("near", F.last("full", ignorenulls=True).over(before)).filter("warc_type = 'revisit'")
    stamp = F.when(F.col("full").isNotNull(), F.struct("at", "record_id"))
    ends = able.groupBy("group", "range").agg(F.max_by("full", stamp).alias("last"))
    # What each range that the URL has is handed by those before it.
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = ends.select("group", "range", F.last("last", ignorenulls=True).over(earlier).alias("final"))
    met = seen.join(reach, ["group", "range"], "left").withColumn("base", F.coalesce("near", "final"))
    theirs, own = F.col("base.headers"), F.col("headers")
    tags = (_validator(own, "etag"), _validator(theirs, "etag"))
    dates = (_validator(own, "last-modified"), _validator(theirs, "last-modified"))
    same = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).otherwise(F.coalesce(dates[0] == dates[1], F.lit(False)))
    other = F.coalesce(~F.contains("profile", F.lit("not-modified")), F.coalesce("code", F.lit(304)) != 304)
    usable = ~other & dated & F.col("base").isNotNull()
    status = F.when(other, "other").when(~usable, "unresolved").when(same, "resolved").otherwise("changed")
    updates = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    out = met.withColumn("status", status)
    return out.select("record_id", "url", F.when(usable, F.col("base.record_id")).alias("refers_to"), "status", F.when(F.col("status") == "resolved", merged).otherwise(own).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the body of the response that they refer to (one join by record id)."""
    bodies = records.filter("warc_type = 'response'").select(F.col("record_id").alias("refers_to"), "body")
    return resolved.join(bodies, "refers_to", "left")


_GZIP, _NEXT = b"\x1f\x8b\x08", b"\r\n\r\nWARC/1."
_STEP = 1 << 16


def _members(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The gzip members one by one, and whether each is whole; of one that is cut or broken what can be read of it. Behind a
    broken one reading goes on at the next place that looks like a member."""
    at = raw.find(_GZIP)
    while at >= 0:
        member, parts, pos = zlib.decompressobj(wbits=31), [], at
        try:
            while pos < len(raw) and not member.eof:
                parts.append(member.decompress(raw[pos : pos + _STEP]))
                pos += _STEP
        except zlib.error:
            pass
        yield b"".join(parts), member.eof
        at = raw.find(_GZIP, min(pos, len(raw)) - len(member.unused_data) if member.eof else at + len(_GZIP))


def _fields(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case name; values of a name that repeats are joined by a comma."""
    out: dict[str, str] = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if colon:
            name = k.strip().lower()
            out[name] = f"{out[name]}, {v.strip()}" if name in out else v.strip()
    return out


def _epoch(date: str) -> int | None:
    try:
        at = datetime.fromisoformat(date)
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def parse_records(raw: bytes, damaged: bool = False) -> Iterator[tuple[str, str, str, int | None, int | None, str | None, dict[str, str], bytes]]:
    """The response and revisit records of one file's bytes (plain, or gzip, usually with a member for each record), as RECORD
    has them. A record that is cut short, or whose length is no number or not what it takes, is passed over, and reading goes
    on at the next record or gzip member; with ``damaged`` it comes out as a row of type ``damaged`` with the id, if it can
    be read, and without a body. A date that is none is null. Only the member at hand is held unzipped."""
    held = b""
    for piece, whole in _members(raw) if raw[:2] == _GZIP[:2] else [(raw, True)]:
        if held and piece.startswith(b"WARC/1."):  # a new record begins, so what was waited for will not come
            yield from (r for r, _ in _parsed(held, True, damaged) if r)
            held = b""
        held, used = held + piece, 0
        for record, used in _parsed(held, not whole, damaged):
            if record:
                yield record
        held = held[used:] if whole else b""
    yield from (r for r, _ in _parsed(held, True, damaged) if r)


def _parsed(data: bytes, final: bool, damaged: bool) -> Iterator[tuple[tuple | None, int]]:
    """Records and how far each reaches. Without ``final`` more bytes may follow, and a record that is not there whole waits."""

    def bad(record_id: str, upto: int) -> tuple[tuple | None, int]:
        return ((record_id, "damaged", "", None, None, None, {}, b"") if damaged else None), upto

    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            if final:
                yield bad("", len(data))
            return
        fields = _fields(data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:])
        length, name = fields.get("content-length", "0"), fields.get("warc-record-id", "")
        if not (length.isascii() and length.isdigit()):
            at = head_end
            yield bad(name, at)
            continue
        end = head_end + 4 + int(length)
        if end > len(data) and not final:
            return
        if end > len(data) or not (b"\r\n\r\n".startswith(data[end : end + 4]) or data.startswith(b"WARC/1.", end)):
            following = data.find(_NEXT, head_end)
            at = following + 4 if following >= 0 else len(data)
            yield bad(name, at)
            continue
        block, at = data[head_end + 4 : end], end
        if (kind := fields.get("warc-type", "")) not in ("response", "revisit"):
            yield None, at
            continue
        top, _, body = block.partition(b"\r\n\r\n")
        first, *lines = top.decode("utf-8", "replace").split("\r\n")
        code = re.match(r"HTTP/\S+ (\d{3})\b", first)
        yield (name, kind, fields.get("warc-target-uri", ""), _epoch(fields.get("warc-date", "")), int(code[1]) if code else None, fields.get("warc-profile"), _fields(lines), body), at


def format_record(record_id: str, kind: str, url: str, when: int, headers: dict[str, str], body: bytes = b"", code: int | None = None, profile: str | None = None) -> bytes:
    """One record as WARC/1.1 bytes; ``parse_records`` gives the same fields again."""
    code = code or (304 if kind == "revisit" else 200)
    block = (f"HTTP/1.1 {code} {http.HTTPStatus(code).phrase}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + body
    date = datetime.fromtimestamp(when, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n" + (f"WARC-Profile: {profile}\r\n" if profile else "") + f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """The records of all files under ``path``, a task for each file (WARC files are cut at about 1 GB by custom; one may have
    2 GB at most, as Spark reads it whole, and is unzipped member by member). With ``damaged`` there is a row of that type
    for each record that had to be passed over."""
    import pyarrow as pa

    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.int64()), ("http_status", pa.int32()), ("profile", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cols[6] = [list(h.items()) for h in cols[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for raw in batch.column(0):
                held = []
                for record in parse_records(raw.as_py() or b"", damaged):
                    held.append(record)
                    if len(held) == 256:
                        yield some(held)
                        held = []
                if held:
                    yield some(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl's records made of a table of pages (page_id, url, html), for the query and the tests: each page's response
    at 10 * page_id, and a revisit of its URL: of every third page five before its response, of the others five
    after. Every seventh revisit bears another entity tag."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    when = F.col("page_id") * 10
    response = pages.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        when.alias("warc_date"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), when.cast("string")).alias("headers"),
    )
    seen = when + F.when(F.col("page_id") % 3 == 0, -5).otherwise(5)
    told = F.when(F.col("page_id") % 7 == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"),
        seen.alias("warc_date"),
        F.create_map(F.lit("etag"), told, F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"), F.lit("date"), seen.cast("string")).alias("headers"),
    )
    return response.union(revisit)
