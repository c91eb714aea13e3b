"""Text expressions. Lengths are code points; whitespace is Unicode's unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"
#: Sentence ends of the packer, and of the answerer (which does not split at an ASCII full stop).
PACKER_ENDS = "。！？；.!?;"
ANSWER_ENDS = "。！？!?；;"


def newlines(s: Column) -> Column:
    """CRLF and CR become LF; the ends are stripped."""
    return F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def collapse(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", "")


def squeeze(s: Column) -> Column:
    """All whitespace removed, lower case: the key of a normalised comparison."""
    return F.lower(F.regexp_replace(s, r"(?U)\s+", ""))


def preview(s: Column, most: int) -> Column:
    c = collapse(s)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


def token_estimate(s: Column) -> Column:
    """Half the length, rounded up; at least 1 unless the text is empty."""
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(s) / 2).cast("int"))).cast("int")


def clip_tokens(s: Column, most: int, suffix: str = "...") -> Column:
    """The text within ``most`` estimated tokens, else its beginning and ``suffix``."""
    room = max(1, 2 * most - 2 * -(-len(suffix) // 2))
    return F.when(token_estimate(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(room)), F.lit(suffix)))


def message_text(s: Column, most: int, suffix: str = "...") -> Column:
    c = collapse(s)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(max(0, most - len(suffix)))), F.lit(suffix)))


def sentences(s: Column, ends: str) -> Column:
    """Split after each of ``ends`` and the whitespace behind it; blank parts are left out."""
    parts = F.split(s, f"(?<=[{ends}])\\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(f"({WORD})"), 1)


def joined_words(s: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def query_terms(s: Column) -> Column:
    """ASCII words of two signs or more in lower case; CJK runs of two or more, and their 4-, 3- and 2-grams where a run
    is longer than four. Distinct, in no stated order."""
    ascii_terms = F.filter(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_]+)"), 1), lambda x: F.length(x) >= 2)
    runs = F.regexp_extract_all(s, F.lit("([一-鿿]{2,})"), 1)

    def grams(run: Column) -> Column:
        sizes = F.array(F.lit(4), F.lit(3), F.lit(2))
        cut = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))))
        return F.when(F.length(run) > 4, F.concat(F.array(run), cut)).otherwise(F.array(run))

    return F.array_distinct(F.concat(ascii_terms, F.flatten(F.transform(runs, grams))))


def history_terms(s: Column) -> Column:
    """As query_terms, with the grams of every run that is long enough for them."""
    ascii_terms = F.filter(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_]+)"), 1), lambda x: F.length(x) >= 2)
    runs = F.regexp_extract_all(s, F.lit("([一-鿿]{2,})"), 1)

    def grams(run: Column) -> Column:
        sizes = F.filter(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda n: n <= F.length(run))
        return F.concat(F.array(run), F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n)))))

    return F.array_distinct(F.concat(ascii_terms, F.flatten(F.transform(runs, grams))))


def entities(s: Column) -> Column:
    """Identifiers (letters, then digits), numbers with a unit, and quoted names; distinct."""
    ids = F.regexp_extract_all(s, F.lit(r"\b([A-Za-z]+[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*)"), 1)
    amounts = F.regexp_extract_all(s, F.lit("([0-9]+(?:\\.[0-9]+)?(?:%|元|天|小时|分钟|年|个月|个工作日))"), 1)
    quoted = F.regexp_extract_all(s, F.lit("[“\"《「]([^”\"》」]{2,40})[”\"》」]"), 1)
    return F.array_distinct(F.concat(ids, amounts, quoted))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


# Redaction of keys, bearer tokens and signed links in log details.
SENSITIVE = "(?i)(password|passwd|secret|token|authorization|api_?key)"


def redact(s: Column) -> Column:
    masked = F.regexp_replace(s, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer <redacted>")
    masked = F.regexp_replace(masked, r'(?i)("(?:password|passwd|secret|token|authorization|api_?key)"\s*:\s*)"[^"]*"', '$1"<redacted>"')
    return F.regexp_replace(masked, r"(https?://[^\s?]+)\?[^\s]*(?i:signature|expires)=[^\s]*", "$1?<redacted>")


def redact_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("<redacted>")).otherwise(redact(v)))


def audit_arguments(m: Column) -> Column:
    """Arguments that name things by id stay, all others are left out of the log."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike("(^|_)ids?$|^(limit|radius|top_k)$"), v).otherwise(F.lit("<omitted>")))


def vector_id(kb: Column, doc: Column, item: Column, index: Column, content: Column) -> Column:
    """A stable id: SHA-256 over the key's JSON, keys in order."""
    n = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"chunk_index": '), n(index), F.lit(', "content_sha256": "'), F.sha2(content, 256), F.lit('", "document_id": '), n(doc), F.lit(', "knowledge_base_id": '), n(kb), F.lit(', "knowledge_item_id": '), n(item), F.lit("}"))
    return F.concat(F.lit("chunk_"), F.sha2(body, 256))


def safe_extension(name: Column) -> Column:
    """The extension in lower case if it is short and plain, else nothing."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,10})$", 1))
    return F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")


def object_key(prefix: Column, org: Column, kb: Column, upload: Column, name: Column) -> Column:
    """Where an upload is stored; a name that climbs out of its folder has no key."""
    bad = name.contains("..") | name.contains("/") | name.contains("\\") | (F.coalesce(F.length(name), F.lit(0)) == 0)
    return F.when(~bad, F.concat(F.concat_ws("/", prefix, org.cast("string"), kb.cast("string"), upload.cast("string"), F.lit("source")), safe_extension(name)))


def label_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def strip_fence(s: Column) -> Column:
    """The inside of a fenced block, or the trimmed text."""
    inner = F.regexp_extract(s, r"(?s)^\s*```[a-zA-Z]*\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(s))


def backoff_seconds(attempt: Column, base: int = 5, most: int = 300) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def column_name(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA; up to three letters. Behind ZZZ the first one goes on by code points, as the SQL's chr does
    (``char`` would begin anew at 256)."""
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(F.lit(65) + c), 8, "0")), "UTF-32")
    one = letter(index % 26)
    n = index.cast("int")
    mid = F.floor((n - 26) / 26).cast("int")
    return F.when(n < 26, one).when(n < 702, F.concat(letter(mid), one)).otherwise(F.concat(letter(F.floor((n - 702) / 676).cast("int")), letter(F.floor((n - 702) / 26).cast("int") % 26), one))


def is_number(s: Column) -> Column:
    return F.replace(F.replace(F.trim(s), F.lit(","), F.lit("")), F.lit("%"), F.lit("")).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def range_label(first_row: Column, last_row: Column, first_col: Column, last_col: Column) -> Column:
    """A sheet's range as A1:D5; rows and columns count from 1."""
    return F.concat(column_name(first_col - 1), first_row, F.lit(":"), column_name(last_col - 1), last_row)


# What a scrap of a page may begin with, and how long it is at most.
SCRAP_STARTS, SCRAP_CHARS = "，。、；：）】》", 24


def is_scrap(s: Column) -> Column:
    """Paragraphs that are left over beside tables: empty, or short and begun by a closing sign."""
    t = F.trim(s)
    return (t == "") | ((F.length(t) <= SCRAP_CHARS) & F.contains(F.lit(SCRAP_STARTS), F.left(t, F.lit(1))))
