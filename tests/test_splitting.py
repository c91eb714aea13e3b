"""Splitting on small literals."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as fx
from docweave.operators import splitting

HANDBOOK = "# Handbook\n\nWelcome text here.\n\n## Leave\n\nLeave is granted on request.\n\n### Types\n\n- annual\n- sick\n  with a note\n\n## Pay\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\nx = 1\n\ny = 2\n```\n"


def test_markdown_elements_and_paths(spark):
    e = splitting.markdown_elements(spark.createDataFrame([(1, HANDBOOK)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.kind, r.level) for r in e] == [("heading", 1), ("paragraph", None), ("heading", 2), ("paragraph", None), ("heading", 3), ("list", None), ("heading", 2), ("table", None), ("code", None)]
    assert e[5].heading_path == ["Handbook", "Leave", "Types"]
    assert e[5].text == "- annual\n- sick\n  with a note"
    assert e[8].heading_path == ["Handbook", "Pay"]
    assert e[8].text == "```\nx = 1\n\ny = 2\n```"


def test_chunks_carry_their_heading(spark):
    c = splitting.chunk_elements(splitting.markdown_elements(spark.createDataFrame([(1, HANDBOOK)], "doc_id long, text string"))).orderBy("chunk_index").collect()
    assert c[0].content.startswith("# Handbook\n\nWelcome")
    assert any(r.content == "## Pay\n\n| a | b |\n| --- | --- |\n| 1 | 2 |" for r in c)
    assert [r.chunk_index for r in c] == list(range(len(c)))


@pytest.mark.parametrize("target,most,overlap", [(0, 1, 0), (2, 1, 0), (1, 1, 1), (1, 2, -1)])
def test_options_are_checked(target, most, overlap):
    with pytest.raises(ValueError):
        splitting.check_options(target, most, overlap)


def plain_pack(units, target, most, glue):
    out, cur = [], ""
    for u in units:
        nxt = len(cur) + len(glue) + len(u)
        if cur and ((len(cur) >= target and nxt > target) or nxt > most):
            out.append(cur)
            cur = u
        else:
            cur = cur + glue + u if cur else u
    return [*out, cur] if cur else out


def test_pack_is_greedy(spark):
    units = ["a" * n for n in (3, 4, 2, 9, 1, 1, 6, 20, 2)]
    got = spark.createDataFrame([(units,)], "u array<string>").select(splitting.pack(F.col("u"), 8, 12, " ").alias("p")).first().p
    assert got == plain_pack(units, 8, 12, " ")


def test_overlap_takes_whole_sentences(spark):
    chunks = ["One two. Three four.", "Five."]
    got = spark.createDataFrame([(chunks,)], "c array<string>").select(splitting.overlapped(F.col("c"), 15).alias("o")).first().o
    assert got == ["One two. Three four.", "Three four.\n\nFive."]


def test_ocr_headings(spark):
    s = spark.createDataFrame([("第 一 章 总则",), ("1 . 1 范围",)], "s string").select(splitting.heading_text(F.col("s")).alias("h"), splitting.heading_match(F.col("s")).alias("m")).collect()
    assert [r.h for r in s] == ["第一章 总则", "1.1 范围"]
    assert [r.m.level for r in s] == [1, 2]


def test_outline_without_bodies_keeps_no_heading(spark):
    rows = splitting.lines(spark.createDataFrame([(1, "1. One\n2. Two\n3. Three")], "doc_id long, text string"))
    assert splitting.headings(rows).filter("keep").count() == 0


def test_expressions(spark):
    r = spark.sql("select 'ab  cd　e' as s").select(
        fx.collapse(F.col("s")).alias("c"), fx.squeeze(F.col("s")).alias("q"), fx.preview(F.lit("abcdefghij"), 8).alias("p"), fx.token_estimate(F.lit("")).alias("t0"), fx.token_estimate(F.lit("abc")).alias("t"),
        fx.column_name(F.lit(0)).alias("n0"), fx.column_name(F.lit(26)).alias("n1"), fx.column_name(F.lit(701)).alias("n2"), fx.column_name(F.lit(702)).alias("n3"),
        fx.strip_fence(F.lit("```json\n{}\n```")).alias("f"), fx.query_terms(F.lit("VPN 访问权限申请 x")).alias("terms"), fx.backoff_seconds(F.lit(3)).alias("b"),
    ).first()
    assert (r.c, r.q, r.p, r.t0, r.t) == ("ab cd e", "abcde", "abcde...", 0, 2)
    assert (r.n0, r.n1, r.n2, r.n3) == ("A", "AA", "ZZ", "AAA")
    assert r.f == "{}" and r.b == 20
    assert {"vpn", "访问权限申请", "访问权限", "申请"} <= set(r.terms)


def test_redaction(spark):
    m = {"api_key": "k", "note": 'Bearer abc.def {"token": "x"} https://h/x?Expires=1&Signature=z'}
    r = spark.createDataFrame([(m,)], "m map<string,string>").select(fx.redact_map(F.col("m")).alias("m")).first().m
    assert r == {"api_key": "<redacted>", "note": 'Bearer <redacted> {"token": "<redacted>"} https://h/x?<redacted>'}
