"""Long blocks, page geometry and context packs on small literals."""

from pyspark.sql import functions as F

from docweave.operators import conversation, layout, splitting


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_windows_cover_the_text(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(60)).strip()
    w = one(spark, splitting.windows(F.lit(text), 200, 40))
    assert w[0] == text[: len(w[0])] and text.endswith(w[-1]) and all(x in text for x in w) and max(map(len, w)) <= 280
    at = 0
    for x in w:  # no gap but white space between one window and the next
        found = text.find(x)
        assert found <= at + 1
        at = max(at, found + len(x))
    assert at == len(text)
    assert one(spark, splitting.windows(F.lit("x" * 450), 200, 0)) == ["x" * 200, "x" * 200, "x" * 50]


def test_tables_keep_their_header(spark):
    rows = [f"| {i} | {'v' * 10} |" for i in range(20)]
    text = "\n".join(["| a | b |", "| --- | --- |", *rows])
    parts = one(spark, splitting.split_table(F.lit(text), 100))
    assert all(p.startswith("| a | b |\n| --- | --- |\n") and len(p) <= 100 for p in parts)
    assert [r for p in parts for r in p.split("\n")[2:]] == rows


def test_code_keeps_its_fences(spark):
    body = [f"line {i}" if i % 3 else "" for i in range(40)]
    text = "\n".join(["```py", *body, "```"])
    parts = one(spark, splitting.split_code(F.lit(text), 60))
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in parts)
    assert [r for p in parts for r in p.split("\n")[1:-1]] == body


def test_text_sections(spark):
    text = "Preface text that is long enough.\n第一章 总则\n本章规定了全部的内容和范围。\n第二章 附则\n本办法自发布之日起施行。"
    s = splitting.text_sections(spark.createDataFrame([(1, text), (2, "Just one line of text here.")], "doc_id long, text string")).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.heading) for r in s] == [(1, None), (1, "第一章 总则"), (1, "第二章 附则"), (2, None)]


def test_merged_metadata(spark):
    b = spark.createDataFrame([(1, 0, 2, 3, None, None, None, None, "A", "list"), (1, 1, 1, 4, 5, 9, 4, "S", "A", "table")], "c int, n int, page_start int, page_end int, row_start int, row_end int, row_count int, sheet_name string, heading_path string, kind string")
    r = splitting.merged_metadata(b, ["c"]).first()
    assert (r.page_start, r.page_end, r.row_start, r.sheet_name, r.heading_paths, r.block_types) == (1, 4, 5, "S", ["A"], ["list", "table"])


def test_lines_hang_on_their_first_word(spark):
    w = spark.createDataFrame([(1, 10.0, 0.0, 5.0, 20.0, "a"), (1, 13.0, 6.0, 9.0, 22.0, "b"), (1, 15.0, 0.0, 5.0, 25.0, "c")], "page int, top double, x0 double, x1 double, bottom double, word string")
    assert {r.word: r.line for r in layout.lines_of_words(w, ["page"]).collect()} == {"a": 0, "b": 0, "c": 1}


def test_page_elements(spark):
    rows = [(1, 1, 0, "Title", 16.0, 0.0, 16.0), (1, 1, 1, "First line", 10.0, 20.0, 30.0), (1, 1, 2, "goes on.", 10.0, 32.0, 42.0), (1, 1, 3, "Another one.", 10.0, 80.0, 90.0), (1, 2, 0, "Next page.", 10.0, 0.0, 10.0)]
    e = layout.page_elements(spark.createDataFrame(rows, "doc int, page int, position int, text string, size double, top double, bottom double"), "doc").orderBy("element").collect()
    assert [(r.kind, r.text) for r in e] == [("heading", "Title"), ("paragraph", "First line goes on."), ("paragraph", "Another one."), ("paragraph", "Next page.")]


def test_context_pack_fills_regions_in_order(spark):
    items = [(1, "tool", 1, 30, False, 1), (1, "system", 1, 20, True, 9), (1, "message", 1, 50, False, 1), (1, "message", 2, 60, False, 1), (1, "message", 3, 10, False, 1), (1, "memory", 1, 40, False, 1)]
    p = conversation.context_pack(spark.createDataFrame(items, "id int, kind string, n int, tokens int, pinned boolean, importance int"), ["id"], 120, {"memory": 30}).collect()
    assert {(r.kind, r.n): r.selected for r in p} == {("system", 1): True, ("memory", 1): False, ("message", 3): True, ("message", 2): True, ("message", 1): False, ("tool", 1): True}
    assert p[0].used == 120


def test_hard_limit(spark):
    items = [(1, "tool", i, 10, False, None, 960) for i in range(5)] + [(1, "evidence", i, 300, i == 0, float(i), 960) for i in range(4)]
    r = conversation.hard_limit(spark.createDataFrame(items, "id int, kind string, n int, tokens int, protected boolean, score double, used int"), ["id"], "used", 1000).collect()
    assert sorted((x.kind, x.n) for x in r) == [("evidence", 0), ("evidence", 3), ("tool", 4)]


def test_memories_and_summary(spark):
    m = spark.createDataFrame([(1, 1, 5, "2024-01-01", "active"), (1, 2, 5, "2024-01-02", "active"), (1, 3, 9, "2024-01-01", "archived")], "conv int, memory_id int, importance int, updated_at string, status string")
    assert [r.memory_id for r in conversation.top_memories(m, ["conv"], 99).orderBy("rank").collect()] == [2, 1]
    assert one(spark, conversation.labelled_summary(F.lit("g"), F.lit(""), F.lit("d"), F.lit(None))) == "Goal: g\nDecisions: d"


def plain_chunks(blocks, target, most, overlap):
    """Packing of (kind, units) as plain Python; units of a block that was split may overlap."""
    import re

    sentences = lambda t: [x.strip() for x in re.split(r"(?<=[。！？；.!?;])\s*", t) if x.strip()]
    out, cur = [], []
    for n, (kind, units) in enumerate(blocks):
        group = n if len(units) > 1 else None
        for u in units:
            size = len("\n\n".join(x for x, *_ in cur))
            nxt = size + (2 if size else 0) + len(u)
            if cur and ((size >= target and nxt > target) or nxt > most):
                out.append("\n\n".join(x for x, *_ in cur))
                kept, total = [], 0
                if group is not None and cur[-1][2] == group:
                    for x, k, g in reversed([(p, k, g) for t, k, g in cur for p in (sentences(t) if k == "paragraph" else [t])]):
                        if total + len(x) > overlap:
                            break
                        kept, total = [(x, k, g), *kept], total + len(x) + 2
                cur = kept
            cur.append((u, kind, group))
    return [*out, "\n\n".join(x for x, *_ in cur)] if cur else out


def test_packing_with_overlap_against_plain_python(spark):
    import random

    r = random.Random(6)
    cases = []
    for _ in range(30):
        blocks = []
        for _ in range(r.randrange(1, 5)):
            sentence = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(3, 40))).strip() + "x."
            kind = r.choice(["paragraph", "list"])
            blocks.append((kind, [("- " if kind == "list" else "") + sentence() for _ in range(r.choice([1, 1, 9]))]))
        cases.append(blocks)
    rows = [(i, [(u, k, n if len(us) > 1 else None) for n, (k, us) in enumerate(b) for u in us]) for i, b in enumerate(cases)]
    d = spark.createDataFrame(rows, "i int, units array<struct<text:string,kind:string,grp:int>>")
    got = {x.i: x.c for x in d.select("i", splitting.pack_blocks(F.col("units"), 80, 120, 50).alias("c")).collect()}
    assert got == {i: plain_chunks(b, 80, 120, 50) for i, b in enumerate(cases)}
    assert any(len(set(c)) > 1 for c in got.values())


def test_blocks_split_by_their_kind(spark):
    items = [f"- item {i} " + "w" * 30 for i in range(12)]
    text = "intro\n" + "\n".join(x if i % 3 else x + "\n  goes on" for i, x in enumerate(items))
    assert one(spark, splitting.list_items(F.lit(text))) == [x if i % 3 else x + "\n  goes on" for i, x in enumerate(items)]
    units = lambda kind, t: one(spark, splitting.block_units(F.lit(kind), F.lit(t), 200, 20))
    assert units("list", text)[1] == items[1] and units("paragraph", "short") == ["short"]
    assert units("paragraph", "One is here. " * 30) == ["One is here."] * 30
    assert all(len(x) <= 200 for x in units("paragraph", "y" * 900)) and len(units("paragraph", "y" * 900)) == 5
    doc = "# T\n\n## A\n\n" + "A sentence of the text. " * 60 + "\n\n" + text + "\n\n## B\n\n| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'v' * 30} |" for i in range(60))
    c = splitting.chunk_elements(splitting.markdown_elements(spark.createDataFrame([(1, doc)], "doc_id long, text string"))).orderBy("chunk_index").collect()
    assert all(x.content.startswith("## A\n\n") for x in c if x.heading_path == ["T", "A"]) and all("| --- |" in x.content for x in c if x.block_types == ["table"])
    first, second = c[0].content, c[1].content
    shared = second.removeprefix("## A\n\n")[:148]
    assert len(first) <= 1010 and first.endswith(shared) and shared.startswith("A sentence of the text.")


def test_heading_paths_keep_odd_levels(spark):
    d = spark.createDataFrame([(1, "### B\n\nx\n\n## C\n\ny\n\n## D\n\nz\n\n# E\n\nw")], "doc_id long, text string")
    got = {r.text: r.heading_path for r in splitting.markdown_elements(d).collect() if r.kind == "paragraph"}
    assert got == {"x": ["B"], "y": ["B", "C"], "z": ["B", "D"], "w": ["E"]}


def test_plain_text_elements(spark):
    text = "第一章 总则\n本章说明适用范围和基本要求。\n\n1.1 目的\n为了规范流程，特制定本办法。\n\n第 二 章 职责\n各部门应当按照分工履行职责。"
    d = spark.createDataFrame([(1, text, "TXT "), (2, "Only one line of text here.\n\nAnd a second paragraph.", ".text"), (3, "# A\n\nb", "md")], "doc_id long, text string, file_type string")
    got = {}
    for r in splitting.elements_of(d).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r.heading_path))
    a, b, c = got[1][0][2][0], got[1][2][2][-1], got[1][4][2][0]
    assert got[1] == [("heading", 1, [a]), ("paragraph", None, [a]), ("heading", 2, [a, b]), ("paragraph", None, [a, b]), ("heading", 1, [c]), ("paragraph", None, [c])]
    assert [k for k, *_ in got[2]] == ["paragraph", "paragraph"] and got[3] == [("heading", 1, ["A"]), ("paragraph", None, ["A"])]
    with __import__("pytest").raises(Exception, match="no parser"):
        splitting.elements_of(d.withColumn("file_type", F.lit("exe"))).collect()


def test_heading_levels_stay_in_line(spark):
    rows = [(1, 0, "二、x", "cn_enum", 2), (1, 1, "三、y", "cn_enum", 2), (1, 2, "1.1.1 z", "decimal", 3), (1, 3, "1.1.1.1 w", "decimal", 4), (1, 4, "四、v", "cn_enum", 2), (1, 5, "top", "chapter", 1)]
    d = spark.createDataFrame(rows, "doc_id long, line_no int, heading string, pattern string, level int")
    got = [(r.level, r.heading_path) for r in splitting.heading_levels(d, "doc_id", "line_no").orderBy("line_no").collect()]
    assert got == [(1, ["二、x"]), (1, ["三、y"]), (2, ["三、y", "1.1.1 z"]), (3, ["三、y", "1.1.1 z", "1.1.1.1 w"]), (2, ["三、y", "四、v"]), (1, ["top"])]


def test_headings_from_raw_text(spark):
    """Enumerated headings are siblings, a number has as many levels as parts, brackets make a heading."""
    body = "这里是正文内容，说明本节的要求和范围。"
    text = "\n".join(f"{h}\n{body}" for h in ("一、总则", "二、范围", "三、职责", "1.1.1 细则", "（一）附件", "（二）说明"))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.text, r.level) for r in splitting.text_elements(d).orderBy("n").collect() if r.kind == "heading"]
    assert got == [("一、总则", 1), ("二、范围", 1), ("三、职责", 1), ("1.1.1 细则", 2), ("（一）附件", 2), ("（二）说明", 2)]
    found = spark.createDataFrame([("1.2.3 Title",), ("（一） 范围",), ("目录....... 3",), ("第 3 部 分 工 总 则",), ("1 范 围 说 明",), ("xviii",), ("page3",), ("结束。",)], "s string")
    rows = found.select(splitting.heading_match(F.col("s")).alias("m"), splitting.heading_text(F.col("s")).alias("t"), splitting.is_noise(F.col("s")).alias("x")).collect()
    assert [(r.m.pattern, r.m.level) if r.m else None for r in rows] == [("numeric", 3), ("paren_enum", 2), None, ("chapter_cn", 1), ("numeric", 1), None, None, None]
    assert rows[4].t == "1 范围说明" and [r.x for r in rows] == [False] * 5 + [True, True, False]


def test_tables_carry_rows_over(spark):
    rows = [f"| {i:02} | {'v' * 10} |" for i in range(20)]  # 19 signs each; the header takes 26 with its line ends
    text = "\n".join(["| a | b |", "| --- | --- |", *rows])
    parts = spark.range(1).select(splitting.table_parts(F.lit(text), 130, 70, F.lit(5)).alias("p")).first().p
    assert [(p.row_start, p.row_end, p.row_count) for p in parts][:3] == [(5, 9, 5), (8, 12, 5), (11, 15, 5)]
    assert parts[-1].row_end == 24 and all(len(p.text) <= 130 and p.text.startswith("| a | b |\n| --- | --- |\n| ") for p in parts)
    assert {r for p in parts for r in p.text.split("\n")[2:]} == set(rows)
    long = "\n".join(["| a |", "| --- |", "| short |", "| " + "word " * 60 + "|", "| end |"])
    cut = spark.range(1).select(splitting.table_parts(F.lit(long), 120, 30, F.lit(1)).alias("p")).first().p
    assert [p.row_start for p in cut] == [1, *[2] * (len(cut) - 2), 3] and all(p.text.startswith("| a |\n| --- |\n") for p in cut)


def test_code_carries_lines_over(spark):
    text = "\n".join(["```py", *[f"line {i:02}" for i in range(12)], "```"])
    parts = one(spark, splitting.split_code(F.lit(text), 50, 30))
    assert all(p.startswith("```py\n") and p.endswith("\n```") and len(p) <= 50 for p in parts)
    got = [p.split("\n")[1:-1] for p in parts]
    assert all(b[:2] == a[-2:] for a, b in zip(got, got[1:])) and list(dict.fromkeys(x for p in got for x in p)) == [f"line {i:02}" for i in range(12)]


def test_chunks_have_the_metadata_of_what_they_hold(spark):
    rows = [
        (1, 1, "heading", "A", 1, ["A"], 1, 1, None), (1, 2, "paragraph", "One sentence here. " * 4, None, ["A"], 1, 1, None), (1, 3, "list", "- x\n- y", None, ["A"], 2, 2, None),
        (1, 4, "table", "\n".join(["| k |", "| --- |", *[f"| r{i:03} |" for i in range(12)]]), None, ["A"], 3, 4, 2), (1, 5, "paragraph", "Long sentence number one. " * 12, None, ["A"], 4, 5, None),
    ]
    e = spark.createDataFrame(rows, "doc_id long, n int, kind string, text string, level int, heading_path array<string>, page_start int, page_end int, row_start int")
    c = splitting.chunk_elements(e, target=100, most=120, overlap=60).orderBy("chunk_index").collect()
    m = [r.metadata for r in c]
    assert m[0].block_types == ["paragraph", "list"] and (m[0].page_start, m[0].page_end, m[0].paragraph_start, m[0].paragraph_end) == (1, 2, 2, 3)
    tables = [x for x in m if x.block_types == ["table"]]
    assert [(x.row_start, x.row_end) for x in tables] == [(2, 12), (8, 13)] and all((x.page_start, x.page_end) == (3, 4) for x in tables)
    assert [x.heading_paths for x in m] == [[["A"]]] * len(m) and m[-1].paragraph_start == 5 and m[0].row_start is None
    assert [r.chunk_index for r in c] == list(range(len(c)))


def test_sections_align_in_order(spark):
    e = [(1, 1, "heading", "T"), (1, 2, "heading", "A"), (1, 3, "paragraph", " same "), (1, 4, "paragraph", "left out"), (1, 5, "paragraph", "same"), (1, 6, "paragraph", "behind"), (2, 1, "paragraph", "x")]
    b = [(1, 0, 0, "heading", "A"), (1, 0, 1, "paragraph", "same"), (1, 1, 0, "paragraph", "same ")]
    got = splitting.align_sections(spark.createDataFrame(e, "doc_id long, n int, kind string, text string"), spark.createDataFrame(b, "doc_id long, section_no int, block_no int, kind string, text string")).orderBy("doc_id", "n").collect()
    assert [(r.n, r.section_no, r.block_no, r.context_only) for r in got] == [(1, 0, 0, True), (2, 0, 0, False), (3, 0, 1, False), (4, 1, 0, True), (5, 1, 0, False), (6, 1, None, False), (1, 0, None, False)]


def test_pages_with_headings_and_without(spark):
    body = "这里是正文内容，说明本节的要求和范围。"
    rows = [(1, 1, f"一、总则\n{body}\n\n第二段。"), (1, 2, f"接上页的段落，没有标题。\n二、范围\n{body}"), (2, 1, "First paragraph,\ntwo lines.\n\n\nSecond."), (2, 2, "  "), (2, 3, "Third page."), (3, 1, None)]
    e = splitting.page_text_elements(spark.createDataFrame(rows, "doc_id long, page_number int, text string")).orderBy("doc_id", "n").collect()
    one_ = [(r.kind, r.text, r.page_start, r.page_end, r.section_no, r.heading_path) for r in e if r.doc_id == 1]
    assert one_ == [
        ("heading", "一、总则", 1, 1, 1, ["一、总则"]), ("paragraph", body, 1, 1, 1, ["一、总则"]), ("paragraph", "第二段。", 1, 1, 1, ["一、总则"]),
        ("paragraph", "接上页的段落，没有标题。", 2, 2, 1, ["一、总则"]), ("heading", "二、范围", 2, 2, 2, ["二、范围"]), ("paragraph", body, 2, 2, 2, ["二、范围"]),
    ]
    assert [(r.text, r.page_start, r.section_no, r.splitter) for r in e if r.doc_id != 1] == [("First paragraph,\ntwo lines.", 1, 0, "pdf_page_structure"), ("Second.", 1, 0, "pdf_page_structure"), ("Third page.", 3, 1, "pdf_page_structure")]


def test_types_go_to_their_parsers(spark):
    text = "name;score\na;1\nb;2\n\nx;y;z\n"
    rows = [(1, text, "CSV"), (2, "Page one.\fPage two.", "pdf"), (3, "| a |\n| --- |\n| 1 |", "md"), (4, "Some text here.", ".docx")]
    e = splitting.elements_of(spark.createDataFrame(rows, "doc_id long, text string, file_type string")).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.kind, r.row_start, r.row_end, r.page_start) for r in e] == [(1, "table", 2, 3, None), (1, "table", 5, 5, None), (2, "paragraph", None, None, 1), (2, "paragraph", None, None, 2), (3, "table", None, None, None), (4, "paragraph", None, None, None)]
    assert e[0].text == "| name | score |\n| --- | --- |\n| a | 1 |\n| b | 2 |" and e[1].text.startswith("| A | B | C |\n| --- | --- | --- |\n| x | y | z |")
    names = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277)], "i int").select(splitting.column_name(F.col("i")).alias("n")).collect()
    assert [r.n for r in names] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]


def test_lines_join_as_they_read(spark):
    cases = [
        (["The quick", "brown fox.", "It runs"], "The quick brown fox. It runs"), (["第一行", "第二行 ABC", "继续"], "第一行第二行ABC继续"), (["see (", "below", ") now"], "see (below) now"),
        (["see 3", ".5 mm"], "see 3.5 mm"), ([" ", "a-", "b"], "a- b"), (["end ,", "then"], "end, then"), ([], ""), (["数值 为 12 个", "，即 可"], "数值为12个，即可"),
    ]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x array<string>").select("i", layout.join_lines(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [w for _, w in cases]


def test_headers_and_footers_go(spark):
    rows = [(1, p, "Report 2024", 10.0, 20.0) for p in (1, 2, 3)] + [(1, p, f"Page {p}", 980.0, 990.0) for p in (1, 2, 3)] + [(1, 1, "Only here", 10.0, 20.0), (1, 2, "Report 2024", 500.0, 510.0), (2, 1, "Report 2024", 10.0, 20.0)]
    left = layout.without_headers_footers(spark.createDataFrame(rows, "doc int, page int, text string, top double, bottom double"), "doc", F.lit(1000.0)).collect()
    assert sorted((r.doc, r.page, r.text) for r in left) == [(1, 1, "Only here"), (1, 2, "Report 2024"), (2, 1, "Report 2024")]


def test_blocks_items_and_documents(spark, tmp_path):
    import json

    from docweave.sources import sinks

    md = spark.createDataFrame([(1, "# Top\n\n## A\n\ntext a\n\n- x\n\n## B\n\ntext b")], "doc_id long, text string")
    e = splitting.markdown_elements(md)
    b = splitting.blocks(e).orderBy("section_no", "block_no")
    assert [(r.section_no, r.block_no, r.kind, r.heading_path[-1], r.section_level) for r in b.collect()] == [(0, 0, "heading", "A", 2), (0, 1, "paragraph", "A", 2), (0, 2, "list", "A", 2), (1, 0, "heading", "B", 2), (1, 1, "paragraph", "B", 2)]
    aligned = splitting.align_sections(e, b).orderBy("n").collect()
    assert [(r.section_no, r.block_no, r.context_only) for r in aligned] == [(0, 0, True), (0, 0, False), (0, 1, False), (0, 2, False), (1, 0, False), (1, 1, False)]
    items = spark.createDataFrame([(1, "Title", "Plain text of the item."), (2, "", "No title."), (3, "T", "  "), (4, "H", "# own heading")], "item_id long, title string, content string")
    got = {r.item_id: (r.content, json.loads(r.metadata_json)) for r in splitting.item_chunks(items).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: "# Title\n\nPlain text of the item.", 2: "No title.", 4: "# own heading"}
    assert got[1][1]["heading_path"] == ["Title"] and got[1][1]["block_types"] == ["paragraph"] and got[1][1]["chunk_index"] == 0
    docs = [(1, 7, 1, "a.md", "md", "# A\n\nbody"), (2, 7, 2, "t.csv", ".CSV", "k;v\na;1\nb;2"), (3, 7, 2, "p.pdf", "pdf", "One.\fTwo.")]
    made = splitting.document_chunks(spark.createDataFrame(docs, "doc_id long, organization_id int, knowledge_base_id int, filename string, file_type string, text string"))
    sinks.overwrite_documents(made, f"{tmp_path}/chunks")
    rows = {(r.doc_id, r.chunk_index): json.loads(r.metadata_json) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert rows[1, 0]["filename"] == "a.md" and rows[1, 0]["heading_path"] == ["A"] and rows[2, 0]["row_start"] == 2 and rows[2, 0]["row_end"] == 3
    assert (rows[3, 0]["page_start"], rows[3, 0]["page_end"]) == (1, 2) and rows[3, 0]["document_id"] == 3


def test_history_is_read_for_gaps_only(spark):
    from docweave.operators import conversation

    q = spark.createDataFrame([(1, "之前说的那个预算是多少"), (2, "What is the annual budget of the whole department for travel?")], "conv_id long, question string")
    m = spark.createDataFrame([(c, t, "user", x, 0.0) for c in (1, 2) for t, x in enumerate(["预算是三万元", "hello"])], "conv_id long, turn long, role string, text string, age_days double")
    got = conversation.recover(q, m).collect()
    assert {r.conv_id for r in got} == {1} and all(r.reason for r in got)
    assert [r.content for r in got if r.rank == 1] == ["user: 预算是三万元"]
