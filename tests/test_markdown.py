"""Markdown trees: structure, spans, inline text, blocks, faults."""

import random
import time

import pytest

from docloom.sources import markdown as M

NAMES = [c.strip().split()[0] for c in M.NODE_COLUMNS.split(",")]


def nodes(source):
    return [dict(zip(NAMES, r, strict=True)) for r in M.parse_tree(source)]


def shape(source):
    """Nested (type, text) of the tree; text of leaves only."""
    found = nodes(source)

    def of(k):
        below = [of(n["node_no"]) for n in found if n["parent_no"] == k]
        return (found[k]["node_type"], below) if below else (found[k]["node_type"], found[k]["text"])

    return of(0)[1]


GUIDE = "# 指南\n## 第二章\n### 2.1 启动\n1. 准备\n2. 启动\n\n正文。\n### 2.2 停止\n- 入口\n- 状态\n#### 标题\n##### 下一个\n结束。\n"


def test_headings_lists_and_paragraphs_side_by_side():
    found = nodes(GUIDE)
    top = [n for n in found if n["parent_no"] == 0]
    assert [n["node_type"] for n in top] == ["HEADING"] * 3 + ["ORDERED_LIST", "PARAGRAPH", "HEADING", "UNORDERED_LIST", "HEADING", "HEADING", "PARAGRAPH"]
    assert [n["level"] for n in found if n["node_type"] == "HEADING"] == [1, 2, 3, 3, 4, 5]
    items = [n for n in found if n["node_type"] == "LIST_ITEM"]
    assert [(n["marker"], n["ordinal"]) for n in items] == [("1.", 1), ("2.", 2), ("-", None), ("-", None)]
    raw = GUIDE.encode()
    assert all(raw[n["first_byte"] : n["last_byte"]].decode() for n in found)
    assert [raw[n["first_byte"] : n["last_byte"]].decode() for n in items[:2]] == ["1. 准备\n", "2. 启动\n\n"]


def test_tables_keep_escaped_bars_empty_cells_and_alignment():
    source = "# 表\n\n| 键 | 值 | 空 |\n| :--- | :---: | ---: |\n| a | A \\| B | |\n| b | | z |\n| c |\n"
    cells = [n for n in nodes(source) if n["node_type"] == "TABLE_CELL"]
    assert [n["text"] for n in cells] == ["键", "值", "空", "a", "A | B", "", "b", "", "z", "c", "", ""]
    assert [n["alignment"] for n in cells[:3]] == ["LEFT", "CENTER", "RIGHT"] and [n["header"] for n in cells] == [True] * 3 + [False] * 9
    assert [(n["row_index"], n["column_index"]) for n in cells] == [(y, x) for y in range(4) for x in range(3)]
    raw = source.encode()
    assert [raw[n["first_byte"] : n["last_byte"]].decode() for n in cells[:9]] == ["键", "值", "空", "a", "A \\| B", "", "b", "", "z"]


def test_ordinals_that_do_not_count_up():
    assert [(n["marker"], n["ordinal"]) for n in nodes("0. zero\n2. two\n") if n["node_type"] == "LIST_ITEM"] == [("0.", 0), ("2.", 2)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(end):
    source = f"# 题{end}{end}a\u2028b\x0cc\x1cd{end}"
    found = nodes(source)
    assert [n["node_type"] for n in found] == ["DOCUMENT", "HEADING", "PARAGRAPH"] and found[2]["text"] == "a\u2028b\x0cc\x1cd"
    assert found[0]["last_byte"] == len(source.encode()) and found[0]["last_line"] == 4 and found[0]["last_column"] == 1
    assert nodes("ab")[0]["last_column"] == 3 and nodes("")[0]["last_line"] == 1


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("> a\nb\n> c\n\nd", [("BLOCKQUOTE", [("PARAGRAPH", "a\nb\nc")]), ("PARAGRAPH", "d")]),
        ("- a\n\n  b\n- c", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a"), ("PARAGRAPH", "b")]), ("LIST_ITEM", [("PARAGRAPH", "c")])])]),
        ("- a\n+ b", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a")])]), ("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "b")])])]),
        ("- a\n  - b\n    - c\n- d", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a"), ("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "b"), ("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "c")])])])])]), ("LIST_ITEM", [("PARAGRAPH", "d")])])]),
        ("1. a\n\n   > q\n   >> r\n", [("ORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a"), ("BLOCKQUOTE", [("PARAGRAPH", "q"), ("BLOCKQUOTE", [("PARAGRAPH", "r")])])])])]),
        ("-\n  a", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a")])])]),
        ("-\n\n  a", [("UNORDERED_LIST", [("LIST_ITEM", "")]), ("PARAGRAPH", "a")]),
        ("a\n2. b", [("PARAGRAPH", "a\n2. b")]),
        ("a\n1. b", [("PARAGRAPH", "a"), ("ORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "b")])])]),
        ("    code\n\n      more\n\ntext", [("CODE_BLOCK", "code\n\n  more"), ("PARAGRAPH", "text")]),
        ("a\n    b", [("PARAGRAPH", "a\nb")]),
        ("-     code", [("UNORDERED_LIST", [("LIST_ITEM", [("CODE_BLOCK", "code")])])]),
        ("- foo\n\n\t\tbar", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "foo"), ("CODE_BLOCK", "  bar")])])]),
        ("```a b\nx\n``\n````\ny", [("CODE_BLOCK", "x\n``"), ("PARAGRAPH", "y")]),
        ("> ```\n> x\n\ny", [("BLOCKQUOTE", [("CODE_BLOCK", "x")]), ("PARAGRAPH", "y")]),
        ("  ~~~\n   x\n ~~~", [("CODE_BLOCK", " x")]),
        ("Foo\n---\nbar\n***", [("HEADING", "Foo"), ("PARAGRAPH", "bar"), ("THEMATIC_BREAK", "")]),
        ("# a #\n## b \\##\n###\n####### c", [("HEADING", "a"), ("HEADING", "b ##"), ("HEADING", ""), ("PARAGRAPH", "####### c")]),
        ("- - -\n* * a", [("THEMATIC_BREAK", ""), ("UNORDERED_LIST", [("LIST_ITEM", [("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "a")])])])])]),
        ("<div>\n*x*\n\n*y*", [("HTML_BLOCK", "<div>\n*x*"), ("PARAGRAPH", "y")]),
        ("<!-- a\n\nb -->\nc", [("HTML_BLOCK", "<!-- a\n\nb -->"), ("PARAGRAPH", "c")]),
        ("x\n<a href='q'>\ny", [("PARAGRAPH", "x\n<a href='q'>\ny")]),
        ("[a]: /u 't'\n[b]:\n/v\n\n[a] [x][b] [c]", [("PARAGRAPH", "a x [c]")]),
        ("[a]: /u\n===\n[a]", [("PARAGRAPH", "===\na")]),
        ("t\n| a | b |\n|---|---|\n| c | d |\n> q", [("PARAGRAPH", "t"), ("TABLE", [("TABLE_HEAD", [("TABLE_ROW", [("TABLE_CELL", "a"), ("TABLE_CELL", "b")])]), ("TABLE_BODY", [("TABLE_ROW", [("TABLE_CELL", "c"), ("TABLE_CELL", "d")])])]), ("BLOCKQUOTE", [("PARAGRAPH", "q")])]),
        ("> | a |\n> |---|\n> | b |\n\nc | d\n- | -", [("BLOCKQUOTE", [("TABLE", [("TABLE_HEAD", [("TABLE_ROW", [("TABLE_CELL", "a")])]), ("TABLE_BODY", [("TABLE_ROW", [("TABLE_CELL", "b")])])])]), ("PARAGRAPH", "c | d"), ("UNORDERED_LIST", [("LIST_ITEM", [("PARAGRAPH", "| -")])])]),
    ],
)
def test_structure(source, want):
    assert shape(source) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("*a **b** c*", "a b c"), ("foo*bar*", "foobar"), ("**foo*", "*foo"), ("_a_b_", "a_b"), ("***a***", "a"), ("*a _b* c_", "a _b c_"), ("*foo**bar*", "foo**bar"), ("foo******bar*********baz", "foobar***baz"),
        ("a * b *", "a * b *"), ("**a*", "*a"), ("[x *y*](http://a 't') z", "x y z"), ("![alt *q*](u) [r] [t][r] [r][]", "alt *q* r t r"), ("[a](b", "[a](b"), ("[a [b](c) d](e)", "[a b d](e)"), ("[*a](x)*", "*a*"),
        ("`` a`b `` c `d", "a`b c `d"), ("a\\*b &amp; &#65;&#x4e2d; <b>x</b> &nope;", "a*b & A中 <b>x</b> &nope;"), ("a  \nb\\\nc\n  d", "a\nb\nc\nd"), ("<http://x.y> <u@v.org> a<b", "http://x.y u@v.org a<b"), ("中**文**字 “*x*”", "中文字 “x”"), ("!", "!"), ("]", "]"),
    ],
)
def test_inline_text(raw, want):
    assert M.inline_text(raw, {"r"}) == want


def soup(seed):
    r = random.Random(seed)
    pieces = ["# ", "## x\n", "- ", "  - ", "1. ", "3) ", "> ", "```\n", "~~~ py\n", "\n", "\n\n", "a b", "中", "*", "**x**", "|", "| a | b |\n|---|:-:|\n| c |\n", "    ", "\t", "---\n", "===\n", "<div>\n", "[q]: /u\n", "[q]", "`", "\\", "\r\n", "&lt;"]
    return "".join(r.choice(pieces) for _ in range(r.randint(1, 60)))


def test_random_texts_give_sound_trees(spark):
    texts = [(k, soup(k)) for k in range(1500)]
    for _, text in texts:
        found = nodes(text)
        raw = text.encode()
        for n in found[1:]:
            above = found[n["parent_no"]]
            assert n["parent_no"] < n["node_no"] and above["first_byte"] <= n["first_byte"] <= n["last_byte"] <= above["last_byte"], repr(text)
            raw[n["first_byte"] : n["last_byte"]].decode()
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    tree = M.markdown_tree(df, "id", "text")
    assert M.tree_faults(tree, "id").isEmpty()
    assert tree.where("node_no = 0").count() == len(texts)


def test_faults_are_named(spark):
    tree = M.markdown_tree(spark.createDataFrame([(1, "| k | v |\n|---|---|\n| a | b |\n\n1. x\n")], "id long, text string"), "id", "text").cache()
    change = lambda where, column, value: tree.withColumn(column, M.F.when(M.F.expr(where), M.F.expr(value)).otherwise(M.F.col(column)))
    said = lambda df: {r.fault for r in M.tree_faults(df, "id").collect()}
    assert said(tree) == set()
    assert "WRONG_PARENT_TYPE" in said(change("node_type = 'TABLE_HEAD'", "parent_no", "0"))
    assert said(change("header and column_index = 0", "header", "false")) == {"HEADER_FLAG_WRONG"}
    assert said(change("node_type = 'LIST_ITEM'", "ordinal", "null")) == {"ORDINAL_MISSING"}
    assert "UNKNOWN_PARENT" in said(change("node_no = 1", "parent_no", "null"))
    assert "PARENT_AFTER_CHILD" in said(change("node_no = 1", "parent_no", "5"))
    assert "SPAN_OUTSIDE_PARENT" in said(change("node_no = 1", "last_byte", "999"))
    assert said(tree.where("node_no <> 3")) >= {"ORDER_NOT_CONTIGUOUS", "UNKNOWN_PARENT"}


def test_blocks_carry_sections_and_grids(spark):
    source = "lead\n\n# 表\n\n| a | b |\n|---|---|\n| c | |\n\n## *二*\n- x\n- y\n\n```\ncode\n```\n[q]: /u\n"
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "id long, text string")
    tree = M.markdown_tree(df, "id", "text")
    got = [tuple(r) for r in M.markdown_blocks(tree, df, "id", "text").orderBy("id", "block_no").select("block_no", "block_type", "level", "marker", "block_text", "section_path", "rows").collect()]
    assert got == [
        (1, "TEXT", None, None, "lead", "", None), (2, "TITLE", 1, "#", "表", "表", None), (3, "TABLE", None, None, "a | b\nc | ".strip(" "), "表", [["a", "b"], ["c", ""]]), (4, "TITLE", 2, "##", "二", "二", None),
        (5, "LIST", None, None, "- x\n- y", "二", None), (6, "CODE", None, "```", "```\ncode\n```", "二", None),
    ]
    assert {r.id: r.n for r in tree.groupBy("id").agg(M.F.count("*").alias("n")).collect()}[3] == 1 and tree.where("id = 2").isEmpty()


def test_long_texts_take_linear_time():
    for piece in ("| a | b |\n", "- x\n", "**a** _b_ `c` [d](e) ", "> q\n", "* a *b ", "[a"):
        head = "| a | b |\n|---|---|\n" if piece.startswith("|") else ""
        times = []
        for n in (2000, 16000):
            began = time.perf_counter()
            list(M.parse_tree(head + piece * n))
            times.append(time.perf_counter() - began)
        assert times[1] < 30 * times[0] + 0.5, (piece, times)
