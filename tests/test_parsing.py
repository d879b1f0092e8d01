import base64
import random

import pytest
from pyspark.sql import functions as F

from docloom.sources import files
from docloom.sources import pages as P


def test_html_blocks_in_reading_order():
    html = (
        "<html><head><style>p{}</style><script>var t='</p>'; if (a<b) {}</script></head><body>loose <h1> A  b</h1><p>one<br>two <b>x</b></p>"
        "<ul><li>i</li></ul><img alt='pic'><table><tr><th rowspan=2>h</th><td colspan='2'>c</td></tr><tr><td></td><td>d</td></tr></table>tail"
    )
    blocks = P.parse_html(html)
    assert [(k, t) for k, t, _ in blocks] == [("TEXT", "loose"), ("TITLE", "A b"), ("TEXT", "one two x"), ("TEXT", "i"), ("IMAGE", "pic"), ("TABLE", "h | c | c\nh | d"), ("TEXT", "tail")]
    assert blocks[5][2] == [["h", "c", "c"], ["h", "", "d"]]


def test_grid_of_spans():
    assert P.filled_grid([[("a", 3, 1), ("b", 1, 2)], [("c", 1, 1)]]) == [["a", "b", "b"], ["a", "c", ""]]


def test_markdown_blocks_have_byte_spans():
    source = "# Ünï\n\npara one\nstill\n- a\n- b\n\n1. x\n\n```py\n# no\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n---\n<div>\n"
    nodes = P.parse_markdown(source)
    assert [n[0] for n in nodes] == ["TITLE", "TEXT", "LIST", "LIST", "CODE", "TABLE", "BLOCKQUOTE", "THEMATIC_BREAK", "HTML"]
    raw = source.encode()
    assert nodes[0][1] == 1 and nodes[0][4] == "Ünï" and raw[nodes[5][2] : nodes[5][3]].decode().startswith("| a | b |")
    assert all(a[3] <= b[2] for a, b in zip(nodes, nodes[1:], strict=False))


@pytest.mark.parametrize("most", [1, 7, 100, 1200])
def test_segments_cover_every_code_point_once(most):
    r = random.Random(most)
    text = "".join(r.choice("ab。 \n😀é中;") for _ in range(3000))
    spans = list(P.segments_of(text, most, 200))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(P.token_cost(text[a:b]) <= 200 or b - a == 1 for a, b in spans)


def test_chunks_overlap_and_cover():
    text = "word " * 900
    spans = list(P.chunk_spans(text, 800, 120))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False)) and all(b - a <= 800 for a, b in spans)


def test_rows_for_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>")], "id long, html string")
    assert [tuple(r) for r in P.html_blocks(df, "id", "html").collect()] == [(3, 1, "TEXT", "x")]


def test_file_types_and_decoding(spark):
    rows = [("a.MD", None, ""), ("b", "pdf", ""), ("c.xls", None, ""), ("d", None, "text/x"), ("e", None, "")]
    df = spark.createDataFrame(rows, "n string, g string, m string")
    kinds = df.select(files.file_type(F.col("n"), F.col("g"), F.col("m")).alias("k")).select("k", files.route(F.col("k")).alias("r")).collect()
    assert [tuple(k) for k in kinds] == [("MARKDOWN", "NATIVE_TEXT"), ("PDF", "LAYOUT_SERVICE"), ("XLS", "REJECTED"), ("TXT", "NATIVE_TEXT"), ("UNKNOWN", "REJECTED")]
    raw = [("中文".encode("gb18030"),), ("中文".encode(),), (b"\xff\xfe\xfd",), (b"\xef\xbb\xbfx",)]
    got = [r.t for r in spark.createDataFrame(raw, "c binary").select(files.decode_text(F.col("c")).alias("t")).collect()]
    assert got[:2] == ["中文", "中文"] and "�" in got[2] and got[3] == "﻿x"
    codes = spark.createDataFrame([(base64.b64encode(b"hi").decode(),), ("",), ("%%",)], "b string").select(files.decode_base64(F.col("b")).alias("d")).collect()
    assert [r.d for r in codes] == [bytearray(b"hi"), None, None]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "1"}, {"q": "2"}]')
    (tmp_path / "b.json").write_text('{"data": [{"q": "3"}]}')
    (tmp_path / "c.json").write_text('{"q": "4"}\n\n{"q": "5", "z": 1}\n')
    (tmp_path / "d.json").write_text('{"q": "6"}')
    got = sorted(r.q for r in files.read_records(spark, str(tmp_path), "q string").collect())
    assert got == ["1", "2", "3", "4", "5", "6"]
    assert [r.q for r in files.read_jsonl(spark, str(tmp_path / "c.json"), "q string").collect()] == ["4", "5"]
    names = {r.name: r.parser for r in files.read_files(spark, str(tmp_path)).collect()}
    assert names["a.json"] == "LAYOUT_SERVICE" and len(names) == 4
