import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.functions import text as T


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def of(spark, f, text, *more):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(f(F.col("t"), *more).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.cleanup_text, "\r\na\tb\x00c\r 　", "a b c"),
        (T.paragraphs, "a\n \nb\n\n\n c \n", ["a", "b", "c"]),
        (T.classify_block, "第三章 绪论", "TITLE"),
        (T.classify_block, "1.2. Scope", "TITLE"),
        (T.classify_block, "see below:", "TITLE"),
        (T.classify_block, "# heading", "TEXT"),
        (T.classify_block, "x" * 81 + ":", "TEXT"),
        (T.strip_heading, "### a # b", "a # b"),
        (T.base_name, "a.b.pdf", "a.b"),
        (T.base_name, "", "document"),
        (T.token_estimate, "你好 world", 2 + 1 + 1),
        (T.token_estimate, "", 0),
        (T.quality_level, " ", 1),
        (T.quality_level, "ok" + "�", 1),
        (T.quality_level, "short", 2),
        (T.quality_level, "x" * 500, 3),
        (T.sentences, "甲。乙！ 丙?d; e\nf.g", ["甲", "乙", "丙", "d", "e", "f.g"]),
        (T.extract_terms, "GPIO_a 引脚 文档 这是一个很长的中文短语 gpio", ["gpio_a", "gpio", "引脚", "这是一个", "一个很长", "很长的中", "的中文短", "文短语"]),
        (T.metadata_words, '["a","b"，c、a]', ["a", "b", "c"]),
        (T.last_section, "a / b > c", "c"),
        (T.last_section, "", ""),
        (T.summary_of_reply, '```json\n{"summary": " ok "}\n```', "ok"),
        (T.summary_of_reply, "plain", "plain"),
        (T.stable_hash, "ab", 97 * 31 + 98),
        (T.citations, "x [2][1] y [2] [a]", [2, 1]),
        (T.operator_error, "", "处理失败"),
        (T.operator_error, "Traceback (most recent call last) 解析", "解析失败，请打开文档详情查看阶段记录。"),
        (T.operator_error, "plain", "plain"),
    ],
)
def test_text_functions(spark, f, text, want):
    assert of(spark, f, text) == want


def test_clip_and_preview(spark):
    assert of(spark, lambda t: T.clip_text(t, 5), "abcd efgh") == "abcd..."
    assert of(spark, lambda t: T.preview(t, 4), " a\n\nb  c d") == "a b ..."
    assert of(spark, lambda t: T.canonical_path(t, F.lit(3)), "A / 中文! b") == "/A-中文-b/3"
    assert of(spark, lambda t: T.canonical_path(t, F.lit(3)), None) == "/root/3"


def test_tables(spark):
    df = spark.createDataFrame([([["", " a ", None], [" ", "", ""], ["", "<b>", "c", ""]],)], "r array<array<string>>")
    tidy = T.trim_table(F.col("r"))
    assert df.select(tidy.alias("v")).first()["v"] == [["a", ""], ["<b>", "c"]]
    assert df.select(T.table_text(tidy).alias("v")).first()["v"] == "a\n<b> | c"
    assert df.select(T.table_html(tidy).alias("v")).first()["v"] == "<table><tr><td>a</td><td></td></tr><tr><td>&lt;b&gt;</td><td>c</td></tr></table>"


def test_paths_and_ranges(spark):
    df = spark.createDataFrame([(["a/b/c", "a > b > d", "", "a/b"], ["3-5", "", "12"])], "p array<string>, r array<string>")
    assert df.select(T.common_section_path("p").alias("v")).first()["v"] == "a > b"
    assert df.select(T.merge_page_ranges("r").alias("v")).first()["v"] == "3-12"


def test_faithfulness_and_copying(spark):
    df = spark.createDataFrame([("a b b z", "a b", "x" * 30 + "! short", "_" + "x" * 30)], "a string, c string, s string, t string")
    row = df.select(T.lexical_faithfulness(F.col("a"), F.col("c")).alias("f"), T.copy_ratio(F.col("s"), F.col("t")).alias("k"), T.lexical_faithfulness(F.lit(""), F.lit("")).alias("e")).first()
    assert (row.f, row.k, row.e) == (0.75, 0.5, 1.0)


@pytest.mark.parametrize(("score", "want"), [(0.0, 0.0), (1.0, 1.0), (1.5, 0.8175744761936437), (-0.1, 0.47502081252106), (60.0, 1.0), (-60.0, 0.0)])
def test_score_normaliser_steps_where_its_parts_meet(spark, score, want):
    assert abs(value(spark, S.normalize_score(F.lit(score))) - want) < 1e-12


def test_boxes(spark):
    for text in ('{"x0": 1, "y0": 2, "x1": 3, "y1": 5}', '{"left": 1, "top": 2, "right": 3, "bottom": 5}', '{"x": 1, "y": 2, "width": 2, "height": 3}', "[1, 2, 3, 5]"):
        assert tuple(of(spark, S.box_of_json, text)) == (1.0, 2.0, 3.0, 5.0)
    assert of(spark, S.box_of_json, "{}") is None
    box = S.box_of_polygon(F.array(*[F.lit(float(x)) for x in (4, 1, 0, 3, 2, 9)]))
    assert tuple(value(spark, box)) == (0.0, 1.0, 4.0, 9.0)
    share = F.struct(F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"), F.lit(0.5).alias("x1"), F.lit(1.2).alias("y1"))
    assert tuple(value(spark, S.crop_box(share, F.lit(100), F.lit(50)))) == (10, 10, 50, 50)


def test_dates_and_ids(spark):
    day = lambda d: F.lit(d).cast("date")
    same = value(spark, S.between_dates(day("2024-01-02"), day("2024-01-02"), True))
    assert len(same) == 2
    assert len(value(spark, S.between_dates(day("2024-01-09"), day("2024-01-02"), False))) == 6
    assert value(spark, S.week_of_year(day("2024-01-01"))) == 1 and value(spark, S.week_of_year(day("2023-01-08"))) == 1
    assert value(spark, S.seconds_between(F.lit(None).cast("timestamp"), F.current_timestamp())) == -1
    assert value(spark, S.snowflake_millis(S.snowflake(F.lit(1700000000000), F.lit(3), F.lit(4), F.lit(5)))) == 1700000000000
    parts = value(spark, S.uid_parts(S.uid(F.lit(1716134400 + 77), F.lit(9), F.lit(8))))
    assert tuple(parts) == (1716134477, 9, 8)
    assert value(spark, S.parse_date(F.lit("no"), "yyyy-MM-dd")) is None and value(spark, S.number_key(F.lit(None).cast("timestamp"))) == 0


def test_maps(spark):
    merged = S.without_empty(S.merge_maps(S.json_map(F.lit('{"a": "1", "b": ""}')), S.json_map(F.lit('{"a": 2, "c": null}'))))
    assert value(spark, merged) == {"a": "2"}
    assert value(spark, S.json_map(F.lit("[]"))) == {}


def test_options_outside_their_limits_are_named():
    from docloom.functions import scalars as S

    good = {name: low for name, (low, _) in S.EXTRACTION_LIMITS.items()}
    assert S.in_ranges(good, S.EXTRACTION_LIMITS) == []
    bad = good | {"batchChunkLimit": True, "maxQuoteChars": 2001, "maxUnitTextChars": 50.0, "outputReserve": None}
    bad.pop("promptReserve")
    assert S.in_ranges(bad, S.EXTRACTION_LIMITS) == ["batchChunkLimit", "maxQuoteChars", "maxUnitTextChars", "outputReserve", "promptReserve"]
