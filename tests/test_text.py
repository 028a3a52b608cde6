"""Golden cases of the text kernel."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.profile import CJK_PROFILE


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("lines", "joined"),
    [
        (["2016 2017", "2020 2022 年版。"], "2016 2017 2020 2022 年版。"),
        (["中文", "断行"], "中文断行"),
        (["abc", "中"], "abc中"),
        (["foo-", "bar"], "foo-bar"),
        ([" a ", "", "b"], "a b"),
        (["\u3000a\u3000", "b"], "a b"),
        ([], ""),
    ],
)
def test_join_lines(spark, lines, joined):
    array = F.array(*[F.lit(x) for x in lines]) if lines else F.array().cast("array<string>")
    assert one(spark, tx.join_lines(array)) == joined


@pytest.mark.parametrize(("text", "plain"), [("a<sub>；</sub>b<sup>2</sup>", "a；b2"), ("<sub>a\nb</sub>", "<sub>a\nb</sub>"), ("<sub>x", "<sub>x"), ("<sub><sub>x</sub></sub>", "<sub>x</sub>")])
def test_strip_tags(spark, text, plain):
    assert one(spark, tx.strip_tags(F.lit(text))) == plain


@pytest.mark.parametrize(
    ("note", "tidy"),
    [("《史记 · 秦本纪》 : 中华书局 ( 1959 年 ) 第 2－3 页", "《史记·秦本纪》：中华书局 （1959 年） 第 2-3 页"), ("Smith (2001) : p. 3", "Smith (2001) : p. 3"), ("a  b 。", "a b。")],
)
def test_tidy_footnote(spark, note, tidy):
    assert one(spark, tx.tidy_footnote(F.lit(note))) == tidy


def test_significant(spark):
    assert one(spark, tx.significant(F.lit("秦令⑧，(8) **x**—Ａ"))) == "秦令⑧8x"


@pytest.mark.parametrize(("text", "n", "shown"), [("abcdef", 4, "ab……〔中略 2 字〕……ef"), ("abcdefg", 5, "ab……〔中略 2 字〕……efg"), ("abc", 5, "abc")])
def test_cut(spark, text, n, shown):
    assert one(spark, tx.cut(F.lit(text), n)) == shown


def test_marks_and_their_indexes(spark):
    assert one(spark, tx.mark_index(F.lit("⑳"))) == 19
    assert one(spark, tx.mark_of(F.lit(0))) == "①"
    assert one(spark, tx.mark_of(F.lit(20))) == ""
    assert one(spark, tx.leading_marks(F.lit("②③史记①"))) == "②③"
    assert one(spark, tx.pieces(F.lit("a①b②"))) == ["a", "①b", "②"]


@pytest.mark.parametrize(
    ("before", "after", "cuts"),
    [("甲未完", "续。", True), ("近代化。[^11]", "续。", False), ("未完[^3]", "续", True), ("甲未完", "第二章 x", False), ("# 甲", "续", False), ("甲", "![](x)", False), ("", "续", False)],
)
def test_is_break(spark, before, after, cuts):
    assert one(spark, tx.is_break(F.lit(before), F.lit(after), CJK_PROFILE)) is cuts


def test_numbers_in_both_widths(spark):
    assert one(spark, tx.first_number(F.lit("第１２页 3"))) == 12
    assert one(spark, tx.first_number(F.lit("none"))) is None
    assert one(spark, tx.parse_numbers(F.lit("12，30, 4"))) == [12, 30, 4]


def test_added_note(spark):
    row = one(spark, tx.parse_added_note(F.lit("3:2: 史记: 卷一")))
    assert (row["page_idx"], row["circ"], row["text"]) == (3, 1, "史记: 卷一")
    assert one(spark, tx.parse_added_note(F.lit("x:2:y"))) is None


@pytest.mark.parametrize(("path", "inside"), [("a/b.json", True), ("../x", False), ("a/../../x", False), ("a/../b", True), ("/etc/x", False), ("C:\\x", False)])
def test_archive_members(spark, path, inside):
    assert one(spark, tx.member_is_inside(F.lit(path))) is inside


def test_names_and_heads(spark):
    assert one(spark, tx.safe_name(F.lit(" 甲/乙: 丙?"))) == "甲／乙- 丙-"
    assert one(spark, tx.frontmatter(F.lit("---\na: 1\n---\nx"))) == "a: 1"
    assert one(spark, tx.frontmatter(F.lit("x"))) is None
