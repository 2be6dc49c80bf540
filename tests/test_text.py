from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.similarity import gestalt_ratio

TEXTS = ["", "  a  b ", "- foo", "---", "　全角　空白　", "a b c", "# Title\nbody", "#\n", "one line", "```json\n{\"a\": 1}\n``` rest", "```python\nx\n```", " ```\nopen", "| a | b |", "|", "| a", "•– x_y*"]


def run(spark, column, texts=TEXTS):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in frame.orderBy("i").select(column(F.col("t")).alias("x")).collect()]


def test_white_space_is_that_of_unicode(spark):
    assert run(spark, T.strip) == [t.strip() for t in TEXTS]
    assert run(spark, T.split_words) == [t.split() for t in TEXTS]
    assert run(spark, T.squeeze) == [" ".join(t.split()).lower() for t in TEXTS]


def test_normalize_keeps_the_blank_beside_a_deleted_mark(spark):
    got = run(spark, T.normalize)
    assert got[2] == " foo" and got[3] == "" and got[-1] == " xy"


def test_title_and_rest(spark):
    lines = [t.split("\n", 1) for t in TEXTS]
    assert run(spark, T.first_line_title) == [x[0].replace("#", "").strip() for x in lines]
    assert run(spark, T.after_first_line) == [(x[1] if len(x) > 1 else "").strip() for x in lines]


def test_fences_and_table_lines(spark):
    fences = run(spark, T.strip_fence)
    assert fences[9] == '{"a": 1}' and fences[10] == "python\nx" and fences[11] == "open" and fences[8] == "one line"
    assert [t for t, ok in zip(TEXTS, run(spark, T.is_table_line), strict=True) if ok] == ["| a | b |"]
    assert run(spark, T.heading_text, ["## a ", "#b", "c"]) == ["a", "b", "c"] and run(spark, T.snippet, ["x" * 300, "y"]) == ["x" * 200 + "...", "y..."]
    assert run(spark, T.squeeze_blank_lines, [" a\n \n\n\nb\n"]) == ["a\n\nb"]


def test_ratio_depends_on_order(spark):
    frame = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    assert [r.x for r in frame.select(gestalt_ratio("a", "b").alias("x")).collect()] == [0.25, 0.5, 1.0]
