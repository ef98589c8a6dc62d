"""Text helpers against plain Python."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from reckoner.functions import draws, money, text


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_yes_no_answers(spark):
    rows = [("Yes", True), ("no", False), ("Yes.", None), ("yes and no", None), ("", None), (None, None), ("No\tway", False)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    assert [r.p for r in df.select("i", text.parse_yes_no("a").alias("p")).orderBy("i").collect()] == [w for _, w in rows]
    loose = [r.p for r in df.select("i", text.parse_yes_no("a", True).alias("p")).orderBy("i").collect()]
    assert loose[2] is True and loose[3] is None


def test_csv_line_equals_the_csv_module(spark):
    cells = ["plain", 'say "x"', "a,b", "line\nbreak", "", None, " lead", "tab\t", "cr\rx", "ümlaut"]
    names = [f"c{i}" for i in range(len(cells) - 1)] + ["with,comma"]
    df = spark.createDataFrame([tuple(cells)], ", ".join(f"`{n}` string" for n in names))
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(names)
    writer.writerow(["" if c is None else c for c in cells])
    assert df.select(text.linearize_csv(names).alias("v")).first().v == buffer.getvalue()


def test_markdown_table(spark):
    got = one(spark, text.linearize_markdown({"item": F.lit("spam"), "qty": F.lit(42)}, ["qty"]))
    assert got == "| item   |   qty |\n|:-------|------:|\n| spam   |    42 |"


def test_templates(spark):
    assert one(spark, text.fill_template("{{a}}-{{b}}", a=F.lit("{{b}}"), b=F.lit(2), c=F.lit("x"))) == "{{b}}-2"
    with pytest.raises(ValueError, match="no value"):
        text.fill_template("{{missing}}", a=F.lit(1))
    assert one(spark, text.fill_template_column(F.lit("x{{a}}{{b}}y{{a}}"), a=F.lit("$1"), b=F.lit("{{a}}"))) == "x$1{{a}}y$1"
    with pytest.raises(Exception, match="no value for template variable nope"):
        one(spark, text.fill_template_column(F.lit("{{nope}}"), a=F.lit("1")))


def test_chat_templates(spark):
    given = F.array(text.message("user", F.lit("q")), text.message("assistant", F.lit("a")))
    chat = text.fill_chat([{"role": "system", "content": "{{x}}"}, "{{shots}}", "{{one}}"], x=F.lit("s"), shots=given,
                          one={"role": F.lit("user"), "content": F.lit("last")})
    assert [(m.role, m.content) for m in one(spark, chat)] == [
        ("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "last")]
    with pytest.raises(ValueError, match="template message"):
        text.fill_chat(["{{gone}}"], x=F.lit("s"))


def test_broken_identifiers_are_one_error_away(spark):
    ids = ["", "7", "42", "1234", "12345", "INV100000000000123"]
    df = spark.range(3000).select("id", draws.pick(ids, draws.u01(1, "which", "id")).alias("s"))
    rows = df.select("s", text.break_identifier("s", 1, "brk", "id").alias("b")).collect()
    kinds = set()
    for s, b in rows:
        n = len(s)
        options = {s} if n < 5 else set()
        blank = {s[:i] + " " + s[i:] for i in range(1, n)}
        lost = {s[:i] + s[i + 1:] for i in range(n)} if n >= 5 else set()
        digit = {s[:i] + d + s[i:] for i in range(n + 1) for d in "0123456789"}
        swapped = {s[:i] + s[i + 1] + s[i] + s[i + 2:] for i in range(n - 1)} if n >= 2 else set()
        cut = {s[:-j] for j in range(1, n)} | {s[j:] for j in range(1, n)} if n >= 5 else set()
        assert b in options | blank | lost | digit | swapped | cut, (s, b)
        if n >= 5:
            kinds |= {name for name, group in (("blank", blank), ("digit", digit), ("cut", cut), ("swap", swapped)) if b in group}
    assert kinds == {"blank", "digit", "cut", "swap"}


def test_joined_ids_and_padding(spark):
    ids = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, text.join_ids(ids, "REF {{idx}}: {{identifier}}", " & ")) == "REF 0: a & REF 1: b"
    assert one(spark, text.join_ids(ids, F.lit("{{identifier}}"), F.lit(""))) == "ab"
    assert one(spark, text.mean_se(F.lit(0.9749), F.lit(0.0213))) == "0.97 ± 0.02"


def test_split_amounts(spark):
    df = spark.range(500).select(
        (F.col("id") + F.lit(0.01)).cast(money.MONEY).alias("t"),
        F.transform(F.sequence(F.lit(1), (F.col("id") % 5 + 2).cast("int")), lambda i: draws.u01(1, "w", "id", i)).alias("w"))
    for r in df.select("t", money.split_amount(F.col("t"), F.col("w")).alias("p")).collect():
        assert sum(r.p) == r.t and min(r.p) >= 0


def test_days(spark):
    assert one(spark, money.add_days(F.lit("20240228"), F.lit(2))) == "20240301"
    leap = spark.range(4000).select(money.format_day(money.day_in_year(F.lit(2024), draws.u01(1, "d", "id"))).alias("d"))
    days = {r.d for r in leap.collect()}
    assert "20240229" not in days and len(days) == 365
    with pytest.raises(Exception, match="no exchange rate"):
        one(spark, money.fx_rate(F.lit("XXX")))
