"""Queries that SQL can express, on the given tables and on awkward rows."""

import duckdb
import pytest

from reckoner.llm import licenses, lines, mixing
from reckoner.llm.oracle import SQL
from reckoner.llm.queries import QUERIES
from tests.compare import connection, differences
from tests.llm.conftest import ODD, SF

OPERATORS = {
    "op2_license_scan": licenses.labelled, "op8_quality_rules": lines.judge,
    "op3_source_mix": lambda d: mixing.mix(d).selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken"),
}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", ODD)
    assert differences(OPERATORS[name](odd), con, SQL[name]) is None


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none, name):
    assert OPERATORS[name](none).collect() == []


def test_native_queries_run_no_python(spark):
    for name in ("op2_license_scan", "op3_source_mix"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_base_phrases_across_lines_and_blocks(spark):
    text = " ".join(["x"] * 31) + "\nAll Rights\nreserved; CC-BY " + " ".join(["y"] * 200) + " general PUBLIC license, cc by"
    row = licenses.labelled(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (4, 31, 239, "cc-by,gpl,reserved")


def test_lines_of_many_documents_deplete(spark):
    common = "this line is on every page of the host and says nothing new at all " * 4
    own = lambda i, n: " ".join(chr(97 + i // 20) + chr(97 + i % 20) + chr(97 + k // 20) + chr(97 + k % 20) for k in range(n))
    rows = [(i, common + "\n" + own(i, 20), "a") for i in range(40)]
    rows += [(100 + i, own(i, 80), "a") for i in range(40)]
    kept = {r.doc_id: r.kept for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(40))


def test_mix_comes_near_its_targets_and_repeats_rows(docs):
    rows = mixing.mix(docs).toPandas()
    for _, g in rows.groupby("_source"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= g["size"].max()
        assert g["copies"].max() <= mixing.MAX_REPEAT and g["target"].iloc[0] <= 3 * g["source_size"].iloc[0]
    assert abs(rows.groupby("_source")["target"].first().sum() - rows["size"].sum()) < 1e-3
    assert mixing.mixed(docs).count() == rows["copies"].sum()


def test_words_of_a_notice_must_stand_together(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = ["The MIT press works under the terms of its own house license.", " ".join(mit.split()[:17]), "By nc and cc, licensed under.", mit,
             "x " * 40 + mit.replace("hereby", "now hereby") + " y" * 50,  # a word put in
             " ".join(w + " far away" * 3 for w in mit.split()),  # every word there, but not together
             "under the mit " + "x " * 70 + "license"]
    rows = licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(rows)] == ["", "mit", "", "mit", "mit", "", ""]


def test_a_template_of_any_length(spark):
    rng = __import__("random").Random(2)
    words = [f"t{i}" for i in range(150)]
    template = licenses.Template("long", " ".join(words))
    half, most = list(words), list(words)
    for i in rng.sample(range(150), 60):
        half[i] = "other"
    for i in rng.sample(range(150), 25):
        most[i] = "other"
    texts = [" ".join(["a"] * 333 + words + ["b"] * 77), " ".join(["a"] * 101 + most), " ".join(half), " ".join(words[:125]), " ".join(words[:110])]
    rows = licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=(*licenses.PHRASES, template)).collect()
    assert [r.labels for r in sorted(rows)] == ["long", "long", "", "long", ""]
    assert [round(r.score, 3) for r in sorted(rows)] == [1.0, round(125 / 150, 3), 0.0, round(125 / 150, 3), 0.0]


def test_a_source_at_its_limit_goes_through_no_window(spark):
    rows = [(i, "w " * (5 + i % 7), "a" if i < 60 else "b" if i < 400 else "c") for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    few = [r for r in out.collect() if r._source == "a"]
    assert {r.copies for r in few} == {mixing.MAX_REPEAT} and few[0].target == mixing.MAX_REPEAT * few[0].source_size
    assert sum(r.copies * r["size"] for r in few) == few[0].target


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b c", "x")] * 7 + [(None, "d e", "x")] * 5 + [(i, "f " * 9, "y") for i in range(2, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixed(df).count() == mixing.mix(df).agg({"copies": "sum"}).first()[0]


def test_notices_of_one_license_are_not_those_of_another(spark):
    texts = ["This work is licensed under the GNU General Public License version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.",
             "Released under the Zlib license.", "Released under the MIT license.", "Licensed under the Apache License, Version 2.0.",
             "Under the GNU Lesser General Public License.", "This file is licensed under the GNU General Public License, version 2.0."]
    rows = licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(rows)] == ["gpl,gpl-notice", "cc-by,cc-by-nc", "cc-by,cc-by-sa", "", "mit", "apache-2.0", "gpl,lgpl", "gpl,gpl-notice"]
