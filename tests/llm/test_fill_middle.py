import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, awkward, frame, got, row, words
from tidemark.llm import fill_middle


def brute(doc_id, text):
    """The contract, character by character."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def corpus():
    rng = random.Random(3)
    pool = ["\U0001f600", "é", "é", "\n", "\r\n", " ", "$1", "\\", "<", ">", "<P", "S>", "\0", " ", "a", "{2}", "\\E", "<M"]
    rows = [row(200 + i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [row(600 + i, f"x{m}y") for i, m in enumerate(("<P>", "<S>", "<M>", "<p>"))]
    rows += [row(700 + i, "\U0001f600é\n" * 120_000) for i in range(3)]
    return rows + awkward()


def test_equals_cutting_by_characters(spark):
    rows = corpus()
    found = fill_middle.transform(frame(spark, rows))
    want = sorted(((r[0], *brute(r[0], r[1])) for r in rows), key=repr)
    assert got(found, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert got(back, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_digests_equal_their_sql(spark):
    df = frame(spark, corpus())
    have = fill_middle.digests(fill_middle.transform(df))
    con = duckdb.connect()
    con.register("raw", df.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM raw")
    assert got(have, *have.columns) == sorted(con.execute(fill_middle.SQL).fetchall(), key=repr)
    assert have.columns == [d[0] for d in con.execute(fill_middle.SQL).description]


def test_other_units(spark):
    """Words as units: white space goes with the word after it, what is left with the suffix."""
    rng = random.Random(5)
    texts = [words(rng, n) + tail for n in (1, 5, 50, 3000, 30_000) for tail in ("", " \n")]
    found = fill_middle.transform(frame(spark, [row(i, t) for i, t in enumerate(texts)]), unit=r"\s*\S+").collect()
    for r in found:
        units = re.findall(r"\s*\S+", texts[r["doc_id"]])
        assert r["n"] == len(units)
        if r["form"] == "psm":
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            suffix = texts[r["doc_id"]][len("".join(units[:b])) :]
            assert r["output"] == f"<P>{''.join(units[:a])}<S>{suffix}<M>{''.join(units[a:b])}"


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 2000, 123_456])
def test_counts_at_the_edges_of_runs(spark, n):
    df = spark.createDataFrame([("é" * n,)], "t string")
    assert df.select(fill_middle.count_units(F.col("t"))).first()[0] == n


def test_empty_table_and_one_match_a_row(spark):
    found = fill_middle.transform(frame(spark, [], SCHEMA))
    assert found.count() == 0
    plan = fill_middle.digests(fill_middle.transform(frame(spark, corpus())))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("}+)((?:") == 1  # the row's pattern is matched once, not once per part or use
