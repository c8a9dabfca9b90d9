import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, awkward, frame, got, row, words
from tidemark.llm import contamination

ITEMS = "item_id long, text string, doc_id long, source string"


def items(rng):
    """Long, short, one-word, wordless and null items, shared passages, repeated rows and ids."""
    passage = words(rng, 30)
    rows = [(i, words(rng, rng.randint(10, 40)), None, "x") for i in range(20)]
    rows += [(20 + i, f"{words(rng, 4)} {passage} {words(rng, i)}", 1, None) for i in range(5)]
    rows += [(30 + n, words(rng, n, "xyz"), 1, "y") for n in range(1, 10)]
    rows += [(50, "zulu", 1, "y"), (51, " .,- ", 1, "y"), (52, "", 1, "y"), (53, None, 1, "y"), (54, "rust " * 25, 1, "y")]
    rows += [rows[0], (20, words(rng, 12), 1, "z"), (None, words(rng, 15, "uvw"), None, None)]
    return rows, passage


def corpus(rng, bench, passage):
    rows = awkward()
    for i, (_, text, *_) in enumerate(bench):
        part = (text or "").split()
        begin = rng.randint(0, max(len(part) - 10, 0))
        rows.append(row(1000 + i, f"{words(rng, 20)} {(text or '').upper()}, {words(rng, 9)}"))
        rows.append(row(2000 + i, f"{words(rng, 5)}\n{' '.join(part[begin : begin + 9])} {words(rng, 9)}"))
        rows.append(row(3000 + i, f"{words(rng, 5)}\n{' '.join(part[begin : begin + 10])} {words(rng, 9)}"))
    rows += [row(4000 + i, f"{passage} {passage} tail") for i in range(40)]
    rows += [row(5000, " ".join(t or "" for _, t, *_ in bench)), row(5001, "rust " * 12), row(5002, "rust " * 9), row(5003, "é zulu Ünï")]
    rows.append(row(5004, words(rng, 30_000) + f" {passage} " + words(rng, 500)))
    return rows + [rows[-1]]


def by_sql(df, bench):
    con = duckdb.connect()
    con.register("raw", df.select("doc_id", "text").toPandas())
    con.register("raw_items", bench.select("item_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM raw")
    con.execute("CREATE VIEW benchmark AS SELECT item_id::BIGINT AS item_id, text FROM raw_items")
    return sorted(con.execute(contamination.check_sql()).fetchall(), key=repr)


def test_equals_looking_up_every_window(spark):
    rng = random.Random(1)
    bench, passage = items(rng)
    df, of = frame(spark, corpus(rng, bench, passage)), spark.createDataFrame(bench, ITEMS)
    found = contamination.digests(contamination.decontaminate(df, of))
    want = by_sql(df, of)
    assert got(found, *found.columns) == want
    hit = {r[0] for r in want if r[5]}
    assert {3000 + i for i in range(25)} <= hit and {4000, 5000, 5001, 5003, 5004} <= hit


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_ties(spark, seed):
    """Two or three different words: equal k-grams everywhere, windows overlap themselves."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(n))
    bench = [(i, text(rng.randint(1, 14)) if i % 7 else text(2), None, None) for i in range(30)]
    df, of = frame(spark, [row(i, text(rng.randint(0, 60))) for i in range(200)]), spark.createDataFrame(bench, ITEMS)
    found = contamination.digests(contamination.decontaminate(df, of))
    assert got(found, *found.columns) == by_sql(df, of)


@pytest.mark.parametrize("length", range(1, 11))
def test_equal_windows_have_equal_marks_wherever_they_stand(spark, length):
    rng = random.Random(length)
    shared = [rng.randint(0, 3) for _ in range(length)]
    rows = [([rng.randint(0, 3) for _ in range(n)] + shared + [rng.randint(0, 3) for _ in range(9)], n) for n in range(12)]
    df = spark.createDataFrame(rows, "h array<long>, n int")
    mark = df.select(F.expr(f"get({contamination.marks('h', length)}, n)").alias("m"))
    assert mark.distinct().count() == 1


def test_spans_are_the_places_of_windows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    df = frame(spark, [row(1, f"zero {item} {item}"), row(2, "nothing here")])
    found = contamination.decontaminate(df, spark.createDataFrame([(7, item, 1, "x"), (8, "nothing", 1, "x")], ITEMS))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 11), (2, 12), (12, 22), (13, 23)] and rows[1]["items"] == ["7"]
    assert rows[1]["n_hit"] == 22 and rows[2]["items"] == ["8"] and rows[2]["n_hit"] == 1


def test_main_path_is_native_and_empty_tables(spark):
    rng = random.Random(2)
    bench, passage = items(rng)
    df, of = frame(spark, corpus(rng, bench, passage)), spark.createDataFrame(bench, ITEMS)
    windows = contamination.item_windows(of).withColumn("window_key", F.col("window"))
    plans = [contamination.decontaminate(df, of), contamination.occurrences(df, windows)]
    for plan in (p._jdf.queryExecution().toString() for p in plans):
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert contamination.decontaminate(frame(spark, [], SCHEMA), of).count() == 0
    none = contamination.decontaminate(df, of.where("false"))
    assert none.count() == df.count() and none.where("contaminated").count() == 0


def test_words_are_what_the_pattern_matches(spark):
    rng = random.Random(5)
    odd = [chr(c) for c in [*range(128), 0x85, 0xA0, 0xAD, 0xD7, 0x130, 0x1E9E, 0x2003, 0x2028, 0x3000, 0x10400, 0x1F600, 0xFFFF]]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [*odd, "", " ", ",a", "a,", ",,a,,B,,", "A\0b", "one", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    upper = str.maketrans(contamination._UPPER, contamination._LOWER)
    want = [re.findall(contamination._WORD, (t or "").translate(upper)) for t in texts]
    found = df.select(contamination.words(F.col("text")).alias("w"), contamination.count_words(F.col("text")).alias("n")).collect()
    assert [(r.w, r.n) for r in found] == [(w, len(w)) for w in want]


def test_texts_are_cut_not_matched_word_by_word(spark):
    """A match per word cost 347 CPU seconds a GB in each of two passes."""
    df, of = frame(spark, [row(1, "a b c")]), spark.createDataFrame([(1, "a b", None, "x")], ITEMS)
    for made in (contamination.decontaminate(df, of), contamination.item_windows(of)):
        assert "regexp_extract_all" not in made._jdf.queryExecution().analyzed().toString()
