import duckdb

from helpers import SCHEMA, awkward, frame, got, row, words
import random

from tidemark.llm import licenses


def corpus():
    rng = random.Random(0)
    rows = awkward()
    for i, (_, notice) in enumerate(licenses.NOTICES):
        rows.append(row(500 + i, words(rng, rng.randint(0, 300)) + " " + notice.upper() + " " + words(rng, 50)))
        part = notice.split()
        rows.append(row(600 + i, words(rng, 40) + "\n" + " ".join(part[: int(len(part) * 0.9)]) + " " + words(rng, 40)))
        rows.append(row(700 + i, " ".join(part[: len(part) // 2]) + " " + words(rng, 40)))
    rows.append(row(800, " ".join(n for _, n in licenses.NOTICES)))
    return rows


def test_finds_what_comparing_everything_finds(spark):
    df = frame(spark, corpus())
    con = duckdb.connect()
    con.register("raw", df.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM raw")
    want = sorted(con.execute(licenses.check_sql()).fetchall(), key=repr)
    have = got(licenses.licenses(df), "doc_id", "license", "containment")
    assert have == want
    found = {r[0] for r in have}
    assert {500 + i for i in range(len(licenses.NOTICES))} <= found
    assert not found & set(range(0, 109))


def test_one_license_per_overlapping_match(spark):
    rng = random.Random(4)
    texts = [t for _, t in licenses.NOTICES]
    df = frame(spark, [row(i, words(rng, 30) + " " + t + " " + words(rng, 30)) for i, t in enumerate(texts)])
    found = {}
    for doc, name, _ in got(licenses.licenses(df), "doc_id", "license", "containment"):
        found.setdefault(doc, set()).add(name)
    assert found == {i: {name} for i, (name, _) in enumerate(licenses.NOTICES)}
    both = [t for n, t in licenses.NOTICES if n in ("AGPL-3.0", "GPL-3.0")]
    two = licenses.licenses(frame(spark, [row(1, words(rng, 300).join(both)), row(None, both[0])]))
    assert [r[:2] for r in got(two, "doc_id", "license")] == sorted([(1, "AGPL-3.0"), (1, "GPL-3.0"), (None, "AGPL-3.0")], key=repr)


def test_main_path_is_native(spark):
    plan = licenses.licenses(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_own_templates_and_empty_tables(spark):
    own = spark.createDataFrame([("own", "alpha beta gamma delta epsilon zeta"), ("short", "too short"), ("none", None)], "license string, notice string")
    df = frame(spark, [row(1, "x Alpha, beta gamma delta epsilon zeta!"), row(2, "alpha beta gamma"), row(3, None)])
    assert got(licenses.licenses(df, own), "doc_id", "license", "containment") == [(1, "own", 1.0)]
    windows = licenses.scan(df, own).collect()
    assert windows and all(w["window_at"] <= 1 for w in windows)
    assert licenses.licenses(frame(spark, [], SCHEMA)).count() == 0
    assert licenses.licenses(df, own.where("license = 'none'")).count() == 0


def test_bands_guarantee():
    for overlap in (0.05, 0.2, 0.5, 1.0):
        n = licenses.bands_for(overlap)
        assert (1 - min(overlap, 1 - 1e-9)) ** n <= licenses.MISS
