import random

import public_tokenizers

import corpus_pipeline
from helpers import SCHEMA, awkward, frame, got, row, words
from tidemark.llm import bpe, langid, mix, quality, simhash, stages
from test_models import LABELS, LANGS

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def corpus(tmp_path, spark):
    rng = random.Random(0)
    rows, marks = [], []
    for i in range(240):
        lang = list(LANGS)[i % 2]
        text = words(rng, rng.randint(20, 120), LANGS[lang])
        bad = i % 6 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append(row(i, text, lang=lang, source=f"s{i % 4}"))
        marks.append((i, int(not bad), 0, ""))
    good = [r for r, m in zip(rows, marks) if m[1]]
    rows += [(1000 + k, *good[0][1:]) for k in range(20)] + [good[3], row(2000, "123 456 789"), row(2001, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    sf, docs = str(tmp_path), frame(spark, rows)
    one = stages.quality_filter(spark, docs, sf)
    assert one.columns == COLUMNS
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = {i for i, r in enumerate(rows) if quality.probabilities(model, [r[1]])[0] >= 0.5}
    assert got(one, *COLUMNS) == sorted((rows[i] for i in keep), key=repr)
    assert all(r[0] % 6 for r in one.collect() if r[0] is not None and r[0] < 240)
    two = stages.language_filter(spark, one, sf)
    ids = {r["doc_id"] for r in two.collect()}
    assert not ids & {2000, 2001} and {r["doc_id"] for r in one.collect()} - ids <= {2000, 2001}
    three = stages.near_duplicates(spark, two, sf)
    found = simhash.near_duplicates(two, 3, 2).collect()
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({r["component_id"] for r in found})
    assert three.columns == COLUMNS
    four = stages.mix(spark, three, sf)
    assert four.columns == COLUMNS
    assert sum(len((r["text"] or "").split()) for r in four.collect()) == sum(r["taken"] for r in mix.mix(three).collect())
    five = stages.encode(spark, four, sf)
    assert five.count() == four.count()


def test_run_is_the_stages_in_order(spark, tmp_path):
    corpus(tmp_path, spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert got(whole, *whole.columns) == got(docs, *whole.columns)


def test_awkward_rows_pass(spark, tmp_path):
    frame(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_corpus(spark, tmp_path):
    frame(spark, [], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.fit(frame(spark, [], SCHEMA))["names"] == []
    assert bpe.encode_decode(frame(spark, [], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_language_filter_keeps_what_operator_7_names(spark, tmp_path):
    rng = random.Random(2)
    rows = [row(i, words(rng, 30, "abcdefghij"), lang=f"l{i % 3}") for i in range(90)] + [row(500, "12 34"), row(501, None)]
    docs = frame(spark, rows)
    # Three names for one alphabet: no score comes near one half for every text.
    named = {r["doc_id"]: r["score"] for r in langid.identify(docs, langid.fit(docs)).collect() if r["lang_pred"] != langid.UNKNOWN}
    assert min(named.values()) < 0.5
    assert {r["doc_id"] for r in stages.language_filter(spark, docs, str(tmp_path)).collect()} == set(named) == set(range(90))


def test_one_document_of_each_group(spark, tmp_path):
    """Repeated ids with unlike texts, and null ids, in one near-duplicate group."""
    rng = random.Random(4)
    text, other, third = (words(rng, 60) for _ in range(3))
    rows = [row(1, text), row(1, text.upper()), row(1, "  ".join(text.split())), row(2, text), row(1, text)]
    rows += [row(None, other), row(None, other.upper()), row(None, other), row(None, "  " + other), row(1, third), row(None, text)]
    kept = stages.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()
    assert len(kept) == 3 and {(r["doc_id"], r["text"].lower().split()[0]) for r in kept} == {
        (1, text.split()[0]), (None, other.split()[0]), (1, third.split()[0])
    }


def test_a_hundred_languages(spark):
    """More languages than the sample has room for at full depth: fewer documents of each."""
    docs = frame(spark, [row(i, f"w{i % 100} " * 12 + chr(0x4E00 + i % 100) * 40, lang=f"l{i % 100}") for i in range(800)])
    picked = langid.sample(docs.select("doc_id", "lang"), docs, "lang", 4, 50)
    assert picked.groupby("lang").size().to_dict() == {f"l{i}": 2 for i in range(100)}
    few = langid.sample(docs.select("doc_id", "lang"), docs, "lang", 4, 5)
    assert len(few) == 20 and set(few.groupby("lang").size()) == {1}
    found = langid.identify(docs)
    assert found.count() == 800 and found.where("lang_pred = 'und'").count() == 0
