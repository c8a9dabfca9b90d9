import random
import zlib

import numpy as np
import pytest

from helpers import SCHEMA, awkward, frame, got, row, words
from tidemark.llm import langid, quality

LANGS = {"aa": "abcde", "bb": "fghij", "cc": "éèàùô"}


def languages(n=240):
    rng = random.Random(0)
    return [row(i, words(rng, rng.randint(4, 120), LANGS[lang]), lang=lang) for i in range(n) for lang in [list(LANGS)[i % 3]]]


def test_held_out_accuracy(spark):
    rows = languages() + [row(1000, None), row(1001, "12 34 !?"), row(1002, ""), row(None, "abcde abcde"), row(5, "abcde")]
    found = langid.identify(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    lang = {r[0]: r[2] for r in languages()}
    held = [r for r in found if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held if r["doc_id"] in lang]) >= 0.95
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_language_of_the_whole_text(spark):
    rng = random.Random(1)
    text = words(rng, 60, LANGS["aa"]) + " " + words(rng, 4000, LANGS["bb"])
    found = langid.identify(frame(spark, languages() + [row(999, text, lang=None)])).where("doc_id = 999").first()
    assert found["lang_pred"] == "bb"


def test_inputs_are_only_the_text(spark):
    rows = languages()
    model = langid.fit(frame(spark, rows))
    changed = [(*r[:2], "zz", "other", *r[4:]) for r in rows]
    a = got(langid.identify(frame(spark, rows), model), "doc_id", "lang_pred", "score")
    assert a == got(langid.identify(frame(spark, changed), model), "doc_id", "lang_pred", "score")


def test_tables_score_like_the_network():
    rows = languages(60)
    model = langid.train([r[1] for r in rows], [r[2] for r in rows])
    part = np.concatenate([langid.windows(r[1]) for r in rows[:9]])
    weights = {k: v for k, v in model.items() if k != "names"}
    want = np.log(langid._forward(weights, part)[0])
    assert np.allclose(langid.Scorer(model).log_probabilities(part), want, atol=1e-4)


def test_network_gradient():
    rng = np.random.default_rng(0)
    weights, x, y = langid._begin(3, 1), rng.integers(0, 256, (4, langid.WINDOW)).astype("uint8"), np.array([0, 1, 2, 1])
    grads = langid._gradients(weights, x, y)

    def loss():
        return -np.log(langid._forward(weights, x)[0][np.arange(4), y]).mean()

    for name in ("out", "filter3", "bias2", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep = weights[name][at]
        weights[name][at] = keep + 1e-5
        up = loss()
        weights[name][at] = keep - 1e-5
        down = loss()
        weights[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


@pytest.mark.parametrize("rows", [[], [row(1, "a b", lang=None), row(2, None)]])
def test_nothing_to_learn_languages(spark, rows):
    found = langid.identify(frame(spark, rows, SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)] * len(rows)


def qualities(n=300):
    rng = random.Random(2)
    out, marks = [], []
    for i in range(n):
        good = words(rng, rng.randint(10, 200))
        bad = i % 5 == 0
        if bad:
            junk = " ".join(w.upper() + "!!" for w in words(rng, rng.randint(150, 200)).split())
            good = junk if i % 2 else good[:200] + " " + junk
        out.append(row(i, good))
        marks.append((i, int(not bad), 0, "x"))
    return out, marks


LABELS = "doc_id long, quality int, toxic int, text string"


def test_quality_held_out(spark):
    rows, marks = qualities()
    odd = [row(1000, None), row(1001, ""), row(None, "words here"), row(7, "again")]
    labels = spark.createDataFrame(marks + [(None, 1, 0, ""), (3, None, 0, ""), (9999, 0, 0, "")], LABELS)
    found = quality.classify(frame(spark, rows + odd), labels).collect()
    assert len(found) == len(rows) + len(odd)
    want = {i: q for i, q, *_ in marks}
    held = [r for r in found if r["held_out"] and r["doc_id"] in want and r["doc_id"] != 7]
    assert held and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) >= 0.95
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_attention_finds_the_bad_passage():
    rows, marks = qualities()
    model = quality.train([r[1] for r in rows], [q for _, q, *_ in marks], 0.8)
    rng = random.Random(9)
    clean = words(rng, 300)
    dirty = clean[:400] + " " + " ".join(w.upper() + "!!" for w in words(rng, 180).split())
    p = quality.probabilities(model, [clean, dirty, clean])
    assert p[0] > 0.5 > p[1] and p[0] == pytest.approx(p[2])
    one_by_one = np.concatenate([quality.probabilities(model, [t]) for t in (clean, dirty)])
    assert np.allclose(one_by_one, p[:2])


def test_attention_gradient():
    rng = np.random.default_rng(0)
    w = quality._begin(1)
    x, bag, y = rng.random((7, quality.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([0.0, 1.0, 1.0])
    grads = quality._gradients(w, x, bag, y)

    def loss():
        p = quality._forward(w, x, bag, 3)[0]
        ce = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        return ce + 0.5e-4 * sum((v * v).sum() for k, v in w.items() if k != "out_bias")

    for name in w:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep = w[name][at]
        w[name][at] = keep + 1e-5
        up = loss()
        w[name][at] = keep - 1e-5
        down = loss()
        w[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_quality_without_two_labels(spark):
    rows, marks = qualities(20)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.classify(frame(spark, rows), none).collect()} == {0.5}
    ones = spark.createDataFrame([m for m in marks if m[1] == 1], LABELS)
    assert {r["score"] for r in quality.classify(frame(spark, rows), ones).collect()} == {1.0}
    assert quality.classify(frame(spark, [], SCHEMA), none).count() == 0


def test_awkward_rows_are_scored(spark):
    rows, marks = qualities()
    extra = awkward(4)
    found = quality.classify(frame(spark, rows + extra), spark.createDataFrame(marks, LABELS))
    assert found.count() == len(rows) + len(extra)
    assert langid.identify(frame(spark, languages() + extra)).count() == 240 + len(extra)


def test_training_takes_whole_texts(spark):
    """What tells the classes apart stands at the far end of long texts."""
    from tidemark.llm import training

    long = "the same words for all of them " * 400
    rows = [(i, long + ("alpha " if i % 2 else "omega ") * 30, "a" if i % 2 else "o") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = training.sample(docs, docs, "lang", 15, 4)
    assert len(found) == 30 and set(found["text"].map(len)) == {len(r[1]) for r in rows}
