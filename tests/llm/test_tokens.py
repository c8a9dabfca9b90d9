import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, awkward, frame, got
from tidemark.llm import bpe, range_coder, token_store, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def units():
    return words.Units(words.read_tokenizer(PATH))


LETTERS = [" "] * 6 + list("ab'sS1é\n\t\r\x1c\x1f\x85\xa0 ᠎​　.,!?$ñ中Ⅷ²ª\0") + [
    "<|endoftext|>", "'ll", " 's", "  ", "\n \n", "\U0001f600", ".\nAb"
]


def test_units_encode_like_the_whole_text(library, units):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 16)))
        parts = units.split(text)
        small = [w for u in parts for w in units.words(u)]
        assert "".join(parts) == text == "".join(small)
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for ids in units.encode(parts) for i in ids] == want
        assert [i for ids in units.encode(small) for i in ids] == want
        assert np.frombuffer(b"".join(units.packed(small, "<u2")), "<u2").tolist() == want


def test_pieces_decode_like_the_library(library):
    table = dict(words.pieces(words.read_tokenizer(PATH)))
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(5)]
        assert b"".join(table[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        words.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_packed_numbers():
    rng = random.Random(3)
    for _ in range(100):
        values = np.array([rng.randrange(1 << rng.randint(1, 40)) for _ in range(rng.randint(0, 50))], "int64")
        assert (words.unpack_numbers(words.pack_numbers(values)) == values).all()


def wanted(rows, library, end=()):
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        yield doc_id, [*library.encode(text or "", add_special_tokens=False).ids, *end]


@pytest.mark.parametrize("chunk", [32 << 20, 500])
def test_encode_decode(spark, monkeypatch, library, chunk):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(bpe, "ROW_WORDS", 100)
    rows = awkward()
    found = bpe.encode_decode(frame(spark, rows), PATH)
    have = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) for r in found.collect()]
    want = [(d, ids, len(ids), library.decode(ids, skip_special_tokens=False)) for d, ids in wanted(rows, library)]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_encode_nothing(spark):
    assert bpe.encode_decode(frame(spark, [], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 70_000])
@pytest.mark.parametrize("kind", ["one", "two", "uniform", "skewed", "repeating", "large"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "one": lambda: np.zeros(n, "int64"), "two": lambda: rng.integers(0, 2, n), "uniform": lambda: rng.integers(0, 50257, n),
        "skewed": lambda: rng.zipf(1.3, n) % 50257, "repeating": lambda: np.resize(rng.integers(0, 50257, 97), n),
        "large": lambda: rng.integers(0, 131072, n),
    }[kind]()
    block = range_coder.write_block(ids, b"extra")
    back, extra = range_coder.read_block(block)
    assert (back == ids).all() and extra == b"extra"
    if kind in ("one", "repeating") and n == 70_000:
        assert len(block) < n


@pytest.mark.parametrize("top", [1 << 17, 200_000, (1 << 32) - 1])
def test_large_ids(top):
    rng = np.random.default_rng(top % 97)
    ids = np.append(rng.integers(0, top, 5000) % rng.choice([50, top], 5000), top)
    back, _ = range_coder.read_block(range_coder.write_block(ids))
    assert (back == ids).all()


def test_more_ids_than_shares_of_18_bits():
    ids = np.random.default_rng(1).permutation(400_000)
    back, _ = range_coder.read_block(range_coder.write_block(ids))
    assert (back == ids).all()


def test_damage_is_found():
    block = bytearray(range_coder.write_block(np.arange(1000) % 37))
    for at in (0, 10, len(block) // 2, len(block) - 1):
        broken = bytes(block[:at]) + bytes([block[at] ^ 1]) + bytes(block[at + 1 :])
        with pytest.raises(range_coder.BlockError):
            range_coder.read_block(broken)
    with pytest.raises(range_coder.BlockError):
        range_coder.read_block(b"")


@pytest.mark.parametrize("block_ids,chunk,units", [(1 << 22, 24 << 20, 1 << 19), (300, 20, 7)])
def test_store_round_trip(spark, tmp_path, monkeypatch, library, block_ids, chunk, units):
    monkeypatch.setattr(token_store, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(words, "SLICE", units)
    rows = awkward()
    path = str(tmp_path / "tokens")
    token_store.write_tokens(frame(spark, rows).repartition(5), PATH, path, end_id=2, block_ids=block_ids)
    found = token_store.read_tokens(spark, path).collect()
    want = list(wanted(rows, library, end=(2,)))
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found if r["doc_id"] is not None) == sorted(
        (d, ids) for d, ids in want if d is not None
    )
    in_order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == [d for d, _ in want]
    at = 0
    for r in in_order:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]


def test_arrow_encodes_as_the_library(library):
    """Any mixture of blanks, marks, letters and added tokens, in whole batches."""
    bits = [
        " ", "  ", "\n", " \n", "\t", "\r\n", "\u00a0", "\u3000", "\u200b", "\u180e", "\x85", "\x1c", "\0", "a", "é", "foo", "Bar", "日本",
        "ß", "ª", "ı", "\u017f", "x\u0301", "\U0001f44d", "'s", "'", "12", "***", ".,", "_", "-", "`", "~", "{}", "<", "|", "<|endoftext|>",
    ]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(20_000)] + [None, "", " ", "  "]
    ids, sizes = words.Units(words.read_tokenizer(PATH)).encode_texts(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == [i for mine in want for i in mine]


def test_store_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_tokens(frame(spark, [], SCHEMA), PATH, path)
    assert token_store.read_tokens(spark, path).count() == 0


def test_queries_digest_the_outputs(spark, tmp_path, library):
    from tidemark.llm import queries

    rows = [r for r in awkward() if r[0] is not None]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(
        (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for d, ids in wanted(rows, library)
    )
    assert got(queries.QUERIES["op9_bpe_encode_decode"](spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    stored = queries.QUERIES["op8_token_blocks"](spark, str(tmp_path))
    crcs = sorted((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in wanted(rows, library, end=(2,)))
    assert got(stored, "doc_id", "n_tokens", "ids_crc32") == sorted(crcs, key=repr)
    assert stored.where(F.col("start") == 0).count() == 1


def test_words_are_encoded_again_beyond_the_memory_and_no_table_is_left(spark, library, monkeypatch):
    rows = awkward()
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    found = bpe.encode_decode(frame(spark, rows).repartition(3), PATH)
    assert {t.name for t in spark.catalog.listTables()} == before
    # The documents stay where they are bucketed: only the words are shuffled.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") <= 1
    want = sorted((d, ids) for d, ids in wanted(rows, library) if d is not None)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found.collect() if r["doc_id"] is not None) == want


class Sent:
    """A tokenizer that keeps how many characters and strings it was given."""

    def __init__(self, of):
        self.of, self.longest = of, 0

    def encode_batch_fast(self, texts, **options):
        self.longest = max([self.longest, *map(len, texts)])
        return self.of.encode_batch_fast(texts, **options)


def lines_of_words(n):
    rng = random.Random(n)
    return ["".join(rng.choice("abcdeéñüßÿ") for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 1000])
def test_words_are_encoded_together_as_one_by_one(library, n):
    """Cutting words apart within the library took half of the encoding; only marks part them now."""
    units, lines = words.Units(words.read_tokenizer(PATH)), lines_of_words(n)
    units._of_words = Sent(units._of_words)
    assert units._of_words.of.pre_tokenizer is None
    ids, sizes = units._lines("\n".join(lines).encode(), n)
    wanted = [library.encode(w, add_special_tokens=False).ids for w in lines]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
    assert units._of_words.longest <= words.GROUP * 25


def encoded(units, library, texts):
    ids, sizes = units.encode_texts(pa.array(["of another slice", *texts], pa.string()).slice(1), 2)
    want = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == [i for mine in want for i in mine]


# Alike in their first 7, 8, 14, 15 and 16 bytes, zero bytes at the end, and nothing.
ALIKE = [
    "a", "a\0", "a\0\0", "abcdefg", "abcdefgh", "abcdefgi", "abcdefghij", "abcdefghijklmn", "abcdefghijklmno", "abcdefghijklmnop",
    "abcdefghijklmnoq", "ééééééé", "éééééééé", "é" * 40, "a" * 300, ",", "a,", "a.\nb!", "", None, " ", " a", "  a", "a  b", "a <|endoftext|> b",
]


@pytest.mark.parametrize("mix", [None, (1, 0), (1, 1)])
@pytest.mark.parametrize("memory", [1 << 19, 6, 0])
def test_remembered_units_have_the_ids_of_the_library(library, monkeypatch, mix, memory):
    """Also with units that share a mixed number, and where few are kept."""
    monkeypatch.setattr(words, "MEMORY", memory)
    if mix:
        monkeypatch.setattr(words, "_MIX", mix)
    units, rng = words.Units(words.read_tokenizer(PATH)), random.Random(4)
    for n in (1, 30, 0, 200, 200):
        encoded(units, library, [None if t is None else " ".join([t, *rng.choices(ALIKE[:16], k=3)]) for t in rng.choices(ALIKE, k=n)])
        encoded(units, library, ALIKE)
        for kept in (units._units, units._words):
            assert len(kept.sizes) == len(kept._low) == len(kept._high) == len(kept._met) <= memory
            assert len(kept.ids) == kept.sizes.sum()


def test_a_call_that_fails_leaves_the_memory_whole(library, monkeypatch):
    units = words.Units(words.read_tokenizer(PATH))
    encoded(units, library, ALIKE)
    with monkeypatch.context() as broken:
        broken.setattr(units, "_of_words", None)
        with pytest.raises(AttributeError):
            units.encode_texts(pa.array(["some words that are new"]), 2)
    encoded(units, library, ["some words that are new", *ALIKE])


def test_words_are_encoded_once_for_all_tasks_of_a_process(library):
    """Every task built its own tokenizer and encoded words again that the tasks before it had."""
    units = words.lasting_units(words.read_tokenizer(PATH))
    assert words.lasting_units(words.read_tokenizer(PATH)) is units
    units, lines = words.Units(words.read_tokenizer(PATH)), [w[:6] for w in lines_of_words(300)]
    encoded(units, library, [" " + " ".join(lines)])
    units._of_words = Sent(units._of_words)
    encoded(units, library, [" " + " ".join(reversed(lines)), "x " + " ".join(lines)])
    assert units._of_words.longest <= 1
    # A mark behind a word that came before leaves the word itself remembered.
    encoded(units, library, ["x " + " ".join(w + "," for w in lines)])
    assert units._of_words.longest <= 1


def test_a_vocabulary_whose_every_byte_is_merged(library):
    """No byte can stand between words: line ends are isolated by a pattern."""
    spec = json.loads(words.read_tokenizer(PATH))
    letters = {b: c for c, b in words.byte_alphabet().items()}
    top = max(spec["model"]["vocab"].values(), default=0) + len(spec["added_tokens"]) + 1
    pair = [*spec["model"]["merges"][:1]][0]
    for b in words._NEVER:
        token = letters[b] * 2
        spec["model"]["vocab"].setdefault(token, top + b)
        spec["model"]["merges"].append(" ".join([letters[b]] * 2) if isinstance(pair, str) else [letters[b]] * 2)
    units, lines = words.Units(json.dumps(spec)), lines_of_words(100)
    assert units._of_words.pre_tokenizer is not None
    ids, sizes = units._lines("\n".join(lines).encode(), 100)
    wanted = [library.encode(w, add_special_tokens=False).ids for w in lines]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])


def test_model_keeps_to_32_bits(monkeypatch):
    """Twice as wide numbers and np.where on random masks made a fifth of the decoding."""
    seen = []
    interval = range_coder._Model.interval
    monkeypatch.setattr(range_coder._Model, "interval", lambda m, ids: seen.append(interval(m, ids)) or seen[-1])
    ids = np.random.default_rng(3).zipf(1.3, 5000) % 60000
    assert (range_coder.read_block(range_coder.write_block(ids))[0] == ids).all()
    assert {a.dtype.name for pair in seen for a in pair} == {"int32"}
