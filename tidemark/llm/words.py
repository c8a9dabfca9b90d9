"""Splitting texts into units that a byte-level BPE encodes independently of each other."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

# Units whose ids are put together at a time.
SLICE = 1 << 15
# Words that one call of the library encodes.
LINES = 1 << 15
# Words that the library takes as one.
GROUP = 32
# Strings of up to so many bytes are told apart by two numbers that hold bytes and size.
PACKED = 15
# Such units, and such words, whose ids are remembered from one call to the next.
MEMORY = 1 << 19
# The two numbers are mixed into one; strings that would share it are found and numbered as strings.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "uint64")
_NAMED = 0xFF << 56
# Bytes that no text in UTF-8 holds.
_NEVER = (0xFF, 0xFE, 0xC0, 0xC1, *range(0xF5, 0xFE))

# A space with white space on both sides: only there can white space of two units merge.
_MERGES = re.compile("[\\s\u180e\u200b] [\\s\u180e\u200b]|  ")

# The same for the library of regular expressions that Arrow has; white space spelled out.
_BLANK = "\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_MERGES_RE2 = f"  |[{_BLANK}] [{_BLANK}]"

# Units made of Latin letters, plain punctuation and at most one line end between words.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SHAPE = re.compile(f"( ?[{_LETTERS}]+)([.,;:!?]+)?(?:(\n)([{_LETTERS}]+)([.,;:!?]+)?)?")
# The same with more punctuation, for Arrow: no apostrophe, which may begin a word with the letters
# after it, and nothing that an added token is likely to begin with.
_MARKS = r"[!-&(-/:;=?@\[-`{}~]"
_SHAPE_RE2 = (
    f"^(?P<a> ?[{_LETTERS}]+)(?P<b>{_MARKS}+)?(?:(?P<c>\n)(?P<d>[{_LETTERS}]+)(?P<e>{_MARKS}+)?)?$"
)
_LATIN_RE2 = f"^ ?[{_LETTERS}]+$"


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, read once by the driver and sent with the job.

    Only byte-level BPE files are taken whose units can be encoded one by one: no normalizer,
    no added prefix space, and added tokens without blanks or stripping.
    """
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    odd = [
        t["content"] for t in spec.get("added_tokens", [])
        if re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
    ]
    plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex")
    if not plain or pre.get("add_prefix_space") or spec.get("normalizer") or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec, ensure_ascii=False)


def byte_alphabet() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(spec_text: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of every token of the vocabulary; added tokens stand for their own text."""
    spec, letters = json.loads(spec_text), byte_alphabet()
    table = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return sorted(table.items())


class Units:
    """The units of a text, and the ids the tokenizers library gives to a unit."""

    def __init__(self, spec_text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec_text)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        longest = sorted(added, key=len, reverse=True)
        self.added = longest
        self._added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        self._letters = byte_alphabet()
        # The same vocabulary and merges for words that are already split and spelled in the
        # letters of the alphabet; only the mark that stands for line ends parts them.
        mark, self._of_words = self._parted(spec_text)
        self._mark = self._of_words.token_to_id(mark)
        self._spelled = np.array([ord(c) for c, _ in sorted(self._letters.items(), key=lambda e: e[1])], "<u4")
        self._spelled[10] = ord(mark)
        self._units, self._words = _Memory(), _Memory()

    def _parted(self, spec_text: str):
        """(mark, tokenizer of words with marks between them).

        A byte that UTF-8 never has, and no merge, keeps a token of its own between any words:
        several are encoded as one then.  Else line ends are isolated by a pattern, at twice the cost.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        letter = {b: c for c, b in self._letters.items()}
        of_words, model = Tokenizer(self.library.model), json.loads(spec_text)["model"]
        merged = {c for pair in model["merges"] for c in "".join(pair)}
        free = [letter[b] for b in _NEVER if letter[b] in model["vocab"] and letter[b] not in merged]
        if free:
            return free[0], of_words
        of_words.pre_tokenizer = pre_tokenizers.Split(letter[10], "isolated")
        return letter[10], of_words

    def split(self, text: str) -> list[str]:
        """Units that join to the text; encoding each alone gives the ids of the text.

        A space starts a word of its own, whatever comes before it, unless white space
        touches it on both sides; such texts are cut by the library's own word splitter.
        """
        if not text:
            return []
        if "\0" not in text and not _MERGES.search(text):
            units = text.replace(" ", "\0 ").split("\0")
            return units if units[0] else units[1:]
        units = []
        for part in self._added.split(text) if self._added else [text]:
            if self._added and self._added.fullmatch(part):
                units.append(part)
            elif part:
                words = self.library.pre_tokenizer.pre_tokenize_str(part)
                units += [bytes(self._letters[c] for c in word).decode("utf-8") for word, _ in words]
        return units

    def words(self, unit: str) -> list[str]:
        """The words of a unit that are encoded independently; a unit of other shape is one.

        Letters, punctuation and a line end before a letter are words of their own in every
        byte-level split.
        """
        shape = _SHAPE.fullmatch(unit)
        return [w for w in shape.groups() if w] if shape else [unit]

    def encode_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``end_id`` after each, and the ids per text.

        Texts are cut before spaces; their units and words are made distinct by Arrow, each
        distinct word is encoded once and its ids are gathered by position.  Units remembered from
        earlier calls are not encoded again.  Nulls are empty texts.
        """
        import pyarrow.compute as pc

        if not len(texts):
            return np.empty(0, "uint32"), np.empty(0, "int64")
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        units, ends = _cut(texts)
        codes, at = self._units.number(units)
        distinct, n = units.take(pa.array(at)), self._units.numbers
        # An added token may stand anywhere, also within what looks like a word.
        merges = pc.match_substring_regex(texts, "|".join([_MERGES_RE2, *map(re.escape, self.added)]))
        slow = np.flatnonzero(merges.to_numpy(zero_copy_only=False))
        if len(slow):
            odd: dict[str, int] = {}
            pieces_of, slow_texts = [], set(slow.tolist())
            begins = np.append(0, ends[:-1])
            for i in range(len(texts)):
                if i in slow_texts:
                    numbers = [odd.setdefault(u, len(odd)) for u in self.split(texts[i].as_py())]
                    pieces_of.append(np.array(numbers, "int64") + n)
                else:
                    pieces_of.append(codes[begins[i] : ends[i]])
            ends = np.cumsum([len(c) for c in pieces_of])
            codes = np.concatenate(pieces_of)
            distinct = pa.concat_arrays([distinct, pa.array(list(odd), pa.large_string())])
        flat, sizes = self._unit_ids(distinct)
        # The end of a text is one more unit.
        known, known_sizes = self._units.ids, self._units.sizes
        new = n - len(known_sizes)
        self._units.remember(flat[: int(sizes[:new].sum())], sizes[:new])
        flat = np.concatenate([known, flat, np.array([end_id], "uint32")])
        sizes = np.concatenate([known_sizes, sizes, [1]])
        codes = np.insert(codes, ends, len(sizes) - 1)
        # The ids of a unit are the bytes of one value, which Arrow puts one behind another.
        bounds = 4 * np.concatenate([[0], np.cumsum(sizes)])
        values = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        out, reached, total = [], np.empty(len(codes), "int64"), 0
        for at in range(0, len(codes), SLICE):
            found = values.take(pa.array(codes[at : at + SLICE]))
            _, upto, ids = found.buffers()
            reached[at : at + SLICE] = total + np.frombuffer(upto, "int64", len(found) + 1)[1:] // 4
            out.append(np.frombuffer(ids, "uint32", int(reached[at + len(found) - 1]) - total))
            total += len(out[-1])
        return np.concatenate(out), np.diff(reached[ends + np.arange(len(ends))], prepend=0)

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after another, and the ids per unit."""
        import pyarrow.compute as pc

        # Most units are one word of letters, which is told at a tenth of the cost of taking a unit apart.
        single = pc.match_substring_regex(units, _LATIN_RE2)
        rest = units.filter(pc.invert(single))
        shape = pc.extract_regex(rest, _SHAPE_RE2)
        plain = shape.is_valid()
        # A unit of another shape is one word; groups that are absent or empty are no words.
        groups = [pc.if_else(plain, shape.field(0), rest), *(shape.field(i) for i in range(1, 5))]
        columns = [pc.if_else(plain, g, "") if i else g for i, g in enumerate(groups)]
        words = pa.chunked_array([units.filter(single), *columns]).combine_chunks().dictionary_encode()
        word_ids, word_begins, word_sizes = self._word_ids(words.dictionary)
        # Words unit by unit, one or five places each; an empty word has no ids.
        one = single.to_numpy(zero_copy_only=False)
        places = np.where(one, 1, 5)
        begins = np.cumsum(places) - places
        found = words.indices.to_numpy()
        codes = np.empty(int(places.sum()), "int64")
        codes[begins[one]] = found[: len(units) - len(rest)]
        codes[begins[~one][:, None] + np.arange(5)] = found[len(units) - len(rest) :].reshape(5, len(rest)).T
        sizes = np.add.reduceat(word_sizes[codes], begins) if len(begins) else np.empty(0, "int64")
        return gather(word_ids, word_begins, word_sizes, codes), sizes

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where those of each word begin and how many they are."""
        codes, at = self._words.number(words)
        flat, begins, sizes = self._new_word_ids(words.take(pa.array(at)))
        flat = gather(flat, begins, sizes, np.arange(len(sizes)))
        known, known_sizes = self._words.ids, self._words.sizes
        self._words.remember(flat, sizes)
        flat, sizes = np.concatenate([known, flat]), np.concatenate([known_sizes, sizes])
        return flat, (np.cumsum(sizes) - sizes)[codes], sizes[codes]

    def _new_word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the library, for words that are not remembered."""
        import pyarrow.compute as pc

        latin = pc.match_substring_regex(words, _LATIN_RE2).to_numpy(zero_copy_only=False)
        lines, others = words.filter(pa.array(latin)), words.filter(pa.array(~latin)).to_pylist()
        ids, sizes = [], np.zeros(len(words), "int64")
        found = []
        for at in range(0, len(lines), LINES):
            few = lines.slice(at, LINES)
            one = pa.ListArray.from_arrays(pa.array([0, len(few)], "int32"), few.cast(pa.string()))
            mine, counts = self._lines(pc.binary_join(one, "\n")[0].as_buffer(), len(few))
            found.append(counts)
            ids.append(mine)
        packed = self.packed(others, "<u4")
        sizes[latin] = np.concatenate([np.empty(0, "int64"), *found])
        sizes[~latin] = [len(p) // 4 for p in packed]
        # The ids of lines come first.
        flat = np.concatenate([np.empty(0, "<u4"), *ids, np.frombuffer(b"".join(packed), "<u4")]).astype("<u4")
        begins = np.empty(len(words), "int64")
        order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat, begins, sizes

    def encode(self, units: Iterable[str]) -> list[list[int]]:
        """Ids of each unit, as the library gives them without special tokens added."""
        return [e.ids for e in self.library.encode_batch_fast(list(units), add_special_tokens=False)]

    def _lines(self, text: bytes, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are the lines of a text in UTF-8, and the ids per word."""
        spelled = self._spelled[np.frombuffer(text, "uint8")]
        marks = np.flatnonzero(spelled == self._spelled[10])[GROUP - 1 :: GROUP] + 1
        letters = spelled.tobytes().decode("utf-32-le")
        groups = [letters[a:b] for a, b in zip([0, *marks.tolist()], [*marks.tolist(), len(letters)])]
        found = self._of_words.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "uint32")
        is_end = ids == self._mark
        ends = np.append(np.flatnonzero(is_end), len(ids))
        if len(ends) != lines:
            raise ValueError("a word of letters has the id of a line end")
        return ids[~is_end], np.diff(ends, prepend=-1) - 1

    def packed(self, units: list[str], width: str) -> list[bytes]:
        """Ids of each unit as bytes of the number type ``width``.

        Plain words are encoded as lines of one text, which spares a call each.  They
        are words already, so the library need not look for words in them.
        """
        found: dict[str, bytes] = {}
        plain = [u for u in units if (u[1:] if u[:1] == " " else u).isalpha()]
        for at in range(0, len(plain), LINES):
            lines = plain[at : at + LINES]
            ids, sizes = self._lines("\n".join(lines).encode("utf-8"), len(lines))
            ids, ends = ids.astype(width), np.cumsum(sizes)
            for word, begin, end in zip(lines, (ends - sizes).tolist(), ends.tolist()):
                found[word] = ids[begin:end].tobytes()
        others = [u for u in units if u not in found]
        for unit, ids in zip(others, self.encode(others)):
            found[unit] = np.array(ids, width).tobytes()
        return [found[u] for u in units]


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before every space: units, and how many there are up to the end of each text."""
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begin = raw == 32
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    bounds = np.append(np.flatnonzero(begin), len(raw))
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
    units = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers)
    return units, np.searchsorted(bounds[:-1], offsets[1:])


def _pairs(strings: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per string: its bytes and size, or its number among those of more than ``longest`` bytes."""
    if not len(strings):
        return np.empty(0, "uint64"), np.empty(0, "uint64")
    padded = np.append(np.frombuffer(strings.buffers()[2] or b"", "uint8"), np.zeros(16, "uint8"))
    bounds = np.frombuffer(strings.buffers()[1], "int64")[strings.offset : strings.offset + len(strings) + 1]
    # Eight bytes from every position on.
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    begins, sizes = bounds[:-1], np.diff(bounds)
    low = eight[begins] & _MASKS[np.minimum(sizes, 8)]
    high = eight[begins + 8] & _MASKS[np.clip(sizes - 8, 0, 7)] | sizes.astype("uint64") << np.uint64(56)
    others = np.flatnonzero(sizes > longest)
    low[others] = strings.take(pa.array(others)).dictionary_encode().indices.to_numpy()
    high[others] = _NAMED
    return low, high


class _Memory:
    """Numbers of strings, and the ids of those that came before."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self._low, self._high = np.empty(0, "uint64"), np.empty(0, "uint64")
        self.ids, self.sizes, self._met = np.empty(0, "uint32"), np.empty(0, "int64"), np.empty(0, "int64")
        self.numbers, self._now = 0, None

    def number(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of every string, remembered ones before new ones, and where each new one stands.

        What is remembered changes with ``remember`` only, so that a call that fails leaves it whole.
        """
        for longest in (PACKED, -1):
            held = len(self.sizes)
            low, high = (np.append(old, new) for old, new in zip((self._low, self._high), _pairs(strings, longest)))
            mixed = low * np.uint64(_MIX[0]) + high * np.uint64(_MIX[1])
            found = pa.array(mixed.view("int64")).dictionary_encode()
            codes = found.indices.to_numpy()
            at = np.empty(len(found.dictionary), "int64")
            at[codes] = np.arange(len(codes))
            lows, highs = low[at], high[at]
            if (lows[codes] == low).all() and (highs[codes] == high).all():
                break
            # Without memory, and all strings numbered as such, no two share a mixed number.
            self._clear()
        codes = codes[held:].astype("int64")
        met = np.bincount(codes, minlength=len(at))
        met[:held] += self._met
        self.numbers, self._now = len(at), (lows, highs, met)
        return codes, at[held:] - held

    def remember(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take the ids of the new strings; beyond the limit, those that came most are kept."""
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        low, high, met = self._now
        packed, least = high < np.uint64(_NAMED), 0
        keep = packed
        while keep.sum() > MEMORY:
            least = max(2 * least, 1)
            keep = packed & (met > least)
        self._low, self._high, self._now = low[keep], high[keep], None
        self.ids, self.sizes = ids[np.repeat(keep, sizes)], sizes[keep]
        # Counts go down, so that strings which no longer come are left out in time.
        self._met = met[keep] // (2 if least else 1)


@lru_cache(maxsize=1)
def lasting_units(spec_text: str) -> Units:
    """The Units of a tokenizer, one for all tasks of a worker process: built once, with one memory."""
    return Units(spec_text)


def one_thread() -> None:
    """Keep the library to the one core that a task has."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers in 7-bit groups, low group first."""
    values = values.astype("uint64")
    sizes = np.ones(len(values), "int64")
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, "uint8")
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        at = ends[has] - sizes[has] + k
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at] = low.astype("uint8") | ((sizes[has] > k + 1).astype("uint8") << 7)
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, "uint8")
    if not len(raw):
        return np.empty(0, "int64")
    last = raw < 128
    begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    sizes = np.diff(np.append(begins, len(raw)))
    shift = 7 * (np.arange(len(raw)) - np.repeat(begins, sizes))
    return np.add.reduceat((raw & 127).astype("int64") << shift, begins)


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The entries ``flat[begins[c] : begins[c] + sizes[c]]`` for every code, one after another."""
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins[codes] - ends + n, n) + np.arange(total)]


