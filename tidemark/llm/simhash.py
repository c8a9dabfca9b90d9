"""SimHash near-duplicates (operator 2): fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .batches import returning, small_batches
from .components import components, forest

BITS = 64
# Runs of equal block keys up to this length are compared pair by pair, longer ones by
# looking up all fingerprints within the distance.
SHORT_RUN = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[i:j], seed) for i, j in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        dtype="<u8",
    )
    ones = np.zeros(BITS, "int64")
    for part in range(0, len(hashes), 1 << 16):
        rows = hashes[part : part + (1 << 16)].view("uint8").reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype="int64")
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fingerprint): words are runs without ASCII white space, A-Z lower-cased.

    Fewer words than a shingle are one shingle; no word, or a null text, gives 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = np.array([fingerprint(t, shingle) for t in pdf["text"]], "uint64").view("int64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "fingerprint": marks})

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return texts.mapInPandas(returning(run), "doc_id long, text_hash long, fingerprint long")


def block_masks(max_bits: int) -> list[int]:
    """Masks of which one at least covers equal bits of any two fingerprints in reach.

    The bits are cut into ``max_bits + 3`` blocks; differing bits touch ``max_bits`` of them at
    most, so three whole blocks agree.
    """
    blocks = max_bits + 3
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(single, 3)]


def _flips(free: int, max_bits: int) -> list[int]:
    """All non-zero changes of up to ``max_bits`` of the free bits."""
    ones = [1 << i for i in range(BITS) if free >> i & 1]
    return [sum(c) for n in range(1, max_bits + 1) for c in combinations(ones, n)]


def _run_links(marks: np.ndarray, mask: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one long run (sorted, distinct fingerprints)."""
    label = np.arange(len(marks))
    for flip in _flips(~mask & (2**BITS - 1), max_bits):
        wanted = marks ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(marks, wanted), len(marks) - 1)
        i = np.flatnonzero(marks[at] == wanted)
        i = i[label[i] != label[at[i]]]
        if len(i):
            node, low = forest(label[i], label[at[i]])
            renamed = np.arange(len(marks))
            renamed[node] = low
            label = renamed[label]
    moved = np.flatnonzero(label != np.arange(len(marks)))
    return marks[moved], marks[label[moved]]


def _links(masks: list[int], max_bits: int):
    """Task function: links among rows sorted by (block_no, block, fingerprint)."""

    def compare(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        no, block = pdf["block_no"].to_numpy(), pdf["block"].to_numpy()
        marks = pdf["fingerprint"].to_numpy("int64").view("uint64")
        new = np.ones(len(pdf), bool)
        new[1:] = (no[1:] != no[:-1]) | (block[1:] != block[:-1])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(pdf)))
        found = []
        for begin, size in zip(begins[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
            run = np.unique(marks[begin : begin + size])
            found.append(_run_links(run, masks[no[begin]], max_bits))
        left = np.repeat(np.where(sizes > SHORT_RUN, 0, sizes), sizes) - (np.arange(len(pdf)) - np.repeat(begins, sizes)) - 1
        i, step = np.flatnonzero(left > 0), 1
        while len(i):
            near = np.bitwise_count(marks[i] ^ marks[i + step]) <= max_bits
            if near.any():
                found.append((marks[i[near]], marks[i[near] + step]))
            step += 1
            i = i[left[i] >= step]
        if not found:
            return np.empty(0, "uint64"), np.empty(0, "uint64")
        return forest(*(np.concatenate(side) for side in zip(*found)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = compare(pdf)
            return pd.DataFrame({"a": a.view("int64"), "b": b.view("int64")})

        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf["block_no"] == pdf["block_no"].iloc[-1]) & (pdf["block"] == pdf["block"].iloc[-1])
            open_from = len(pdf) - int(np.argmin(last.to_numpy()[::-1])) if not last.all() else 0
            if open_from or (held and not _same(held[-1], pdf)):
                whole = pd.concat([*held, pdf.iloc[:open_from]], ignore_index=True)
                if len(whole):
                    yield out(whole)
                held = []
            held.append(pdf.iloc[open_from:])
        if held:
            yield out(pd.concat(held, ignore_index=True))

    return run


def _same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return (a["block_no"].iloc[-1], a["block"].iloc[-1]) == (b["block_no"].iloc[0], b["block"].iloc[0])


def links(marks: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that connect all distinct ``fingerprint`` values within ``max_bits``.

    Each fingerprint appears once per block mask; rows of equal blocks are sorted together and
    verified by Hamming distance.  Of the links of a run only a spanning forest is returned:
    never all pairs of a group.  Copies were merged before, so a run holds distinct
    fingerprints that agree in three of five blocks.
    """
    masks = block_masks(max_bits)
    signed = [m - 2**BITS if m >> (BITS - 1) else m for m in masks]
    blocks = F.array(*[
        F.struct(F.lit(i).alias("block_no"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("block"))
        for i, m in enumerate(signed)
    ])
    rows = marks.select("fingerprint", F.explode(blocks).alias("x")).select("x.block_no", "x.block", "fingerprint")
    dealt = rows.repartition("block_no", "block").sortWithinPartitions("block_no", "block", "fingerprint")
    return dealt.mapInPandas(returning(_links(masks, max_bits)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, stands) of every document.

    Documents link if their fingerprints differ in ``max_bits`` bits at most; component_id is
    the smallest doc_id that links reach.  Only doc_id and text are read.  Equal fingerprints
    are merged before anything is compared, so copies cost nothing.  ``text_hash`` (xxhash64)
    tells apart rows that repeat an id; ``stands`` marks the rows of the smallest (doc_id,
    text_hash) of their component, which are one text, repeated if the table repeats the row.  Null and empty texts have
    fingerprint 0 and link like any other; null ids never become a component id (a component
    of null ids only has a null one); repeated rows are kept; empty tables give empty ones.
    """
    marked = cut(fingerprints(docs, shingle), "simhash")
    # Nulls last: a null id stands for its component only if there is no other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = cut(marked.groupBy("fingerprint").agg(first.alias("first")), "simhash-marks")
    joined = components(links(distinct.select("fingerprint"), max_bits))
    grouped = distinct.join(joined, distinct["fingerprint"] == joined["node"]).select("fingerprint", "component", "first")
    least = grouped.groupBy("component").agg(F.min("first").alias("of_all"))
    moved = grouped.select("fingerprint", "component").join(least, "component").select("fingerprint", "of_all")
    final = distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("of_all", "first").alias("first"))
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return marked.join(final, "fingerprint", "left").select(
        "doc_id", "text_hash", "fingerprint", F.col("first.doc_id").alias("component_id"), stands.alias("stands")
    )
