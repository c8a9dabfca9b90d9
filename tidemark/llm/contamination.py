"""Benchmark decontamination (operator 13): winnowed k-grams, joined and extended to windows.

Only DataFrame functions.  A window is ``WINDOW`` consecutive words of an item, or the whole
item if it is shorter.  Of the k-grams inside a window the one with the least hash is its
fingerprint, so two texts that share a window share its fingerprint, at the same place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

WINDOW = 10
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands between words of a lower-cased text, and of any text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; a null text has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    # Cutting a text at what is between words costs far less than matching every word.
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def count_words(text: Column) -> Column:
    """How many words a text has; lower case does not matter to that."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN_ANY)
    return F.size(F.array_remove(parts, "")).cast("long")


def gram_size(length: int) -> int:
    """k for windows of ``length`` words; ``length - k + 1`` k-grams lie in each."""
    return (length + 1) // 2


def _at_starts(count: str, each: str) -> str:
    """SQL: ``each`` (of the start ``i``) for ``count`` starts from 0, none below 1."""
    return f"IF({count} > 0, transform(sequence(0, greatest({count} - 1, 0)), i -> {each}), CAST(array() AS ARRAY<BIGINT>))"


def marks(hashed: str, length: int) -> str:
    """SQL: the fingerprint of the window at every start of an array of word hashes."""
    k = gram_size(length)
    per_window = length - k + 1
    gram = ", ".join(f"get({hashed}, i + {j})" for j in range(k))
    inside = ", ".join(f"get(g, i + {j})" for j in range(per_window))
    least = f"least({inside})" if per_window > 1 else inside
    grams = _at_starts(f"size({hashed}) - {k - 1}", f"xxhash64({gram})")
    # A lambda variable holds the k-grams, so that they are computed once.
    return f"get(transform(array({grams}), g -> {_at_starts(f'size({hashed}) - {length - 1}', least)}), 0)"


def word_hashes(of: Column) -> Column:
    return F.transform(of, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame) -> DataFrame:
    """(length, mark, code, window, item_id): distinct windows of every item.

    ``window`` is the words joined by a space, ``code`` a hash of their hashes.
    """
    split = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    each = split.withColumn("length", F.least(F.size("w"), F.lit(WINDOW))).withColumn("h", word_hashes(F.col("w")))
    by_length = " ".join(f"WHEN {n} THEN {marks('h', n)}" for n in range(1, WINDOW + 1))
    placed = each.select("item_id", "w", "h", "length", F.posexplode(F.expr(f"CASE length {by_length} END")).alias("at", "mark"))
    return placed.selectExpr(
        "length", "mark", "xxhash64(slice(h, at + 1, length)) AS code",
        "array_join(slice(w, at + 1, length), ' ') AS window", "item_id",
    ).distinct()


# SQL: words inside the union of the sorted (begin, end) spans.
_COVERED = """aggregate(spans, named_struct('reach', 0, 'n', 0L), (done, x) -> named_struct(
  'reach', greatest(done.reach, x.end), 'n', done.n + greatest(x.end - greatest(done.reach, x.begin), 0)), done -> done.n)"""


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(text_key, begin, window_key): where item windows occur in the distinct texts of ``docs``.

    First only distinct fingerprints of each text meet those of the items; then texts with a
    common fingerprint are split again, every window around a common fingerprint is looked up
    by its hashes, and its words are compared.  ``text_key`` is the sha256 of the text.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW at most
    text = F.col("text").cast("string")
    keyed = docs.where(text.isNotNull()).select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), text.alias("text"))
    if not lengths:
        lengths = [WINDOW]

    def exploded(each: str) -> Column:
        """Rows of ``each`` (SQL of the word hashes h, n for the length) over all lengths."""
        every = ", ".join(each.format(n=n, marks=marks("h", n)) for n in lengths)
        return F.explode(F.expr(f"get(transform(array(h), h -> concat({every})), 0)"))

    marked = "transform(array_distinct({marks}), m -> named_struct('length', {n}, 'mark', m))"
    placed = "transform({marks}, (m, i) -> named_struct('length', {n}, 'mark', m, 'begin', i, 'code', xxhash64(slice(h, i + 1, {n}))))"
    fingerprints = windows.select("length", "mark").distinct()
    hashed = keyed.select("text_key", word_hashes(words(F.col("text"))).alias("h"))
    seen = hashed.select("text_key", exploded(marked).alias("x"))
    met = seen.select("text_key", "x.*").join(fingerprints, ["length", "mark"], "left_semi").select("text_key").distinct()
    met = cut(met, "met-texts")
    # Equal texts are one from here on; they are merged before they are shuffled.
    texts = keyed.join(met, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    texts = cut(texts.select("text_key", words(F.col("text")).alias("w")), "met-words")
    around = texts.select("text_key", word_hashes(F.col("w")).alias("h")).select("text_key", exploded(placed).alias("x"))
    distinct = windows.select("length", "mark", "code", "window", "window_key").distinct()
    found = around.select("text_key", "x.*").join(distinct, ["length", "mark", "code"])
    hits = found.groupBy("text_key").agg(F.collect_list(F.struct("begin", "length", "window", "window_key")).alias("hits"))
    # The words themselves decide; hashes only brought them together.
    same = "filter(hits, x -> array_join(slice(w, x.begin + 1, x.length), ' ') = x.window)"
    checked = hits.join(texts, "text_key").select("text_key", F.explode(F.expr(same)).alias("x"))
    return checked.selectExpr("text_key", "x.begin", "x.begin + x.length AS end", "x.window_key")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) of every document.

    ``spans`` are the sorted (begin, end) word places of item windows in the document, ``items``
    the sorted ids, as strings, of the items with such a window.  Only doc_id and text, item_id
    and text are read.  Null texts and texts without words have zeros and empty lists; repeated
    rows each get their row; rows that share an item_id are one item with the windows of all;
    a null item_id hits words but is in no list; empty tables give empty results or no hits.
    """
    windows = item_windows(items).withColumn("window_key", F.sha2(F.concat_ws(" ", "length", "window").cast("binary"), 256))
    windows = cut(windows, "item-windows")
    found = cut(occurrences(docs, windows), "occurrences")
    per_text = found.groupBy("text_key").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"),
        F.sha2(F.array_join(F.array_sort(F.collect_set("window_key")), "").cast("binary"), 256).alias("set_key"),
    )
    per_text = cut(per_text, "hit-texts")
    # Texts that hold the same windows share one list of items.
    one = per_text.groupBy("set_key").agg(F.min("text_key").alias("text_key"))
    members = found.join(one, "text_key").select("set_key", "window_key").distinct()
    owners = windows.select("window_key", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = members.join(owners, "window_key").groupBy("set_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    result = per_text.join(listed, "set_key", "left").select("text_key", "spans", "items")
    text = F.col("text").cast("string")
    every = docs.select(
        "doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), count_words(text).alias("n_words")
    )
    joined = every.join(result, "text_key", "left")
    none = "CAST(array() AS ARRAY<{}>)"
    return joined.selectExpr(
        "doc_id", "n_words", f"coalesce({_COVERED}, 0L) AS n_hit", f"coalesce(spans, {none.format('STRUCT<begin: INT, end: INT>')}) AS spans",
        f"coalesce(items, {none.format('STRING')}) AS items", "spans IS NOT NULL AS contaminated",
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item list in place of lists."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def check_sql() -> str:
    """The same by looking up every window of every document, for an SQL engine."""
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    return f"""
WITH iw AS (SELECT item_id, {split} AS w FROM benchmark),
il AS (SELECT *, least(len(w), {WINDOW}) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
dw AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
dl AS (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM dw),
dp AS (SELECT r, n, i, string_agg(v, ' ') OVER (PARTITION BY r, n ORDER BY i ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS s
  FROM dl, (SELECT DISTINCT n FROM win)),
hit AS (SELECT r, n, i, item_id FROM dp JOIN win USING (n, s)),
cov AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
