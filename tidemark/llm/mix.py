"""Mixing sources to target weights (operator 1).

Documents get hash-random keys.  Per source, word counts are summed by key ranges, the
sums are chained to distributed prefix sums, and the key at which the source's budget ends is
found by looking into one key range only.  Every document then decides alone: it is taken once
per whole epoch and once more if its key lies before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .prefix import before, numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
# Documents in one key range: the unit of the row-level prefix sum.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Hash-random hex key of a row; equal only for rows equal in id and text."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(seed), name, F.md5(F.coalesce(text, F.lit("")))))


def _range_no(rows: Column) -> Column:
    """Number of the key range, of as many as the source needs."""
    ranges = F.ceil(rows / F.lit(RANGE_ROWS))
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source, from (source, source_size).

    Sources in code point order, null last, get the weights in turn.  All words are shared by
    weight; a source never gets more than ``cap`` times its own words, and what it leaves is
    shared again by weight among the others until none is above.  Each round sums over the
    source table; the driver holds four numbers.
    """
    order = [F.col("source").isNull(), F.col("source")]
    turn = numbered(sources, order, "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = cut(
        turn.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap),
        "mix-sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum(F.when(full, 1).otherwise(0)),
            F.sum(F.when(full, F.col("most")).otherwise(0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if row[0] == capped:
            break
        capped = row[0]
        level = float(total - row[1]) / row[2]
    return table.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): what each source gives to the mix, and where it is cut.

    ``documents`` has doc_id, source, key, size; ``sources`` has per source the words, the
    target, the whole ``epochs``, the ``cut_key`` and the words each document at exactly that
    key gives (``cut_words``; rows equal in id and text share the rest of the budget evenly).
    """
    narrow = docs.select(
        "doc_id", "source", random_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
        word_count(F.col("text")).alias("size"),
    )
    rows = cut(narrow, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = cut(
        targets(sums, weights, cap)
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")),
        "mix-targets",
    )
    same = rows["source"].eqNullSafe(sources["source"])
    keyed = (
        rows.join(sources.where("rest > 0"), same)
        .select("source_no", "key", "size", "rest", _range_no(F.col("rows")).alias("range_no"))
    )
    # Sums by key range, chained within the source; the cut lies in the last range that
    # begins before the rest of the budget is used up.
    by_range = keyed.groupBy("source_no", "rest", "range_no").agg(F.sum("size").alias("words"))
    chained = before(by_range, "words", ["range_no"], "earlier", ["source_no"])
    hit = chained.where((F.col("earlier") < F.col("rest")) & (F.col("earlier") + F.col("words") >= F.col("rest")))
    inside = keyed.join(hit.select("source_no", "range_no", "earlier"), ["source_no", "range_no"])
    by_key = inside.groupBy("source_no", "rest", "earlier", "key").agg(
        F.sum("size").alias("words"), F.count("*").alias("same")
    )
    run = before(by_key, "words", ["key"], "within", ["source_no"])
    begin = F.col("earlier") + F.col("within")
    at = run.where((begin < F.col("rest")) & (begin + F.col("words") >= F.col("rest"))).select(
        "source_no", F.col("key").alias("cut_key"),
        F.floor((F.col("rest") - begin) / F.col("same")).cast("long").alias("cut_words"),
    )
    # Written once: its size is known, so documents meet it without moving where it is small.
    return rows, cut(sources.join(at, "source_no", "left"), "mix-cuts")


def _decided(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source gives: whole copies, and words of the last, cut copy."""
    table = sources.withColumnRenamed("source", "__source")
    joined = rows.join(table, rows["source"].eqNullSafe(table["__source"]), "left")
    early = F.coalesce((F.col("key") < F.col("cut_key")).cast("long"), F.lit(0))
    part = F.when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)
    return joined.withColumn("copies", F.col("epochs") + early).withColumn("part", part)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    Needs doc_id, text and source; other columns are ignored.  A null text has 0 words, null
    sources form one source, repeated rows count as rows, an empty table gives an empty one.
    The taken words of a source sum to its rounded target (less than one word per row that
    repeats the document at the cut is lost), and none is taken more than ``cap`` times.
    """
    rows, sources = plan(docs, weights, cap, seed)
    taken = F.col("copies") * F.col("size") + F.col("part")
    return _decided(rows, sources).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: documents repeated by epochs, the one at the cut ending at the budget.

    Columns of ``docs`` (``n_chars``, if there, follows the cut).  Texts do not move: each row
    finds its source's cut and decides alone.  Documents without words are left out where their
    source is not repeated past them.
    """
    columns = docs.columns
    inner = {c: f"__in_{i}" for i, c in enumerate(columns) if c not in ("doc_id", "source", "text")}
    named = docs.select(*[F.col(c).alias(inner.get(c, c)) for c in columns])
    _, sources = plan(named, weights, cap, seed)
    keyed = named.withColumn("key", random_key(F.col("doc_id"), F.col("text"), seed))
    rows = _decided(keyed, sources)
    # One entry per copy: null for a whole one, the words kept for the cut one.
    whole = F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int"))
    copies = F.when(F.col("part") > 0, F.array_append(whole, F.col("part"))).otherwise(whole)
    rows = rows.withColumn("__kept", F.explode(copies))
    lead = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(lead, F.lit(1), F.col("__kept").cast("int")), "")
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(head)
    out = rows.withColumn("text", text)
    cols = []
    for c in columns:
        col = F.col(inner.get(c, c))
        if c == "n_chars":
            col = F.when(F.col("__kept").isNull(), col).otherwise(F.char_length("text"))
        cols.append(col.alias(c))
    return out.select(*cols)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
    sum(source_size) OVER () AS total FROM sums),
chain AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT coalesce(sum(CASE WHEN most * open <= weight * (total - filled) THEN most ELSE 0 END), 0) AS used,
    sum(CASE WHEN most * open <= weight * (total - filled) THEN 0 ELSE weight END) AS open_weight, max(total) AS total
  FROM chain),
goal AS (
  SELECT source, source_size, least(most::DOUBLE, weight::DOUBLE * CASE WHEN open_weight > 0 THEN (t - used)::DOUBLE / open_weight::DOUBLE ELSE 0 END) AS target
  FROM weighed, (SELECT used, open_weight, total AS t FROM level)),
budget AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size::BIGINT ELSE 0 END AS epochs FROM goal),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.words - b.epochs * b.source_size::BIGINT AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (epochs * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken
FROM run
"""
