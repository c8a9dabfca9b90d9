"""Fill-in-the-middle (operator 12): one counted-quantifier match cuts a text into three.

A text is a run of units (code points unless told otherwise).  ``regexp_count`` gives their
number n, a hash of the id two cut places a <= b, and one match of a pattern made for the row,
``\\A(unit{a}+)(unit{b-a}+)(rest)\\z`` with possessive counts, captures prefix, middle and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
# Units are counted in runs of this many, so that counting holds no object per unit.
RUN = 1000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_BELOW = 20


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units follow each other from the start of the text (a long)."""
    runs = F.regexp_count(text, F.lit(rf"\G(?:{unit}){{{RUN}}}+"))
    tail = F.regexp_replace(text, rf"\A(?:(?:{unit}){{{RUN}}}+)*+", "")
    return (runs.cast("long") * RUN + F.regexp_count(tail, F.lit(rf"\G(?:{unit})"))).cast("long")


def hash_words(doc_id: Column) -> list[Column]:
    """The first four 32-bit groups of the sha256 of ``1:`` and the decimal id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_pattern(a: Column, b: Column, unit: str = CODE_POINT) -> Column:
    """The row's pattern: ``a`` units, ``b - a`` units, the rest."""
    return F.concat(
        F.lit(rf"\A((?:{unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), (b - a).cast("string"),
        F.lit(r"}+)((?s:.*+))\z"),
    )


def transform(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``unit`` is a regular expression that matches one unit and never the empty text; what
    follows the last unit belongs to the suffix.  ``form`` is plain, psm or spm: plain if the
    text is empty, holds a sentinel, or one in ten by the hash; of the rest one in five is spm.
    ``prefix_chars`` and ``middle_chars`` count units (null: plain).  Only doc_id and text are
    read, every row stands alone.  Null texts are empty texts, null ids hash the text ``1:``,
    repeated rows give equal rows, an empty table gives an empty one.
    """
    h1, h2, h3, h4 = (F.col(f"__h{i}") for i in range(1, 5))
    n, a, b = F.col("n"), F.col("__a"), F.col("__b")
    text = F.col("__text")
    sentinel = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        sentinel = sentinel | F.contains(text, F.lit(mark))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumns({f"__h{i + 1}": h for i, h in enumerate(hash_words(F.col("doc_id")))})
    rows = rows.withColumn("n", count_units(text, unit))
    rows = rows.withColumns({
        "__a": F.least(h1 % (n + 1), h2 % (n + 1)),
        "__b": F.greatest(h1 % (n + 1), h2 % (n + 1)),
        "form": F.when((text == "") | sentinel | (h3 % 100 >= PLAIN_FROM), "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm"),
    })
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    cut = F.regexp_replace(text, cut_pattern(a, b, unit), order)
    split = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form",
        F.when(split, a).alias("prefix_chars"), F.when(split, b - a).alias("middle_chars"),
        F.when(split, cut).otherwise(text).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone.

    Texts with a sentinel are never cut, and no sentinel can begin inside another, so the first
    occurrences are the marks.
    """
    part = r"((?s:.*?))"
    psm = F.regexp_replace(output, rf"\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}((?s:.*+))\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}((?s:.*+))\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(found: DataFrame) -> DataFrame:
    """The cut with digests in place of texts."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
  ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
