"""Documents before indexing: page text, chunks, new-only selection, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError

# Markup and personal-data patterns (Java and RE2 syntax alike).
BLOCKS = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>"
COMMENTS = r"(?s)<!--.*?-->"
TAGS = r"(?s)<[^>]*>"
BLANKS = r"\s+"
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&amp;": "&",
}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_DIGITS = r"[0-9][ .)-]+[0-9]{3,4}[ .-][0-9]{3,4}"
PHONE = r"(\+[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}"


def html_text(html: Column) -> Column:
    """Visible text of a page: markup removed, common entities decoded, blanks joined."""
    text = html
    for pattern in (COMMENTS, BLOCKS, TAGS):
        text = F.regexp_replace(text, pattern, " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def chunk(df: DataFrame, text: str, size: int, overlap: int = 0, out: str = "chunk") -> DataFrame:
    """Pieces of ``size`` characters, each repeating ``overlap`` of the one before.

    The whole text is covered; the last piece may be shorter.
    """
    if size < 1 or not 0 <= overlap < size:
        raise SpecError("chunks need size >= 1 and 0 <= overlap < size")
    step, length = size - overlap, F.char_length(text)
    last = F.greatest(F.ceil((length - overlap) / step) - 1, F.lit(0)).cast("int")
    # The text is cut once into steps; a chunk joins the steps it covers, whose last one it may cut.
    steps = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
    covered = -(-size // step)

    def pieces(cut: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(F.array_join(F.slice(cut, i + 1, F.lit(covered)), ""), 1, size),
        )

    # The outer array of one element keeps the steps from being cut again for every chunk.
    chunks = F.get(F.transform(F.array(steps), pieces), F.lit(0))
    columns = [c for c in df.columns if c not in ("chunk_no", out)]
    found = df.where(length > 0).select("*", F.posexplode(chunks).alias("__no", "__chunk"))
    return found.select(*columns, F.col("__no").cast("long").alias("chunk_no"), F.col("__chunk").alias(out))


def new_only(documents: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Documents whose key is not indexed yet."""
    return documents.join(indexed.select(key).distinct(), key, "left_anti")


def mask_pii(
    df: DataFrame, text: str, email: str = "john_doe@email.com", phone: str = "123456789",
    out: str | None = None,
) -> DataFrame:
    """Replace e-mail addresses and phone numbers by constants, with the counts found.

    The text is cut once into found items and what lies between them; an item is an address if
    it holds ``@``.  A null text stays null with null counts.
    """
    either = f"{EMAIL}|{PHONE}"
    # Most texts hold neither; a plain search decides before the pattern runs.
    may = F.contains(F.col(text), F.lit("@")) | F.col(text).rlike(_DIGITS)
    empty = F.slice(F.array(F.lit("")), 1, 0)
    staged = df.withColumn("__items", F.when(may, F.regexp_extract_all(F.col(text), F.lit(either), F.lit(0))).otherwise(empty))
    staged = staged.withColumn("__between", F.when(F.size("__items") > 0, F.split(F.col(text), either, -1)))
    address = F.filter("__items", lambda x: F.contains(x, F.lit("@")))
    constants = F.transform("__items", lambda x: F.when(F.contains(x, F.lit("@")), F.lit(email)).otherwise(F.lit(phone)))
    joined = F.concat(
        F.get("__between", F.lit(0)),
        F.array_join(F.zip_with(constants, F.slice("__between", F.lit(2), F.size("__items")), lambda c, b: F.concat(c, b)), ""),
    )
    known = F.col(text).isNotNull()
    return staged.withColumns(
        {
            "n_emails": F.when(known, F.size(address)),
            "n_phones": F.when(known, F.size("__items") - F.size(address)),
            out or text: F.when(F.size("__items") > 0, joined).otherwise(F.col(text)),
        }
    ).drop("__items", "__between")
