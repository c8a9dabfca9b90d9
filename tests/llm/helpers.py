"""Small corpora with the awkward rows every operator must take."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, size long, copies long, chunk long, no int, score double, component_id long, ids string"
)
EXTRA = ("k", 7, 9, 1, 2, 0.5, 3, "x")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, *EXTRA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(seed=0):
    """Nulls in every column, empty and long texts, copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    long = words(rng, 20_000)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = [row(i, t, source="abc"[i % 3]) for i, t in enumerate(base)]
    rows += [
        row(100, None), row(101, ""), row(102, " \t\n "), row(103, long), row(104, long + " tail"), row(105, base[0]),
        row(106, base[0], source=None), row(107, "ça va bien \U0001f600 <|endoftext|> x\0y  z", lang=None), row(108, "123 456"),
        row(None, "no id here at all"), row(109, base[1]), row(109, base[1]), tuple([None] * 13),
    ]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
