"""Conversation repair (operator 11): generalised LR with a graph-structured stack.

The role grammar is ``C -> empty | s? P, P -> P u a | u a``.  A stack top is all a parse needs to
go on, so stacks with equal tops are merged and the one of least (cost, audit) stays.  A row is
shifted as it is (Keep), under another role (Rerole) or not at all (Delete); turns that are
missing are shifted without a row (Insert).

Two edit sequences over the same rows with equal cost are never prefixes of each other, so the
least of two stays the least whatever follows: merging loses no best repair, and parts of a
conversation can be parsed apart, from every top to every top, and joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .batches import returning

# Rows of a conversation that one group holds; longer ones are parsed in parts of this size.
PART_ROWS = 4096

START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRS}, PAIRS: {"u": USER}}
ACCEPT = (START, PAIRS)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
MADE = "ua"
_SPACE = " \t\n\x0b\x0c\r"

# A stack top's best parse: (cost, audit, turns); turns is a chain (before, row or -1, new role).
Tops = dict[int, tuple]


def _offer(tops: Tops, top: int, cost: int, audit: str, turns) -> bool:
    best = tops.get(top)
    if best is None or (cost, audit) < best[:2]:
        tops[top] = (cost, audit, turns)
        return True
    return False


def _with_inserts(tops: Tops) -> Tops:
    """Tops that any number of inserted turns reach."""
    reached, fresh = dict(tops), list(tops)
    while fresh:
        changed = []
        for top in fresh:
            cost, audit, turns = reached[top]
            for role in MADE:
                to = SHIFT[top].get(role)
                if to is not None and _offer(reached, to, cost + INSERT, audit + "I", (turns, -1, role)):
                    changed.append(to)
        fresh = changed
    return reached


def _feed(tops: Tops, row: int, initial: str, fault: str, copies: int) -> Tops:
    """Tops after one distinct row and its adjacent copies, which can only be deleted."""
    after: Tops = {}
    if fault != "d":
        extra = CUT_SHORT if fault == "t" else 0
        for top, (cost, audit, turns) in _with_inserts(tops).items():
            for role, to in SHIFT[top].items():
                if role == initial:
                    _offer(after, to, cost + extra, audit + "K", (turns, row, None))
                if role in MADE:
                    _offer(after, to, cost + REROLE + extra, audit + "R", (turns, row, role))
    # An insert before a delete is never better than the same insert after it.
    for top, (cost, audit, turns) in tops.items():
        _offer(after, top, cost + DELETE, audit + "D", turns)
    if copies > 1:
        more = "D" * (copies - 1)
        after = {top: (c + DELETE * (copies - 1), a + more, t) for top, (c, a, t) in after.items()}
    return after


def parse(symbols: str, copies: list[int], entry: int = START) -> Tops:
    """Best parse to every top.  ``symbols`` has two letters a row: role initial and fault.

    Faults: d must be deleted, t is cut short, k is sound.
    """
    tops: Tops = {entry: (0, "", None)}
    for row in range(len(symbols) // 2):
        tops = _feed(tops, row, symbols[2 * row], symbols[2 * row + 1], int(copies[row]))
    return tops


def accepted(tops: Tops) -> tuple:
    """(cost, audit, turns, top) of the cheapest complete parse; Delete everything is always one."""
    ends = _with_inserts(tops)
    return min(((*ends[t], t) for t in ACCEPT if t in ends), key=lambda x: x[:2])


def _listed(turns) -> tuple[list[int], list[str | None]]:
    rows, roles = [], []
    while turns is not None:
        turns, row, role = turns
        rows.append(row)
        roles.append({"u": "user", "a": "assistant"}.get(role))
    return rows[::-1], roles[::-1]


_REPAIR = "cost long, audit string, rows array<int>, roles array<string>"
_TABLE = "array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _repair_whole(symbols: pd.Series, copies: pd.Series) -> pd.DataFrame:
    found = []
    for text, n in zip(symbols, copies):
        cost, audit, turns, _ = accepted(parse(text, n))
        found.append((cost, audit, *_listed(turns)))
    return pd.DataFrame(found, columns=["cost", "audit", "rows", "roles"])


def _part_table(symbols: pd.Series, copies: pd.Series) -> pd.Series:
    def table(text: str, n) -> list[dict]:
        return [
            {"entry": entry, "exit": top, "cost": cost, "audit": audit}
            for entry in SHIFT
            for top, (cost, audit, _) in parse(text, n, entry).items()
        ]

    return pd.Series([table(*x) for x in zip(symbols, copies)])


def _repair_part(symbols: pd.Series, copies: pd.Series, entry: pd.Series, leave: pd.Series, end: pd.Series) -> pd.DataFrame:
    """A part's own share of the repair: from its entry top to its exit top, ``end`` >= 0 if inserts to that top end it."""
    found = []
    for text, n, start, stop, last in zip(symbols, copies, entry, leave, end):
        best = parse(text, n, int(start))[int(stop)]
        if last >= 0:
            best = _with_inserts({int(stop): best})[int(last)]
        cost, audit, turns = best
        found.append((cost, audit, *_listed(turns)))
    return pd.DataFrame(found, columns=["cost", "audit", "rows", "roles"])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): conversations damaged by a hash of id and turn.

    ``n`` is how often a row stands there: 0 for a dropped row, which only names its
    conversation, 2 for a repeated one.  Null roles, texts, and ids or turns in the hash are one
    space.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _judged(rows: DataFrame, again: Column) -> DataFrame:
    """Adds initial and fault to distinct rows; ``again``: role and text were seen earlier."""
    body = F.rtrim("text", F.lit(_SPACE))
    ends = F.endswith(body, F.lit(".")) | F.endswith(body, F.lit("!")) | F.endswith(body, F.lit("?"))
    fault = F.when(body == "", "b").when(again, "r").when(~ends, "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    return rows.withColumns({"initial": initial, "fault": fault})


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its rows in order as an array, and what is counted of them."""
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "n", "initial", "fault")
    count = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0)).cast("long")
    turn = F.when(F.col("n") > 0, F.col("turn"))
    grouped = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, row))).alias("found"),
        count("b", F.col("n")).alias("blank"),
        F.sum(F.when(F.col("fault") == "r", F.col("n")).when(F.col("fault") == "b", 0).otherwise(F.greatest(F.col("n") - 1, F.lit(0)))).cast("long").alias("duplicate"),
        count("t", F.lit(1)).alias("truncated"),
        F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count_distinct(turn).alias("turns"),
    )
    pairs = """cast(aggregate(found, 0L, (s, x) -> s + x.n - 1) + size(filter(transform(sequence(0, greatest(size(found) - 2, 0)),
      i -> concat(coalesce(get(found, i).initial, ''), '|', coalesce(get(found, i + 1).initial, ''))),
      p -> size(found) > 1 AND p NOT IN ('s|u', 'u|a', 'a|u'))) AS LONG)"""
    letters = """array_join(transform(found, x -> concat(if(x.initial IN ('s', 'u', 'a'), x.initial, 'x'),
      CASE x.fault WHEN 'b' THEN 'd' WHEN 'r' THEN 'd' ELSE x.fault END)), '')"""
    return grouped.withColumns({"illegal": F.expr(pairs), "symbols": F.expr(letters), "copies": F.expr("transform(found, x -> x.n)")})


_TURNS = """transform(arrays_zip(fix.rows, fix.roles), x -> named_struct(
  'role', coalesce(x.roles, get(found, x.rows).role), 'text', if(x.rows < 0, '', get(found, x.rows).text)))"""
_GAPS = "coalesce(last_turn - first_turn + 1 - turns, 0L) AS gaps"
_OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "fix.cost AS cost", "fix.audit AS audit", f"{_TURNS} AS repaired"]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that one group may hold: one shuffle, everything else in its partitions."""
    placed = rows.repartition("conv_id")
    each = placed.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    judged = _judged(each.withColumn("seen", F.row_number().over(earlier)), F.col("seen") > 1)
    fixed = _gathered(judged, ["conv_id"]).withColumn("fix", F.pandas_udf(_repair_whole, _REPAIR)("symbols", "copies"))
    return fixed.selectExpr("*", _GAPS).selectExpr("conv_id", "0 AS part", "1 AS parts", *_OUT)


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the parts of each conversation in order; a row for every part when it ends.

    Held: four audits of the conversation at most, and of its parts the numbers only.
    """
    conv, parts, tops, facts = None, [], {}, None

    def ended() -> pd.DataFrame:
        """The turns chain of a top holds (entry, exit) of every part before."""
        cost, audit, links, top = accepted(tops)
        at_end, steps = top if links and links[1] == -1 else -1, []
        while links and links[1] == -1:
            links = links[0]
        while links:
            links, entry, leave = links
            steps.append((entry, leave))
        frame = pd.DataFrame(steps[::-1], columns=["entry", "leave"])
        frame["conv"], frame["slice"], frame["end"] = conv, parts, [-1] * (len(parts) - 1) + [at_end]
        return frame.assign(part=range(len(parts)), parts=len(parts), gaps=facts["gaps"], across=facts["across"])

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.conv != conv:
                if conv is not None:
                    yield ended()
                conv, parts, tops = row.conv, [], {START: (0, "", None)}
                facts = {"gaps": 0, "across": 0, "first": None, "last": None, "initial": None}
            after: Tops = {}
            for step in row.table:
                if step["entry"] in tops:
                    cost, audit, links = tops[step["entry"]]
                    _offer(after, step["exit"], cost + step["cost"], audit + step["audit"], (links, step["entry"], step["exit"]))
            tops = after
            parts.append(row.slice)
            if facts["initial"] is not None and facts["initial"] + "|" + row.first_initial not in ("s|u", "u|a", "a|u"):
                facts["across"] += 1
            facts["initial"] = row.last_initial
            if not pd.isna(row.first_turn):
                facts["first"] = row.first_turn if facts["first"] is None else facts["first"]
                step = 0 if facts["last"] is None else row.first_turn - facts["last"] - 1
                facts["gaps"] += int(max(step, 0) + row.last_turn - row.first_turn + 1 - row.turns)
                facts["last"] = row.last_turn
    if conv is not None:
        yield ended()


def _long(rows: DataFrame, part_rows: int) -> DataFrame:
    """Conversations of any length, in parts along their order.

    Equal rows are counted before they are dealt, so a part holds distinct rows; the first
    place of a (role, text) comes from a minimum that is reduced where the rows are.
    """
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).where("n > 0")
    each = each.withColumn("conv", F.struct("conv_id"))
    slices = each.agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(part_rows)).cast("int")).first()[0] or 1
    dealt = cut(each.repartitionByRange(slices, "conv_id", "turn", "role", "text").withColumn("slice", F.spark_partition_id()), "long-conversations")
    first = dealt.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    same = (dealt["conv"] == first["conv"]) & (dealt["role"] == first["role"]) & (dealt["text"] == first["text"])
    again = F.struct(F.col("turn").isNotNull(), "turn") > F.col("first")
    judged = _judged(dealt.join(first, same).select(dealt["*"], "first"), again)
    gathered = cut(_gathered(judged, ["conv", "slice"]), "long-parts")
    tables = gathered.select(
        "conv", "slice", "first_turn", "last_turn", "turns", F.pandas_udf(_part_table, _TABLE)("symbols", "copies").alias("table"),
        F.expr("coalesce(get(found, 0).initial, '')").alias("first_initial"), F.expr("coalesce(element_at(found, -1).initial, '')").alias("last_initial"),
    )
    # One text per conversation: pandas would turn ids with a null among them into floats.
    code = F.to_json("conv")
    ordered = tables.withColumn("conv", code).repartition("conv").sortWithinPartitions("conv", "slice")
    chain = "conv string, slice int, entry int, leave int, end int, part int, parts int, gaps long, across long"
    steps = cut(ordered.mapInPandas(returning(_select(_chained, chain)), chain), "long-steps")
    placed = gathered.withColumn("code", code).join(steps.withColumnRenamed("conv", "code"), ["code", "slice"])
    fixed = placed.withColumn("fix", F.pandas_udf(_repair_part, _REPAIR)("symbols", "copies", "entry", "leave", "end"))
    fixed = fixed.withColumn("illegal", F.col("illegal") + F.when(F.col("part") == 0, F.col("across")).otherwise(0))
    fixed = fixed.withColumn("gaps", F.when(F.col("part") == 0, F.col("gaps")).otherwise(0))
    return fixed.withColumn("conv_id", F.col("conv.conv_id")).selectExpr("conv_id", "part", "parts", *_OUT)


def _select(task, schema: str):
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        for pdf in task(batches):
            yield pdf[names]

    return run


def repair(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    ``rows`` has conv_id, turn, role, text and ``n``, how often the row stands there (0: it only
    names its conversation).  Rows are taken by turn, nulls first, then role and text, which
    puts equal rows next to each other.  A role counts by its first character; only s, u and a
    can be kept, other roles need a new one.  ``repaired`` is the array of (role, text) of the
    mended conversation.  A conversation of up to ``part_rows`` rows is one row with ``parts`` 1;
    a longer one has a row per part, whose counts and costs add up and whose audits and turns
    follow each other by ``part``.  Null roles and texts are one space; a null conv_id is a
    conversation like any other; a conversation without rows has zeros and an empty audit; an
    empty table gives an empty one.  Other columns are ignored.
    """
    blank = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "n")
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("rows")).where(F.col("rows") > part_rows)
    long_ones = cut(sizes.select(F.struct("conv_id").alias("long_id")), "long-ids")
    if long_ones.isEmpty():
        return _short(rows)
    same = F.struct("conv_id") == F.col("long_id")
    return _short(rows.join(long_ones, same, "left_anti")).unionByName(_long(rows.join(long_ones, same, "left_semi"), part_rows))


def _digest_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and whole audit of each conversation from its parts in order."""
    code, sha, audit, none = None, None, [], True
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.code != code:
                if code is not None:
                    yield pd.DataFrame([(code, "".join(audit), sha.hexdigest())], columns=["code", "audit", "repaired_sha256"])
                code, sha, audit, none = row.code, hashlib.sha256(), [], True
            audit.append(row.audit)
            if row.turns:
                sha.update(("" if none else "\n").encode() + row.body.encode())
                none = False
    if code is not None:
        yield pd.DataFrame([(code, "".join(audit), sha.hexdigest())], columns=["code", "audit", "repaired_sha256"])


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit and the digest of the mended text.

    The digest of a long conversation is taken over its parts as they stream by in order.
    """
    body = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = parts.where("parts = 1").select("conv_id", *counts, "audit", F.sha2(body.cast("binary"), 256).alias("repaired_sha256"))
    several = parts.where("parts > 1").withColumn("conv", F.struct("conv_id")).withColumn("code", F.to_json("conv"))
    sums = several.groupBy("code").agg(F.any_value("conv").alias("conv"), *[F.sum(c).alias(c) for c in counts])
    texts = several.select("code", "part", "audit", F.size("repaired").alias("turns"), body.alias("body"))
    streamed = texts.repartition("code").sortWithinPartitions("code", "part").mapInPandas(
        returning(_digest_parts), "code string, audit string, repaired_sha256 string"
    )
    joined = sums.join(streamed, "code").select("conv.conv_id", *counts, "audit", "repaired_sha256")
    return whole.unionByName(joined)
