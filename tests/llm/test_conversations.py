import hashlib
import heapq
import random
import re
import zlib

import pytest

from helpers import got
from tidemark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, n long, part int, symbols string, found string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired): best-first over whole edit sequences, the grammar as a pattern."""
    heap, best = [(0, "", 0, "", ())], {}
    limit = 3 * len(rows) + 1
    while heap:
        cost, audit, at, roles, turns = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.match(roles):
            return cost, audit, turns
        key = (at, roles[-2:], len(roles) > 2)
        if cost > limit or best.get(key, (cost, audit)) < (cost, audit):
            continue
        best[key] = (cost, audit)

        def push(more, letter, step, initial=None, turn=None):
            grown = roles + (initial or "")
            if re.match(r"(s|s?(ua)*u?)\Z", grown):
                heapq.heappush(heap, (cost + more, audit + letter, at + step, grown, turns + ((turn,) if turn else ())))

        for role in ("user", "assistant"):
            push(2, "I", 0, role[0], (role, ""))
        if at < len(rows):
            role, text, fault = rows[at]
            push(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    push(extra, "K", 1, role[0], (role, text))
                for new in ("user", "assistant"):
                    push(2 + extra, "R", 1, new[0], (new, text))
    raise AssertionError


def by_hand(table):
    """The contract of the query, conversation by conversation."""
    grouped = {}
    for conv, turn, role, text, *_ in table:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        rows = grouped.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    result = []
    for conv, rows in grouped.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = lambda name: sum(f == name for *_, f in judged)
        illegal = sum(a[1][:1] + "|" + b[1][:1] not in ("s|u", "u|a", "a|u") for a, b in zip(rows, rows[1:]))
        cost, audit, turns = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        result.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(result, key=repr)


def table(seed, conversations_, most):
    rng = random.Random(seed)
    texts = ["Hello.", "How?", "Fine!", "so", "and then", "", " \t\n", "é. ", "x.\x0b", " ", None, "Hello.", "a?b"]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "User", "sys"]
    rows = []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            place = None if rng.random() < 0.05 else turn * (1 if rng.random() < 0.9 else 3)
            rows.append((conv, place, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"turn {turn}.", 1, 2, "s", "f"))
    rows += rows[:10] + [(None, 0, "user", "Hi.", 1, 1, "", ""), (None, 1, "assistant", "Ho.", 1, 1, "", ""), (None, None, None, None, None, None, None, None)]
    rows += [(9000, t, "user", "same", 1, 1, "", "") for t in range(30)]
    rows += [(9001 + i, i, "user", "one.", 1, 1, "", "") for i in range(40)]  # some lose their only row
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_equals_searching_all_edits(spark):
    rows = table(1, 150, 8) + [(7, 3, "assistant", "long " * 100_000 + ".", 1, 1, "", "")]
    found = conversations.digests(conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert found.columns == COLUMNS
    want = by_hand(rows)
    assert got(found, *COLUMNS) == want
    assert any(r[7] == "" for r in want) and {"K", "R", "D", "I"} <= set("".join(r[7] for r in want))


@pytest.mark.parametrize("part_rows", [2, 3, 7])
def test_parts_make_the_same_repair(spark, part_rows):
    """Tiny parts: every conversation above them is parsed apart and joined."""
    rows = table(part_rows, 40, 14)
    damaged = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    parts = conversations.repair(damaged, part_rows)
    assert parts.where("parts > 2").count() > 0
    assert got(conversations.digests(parts), *COLUMNS) == by_hand(rows)


def test_many_equal_rows_and_long_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(20_000)]
    rows += [(2, None, "user", "again")] * 30_000
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    found = {r["conv_id"]: r for r in conversations.digests(conversations.repair(df)).collect()}
    assert found[1]["cost"] == 0 and found[1]["audit"] == "K" * 20_000 and found[1]["illegal"] == 0
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:20_000])
    assert found[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert found[2]["duplicate"] == 29_999 and found[2]["illegal"] == 29_999 and found[2]["audit"] in ("D" * 30_000, "K" + "D" * 29_999 + "I")
    assert found[2]["cost"] == 29_999 * 3 + 3


@pytest.mark.parametrize("seed", range(4))
def test_parse_against_all_sequences(seed):
    rng = random.Random(seed)
    for _ in range(60):
        kinds = [(rng.choice("suax"), rng.choice("kkktd")) for _ in range(rng.randint(0, 6))]
        names = {"k": "", "t": "truncated", "d": "blank"}
        want = cheapest([(c, str(i), names[f]) for i, (c, f) in enumerate(kinds)])
        have = conversations.accepted(conversations.parse("".join(c + f for c, f in kinds), [1] * len(kinds)))
        assert have[:2] == want[:2]


def test_empty_table(spark):
    empty = conversations.damaged(spark.createDataFrame([], SCHEMA))
    assert conversations.digests(conversations.repair(empty)).count() == 0
