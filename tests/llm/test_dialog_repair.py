from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import dialog_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", ""]


def plain(rows):
    """The least (cost, audit) by trying every way to keep, rerole, delete and insert; at most two rows are inserted at a place."""
    moves = []
    for r in rows:
        own = [(2, "D", "")]
        if r.fault not in ("blank", "duplicate"):
            extra = 5 if r.fault == "truncated" else 0
            own += [(extra, "K", r.role[:1] or "-"), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
        moves += [[(2, "D", "")] if r.n > 1 and k else own for k in range(r.n)]
    gaps = [(0, "", ""), *[(5, "I", x) for x in "ua"], *[(10, "II", x + y) for x in "ua" for y in "ua"]]
    each = [gaps]
    for own in moves:
        each += [own, gaps]
    fits = re.compile("(s?(ua)+)?")
    ways = ([sum(m[0] for m in way), "".join(m[1] for m in way), "".join(m[2] for m in way)] for way in itertools.product(*each))
    return min((cost, audit) for cost, audit, roles in ways if fits.fullmatch(roles))


def drawn(rng, size, faults=("", "", "", "truncated", "blank", "duplicate")):
    return [repair.Row(rng.choice(ROLES), f"t{k}", 1, rng.choice(faults)) for k in range(size)]


def test_parser_against_every_way():
    rng = random.Random(3)
    for size in (0, 1, 2, 3):
        for _ in range(12 if size < 3 else 25):
            rows = drawn(rng, size)
            assert repair.parsed(rows, repair.entered(0))[repair.LR.accepts].best == plain(rows)
    rows = [repair.Row("user", "t", 3, ""), repair.Row("user", "u", 1, "")]
    assert repair.parsed(rows, repair.entered(0))[repair.LR.accepts].best == (5, "KDDR") == plain(rows)


def stepwise(rows):
    """(cost, audit) by the four places in the role pattern: nothing yet, after the system row, after a user, after a pair."""
    best = {0: (0, "")}

    def offer(to, at, cost, edit):
        to[at] = min(to.get(at, (10**9, "")), (cost, edit))

    def filled(now):
        for _ in range(2):
            for at, (cost, audit) in list(now.items()):
                offer(now, 3 if at == 2 else 2, cost + 5, audit + "I")
        return now

    for r in rows:
        after = {}
        for at, (cost, audit) in filled(best).items():
            offer(after, at, cost + 2 * r.n, audit + "D" * r.n)
            if r.fault in ("blank", "duplicate"):
                continue
            cost, rest = cost + 2 * (r.n - 1) + (5 if r.fault == "truncated" else 0), "D" * (r.n - 1)
            offer(after, 3 if at == 2 else 2, cost + 1, audit + "R" + rest)
            if r.role[:1] == {0: "u", 1: "u", 2: "a", 3: "u"}[at]:
                offer(after, 3 if at == 2 else 2, cost, audit + "K" + rest)
            if at == 0 and r.role[:1] == "s":
                offer(after, 1, cost, audit + "K" + rest)
        best = after
    return min(b for at, b in filled(best).items() if at in (0, 3))


@pytest.mark.parametrize("size", [10, 60, 400])
def test_parser_against_the_pattern_of_roles(size):
    rng = random.Random(size)
    for _ in range(20):
        rows = drawn(rng, size)
        assert repair.parsed(rows, repair.entered(0))[repair.LR.accepts].best == stepwise(rows)


def test_pieces_make_the_whole():
    """Any cut into pieces gives the cost, the audit and the lines of the whole."""
    rng = random.Random(8)
    for _ in range(40):
        rows = drawn(rng, 30)
        cost, audit = repair.parsed(rows, repair.entered(0))[repair.LR.accepts].best
        cuts = [0, *sorted(rng.sample(range(1, 30), 4)), 30]
        parts = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        total, edits = repair.chained([repair._partly(p) for p in parts])
        assert total == (cost, audit) and "".join(e for _, e in edits) == audit
        lines = [x for p, (top, own) in zip(parts, edits, strict=True) for x in repair.edited(p, own, top == repair.OPEN)]
        assert lines == repair.edited(rows, audit, False)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))


def sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    return sorted((tuple(r) for r in con.execute(repair.OP12_SQL).fetchall()), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (1, 0, "user", "Hi there."), (1, 0, "user", "Hi there."), (1, 1, "assistant", "Well."), (1, None, "user", "First."), (1, None, None, None),
    (2, None, "assistant", "a."), (2, None, "user", "b"), (2, 5, "user", " \t\n"), (2, 9, "", "no role."), (2, 9, "tool", "x!"), (2, -3, "system", "s."),
    (None, 1, "user", "null conversation."), (None, 2, "assistant", "yes?"), (3, None, None, None), (4, 0, "user", ""), (5, 7, "user", "word " * 60_000 + "."),
    (6, 2**62, "user", "late."), (6, 0, "assistant", "早安！"), (7, 1, "user", "same."), (7, 2, "user", "same."), (7, 3, "user", "same."), (8, 0, "user", "ends. \x0b\x0c\r"),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_query_against_sql_on_odd_rows(spark, tmp_path, parts):
    more = [(100 + k, t, random.Random(k * 50 + t).choice(ROLES), random.Random(k + t).choice(["One.", "Two", "Three!", "", " "])) for k in range(60) for t in range(k % 9)]
    df = spark.createDataFrame(ODD + more, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "fault", "said", "kind", "part", "first")})
    df.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op12_dialog_repair(spark, str(tmp_path))
    assert told(got) == sql(spark, tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert told(repair.op12_dialog_repair(spark, str(tmp_path))) == []


def test_one_conversation_with_most_rows(spark, tmp_path):
    """A conversation of 3,000 rows among small ones, one text in most of its turns, cut in pieces of 64 rows."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(ROLES), "the same." if t % 3 else f"text {t}{rng.choice(['.', ''])}") for t in range(3000)]
    rows += [(1, None, "user", "again.")] * 200 + [(2 + t // 4, t % 4, rng.choice(ROLES), f"x{t}.") for t in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    made = repair.repair(repair.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet"))), size=64)
    assert told(made) == sql(spark, tmp_path)


def test_repaired_rows(spark):
    """The rows themselves, of undamaged input, and their digest."""
    rng = random.Random(6)
    rows = [(k, t, rng.choice(ROLES[:3]), f"{k} {t}{rng.choice(['.', ''])}") for k in range(20) for t in range(300 if k == 3 else k)]
    df = repair.given(spark.createDataFrame(rows, SCHEMA).repartition(5))
    lines = {}
    for r in sorted(repair.repaired_rows(df, size=32).collect(), key=lambda r: (r.conv_id, r.at)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.repair(df, size=32).collect()}
    assert len(digests) == 19
    for conv, (audit, sha) in digests.items():
        own = lines.get(conv, [])
        assert sha == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in own)) and len(own) == sum(x != "D" for x in audit)
