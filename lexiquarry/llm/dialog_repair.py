"""Repair of damaged conversations by a generalised LR parser with weighted edits.

The roles of a conversation must read ``(s?(ua)+)?`` by their initials: nothing, or a system row perhaps and then
pairs of user and assistant. :data:`GRAMMAR` says so, and its LR(0) automaton is built from it. The parser
keeps a graph-structured stack: a node is an automaton state with the nodes that may lie under it. Each
row is kept, reroled or deleted, and rows may be inserted before it and at the end; a kept or reroled row and
an inserted one shift a role, whatever reductions follow are done at once, and nodes with the same state at
the same place are one node, with what lies under all of them and the least (cost, audit). That loses nothing:
what can follow a state is the same whatever lies under it in this grammar, and of two audits of equal
cost over the same rows neither begins the other (they differ by inserted rows only, which cost), so
their order stays when both go on in the same way.

Rows are added up where all columns agree, put in order by a range partitioning on conversation, turn, role and
text, and read partition by partition, so that a conversation of any length is spread over tasks. A
conversation that lies inside a partition is repaired there. Of one that crosses partitions, or has more
than ``PIECE`` rows, each piece gives the cheapest way from each stack top to each other one; the ways of a
conversation's pieces, without texts, are put together in order, and each piece then edits its own rows. Only the
digest, which is sequential by nature, reads a conversation's pieces one after another, as a stream.

Cases: a null role or text is one space; a null ``conv_id`` is a conversation of its own; null turns come first; rows
of the same turn go by role, then by text; a role with another initial than s, u and a can only be reroled
or deleted; conversations without rows after the damage give zeros, an empty audit and the digest of
the empty text; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.shared import table, written

SPACE = " \t\n\u000b\f\r"
#: Rows, and characters, of a conversation that are looked at together.
PIECE, PIECE_CHARS = 1000, 4_000_000

#: A production is its left side and its right side. Terminals are initials of roles.
GRAMMAR = [("start", ("talk",)), ("talk", ()), ("talk", ("head", "turns")), ("head", ()), ("head", ("s",)), ("turns", ("pair",)), ("turns", ("turns", "pair")), ("pair", ("u", "a"))]
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

Best = tuple[int, str]


class Automaton:
    """The LR(0) automaton of a grammar: ``goto[state][symbol]``, and the productions that are complete in each state."""

    def __init__(self, grammar: list[tuple[str, tuple[str, ...]]]):
        self.grammar = grammar
        start = self._closed({(0, 0)})
        self.goto: list[dict[str, int]] = [{}]
        self.path: list[list[str]] = [[]]  # the symbols on the shortest stack with each state on top
        states = {start: 0}
        found = [start]
        for k, items in enumerate(found):  # grows while it is read
            for symbol in dict.fromkeys(grammar[p][1][dot] for p, dot in sorted(items) if dot < len(grammar[p][1])):
                to = self._closed({(p, dot + 1) for p, dot in items if grammar[p][1][dot : dot + 1] == (symbol,)})
                if to not in states:
                    states[to] = len(found)
                    found.append(to)
                    self.goto.append({})
                    self.path.append([*self.path[k], symbol])
                self.goto[k][symbol] = states[to]
        self.complete = [[grammar[p] for p, dot in sorted(items) if p and dot == len(grammar[p][1])] for items in found]
        self.shifts = [{s for s in to if s in "sua"} for to in self.goto]
        self.accepts = self.goto[0][grammar[0][1][0]]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            p, dot = todo.pop()
            for q, (left, _) in enumerate(self.grammar):
                if self.grammar[p][1][dot : dot + 1] == (left,) and (q, 0) not in items:
                    items.add((q, 0))
                    todo.append((q, 0))
        return frozenset(items)


LR = Automaton(GRAMMAR)
#: States with which a row can be shifted; between rows only these matter.
TOPS = [k for k, shifts in enumerate(LR.shifts) if shifts]
#: The one in which a pair is open, and so the next role is the assistant's.
OPEN = next(k for k in TOPS if LR.shifts[k] == {"a"})


class Node:
    """A state, the nodes under it by their states, and the least (cost, audit) that leads here."""

    __slots__ = ("below", "best", "state")

    def __init__(self, state: int, below: dict[int, Node], best: Best):
        self.state, self.below, self.best = state, below, best


Stack = dict[int, Node]


def _merged(into: dict[int, Node], more: dict[int, Node]) -> bool:
    """Adds nodes under a node; those of equal state become one. Tells if there is anything new."""
    new = False
    for state, node in more.items():
        if state not in into:
            into[state] = node
            new = True
        elif into[state] is not node and node.below:
            new |= _merged(into[state].below, node.below)
    return new


def push(stack: Stack, state: int, below: dict[int, Node], best: Best) -> None:
    """A new top, and every top that reductions make of it."""
    node = stack.get(state)
    if node is None:
        node = stack[state] = Node(state, dict(below), best)
    else:
        new = _merged(node.below, below)
        if best < node.best:
            node.best = best
        elif not new:
            return
    for left, right in LR.complete[state]:
        under = [node]
        for _ in right:
            under = [x for n in under for x in n.below.values()]
        for n in under:
            push(stack, LR.goto[n.state][left], {n.state: n}, node.best)


def entered(top: int) -> Stack:
    """A stack with ``top`` on it."""
    node = Node(0, {}, (0, ""))
    for symbol in LR.path[top]:
        node = Node(LR.goto[node.state][symbol], {node.state: node}, (0, ""))
    stack: Stack = {}
    push(stack, node.state, node.below, node.best)
    return stack


def _shift(after: Stack, node: Node, role: str, cost: int, edit: str) -> None:
    if role in LR.shifts[node.state]:
        push(after, LR.goto[node.state][role], {node.state: node}, (node.best[0] + cost, node.best[1] + edit))


def inserted(stack: Stack) -> Stack:
    """The stack with rows inserted where that is cheapest; two insertions close a pair and open none, so two rounds do."""
    for _ in range(2):
        for node in [stack[k] for k in TOPS if k in stack]:
            for role in ROLES:
                _shift(stack, node, role, INSERT, "I")
    return stack


class Row(NamedTuple):
    """A row of a conversation ``n`` times over; ``fault`` is blank, duplicate, truncated or nothing."""

    role: str
    text: str
    n: int
    fault: str


def stepped(stack: Stack, row: Row) -> Stack:
    """The stack after one row and its repetitions; a row that must go only deletes."""
    gone = row.n if row.fault in ("blank", "duplicate") else row.n - 1
    rest, extra = "D" * gone, TRUNCATED if row.fault == "truncated" else 0
    after: Stack = {}
    for node in [stack[k] for k in TOPS if k in stack]:
        cost, audit = node.best
        deleted = row.n
        push(after, node.state, node.below, (cost + DELETE * deleted, audit + "D" * deleted))
        if gone < row.n:
            _shift(after, node, row.role[:1] or "-", KEEP + extra + DELETE * gone, "K" + rest)
            for role in ROLES:
                _shift(after, node, role, REROLE + extra + DELETE * gone, "R" + rest)
    return after


def parsed(rows: Iterable[Row], stack: Stack) -> Stack:
    for row in rows:
        stack = stepped(inserted(stack), row)
    return inserted(stack)


def edited(rows: Iterable[Row], audit: str, is_open: bool) -> list[tuple[str, str]]:
    """``(role, text)`` after the edits of ``audit``; ``is_open`` tells that the row before is a user's."""
    out: list[tuple[str, str]] = []
    each = ((r.role, r.text) for r in rows for _ in range(r.n))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(each)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if is_open else "u"]
        out.append((role, text))
        is_open = role[0] == "u"
    return out


def joined(lines: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in lines)


# --- rows with their faults ------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` after the damage that a checksum of id and turn deals; ``n`` is 0 for a dropped row."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        F.col("conv_id").cast("long"),
        F.when(kind != 0, F.col("turn").cast("long")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def given(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` of rows as they are."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("n"))


def faulty(rows: DataFrame) -> DataFrame:
    """Each different row once, with how often it stands there, ``n``, and its first ``fault``."""
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    stripped = F.rtrim("text", F.lit(SPACE))
    ends: Column = F.right(stripped, F.lit(1)).isin(".", "!", "?")
    each = each.withColumn("said", F.when((F.col("n") > 0) & (stripped != ""), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # The first turn of what is said in several turns; all else is there for the first time.
    again = each.where(F.col("said").isNotNull()).groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    again = again.where(F.col("turns") > 1).select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    met = each.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("n") == 0, "").when(F.col("said").isNull(), "blank").when(later, "duplicate").when(~ends, "truncated").otherwise("")
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


# --- pieces ----------------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
WAY = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
LINE = pa.struct([("role", pa.string()), ("text", pa.string())])
ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fault", pa.string())])
PIECES = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("last_turn", pa.int64()), ("initials", pa.list_(pa.string())),
        ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("ways", pa.list_(WAY)), ("rows", pa.list_(ROW)), ("lines", pa.list_(LINE)),
    ]
)
PIECES_DDL = (
    "conv_id long, part long, whole boolean, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, last_turn long, initials array<string>, "
    "cost long, audit string, repaired_sha256 string, ways array<struct<from:int,to:int,cost:long,audit:string>>, rows array<struct<role:string,text:string,n:long,fault:string>>, lines array<struct<role:string,text:string>>"
)


def is_illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def looked_at(rows: list[Row], turns: list[int | None]) -> dict:
    """What a piece adds to its conversation's counts; its rows are in order."""
    out = dict.fromkeys(COUNTS, 0)
    initials = [r.role[:1] for r in rows]
    for r in rows:
        if r.fault in ("blank", "duplicate"):
            out[r.fault] += r.n
        else:
            out["duplicate"] += r.n - 1
            out["truncated"] += r.fault == "truncated"
        out["illegal"] += r.n - 1
    out["illegal"] += sum(map(is_illegal, initials, initials[1:]))
    known = sorted({t for t in turns if t is not None})
    return out | {"least": known[0] if known else None, "most": known[-1] if known else None, "turns": len(known), "last_turn": known[-1] if known else None, "initials": initials[:1] + initials[-1:]}


def gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def _whole(rows: list[Row], lines: bool) -> dict:
    """A conversation that is all here, repaired."""
    best = parsed(rows, entered(0))[LR.accepts].best
    after = edited(rows, best[1], False)
    out = {"whole": True, "cost": best[0], "audit": best[1], "repaired_sha256": hashlib.sha256(joined(after).encode()).hexdigest()}
    return out | {"lines": [{"role": r, "text": t} for r, t in after]} if lines else out


def _partly(rows: list[Row]) -> dict:
    """A piece of a conversation: the cheapest way from each stack top to each other, and the rows to edit later."""
    ways = [{"from": top, "to": to, "cost": node.best[0], "audit": node.best[1]} for top in TOPS for to, node in parsed(rows, entered(top)).items() if to in TOPS]
    return {"whole": False, "ways": ways, "rows": [r._asdict() for r in rows]}


def _pieces(batches: Iterator[pa.RecordBatch], lines: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Conversations and pieces of a sorted partition. Its first and its last conversation may go on beyond it."""
    own = TaskContext.get()
    part = (own.partitionId() if own else 0) << 33
    held: list[tuple[Row, int | None]] = []
    chars, conv, first, cut, any_row, waiting = 0, None, True, False, False, 0
    out: list[dict] = []

    def close(more: bool) -> None:
        """Ends the piece that is held; ``more`` tells that the conversation may go on."""
        nonlocal held, chars, part, waiting
        rows, turns = [r for r, _ in held if r.n], [t for r, t in held if r.n]
        out.append({"conv_id": conv, "part": part} | looked_at(rows, turns) | (_partly(rows) if first or cut or more else _whole(rows, lines)))
        held, chars, part, waiting = [], 0, part + 1, waiting + chars

    def told() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=PIECES)
            out.clear()

    for batch in batches:
        for i, turn, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")), strict=True):
            if any_row and i != conv:
                close(False)
                first = cut = False
            elif len(held) >= size or chars >= PIECE_CHARS:
                close(True)
                cut = True
            conv, any_row = i, True
            held.append((Row(*row), turn))
            chars += len(row[1])
            if len(out) >= 500 or waiting >= PIECE_CHARS:
                yield from told()
                waiting = 0
    if any_row:
        close(True)
    yield from told()


def pieces(rows: DataFrame, lines: bool = False, size: int = PIECE) -> DataFrame:
    """``rows`` (see :func:`faulty`) in order, in whole conversations and pieces of at most ``size`` rows."""
    order = ["conv_id", "turn", "role", "text"]
    sorted_ = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(256))).sortWithinPartitions(*order)
    return sorted_.mapInArrow(lambda b: _pieces(b, lines, size), PIECES_DDL)


# --- conversations in several pieces ---------------------------------------------------------------------

CHOSEN = "conv_id long, part long, edits string, entry int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chained(found: list[dict]) -> tuple[Best, list[tuple[int, str]]]:
    """The least (cost, audit) over a conversation's pieces, and each piece's stack top and edits on that way."""
    best: dict[int, Best] = {k: node.best for k, node in entered(0).items() if k in TOPS}
    steps: list[dict[int, tuple[int, str]]] = []
    for piece in found:
        after: dict[int, Best] = {}
        came: dict[int, tuple[int, str]] = {}
        for way in piece["ways"]:
            if way["from"] in best:
                cost, audit = best[way["from"]]
                new = (cost + way["cost"], audit + way["audit"])
                if way["to"] not in after or new < after[way["to"]]:
                    after[way["to"]], came[way["to"]] = new, (way["from"], way["audit"])
        best = after
        steps.append(came)
    total, top = min((b, k) for k, b in best.items() if LR.accepts in entered(k))
    chosen = []
    for came in reversed(steps):
        chosen.append(came[top])
        top = came[top][0]
    return total, chosen[::-1]


def _chosen(group: pa.Table) -> pa.Table:
    """The chosen edits of each piece of one conversation; totals stand beside the first piece's."""
    found = sorted(group.to_pylist(), key=lambda r: r["part"])
    (cost, audit), edits = chained(found)
    total = {c: sum(r[c] for r in found) for c in COUNTS}
    spoken = [r for r in found if r["initials"]]
    total["illegal"] += sum(is_illegal(a["initials"][-1], b["initials"][0]) for a, b in zip(spoken, spoken[1:], strict=False))
    timed = [r for r in found if r["least"] is not None]
    shared = sum(a["last_turn"] == b["least"] for a, b in zip(timed, timed[1:], strict=False))
    turns = sum(r["turns"] for r in timed) - shared
    total |= {"cost": cost, "audit": audit, "gaps": gaps(timed[0]["least"], timed[-1]["most"], turns) if timed else 0}
    rows = [{"conv_id": r["conv_id"], "part": r["part"], "edits": own, "entry": top} | (total if k == 0 else {}) for k, (r, (top, own)) in enumerate(zip(found, edits, strict=True))]
    names = [x.split()[0] for x in CHOSEN.split(", ")]
    kinds = {"edits": pa.string(), "audit": pa.string(), "entry": pa.int32()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(x, kinds.get(x, pa.int64())) for x in names]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ["conv_id", "part"]
    for batch in batches:
        for k in range(batch.num_rows):
            own = batch.slice(k, 1)
            rows = [Row(**r) for r in own.column("rows")[0].as_py() or ()]
            lines = edited(rows, own.column("edits")[0].as_py(), own.column("entry")[0].as_py() == OPEN)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), pa.array([[{"role": r, "text": t} for r, t in lines]], pa.list_(LINE))], names=[*kept, "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation, from its pieces in order."""

    def lines() -> Iterator[tuple[int | None, list[dict]]]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column("conv_id")[k].as_py(), batch.column("lines")[k].as_py()

    for conv, own in groupby(lines(), key=lambda x: x[0]):
        digest, begun = hashlib.sha256(), False
        for _, part in own:
            if part:
                digest.update((("\n" if begun else "") + joined((x["role"], x["text"]) for x in part)).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


RESULT = ("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def _parts(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is chosen for the pieces of conversations in several pieces, and their lines after it."""
    partly = made.where(~F.col("whole"))
    told = partly.select("conv_id", "part", *COUNTS, "least", "most", "turns", "last_turn", "initials", "ways")
    chosen = written(told.groupBy("conv_id").applyInArrow(_chosen, CHOSEN), "edits")
    edits = chosen.select("part", "edits", "entry")  # numbers of parts are unique over all conversations
    lines = partly.select("conv_id", "part", "rows").join(edits, "part").select("conv_id", "part", "rows", "edits", "entry")
    return chosen, lines.mapInArrow(_edited, "conv_id long, part long, lines array<struct<role:string,text:string>>")


def repair(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``rows`` (:func:`given` or :func:`damaged`)."""
    made = written(pieces(written(faulty(rows), "rows"), size=size), "pieces")
    left = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long"))
    whole = made.where("whole").withColumn("gaps", left).select(*RESULT)
    chosen, lines = _parts(made)
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "_conv")
    partly = chosen.where(F.col("cost").isNotNull()).join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return whole.unionByName(partly.select(*RESULT))


def repaired_rows(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, at, role, text``: the rows of every conversation after its repair, numbered by ``at`` in their order, with gaps."""
    made = written(pieces(written(faulty(rows), "rows"), True, size), "pieces")
    parts = made.where("whole").select("conv_id", "part", "lines").unionByName(_parts(made)[1])
    each = parts.select("conv_id", "part", F.posexplode_outer("lines").alias("k", "line")).where(F.col("line").isNotNull())
    return each.select("conv_id", F.struct("part", "k").alias("at"), "line.role", "line.text")


def op12_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
         ) AS crc
  FROM conversations
), kinds AS (
  SELECT *, xor(crc, 4294967295) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM faults GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR) AS s3
  FROM totals
  UNION ALL
  SELECT conv_id, k,
         CASE WHEN s0 IS NULL THEN NULL ELSE {'c': s0.c + 2, 'a': s0.a || 'D'} END,
         list_min([CASE WHEN s1 IS NULL THEN NULL ELSE {'c': s1.c + 2, 'a': s1.a || 'D'} END,
                   CASE WHEN stays AND initial = 's' AND s0 IS NOT NULL THEN {'c': s0.c + extra, 'a': s0.a || 'K'} END]),
         list_min([CASE WHEN s2 IS NULL THEN NULL ELSE {'c': s2.c + 2, 'a': s2.a || 'D'} END,
                   CASE WHEN stays AND to_u IS NOT NULL THEN {'c': to_u.c + extra + 1, 'a': to_u.a || 'R'} END,
                   CASE WHEN stays AND to_u IS NOT NULL AND initial = 'u' THEN {'c': to_u.c + extra, 'a': to_u.a || 'K'} END]),
         list_min([CASE WHEN s3 IS NULL THEN NULL ELSE {'c': s3.c + 2, 'a': s3.a || 'D'} END,
                   CASE WHEN stays AND s2 IS NOT NULL THEN {'c': s2.c + extra + 1, 'a': s2.a || 'R'} END,
                   CASE WHEN stays AND s2 IS NOT NULL AND initial = 'a' THEN {'c': s2.c + extra, 'a': s2.a || 'K'} END])
  FROM (
    SELECT i.conv_id, i.s0, i.s1, i.s2, i.s3, i.to_u, r.k, r.initial, r.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END AS extra
    FROM (
      SELECT conv_id, k, s0, s1, s2, list_min([s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I'} END]) AS s3, to_u
      FROM (
        SELECT conv_id, k, s0, s1, s3, list_min([s0, s1, s3]) AS to_u,
               list_min([s2, CASE WHEN list_min([s0, s1, s3]) IS NOT NULL THEN {'c': list_min([s0, s1, s3]).c + 5, 'a': list_min([s0, s1, s3]).a || 'I'} END]) AS s2
        FROM steps
      )
    ) i JOIN faults r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.k = i.k + 1
  )
), ended AS (
  SELECT s.conv_id, list_min([s0, s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I'} END,
         CASE WHEN list_min([s0, s1, s3]) IS NOT NULL THEN {'c': list_min([s0, s1, s3]).c + 10, 'a': list_min([s0, s1, s3]).a || 'II'} END]) AS best
  FROM steps s JOIN totals t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND s.k = t.n
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS edit, unnest(range(length(best.a))) AS pos FROM ended WHERE best.a <> ''
), placed AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM letters
), outs AS (
  SELECT p.conv_id, p.edit, CASE WHEN p.edit <> 'I' THEN r.role END AS role, CASE WHEN p.edit = 'I' THEN '' ELSE r.text END AS text,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.pos) AS o
  FROM placed p LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k WHERE p.edit <> 'D'
), heads AS (
  SELECT *, bool_or(o = 1 AND edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS head FROM outs
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - head::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS sha
  FROM heads GROUP BY conv_id
)
SELECT c.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated,
       coalesce(t.illegal, 0) AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
