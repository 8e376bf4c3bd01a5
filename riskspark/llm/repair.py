"""Conversation structure repair as lightest derivations (Knuth's generalisation of shortest paths to weighted deduction).

An item [n, q] says: the first n rows are edited and what they give is a prefix of (s?(ua)+)? that ends in state q.  A deduction takes an item and an
edit of the next row (keep, rerole, delete), or an insertion, to another item; its weight function adds the cost and appends the edit's initial.  That is
superior (a conclusion never weighs less than its premise in the order of cost, then audit) and monotone: among derivations of one item with one cost no audit is a
prefix of another, as an insertion costs 5 and rows determine the cost of their edits.  So an agenda that pops the least (cost, audit) finalises items for good, and stops at the goal.

At scale the rows of all conversations are ordered by range partitions (conversation, turn, role, text), so a task streams through whole conversations, of which it
holds one at a time.  A conversation that a partition only holds a part of, or that is long, is cut into blocks: a block's table of lightest (cost, audit) from each state to each
state is a premise like an edit is, and the tables compose to that of the conversation.  Its text is hashed last, streamed in order (SHA-256 has one order), so no conversation is held in memory whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import cut, drop

#: Costs of the edits, and of leaving a truncated row in place.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a conversation's roles may be, as states: nothing yet, s, u, a.  A conversation may end with nothing or after a.
STATES, GOALS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: States in which the next of user and assistant may follow: what an insertion or a new role can only be.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: A conversation with more rows or characters than this goes through blocks.
LONG_ROWS, LONG_CHARS = 2048, 1 << 24
BLOCK = 256
BLANK = " \t\n\x0b\x0c\r"

#: A row as the agenda sees it: (initial of its role, must be deleted, is truncated).
Fact = tuple[str, bool, bool]


def lightest(rows: list[Fact], start: int, goals: tuple[int, ...] | None) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from state ``start`` before the rows to states behind them.

    With ``goals`` only the first goal state that is finalised, else every state that can be reached.
    """
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    end = len(rows)
    while agenda:
        cost, audit, n, state = heapq.heappop(agenda)
        if (n, state) in final:
            continue
        final.add((n, state))
        if n == end:
            if goals is None:
                found[state] = (cost, audit)
                if len(found) == STATES:
                    break
            elif state in goals:
                return {state: (cost, audit)}
        new = STEP[state, NEXT[state]]
        if (n, new) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", n, new))
        if n == end:
            continue
        initial, gone, short = rows[n]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", n + 1, state))
        if not gone:
            more = TRUNCATED if short else 0
            kept = STEP.get((state, initial))
            if kept is not None:
                heapq.heappush(agenda, (cost + KEEP + more, audit + "K", n + 1, kept))
            if NEXT[state] != initial:
                heapq.heappush(agenda, (cost + REROLE + more, audit + "R", n + 1, new))
    return found


Table = dict[tuple[int, int], tuple[int, str]]


def table_of(rows: list[Fact]) -> Table:
    """Lightest (cost, audit) of a block from each state to each state."""
    return {(p, q): w for p in range(STATES) for q, w in lightest(rows, p, None).items()}


def compose(a: Table, b: Table) -> Table:
    """The table of two neighbouring blocks: the lightest over the state between them."""
    out: Table = {}
    for (p, r), (cost, audit) in a.items():
        for q in range(STATES):
            if (r, q) in b:
                more = b[r, q]
                w = (cost + more[0], audit + more[1])
                if (p, q) not in out or w < out[p, q]:
                    out[p, q] = w
    return out


class Hashed:
    """SHA-256 of the repaired conversation, fed with rows and edits in order."""

    def __init__(self) -> None:
        self.sha, self.state, self.first = hashlib.sha256(), 0, True

    def _line(self, role: str, text: str, initial: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first, self.state = False, STEP[self.state, initial]

    def insert(self, edits: Iterator[str]) -> str | None:
        """Take insertions; gives the edit after them."""
        for edit in edits:
            if edit != "I":
                return edit
            self._line(ROLE[NEXT[self.state]], "", NEXT[self.state])
        return None

    def row(self, edits: Iterator[str], role: str, text: str) -> None:
        edit = self.insert(edits)
        if edit == "K":
            self._line(role, text, role[:1])
        elif edit == "R":
            self._line(ROLE[NEXT[self.state]], text, NEXT[self.state])


#: One row per conversation, or what a later step needs of it.
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUT = "kind string, conv_id {}, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string, repaired_sha256 string, spot long, turn long, role string, text string, lost boolean, empty boolean, short boolean"
LEGAL = {"su", "ua", "au"}


def _closed(rows: list[tuple]) -> dict:
    """The result of a whole conversation from its rows (turn, role, text, lost, empty, short) in order."""
    rows = [r for r in rows if not r[3]]
    seen: set[tuple[str, str]] = set()
    facts, counts = [], [0, 0, 0]
    for _, role, text, _, empty, short in rows:
        again = not empty and (role, text) in seen
        seen.add((role, text))
        counts[0] += empty
        counts[1] += again
        counts[2] += short and not again
        facts.append((role[:1], empty or again, short and not again))
    turns = {r[0] for r in rows if r[0] is not None}
    cost, audit = next(iter(lightest(facts, 0, GOALS).values()))
    hashed, edits = Hashed(), iter(audit)
    for _, role, text, *_ in rows:
        hashed.row(edits, role, text)
    hashed.insert(edits)
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(facts, facts[1:], strict=False))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashed.sha.hexdigest()}


def _stream(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie wholly within a partition, and the rows of the others.

    A partition's first and last conversation may go on in its neighbours, so they are passed on; so is one that is long.
    """
    names = schema.names
    out: list[dict] = []

    def passed(conv, rows) -> list[dict]:
        return [{"kind": "row", "conv_id": conv, "spot": s, "turn": t, "role": r, "text": x, "lost": lost, "empty": empty, "short": short} for s, t, r, x, lost, empty, short in rows]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema)

    held: list[tuple] = []
    conv, chars, first, long, some = None, 0, True, False, False
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("conv_id", "spot", "turn", "role", "text", "lost", "empty", "short")]
        for row in zip(*columns, strict=True):
            if some and row[0] != conv:
                if first or long:
                    out += passed(conv, held)
                else:
                    out.append({"kind": "done", "conv_id": conv} | _closed([h[1:] for h in held]))
                held, chars, first, long = [], 0, False, False
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
            conv, some = row[0], True
            held.append(row[1:])
            chars += len(row[4])
            if len(held) > most or chars > LONG_CHARS:
                out += passed(conv, held)
                held, chars, long = [], 0, True
                yield batch()
                out.clear()
    out += passed(conv, held)
    yield batch()


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows as (does a new conversation begin, values)."""
    last, some = None, False
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield not some or row[0] != last, row
            last, some = row[0], True


def _segments(batches: Iterable[pa.RecordBatch], schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
    """conv_id, spot of the first row, initials of first and last row, counts and table of each conversation's run of rows (conv_id, spot, initial, empty, again, short) in a partition."""
    run: dict | None = None
    facts: list[Fact] = []

    def close_block() -> None:
        if facts:
            table = table_of(facts)
            run["table"] = compose(run["table"], table) if run["table"] else table
            facts.clear()

    def finished() -> pa.RecordBatch:
        close_block()
        table = run.pop("table")
        row = run | {"cost": [table.get((p, q), (None, None))[0] for p in range(STATES) for q in range(STATES)], "audit": [table.get((p, q), (None, None))[1] for p in range(STATES) for q in range(STATES)]}
        return pa.RecordBatch.from_pylist([row], schema)

    for new, (conv, spot, initial, empty, again, short) in _runs(batches):
        if new:
            if run:
                yield finished()
            run = {"conv_id": conv, "spot": spot, "first": initial, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "table": None}
        elif run["last"] + initial not in LEGAL:
            run["illegal"] += 1
        run["last"] = initial
        again, short = again and not empty, short and not again
        for n, x in (("blank", empty), ("duplicate", again), ("truncated", short)):
            run[n] += x
        facts.append((initial, empty or again, short))
        if len(facts) >= block:
            close_block()
    if run:
        yield finished()


def _chain(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From the segments of a conversation in order: its counts, cost and audit, and each segment's part of the audit (spot, audit)."""
    conv, items, cuts, sums, last = None, {}, [], {}, None

    def finished() -> pa.RecordBatch:
        goal = min((items[q], q) for q in GOALS if q in items)
        (cost, audit), state = goal
        rows = [sums | {"kind": "sum", "conv_id": conv, "cost": cost, "audit": audit}]
        end = len(audit)
        for spot, back in reversed(cuts):
            state, size = back[state]
            rows.append({"kind": "part", "conv_id": conv, "spot": spot, "audit": audit[end - size : end]})
            end -= size
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)

    some = False
    for new, (key, spot, begins, ends, blank, duplicate, truncated, illegal, costs, audits) in _runs(batches):
        if new:
            if some:
                yield finished()
            conv, items, cuts, some, last = key, {0: (0, "")}, [], True, None
            sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        new_items, back = {}, {}
        for p, (cost, audit) in items.items():
            for q in range(STATES):
                if costs[p * STATES + q] is not None:
                    piece = audits[p * STATES + q]
                    w = (cost + costs[p * STATES + q], audit + piece)
                    if q not in new_items or w < new_items[q]:
                        new_items[q], back[q] = w, (p, len(piece))
        items = new_items
        cuts.append((spot, back))
        for n, x in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal + (last is not None and last + begins not in LEGAL))):
            sums[n] += x
        last = ends
    if some:
        yield finished()


def _hash(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """conv_id, repaired_sha256 from rows (conv_id, spot, edits, role, text): where ``edits`` is given it holds those of the rows that follow."""
    hashed, edits, conv, some = Hashed(), iter(""), None, False

    def finished() -> pa.RecordBatch:
        hashed.insert(edits)
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": hashed.sha.hexdigest()}], schema)

    for new, (key, _, given, role, text) in _runs(batches):
        if new:
            if some:
                yield finished()
            hashed, edits, conv, some = Hashed(), iter(""), key, True
        if given is not None:
            hashed.insert(edits)
            edits = iter(given)
        else:
            hashed.row(edits, role, text)
    if some:
        yield finished()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost`` after damage by crc32("conv_id:turn") mod 20; lost rows stay, marked, so that their conversation is not forgotten.

    Nulls in the key, the role and the text are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") == 0, "").otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is not white space ends no sentence."""
    trimmed = F.rtrim(text, F.lit(BLANK))
    return trimmed == "", (trimmed != "") & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, lost``: its faults, and the cheapest repair with its audit and digest.

    Rows are taken by turn, nulls first, equal turns by role and text; a row that repeats another wholly is a duplicate.  A null conversation is one of its own.  Null roles
    and texts do not occur (``damaged`` makes them a space).  A conversation whose rows are all lost has zeros, an empty audit and the digest of nothing; a table without rows gives
    no rows.  Rows of any number and texts of any length are streamed; only the audit, one character an edit, is a single value.  Other columns are not read.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    empty, short = faults(F.col("text"))
    # Equal rows may be many, so a number drawn for each one takes part in the ranges.
    dealt = rows.withColumn("__deal", F.rand(7)).repartitionByRange(*order, "__deal").sortWithinPartitions(*order, "__deal")
    placed = dealt.select("conv_id", F.monotonically_increasing_id().alias("spot"), "turn", "role", "text", "lost", empty.alias("empty"), short.alias("short"))
    arrow = pa.schema([("kind", pa.string()), ("conv_id", _arrow(conv)), *[(c, pa.int64()) for c in RESULT], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("spot", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("lost", pa.bool_()), ("empty", pa.bool_()), ("short", pa.bool_())])
    first = cut(placed.mapInArrow(lambda batches: _stream(batches, arrow, long_rows), OUT.format(conv)))
    done = first.where("kind = 'done'").select("conv_id", *RESULT, "audit", "repaired_sha256")

    # Conversations that are cut by partitions, or long.
    left = first.where("kind = 'row'")
    kept = left.where("not lost")
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = cut(kept.select("conv_id", "spot", "turn", F.left("role", F.lit(1)).alias("initial"), "empty", "short", key.alias("key")))
    earliest = facts.groupBy("conv_id", "key").agg(F.min("spot").alias("spot")).select("spot", F.lit(False).alias("again"))
    flagged = facts.select("conv_id", "spot", "initial", "empty", "short").join(earliest, "spot", "left").select("conv_id", "spot", "initial", "empty", F.coalesce("again", F.lit(True)).alias("again"), "short")
    kinds = pa.schema([("conv_id", _arrow(conv)), ("spot", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
    runs = flagged.repartitionByRange("conv_id", "spot").sortWithinPartitions("conv_id", "spot")
    segments = cut(runs.mapInArrow(lambda batches: _segments(batches, kinds, block), f"conv_id {conv}, spot long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost array<long>, audit array<string>"))
    chained = pa.schema([("kind", pa.string()), ("conv_id", _arrow(conv)), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("spot", pa.int64())])
    solved = cut(segments.repartition("conv_id").sortWithinPartitions("conv_id", "spot").mapInArrow(lambda batches: _chain(batches, chained), f"kind string, conv_id {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, spot long"))
    # The edits of a run stand before its first row.
    none = F.lit(None).cast("string")
    lines = kept.select("conv_id", "spot", none.alias("edits"), "role", "text").unionByName(solved.where("kind = 'part'").select("conv_id", "spot", F.col("audit").alias("edits"), none.alias("role"), none.alias("text")))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "spot", F.col("edits").isNull())
    shas = ordered.mapInArrow(lambda batches: _hash(batches, pa.schema([("conv_id", _arrow(conv)), ("repaired_sha256", pa.string())])), f"conv_id {conv}, repaired_sha256 string")
    turns = facts.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    # What is known of a conversation comes from four sides; the null one is grouped like any other.
    sides = [left.select("conv_id").distinct(), turns, solved.where("kind = 'sum'").drop("kind", "spot"), shas]
    merged = sides[0]
    for side in sides[1:]:
        merged = merged.unionByName(side, allowMissingColumns=True)
    open_ones = merged.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in RESULT], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    out = cut(done.unionByName(open_ones))
    drop(first, facts, segments, solved)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repair_damaged(conversations: DataFrame, long_rows: int = LONG_ROWS, block: int = BLOCK) -> DataFrame:
    """``repair`` after ``damaged``."""
    return repair(damaged(conversations.select("conv_id", "turn", "role", "text")), long_rows, block)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB: one recursion over the places in all conversations at once, with up to two insertions before a row or the end.
ORACLE_SQL = """
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, substr(role, 1, 1) AS i FROM hurt),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed),
told AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS earlier FROM counted),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM told GROUP BY 1),
steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(p, c, q)),
extra AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])) v(p, q, cost, audit, lines)),
best AS (SELECT conv_id, 0::BIGINT AS n, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS w FROM facts
 UNION ALL SELECT b.conv_id, r.n, e.q, min({'cost': b.w.cost + x.cost + e.cost, 'audit': b.w.audit || x.audit || e.audit, 'lines': b.w.lines || x.lines || e.lines}) FROM best b JOIN extra x ON x.p = b.q JOIN told r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n + 1,
 LATERAL (SELECT x.q AS q, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines UNION ALL
  SELECT s.q, CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END + a.more, a.edit, [coalesce(a.role, r.role) || ':' || r.text] FROM steps s JOIN (VALUES ('K', NULL, 0), ('R', 'user', 1), ('R', 'assistant', 1)) a(edit, role, more) ON s.c = CASE WHEN a.edit = 'K' THEN r.i ELSE substr(a.role, 1, 1) END WHERE s.p = x.q AND r.fault NOT IN ('blank', 'duplicate')) e
 GROUP BY 1, 2, 3),
ends AS (SELECT b.conv_id, min({'cost': b.w.cost + x.cost, 'audit': b.w.audit || x.audit, 'lines': b.w.lines || x.lines}) AS w FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.last = b.n JOIN extra x ON x.p = b.q AND x.q IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
