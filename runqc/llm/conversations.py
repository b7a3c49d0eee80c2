"""Conversation structure repair by Hirschberg's divide and conquer over four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.session import written

#: States: nothing said yet, after the system's turn, after a user's, after an assistant's. Repaired conversations end
#: in the first (empty) or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The state that a turn of the other speaker leads to, inserted or reroled.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of one piece of a conversation. It bounds what is searched at once; longer conversations are joined from pieces.
PIECE = 1024
FAR = 10**15
WORD, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def step(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, audit letter, next state) of all edits of a row. ``code``: see ``coded``."""
    out = [(DELETE, "D", state)]
    if code not in "bd":
        late = TRUNCATED if code.isupper() else 0
        out.append((REROLE + late, "R", NEXT[state]))
        kind = code.lower()
        if kind == "s" and state == START:
            out.append((late, "K", SYSTEM))
        elif kind == "u" and state != USER or kind == "a" and state == USER:
            out.append((late, "K", NEXT[state]))
    return out


def filled(state: int) -> list[tuple[int, str, int]]:
    """(cost, audit, state) of inserting none, one or two turns; three or more only come back to a state."""
    return [(0, "", state), (INSERT, "I", NEXT[state]), (2 * INSERT, "II", NEXT[NEXT[state]])]


@cache
def one_row(code: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """Least (cost, audit) of a row from each state to each, with inserted turns around it."""
    best = [[(FAR, "")] * 4 for _ in range(4)]
    for a in range(4):
        for c0, before, s in filled(a):
            for c1, letter, t in step(code, s):
                for c2, after, b in filled(t):
                    best[a][b] = min(best[a][b], (c0 + c1 + c2, before + letter + after))
    return tuple(map(tuple, best))


@cache
def _costs(code: str) -> np.ndarray:
    return np.array([[c for c, _ in row] for row in one_row(code)], np.int64)


class Segment:
    """The least-cost audits of a run of rows between any two states.

    Hirschberg: the cost vector forward from the entry and the one backward from the exit meet in the middle; each half
    is then solved between the states of an optimal crossing. Only vectors of four costs are kept, and the audits
    themselves. Of several optimal crossings the one whose first half has the least audit is taken: two least-cost audits
    to different states differ before either ends, or the longer goes on with insertions, which the shorter's second half
    may make as well; so the first half decides, and on equal beginnings the shorter.
    """

    def __init__(self, codes: str):
        self.codes = codes
        self.known: dict[tuple[int, int, int, int], str] = {}

    def _forward(self, lo: int, hi: int, entry: int) -> np.ndarray:
        cost = np.full(4, FAR)
        cost[entry] = 0
        for code in self.codes[lo:hi]:
            cost = (cost[:, None] + _costs(code)).min(0)
        return cost

    def _backward(self, lo: int, hi: int, leave: int) -> np.ndarray:
        cost = np.full(4, FAR)
        cost[leave] = 0
        for code in reversed(self.codes[lo:hi]):
            cost = (_costs(code) + cost).min(1)
        return cost

    def costs(self) -> np.ndarray:
        """Cost from each state (row) to each (column)."""
        return np.stack([self._forward(0, len(self.codes), s) for s in range(4)])

    def audit(self, entry: int, leave: int) -> str:
        """The least audit among those of least cost; the pair must be within reach."""
        return self._audit(0, len(self.codes), entry, leave)

    def _audit(self, lo: int, hi: int, entry: int, leave: int) -> str:
        if hi - lo == 1:
            return one_row(self.codes[lo])[entry][leave][1]
        key = (lo, hi, entry, leave)
        if key not in self.known:
            mid = (lo + hi) // 2
            meet = self._forward(lo, mid, entry) + self._backward(mid, hi, leave)
            first, crossing = min((self._audit(lo, mid, entry, int(s)), int(s)) for s in np.flatnonzero(meet == meet.min()))
            self.known[key] = first + self._audit(mid, hi, crossing, leave)
        return self.known[key]


def joined(costs: list[np.ndarray], audits: list[list[str | None]]) -> tuple[int, list[str]]:
    """(cost, audit of each piece) of a conversation in pieces: backward costs from its end, then the audit-least crossing
    of each border, as within a piece. ``audits`` has an audit per pair of states, None out of reach."""
    back = [np.array([0 if s in ENDS else FAR for s in range(4)])]
    for c in reversed(costs):
        back.append((c + back[-1]).min(1))
    back.reverse()
    state, parts = START, []
    for i, c in enumerate(costs):
        total = c[state] + back[i + 1]
        part, state = min((audits[i][4 * state + int(s)], int(s)) for s in np.flatnonzero(total == total.min()))
        parts.append(part)
    return int(back[0][START]), parts


def damaged(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut, repeated or given to the user by a checksum of their key.

    A NULL counts as one space, in the key as well as in role and text; the turn itself stays NULL.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), luck.alias("luck"))
    changed = rows.where("luck <> 0").select(
        "conv_id", "turn", F.when(F.col("luck") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "luck")
    again = F.when(F.col("luck") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.select("conv_id", "turn", "role", "text", F.explode(again).alias("again")).drop("again")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows of a conversation one after another, with a ``place`` that rises; kept as a table.

    Rows are dealt by ranges of their whole order and a number of their own, so a conversation, a turn or a text that a
    third of the rows share is cut anywhere.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("said"), F.col("own")]
    dealt = rows.withColumns({"said": F.xxhash64("role", "text"), "own": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", "text"), "conversation-rows")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, place, code): what an edit's cost depends on, one letter a row.

    b blank, d duplicate; else s, u, a by the role's initial, o any other; capital if the text is truncated. A duplicate
    is known by the least place of its conversation, role and text: counted before the shuffle, joined by place.
    """
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("text")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    kind = F.when(_initial("role").isin("s", "u", "a"), _initial("role")).otherwise("o")
    small = rows.select("conv_id", "place", F.rlike("text", F.lit(WORD)).alias("said"), F.rlike("text", F.lit(ENDED)).alias("ended"), kind.alias("kind"))
    code = F.when(~F.col("said"), "b").when(F.col("new").isNull(), "d").when(~F.col("ended"), F.upper("kind")).otherwise(F.col("kind"))
    return small.join(first, "place", "left").select("conv_id", "place", code.alias("code"))


def _pieces(codes: DataFrame, size: int) -> DataFrame:
    """(conv_id, place, codes): runs of at most ``size`` rows of a conversation, in order, named by their first place."""
    key = codes.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        letters: list[str] = []
        done: list[tuple] = []
        kind = None
        batch_of = lambda: pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["conv_id", "place", "codes"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, place, code in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[0] != conv or len(letters) == size:
                    if held is not None:
                        done.append((*held, "".join(letters)))
                    held, letters = (conv, place), []
                letters.append(code)
            if len(done) >= 4096:
                yield batch_of()
                done = []
        if held is not None:
            done.append((*held, "".join(letters)))
            yield batch_of()

    return codes.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(run, f"conv_id {key}, place long, codes string")


SOLVED_DDL = "place long, codes string, audit string, cost long"


@lru_cache(50_000)
def _solve(codes: str) -> tuple[str, int]:
    """(audit, cost) of a whole conversation."""
    segment = Segment(codes)
    cost = segment._forward(0, len(codes), START)
    least = min(int(cost[s]) for s in ENDS)
    return min(segment.audit(START, s) for s in ENDS if cost[s] == least), least


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one piece."""
    for batch in batches:
        places, codes = (batch.column(c).to_pylist() for c in ("place", "codes"))
        made = [_solve(c) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array(codes, pa.string()), pa.array([a for a, _ in made], pa.string()), pa.array([c for _, c in made], pa.int64())],
            names=["place", "codes", "audit", "cost"])


def _solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of longer conversations: the costs and audits between all pairs of states."""
    for batch in batches:
        costs, audits = [], []
        for c in batch.column("codes").to_pylist():
            segment = Segment(c)
            m = segment.costs()
            costs.append(m.ravel().tolist())
            audits.append([segment.audit(a, b) if m[a, b] < FAR else None for a in range(4) for b in range(4)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=[*batch.schema.names, "costs", "audits"])


def _join_parts(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("place")
    costs = [np.array(c, np.int64).reshape(4, 4) for c in parts.column("costs").to_pylist()]
    cost, chosen = joined(costs, parts.column("audits").to_pylist())
    return pa.table({"place": parts.column("place"), "codes": parts.column("codes"), "audit": pa.array(chosen, pa.string()), "cost": pa.array([cost] + [0] * (len(chosen) - 1), pa.int64())})


def _solved(pieces: DataFrame) -> DataFrame:
    """(conv_id, place, codes, audit, cost) per piece; the costs of a conversation's pieces add up to its cost."""
    key = pieces.schema["conv_id"].dataType.simpleString()
    several = pieces.groupBy("conv_id").count().where("count > 1").select(F.struct("conv_id").alias("conv"))
    named = pieces.withColumn("conv", F.struct("conv_id"))
    whole = named.join(several, "conv", "left_anti").select("place", "codes").mapInArrow(_solve_whole, SOLVED_DDL)
    parts = named.join(several, "conv", "left_semi").select("conv", "place", "codes")
    parts = parts.mapInArrow(_solve_parts, f"conv struct<conv_id: {key}>, place long, codes string, costs array<long>, audits array<string>")
    long = parts.groupBy("conv").applyInArrow(_join_parts, SOLVED_DDL)
    return written(whole.unionAll(long).join(pieces.select("conv_id", "place"), "place"), "conversation-audits")


class _Conversation:
    """Running result of one conversation; its rows come in order, each piece's edits before its rows."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.cost, self.hash, self.lines = conv_id, START, [], 0, hashlib.sha256(), 0
        self.faults, self.illegal, self.before = {"b": 0, "d": 0, "t": 0}, 0, None
        self.turns, self.low, self.high = 0, None, None

    def edits(self, codes: str, audit: str, cost: int) -> None:
        self.audit.append(audit)
        self.cost += cost
        self.codes, self.todo = iter(codes), iter(audit)

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self, letters: Iterator[str]) -> str:
        """The next letter that is not an insertion; '' at the end."""
        for letter in letters:
            if letter != "I":
                return letter
            self.state = NEXT[self.state]
            self._say(ROLES[self.state], "")
        return ""

    def row(self, turn: int | None, role: str, text: str) -> None:
        code, letter = next(self.codes), self._insert(self.todo)
        fault = code if code in "bd" else "t" if code.isupper() else ""
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if letter == "R":
            self.state = NEXT[self.state]
            self._say(ROLES[self.state], text)
        elif letter == "K":
            self.state = SYSTEM if code in "sS" else NEXT[self.state]
            self._say(role, text)

    def end_piece(self) -> None:
        self._insert(self.todo)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
          ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted (conv_id, place, turn, role, text, codes, audit, cost); rows with ``codes`` bring a piece's edits."""
    now: _Conversation | None = None
    out: list[tuple] = []
    kind = None
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *(pa.array([r[i + 1] for r in out], t) for i, (_, t) in enumerate(RESULT))], names=["conv_id", *(n for n, _ in RESULT)])
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, _, turn, role, text, codes, audit, cost in zip(*(c.to_pylist() for c in batch.columns)):
            if codes is None:
                now.row(turn, role, text)
                continue
            if now is not None:
                now.end_piece()
                if now.conv_id != conv:
                    out.append(now.result())
                    now = None
            now = now or _Conversation(conv)
            now.edits(codes, audit, cost)
        if len(out) >= 2048:
            yield batch_of()
            out = []
    if now is not None:
        now.end_piece()
        out.append(now.result())
        yield batch_of()


def repaired(rows: DataFrame, piece: int = PIECE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    Rows are taken by turn (NULL first), then by a hash of role and text, so repeated turns have one order. The cheapest edits turn
    each conversation into an optional system turn and pairs of user and assistant turns, or into nothing: keep 0,
    rerole to user or assistant 1, delete 2 (the only edit of blank and duplicate rows), insert an empty turn 5; a
    truncated row that stays adds 5. ``audit`` has the initials of the edits, the ASCII-least of the cheapest.
    ``repaired_sha256`` is of the repaired ``role:text``, joined by newlines.

    Pieces of conversations are solved apart, and joined by their costs between states, so a conversation may hold a
    third of all rows. What must follow one after another is only the digest, which streams through in order of the rows.
    A NULL conv_id is a conversation; a NULL role or text is one space. Empty texts are blank. Other columns are ignored;
    an empty table gives an empty result.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    placed = _placed(rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text")))
    solved = _solved(written(_pieces(coded(placed), piece), "conversation-pieces"))
    none = lambda kind: F.lit(None).cast(kind)
    stream = placed.select("conv_id", "place", "turn", "role", "text", none("string").alias("codes"), none("string").alias("audit"), none("long").alias("cost"))
    stream = stream.unionAll(solved.select("conv_id", "place", none("long"), none("string"), none("string"), "codes", "audit", "cost"))
    order = [F.col("conv_id").asc_nulls_first(), "place", F.col("codes").asc_nulls_last()]
    key = placed.schema["conv_id"].dataType.simpleString()
    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_applied, f"conv_id {key}, {RESULT_DDL}")


def damaged_and_repaired(turns: DataFrame, piece: int = PIECE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repaired`` of the ``damaged`` rows, for every conversation of ``turns``; those without rows after the damage have zeros."""
    found = repaired(damaged(turns, conv_id, turn, role, text), piece)
    every = turns.select(F.struct(F.col(conv_id).alias("conv_id")).alias("conv")).distinct()
    found = found.select(F.struct("conv_id").alias("conv"), *[n for n, _ in RESULT])
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.join(found, "conv", "left").select("conv.conv_id", *[F.coalesce(n, F.lit(nothing.get(n, 0))).alias(n) for n, _ in RESULT])
