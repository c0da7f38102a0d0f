"""Operator 11: conversation structure repair by a min-plus matrix scan.

A conversation in order has the role initials (s?(ua)+)?, an automaton of four
states. What may be done with a turn is a 4x4 matrix from state to state, its
elements being (cost, audit): the cheapest edits and, among equally cheap ones,
the least letters. The sum of elements is their minimum, the product adds costs
and joins letters, and each turn's matrix is closed under insertions before and
after it. Products are associative, so a conversation is reduced as a tree: in
blocks of turns within a task, then over pieces of long conversations, then
over the tasks that hold a part of it.

Least letters go well with joining because of two equally cheap edits of the
same turns neither begins the other: it would lack insertions, which cost.

Rows are dealt by ranges of (conversation, turn), so a long conversation lies
in several tasks; only conversations at the ends of a task's range, and those
longer than a piece, need to be put together from segments afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trawl.llm.common import SPACE, cut

#: States of (s?(ua)+)?.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: Neighbours that may follow each other, by role initials.
LEGAL = {"su", "ua", "au"}
#: Turns and characters of a piece; a conversation of one piece is a row, a longer one several.
PIECE_TURNS, PIECE_CHARS = 4096, 4_000_000
#: How many segments of neighbouring ranges a step of the tree takes together.
FAN = 16

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]
#: From each state that a role can follow to the state after it.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def least(*elements: Element) -> Element:
    return min((e for e in elements if e is not None), default=None)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product; letters are joined only where costs are least."""
    out = []
    for row in x:
        line: list[Element] = []
        for j in range(4):
            ways = [(row[k][0] + y[k][j][0], k) for k in range(4) if row[k] is not None and y[k][j] is not None]
            low = min(ways, default=(0, 0))[0]
            line.append(least(*((c, row[k][1] + y[k][j][1]) for c, k in ways if c == low)))
        out.append(tuple(line))
    return tuple(out)


def matrix(steps: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(steps.get((i, j)) for j in range(4)) for i in range(4))


def _closure() -> Matrix:
    one = {(i, j): (INSERT, "I") for r in "ua" for i, j in MOVES[r].items()}
    step = matrix({(i, i): (0, "") for i in range(4)} | one)
    return times(times(step, step), step)


#: Any number of insertions; more than two lead nowhere new.
INSERTED = _closure()


@lru_cache(maxsize=16)
def turn_matrix(code: str) -> Matrix:
    """s, u, a, o: the role's initial, o for any other; capitals: cut short; d: must be deleted."""
    steps: dict[tuple[int, int], Element] = {(i, i): (DELETE, "D") for i in range(4)}
    if code != "d":
        more = CUT_SHORT if code.isupper() else 0
        for role, moves in MOVES.items():
            for move in moves.items():
                ways = [(KEEP + more, "K")] if role == code.lower() else []
                ways += [(REROLE + more, "R")] if role != "s" else []
                steps[move] = least(steps.get(move), *ways)
    return times(times(INSERTED, matrix(steps)), INSERTED)


@lru_cache(maxsize=1 << 15)
def block_matrix(codes: str) -> Matrix:
    """The product over a short run of turns; many conversations share such runs."""
    if len(codes) == 1:
        return turn_matrix(codes)
    half = len(codes) // 2
    return times(block_matrix(codes[:half]), block_matrix(codes[half:]))


def tree(parts: list[Matrix]) -> Matrix:
    """The product of matrices, neighbours first, so that letters are joined about log n times."""
    while len(parts) > 1:
        parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else INSERTED


def codes_matrix(codes: str, block: int = 8) -> Matrix:
    return tree([block_matrix(codes[i : i + block]) for i in range(0, len(codes), block)])


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest edits from nothing to the end of a sound conversation."""
    return least(m[START][START], m[START][ASSISTANT])


def after(state: int, letter: str, initial: str = "") -> int:
    """The state after an edit; initial: of the role of a kept turn."""
    if letter == "D":
        return state
    if letter == "K" and initial == "s":
        return SYSTEM
    return ASSISTANT if state == USER else USER


class Part(NamedTuple):
    """What a stretch of neighbouring turns adds to its conversation."""

    n: int
    lo: int | None
    hi: int | None
    distinct: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str | None
    last: str | None

    def then(self, other: Part) -> Part:
        if not self.n or not other.n:
            return self if self.n else other
        lo, hi = (other.lo if self.lo is None else self.lo), (self.hi if other.hi is None else other.hi)
        seen = self.hi is not None and self.hi == other.lo
        odd = self.last + other.first not in LEGAL
        return Part(self.n + other.n, lo, hi, self.distinct + other.distinct - seen, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + odd, self.first, other.last)


NOTHING = Part(0, None, None, 0, 0, 0, 0, 0, None, None)
_PART = "n long, lo long, hi long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_TURNS = "array<struct<turn: long, role: string, text: string, edit: string>>"
_MATRIX = "array<struct<cost: long, audit: string>>"


def flat(m: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for row in m for e in row]


def unflat(cells: list[dict | None]) -> Matrix:
    e = [None if c is None else (c["cost"], c["audit"]) for c in cells]
    return tuple(tuple(e[4 * i : 4 * i + 4]) for i in range(4))


def edited(turns: list[dict], audit: str, state: int = START) -> list[dict]:
    """The turns that are left and those put in, each with its edit's initial; edits come in the order of turns."""
    out, rows = [], iter(turns)
    for letter in audit:
        row = None if letter == "I" else next(rows)
        put = "assistant" if state == USER else "user"
        if letter == "I":
            out.append({"turn": None, "role": put, "text": "", "edit": letter})
        elif letter != "D":
            out.append({"turn": row["turn"], "role": put if letter == "R" else row["role"], "text": row["text"], "edit": letter})
        state = after(state, letter, row["role"][:1] if row else "")
    return out


def _said(text: Column) -> Column:
    return text.rlike(f"[^{SPACE}]")


class _Piece:
    """Turns of one conversation in order, up to a piece's size."""

    def __init__(self, conv: object, seg: int):
        self.conv, self.seg, self.chars = conv, seg, 0
        self.codes: list[str] = []
        self.turns: list[dict] = []
        self.part = NOTHING

    def full(self) -> bool:
        return len(self.turns) >= PIECE_TURNS or self.chars >= PIECE_CHARS

    def add(self, turn: int | None, role: str, text: str, code: str, blank: bool) -> None:
        self.codes.append(code)
        self.turns.append({"turn": turn, "role": role, "text": text, "edit": None})
        self.chars += len(text)
        faults = (int(blank), int(code == "d" and not blank), int(code.isupper()))
        self.part = self.part.then(Part(1, turn, turn, int(turn is not None), *faults, 0, role[:1], role[:1]))


def _folded(schema: StructType):
    """Rows in order to pieces: whole conversations are solved, others leave their codes and matrix."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, size = 0, [], 0, 0

        def give(piece: _Piece, whole: bool) -> None:
            nonlocal held
            codes = "".join(piece.codes)
            m = codes_matrix(codes)
            row = piece.part._asdict() | {"conv_id": piece.conv, "part": part, "seg": piece.seg, "whole": whole}
            if whole:
                cost, audit = best(m)
                row |= {"cost": cost, "audit": audit, "codes": None, "matrix": None, "turns": edited(piece.turns, audit)}
            else:
                row |= {"cost": None, "audit": None, "codes": codes, "matrix": flat(m), "turns": piece.turns}
            done.append(row)
            held += piece.chars + 100 * len(piece.turns)

        def taken() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_pylist(done, schema=arrow)
            done.clear()
            held = 0
            return out

        piece, first, segs = None, True, 0
        for b in batches:
            step = max(1, min(b.num_rows, int(b.num_rows * 4_000_000 / max(b.nbytes, 1))))
            for at in range(0, b.num_rows, step):
                for r in b.slice(at, step).to_pylist():
                    part = r["part"]
                    if piece is None or r["conv_id"] != piece.conv:
                        if piece is not None:
                            give(piece, not first and not piece.seg)
                            first = False
                        piece, segs = _Piece(r["conv_id"], 0), 0
                    for copy in range(r["n"]):
                        if piece.full():
                            # a piece with a successor has a number, and so has its last one
                            piece.seg = segs + 1
                            give(piece, False)
                            segs += 1
                            piece = _Piece(piece.conv, segs + 1)
                            if held > 8_000_000:
                                yield taken()
                        initial = r["role"][:1] if r["role"][:1] in MOVES else "o"
                        code = "d" if r["blank"] or r["seen"] or copy else initial.upper() if r["short"] else initial
                        piece.add(r["turn"], r["role"], r["text"], code, r["blank"])
                    if held > 8_000_000 or len(done) >= 1000:
                        yield taken()
        if piece is not None:
            give(piece, False)
        if done:
            yield taken()

    return run


def _joined(rows: DataFrame, group: Column, schema: StructType) -> DataFrame:
    """Neighbouring segments of a conversation as one: a step of the tree."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                parts = sorted(r["s"], key=lambda s: (s["part"], s["seg"]))
                total = NOTHING
                for s in parts:
                    total = total.then(Part(*(s[f] for f in Part._fields)))
                out.append(total._asdict() | {"conv_id": r["conv_id"], "part": parts[0]["part"], "seg": parts[0]["seg"], "matrix": flat(tree([unflat(s["matrix"]) for s in parts]))})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    held = [c for c in schema.names if c != "conv_id"]
    return rows.groupBy("conv_id", group.alias("_g")).agg(F.collect_list(F.struct(*held)).alias("s")).drop("_g").mapInArrow(run, schema)


def _slices(conv: str):
    """Each segment's letters of its conversation's audit, and the state it begins in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                at, state, audit, out = 0, START, r["audit"], []
                parts = sorted(r["s"], key=lambda s: (s["part"], s["seg"]))
                for k, s in enumerate(parts):
                    begun, entered = at, state
                    for code in s["codes"]:
                        while audit[at] == "I":
                            state, at = after(state, "I"), at + 1
                        state, at = after(state, audit[at], code.lower()), at + 1
                    if k == len(parts) - 1:
                        at = len(audit)
                    out.append((s["part"], s["seg"], k, audit[begun:at], entered))
                ids = pa.array([r["conv_id"]] * len(out), b.schema.field("conv_id").type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32())))], ["conv_id", "part", "seg", "piece", "letters", "state"])

    return run, f"conv_id {conv}, part int, seg long, piece long, letters string, state int"


def _applied(schema: StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "piece": r["piece"], "alone": False, "turns": edited(r["turns"], r["letters"], r["state"])}], schema=arrow)

    return run


class Repaired(NamedTuple):
    """summary: a row for each conversation; turns: its repaired turns, conv_id, piece (from 0), alone (the only piece), turns (turn, role, text, edit)."""

    summary: DataFrame
    turns: DataFrame


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> Repaired:
    """Finds the faults of each conversation and its cheapest repair.

    Turns come in order of turn (a whole number; nulls first), then of role and
    text. summary: conv_id, gaps (whole numbers missing between the least and
    the greatest turn, the largest long if there are more), blank, duplicate, truncated (each turn's first fault),
    illegal (neighbours whose role initials aren't su, ua or au), cost, audit
    (initials of Keep, Rerole, Delete, Insert). A null role or text is one
    space; a role's initial is as it is written; a null conversation is one
    too. copies: how often a row counts, 1 unless given; a conversation whose
    rows all count 0 times has zeros and no turns. Other columns of df play no
    part. turns has a row for a conversation of up to PIECE_TURNS turns and
    PIECE_CHARS characters, and several for a longer one or one that lay at the
    end of a task's range.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    told = (F.lit(1) if copies is None else copies).cast("long")
    base = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))), told.alias("n"))
    # rows that count 0 times only say that their conversation is there
    base = base.select("conv_id", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("turn", "role", "text")), "n")
    conv = F.col("conv_id").cast("string")
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(conv, F.lit("")), conv.isNull().cast("string"), F.length("role").cast("string"), "role", "text")))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    # what is said at more than one turn, and where first; rows equal in turn as well are counted below
    again = base.where("n > 0").groupBy(key.alias("_k")).agg(F.min(when).alias("lo"), F.max(when).alias("hi")).where("lo <> hi")
    again = cut(again.select("_k", F.col("lo.turn").alias("_first")))
    rows = base.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("_k", key).join(again.withColumn("_in", F.lit(True)), "_k", "left")
    last = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    rows = rows.select("conv_id", "turn", "role", "text", "n", (~_said(F.col("text"))).alias("blank"), (F.coalesce("_in", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first"))).alias("seen"), (~last.isin(".", "!", "?")).alias("short"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())

    whole = StructType.fromDDL(f"conv_id {kind}, part int, seg long, whole boolean, {_PART}, cost long, audit string, codes string, matrix {_MATRIX}, turns {_TURNS}")
    pieces = cut(rows.mapInArrow(_folded(whole), whole))
    closed, open_ = pieces.where("whole"), pieces.where("not whole")

    sums = StructType.fromDDL(f"conv_id {kind}, part int, seg long, {_PART}, matrix {_MATRIX}")
    segments = open_.select(*sums.names)
    most = open_.agg(F.max("part")).first()[0] or 0
    joined, width = _joined(segments, F.col("part"), sums), 1
    while width <= most:
        width *= FAN
        joined = _joined(joined, F.floor(F.col("part") / width), sums)
    ends = F.array_sort(F.filter(F.array(*(F.element_at("matrix", 4 * START + j + 1) for j in (START, ASSISTANT))), lambda e: e.isNotNull()))
    joined = cut(joined.withColumn("_b", ends[0]).select("conv_id", *Part._fields, F.col("_b.cost").alias("cost"), F.col("_b.audit").alias("audit")))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("hi", "lo", "distinct")]
    gaps = F.least(F.coalesce(wide[0] - wide[1] + 1 - wide[2], F.lit(0)), F.lit(2**63 - 1)).cast("long").alias("gaps")
    cols = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    summary = closed.select(*cols).unionByName(joined.select(*cols))

    run, ddl = _slices(kind)
    letters = open_.select("conv_id", F.struct("part", "seg", "codes").alias("s")).groupBy("conv_id").agg(F.collect_list("s").alias("s"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    letters = letters.join(joined.select("conv_id", "audit"), same(letters, joined)).select(letters["conv_id"], "s", "audit").mapInArrow(run, ddl)
    mine = open_.join(letters, same(open_, letters) & (open_["part"] == letters["part"]) & (open_["seg"] == letters["seg"]))
    turns = StructType.fromDDL(f"conv_id {kind}, piece long, alone boolean, turns {_TURNS}")
    fixed = mine.select(open_["conv_id"], "piece", "turns", "letters", "state").mapInArrow(_applied(turns), turns)
    return Repaired(summary, closed.select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("alone"), "turns").unionByName(fixed))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of each conversation's role:text, a newline between turns. Pieces of a long conversation pass one task in order, since the hash is a chain; only one of them is held at a time."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, begun, state = None, False, False, hashlib.sha256()
        schema = pa.schema([turns_type, pa.field("sha256", pa.string())])
        for b in batches:
            for i in range(b.num_rows):
                conv, said = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if not known or conv != now:
                    if known:
                        yield pa.RecordBatch.from_pylist([{"conv_id": now, "sha256": state.hexdigest()}], schema=schema)
                    now, known, begun, state = conv, True, False, hashlib.sha256()
                for line in said:
                    state.update((("\n" if begun else "") + line).encode())
                    begun = True
        if known:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "sha256": state.hexdigest()}], schema=schema)

    turns_type = to_arrow_schema(turns.select("conv_id").schema).field(0)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    ordered = turns.where("not alone").select("conv_id", "piece", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    chained = ordered.select("conv_id", "lines").mapInArrow(run, f"conv_id {kind}, sha256 string")
    return turns.where("alone").select("conv_id", F.sha2(F.array_join(lines, "\n"), 256).alias("sha256")).unionByName(chained)


def damage(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of (conv_id, turn, role, text) with planted faults, by crc32 of conv_id:turn modulo 20, and how often each counts: 0 drops a row, 1 empties its text, 2 takes its ends of sentences, 3 doubles it, 4 makes it the user's. A null is one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(kind == 4, "user").otherwise(or_space("role"))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"))
    return rows, F.col("_copies")


def repaired_conversations(df: DataFrame) -> DataFrame:
    """The damaged table's repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows, copies = damage(df)
    found = repair(rows, copies=copies)
    sha = digests(found.turns).withColumnRenamed("conv_id", "_c")
    return found.summary.join(sha, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("sha256", "repaired_sha256")
