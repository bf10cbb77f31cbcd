"""Repair of conversations by the cheapest edits, found as a shortest path over scalar big integers.

The repaired roles have to read ``(s?(ua)+)?`` by their initials. Each row is kept (cost 0), given the
role that fits (2) or deleted (3, required for blank and repeated rows); user and assistant rows
without text may be put in anywhere (2); a row kept although it breaks off adds 1. Every path through
the rows and the four states of that grammar weighs one integer: the high digits are the cost, and a
fixed number of low digits holds the letters of its edits in order, zeros filling the end. The smaller
integer is thus the cheaper path, and among equally cheap ones that with the ASCII-least letters, so one
plain integer minimum a state decides everything. Paths are built from the end: a letter put in front
moves the low digits down one place, which the zeros at the end make exact.

Rows are put in order by ranges and cut into chunks of ``CHUNK`` rows, each solved by itself between all
pairs of states; the chunks of a conversation are then joined pairwise. So a conversation of any length is
spread over tasks, and only its edits, not its texts, meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: Letters in ASCII order from 1; 0 is the padding. Bits of a digit.
LETTERS, BITS = ".DIKR", 3
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
#: State after a row that is kept, by its initial: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: State after the row that fits (a user row, or an assistant row after a user row).
FITS = {0: 2, 1: 2, 2: 3, 3: 2}
CHUNK_BITS = 8  # chunks of 256 rows
VISIBLE = r"[^\x20\x09-\x0D]"


@dataclass
class Path:
    """A weight with ``width`` low digits."""

    weight: int
    width: int

    @property
    def cost(self) -> int:
        return self.weight >> BITS * self.width

    @property
    def letters(self) -> str:
        low = self.weight & ((1 << BITS * self.width) - 1)
        digits = ((low >> BITS * k) & 7 for k in range(self.width - 1, -1, -1))
        return "".join(LETTERS[d] for d in digits if d)


def weigh(cost: int, letters: str, width: int) -> int:
    low = 0
    for c in letters:
        low = low << BITS | LETTERS.index(c)
    return cost << BITS * width | low << BITS * (width - len(letters))


def solve(rows: list[tuple[str, bool, bool, int]], entries: tuple[int, ...] = (0, 1, 2, 3)) -> dict[tuple[int, int], Path]:
    """The lightest path between each pair of states (before, after) over rows of (initial, must go, breaks off, further copies).

    New rows are put in before a row only; those after the last one belong to what follows. Further copies of a row always go.
    """
    width = sum(1 + r[3] for r in rows) + 2 * len(rows)
    size = BITS * width
    mask = (1 << size) - 1

    def front(weight: int | None, cost: int, letter: str) -> int | None:
        return None if weight is None else ((weight >> size) + cost) << size | LETTERS.index(letter) << size - BITS | (weight & mask) >> BITS

    least = lambda *w: min((x for x in w if x is not None), default=None)
    found = {}
    for end in range(4):
        best: list[int | None] = [0 if s == end else None for s in range(4)]
        for initial, must_go, broken, more in reversed(rows):
            for _ in range(more):
                best = [front(w, DELETE, "D") for w in best]
            now = [front(w, DELETE, "D") for w in best]
            if not must_go:
                step = STEPS.get(initial, {})
                now = [least(w, front(best[FITS[s]], REROLE + broken, "R"), front(best[step[s]], KEEP + broken, "K") if s in step else None) for s, w in enumerate(now)]
            once = [least(w, front(now[FITS[s]], INSERT, "I")) for s, w in enumerate(now)]
            best = [least(w, front(once[FITS[s]], INSERT, "I")) for s, w in enumerate(now)]
        found |= {(s, end): Path(best[s], width) for s in entries if best[s] is not None}
    return found


def join_paths(left: dict[tuple[int, int], Path], right: dict[tuple[int, int], Path]) -> dict[tuple[int, int], Path]:
    """The lightest paths through two neighbouring pieces; the second one's letters follow the first one's at once."""
    out: dict[tuple[int, int], Path] = {}
    for (s, m), p in left.items():
        low = p.weight & ((1 << BITS * p.width) - 1)
        used = p.width - ((low & -low).bit_length() - 1) // BITS if low else 0
        for t in range(4):
            q = right.get((m, t))
            if q is None:
                continue
            width = p.width + q.width
            after = q.weight & ((1 << BITS * q.width) - 1)
            w = (p.cost + q.cost) << BITS * width | low << BITS * q.width | after << BITS * (p.width - used)
            if (s, t) not in out or w < out[s, t].weight:
                out[s, t] = Path(w, width)
    return out


#: What may follow the last row, by the state before: state 3 stands for the end.
CLOSING = {(0, 3): Path(0, 2), (3, 3): Path(0, 2), (2, 3): Path(weigh(INSERT, "I", 2), 2), (1, 3): Path(weigh(2 * INSERT, "II", 2), 2)}


def cheapest(pieces: list[dict[tuple[int, int], Path]]) -> Path:
    """The lightest path from nothing to a whole conversation through the pieces in order, joined pairwise."""
    level = [*pieces, CLOSING]
    while len(level) > 1:
        level = [join_paths(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0][0, 3]


def read_edits(letters: str, initials: str, more: list[int]) -> list[str]:
    """For each row what is written in its place: u and a for rows put in, = kept, U and A given that role, - deleted."""
    out, state, at = [], 0, 0
    for initial, n in zip(initials, more):
        here = ""
        while letters[at] == "I":
            here, state, at = here + ("a" if state == 2 else "u"), FITS[state], at + 1
        c = letters[at]
        here += {"K": "=", "D": "-", "R": "A" if state == 2 else "U"}[c]
        state = STEPS[initial][state] if c == "K" else FITS[state] if c == "R" else state
        out.append(here)
        at += 1 + n  # the further copies are deleted
    for _ in letters[at:]:
        out[-1], state = out[-1] + ("a" if state == 2 else "u"), FITS[state]
    return out


def is_illegal(first: str, second: str) -> bool:
    return first + second not in ("su", "ua", "au")


def _solve_chunk(table: pa.Table) -> pa.Table:
    """One row a conversation of the chunk: its counts and the lightest path between each pair of states."""
    out = []
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    start = 0
    while start < len(rows):
        stop = start
        while stop < len(rows) and rows[stop]["conv_id"] == rows[start]["conv_id"]:
            stop += 1
        run = rows[start:stop]
        turns = [r["turn"] for r in run if r["turn"] is not None]
        fault = lambda k: sum(r["fault"] == k for r in run)
        extra = lambda blank: sum(r["copies"] - 1 for r in run if (r["fault"] == "blank") == blank)
        # a conversation that begins inside the chunk begins with nothing
        paths = solve([(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated", r["copies"] - 1) for r in run], (0,) if start else (0, 1, 2, 3))
        out.append({
            "conv_id": run[0]["conv_id"], "first_at": run[0]["at"], "blank": fault("blank") + extra(True), "duplicate": fault("duplicate") + extra(False), "truncated": fault("truncated"),
            "illegal": sum(is_illegal(x["initial"], y["initial"]) for x, y in zip(run, run[1:])) + sum((r["copies"] - 1) * is_illegal(r["initial"], r["initial"]) for r in run),
            "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "n_turns": len(set(turns)),
            "initials": [r["initial"] for r in run], "more": [r["copies"] - 1 for r in run], "paths": [{"s": s, "t": t, "cost": p.cost, "letters": p.letters} for (s, t), p in paths.items()],
        })
        start = stop
    return pa.Table.from_pylist(out, _chunk_schema(table.schema.field("conv_id").type))


def _chunk_schema(conv: pa.DataType) -> pa.Schema:
    i, s = pa.int64(), pa.string()
    path = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", i), ("letters", s)])
    return pa.schema([("conv_id", conv), ("first_at", i), ("blank", i), ("duplicate", i), ("truncated", i), ("illegal", i), ("least_turn", i), ("most_turn", i), ("n_turns", i), ("initials", pa.list_(s)), ("more", pa.list_(i)), ("paths", pa.list_(path))])


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _join_chunks(parts: list[dict]) -> list[dict]:
    """The edits of each chunk of one conversation and, in the first, its report."""
    pieces = []
    for p in parts:
        width = sum(p["more"]) + 3 * len(p["more"])
        pieces.append({(x["s"], x["t"]): Path(weigh(x["cost"], x["letters"], width), width) for x in p["paths"]})
    best = cheapest(pieces)
    letters = best.letters
    edits = read_edits(letters, [c for p in parts for c in p["initials"]], [n for p in parts for n in p["more"]])
    turns = [(p["least_turn"], p["most_turn"]) for p in parts if p["n_turns"]]
    shared = sum(x[1] == y[0] for x, y in zip(turns, turns[1:]))
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(is_illegal(x["initials"][-1], y["initials"][0]) for x, y in zip(parts, parts[1:]))
    report = {"gaps": turns[-1][1] - turns[0][0] + 1 - (sum(p["n_turns"] for p in parts) - shared) if turns else 0, **total, "cost": best.cost, "audit": letters}
    out, at = [], 0
    for k, p in enumerate(parts):
        n = len(p["initials"])
        out.append({"conv_id": p["conv_id"], "first_at": p["first_at"], "edits": edits[at : at + n], "report": None if k else report})
        at += n
    return out


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[dict]]]:
    """Runs of rows with one conv_id out of batches in that order, with the type of that column."""
    held: list[dict] = []
    for b in batches:
        kind = b.schema.field("conv_id").type
        for r in b.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield kind, held
                held = []
            held.append(r)
    if held:
        yield kind, held


@dataclass
class Repair:
    """``report``: one row a conversation with rows: counts of faults, cost, audit. ``rows``: ``conv_id, at, lines``, each
    row's place in the order and what stands there after the repair, as structs of role and text."""

    report: DataFrame
    rows: DataFrame


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults of every conversation and its cheapest repair.

    Rows are taken by turn, null turns first, equal turns by role and by the SHA-256 of the text. Of each row
    the first fault counts: blank (nothing visible), duplicate (role and text seen earlier), truncated (the last
    visible character is none of ``.!?``). ``gaps`` is the number of turns missing between the first and the last
    one, ``illegal`` the number of neighbours whose initials are not su, ua or au. ``cost`` and ``audit`` are those of
    the cheapest edits: K kept, R given another role, D deleted, I put in.

    Nulls in role or text count as one space; rows with a null conversation are one conversation; rows that are equal
    in all four columns are counted first, so that a row repeated any number of times is one row here. Roles may be
    any text: what begins with none of s, u, a can only be given another role or deleted. Other columns are not
    read. An empty table gives empty results. Texts may have any length and are never gathered.
    """
    c = lambda name: F.col(f"`{name}`")
    space = lambda col: F.coalesce(col, F.lit(" "))
    src = rows.select(c(conv_col).alias("conv_id"), c(turn_col).cast("long").alias("turn"), space(c(role_col)).alias("role"), space(c(text_col)).alias("text"))
    once = src.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    order = ("conv_id", "turn", "role", "key")
    placed = materialize(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    lean = placed.select("conv_id", "at", "turn", "role", "copies", "key", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(VISIBLE)).alias("is_blank"), (~end.isin(".", "!", "?")).alias("breaks"))
    firsts = lean.groupBy("conv_id", "role", "key").agg(F.min("at").alias("seen"))
    same = F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.role") == F.col("f.role")) & (F.col("l.key") == F.col("f.key"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("at") > F.col("seen"), "duplicate").when(F.col("breaks"), "truncated").otherwise("")
    marked = lean.alias("l").join(firsts.alias("f"), same).select("l.conv_id", "at", "turn", "initial", "copies", fault.alias("fault"))
    kind = src.schema["conv_id"].dataType.simpleString()
    chunk_type = f"conv_id {kind}, first_at long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, n_turns long, initials array<string>, more array<long>, paths array<struct<s:int,t:int,cost:long,letters:string>>"
    chunks = marked.withColumn("chunk", F.shiftright("at", CHUNK_BITS)).groupBy("chunk").applyInArrow(lambda t: _solve_chunk(t.drop_columns(["chunk"])), chunk_type)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        for kind, parts in _by_conversation(batches):
            kept += _join_chunks(parts)
            if len(kept) >= 2_000:
                yield _edits_batch(kept, kind)
                kept = []
        if kept:
            yield _edits_batch(kept, kind)

    report_type = "struct<" + ",".join(f"{k}:long" for k in _COUNTS) + ",audit:string>"
    joined = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "first_at").mapInArrow(fold, f"conv_id {kind}, first_at long, edits array<string>, report {report_type}")
    joined = materialize(joined, "edits")
    edits = joined.select(F.col("first_at"), F.posexplode("edits").alias("i", "edit")).select((F.col("first_at") + F.col("i")).alias("at"), "edit")
    new = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    user, assistant, empty = F.lit("user"), F.lit("assistant"), F.lit("")
    text = F.col("text")

    def line(e: Column) -> Column:
        return F.when(e == "u", new(user, empty)).when(e == "a", new(assistant, empty)).when(e == "U", new(user, text)).when(e == "A", new(assistant, text)).when(e == "=", new(F.col("role"), text))

    letters = F.filter(F.split("edit", ""), lambda e: ~e.isin("", "-"))
    repaired = placed.select("conv_id", "at", "role", "text").join(edits, "at").select("conv_id", "at", F.transform(letters, line).alias("lines"))
    return Repair(joined.where("report is not null").select("conv_id", "report.*"), repaired)


def _edits_batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    report = pa.struct([*[(k, pa.int64()) for k in _COUNTS], ("audit", pa.string())])
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", conv), ("first_at", pa.int64()), ("edits", pa.list_(pa.string())), ("report", report)]))


def digest_lines(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256``: the digest of each conversation's ``role:text`` lines, joined by newlines.

    A digest goes through its text in order, so a conversation is read by one task, row after row; nothing is gathered.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    src = rows.select("conv_id", "at", F.when(F.size("lines") > 0, text).alias("written"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, first = None, None, True
        for b in batches:
            done = []
            for conv, written in zip(b.column("conv_id").to_pylist(), b.column("written")):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, first = conv, hashlib.sha256(), True
                if written.is_valid:
                    digest.update(b"" if first else b"\n")
                    digest.update(written.as_py().encode())
                    first = False
            if done:
                yield pack(done, b)
        if digest is not None:
            yield pack([(now, digest.hexdigest())], b)

    def pack(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], like.schema.field("conv_id").type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])

    return src.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, f"conv_id {kind}, sha256 string")
