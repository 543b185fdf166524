"""Cheapest repair of a conversation's structure, by scalar big-integer weights.

A repair is a sequence of edits (Keep, Rerole, Delete a turn, Insert an empty one) whose roles read ``(s?(ua)+)?``.  Its
weight is one integer: the cost in the high digits, then one octal digit for each edit's letter in ASCII order, left
aligned in a fixed width, with zeros behind the last.  The smaller integer is then the cheaper repair, and of equally
cheap ones the one whose letters come first; an ordinary minimum over the paths of a DAG (turn, state) decides
everything.  The DAG is walked from its end: putting an edit in front adds its cost and its digit and moves the other
digits one place on.

Conversations are cut into chunks of at most ``CHUNK`` turns, which know nothing of each other: a chunk gives the least
weight from each state to each other one, and the weights of a conversation's chunks are put together in the same way.
That is exact: two repairs of one chunk between the same states and of equal cost are never one the beginning of the
other (each turn has one letter, and more insertions cost more).  So a conversation of any length is dealt out by the
range of its turns, no task holds more turns than a chunk, and only numbers and letters of a conversation meet.  A
conversation that lies in one chunk, as nearly all do, is repaired there and then, without another exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

CHUNK = 256
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after a system, a user, an assistant turn; the role each takes next, and where a kept role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Letters as octal digits in ASCII order; zero is the padding.
DIGITS, LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")


class Weights:
    """Weights whose letters have room for a number of edits."""

    def __init__(self, edits: int):
        self.edits, self.shift = edits, 3 * edits
        self.mask = (1 << self.shift) - 1

    def ahead(self, cost: int, letters: int, n: int, weight: int) -> int:
        """``weight`` with ``n`` edits in front of it."""
        low = weight & self.mask
        return weight - low + (cost << self.shift) + (letters << (self.shift - 3 * n)) + (low >> (3 * n))

    def read(self, weight: int) -> tuple[int, str]:
        """Cost and letters of a weight."""
        return weight >> self.shift, f"{weight & self.mask:0{max(self.edits, 1)}o}".rstrip("0").translate(LETTERS)


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


@lru_cache(maxsize=50_000)
def transfers(kinds: str) -> list[list[tuple[int, str] | None]]:
    """For each state before and after turns of these kinds the cost and letters of the least weight.

    A kind is a role's initial (``x`` for others), in upper case for a turn that is cut off, or ``d`` for one that must go.
    """
    weights = Weights(3 * len(kinds))
    table: list[list] = [[None] * 4 for _ in range(4)]

    def put(cost: int, digit: int, weight: int | None) -> int | None:
        return None if weight is None else weights.ahead(cost, digit, 1, weight)

    for target in range(4):
        best: list[int | None] = [None] * 4
        best[target] = 0
        for kind in reversed(kinds):
            own: list[int | None] = []
            for state in range(4):
                options = [put(DELETE, 1, best[state])]
                if kind != "d":
                    more = CUT_OFF if kind.isupper() else 0
                    if (after := KEPT[state].get(kind.lower())) is not None:
                        options.append(put(KEEP + more, 3, best[after]))
                    options.append(put(REROLE + more, 4, best[NEXT[state]]))
                own.append(_least(*options))
            once = [_least(own[s], put(INSERT, 2, own[NEXT[s]])) for s in range(4)]
            best = [_least(own[s], put(INSERT, 2, once[NEXT[s]])) for s in range(4)]  # three insertions come back to a state
        for state in range(4):
            table[state][target] = None if best[state] is None else weights.read(best[state])
    return table


def combine(tables: list[list[list]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the least repair of a conversation, and for each of its chunks the state before it and its letters."""
    weights = Weights(2 + sum(max(len(x[1]) for row in t for x in row if x) for t in tables))
    tail = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    best: list[int | None] = [weights.ahead(INSERT * len(t), int("0" + t.translate(DIGITS), 8), len(t), 0) for _, t in sorted(tail.items())]
    choices = []
    for table in reversed(tables):
        now, chosen = [], []
        for row in table:
            options = [(weights.ahead(x[0], int("0" + x[1].translate(DIGITS), 8), len(x[1]), best[t]), t) for t, x in enumerate(row) if x and best[t] is not None]
            weight, to = min(options, default=(None, 0))
            now.append(weight)
            chosen.append(to)
        best = now
        choices.append(chosen)
    parts, state = [], START
    for table, chosen in zip(tables, reversed(choices), strict=True):
        to = chosen[state]
        parts.append((state, table[state][to][1]))
        state = to
    if parts:
        parts[-1] = (parts[-1][0], parts[-1][1] + tail[state])
    return (weights.read(best[START])[0] if tables else 0), parts


def applied(state: int, letters: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired turns of a chunk."""
    out, at = [], 0
    for letter in letters:
        if letter == "K":
            role, text = turns[at]
            out.append((role, text))
            state = KEPT[state][role[0]]
        elif letter != "D":
            state = NEXT[state]
            out.append((NAMES[state], turns[at][1] if letter == "R" else ""))
        at += letter != "I"
    return out


def kind_of(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """A turn's kind and its first fault (``b`` blank, ``d`` duplicate, ``t`` truncated, or none)."""
    said = text.strip(SPACES)
    if not said or repeated:
        return "d", "d" if said else "b"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial, "") if said[-1] in ENDS else (initial.upper(), "t")


_CELL = pa.struct([("cost", pa.int64()), ("letters", pa.string())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_CHUNKS = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("facts", pa.struct([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "distinct")]))]
    + [("edge", pa.string()), ("table", pa.list_(_CELL)), ("turns", pa.list_(_TURN)), ("whole", pa.bool_())]
)
_CHUNKS_SQL = (
    "conv_id long, chunk long, facts struct<blank:long,duplicate:long,truncated:long,illegal:long,first_turn:long,last_turn:long,distinct:long>, "
    "edge string, table array<struct<cost:long,letters:string>>, turns array<struct<role:string,text:string>>, whole boolean"
)


def illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _chunk(conv, number: int, rows: list[tuple], whole: bool = False) -> dict:
    """One chunk from its rows (turn, role, text, repeated); ``whole`` if it is known to be all of the conversation."""
    kinds, faults = zip(*[kind_of(role, text, repeated) for _, role, text, repeated in rows], strict=True)
    initials = [role[:1] for _, role, _, _ in rows]
    known = [t for t, *_ in rows if t is not None]
    facts = {
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(map(illegal, initials, initials[1:])),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "distinct": len(set(known)),
    }
    table = [{"cost": x[0], "letters": x[1]} if x else None for row in transfers("".join(kinds)) for x in row]
    turns = [{"role": role, "text": text} for _, role, text, _ in rows]
    # first and last role's initial, each padded: an empty role has none
    return {"conv_id": conv, "chunk": number, "facts": facts, "edge": f"{initials[0]:1}{initials[-1]:1}", "table": table, "turns": turns, "whole": whole}


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the rows of a range, which are in order; numbered by range and place in it."""
    from pyspark import TaskContext

    first = number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    conv, opened = None, False  # whether the chunk begins with its conversation
    for batch in batches:
        out = []
        for c, *row in zip(*[x.to_pylist() for x in batch.columns[:5]], strict=True):
            if held and (c != conv or len(held) == size):
                # the range's first conversation may have begun in the one before
                out.append(_chunk(conv, number, held, whole=opened and c != conv and number > first))
                number, held, opened = number + 1, [], c != conv
            conv = c
            held.append(tuple(row))
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHUNKS)
    if held:
        yield pa.RecordBatch.from_pylist([_chunk(conv, number, held)], _CHUNKS)


_PLAN = pa.schema(
    [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]]
    + [("parts", pa.list_(pa.struct([("chunk", pa.int64()), ("state", pa.int32()), ("letters", pa.string())])))]
)
_PLAN_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, parts array<struct<chunk:long,state:int,letters:string>>"


def _plan(conv, chunks: list[dict]) -> dict:
    """A conversation's figures and repair from its chunks' facts and tables, in order."""
    tables = [[[(x["cost"], x["letters"]) if x else None for x in c["table"][4 * s : 4 * s + 4]] for s in range(4)] for c in chunks]
    cost, parts = combine(tables)
    facts = [c["facts"] for c in chunks]
    total = {k: sum(f[k] for f in facts) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(illegal(a["edge"][1].strip(), b["edge"][0].strip()) for a, b in zip(chunks, chunks[1:], strict=False))
    known = [f for f in facts if f["distinct"]]
    distinct = sum(f["distinct"] for f in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct if known else 0
    return total | {"conv_id": conv, "gaps": gaps, "cost": cost, "parts": [{"chunk": c["chunk"], "state": s, "letters": x} for c, (s, x) in zip(chunks, parts, strict=True)]}


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_plan(conv, chunks) for conv, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], _PLAN)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("letters", pa.string()), ("turns", pa.list_(_TURN))])


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs of conversations of one chunk."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            out = []
            for c in batch.slice(lo, 512).to_pylist():
                plan = _plan(c["conv_id"], [c])
                part = plan.pop("parts")[0]
                turns = applied(part["state"], part["letters"], [(t["role"], t["text"]) for t in c["turns"]])
                out.append(plan | {"chunk": c["chunk"], "letters": part["letters"], "turns": [{"role": r, "text": x} for r, x in turns]})
            yield pa.RecordBatch.from_pylist(out, _REPAIRED)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [
            [{"role": r, "text": x} for r, x in applied(state, letters, [(t["role"], t["text"]) for t in turns])]
            for state, letters, turns in zip(*[batch.column(c).to_pylist() for c in ("state", "letters", "turns")], strict=True)
        ]
        kept = [c for c in batch.schema.names if c not in ("state", "turns")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(turns, pa.list_(_TURN))], [*kept, "turns"])


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED_SQL = "conv_id long, chunk long, " + ", ".join(f"{c} long" for c in FACTS) + ", letters string, turns array<struct<role:string,text:string>>"


def _sides(turns: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Repaired chunks: of conversations that are one, and of the others."""
    filled = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    same = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    # of rows that agree in everything the first stands first; row numbers only spread such rows over ranges
    marked = filled.withColumn("repeated", F.row_number().over(same) > 1).withColumn("place", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "repeated", "place"]
    chunks = staged(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _chunks(batches, size), _CHUNKS_SQL))
    one = chunks.where("whole").mapInArrow(_at_once, _REPAIRED_SQL)
    several = chunks.where("not whole")
    met = several.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "facts", "edge", "table"))).alias("chunks"))
    parts = met.mapInArrow(_plans, _PLAN_SQL).select("conv_id", *FACTS, F.explode("parts").alias("part")).select("conv_id", *FACTS, "part.*")
    both = parts.join(several.select("chunk", "turns"), "chunk").select("conv_id", "chunk", *FACTS, "letters", "state", "turns")
    return one, both.mapInArrow(_repaired, _REPAIRED_SQL)


def repair(turns: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """Chunks of repaired conversations from ``turns`` (conv_id, turn, role, text, ...).

    Rows (conv_id, chunk, gaps, blank, duplicate, truncated, illegal, cost, letters, turns): a conversation is its chunks
    in the order of ``chunk``; the figures are those of the whole conversation, on each of its chunks; ``letters`` are the
    edits and ``turns`` (array of role, text) the repaired turns of the chunk.

    * Turns are ordered by (turn, role, text), nulls first.  Null role or text counts as one space, so its turn has no
      known role or is blank.  Rows without conv_id are one conversation without id.
    * Repeated rows are duplicates of the first.  An empty role has no initial.  Texts and conversations may have any
      length.  Other columns are ignored; an empty table gives no rows.
    """
    one, several = _sides(turns, size)
    return one.unionAll(several)


def summary(turns: DataFrame, *, size: int = CHUNK) -> DataFrame:
    """One row per conversation of :func:`repair`: figures, audit and the digest of ``role:text`` lines joined by a line feed.

    The chunks of a conversation pass by in order; none is held.
    """
    one, several = _sides(turns, size)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    short = one.select("conv_id", *FACTS, F.col("letters").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, letters, lines, digest = None, None, [], 0, None
        names = ["conv_id", *FACTS, "audit", "repaired_sha256"]
        kinds = [*[pa.int64()] * (1 + len(FACTS)), pa.string(), pa.string()]

        def done() -> tuple:
            return (*first, "".join(letters), digest.hexdigest())

        for batch in batches:
            out = []
            for *row, part, turns in zip(*[batch.column(c).to_pylist() for c in ("conv_id", *FACTS, "letters", "turns")], strict=True):
                if first is None or row[0] != conv:
                    if first is not None:
                        out.append(done())
                    conv, first, letters, lines, digest = row[0], row, [], 0, hashlib.sha256()
                letters.append(part)
                for t in turns:
                    digest.update(f"{chr(10) if lines else ''}{t['role']}:{t['text']}".encode())
                    lines += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds, strict=True)], names)

    schema = "conv_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
    return short.unionAll(several.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema))
