"""Conversation structure repair: the cheapest edits by dynamic programming over layer ranks.

A conversation's turns, in order, are the layers. Between layers only four states matter: nothing
kept yet, after a system turn, after a user turn, after an assistant turn. A macro edit is a run of
inserted turns and what is done to the layer's turn. Its code (``CODES``) ends in a letter that no
run has, so no code is a prefix of another: audit strings compare as their codes do, one by one, and
of a layer's up to four best strings only the order is kept, as ranks, with a pointer to the parent
state. Strings are written out afterwards, backwards along the pointers.

Costs relative to the cheapest, ranks and the turn's kind are few, so a layer is a look-up
(``step``). What chunks of turns do to the four states composes like matrices: a conversation of any
length is cut into chunks that tasks fold apart, and their summaries are composed in rounds.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from boxloom.llm.common import pack, shared

KEEP, DELETE, INSERT, RENAME = 0, 4, 3, 3
#: What an undeleted turn that breaks off adds.
BROKEN = 3
#: Macro edits in the order of their texts.
CODES = ("D", "IK", "IR", "K", "R")
COSTS = (DELETE, INSERT + KEEP, INSERT + RENAME, KEEP, RENAME)
#: States: nothing kept, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that another turn of user or assistant leads to, and the states a conversation may end in.
AFTER = (USER, USER, ASSISTANT, USER)
ENDS = (EMPTY, ASSISTANT)
FAR = 1 << 40
#: Turns of a chunk, and summaries that a task composes.
CHUNK, FAN = 4096, 1024
#: Rows of a batch that goes back to Spark.
BATCH = 256
BLANKS = " \t\n\x0b\x0c\r"

State = tuple[tuple[int, ...], tuple[int, ...]]


def start(state: int) -> State:
    """Costs and ranks when only one state is reached."""
    return tuple(0 if x == state else FAR for x in range(4)), (0, 1, 2, 3)


def _moves(state: int, kind: str) -> Iterator[tuple[int, int]]:
    """``code, next`` of the edits of a turn. Others are dearer: runs of two leave the state as it was.

    A run before a deleted turn is never least: the same run after it costs the same and reads less.
    """
    yield 0, state
    if kind in "bd":
        return
    after = AFTER[state]
    yield 4, after
    yield 2, AFTER[after]
    wanted = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(kind.lower())
    if wanted == SYSTEM and state == EMPTY:
        yield 3, SYSTEM
    elif wanted is not None and wanted == after:
        yield 3, after
    elif wanted in (USER, ASSISTANT):
        yield 1, AFTER[after]


@lru_cache(maxsize=1 << 16)
def step(costs: tuple[int, ...], ranks: tuple[int, ...], kind: str) -> tuple[int, State, tuple]:
    """One layer: what the cheapest costs, the next costs relative to it and ranks, and for each state its parent and code."""
    best: dict[int, tuple] = {}
    extra = BROKEN if kind.isupper() else 0
    for state in range(4):
        if costs[state] >= FAR:
            continue
        for code, to in _moves(state, kind):
            found = (costs[state] + COSTS[code] + (extra if code else 0), ranks[state], code, state)
            if to not in best or found < best[to]:
                best[to] = found
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda to: best[to][1:3])
    placed = tuple(order.index(to) if to in best else 3 for to in range(4))
    relative = tuple(best[to][0] - least if to in best else FAR for to in range(4))
    return least, (relative, placed), tuple((best[to][3], best[to][2]) if to in best else None for to in range(4))


def forward(kinds: str, state: int, trail: list | None = None) -> tuple[int, State]:
    """Cost of the cheapest and the last layer's state; ``trail`` gathers the layers' pointers."""
    total, now = 0, start(state)
    for kind in kinds:
        more, now, parents = step(*now, kind)
        total += more
        if trail is not None:
            trail.append(parents)
    return total, now


def finish(total: int, now: State) -> tuple[int, int]:
    """The end state of the best complete string, and how many turns are inserted after it."""
    found = []
    for state in range(4):
        if now[0][state] < FAR:
            run, at = 0, state
            while at not in ENDS:
                run, at = run + 1, AFTER[at]
            found.append((total + now[0][state] + INSERT * run, now[1][state], run, state))
    _, _, run, state = min(found)
    return state, run


def edits(kinds: str, state: int = EMPTY, end: int | None = None, run: int | None = None) -> str:
    """The audit string of a chunk that starts in ``state`` and ends in ``end``, with ``run`` insertions after it.

    Without an end, the chunk is a whole conversation.
    """
    trail: list = []
    total, now = forward(kinds, state, trail)
    if end is None:
        end, run = finish(total, now)
    out = ["I" * (run or 0)]
    for parents in reversed(trail):
        end, code = parents[end]
        out.append(CODES[code])
    return "".join(reversed(out))


def summary(kinds: str) -> list[int]:
    """For each start state the costs of the four ends, then their ranks: 32 numbers."""
    out = []
    for state in range(4):
        total, (costs, ranks) = forward(kinds, state)
        out += [min(FAR, total + c) for c in costs] + list(ranks)
    return out


def compose(a: list[int], b: list[int]) -> list[int]:
    """The summary of two chunks in a row."""
    out = []
    for state in range(4):
        costs, ranks = a[8 * state : 8 * state + 4], a[8 * state + 4 : 8 * state + 8]
        best = []
        for end in range(4):
            ways = [(costs[m] + b[8 * m + end], ranks[m], b[8 * m + 4 + end]) for m in range(4) if costs[m] < FAR and b[8 * m + end] < FAR]
            best.append(min(ways) if ways else None)
        order = sorted((e for e in range(4) if best[e]), key=lambda e: best[e][1:])
        out += [x[0] if x else FAR for x in best] + [order.index(e) if best[e] else 3 for e in range(4)]
    return out


def between(parts: list[list[int]], state: int, end: int) -> list[tuple[int, int]]:
    """Start and end state of each of several chunks in a row, of the best string from ``state`` to ``end``."""
    layers, now = [], start(state)
    for part in parts:
        best = [None] * 4
        for m in range(4):
            for e in range(4):
                if now[0][m] < FAR and part[8 * m + e] < FAR:
                    way = (now[0][m] + part[8 * m + e], now[1][m], part[8 * m + 4 + e], m)
                    if best[e] is None or way < best[e]:
                        best[e] = way
        order = sorted((e for e in range(4) if best[e]), key=lambda e: best[e][1:3])
        now = tuple(x[0] if x else FAR for x in best), tuple(order.index(e) if best[e] else 3 for e in range(4))
        layers.append([x[3] if x else None for x in best])
    out = []
    for layer in reversed(layers):
        out.append((layer[end], end))
        end = layer[end]
    return out[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the row's crc32: a stated share of each kind.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it and
    4 makes it the user's. Null roles and texts become one space, null ids and turns only in the key.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pack(rows, conv_id=F.col("conv_id"), turn=F.col("turn").cast("long"), role=text("role"), text=text("text"), key=F.concat(text("conv_id"), F.lit(":"), text("turn")))
    kind = F.crc32(F.col("key").cast("binary")) % 20
    cut = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), again.alias("copy")).drop("copy")


def _turns(turns: DataFrame) -> DataFrame:
    """The turns with the hashes of role and text that put equal turns in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pack(turns, conv=F.col("conv_id"), turn=F.col("turn").cast("long"), role=text("role"), text=text("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("turn"), "text", "role")})


def _order(*more: str) -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("h1"), F.col("h2"), *map(F.col, more)]


def kind_of(role: Column, text: Column) -> Column:
    """``b`` blank, else the role's initial (``x``: none of s, u, a), a capital if the text breaks off."""
    said = F.rtrim(text, F.lit(BLANKS))
    first = F.substring(role, 1, 1)
    first = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return F.when(said == "", "b").when(F.substring(said, -1, 1).isin(".", "!", "?"), first).otherwise(F.upper(first))


def chunks(turns: DataFrame) -> DataFrame:
    """``conv, at, turn, h1, h2, kinds``: conversations in chunks of up to ``CHUNK`` turns, with the key of the first.

    Turns are dealt by range of conversation and turn, so a long conversation is in many tasks.
    Only hashes and kinds travel. A turn is a duplicate (``d``) unless it is the first of its role
    and text; equal ones are added up where they lie.
    """
    slim = _turns(turns).select("conv", "turn", "h1", "h2", kind_of(F.col("role"), F.col("text")).alias("kind"))
    # The number spreads turns that are equal in everything; which of them gets which does not matter.
    slim = slim.withColumn("tie", F.monotonically_increasing_id())
    dealt = slim.repartitionByRange(*_order("tie")).sortWithinPartitions(*_order("tie"))
    dealt = shared(dealt.drop("tie").withColumn("seq", F.monotonically_increasing_id()))
    inside = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    most = dealt.agg(F.coalesce(F.max(inside), F.lit(0))).first()[0] // CHUNK + 1
    at = F.shiftright("seq", 33) * most + F.floor(inside / CHUNK)
    firsts = dealt.where("kind <> 'b'").groupBy("conv", "h1", "h2").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    rows = dealt.join(firsts, "seq", "left").withColumn("kind", F.when((F.col("kind") == "b") | F.col("new"), F.col("kind")).otherwise("d"))
    rows = rows.select("conv", at.alias("at"), F.struct("seq", "kind", "turn", "h1", "h2").alias("x")).groupBy("conv", "at").agg(F.array_sort(F.collect_list("x")).alias("x"))
    kinds = F.array_join(F.transform("x", lambda x: x["kind"]), "")
    return shared(rows.select("conv", "at", *[F.get("x", F.lit(0))[c].alias(c) for c in ("turn", "h1", "h2")], kinds.alias("kinds")))


def _ends(parts: DataFrame) -> DataFrame:
    """``conv, at, state, end, run`` for the chunks of conversations that have several.

    Summaries are composed ``FAN`` at a time until a conversation has one; then each round tells
    its parts where the best string enters and leaves them.
    """
    several = parts.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("long"))
    kind = parts.schema["conv"].dataType.simpleString()
    long = parts.join(several, F.col("conv").eqNullSafe(F.col("long")), "left_semi").select("conv", "at", "kinds")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(k.as_py()) for k in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv", "at", "part"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        whole = list(rows["part"].iloc[0])
        for part in rows["part"].iloc[1:]:
            whole = compose(whole, list(part))
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "at": rows["up"].iloc[:1], "part": [whole]}).reset_index(drop=True)

    def opened(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        ways = between([list(p) for p in rows["part"]], int(rows["state"].iloc[0]), int(rows["end"].iloc[0]))
        run = [0] * (len(rows) - 1) + [int(rows["run"].iloc[0])]
        return pd.DataFrame({"conv": rows["conv"].to_numpy(), "at": rows["at"].to_numpy(), "state": [w[0] for w in ways], "end": [w[1] for w in ways], "run": run})

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in batch.column(2):
                costs, ranks = part.as_py()[:4], part.as_py()[4:8]
                found.append(finish(0, (tuple(costs), tuple(ranks))))
            cols = [batch.column(0), batch.column(1), pa.array([EMPTY] * len(found), pa.int32()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["conv", "at", "state", "end", "run"])

    plan = f"conv {kind}, at long, state int, end int, run int"
    levels = [shared(long.mapInArrow(summaries, f"conv {kind}, at long, part array<long>"))]
    while not levels[-1].groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        up = levels[-1].withColumn("up", F.floor(F.col("at") / FAN))
        levels.append(shared(up.groupBy("conv", "up").applyInPandas(composed, f"conv {kind}, at long, part array<long>")))
    ends = levels.pop().mapInArrow(closed, plan)
    for level in reversed(levels):
        above = ends.select(F.col("conv").alias("c"), F.col("at").alias("up"), "state", "end", "run")
        below = level.withColumn("to", F.floor(F.col("at") / FAN))
        below = below.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("to") == F.col("up"))).drop("c", "up")
        ends = below.groupBy("conv", "to").applyInPandas(opened, plan)
    return ends


def audits(turns: DataFrame) -> DataFrame:
    """``conv, at, turn, h1, h2, kinds, edits``: each chunk with its piece of the conversation's audit string."""
    parts = chunks(turns)
    ends = _ends(parts).withColumnsRenamed({"conv": "c", "at": "a"})
    rows = parts.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left")
    kind = parts.schema["conv"].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("kinds", "state", "end", "run")], strict=True)
            found = [edits(k, s or EMPTY, e, r) for k, s, e, r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(6)] + [pa.array(found, pa.string())], ["conv", "at", "turn", "h1", "h2", "kinds", "edits"])

    rows = rows.select("conv", "at", "turn", "h1", "h2", "kinds", "state", "end", "run")
    return rows.mapInArrow(written, f"conv {kind}, at long, turn long, h1 long, h2 long, kinds string, edits string")


def _beside(turns: DataFrame) -> DataFrame:
    """Turns and pieces of audit, sorted by conversation; a piece comes before the first turn that it is about."""
    columns = ["conv", "at", "turn", "h1", "h2", "role", "text", "kinds", "edits"]
    none = F.lit(None).cast("string")
    rows = _turns(turns).withColumns({"kinds": none, "edits": none, "at": none.cast("long")}).select(*columns)
    pieces = audits(turns).withColumns({"role": none, "text": none}).select(*columns)
    both = rows.unionByName(pieces).repartition("conv")
    return both.sortWithinPartitions(*_order(), F.asc_nulls_last("at")).select("conv", "turn", "role", "text", "kinds", "edits")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``turn, edit, kind, initial, role, text`` of a conversation's sorted turns and pieces, one at a time.

    Pieces wait in a queue that turns take their edits from; what is left of it at the end is
    inserted. ``kind`` and ``initial`` are those before the edit, and null for inserted turns.
    """
    todo, kinds, state = "", "", EMPTY

    def inserted() -> tuple:
        nonlocal state
        state = AFTER[state]
        return None, "I", None, None, "user" if state == USER else "assistant", ""

    place = seen = 0
    for _, turn, role, text, more_kinds, more in rows:
        if more is not None:
            todo, kinds, place, seen = todo[place:] + more, kinds[seen:] + more_kinds, 0, 0
            continue
        while todo[place] == "I":
            place += 1
            yield inserted()
        edit, kind, initial = todo[place], kinds[seen], role[:1]
        place, seen = place + 1, seen + 1
        if edit == "R":
            state = AFTER[state]
            role = "user" if state == USER else "assistant"
        elif edit == "K":
            state = SYSTEM if initial == "s" else AFTER[state]
        yield turn, edit, kind, initial, role, text
    for _ in todo[place:]:
        yield inserted()


def fault_of(kind: str | None) -> str | None:
    """The fault that a turn's kind stands for."""
    return {"b": "blank", "d": "duplicate"}.get(kind, "truncated" if kind and kind.isupper() else None)


def _emitted(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> Callable:
    """``rows`` as a function of Arrow batches to batches of ``schema``, a few rows each."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return run


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, rows in groupby(_rows(batches), key=itemgetter(0)):
        yield conv, edited(rows)


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn, edit, fault, role, text``: every turn and inserted turn with its edit, in order.

    ``turns`` has ``conv_id``, ``turn`` (an integer), ``role`` and ``text``; other columns are ignored.
    A turn's first fault counts: blank; duplicate, if an earlier one has its role and text; truncated,
    if it does not end in ``. ! ?``. Blank and duplicate turns are deleted. What stays reads system (at
    most one, first), then user and assistant in turn, or is empty; of the cheapest ways the one whose
    edits' initials (Keep, Rerole, Delete, Insert) come first. ``role`` is the one after the edit.

    Null roles and texts are one space; null turns come first, null ids are one conversation; turns of
    one number are in the order of a hash of role and text, so repeated rows stand together and all
    but one are duplicates; an empty table gives no rows. A conversation is streamed, never held.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, turn long, edit string, fault string, role string, text string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, found in _conversations(batches):
            for place, (turn, edit, k, _, role, text) in enumerate(found):
                yield conv, place, turn, edit, fault_of(k), role, text

    return _beside(turns).mapInArrow(_emitted(rows, schema), schema)


def summarise(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation that ``repair`` edits.

    ``gaps`` counts the turn numbers that are missing between the least and the largest; ``illegal`` turns
    next to each other whose roles' initials are not su, ua or au, before any edit; the hash is that of the repaired
    ``role:text``, joined by newlines, taken while the turns stream by. Odd rows count as in ``repair``.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, found in _conversations(batches):
            faults, audit, digest = Counter(), [], hashlib.sha256()
            least = most = before = None
            distinct = illegal = cost = 0
            joint = ""
            for turn, edit, k, initial, role, text in found:
                audit.append(edit)
                cost += {"K": KEEP, "D": DELETE, "I": INSERT, "R": RENAME}[edit]
                fault = fault_of(k)
                cost += BROKEN if fault == "truncated" and edit != "D" else 0
                if edit != "D":
                    digest.update(f"{joint}{role}:{text}".encode())
                    joint = "\n"
                if edit == "I":
                    continue
                faults[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if turn is not None and turn != most:
                    least, most, distinct = turn if least is None else least, turn, distinct + 1
            gaps = 0 if least is None else most - least + 1 - distinct
            yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()

    return _beside(turns).mapInArrow(_emitted(rows, schema), schema)
