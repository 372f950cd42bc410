"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?, by a forward Viterbi pass.

A conversation's rows are read by turn (nulls first), then role and text; nulls in role or text are one space. Each row's first
fault counts: blank, duplicate of an earlier row's role and text, truncated. Edits: Keep (0), Rerole to user or assistant (3),
Delete (4, required for blank and duplicate rows), Insert an empty user or assistant turn (3); truncated rows that stay add 3. The
grammar's states are NOTHING, SYSTEM, USER and ASSISTANT; each carries the least (cost, audit string), the audit being the edits'
initials, and after every row a bounded number of inserts closes the layer.

How little has to be carried: behind a row, the states' audits differ in it or before it, or one is the other with inserts at its
end, so a rank for each audit and the number of its last inserts compare any two. Costs relative to the least, ranks and inserts
take few values, so a layer is a step of a finite automaton, made once for each (layer, kind of row). A conversation keeps a
number for each row, from which the audit is read backwards, and a running hash for each audit: never its texts.

Faults are found in the JVM with one shuffle by conversation; rows are then read in order, a batch at a time. A conversation is
read by one task, whatever its size, because its digest is a hash over all its repaired turns in order; memory does not grow with its
texts, only by four bytes a row and the audit.

Rows that are the same in all columns are copies: all but the first are duplicates. Null conversation ids are one conversation.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, ship

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: A row's kind: DROPPED stands for a row that only names its conversation, GONE for one that has to be deleted; otherwise 1 and
#: twice the place of its role's initial among s, u, a and others, and 1 more where it is truncated.
DROPPED, GONE = -1, 0
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Where an inserted turn leads, and its role.
NEXT = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
OUT = "conv_id long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: A layer: for each state the cost above the least, the audit's rank and its last inserts; None where nothing leads to it.
Layer = tuple[tuple[int, int, int] | None, ...]
#: Of a layer's audit: rank of the one that it goes on from, the edits added, and the state that it was in and comes to.
Step = tuple[int, str, int, int]


def closed(cores: dict[int, tuple[int, int]]) -> tuple[Layer, int]:
    """The layer behind the states' audits (cost, rank) with what inserts add, and the least cost."""
    best = {s: (c, r, 0) for s, (c, r) in cores.items()}
    for _ in range(3):  # no state is worth coming back to, so three inserts reach all
        for s, (c, r, k) in list(best.items()):
            to = NEXT[s][0]
            best[to] = min(best.get(to, (c + INSERT, r, k + 1)), (c + INSERT, r, k + 1))
    least = min(c for c, _, _ in best.values())
    return tuple((best[s][0] - least, *best[s][1:]) if s in best else None for s in range(4)), least


def kept_state(initial: int, s: int) -> int | None:
    """Where a row with that initial leads from state s, if it may follow."""
    if initial == 0:
        return SYSTEM if s == NOTHING else None
    if initial == 1:
        return USER if s != USER else None
    return ASSISTANT if initial == 2 and s == USER else None


class Automaton:
    """Layers and steps, made when they are first met."""

    def __init__(self) -> None:
        first, _ = closed({NOTHING: (0, 0)})
        self.layers: list[Layer] = [first]
        self.states: list[list[int]] = [[NOTHING]]  # of each layer's audits, by rank
        self.numbers = {(first, (NOTHING,)): 0}
        self.known: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.steps: list[list[Step]] = []

    def step(self, layer: int, kind: int) -> tuple[int, int, int]:
        """The next layer, how much the least cost rises, and the step's number."""
        found = self.known.get((layer, kind))
        if found is None:
            found = self.known[layer, kind] = self._made(layer, kind)
        return found

    def _made(self, layer: int, kind: int) -> tuple[int, int, int]:
        cut = CUT * ((kind - 1) % 2) if kind > 0 else 0
        best: dict[int, tuple[int, int, str]] = {}

        def offer(to: int, cost: int, rank: int, edits: str) -> None:
            best[to] = min(best.get(to, (cost, rank, edits)), (cost, rank, edits))

        for s, entry in enumerate(self.layers[layer]):
            if entry is None:
                continue
            cost, rank, inserts = entry
            before = "I" * inserts
            offer(s, cost + DELETE, rank, before + "D")
            if kind > 0:
                to = kept_state((kind - 1) // 2, s)
                if to is not None:
                    offer(to, cost + cut, rank, before + "K")
                offer(NEXT[s][0], cost + REROLE + cut, rank, before + "R")
        order = sorted(best, key=lambda s: best[s][1:])
        after, least = closed({s: (best[s][0], k) for k, s in enumerate(order)})
        key = (after, tuple(order))
        if key not in self.numbers:
            self.numbers[key] = len(self.layers)
            self.layers.append(after)
            self.states.append(order)
        self.steps.append([(best[s][1], best[s][2], self.states[layer][best[s][1]], s) for s in order])
        return self.numbers[key], least, len(self.steps) - 1

    def end(self, layer: int) -> tuple[int, int, int]:
        """The least (cost, rank, inserts) at a state where a conversation may end."""
        return min(e for e in (self.layers[layer][NOTHING], self.layers[layer][ASSISTANT]) if e is not None)


def inserted(state: int, n: int) -> tuple[list[str], int]:
    """The roles of n inserted turns after a state, and the state behind them."""
    roles = []
    for _ in range(n):
        state, role = NEXT[state]
        roles.append(role)
    return roles, state


class Conversation:
    """What is carried along one conversation."""

    def __init__(self, rules: Automaton, digest: Callable[[], object] = hashlib.sha256) -> None:
        self.rules, self.layer, self.cost, self.steps = rules, 0, 0, array("I")
        self.hashes = [digest()]
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, kind: int, fault: str | None, initial: int, role: str, text: str) -> None:
        self.rows += 1
        if fault is not None:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.initial is not None and (self.initial, initial) not in LEGAL
        self.initial = initial
        self.layer, rise, number = self.rules.step(self.layer, kind)
        self.cost += rise
        self.steps.append(number)
        hashes = []
        for rank, edits, state, to in self.rules.steps[number]:
            known = self.hashes[rank]
            if edits != "D":
                known = known.copy()
                roles, at = inserted(state, len(edits) - 1)
                lines = [f"{r}:" for r in roles]
                if edits[-1] != "D":
                    lines.append(f"{role if edits[-1] == 'K' else 'user' if to == USER else 'assistant'}:{text}")
                known.update((("\n" if state != NOTHING else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            hashes.append(known)
        self.hashes = hashes

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def result(self) -> tuple:
        """Of OUT, all but conv_id."""
        cost, rank, inserts = self.rules.end(self.layer)
        state = self.rules.states[self.layer][rank]
        roles, _ = inserted(state, inserts)
        digest = self.hashes[rank].copy()
        if roles:
            digest.update((("\n" if state != NOTHING else "") + "\n".join(f"{r}:" for r in roles)).encode())
        back = ["I" * inserts]
        for number in reversed(self.steps):
            rank, edits, _, _ = self.rules.steps[number][rank]
            back.append(edits)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, "".join(reversed(back)), digest.hexdigest()


def prepared(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """The rows by conversation and in order, with kind, fault and initial. `copies`: how often a row stands (1); 0 leaves only its
    conversation."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    rows = rows.withColumns({c: F.when(F.col("copies") > 0, F.col(c)) for c in ("turn", "role", "text")}).repartition("conv_id")
    same = Window.partitionBy("conv_id", F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text"))
    seen = F.row_number().over(same.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) > 1
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.right(F.rtrim("text", F.lit(SPACE_CHARS)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(F.col("copies") == 0, None).when(blank, "blank").when(seen, "duplicate").when(cut, "truncated")
    place = F.position(F.left("role", F.lit(1)), F.lit(INITIALS))  # where an empty role is found at 1
    initial = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(len(INITIALS)).cast("int")
    rows = rows.withColumn("fault", fault).withColumn("initial", initial)
    kind = F.when(F.col("copies") == 0, DROPPED).when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + 2 * F.col("initial") + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    rows = rows.withColumn("kind", kind.cast("int"))
    return rows.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault").isNull().desc(), F.col("fault").desc())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = Automaton()
    own, name, begun = None, None, False
    kinds = [pa.int64()] * 8 + [pa.string()] * 2
    names = [c.split()[0] for c in OUT.split(", ")]

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for base in range(0, len(batch), 4096):
            part = batch.slice(base, 4096).to_pydict()
            for conv, turn, role, text, copies, fault, initial, kind in zip(*part.values(), strict=True):
                if not begun or conv != name:
                    if begun:
                        done.append((name, *own.result()))
                    own, name, begun = Conversation(rules), conv, True
                if kind == DROPPED:
                    continue
                own.turn(turn)
                own.add(kind, fault, initial, role, text)
                for _ in range(copies - 1):
                    own.add(GONE, "blank" if fault == "blank" else "duplicate", initial, role, text)
        if done:
            yield told(done)
    if begun:
        yield told([(name, *own.result())])


def repairs(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """A row per conversation: its faults, and the cheapest edits with their cost and a digest of what they give."""
    ship(turns.sparkSession)
    return prepared(turns, copies).select("conv_id", "turn", "role", "text", "copies", "fault", "initial", "kind").mapInArrow(_read, OUT)


def repaired_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of every turn of the repaired conversations; deleted rows are left out."""
    ship(turns.sparkSession)
    rows = prepared(turns, copies).where("copies > 0").select("conv_id", "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    scripts = repairs(turns, copies).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state = None, "", 0, 0, NOTHING
        for batch in batches:
            done: list[tuple] = []

            def inserts() -> None:
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    state, role = NEXT[state]
                    done.append((conv, place, "Insert", role, ""))
                    at, place = at + 1, place + 1

            for row in batch.to_pylist():
                if row["audit"] is not None:
                    conv, audit, at, place, state = row["conv_id"], row["audit"], 0, 0, NOTHING
                    inserts()
                    continue
                for _ in range(row["copies"]):
                    edit, role = audit[at], row["role"]
                    at += 1
                    if edit == "R":
                        state, role = NEXT[state]
                    elif edit == "K":
                        state = kept_state(INITIALS.index(role[0]), state)
                    if edit != "D":
                        done.append((conv, place, "Keep" if edit == "K" else "Rerole", role, row["text"]))
                        place += 1
                    inserts()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["conv_id", "place", "edit", "role", "text"])

    both = scripts.union(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    return both.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with faults for a trial, by crc32 of conv_id:turn modulo 20, and how often each row stands."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(part == 1, "").when(part == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", F.when(part == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(part == 0, 0).when(part == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")


def report(turns: DataFrame) -> DataFrame:
    """The repairs of the damaged turns."""
    return repairs(*damaged(turns)).drop("rows")
