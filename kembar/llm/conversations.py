"""Structure repair of conversations by cheapest edits, with block tables in the manner of the Four Russians.

A conversation is a string of nine symbols (what a row's role starts with, whether its text is cut off, or that it must
go), and a repaired one is accepted by an automaton of four states. The cost to go from each state is a vector of four
numbers; less its smallest entry, only a few dozen vectors ever occur. For each of them and each block of BLOCK symbols the
vector before the block is looked up, so rows are processed by blocks, from the end. The edits are traced forward from the
start; a block that the trace enters is expanded backward into the vectors between its symbols, from which the least
letter among all cheapest ones is taken at each step.

The tables compose: a chunk of a conversation is one more table. So a conversation of any length is cut into chunks of
rows, which Spark deals out by ranges; only their tables meet per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.hot import join_groups

# Roles, costs and the characters that end a text.
REROLE, INSERT, DELETE, CUT_OFF = 3, 3, 4, 3
END_MARKS = ".!?"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
LEGAL = ("su", "ua", "au")
KINDS = "sua"

BLOCK = 3
#: A chunk ends after so many symbols or characters.
CHUNK_SYMBOLS = 1 << 16
CHUNK_CHARS = 4 << 20

# States: nothing yet, after s, after u, after a. The first and the last accept.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
#: The role that continues from a state by inserting or renaming; it is always one only.
NEXT_ROLE = ("u", "u", "a", "u")
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Symbols 0-3: role s, u, a, other; 4-7: the same with a text cut off; 8: must go.
SYMBOLS = 9
GONE = 8
TERMINAL = (0, 2 * INSERT, INSERT, 0)


def keeps_to(state: int, symbol: int) -> int | None:
    """The state after keeping a row as it is, if the automaton allows it."""
    kind = symbol % 4
    if symbol == GONE or kind == 3:
        return None
    if kind == 0:
        return AFTER_S if state == START else None
    return NEXT_STATE[state] if NEXT_ROLE[state] == KINDS[kind] else None


def before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Cost to go from each state before a row, given the costs after it. Inserts come before the row."""
    costs = []
    for state in range(STATES):
        options = [DELETE + after[state]]
        if symbol != GONE:
            extra = CUT_OFF if symbol >= 4 else 0
            options.append(REROLE + extra + after[NEXT_STATE[state]])
            kept = keeps_to(state, symbol)
            if kept is not None:
                options.append(extra + after[kept])
        costs.append(min(options))
    for _ in range(2):  # two inserts reach every state that inserts can reach
        costs = [min(costs[s], INSERT + costs[NEXT_STATE[s]]) for s in range(STATES)]
    return costs


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """All normalised vectors, and for blocks of 1 symbol: (vector after, symbol) -> vector before, offset, end state.

    Vector 0 is the one at the end of a conversation. The end state belongs to the cheapest, least edits from each state.
    """
    vectors, numbers, left, offset, end = [TERMINAL], {TERMINAL: 0}, [], [], []
    at = 0
    while at < len(vectors):
        after = vectors[at]
        for symbol in range(SYMBOLS):
            costs = before(symbol, after)
            low = min(costs)
            vector = tuple(c - low for c in costs)
            if vector not in numbers:
                numbers[vector] = len(vectors)
                vectors.append(vector)
            left.append(numbers[vector])
            offset.append(low)
            end.append([_step(state, symbol, tuple(costs), after)[1] for state in range(STATES)])
        at += 1
    n = len(vectors)
    return vectors, np.array(left).reshape(n, SYMBOLS), np.array(offset).reshape(n, SYMBOLS), np.array(end).reshape(n, SYMBOLS, STATES)


def _step(state: int, symbol: int, costs: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """Least letters among the cheapest edits up to and including a row, and the state after it."""
    letters = ""
    while True:
        if DELETE + after[state] == costs[state]:
            return letters + "D", state
        if INSERT + costs[NEXT_STATE[state]] == costs[state]:
            letters, state = letters + "I", NEXT_STATE[state]
            continue
        extra = CUT_OFF if symbol >= 4 else 0
        kept = keeps_to(state, symbol)
        if kept is not None and extra + after[kept] == costs[state]:
            return letters + "K", kept
        return letters + "R", NEXT_STATE[state]


@cache
def block_tables() -> tuple[list, list, list]:
    """(vector after, block) -> vector before, offset, and end state per start state, for blocks of BLOCK symbols.

    The number of a block has its first symbol in the highest place. Plain lists, since look-ups are one by one.
    """
    _, left1, offset1, end1 = tables()
    left, offset, end = left1, offset1, end1
    for _ in range(BLOCK - 1):
        many = left.shape[1]
        symbols = np.arange(SYMBOLS)
        # A longer block is one symbol more in front: (vector, symbol, block).
        mid = left[:, None, :]
        new_left = left1[mid, symbols[None, :, None]]
        new_offset = offset1[mid, symbols[None, :, None]] + offset[:, None, :]
        first = end1[mid, symbols[None, :, None]]
        rows, blocks = np.arange(len(left))[:, None, None, None], np.arange(many)[None, None, :, None]
        new_end = end[rows, blocks, first]
        left, offset = new_left.reshape(len(left), -1), new_offset.reshape(len(left), -1)
        end = new_end.reshape(len(left), SYMBOLS * many, STATES)
    return left.tolist(), offset.tolist(), end.tolist()


@cache
def _single() -> tuple[list, list, list]:
    _, left, offset, end = tables()
    return left.tolist(), offset.tolist(), end.tolist()


def _blocks(symbols: bytes) -> tuple[list[int], bytes]:
    """Numbers of the whole blocks, and the symbols that are left at the end."""
    whole = len(symbols) // BLOCK * BLOCK
    values = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, BLOCK).astype(np.int64)
    return (values @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist(), symbols[whole:]


def backward(symbols: bytes, vector: int = 0) -> tuple[list[int], int]:
    """Vectors before each block (then after the last), and the offset summed, from the vector after the symbols.

    The list runs over the whole blocks, then over the single symbols left at the end.
    """
    numbers, rest = _blocks(symbols)
    found, total = [vector], 0
    left, offset, _ = _single()
    for symbol in reversed(rest):
        total += offset[vector][symbol]
        vector = left[vector][symbol]
        found.append(vector)
    left, offset, _ = block_tables()
    for number in reversed(numbers):
        total += offset[vector][number]
        vector = left[vector][number]
        found.append(vector)
    return found[::-1], total


@cache
def expand(block: bytes, vector: int, state: int) -> tuple[str, int]:
    """Edits of a block and the state after it: vectors inside it backward, least cheapest letters forward."""
    left, _, _ = _single()
    vectors = tables()[0]
    after = [vector]
    for symbol in reversed(block):
        after.append(left[after[-1]][symbol])
    after.reverse()
    edits = []
    for at, symbol in enumerate(block):
        right = vectors[after[at + 1]]
        letters, state = _step(state, symbol, tuple(before(symbol, right)), right)
        edits.append(letters)
    return "".join(edits), state


def trace(symbols: bytes, vector: int = 0, state: int = START, last: bool = True) -> tuple[str, int]:
    """Least of the cheapest edits of the symbols as letters, and the state after them.

    `vector` holds the costs after the symbols; with `last`, inserts that close a conversation follow.
    """
    between, _ = backward(symbols, vector)
    edits, at, place = [], 0, 1
    whole = len(symbols) // BLOCK * BLOCK
    while at < len(symbols):
        size = BLOCK if at < whole else 1
        letters, state = expand(symbols[at:at + size], between[place], state)
        edits.append(letters)
        at, place = at + size, place + 1
    if last:
        while TERMINAL[state]:
            edits.append("I")
            state = NEXT_STATE[state]
    return "".join(edits), state


def chunk_table(symbols: bytes) -> list[int]:
    """The table of a chunk as one list: per vector after it, the vector before, the offset and four end states."""
    flat = []
    numbers, rest = _blocks(symbols)
    one_left, one_offset, one_end = _single()
    left, offset, end = block_tables()
    for start in range(len(tables()[0])):
        vector, total, states = start, 0, list(range(STATES))
        for symbol in reversed(rest):
            states = [states[s] for s in one_end[vector][symbol]]
            total += one_offset[vector][symbol]
            vector = one_left[vector][symbol]
        for number in reversed(numbers):
            states = [states[s] for s in end[vector][number]]
            total += offset[vector][number]
            vector = left[vector][number]
        flat += [vector, total, *states]
    return flat


def edited_lines(roles: list[str], texts: list[str], edits: str, state: int) -> tuple[list[str], int]:
    """role:text of what the edits make of the rows, from a state on; inserted rows have no text."""
    names = {"u": "user", "a": "assistant"}
    lines, row = [], 0
    for letter in edits:
        if letter == "I":
            lines.append(names[NEXT_ROLE[state]] + ":")
            state = NEXT_STATE[state]
            continue
        if letter == "K":
            lines.append(f"{roles[row]}:{texts[row]}")
            state = AFTER_S if roles[row].startswith("s") else NEXT_STATE[state]
        elif letter == "R":
            lines.append(f"{names[NEXT_ROLE[state]]}:{texts[row]}")
            state = NEXT_STATE[state]
        row += 1
    return lines, state


def damage(rows: DataFrame) -> DataFrame:
    """Damaged (conv_id, turn, role, text, times) of conversation rows, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (times 0), 1 empties its text, 2 removes its `.!?`, 3 repeats it (times 2), 4 makes its role user. A
    null id or turn counts as one blank in the key; a null role or text is one blank.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20)).cast("int")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", END_MARKS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("times"),
    )


_CHUNK = (
    "conv_id bigint, part int, seq int, symbols binary, roles array<string>, texts array<string>, first_turn bigint, "
    "last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, "
    "last_role string"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Chunk:
    """Rows of a conversation in order, until the chunk is full."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None, symbol: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last_role = initial
        if fault:
            self.counts[fault] += 1
        gone = symbol == GONE
        self.symbols.append(symbol)
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.chars += 1 if gone else len(text) + len(role)

    def full(self, symbols: int, chars: int) -> bool:
        return len(self.symbols) >= symbols or self.chars >= chars


def _symbol(role: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return GONE
    return (KINDS.index(role[0]) if role[:1] and role[0] in KINDS else 3) + (4 if fault == "truncated" else 0)


def _cut(symbols: int, chars: int):
    """Consecutive rows of a conversation as chunks, in one pass over ordered rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, chunk, done = TaskContext.get().partitionId(), 0, None, []

        def packed() -> pa.RecordBatch:
            columns = [
                pa.array([c.conv for c, _ in done], pa.int64()), pa.array([part] * len(done), pa.int32()),
                pa.array([s for _, s in done], pa.int32()), pa.array([bytes(c.symbols) for c, _ in done], pa.binary()),
                pa.array([c.roles for c, _ in done], pa.list_(pa.string())), pa.array([c.texts for c, _ in done], pa.list_(pa.string())),
                *(pa.array([getattr(c, n) for c, _ in done], pa.int64()) for n in ("first_turn", "last_turn", "turns")),
                *(pa.array([c.counts[n] for c, _ in done], pa.int64()) for n in _COUNTS),
                *(pa.array([getattr(c, n) for c, _ in done], pa.string()) for n in ("first_role", "last_role")),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _CHUNK.split(", ")])

        for batch in batches:
            for conv, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk is None or chunk.conv != conv:
                    if chunk is not None:
                        done.append((chunk, seq))
                    chunk, seq = _Chunk(conv), 0
                for copy in range(times):
                    if chunk.full(symbols, chars):
                        done.append((chunk, seq))
                        chunk, seq = _Chunk(conv), seq + 1
                        if sum(c.chars + len(c.symbols) for c, _ in done) >= chars:
                            yield packed()
                            done.clear()
                    again = fault if copy == 0 or fault == "blank" else "duplicate"
                    chunk.add(turn, role, text, again, _symbol(role, again))
            if len(done) >= 1000 or sum(c.chars for c, _ in done) >= chars:
                yield packed()
                done.clear()
        if chunk is not None:
            done.append((chunk, seq))
        if done:
            yield packed()

    return run


def conversation_chunks(
    rows: DataFrame, symbols: int = CHUNK_SYMBOLS, chars: int = CHUNK_CHARS, limit: int = runtime.BROADCAST_BYTES
) -> DataFrame:
    """Written chunks of conversations, whose rows (conv_id, turn, role, text, times) are in order of turn.

    Equal rows are counted first. Whether role and text stood earlier is known from the least turn of each role and text
    in a conversation. Then rows are dealt out by ranges of conversation and turn, so that one conversation may lie in many
    tasks; ties of a turn are in order of role and text.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    blank = ~F.col("text").rlike(NOT_BLANK)
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    open_end = ~F.col("text").rlike(f"[{END_MARKS}][\\x20\\x09-\\x0D]*\\z")
    rows = runtime.written(
        rows.withColumns({"blank": blank, "digest": digest, "open_end": open_end}).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))),
        "conversation-rows",
    )
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    seen = rows.where((F.col("times") > 0) & ~F.col("blank")).groupBy("conv", "digest").agg(
        F.min(turn).alias("first"), F.count("*").alias("__n")
    ).where(F.col("__n") > 1).select("conv", "digest", "__n", F.col("first.known").alias("first_known"), F.col("first.at").alias("first_at"))
    seen = runtime.written(seen, "conversation-repeats")
    joined = join_groups(rows, seen, ["conv", "digest"], "__n", ["turn"], limit)
    later = F.col("first_known").isNotNull() & (turn != F.struct(F.col("first_known").alias("known"), F.col("first_at").alias("at")))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("open_end"), "truncated")
    # Range bounds travel to the driver, so long roles and texts take part in them with a short beginning only.
    ranges = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    ordered = joined.select("conv_id", "turn", "role", "text", "times", fault.alias("fault")).repartitionByRange(*ranges)
    ordered = ordered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return runtime.written(ordered.mapInArrow(_cut(symbols, chars), _CHUNK), "conversation-chunks")


_PLAN = (
    "conv_id bigint, part int, seq int, vector int, state int, last boolean, gaps bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, cost bigint"
)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _plan_conversation(chunks: pa.Table) -> pa.Table:
    """Where each chunk of one conversation starts and ends, from the tables of its chunks, and the sums over them."""
    rows = sorted(chunks.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    vector, cost = 0, 0
    for row in reversed(rows):
        row["vector"] = vector
        width = 2 + STATES
        row["table"] = row.pop("chunk_table")[vector * width:(vector + 1) * width]
        cost += row["table"][1]
        vector = row["table"][0]
    cost += tables()[0][vector][START]
    state, low, high, last_role = START, None, None, None
    turns, illegal = 0, sum(r["illegal"] for r in rows)
    for row in rows:
        row["state"] = state
        state = row["table"][2 + state]
        if row["first_turn"] is not None:
            turns += row["turns"] - (high == row["first_turn"])
            low = row["first_turn"] if low is None else low
            high = row["last_turn"]
        if row["first_role"] is not None:
            illegal += last_role is not None and last_role + row["first_role"] not in LEGAL
            last_role = row["last_role"]
    sums = {"gaps": _gaps(low, high, turns), "illegal": illegal, "cost": cost}
    sums |= {name: sum(r[name] for r in rows) for name in ("blank", "duplicate", "truncated")}
    names = [f.split()[0] for f in _PLAN.split(", ")]
    types = {"part": pa.int32(), "seq": pa.int32(), "vector": pa.int32(), "state": pa.int32(), "last": pa.bool_()}
    for at, row in enumerate(rows):
        row |= sums | {"last": at == len(rows) - 1}
    return pa.Table.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names)


_PIECE = (
    "conv_id bigint, part int, seq int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired binary, repaired_sha256 string"
)
_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _repair(keep_text: bool):
    """Edits and repaired lines of each chunk; a conversation in one chunk gets its digest here."""
    names = [f.split()[0] for f in _PIECE.split(", ")]
    types = {"conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int32(), "audit": pa.string(), "repaired": pa.binary(), "repaired_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in names}
            for row in batch.to_pylist():
                whole = row["vector"] is None
                vector, state, last = (0, START, True) if whole else (row["vector"], row["state"], row["last"])
                symbols = row["symbols"]
                edits, _ = trace(symbols, vector, state, last)
                lines, _ = edited_lines(row["roles"], row["texts"], edits, state)
                repaired = "\n".join(lines).encode("utf-8", "surrogatepass")
                if whole:
                    between, cost = backward(symbols)
                    row["gaps"] = _gaps(row["first_turn"], row["last_turn"], row["turns"])
                    row["cost"] = cost + tables()[0][between[0]][START]
                row["audit"], row["repaired_sha256"] = edits, hashlib.sha256(repaired).hexdigest() if whole else None
                row["repaired"] = (repaired if lines else None) if keep_text or not whole else None
                for name in names:
                    out[name].append(row[name])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in names], names)

    return run


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations from their pieces in order: audits appended, digests carried from piece to piece."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    current, digest, audit, empty, out = None, None, [], True, []

    def finished() -> dict:
        return current | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    def packed(rows: list[dict]) -> pa.RecordBatch:
        types = {"audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names)

    for batch in batches:
        for row in batch.to_pylist():
            if current is None or current["conv_id"] != row["conv_id"]:
                if current is not None:
                    out.append(finished())
                current, digest, audit, empty = row, hashlib.sha256(), [], True
            if row["repaired"] is not None:
                if not empty:
                    digest.update(b"\n")
                digest.update(row["repaired"])
                empty = False
            audit.append(row["audit"])
        if len(out) >= 1000:
            yield packed(out)
            out.clear()
    if current is not None:
        out.append(finished())
    if out:
        yield packed(out)


def repaired_pieces(chunks: DataFrame, keep_text: bool = True, limit: int = runtime.BROADCAST_BYTES) -> DataFrame:
    """Edits and repaired text of every chunk; what the edits cost over the whole conversation is in every row of it."""
    on = ["conv_id", "part", "seq"]
    light = chunks.select(*[c for c in chunks.columns if c not in ("roles", "texts")])
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    long = runtime.written(light.groupBy(key.alias("conv")).agg(F.count("*").alias("n")).where(F.col("n") > 1).select("conv"), "long-conversations")
    wide = light.withColumn("conv", key)
    small = runtime.fits_broadcast(long, limit)
    cut = wide.join(F.broadcast(long) if small else long, "conv", "left_semi")
    fields = [f for f in cut.schema.fields if f.name != "symbols"]

    def tabled(batches):
        for batch in batches:
            made = pa.array([chunk_table(s) for s in batch.column("symbols").to_pylist()], pa.list_(pa.int64()))
            kept = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made], [*kept, "chunk_table"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", chunk_table array<bigint>"
    plan = cut.mapInArrow(tabled, schema).groupBy("conv").applyInArrow(_plan_conversation, _PLAN)
    plan = runtime.written(plan, "conversation-plan")
    plan = plan.select(*(F.col(c).alias(f"p_{c}") for c in plan.columns))
    same = F.col("conv_id").eqNullSafe(F.col("p_conv_id")) & (F.col("part") == F.col("p_part")) & (F.col("seq") == F.col("p_seq"))
    chosen = chunks.join(F.broadcast(plan) if runtime.fits_broadcast(plan, limit) else plan, same, "left").select(
        *(c for c in chunks.columns if c not in _COUNTS), *(F.col(f"p_{c}").alias(c) for c in ("vector", "state", "last", "gaps", "cost")),
        *(F.coalesce(f"p_{c}", c).alias(c) for c in _COUNTS),
    )
    return chosen.mapInArrow(_repair(keep_text), _PIECE)


def repair_conversations(
    rows: DataFrame, symbols: int = CHUNK_SYMBOLS, chars: int = CHUNK_CHARS, limit: int = runtime.BROADCAST_BYTES
) -> DataFrame:
    """One row per conv_id: faults, cost and letters of the cheapest edits, and a digest of the repaired conversation.

    `rows` has conv_id, turn (integers), role, text and times (0: the row is no longer there). A null conv_id is a
    conversation of its own; null roles and texts must have been replaced. Rows of one turn are in order of role and text;
    null turns come first. A conversation without rows has zeros, no edits and the digest of an empty text. The audit of a
    conversation is one string, and its digest is taken in order over its pieces, which pass through memory one by one.
    """
    chunks = conversation_chunks(rows, symbols, chars, limit)
    pieces = runtime.written(repaired_pieces(chunks, keep_text=False, limit=limit), "conversation-pieces")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    whole = pieces.where(F.col("repaired_sha256").isNotNull()).select(*names)
    cut = pieces.where(F.col("repaired_sha256").isNull())
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_join_pieces, _RESULT)
    return whole.unionByName(cut)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, part, seq, repaired): the repaired lines of every chunk, in UTF-8; chunks are ordered by part and seq."""
    return repaired_pieces(conversation_chunks(rows)).select("conv_id", "part", "seq", F.col("repaired").cast("string").alias("repaired"))
