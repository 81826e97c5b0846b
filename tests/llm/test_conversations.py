"""Conversation repair: block tables against all edits tried out, the contract row by row, chunks, odd input."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kembar import runtime
from kembar.llm import conversations as c

LETTERS = "suax"


def rows_of(symbols):
    """Roles of rows, whether the text is cut off, whether the row must go."""
    return [(LETTERS[s % 4], 4 <= s < 8, s == 8) for s in symbols]


def plain_best(symbols):
    """Cheapest edits by dynamic programming over whole audits, least letters among equals. One letter at a time."""
    best = {(0, ""): (0, "")}  # (rows done, shape of the roles so far) -> (cost, audit)
    shape = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    rows = rows_of(symbols)
    done = {}
    layer = {"": (0, "")}
    for at in range(len(rows) + 1):
        changed = True
        while changed:  # inserts
            changed = False
            for state, (cost, audit) in list(layer.items()):
                for role in "ua":
                    to = shape.get((state, role))
                    if to and layer.get(to, (1e9, "~")) > (cost + 3, audit + "I"):
                        layer[to] = (cost + 3, audit + "I")
                        changed = True
        if at == len(rows):
            break
        role, cut, gone = rows[at]
        after = {}
        for state, (cost, audit) in layer.items():
            options = [(state, cost + 4, "D")]
            if not gone:
                extra = 3 if cut else 0
                if (state, role) in shape:
                    options.append((shape[state, role], cost + extra, "K"))
                options += [(shape[state, r], cost + 3 + extra, "R") for r in "ua" if (state, r) in shape]
            for to, price, letter in options:
                if after.get(to, (1e9, "~")) > (price, audit + letter):
                    after[to] = (price, audit + letter)
        layer = after
    del best, done
    return min(layer[s] for s in ("", "a") if s in layer)


def tried_out(symbols, most_inserts=3):
    """All audits up to a number of inserts; the roles they give must match the pattern."""
    found = []
    rows = rows_of(symbols)

    def go(at, roles, cost, audit, inserts):
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < most_inserts:
            for r in "ua":
                go(at, roles + r, cost + 3, audit + "I", inserts + 1)
        if at < len(rows):
            role, cut, gone = rows[at]
            go(at + 1, roles, cost + 4, audit + "D", inserts)
            if not gone:
                extra = 3 if cut else 0
                go(at + 1, roles + role, cost + extra, audit + "K", inserts)
                for r in "ua":
                    go(at + 1, roles + r, cost + 3 + extra, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(found)


def traced(symbols):
    symbols = bytes(symbols)
    between, offset = c.backward(symbols)
    return offset + c.tables()[0][between[0]][c.START], c.trace(symbols)[0]


def test_all_short_conversations():
    for n in range(4):
        for symbols in itertools.product(range(c.SYMBOLS), repeat=n):
            assert traced(symbols) == tried_out(symbols), symbols


def test_longer_conversations():
    rng = random.Random(3)
    for _ in range(3000):
        symbols = rng.choices(range(c.SYMBOLS), k=rng.randint(3, 30))
        assert traced(symbols) == plain_best(symbols), symbols


def test_tables_are_small():
    assert len(c.tables()[0]) < 60


def test_chunks_compose():
    rng = random.Random(4)
    width = 2 + c.STATES
    for _ in range(300):
        symbols = bytes(rng.choices(range(c.SYMBOLS), k=rng.randint(0, 40)))
        cut = sorted(rng.randint(0, len(symbols)) for _ in range(2))
        parts = [symbols[:cut[0]], symbols[cut[0]:cut[1]], symbols[cut[1]:]]
        vector, cost, vectors = 0, 0, []
        for part in reversed(parts):
            vectors.insert(0, vector)
            row = c.chunk_table(part)[vector * width:(vector + 1) * width]
            vector, cost = row[0], cost + row[1]
        state, audit = c.START, ""
        for at, part in enumerate(parts):
            row = c.chunk_table(part)[vectors[at] * width:(vectors[at] + 1) * width]
            letters, end = c.trace(part, vectors[at], state, at == 2)
            assert at == 2 or end == row[2 + state]
            audit, state = audit + letters, row[2 + state]
        assert (cost + c.tables()[0][vector][c.START], audit) == traced(symbols)


# ------------------------------------------------------------ the contract, row by row

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(original, rows):
    result = []
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in mine:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = "sua".find(role[:1]) if role[:1] else -1
            symbols.append(8 if fault in ("blank", "duplicate") else (kind if kind >= 0 else 3) + 4 * (fault == "truncated"))
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = plain_best(symbols)
        lines, state, at = [], "", 0
        for letter in audit:
            wanted = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[wanted]
            if letter == "I":
                lines.append(f"{name}:")
                state = wanted
                continue
            _, role, text = mine[at]
            at += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
            elif letter == "R":
                lines.append(f"{name}:{text}")
                state = wanted
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result.append((conv, gaps, *counts.values(), illegal, cost, audit, sha))
    return sorted(result, key=str)


def made_up():
    rng = random.Random(8)
    texts = ["Ja.", "ja", "", " \t\n", None, "Nein!  ", "Was? ", "ö.", "a\x85", "Ende.\n\x0b"]
    roles = ["system", "user", "assistant", "tool", "", None, "sys", "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            at = rng.choice([turn, turn, turn, turn * 3, None, -turn])
            rows.append((conv, at, rng.choice(roles[:3] * 4 + roles), rng.choice(texts * 2 + [f"Satz {turn}."])))
    rows += [(7, i // 2, ("user", "assistant")[i % 2], f"Satz {i}." if i % 5 else "gleich.") for i in range(400)]
    rows += [(8, None, "user", "gleich.")] * 50 + [(9, 5, "system", "viele")] * 30
    rows.append((99, 1, "user", "x" * 100_000 + "."))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_up()


@pytest.fixture(scope="module")
def frame(spark, rows):
    extra = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string, conv string, times int").repartition(5)


@pytest.mark.parametrize("sizes", [{}, {"symbols": 5}, {"chars": 30, "limit": 0}])
def test_contract(frame, rows, sizes):
    got = sorted((tuple(r) for r in c.repair_conversations(c.damage(frame), **sizes).collect()), key=str)
    assert got == plain(rows, damaged(rows))


def test_every_row_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "x.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in c.repair_conversations(c.damage(frame)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert c.repair_conversations(c.damage(frame)).count() == 0


def test_repaired_text(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 1), (1, 2, "user", "And?", 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, times bigint")
    assert [r.repaired for r in c.repaired_rows(frame).collect()] == ["user:Hi.\nassistant:Yes.\nuser:And?\nassistant:"]
    assert runtime.releases(spark) >= 0
