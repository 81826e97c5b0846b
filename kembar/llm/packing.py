"""Best-fit packing: token sequences of fixed length by minimum bin slack."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kembar import runtime
from kembar.llm.words import per_batch

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids binary"
#: Encoded pieces of text that a task keeps at hand.
KEPT_PIECES = 300_000


class Encoder(dict):
    """Byte-pair ids of whole texts, as little-endian unsigned 32-bit numbers, from a file of ranks and its pattern.

    A text is cut before each space that follows a sign other than white space: no token crosses such a place, so the parts
    are encoded one by one and kept, as most come back. A text with a space after white space is encoded whole.
    """

    run_of_spaces = re.compile(r"\s ")

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.whole(" " + part)
        if len(self) < KEPT_PIECES:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.run_of_spaces.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def public_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level vocabulary of 50,257 ids, as installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_pieces(docs: DataFrame, vocabulary=public_vocabulary, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES of every document: its ids and a closing id 0, cut into pieces of `capacity`, the first of which is shorter.

    Null texts count as empty and give one piece of one id. Repeated rows give pieces each.
    """
    schema = PIECES.format(id=docs.schema[id_col].dataType.simpleString())
    kept: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not kept:
            kept.append(Encoder(*vocabulary()))
        texts, owners, rows = batch.column("text"), [], []
        for i in range(batch.num_rows):
            ids = kept[0].encode(texts[i].as_py() or "") + END_ID.to_bytes(4, "little")
            total = len(ids) // 4
            starts = [0, *range(total % capacity or capacity, total, capacity)]
            for piece, (start, end) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                owners.append(i)
                rows.append((piece, start, end - start, ids[4 * start:4 * end]))
        kinds = dict(piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids=pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return {"doc_id": batch.column("doc_id").take(pa.array(owners, pa.int64()))} | {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}

    return per_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and times of the fullest bin that holds the longest length there is.

    Bit s of a set says that s can be filled; lengths enter from the shortest up, each as often as it is there. Going back
    from the longest down, each is taken as often as what is left can still be filled, so that of equally full bins
    the one with the longest pieces is chosen and short ones stay for later.
    """
    longest = max(counts)
    room, sums, steps = capacity - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted(n for n in counts if n <= room):
        times = min(counts[n] - (n == longest), room // n)
        if times <= 0:
            continue
        steps.append((n, sums, times))
        part = 1
        while times > 0:
            used = min(part, times)
            sums |= (sums << (n * used)) & mask
            times, part = times - used, part * 2
    rest, found = sums.bit_length() - 1, {longest: 1}
    for n, before, times in reversed(steps):
        k = next(k for k in range(min(times, rest // n), -1, -1) if before >> (rest - k * n) & 1)
        if k:
            found[n] = found.get(n, 0) + k
        rest -= k * n
    return found


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Minimum bin slack over counts of lengths: rows (length, first rank, first sequence, times, offset).

    The fullest bin is found and removed as often as its lengths allow, then the next. A length's pieces of ranks from
    `first rank` on fill sequences from `first sequence` on, `times` in each, side by side from `offset`. As lengths are at
    most `capacity`, so is the number of counts, whatever the number of pieces.
    """
    left, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        found = fullest(left, capacity)
        repeat, offset = min(left[n] // k for n, k in found.items()), 0
        for n, k in found.items():
            rows.append((n, used[n], sequence, k, offset))
            used[n] += repeat * k
            left[n] -= repeat * k
            offset += n * k
            if not left[n]:
                del left[n]
        sequence += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` from 1 to `capacity`; every sequence is gapless from 0.

    Only counts of lengths, at most `capacity` of them, get to the driver. Ranks within a length are numbered per block of
    the written table and shifted by what earlier blocks hold, so a length that very many pieces share is many small
    windows. Repeated rows are packed each; ties in length go by place. No rows: no rows.
    """
    rows = runtime.written(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces").withColumn("__block", F.shiftright("__uid", 33))
    held = runtime.written(rows.groupBy("length", "__block").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = bin_plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = held.select("length", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("length", "__block").orderBy("__uid")) - 1
    ranked = rows.withColumn("__place", place).join(shifts, ["length", "__block"])
    ranked = ranked.withColumn("__rank", F.col("__place") + F.col("__before"))
    names = list(pieces.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    span = 1 << 48
    starts = plan[:, 0] * span + plan[:, 1]

    def run(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "__rank"))
        row = plan[np.searchsorted(starts, length * span + rank, side="right") - 1]
        behind = rank - row[:, 1]
        return {n: batch.column(n) for n in names} | {"sequence_id": row[:, 2] + behind // row[:, 3], "offset": row[:, 4] + behind % row[:, 3] * length}

    return per_batch(ranked.select(*names, "__rank"), run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed rows with ids: the finished sequences; a sequence has at most `capacity` pieces."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(joined, "")).alias("ids"))
