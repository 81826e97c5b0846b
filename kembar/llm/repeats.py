"""Suffix-array dedup: bytes of long passages that also start in an earlier document, by run-length indexes of fragments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.words import per_batch

WINDOW, SEED = 50, 18
#: Seeds in a window, and the bytes beside a seed of which two equal windows share those of one side at least.
SEEDS, SIDE = WINDOW - SEED + 1, (WINDOW - SEED) // 2
MULT, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * MULT
    return x ^ (x >> np.uint64(32))


def substring_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, 64-bit hashes of the bytes from every place on, by doubling."""
    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x * MULT
        out += y
        out ^= out >> np.uint64(31)
        out *= ODD
        return out

    levels, size = [data.astype(np.uint64) * MULT], 1
    while 2 * size <= max(lengths):
        x = levels[-1]
        levels.append(paired(x[:-size], x[size:]) if len(x) > size else x[:0])
        size *= 2
    out = []
    for length in lengths:
        parts = [k for k in range(len(levels) - 1, -1, -1) if length >> k & 1]
        places, done = max(0, len(data) - length + 1), 1 << parts[0]
        total = levels[parts[0]][:places]
        for k in parts[1:]:
            total = paired(total, levels[k][done:done + places])
            done += 1 << k
        out.append(mixed(total))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def fragment_key(seed: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mixed(seed * MULT + content)


@dataclass
class Fragments:
    """Runs of windows of one text that have their least seed at one place: first window, number of windows, hash of the seed,
    hash of the content, and hashes of the sides of the seed, 0 where the text is too short for one."""

    start: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    content: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def cut_seed(self, buckets: int) -> np.ndarray:
        """Seed hashes as they are known in their bucket: 32 bits besides its number."""
        whole = np.uint64(buckets)
        return (self.seed // whole & np.uint64(0xFFFFFFFF)) * whole + self.seed % whole

    def part(self, first: int, last: int) -> Fragments:
        return Fragments(*(x[first:last] for x in (self.start, self.count, self.seed, self.content, self.left, self.right)))

    def key(self, buckets: int) -> np.ndarray:
        return fragment_key(self.cut_seed(buckets), self.content >> np.uint64(16))


#: Bytes of texts that are cut into fragments together; a longer text is alone.
TOGETHER = 1 << 15


def fragments_of(texts: Iterator[bytes], hot: np.ndarray | None = None) -> Iterator[tuple[list[bytes], np.ndarray, Fragments]]:
    """Fragments of texts, some texts at a time: (texts, number of its text for each fragment, fragments)."""
    held, size = [], 0
    for data in texts:
        if held and size + len(data) > TOGETHER:
            yield held, *_cut(held, hot)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held, *_cut(held, hot)


def fragments(data: bytes, hot: np.ndarray | None = None) -> Fragments | None:
    """Fragments of one text, or None if it is shorter than a window."""
    return _cut([data], hot)[1] if len(data) >= WINDOW else None


def _cut(texts: list[bytes], hot: np.ndarray | None) -> tuple[np.ndarray, Fragments]:
    """Where a window stands in a text, its least seed is the same, so equal windows are in fragments of equal seeds. Fragments
    of a hot seed are cut into single windows, which go by their own hash instead."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    seeds, sides, windows = substring_hashes(raw, (SEED, SIDE, WINDOW))
    places = [np.empty(0, np.int64)]
    for first in range(0, len(windows), CHUNK):
        part = seeds[first:first + CHUNK + SEEDS - 1]
        coded = (part & ~np.uint64(0xFFFFF)) | np.arange(len(part), dtype=np.uint64)
        places.append((sliding_least(coded, SEEDS) & np.uint64(0xFFFFF)).astype(np.int64) + first)
    place = np.concatenate(places)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(place)]
    inside = np.arange(len(place)) + WINDOW <= ends[owner] if len(place) else np.empty(0, bool)
    change = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])] if len(place) else inside
    start = np.flatnonzero(change)
    count = np.diff(np.r_[start, len(place)])
    start, count = start[inside[start]], count[inside[start]]
    text, at = owner[start], place[start]
    seed = seeds[at]
    content = mixed(windows[start] * MULT + windows[start + count - 1] * ODD + count.astype(np.uint64))
    begin, end = (ends - sizes)[text], ends[text]
    left = np.where(at - begin >= SIDE, sides[np.maximum(at - SIDE, 0)] | np.uint64(1), np.uint64(0)) if len(at) else seed
    right = np.where(at + SEED + SIDE <= end, sides[np.minimum(at + SEED, len(sides) - 1)] | np.uint64(1), np.uint64(0)) if len(at) else seed
    if hot is not None and len(hot) and len(seed):
        is_hot = hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed
        if is_hot.any():
            single = np.concatenate([np.arange(s, s + n) for s, n in zip(start[is_hot], count[is_hot], strict=True)])
            zero, one = np.zeros(len(single), np.uint64), np.ones(len(single), np.int64)
            cold = ~is_hot
            text = np.r_[text[cold], owner[single]]
            start, count, seed, content, left, right = (np.r_[a[cold], b] for a, b in (
                (start, single), (count, one), (seed, windows[single]), (content, windows[single]), (left, zero), (right, zero)))
            order = np.argsort(text, kind="stable")
            text, start, count, seed, content, left, right = (x[order] for x in (text, start, count, seed, content, left, right))
    return text, Fragments(start - (ends - sizes)[text], count, seed, content, left, right)


# ---------------------------------------------------------------- run-length index

class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of byte strings, with owners sampled by run.

    Suffixes are ordered by their first WINDOW bytes; that is all that a search of that depth looks at. Of the transform
    only the runs stay, cut at RUN rows: where they start, their byte, how often it stood before, and the least owner in
    the run. Owners are sampled per row at both ends of an interval only, so an interval costs its runs, not its rows.
    """

    RUN = 64

    def __init__(self, strings: list[bytes], owners: np.ndarray):
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        lengths = np.array([len(s) + 1 for s in strings], np.int64)
        owner = np.repeat(owners, lengths)
        order = self._order(text)
        last = text[order - 1]
        begins = np.flatnonzero(np.r_[True, last[1:] != last[:-1]] | (np.arange(len(text)) % self.RUN == 0))
        self.size, self.begins = len(text), begins
        self.least = np.minimum.reduceat(owner[order], begins)
        self.rows = owner[order]
        letter, size = last[begins].astype(np.int64), np.diff(np.r_[begins, len(text)])
        by_letter = np.lexsort((begins, letter))
        self.run_key = letter[by_letter] * self.size + begins[by_letter]
        self.run_size = size[by_letter]
        total = np.cumsum(self.run_size) - self.run_size
        first_of_letter = np.searchsorted(letter[by_letter], np.arange(257))
        self.run_before = total - np.r_[total, 0][first_of_letter][letter[by_letter]] if len(total) else total
        self.run_letter = letter[by_letter]
        self.smaller = np.searchsorted(np.sort(text), np.arange(257))

    @staticmethod
    def _order(text: np.ndarray) -> np.ndarray:
        # Eight bytes are one number to begin with; from there on, doubling.
        padded, key = np.r_[text, np.zeros(8, np.uint8)], np.zeros(len(text), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[k:k + len(text)]
        order = np.argsort(key, kind="stable")
        rank, span = np.empty(len(text), np.int64), 8
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        while span < WINDOW:
            step = min(span, WINDOW - span)
            behind = np.r_[rank[step:] + 1, np.zeros(step, np.int64)]
            key = rank * (int(behind.max()) + 1) + behind
            order = np.argsort(key, kind="stable")
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            span += step
        return np.argsort(rank, kind="stable")

    def before(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each letter stands in the transform above a row."""
        at = np.searchsorted(self.run_key, letter * self.size + row, side="left") - 1
        safe = np.maximum(at, 0)
        inside = np.minimum(row - (self.run_key[safe] - self.run_letter[safe] * self.size), self.run_size[safe])
        return np.where((at >= 0) & (self.run_letter[safe] == letter), self.run_before[safe] + inside, 0)

    def least_owners(self, patterns: np.ndarray) -> np.ndarray:
        """For each row of bytes, the least owner of a string that holds them, by backward search.

        All patterns go one byte to the left at a time. A match that one row is left of cannot shrink further for a
        pattern that is in the index, so it is settled there. Patterns of like ends go side by side, since they need the
        same parts of the index.
        """
        end = np.zeros(len(patterns), np.uint64)
        for k in range(min(8, patterns.shape[1])):
            end = end << np.uint64(8) | patterns[:, -1 - k]
        order = np.argsort(end)
        patterns = patterns[order]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            letter = patterns[live, k].astype(np.int64)
            low[live] = self.smaller[letter] + self.before(letter, low[live])
            high[live] = self.smaller[letter] + self.before(letter, high[live])
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
        out = np.empty(len(patterns), self.rows.dtype)
        out[order] = self._least_between(low, np.maximum(high, low + 1))
        return out

    def _least_between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.begins, low, side="right") - 1, np.searchsorted(self.begins, high - 1, side="right") - 1
        tables, span = [self.least], 1
        while 2 * span <= len(self.least):
            x = tables[-1]
            tables.append(np.minimum(x[:-span], x[span:]))
            span *= 2
        out = np.minimum(self.rows[low], self.rows[high - 1])
        whole = last - first - 1
        for level, table in enumerate(tables):
            use = np.flatnonzero((whole >= 1 << level) & (whole < 2 << level))
            if len(use):
                a, b = first[use] + 1, last[use] - (1 << level)
                out[use] = np.minimum(out[use], np.minimum(table[a], table[b]))
        # Parts of runs at either end: at most RUN rows, compared directly.
        for row, until in ((low, np.minimum(high, np.r_[self.begins[1:], self.size][first])), (np.maximum(low, self.begins[last]), high)):
            while len(use := np.flatnonzero(row < until)):
                out[use] = np.minimum(out[use], self.rows[row[use]])
                row = row.copy()
                row[use] += 1
        return out


# ---------------------------------------------------------------- passes over the texts

def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, body): ids as numbers, null ids before all others, and UTF-8 bytes, compressed for the shuffles ahead."""
    def run(batch: pa.RecordBatch) -> dict:
        press, column = zstandard.ZstdCompressor(level=1), batch.column("text")
        return {"doc": batch.column("doc"), "body": pa.array([press.compress((column[i].as_py() or "").encode("utf-8", "surrogatepass")) for i in range(batch.num_rows)], pa.binary())}

    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    return per_batch(rows, run, "doc bigint, body binary")


def body_bytes(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _bodies(column: pa.Array) -> Iterator[bytes]:
    for i in range(len(column)):
        yield (column[i].as_py() or "").encode("utf-8", "surrogatepass")


BUCKETED = "bucket int, docs binary, at binary, seed binary, content binary, left binary, right binary, done_at binary, done_key binary"


def _six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _two_bytes(side: np.ndarray) -> bytes:
    """16 bits of a side, 0 for none only."""
    return np.where(side > 0, side >> np.uint64(48) | np.uint64(1), 0).astype(np.uint16).tobytes()


def bucket_rows(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Fragments of all texts, a row per batch and bucket of seeds, in numpy buffers.

    Of equal fragments in a batch, that of the least document goes on; for the others it is settled here that they are
    repeats (done_at, done_key), so a hot fragment has one entry per batch.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, column, found, owner = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text"), [], []
            done = 0
            for texts, text, f in fragments_of(_bodies(column), sent.value):
                found.append((f.seed, f.content, f.key(buckets), f.left, f.right))
                owner.append(text + done)
                done += len(texts)
            if not found:
                continue
            seed, content, key, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
            owner = np.concatenate(owner)
            places, back = np.unique(ids, return_inverse=True)
            owner = back[owner]
            order = np.lexsort((owner, key))
            owner, key = owner[order], key[order]
            head = np.r_[True, key[1:] != key[:-1]]
            least = owner[head][np.cumsum(head) - 1]
            fresh = head | np.r_[False, owner[1:] != owner[:-1]]
            done = fresh & (owner != least)
            done_at, done_key = owner[done], key[done]
            keep = order[head]
            owner, seed, content, left, right = owner[head], seed[keep], content[keep], left[keep], right[keep]
            bucket, done_bucket = (seed % np.uint64(buckets)).astype(np.int64), (done_key % np.uint64(buckets)).astype(np.int64)
            order, done_order = np.lexsort((owner, bucket)), np.argsort(done_bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            done_cuts = np.searchsorted(done_bucket[done_order], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                own, mine = order[cuts[k]:cuts[k + 1]], done_order[done_cuts[k]:done_cuts[k + 1]]
                if not len(own) and not len(mine):
                    continue
                used, where = np.unique(np.r_[owner[own], done_at[mine]], return_inverse=True)
                rest = seed[own] // np.uint64(buckets)
                out.append((k, places[used].tobytes(), where[:len(own)].astype(np.uint32).tobytes(), (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                            _six_bytes(content[own]), _two_bytes(left[own]), _two_bytes(right[own]),
                            where[len(own):].astype(np.uint32).tobytes(), done_key[mine].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32())] + [pa.array([r[c] for r in out], pa.binary()) for c in range(1, 9)],
                                             BUCKETED.replace(" int", "").replace(" binary", "").split(", "))

    return docs.mapInArrow(run, BUCKETED)


def settle_bucket(buckets: int):
    """Of one bucket's fragments: documents and keys of those that are repeats, and of those to be compared by windows, for
    each group of documents."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs, seeds, contents, lefts, rights, done_docs, done_keys = [], [], [], [], [], [], []
        for r in rows.itertuples():
            ids = np.frombuffer(r.docs, np.int64)
            docs.append(ids[np.frombuffer(r.at, np.uint32)])
            seeds.append(np.frombuffer(r.seed, np.uint32))
            contents.append(_from_six(r.content))
            lefts.append(np.frombuffer(r.left, np.uint16))
            rights.append(np.frombuffer(r.right, np.uint16))
            done_docs.append(ids[np.frombuffer(r.done_at, np.uint32)])
            done_keys.append(np.frombuffer(r.done_key, np.uint64))
        bucket = int(rows["bucket"].iloc[0])
        doc, rest, content, left, right = (np.concatenate(x) for x in (docs, seeds, contents, lefts, rights))
        del docs, seeds, contents, lefts, rights
        order = np.lexsort((doc, content, rest))
        doc, rest, content, left, right = doc[order], rest[order], content[order], left[order], right[order]
        new_seed = np.r_[True, rest[1:] != rest[:-1]] if len(rest) else np.empty(0, bool)
        head = new_seed | np.r_[True, content[1:] != content[:-1]] if len(rest) else new_seed
        first = doc == doc[head][np.cumsum(head) - 1] if len(rest) else new_seed
        key = fragment_key(rest.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), content)
        gone = (doc[~first], key[~first])
        doc, rest, key, left, right = doc[first], rest[first], key[first], left[first], right[first]
        asked = np.zeros(len(doc), bool)
        for side in (left, right):
            order = np.lexsort((doc, side, rest))
            r, s, d = rest[order], side[order], doc[order]
            if len(r):
                head = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])]
                starts = np.flatnonzero(head)
                least, most = d[starts], d[np.r_[starts[1:], len(d)] - 1]
                asked[order] |= ((least != most) & (s[starts] > 0))[np.cumsum(head) - 1]
        out = []
        for ids, keys, asks in ((np.concatenate([gone[0], *done_docs]), np.concatenate([gone[1], *done_keys]), False), (doc[asked], key[asked], True)):
            group = (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(buckets + 1))
            out += [(g, asks, ids[order[a:b]].tobytes(), keys[order[a:b]].tobytes()) for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pd.DataFrame(out, columns=["g", "asks", "docs", "keys"])

    return run


def per_document(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc, gone, asked): the keys of each document of one group, as buffers."""
    out = []
    for asks, name in ((False, "gone"), (True, "asked")):
        own = rows[rows["asks"] == asks]
        ids, keys = np.frombuffer(b"".join(own["docs"]), np.int64), np.frombuffer(b"".join(own["keys"]), np.uint64)
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        out.append(pd.DataFrame({"doc": ids[cuts], name: [keys[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(ids)], strict=False)]}))
    return out[0].merge(out[1], on="doc", how="outer").reindex(columns=["doc", "gone", "asked"]).astype({"doc": "int64"})


def hot_seeds(docs: DataFrame, sample: int = 32, share: int = 1000, least: int = 12) -> np.ndarray:
    """Seeds with different fragments in at least one of `share` documents (and `least`), counted on one in `sample`.

    Which seeds are hot changes how windows meet, never a result. There are at most `share` times as many as a text has
    fragments on average, so they may go to all tasks.
    """
    def run(batch: pa.RecordBatch) -> dict:
        found = [(f.seed, f.content) for _, _, f in fragments_of(_bodies(batch.column("text")))]
        seed, content = (np.concatenate(c).view(np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return {"seed": seed, "content": content}

    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    rows = chosen.count()
    seeds = per_batch(chosen.select("text"), run, "seed bigint, content bigint").distinct().groupBy("seed").agg(F.count("*").alias("n"))
    found = seeds.where(F.col("n") >= max(least, rows // share)).select("seed").toPandas()["seed"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def windows_of(text: bytes) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), WINDOW)


def compare_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Of fragments (doc, key, body) that may share windows: per document and key, a bit for each window that an earlier
    document holds.

    A window whose hash stands in one document only is in no other. The fragments with other windows make a run-length
    index, in which these windows are searched: one of each hash, and those that differ from it byte by byte.
    """
    rows = rows.drop_duplicates(["doc", "key"]).sort_values("doc")
    docs, texts = rows["doc"].to_numpy(np.int64), rows["body"].tolist()
    counts = np.array([len(b) - WINDOW + 1 for b in texts], np.int64)
    ends = np.cumsum([len(b) for b in texts])
    starts = np.repeat(ends - [len(b) for b in texts], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    hashes = substring_hashes(whole, (WINDOW,))[0][starts]
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    of_doc = docs[owner[order]]
    least, most = np.minimum.reduceat(of_doc, heads), np.maximum.reduceat(of_doc, heads)
    many = np.empty(len(hashes), bool)
    many[order] = np.repeat(least != most, np.diff(np.r_[heads, len(hashes)]))
    del of_doc
    earlier = np.zeros(len(hashes), bool)
    if many.any():
        held = np.unique(owner[many])
        index = RunLengthIndex([texts[i] for i in held.tolist()], docs[held])
        windows = np.lib.stride_tricks.sliding_window_view(whole, WINDOW)

        def least_owner(asked: np.ndarray) -> np.ndarray:
            return np.concatenate([index.least_owners(windows[starts[part]]) for part in np.array_split(asked, len(asked) // 500_000 + 1)])

        group = np.empty(len(hashes), np.int32 if len(heads) < 1 << 31 else np.int64)
        group[order] = np.repeat(np.arange(len(heads), dtype=group.dtype), np.diff(np.r_[heads, len(hashes)]))
        searched = np.flatnonzero(least != most)
        of_group = np.empty(len(heads), np.int64)
        of_group[searched] = least_owner(order[heads[searched]])
        asked = np.flatnonzero(many)
        for part in np.array_split(asked, len(asked) // 500_000 + 1):
            earlier[part] = of_group[group[part]] < docs[owner[part]]
            other = part[(windows[starts[part]] != windows[starts[order[heads[group[part]]]]]).any(axis=1)]
            if len(other):
                earlier[other] = least_owner(other) < docs[owner[other]]
    first = np.cumsum(counts) - counts
    bits = np.where(earlier, np.int64(1) << (np.arange(len(earlier)) - np.repeat(first, counts)), 0)
    masks = np.add.reduceat(bits, first)
    return pd.DataFrame({"doc": docs, "key": rows["key"].to_numpy(), "mask": masks})[masks != 0]


def covered_bytes(size: int, f: Fragments | None, buckets: int, gone: bytes | None, masks: dict[int, int]) -> np.ndarray:
    """Which bytes of a text lie in a window that is a repeat."""
    hit = np.zeros(size + 1, np.int64)
    if f is not None:
        key = f.key(buckets)
        whole = np.isin(key, np.frombuffer(gone or b"", np.uint64))
        np.add.at(hit, f.start[whole], 1)
        np.add.at(hit, f.start[whole] + f.count[whole] + WINDOW - 1, -1)
        if masks:
            for i in np.flatnonzero(np.isin(key, np.array(list(masks), np.uint64)) & ~whole):
                for k in range(int(f.count[i])):
                    if masks[int(key[i])] >> k & 1:
                        hit[f.start[i] + k] += 1
                        hit[f.start[i] + k + WINDOW] -= 1
    return np.cumsum(hit)[:-1] > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragments_per_bucket: int = 2_000_000) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for every row: what is left of each text as UTF-8 bytes.

    A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller id. Texts are cut into
    fragments by content, so that equal windows meet by the hash of a seed inside them: fragments that are equal are
    settled by that; those whose seeds and one side agree are compared window by window, in run-length indexes of
    such fragments alone. Hot seeds go window by window from the start. Texts move twice more, by id.

    Null texts count as empty and null ids come before all others; rows of one id do not repeat each other, each is judged
    by other ids. Other columns are not read. No rows: no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (16 * fragments_per_bucket) + 1)
    hot = hot_seeds(plain)
    sent = spark.sparkContext.broadcast(hot)
    settled = bucket_rows(plain, buckets, hot).groupBy("bucket").applyInPandas(settle_bucket(buckets), "g bigint, asks boolean, docs binary, keys binary")
    verdicts = settled.groupBy("g").applyInPandas(per_document, "doc bigint, gone binary, asked binary")
    verdicts = runtime.written(verdicts, "repeat-verdicts")
    texts = texts_of(docs, id_col, text_col)

    def asked_fragments(batch: pa.RecordBatch) -> dict:
        out, row = [], 0
        docs_, asked_ = batch.column("doc").to_pylist(), batch.column("asked")
        for texts, text, f in fragments_of((body_bytes(x.as_py()) for x in batch.column("body")), sent.value):
            key, seed = f.key(buckets), f.cut_seed(buckets).view(np.int64)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            for k, data in enumerate(texts):
                where = cuts[k] + np.flatnonzero(np.isin(key[cuts[k]:cuts[k + 1]], np.frombuffer(asked_[row + k].as_py(), np.uint64)))
                out += [(s, docs_[row + k], q, data[a:a + n + WINDOW - 1]) for s, q, a, n in zip(
                    seed[where].tolist(), key[where].view(np.int64).tolist(), f.start[where].tolist(), f.count[where].tolist(), strict=True)]
            row += len(texts)
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = dict(seed=pa.int64(), doc=pa.int64(), key=pa.int64(), body=pa.binary())
        return {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}

    asked = verdicts.where(F.octet_length("asked") > 0).select("doc", "asked")
    parts = per_batch(texts.join(asked, "doc").select("doc", "body", "asked"), asked_fragments, "seed bigint, doc bigint, key bigint, body binary")
    parts = runtime.written(parts, "asked-fragments")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.count() // 200_000 + 1)
    compared = parts.withColumn("g", F.pmod("seed", F.lit(groups))).groupBy("g").applyInPandas(
        lambda rows: compare_bucket(rows[["doc", "key", "body"]]), "doc bigint, key bigint, mask bigint")
    masks = compared.groupBy("doc").agg(F.collect_list(F.struct("key", "mask")).alias("masks"))
    found = runtime.written(verdicts.select("doc", "gone").join(masks, "doc", "full"), "repeats")
    has = F.col("gone").isNotNull() | F.col("masks").isNotNull()

    def strip(batch: pa.RecordBatch) -> dict:
        bodies, gone, masks = (batch.column(n) for n in ("body", "gone", "masks"))
        hit = [i for i in range(batch.num_rows) if gone[i].is_valid or masks[i].is_valid]
        out, done = [None] * batch.num_rows, 0
        for i in set(range(batch.num_rows)).difference(hit):
            data = body_bytes(bodies[i].as_py())
            out[i] = (len(data), 0, 0, data)
        for texts, text, f in fragments_of((body_bytes(bodies[i].as_py()) for i in hit), sent.value):
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            for i, data, first, last in zip(hit[done:done + len(texts)], texts, cuts[:-1], cuts[1:], strict=True):
                covered = covered_bytes(len(data), f.part(first, last), buckets, gone[i].as_py(), {m["key"] % 2**64: m["mask"] for m in masks[i].as_py() or ()})
                edges = np.diff(np.r_[False, covered].astype(np.int8)) > 0
                out[i] = (len(data), int(covered.sum()), int(edges.sum()), np.frombuffer(data, np.uint8)[~covered].tobytes())
            done += len(texts)
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = dict(n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept=pa.binary())
        return {"doc": batch.column("doc")} | {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}

    stripped = per_batch(texts.join(found.where(has), "doc", "left").select("doc", "body", "gone", "masks"), strip, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    own_id = F.when(F.col("doc") != NO_ID, F.col("doc")).cast(docs.schema[id_col].dataType).alias(id_col)
    return stripped.select(own_id, "n_bytes", "n_removed", "n_spans", "kept")
