"""Packing documents into fixed-length training sequences by dynamic programming.

Documents keep their order. Windows of at most `size` ids are cut at document ends
(no penalty), sentence ends (SENTENCE) or, where a sentence leaves no other choice,
inside one (INSIDE). A window pays its padding, which is nothing at a power of two.
The best last cut is the minimum of dp[i] + position[i] over a sliding range of
candidates, kept in a monotone queue, so each candidate enters and leaves once.

Each input partition is packed by itself, in blocks of BLOCK ids whose last window
runs on into the next block: memory is bounded and nothing is shuffled. Ids of
sequences hold the partition's number in their upper bits.

Defined cases: a null or empty text is a document of the end id alone; repeated rows
are documents of their own; empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

SIZE = 2048
SENTENCE, INSIDE = 2.0, 24.0
BLOCK = 1 << 19


def encoder(json_path: str, ranks_path: str):
    """text -> ids of the tokenizer in json_path.

    The rank file holds the same vocabulary for a faster encoder; texts with one of the
    tokenizer's special strings, or with characters on whose class the two libraries'
    Unicode tables may differ (beyond U+024F, but for common punctuation), go through the tokenizer itself.
    """
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    odd = re.compile("[^\x00-ɏ‐-‧‰-⁞€一-龥Ѐ-џ]" + "".join("|" + re.escape(s) for s in special))
    ends = np.zeros(max(ranks.values()) + 2, bool)
    for piece, i in ranks.items():
        ends[i] = piece.rstrip(b" \t\r")[-1:] in (b".", b"!", b"?", b"\n")

    def encode(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text)

    return encode, ends


def _power(x):
    return (x & (x - 1)) == 0


def cuts(ids_end: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions and their penalties: document ends, sentence ends, and fillers where two lie more than `size` apart."""
    pos = np.union1d(ids_end, sentence)
    pos = np.union1d(pos, [0])
    gaps = np.flatnonzero(np.diff(pos) > size)
    extra = [np.arange(pos[g] + size, pos[g + 1], size) for g in gaps] + [pos[g + 1] - size * np.arange(1, (pos[g + 1] - pos[g]) // size + 1) for g in gaps]
    every = np.union1d(pos, np.concatenate(extra)) if extra else pos
    pen = np.full(len(every), INSIDE)
    pen[np.isin(every, sentence)] = SENTENCE
    pen[np.isin(every, ids_end)] = 0.0
    return every.astype(np.int64), pen


def best_windows(pos: np.ndarray, pen: np.ndarray, size: int) -> list[int]:
    """Cut positions, first and last included, of least padding plus penalties."""
    n = len(pos)
    by_power: dict[int, list[int]] = {}
    k = 1
    while k <= size:
        i = np.searchsorted(pos, pos - k)
        ok = (pos >= k) & (pos[np.minimum(i, n - 1)] == pos - k)
        for j, p in zip(np.flatnonzero(ok).tolist(), i[ok].tolist()):
            by_power.setdefault(j, []).append(p)
        k *= 2
    at, cost = pos.tolist(), pen.tolist()
    dp, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n
    key[0] = float(at[0])
    for j in range(1, n):
        x = at[j]
        while at[queue[0]] < x - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - x
        for p in by_power.get(j, ()):
            if dp[p] <= best:
                best, i = dp[p], p
        dp[j] = best + cost[j]
        back[j] = i
        key[j] = v = dp[j] + x
        while queue and key[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [at[-1]], n - 1
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


def tail(start: int, end: int, size: int) -> list[int]:
    """Ends of the last window's parts: powers of two where the cuts cost less than the padding."""
    n = end - start
    if _power(n) or size - n <= INSIDE * (bin(n).count("1") - 1):
        return [end]
    out = []
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            start += 1 << k
            out.append(start)
    return out


class Packer:
    def __init__(self, size: int, sentence_end: np.ndarray, first: int):
        self.size, self.sentence_end, self.next = size, sentence_end, first
        self.docs: list[tuple[int, np.ndarray, int, int]] = []  # id, its ids, ids packed before, all its ids
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, ids, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows that are settled."""
        if not self.held:
            return []
        flat = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        where, pen = cuts(ends, np.flatnonzero(self.sentence_end[np.minimum(flat, len(self.sentence_end) - 1)]) + 1, self.size)
        marks = best_windows(where, pen, self.size)
        if last:
            marks = marks[:-1] + tail(marks[-2], marks[-1], self.size)
        else:
            marks = marks[:-1]
        out, d, start = [], 0, 0
        for a, b in zip(marks, marks[1:]):
            at = a
            while at < b:
                while ends[d] <= at:
                    d += 1
                doc, ids, before, total = self.docs[d]
                begin = int(ends[d]) - len(ids)
                stop = min(b, int(ends[d]))
                piece = flat[at:stop]
                out.append((doc, before + at - begin, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), total, self.next, at - a, piece))
                at = stop
            self.next += 1
        start = marks[-1]
        rest = []
        for (doc, ids, before, total), e in zip(self.docs, ends.tolist()):
            if e > start:
                used = max(0, start - (e - len(ids)))
                rest.append((doc, ids[used:], before + used, total))
        self.docs, self.held = rest, sum(len(r[1]) for r in rest)
        return out


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, json_path: str, ranks_path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = 1, with_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per piece: the key, COLUMNS and, with_ids, the ids themselves."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"`{c}` bigint" for c in COLUMNS) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = once(json_path, lambda: encoder(json_path, ranks_path))
        packer = Packer(size, ends, TaskContext.get().partitionId() << 33)
        key_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces))
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[key, *COLUMNS, *["ids"] * with_ids])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, np.int64))
                if packer.held >= block and (got := packer.flush(False)):
                    yield batch_of(got)
        if got := packer.flush(True):
            yield batch_of(got)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
