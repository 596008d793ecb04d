"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (dense attention). Pieces
are taken in descending length and each goes to the sequence with the least cost that
still has room for it; pieces that fit nowhere are cut into the gaps that are left, and
what is over at the end of a block becomes sequences whose lengths are powers of two,
which need no padding.

Packing runs inside the scan's own tasks, in blocks of a fixed number of tokens: no
shuffle, no state that grows with the corpus, and a lost task is computed again from its
own input split alone.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm._encode import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"


def place(lengths, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[list[list[tuple[int, int, int]]], list[float]]:
    """Sequences as lists of (item, start in the item, length), and the cost of each.

    Every sequence is full, except those after the last full one, whose lengths are
    powers of two. Ties go to the lower sequence number and the earlier item.
    """
    cost = lambda n: linear * n + quadratic * n * n
    full, heads = [], []  # sequences of one piece; what is left of each item
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            full.append([(i, at, capacity)])
            at += capacity
        if n > at:
            heads.append((n - at, i, at))
    heads.sort(key=lambda x: (-x[0], x[1]))
    n_open = sum(x[0] for x in heads) // capacity
    rooms, costs, seqs, over = [capacity] * n_open, [0.0] * n_open, [[] for _ in range(n_open)], []
    heap = [(0.0, k) for k in range(n_open)]
    for n, i, at in heads:
        aside = []
        while heap and rooms[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
            if rooms[aside[-1][1]] == 0:
                aside.pop()
        if heap:
            _, k = heapq.heappop(heap)
            seqs[k].append((i, at, n))
            rooms[k] -= n
            costs[k] += cost(n)
            if rooms[k]:
                heapq.heappush(heap, (costs[k], k))
        else:
            over.append((n, i, at))
        for x in aside:
            heapq.heappush(heap, x)
    gaps = sorted((k for k in range(n_open) if rooms[k]), key=lambda k: (-rooms[k], k))
    g, tail = 0, []
    for n, i, at in over:
        while n and g < len(gaps):
            k = gaps[g]
            m = min(n, rooms[k])
            seqs[k].append((i, at, m))
            costs[k] += cost(m)
            rooms[k] -= m
            at, n = at + m, n - m
            g += not rooms[k]
        if n:
            tail.append((n, i, at))
    left = sum(x[0] for x in tail)
    t = 0
    while left:
        room = 1 << min(left.bit_length() - 1, capacity.bit_length() - 1)
        left, seq = left - room, []
        while room:
            n, i, at = tail[t]
            m = min(n, room)
            seq.append((i, at, m))
            room -= m
            tail[t] = (n - m, i, at + m)
            t += n == m
        seqs.append(seq)
        costs.append(sum(cost(m) for _, _, m in seq))
    return full + seqs, [cost(capacity)] * len(full) + costs


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 2, block_tokens: int = 1_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a piece (SCHEMA): where it starts in its document's ids, and where it lies in its sequence.

    ``capacity`` is a power of two. Null texts are empty: such a document is its end id
    alone. Null and repeated doc_ids are packed like any others, row by row; a text of any
    length is encoded whole and cut into as many pieces as it needs; an empty
    table gives no rows. Columns other than the two named are not read. sequence_id is
    unique in the result: the task's number, then the sequence's in the task.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def block(first: int, ids: list, held: list[bytes]) -> tuple[int, pa.RecordBatch]:
        seqs, costs = place([len(x) // 4 for x in held], capacity)
        rows = []
        for s, (seq, cost) in enumerate(zip(seqs, costs)):
            offset, total = 0, sum(n for _, _, n in seq)
            for i, at, n in seq:
                rows.append((ids[i], at, n, zlib.crc32(memoryview(held[i])[4 * at : 4 * (at + n)]), len(held[i]) // 4, first + s, offset, total, cost))
                offset += n
        kinds = [pa.int64()] * 8 + [pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return first + len(seqs), pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        enc = encoder(tokenizer)
        first, ids, held, total = TaskContext.get().partitionId() << 36, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = enc.ids(text.as_py()) + end
                if not x:
                    continue
                ids.append(doc_id)
                held.append(x)
                total += len(x) // 4
                if total >= block_tokens:
                    first, out = block(first, ids, held)
                    yield out
                    ids, held, total = [], [], 0
        if ids:
            yield block(first, ids, held)[1]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
