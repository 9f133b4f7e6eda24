"""Packed id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Each task streams over its documents and packs windows of about ``WINDOW_TOKENS`` tokens: memory is bounded by the window
and by the longest document, nothing is shuffled, and a lost task is done again with the same result. Documents longer than
a row are cut into full rows and a rest, without loss. Each output row is one matrix row: ``ids`` (little-endian, unsigned
16-bit where the vocabulary allows it, else 32-bit; padded to the full width), ``cu_seqlens`` (cumulative segment lengths,
from 0 to ``n_tokens``), ``resets`` (places where positions start again at 0), and the document and start of each segment.

Defined results: a null text is empty and has the closing id alone; rows that share a ``doc_id`` are packed each by itself;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lorespark.llm.common import texts
from lorespark.llm.tokenizer import END_OF_DOCUMENT, VOCABULARY, document_ids, encoder

WIDTH = 2048
WINDOW_TOKENS = 2_000_000
ROWS = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, "
        "starts array<long>")


class FreeCapacities:
    """Segment tree over the free capacities 0..width: the smallest one, at least as large as asked for, that some row has."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(free capacity, row) of the tightest row that holds ``least`` tokens; the row leaves the tree."""
        node = least + self.leaves
        if not self.count[node]:
            # Up until a right neighbour holds rows, then down its left edge.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._change(free, -1)
        return free, self.rows[free].pop()

    def _change(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, each with a total length of at most ``width``; the longest pieces come first."""
    tree, rows = FreeCapacities(width), []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[piece])
        if found is None:
            found = (width, len(rows))
            rows.append([])
        free, row = found
        rows[row].append(piece)
        if free > lengths[piece]:
            tree.add(free - lengths[piece], row)
    return rows


def token_rows(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Packed matrix rows of all documents."""

    def run(batches):
        kind = "<u2" if encoder(vocabulary).n_vocab <= 1 << 16 else "<u4"
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        pieces: list[tuple] = []
        held, done = 0, 0

        def flush():
            nonlocal pieces, held, done
            out = []
            for row in best_fit_decreasing([len(p[2]) for p in pieces], width):
                parts = [pieces[k] for k in row]
                ends = np.cumsum([0] + [len(p[2]) for p in parts])
                ids = np.full(width, END_OF_DOCUMENT, dtype=kind)
                ids[:ends[-1]] = np.concatenate([p[2] for p in parts])
                out.append((first + done + len(out), int(ends[-1]), ids.tobytes(), ends.tolist(), ends[:-1].tolist(),
                            [p[0] for p in parts], [p[1] for p in parts]))
            done, pieces, held = done + len(out), [], 0
            return pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "starts"])

        for frame in batches:
            for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
                ids = np.array(document_ids(text, vocabulary), dtype=kind)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for start in range(0, len(ids), width):
                    pieces.append((doc_id, start, ids[start:start + width]))
                held += len(ids)
                if held >= window_tokens:
                    yield flush()
        if pieces:
            yield flush()

    return texts(docs).mapInPandas(run, ROWS)


def write_token_rows(docs: DataFrame, path: str, width: int = WIDTH, vocabulary: str = VOCABULARY) -> None:
    """The matrix rows as files of a store that all executors share; the writer commits whole tasks only."""
    token_rows(docs, width, vocabulary).write.mode("errorifexists").parquet(path)
