"""Token ids packed into rows of fixed length: best fit decreasing, with a segment tree over capacities.

A document longer than a row is split losslessly into pieces. Pieces are placed longest first, each into the
row with the least room that still holds it; the segment tree over room sizes finds that size in O(log length).
Each task packs its stream in groups of GROUP_TOKENS, so memory is bounded and nothing is shuffled: a text's ids
are made, packed and written where the text is read. A group is named by its first document and that one's digest, so the
name of a row does not depend on the number of its task.

Defined results: an empty or null id list takes no room and is in no row; every other id stands in exactly one
place; repeated rows are packed as often as given; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .runtime import tidied

GROUP_TOKENS = 1_000_000


class Rooms:
    """A segment tree over the sizes 0..length: which have an open row."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.full = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.full[at]:
            self.full[at] = True
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of at least that size, removed from the tree: (room, row)."""
        at = least + self.size
        if not self.full[at]:
            while at > 1 and not (at % 2 == 0 and self.full[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.full[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.full[at] = False
            while at > 1:
                at >>= 1
                self.full[at] = self.full[2 * at] or self.full[2 * at + 1]
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces (by index) of each row; no size is over length."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.put(room - sizes[i], row)
    return rows


Piece = tuple[object, int, np.ndarray]


def _groups(rows: Iterator[tuple[object, np.ndarray]], length: int, group_tokens: int) -> Iterator[list[tuple[str, list[Piece]]]]:
    """Rows (document, ids) to packed rows (name, pieces), some at a time; a piece is (document, offset, ids)."""
    held: list[Piece] = []
    size = 0

    def done() -> Iterator[list[tuple[str, list[Piece]]]]:
        name = f"{held[0][0]}-{blake2b(b''.join(x.tobytes() for _, _, x in held), digest_size=8).hexdigest()}"
        packed = [(f"{name}-{k}", [held[i] for i in row]) for k, row in enumerate(best_fit([len(x) for _, _, x in held], length))]
        for i in range(0, len(packed), 64):
            yield packed[i : i + 64]

    for own, ids in rows:
        held += [(own, at, ids[at : at + length]) for at in range(0, len(ids), length)]
        size += len(ids)
        if size >= group_tokens:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def _segments(packed: list[tuple[str, list[Piece]]], kind: pa.DataType) -> list[pa.Array]:
    """pack_id, cu_seqlens, doc_ids and offsets of packed rows."""
    ints = pa.list_(pa.int32())
    cu = [np.cumsum([0, *(len(x) for _, _, x in row)]).astype(np.int32) for _, row in packed]
    return [pa.array([n for n, _ in packed]), pa.array(cu, ints), pa.array([[d for d, _, _ in row] for _, row in packed], pa.list_(kind)), pa.array([[o for _, o, _ in row] for _, row in packed], ints)]


def pack(df: DataFrame, length: int = 2048, id_col: str = "doc_id", ids_col: str = "ids", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of at most `length` ids: pack_id, ids, cu_seqlens, positions, doc_ids, offsets.

    cu_seqlens holds the segments' cumulative lengths from 0; positions restart at 0 in each segment; doc_ids
    and offsets say which document a segment is of, and from which of its ids on.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"pack_id string, cu_seqlens array<int>, doc_ids array<{kind}>, offsets array<int>, ids array<int>, positions array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def rows() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                types[:] = [batch.column(0).type]
                for i in range(batch.num_rows):
                    if batch.column(1)[i].is_valid:
                        yield batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype("<i4")

        ints = pa.list_(pa.int32())
        for packed in _groups(rows(), length, group_tokens):
            ids = pa.array([np.concatenate([x for _, _, x in row]) for _, row in packed], ints)
            positions = pa.array([np.concatenate([np.arange(len(x), dtype=np.int32) for _, _, x in row]) for _, row in packed], ints)
            yield pa.RecordBatch.from_arrays([*_segments(packed, types[0]), ids, positions], ["pack_id", "cu_seqlens", "doc_ids", "offsets", "ids", "positions"])

    packed = df.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(tidied(run), schema)
    return packed.select("pack_id", "ids", "cu_seqlens", "positions", "doc_ids", "offsets")


def matrix(df: DataFrame, tokenizer: str, length: int = 2048, end: str | None = None, pad: int = 0, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Texts encoded and packed in one pass: pack_id, cu_seqlens, doc_ids, offsets, matrix_row, position_resets.

    matrix_row holds exactly `length` ids as little-endian int32 bytes, padded with `pad`; position_resets are the places
    at which positions restart from 0, that of the padding included. end: an added token put after each text, empty ones too.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"pack_id string, cu_seqlens array<int>, doc_ids array<{kind}>, offsets array<int>, matrix_row binary, position_resets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, own = [], bpe.load(tokenizer)
        after = np.array([] if end is None else [own.added[end]], "<i4").tobytes()

        def rows() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                types[:] = [batch.column(0).type]
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        yield name, np.frombuffer((own.encode_bytes(text) if text else b"") + after, "<i4")

        for packed in _groups(rows(), length, group_tokens):
            out = np.full((len(packed), length), pad, "<i4")
            for k, (_, row) in enumerate(packed):
                ids = np.concatenate([x for _, _, x in row])
                out[k, : len(ids)] = ids
            segments = _segments(packed, types[0])
            resets = pa.array([c[:-1] if c[-1] == length else c for c in (x.values.to_numpy() for x in segments[1])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*segments, pa.array([x.tobytes() for x in out], pa.binary()), resets], ["pack_id", "cu_seqlens", "doc_ids", "offsets", "matrix_row", "position_resets"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), schema)


def write_matrix(packed: DataFrame, folder: str) -> None:
    """Writes the id matrix, one Parquet row for each of its rows, the segments beside it."""
    packed.write.parquet(folder)


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """What write_matrix wrote."""
    return spark.read.parquet(folder)
