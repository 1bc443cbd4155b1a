"""Vector bin packing of tokenised examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, texts_of, written
from dialoom.llm.tokens import END_ID, TOKENIZER, encoder


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. None: no limit."""

    tokens: int = 2048
    segments: int | None = None
    loss: int | None = None


@dataclass
class Piece:
    item: int  # which example
    start: int  # its tokens before this piece
    length: int
    loss: int
    sequence: int = -1
    offset: int = -1


class Packer:
    """Fills one sequence at a time from a pool of at most `pool` pieces.

    An example over the token limit first gives whole sequences of its own, as far as its loss-bearing
    tokens allow. From the pool, each step takes the piece with the largest dot product of its demands
    (tokens, one segment, loss tokens, each as a share of its limit) and what the sequence has left, among
    those that fit. Where none fits and `cut` is set, the piece with the largest dot product is cut to fill
    the sequence. The pool bounds memory; its order of arrival fixes the result, so a task that is run
    again gives the same sequences.
    """

    def __init__(self, limits: Limits, pool: int = 2048, cut: bool = True):
        self.limits, self.most, self.cut = limits, pool, cut
        self.cap = np.array([limits.tokens, limits.segments or 1 << 40, limits.loss or 1 << 40], dtype=np.float64)
        self.need = np.zeros((pool, 3))
        self.pieces: list[Piece] = []
        self.sequence = 0

    def add(self, item: int, length: int, loss: np.ndarray | None = None) -> Iterator[Piece]:
        """loss: flags of the loss-bearing tokens; None: all are."""
        sums = None if loss is None else np.concatenate(([0], np.cumsum(loss, dtype=np.int64)))
        borne = (lambda a, b: b - a) if sums is None else (lambda a, b: int(sums[b] - sums[a]))
        start = 0
        while length - start > 0:
            end = min(length, start + self.limits.tokens)
            if self.limits.loss is not None and borne(start, end) > self.limits.loss:  # cut where the loss limit is met
                end = start + (self.limits.loss if sums is None else int(np.searchsorted(sums, sums[start] + self.limits.loss, side="right")) - 1 - start)
            piece = Piece(item, start, end - start, borne(start, end))
            if end - start == self.limits.tokens:
                piece.sequence, piece.offset = self.sequence, 0
                self.sequence += 1
                yield piece
            else:
                if len(self.pieces) == self.most:
                    yield from self.fill()
                self._put(piece, borne)
            start = end

    def _put(self, piece: Piece, borne) -> None:
        piece.borne = borne
        self.need[len(self.pieces)] = (piece.length, 1, piece.loss)
        self.pieces.append(piece)

    def _take(self, k: int) -> Piece:
        piece, last = self.pieces[k], len(self.pieces) - 1
        self.pieces[k], self.need[k] = self.pieces[last], self.need[last]
        self.pieces.pop()
        return piece

    def fill(self) -> Iterator[Piece]:
        """The pieces of one sequence."""
        left, at = self.cap.copy(), 0
        while self.pieces and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.pieces)]
            score = (need / self.cap) @ (left / self.cap)
            fits = (need <= left).all(axis=1)
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, score, -1))))
            elif self.cut and left[2] > 0:
                k = int(np.argmax(score))
                whole = self.pieces[k]
                size = min(int(left[0]), whole.length)
                while size and whole.borne(whole.start, whole.start + size) > left[2]:  # as many tokens as the loss limit lets in
                    size -= max(1, whole.borne(whole.start, whole.start + size) - int(left[2]))
                if size <= 0:
                    break
                piece = Piece(whole.item, whole.start, size, whole.borne(whole.start, whole.start + size))
                whole.start, whole.length, whole.loss = whole.start + size, whole.length - size, whole.loss - piece.loss
                self.need[k] = (whole.length, 1, whole.loss)
            else:
                break
            piece.sequence, piece.offset = self.sequence, at
            at += piece.length
            left -= (piece.length, 1, piece.loss)
            yield piece
        self.sequence += 1

    def finish(self) -> Iterator[Piece]:
        while self.pieces:
            yield from self.fill()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, loss_of: Callable[[str, np.ndarray], np.ndarray] | None = None, pool: int = 2048, cut: bool = True) -> DataFrame:
    """One row per piece of an example: where it starts in it, and in which sequence at which offset it lies.

    An example is the text's ids and the end id; null counts as empty, so the shortest is the end id
    alone. loss_of(text, ids) flags the loss-bearing tokens (without it all are; the end id always is).
    Each task packs the rows of its partition, in their order; nothing is exchanged, and a partition
    leaves one sequence that is not full. sequence_id holds the partition in its upper bits. Rows that
    repeat are packed each. With cut=False examples up to the limits are kept whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        packer = Packer(limits, pool, cut)
        held: dict[int, tuple[int | None, bytes, int]] = {}  # examples with tokens that lie in no sequence yet
        rest: dict[int, int] = {}
        out: list[tuple] = []

        def emit(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                doc, ids, total = held[p.item]
                out.append((doc, p.start, p.length, zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)]), total, base + p.sequence, p.offset, p.loss))
                rest[p.item] -= p.length
                if not rest[p.item]:
                    del held[p.item], rest[p.item]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        item = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = enc.encode(text) + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                held[item], rest[item] = (doc, ids, total), total
                loss = None if loss_of is None else np.append(loss_of(text, np.frombuffer(ids, "<u4")[:-1]).astype(bool), True)
                emit(packer.add(item, total, loss))
                item += 1
            if out:
                yield batch()
        emit(packer.finish())
        if out:
            yield batch()

    return written(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA), "packing-pieces")
