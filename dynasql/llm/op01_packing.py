"""Vector bin packing of token sequences (operator 1).

Examples are placed under simultaneous limits on tokens, segments and
loss-bearing tokens. A bin takes, again and again, the waiting example that
fits and has the largest dot product of its demand with what the bin has left;
when none fits, an example is cut to fill the bin. Examples longer than a bin
are cut into whole bins first.

Each task packs what it reads, as a stream: it holds a window of waiting
examples of bounded size, so nothing is shuffled, a hot source changes nothing
and a lost task packs its rows again in the same way. A task's last, unfilled
bin is cut into sequences whose lengths are powers of two, which need no
padding.

Defined results: a null text is empty, and its only token is the end mark; a
null prompt is empty; a null doc_id is carried; repeated rows are packed each;
no rows give no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents
from .encode import encoder

#: Tokens of a sequence, and the id that ends a document.
TOKENS, END = 2048, (1).to_bytes(4, "little")
#: Limits on segments and loss-bearing tokens of a sequence.
SEGMENTS, LOSS = 512, 2048
#: The same for sequences of conversation turns.
TURN_SEGMENTS, TURN_LOSS = 24, 1024
#: Examples that wait at most while a bin is filled.
WINDOW = 1024


class Packer:
    """Packs (key, ids, prompt tokens) and hands out pieces.

    A piece is (key, start, length, ids, total tokens, loss tokens, sequence, offset).
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, window: int = WINDOW):
        self.cap = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.loss, self.window = tokens, loss, window
        self.room = 2 * window + 2
        self.demand = np.zeros((self.room, 3))
        self.items: list[tuple] = []
        self.done: list[tuple] = []
        self.sequence = 0

    @staticmethod
    def loss_of(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def fitting(self, start: int, length: int, prompt: int, tokens: int, loss: int) -> int:
        """Tokens of an example's front that fit into so many tokens and loss tokens."""
        return min(length, tokens, loss + max(0, prompt - start))

    def wait(self, item: tuple) -> None:
        key, start, ids, prompt, total = item
        n = len(ids) // 4
        self.demand[len(self.items)] = n, 1, self.loss_of(start, n, prompt)
        self.items.append(item)

    def add(self, key, ids: bytes, prompt: int = 0) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = self.fitting(start, total - start, prompt, self.tokens, self.loss)
            piece = (key, start, ids[4 * start : 4 * (start + n)], prompt, total)
            start += n
            if n == self.tokens:
                self.close([piece])
            else:
                self.wait(piece)
                if len(self.items) >= 2 * self.window:
                    self.fill(self.window)

    def take(self, i: int) -> tuple:
        """Remove a waiting example; the last one takes its place."""
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.demand[i] = self.demand[len(self.items)]
        return item

    def fill(self, least: int) -> None:
        """Fill bins until no more than least examples wait."""
        while len(self.items) > least:
            held, left = [], self.cap.copy()
            while self.items and left[0] >= 1 and left[1] >= 1:
                demand = self.demand[: len(self.items)]
                score = demand @ (left / self.cap**2)
                score[(demand > left).any(axis=1)] = -1
                i = int(score.argmax())
                if score[i] >= 0:
                    item = self.take(i)
                else:  # none fits whole
                    i = int((demand @ (left / self.cap**2)).argmax())
                    key, start, ids, prompt, total = self.items[i]
                    n = self.fitting(start, len(ids) // 4, prompt, int(left[0]), int(left[2]))
                    if n < 1:
                        break
                    self.take(i)
                    item = (key, start, ids[: 4 * n], prompt, total)
                    self.wait((key, start + n, ids[4 * n :], prompt, total))
                held.append(item)
                n = len(item[2]) // 4
                left -= (n, 1, self.loss_of(item[1], n, item[3]))
            self.close(held)

    def close(self, pieces: list[tuple]) -> None:
        """Write one full sequence, or several of power-of-two lengths if short."""
        rest = sum(len(p[2]) for p in pieces) // 4
        size = rest if rest == self.tokens else 1 << rest.bit_length() - 1
        offset = 0
        for key, start, ids, prompt, total in pieces:
            while ids:
                n = min(len(ids) // 4, size - offset)
                self.done.append((key, start, n, ids[: 4 * n], total, self.loss_of(start, n, prompt), self.sequence, offset))
                start, ids, offset, rest = start + n, ids[4 * n :], offset + n, rest - n
                if offset == size:
                    self.sequence, offset = self.sequence + 1, 0
                    size = 1 << rest.bit_length() - 1 if rest else 0


def _rows(done: list[tuple], kind: pa.DataType, first: int, with_ids: bool) -> pa.RecordBatch:
    key, start, length, ids, total, loss, sequence, offset = zip(*done, strict=True)
    big = [pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(i) for i in ids], total, [first + s for s in sequence], offset, loss)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    columns = [pa.array(key, kind), *big]
    if with_ids:
        columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, prompt: str | None = None, *, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, vocabulary: str | None = None, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of all rows of docs, packed; with_ids adds their ids as bytes.

    prompt names a column of text that comes first and bears no loss. With added,
    an added token of the vocabulary that a text spells out is one id, as its
    tokenizer has it; else it is plain text. Columns:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(vocabulary), Packer(tokens, segments, loss)
        ids = coder.ids_with_added if added else coder.ids
        first, kind = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            kind = batch.column(0).type
            prompts = batch.column(2) if prompt else None
            for i, key in enumerate(batch.column(0).to_pylist()):
                head = ids(prompts[i].as_py() or "") if prompt else b""
                packer.add(key, head + ids(batch.column(1)[i].as_py() or "") + END, len(head) // 4)
                if len(packer.done) >= 10_000:
                    yield _rows(packer.done, kind, first, with_ids)
                    packer.done.clear()
        packer.fill(0)
        if packer.done:
            yield _rows(packer.done, kind, first, with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text", *([prompt] if prompt else [])).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. They carry no prompt, so tokens bind before loss; see packing_conversations."""
    return pack(documents(spark, sf_dir), added=True)


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn of conversations, with the turn before it as a prompt that bears no loss, under three limits that bind."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = rows.withColumn("prompt", before).filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "prompt", "text")
    return pack(turns, "prompt", segments=TURN_SEGMENTS, loss=TURN_LOSS, added=True)
