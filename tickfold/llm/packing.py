"""Packing token windows: best fit decreasing, with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts, utf8

#: Ends every document.
END_ID = 0


def byte_of_char() -> dict[str, int]:
    """The characters that vocabulary files write bytes as: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte = byte_of_char()
    added = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
    ranks = {bytes(map(byte.__getitem__, w)): i for w, i in file["model"]["vocab"].items() if w not in added}
    return tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


class Tokenizer:
    """The ids that ``tokenizers`` gives with a byte-level BPE file, added tokens in the text included. Merges
    run by rank in ``tiktoken``, at about a third of the time."""

    def __init__(self, path: str, pattern: str):
        self.encoding = _encoding(path, pattern)
        self.added = self.encoding.special_tokens_set

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.encoding.encode(text, allowed_special=self.added), np.int32)
        return np.array(self.encoding.encode_ordinary(text), np.int32)


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def _pieces(path: str | None, pattern: str | None, size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, done = Tokenizer(*((path, pattern) if path else default_vocabulary())), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = []
                for text in utf8(batch, "text"):
                    ids.append(tok.ids((text or b"").decode("utf-8", "replace")))
                    ids.append(np.array([END_ID], np.int32))
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lens = np.array([len(x) + 1 for x in ids[::2]], np.int64)
                count = -(-lens // size)
                doc = np.repeat(np.arange(len(lens)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(lens[doc] - start, size)
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(lens[doc], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(done + np.arange(len(doc)), pa.int64()),
                    ],
                    ["id", "start", "length", "doc_tokens", "ids", "turn"],
                )
                done += len(doc)

    return kernel


class BestFit:
    """Open windows by remaining capacity. ``place`` finds the tightest that holds a piece."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)  # open windows below each node of the segment tree
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def _tightest(self, length: int) -> int | None:
        """The least capacity of ``length`` or more that an open window has."""
        node = self.leaves + length
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset there) of a piece."""
        capacity = self._tightest(length)
        if capacity is None:
            window, offset = self.windows, 0
            self.windows += 1
        else:
            window, offset = self.open[capacity].pop()
            self._add(capacity, -1)
        if left := self.size - offset - length:
            self.open[left].append((window, offset + length))
            self._add(left, 1)
        return window, offset


def _pack(size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(size), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [fit.place(n) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + w for w, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return kernel


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document is the ids of its text (null: none), then id 0. It is cut into full windows and a rest.
    Pieces are dealt evenly to partitions; each sorts its own by length and packs them best fit
    decreasing, so the padding is that of one open window or so a partition. Per piece: id, start,
    length, doc_tokens, ids, sequence_id, offset. Repeated rows are packed as often as they occur;
    null ids stay null; other columns are not looked at, so their names don't matter; an empty table gives no
    piece. A very long text is many pieces, dealt by themselves. Ties of length go by id and start.

    path, pattern: a file of byte-level BPE as ``tokenizers`` reads it and its split pattern; None: the installed one.
    """
    base = texts(df, id_col, text_col)
    kind = dict(base.dtypes)["id"]
    shape = f"id {kind}, start long, length long, doc_tokens long, ids array<int>"
    pieces = base.mapInArrow(_pieces(path, pattern, size), f"{shape}, turn long")
    # By the piece's number in its task too, so that the pieces of a repeated or null id don't meet in one task.
    dealt = pieces.repartition(partitions(df.sparkSession), F.xxhash64("id", "start", "turn"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "id", "start", "turn").drop("turn")
    return ordered.mapInArrow(_pack(size), f"{shape}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        ids = batch.column(at)
        flat, cuts = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(crc, pa.int64())], [*(batch.schema.names[i] for i in keep), "ids_crc32"]
        )


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32, of the ids as little-endian unsigned 32-bit, in the place of the ids."""
    shape = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes if n != "ids")
    return pieces.mapInArrow(_checksums, f"{shape}, ids_crc32 long")
