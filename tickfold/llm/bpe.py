"""Byte-level BPE: padded numpy matrices of equally long pieces, in which every row merges once a round."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, utf8

#: The rank of what doesn't merge, and the id of padding.
NONE, PAD = np.int32(2**31 - 1), np.int32(-1)
#: Longer pieces (bytes) are merged alone: a matrix of them would be mostly one row.
LONG = 256
#: Cells of a matrix, pieces and characters that a kernel holds at once.
CELLS, PIECES, CHARS = 1 << 20, 1 << 16, 1 << 20
#: Pieces (of 64 bytes at most) whose ids a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 100_000, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """What a pair of ids merges into: open addressing with linear probing in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = self._keys(left, right)
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[slots] < 0
            first = np.unique(slots[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[todo[put]], merged[todo[put]]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo, slots = todo[left_over], (slots[left_over] + 1) & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs in arrays of any one shape; ``NONE`` where they don't merge or one is padding."""
        keys = self._keys(left, right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(keys[todo])
        while len(todo):
            found = self.keys[slots]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (found >= 0)
            todo, slots = todo[on], (slots[on] + 1) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks of a file with a base64 token and its rank a line; every single byte must have one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, pairs = self.ranks.get, []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    pairs.append((a, b, rank))
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit."""
        out, buckets = {}, {}
        for piece in pieces:
            if (rank := self.ranks.get(piece)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[piece] = self._long(self.bytes[np.frombuffer(piece, np.uint8)]).astype("<u4").tobytes()
            else:
                buckets.setdefault(max(2, (len(piece) - 1).bit_length()), []).append(piece)
        for power, bucket in buckets.items():
            rows = max(1, CELLS >> power)
            for at in range(0, len(bucket), rows):
                part = bucket[at : at + rows]
                for rows_, ends, ids in self._matrix(part):
                    start = 0
                    for row, end in zip(rows_, ends):
                        out[part[row]] = ids[start:end]
                        start = end
        return out

    def _matrix(self, pieces: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes]]:
        """Rows that have ended, where each one's ids end, and all their ids. Each round every row merges its leftmost pair of least rank, so that
        each loses one cell and the matrix one column; rows without a pair leave it."""
        lengths = np.array([len(p) for p in pieces])
        cells = np.full((len(pieces), lengths.max(initial=1)), PAD, np.int32)
        cells[np.arange(cells.shape[1]) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, ranks = np.arange(len(pieces)), self.pairs.ranks(cells[:, :-1], cells[:, 1:])
        while len(rows):
            width = cells.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NONE)
            live = least < NONE
            if not live.all():
                done = cells[~live]
                held = done >= 0
                yield rows[~live].tolist(), (4 * held.sum(1).cumsum()).tolist(), done[held].astype("<u4").tobytes()
                if not live.any():
                    return
                rows, cells, ranks, at, least = rows[live], cells[live], ranks[live], at[live], least[live]
            each, column = np.arange(len(rows)), np.arange(width)
            cells[each, at] = least
            cells = cells[column != (at + 1)[:, None]].reshape(len(rows), width - 1)
            ranks = ranks[column[:-1] != at[:, None]].reshape(len(rows), width - 2)
            for before in (True, False):  # the pairs that the merged id is in
                has = at > 0 if before else at < width - 2
                p = at[has] - before
                ranks[each[has], p] = self.pairs.ranks(cells[each[has], p], cells[each[has], p + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """As a row of the matrix; a turn does as many rounds at once as leftmost order takes in a row: all pairs of
        the least rank from the left, up to one that makes a pair of lower rank."""
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) < NONE:
            hits = np.flatnonzero(ranks == least)
            starts = np.flatnonzero(np.diff(hits, prepend=-2) != 1)  # of runs, in which every other pair merges
            nth = np.arange(len(hits)) - np.repeat(starts, np.diff(np.append(starts, len(hits))))
            hits = hits[nth % 2 == 0]
            merged = np.full(len(hits), least, np.int32)
            left = np.where(hits > 0, ids[hits - 1], PAD)
            left[1:][np.diff(hits) == 2] = least
            right = np.where(hits + 2 < len(ids), ids[np.minimum(hits + 2, len(ids) - 1)], PAD)
            lower = (self.pairs.ranks(left, merged) < least) | (self.pairs.ranks(merged, right) < least)
            if lower.any():
                hits = hits[: lower.argmax() + 1]
            ids[hits] = least
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            place = hits - np.arange(len(hits))
            ids, ranks = ids[keep], ranks[np.delete(keep, 0)]  # a pair goes with its right id
            for p in (place - 1, place):
                p = p[(p >= 0) & (p < len(ids) - 1)]
                ranks[p] = self.pairs.ranks(ids[p], ids[p + 1])
        return ids

    def decode(self, ids: bytes) -> bytes | None:
        """None if the ids aren't whole 32-bit numbers, or one of them isn't in the file."""
        if len(ids) % 4:
            return None
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and (numbers.max() >= len(self.tokens) or any(not self.tokens[i] for i in np.unique(numbers))):
            return None
        return b"".join(b"".join(map(self.tokens.__getitem__, numbers[at : at + PIECES].tolist())) for at in range(0, len(numbers), PIECES))


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path or default_file()[0])


def default_file() -> tuple[str, str]:
    """Path and split pattern of the installed public 50k byte-level ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def other_classes() -> dict[str, str]:
    """Ranges of code points that ``regex`` counts as letters (L) or numbers (N) and ``tiktoken``, whose tables of
    Unicode are older, doesn't. Asked of both for all code points that Python's own table doesn't have yet."""
    young = [c for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) == "Cn"]
    found = {}
    for kind, start in (("L", "a"), ("N", "1")):
        named = regex.compile(rf"\p{{{kind}}}")
        asked = [c for c in young if named.match(c)]
        ranks = {bytes([b]): b for b in range(256)} | {(start + c).encode(): 256 + k for k, c in enumerate(asked)}
        probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{kind}}}+|.", mergeable_ranks=ranks, special_tokens={})
        differ = [ord(c) for c in asked if len(probe.encode_ordinary(start + c)) > 1]
        ends = [i for i, a in enumerate(differ) if i + 1 == len(differ) or differ[i + 1] != a + 1]
        firsts = [0, *(e + 1 for e in ends)]
        found[kind] = "".join(f"\\U{differ[a]:08x}-\\U{differ[e]:08x}" for a, e in zip(firsts, ends))
    return found


class Splitter:
    """Pieces of a text by ``pattern``, with the letters and numbers that ``tiktoken`` knows."""

    def __init__(self, pattern: str, other: dict[str, str]):
        self.plain, self.exact, ranges = regex.compile(pattern), None, "".join(other.values())
        if ranges:
            self.odd = re.compile(f"[{ranges}]")
            for kind, these in other.items():
                if these:
                    pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{these}]]")
            self.exact = regex.compile(pattern, regex.V1)

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of consecutive pieces; one list unless the text is very long."""
        found = self.exact if self.exact and not text.isascii() and self.odd.search(text) else self.plain
        if len(text) <= CHARS:
            yield found.findall(text)
            return
        pieces = (m[0] for m in found.finditer(text))
        while part := list(islice(pieces, PIECES)):
            yield part


def _encode(path: str | None, pattern: str, other: dict[str, str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split, known = vocabulary(path), Splitter(pattern, other), {}

        def ids(parts: list[list[str]]) -> list[bytes]:
            """Of each list of pieces; all that are new are encoded at once."""
            if new := [p for p in set().union(*parts) if p not in known]:
                written = [p.encode() for p in new]
                known.update(zip(new, map(vocab.encode_pieces(written).__getitem__, written)))
            out = [b"".join(map(known.__getitem__, part)) for part in parts]
            if len(known) > REMEMBERED:
                known.clear()
            else:
                for p in new:
                    if len(p) > REMEMBERED_BYTES:
                        del known[p]
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                read = [(t or b"").decode("utf-8", "replace") for t in utf8(batch, "text")]
                if len(read) > 1 or len(read[0]) <= CHARS:
                    coded = ids([next(split.parts(t)) for t in read])
                else:
                    coded = [b"".join(ids([part])[0] for part in split.parts(read[0]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], ["id", "ids"])

    return kernel


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``CHARS`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > CHARS:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def _decode(path: str | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, "ids"):
                at = batch.schema.get_field_index("ids")
                made = [None if v is None else vocab.decode(v) for v in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

    return kernel


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``df``: its id and ``ids``, the text's BPE ids as little-endian unsigned 32-bit integers, as
    ``tiktoken`` gives them without special tokens (whose strings are ordinary text).

    A text splits by ``pattern`` into pieces, each encoded by itself: whole if the file has it, else from bytes.
    Pieces go into padded matrices by length; pieces that a worker has met lately are looked up. Null and empty
    texts have no ids. A very long text is split as it is read, and a very long piece (blanks, letters without a
    space) is merged alone. Equal pairs go by place, leftmost first. Repeated rows and null ids stay; other
    columns aren't looked at; an empty table gives no row. Broken UTF-8 reads as U+FFFD.

    path, pattern: a file of ranks as ``tiktoken`` reads it and its split pattern; None: the installed public one.
    """
    base = texts(df, id_col, text_col)
    kernel = _encode(path, pattern or default_file()[1], other_classes())
    return base.mapInArrow(kernel, f"id {dict(base.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes that its ids stand for. Null ids, broken ones and ids that the file doesn't
    have give null. Existing columns stay, but one named decoded is replaced."""
    small_batches(df.sparkSession)
    base = df.drop("decoded").withColumnRenamed(ids_col, "ids")
    shape = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    return base.mapInArrow(_decode(path), f"{shape}, decoded binary").withColumnRenamed("ids", ids_col)


def token_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and ids_sha256 of each text, and decoded_sha256 of what its ids decode to."""
    return decode_ids(encode_texts(df, id_col, text_col)).select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
