"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its word n-grams, as 64-bit hashes. All n-grams get one global order:
by document frequency (in powers of two), rare ones first, then by hash.

1.  Frequencies: n-grams are dealt by hash range, so a frequent n-gram or a hot source is no hot key;
    rows are blocks of many documents' n-grams. Equal sets count once.
2.  A document's n-grams that no other set has can't be shared. Where the rest is too small for any
    partner to reach the threshold, the document is done; only the others go on.
3.  Candidates share an n-gram of their prefixes, the first ``n - ceil(t n) + 1`` in the global order.
    A list of documents with one prefix n-gram isn't expanded to pairs: in each of a few rounds, its
    members are tried against one leader and the likeliest of their neighbours in an order, and all that
    are connected get one label. What then is left, pairs of different labels, is tried in full, so no
    link between components is lost. A pair need only be made at its first common n-gram; all before it
    differ. So each row has the parity bitmap of its n-grams from there on, and pairs that the places
    and the bitmaps rule out aren't made: few pairs come from more than one list.
4.  Pairs are verified exactly: the global order is cut into fragments of about equal weight, the
    overlap of a pair is counted in each fragment separately, and the counts are summed.

Hot n-grams, which very many documents have, aren't counted in one place: they are found by block sums
and stand last in the order. Lists longer than ``LIST`` are dealt in parts, in the full turn in pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, by_group, partitions, sized, texts, utf8, written
from .graph import connected_components

U64 = np.uint64
FACTOR = U64(0x9E3779B97F4A7C15)
#: Tokens of one block of documents, pairs that are tried at once, and words whose hashes are kept; they bound
#: a task's memory.
BLOCK_TOKENS, BLOCK_PAIRS, KEPT_WORDS = 500_000, 1_000_000, 40_000
#: An n-gram with so many occurrences in a block is a candidate for a hot one; those with so many in all, and more
#: than one in ``HOT_SHARE`` of all, are hot. So at most ``HOT_SHARE`` are.
HOT_IN_BLOCK, HOT_IN_ALL, HOT_SHARE, HOT_RANK = 64, 10_000, 50_000, 63
#: Members of a list that one task takes, rows that a task holds at once, and neighbours that a member is compared with.
LIST, HELD_ROWS, NEAR = 8_192, 200_000, 24


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ngram_set(text: bytes | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ``text``; a shorter text is one n-gram of its own length.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at space and 0x09-0x0D, as asked for.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, U64)
    each = np.fromiter(map(words.__getitem__, parts), U64, len(parts))
    width = min(n, len(each))
    count = len(each) - width + 1
    h = each[:count] + U64(width)
    for j in range(1, width):
        h = h * FACTOR + each[j : j + count]
    h = np.sort(mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _range_of(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit values."""
    return ((x >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def _often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    token, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, U64), np.empty(0, int))
    return token[count >= HOT_IN_BLOCK], count[count >= HOT_IN_BLOCK]


def _documents(n: int):
    """Each document's set size and key; and of each block its frequent n-grams, with the count below 0 as size."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, held = Cache(xxhash.xxh3_64_intdigest, KEPT_WORDS), [], 0
        kind = None

        def frequent() -> pa.RecordBatch:
            token, count = _often(block)
            return pa.RecordBatch.from_arrays([pa.nulls(len(token), kind), pa.array(-count, pa.int64()), pa.array(_signed(token), pa.int64())], ["id", "n", "key"])

        for batch in batches:
            sizes, keys, kind = [], [], batch.schema.types[0]
            for text in utf8(batch, "text"):
                h = ngram_set(text, n, words)
                sizes.append(len(h))
                keys.append(np.int64(U64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)) if len(h) else None)
                block.append(h)
                held += len(h)
                if held > BLOCK_TOKENS:
                    yield frequent()
                    block, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["id", "n", "key"]
            )
        if held:
            yield frequent()

    return kernel


def _blocks(n: int, ranges: int, hot: np.ndarray):
    """Blocks of n-grams, one row for each block of documents and hash range; hot n-grams go by their
    documents' keys, to numbers from ``ranges`` on."""

    def rows(sets: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        lens, keys = np.array([len(s) for s in sets]), np.array(keys, U64)
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
        at = _range_of(token, ranges)
        if len(hot):
            found = hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token
            at[found] = ranges + _range_of(keys[owner[found]], ranges)
        order = np.argsort(at, kind="stable")
        token, owner, at = token[order], owner[order], at[order]
        cell = at.astype(np.int64) * len(sets) + owner
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        count = np.diff(np.append(first, len(cell))).astype(np.uint32)
        key = keys[owner[first]]
        here, starts = np.unique(at, return_index=True)
        ends, lo = np.append(starts[1:], len(at)), np.searchsorted(first, starts)
        hi = np.append(lo[1:], len(first))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(here, pa.int32()),
                pa.array([token[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([key[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
                pa.array([count[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary()),
            ],
            ["at", "tokens", "keys", "counts"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Cache(xxhash.xxh3_64_intdigest, KEPT_WORDS)
        sets, keys, held, seen = [], [], 0, set()
        for batch in batches:
            for text in utf8(batch, "text"):
                h = ngram_set(text, n, words)
                key = xxhash.xxh3_64_intdigest(h.tobytes())
                if not len(h) or key in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                sets.append(h)
                keys.append(key)
                held += len(h)
                if held > BLOCK_TOKENS:
                    yield rows(sets, keys)
                    sets, keys, held = [], [], 0
        if sets:
            yield rows(sets, keys)

    return kernel


def _joined(batches: list[pa.RecordBatch], name: str, kind) -> np.ndarray:
    found = [x for b in batches for x in b.column(b.schema.get_field_index(name)).to_pylist()]
    return np.frombuffer(b"".join(found), kind)


def _frequencies(parts: int):
    """Of one hash range at a time: n-grams that two or more different sets have, dealt by document. Hot
    ones, whose numbers are ``parts`` or more, all have one rank."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, run in by_group(batches, "at"):
            key, count = _joined(run, "keys", U64), _joined(run, "counts", np.uint32)
            token = _joined(run, "tokens", U64)
            del run
            first = np.zeros(len(key), bool)
            first[np.unique(key, return_index=True)[1]] = True
            place = np.repeat(np.arange(len(key), dtype=np.int32), count)  # of the owner
            if not first.all():
                keep = first[place]
                token, place = token[keep], place[keep]
            if at >= parts:
                owner, rank = key[place], np.full(len(token), HOT_RANK, np.uint8)
            else:
                order = np.argsort(token, kind="stable")
                token, place = token[order], place[order]
                del order
                starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                df = np.diff(np.append(starts, len(token)))
                rank = np.repeat(np.floor(np.log2(df)).astype(np.uint8), df)
                shared = np.flatnonzero(rank)
                token, owner, rank = token[shared], key[place[shared]], rank[shared]
                del starts, df, shared
            del place
            to = _range_of(owner, parts)
            order = np.argsort(to, kind="stable")
            token, owner, rank, to = token[order], owner[order], rank[order], to[order]
            here, lo = np.unique(to, return_index=True)
            cut = list(zip(lo, np.append(lo[1:], len(to))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(here, pa.int32())]
                + [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (owner, token, rank)],
                ["to", "owners", "tokens", "ranks"],
            )

    return kernel


def _sizes(parts: int):
    """The documents' set sizes, dealt as the n-grams are; without ranks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (np.asarray(batch.column(i)) for i in (0, 1))
            to = _range_of(key.view(U64), parts)
            here = np.unique(to)
            yield pa.RecordBatch.from_arrays(
                [pa.array(here, pa.int32())]
                + [pa.array([x[to == p].tobytes() for p in here], pa.binary()) for x in (key, n)]
                + [pa.array([None] * len(here), pa.binary())],
                ["to", "owners", "tokens", "ranks"],
            )

    return kernel


def _open(percent: int):
    """Documents whose shared n-grams could reach the threshold with some partner, in global order."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in by_group(batches, "to"):
            sizes = [b.filter(b.column(3).is_null()) for b in run]
            tokens = [b.filter(b.column(3).is_valid()) for b in run]
            key, at = np.unique(_joined(sizes, "owners", U64), return_index=True)
            if not len(key):
                continue
            n_of = _joined(sizes, "tokens", np.int64)[at]
            owner, token, rank = _joined(tokens, "owners", U64), _joined(tokens, "tokens", U64), _joined(tokens, "ranks", np.uint8)
            if not len(owner):
                continue
            order = np.lexsort((token, rank, owner))
            owner, token, rank = owner[order], token[order], rank[order]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            ends = np.append(starts[1:], len(owner))
            n, shared = n_of[np.searchsorted(key, owner[starts])], ends - starts
            go = np.flatnonzero(shared >= (percent * n + 99) // 100)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed(owner[starts[go]]), pa.int64()),
                    pa.array(n[go], pa.int64()),
                    pa.array(shared[go], pa.int64()),
                    pa.array([token[starts[i] : ends[i]].tobytes() for i in go], pa.binary()),
                    pa.array([rank[starts[i] : ends[i]].tobytes() for i in go], pa.binary()),
                ],
                ["key", "n", "shared", "tokens", "ranks"],
            )

    return kernel


#: Bits of a parity bitmap, and its 64-bit columns.
PARITY = 512
PARITY_COLUMNS = [f"p{i}" for i in range(PARITY // 64)]


def flips(token: np.ndarray) -> np.ndarray:
    """The one bit of a parity bitmap that each n-gram flips. Two sets differ in as many n-grams at least as
    the bitmaps of their n-grams differ in bits."""
    bit = (token >> U64(32)) % U64(PARITY)
    out = np.zeros((len(token), PARITY // 64), U64)
    out[np.arange(len(token)), (bit >> U64(6)).astype(np.int64)] = U64(1) << (bit & U64(63))
    return out


def parity(token: np.ndarray) -> np.ndarray:
    found = np.zeros(PARITY // 64, U64)
    for at in range(0, len(token), BLOCK_TOKENS):
        found ^= np.bitwise_xor.reduce(flips(token[at : at + BLOCK_TOKENS]), axis=0)
    return found


PREFIX_COLUMNS = ["token", "key", "n", "shared", "place", *PARITY_COLUMNS]


def _prefixes(percent: int):
    """Each document's prefix n-grams with their places and the bitmap of all n-grams from there on."""

    def rows(key: int, n: int, token: np.ndarray) -> Iterator[np.ndarray]:
        left, first = parity(token), len(token) - (percent * n + 99) // 100 + 1
        for at in range(0, first, HELD_ROWS):
            some = token[at : min(first, at + HELD_ROWS)]
            gone = np.bitwise_xor.accumulate(flips(some), axis=0)
            bits = left ^ np.concatenate([np.zeros((1, PARITY // 64), U64), gone[:-1]])
            left = left ^ gone[-1]
            place = n - len(token) + at + np.arange(len(some))
            each = [_signed(some), np.full(len(some), key), np.full(len(some), n), np.full(len(some), len(token)), place]
            yield np.column_stack([*each, bits.view(np.int64)])

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(held).T], PREFIX_COLUMNS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held, size = [], 0
            for key, n, tokens in zip(*(whole.column(i).to_pylist() for i in (0, 1, 3))):
                for some in rows(key, n, np.frombuffer(tokens, U64)):
                    held.append(some)
                    size += len(some)
                    if size >= HELD_ROWS:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

    return kernel


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists, at least ``HELD_ROWS`` rows or the rest at once; batches are sorted by (token, part)."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {x: np.asarray(batch.column(i)) for i, x in enumerate(batch.schema.names)}
        if size >= HELD_ROWS:
            last = held[-1]["token"][-1], held[-1]["part"][-1]
            cut = int(np.argmax((now["token"] != last[0]) | (now["part"] != last[1])))
            if cut or now["token"][0] != last[0] or now["part"][0] != last[1]:
                held.append({k: v[:cut] for k, v in now.items()})
                yield {k: np.concatenate([h[k] for h in held]) for k in now}
                held, size, now = [], 0, {k: v[cut:] for k, v in now.items()}
        held.append(now)
        size += len(now["token"])
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _candidates(percent: int, turn: int | None, within: bool = False):
    """Pairs of one prefix n-gram and different labels that the threshold doesn't rule out.

    turn: each member with its list's leader and with the likeliest of ``NEAR`` members before it, in an
    order of the turn's own (0: by label); None: all, in parts of one list only those of different sides.
    within: pairs of one label too.
    """

    def tried(col: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that remain of (a, b), and how many n-grams they have beyond twice the overlap needed, at most."""
        na, nb = col["n"][a], col["n"][b]
        need = -((-percent * (na + nb)) // (100 + percent))
        sa, sb = na - col["place"][a], nb - col["place"][b]  # n-grams from here on
        ok = (np.minimum(sa, sb) >= need) & (col["key"][a] != col["key"][b])
        if not within:
            ok &= col["comp"][a] != col["comp"][b]
        ok &= (col["side"][a] == 0) | (col["side"][a] != col["side"][b])
        ok = np.flatnonzero(ok)
        a, b = a[ok], b[ok]
        slack = sa[ok] + sb[ok] - 2 * need[ok]
        for p in PARITY_COLUMNS:
            slack = slack - np.bitwise_count((col[p][a] ^ col[p][b]).view(U64))
        fits = np.flatnonzero(slack >= 0)
        return a[fits], b[fits], slack[fits]

    def batch(col: dict[str, np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (col["key"][np.concatenate([f[i] for f in found])] for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i], pa.int64()) for i in (0, 1)], ["a", "b"])

    def some(col: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.repeat(start, end - start)
        rows = np.arange(len(first))
        i = np.flatnonzero(rows > first)
        found = [tried(col, first[i], i)[:2]]
        best, partner = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        for back in range(1, NEAR + 1):
            i = np.flatnonzero(rows - back >= first)
            a, b, slack = tried(col, i - back, i)
            better = slack > best[b]
            best[b[better]], partner[b[better]] = slack[better], a[better]
        i = np.flatnonzero(best >= 0)
        yield batch(col, [*found, (partner[i], i)])

    def full(col: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.arange(end[-1])
        past = rows + 1  # where a member's partners start
        if not within:
            run = np.flatnonzero(np.concatenate(([True], (col["comp"][1:] != col["comp"][:-1]) | np.isin(rows[1:], start))))
            past = np.repeat(np.append(run[1:], len(rows)), np.diff(np.append(run, len(rows))))
        todo = np.repeat(end, end - start) - past
        mine, found, size = np.flatnonzero(todo), [], 0
        total, at = np.cumsum(todo[mine]), 0
        while at < len(mine):  # so many pairs at a time; those of one member at least
            base = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, base + BLOCK_PAIRS, "right")))
            i, k = mine[at:upto], todo[mine[at:upto]]
            partner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(past[i], k)
            found.append(tried(col, np.repeat(i, k), partner)[:2])
            size += len(found[-1][0])
            if size > BLOCK_PAIRS:
                yield batch(col, found)
                found, size = [], 0
            at = upto
        if size:
            yield batch(col, found)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _lists(batches):
            by = mixed(col["key"].view(U64) ^ U64(turn)) if turn else col["comp"]
            order = np.lexsort((by, col["part"], col["token"]))
            col = {k: v[order] for k, v in col.items()}
            new = (col["token"][1:] != col["token"][:-1]) | (col["part"][1:] != col["part"][:-1])
            start = np.flatnonzero(np.concatenate(([True], new)))
            end = np.append(start[1:], len(order))
            yield from (full if turn is None else some)(col, start, end)

    return kernel


def _dealt(prefix: DataFrame, long: DataFrame | None, parts: int, full: bool) -> DataFrame:
    """Lists dealt to tasks: (token, part) and the side in a pair of parts. ``long``: (token, pieces) of long lists."""
    if long is None:
        rows = prefix.withColumns({"part": F.lit(0), "side": F.lit(0)})
    else:
        rows = prefix.join(long, "token", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        mine = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
        if full:  # a member meets the others of its piece, and every other piece
            other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
            rows = rows.withColumn("mine", mine).withColumn("other", other)
            part = F.least("mine", "other").cast("long") * F.col("pieces") + F.greatest("mine", "other")
            rows = rows.withColumns({"part": part, "side": F.signum(F.col("other") - F.col("mine")).cast("int")}).drop("mine", "other")
        else:
            rows = rows.withColumns({"part": mine, "side": F.lit(0)})
    rows = rows.select(*PREFIX_COLUMNS, "comp", F.col("part").cast("long").alias("part"), F.col("side").cast("int").alias("side"))
    return rows.repartition(parts, "token", "part").sortWithinPartitions("token", "part")


#: The global order's cells: a rank and one of so many hash ranges.
CELLS = 16


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        token, rank = _joined([batch], "tokens", U64), _joined([batch], "ranks", np.uint8)
        cell, count = np.unique(rank.astype(np.int64) * CELLS + _range_of(token, CELLS), return_counts=True)
        for c, k in zip(cell.tolist(), count.tolist()):
            total[c] = total.get(c, 0) + k
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["cell", "count"])


def _segments(pivots: list[int]):
    """Each document's n-grams cut at the pivots, one row a fragment."""
    cuts = np.array(pivots)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, n, tokens, ranks in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                token = np.frombuffer(tokens, U64)
                cell = np.frombuffer(ranks, np.uint8).astype(np.int64) * CELLS + _range_of(token, CELLS)
                part = np.searchsorted(cuts, cell, "right")
                out += [(key, n, int(p), _signed(token[part == p])) for p in np.unique(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))],
                ["key", "n", "fragment", "tokens"],
            )

    return kernel


def linked_pairs(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the threshold, by partial overlaps of each fragment; with the sizes
    of both, na and nb, and the overlap k."""
    x = segments.select(F.col("key").alias("a"), F.col("n").alias("na"), "fragment", F.col("tokens").alias("ta"))
    y = segments.select(F.col("key").alias("b"), F.col("n").alias("nb"), "fragment", F.col("tokens").alias("tb"))
    partial = pairs.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("k"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return whole.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k")))


class _Join:
    """What a join of ``df`` with itself has read, written and dealt: sets, prefixes and fragments."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, percent: int, fragments: int):
        spark = df.sparkSession
        self.spark, self.percent, self.parts = spark, percent, partitions(spark)
        parts, base = self.parts, texts(df, id_col, text_col)
        read = written(base.mapInArrow(_documents(n), f"id {dict(base.dtypes)['id']}, n long, key long"))
        self.docs = read.where("n >= 0")
        tokens = read.agg(F.sum(F.when(F.col("n") > 0, F.col("n")))).first()[0] or 0
        least = max(HOT_IN_ALL, tokens // HOT_SHARE + 1)
        often = read.where("n < 0").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") <= -least)
        hot = np.sort(np.array([r[0] for r in often.select("key").collect()], np.int64).view(U64))  # at most HOT_SHARE
        blocks = base.select("text").where("text is not null").mapInArrow(_blocks(n, parts, hot), "at int, tokens binary, keys binary, counts binary")
        dealt = blocks.repartition(parts, "at").sortWithinPartitions("at")
        shape = "to int, owners binary, tokens binary, ranks binary"
        shared = dealt.mapInArrow(_frequencies(parts), shape)
        sizes = self.docs.where("n > 0").select("key", "n").mapInArrow(_sizes(parts), shape)
        to = shared.unionByName(sizes).repartition(parts, "to").sortWithinPartitions("to")
        live = written(to.mapInArrow(_open(percent), "key long, n long, shared long, tokens binary, ranks binary"))

        counted = live.mapInArrow(_cells, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count"))
        cells = sorted(counted.collect())  # at most 64 ranks x CELLS rows
        self.empty = not cells
        if cells:
            share, done, pivots = sum(c for _, c in cells) / fragments, 0, []
            for cell, count in cells:
                if done + count > share * (len(pivots) + 1) and len(pivots) < fragments - 1 and done:
                    pivots.append(cell)
                done += count
            self.segments = live.mapInArrow(_segments(pivots), "key long, n long, fragment int, tokens array<bigint>")
            self.prefix = written(live.mapInArrow(_prefixes(percent), ", ".join(f"{c} long" for c in PREFIX_COLUMNS)))
            size = self.prefix.groupBy("token").count().where(F.col("count") > LIST)
            long = written(size.select("token", F.ceil(F.col("count") / LIST).cast("int").alias("pieces")))
            self.long = None if long.isEmpty() else sized(long)

    def links(self, turn: int | None, comps: DataFrame | None, within: bool = False) -> DataFrame:
        if comps is None:
            known = self.prefix.withColumn("comp", F.col("key"))
        else:
            known = self.prefix.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        dealt = _dealt(known, self.long, self.parts, turn is None)
        pairs = dealt.mapInArrow(_candidates(self.percent, turn, within), "a long, b long")
        return written(linked_pairs(pairs.distinct(), self.segments, self.percent))


def ngram_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, rounds: int = 2, fragments: int = 4
) -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id, and class_id, which equal sets share.

    Two texts link when ``100 * intersection >= percent * union`` of their n-gram sets, percent being
    1 to 100. component_id is the smallest id reachable by links. Null and wordless texts have no
    n-grams and link with nothing, so component_id is their own id. A null id stays null, doesn't
    count as smallest, and gets its component's id if that has any. Repeated rows all stay. A very long
    text is one set, which a task holds at once. Other columns are not looked at, so their names don't
    matter. An empty table gives an empty one.
    """
    join = _Join(df, id_col, text_col, n, percent, fragments)
    comps = None
    for turn in [*range(rounds), None]:
        if join.empty:
            break
        fresh = join.links(turn, comps).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if fresh.isEmpty():
            continue
        # what is connected already goes on as one star a component
        edges = fresh if comps is None else fresh.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")))
        comps = connected_components(edges)
    if comps is None:
        comps = join.spark.createDataFrame([], "node long, comp long")
    grouped = join.docs.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = grouped.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    return grouped.join(least, "comp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.col("key").alias("class_id")
    )


def ngram_links(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, fragments: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: class_a < class_b, sizes n_a and n_b, overlap, of all linked pairs of different
    sets. members: id, n_shingles, class_id, n_links (the links of its class) of each row, as in ``ngram_components``.

    A group of m different texts that are all linked has m (m - 1) / 2 links, and this gives them all;
    use ``ngram_components`` where only groups are asked for.
    """
    join = _Join(df, id_col, text_col, n, percent, fragments)
    shape = "class_a long, class_b long, n_a long, n_b long, overlap long"
    links = join.spark.createDataFrame([], shape) if join.empty else join.links(None, None, within=True).toDF("class_a", "class_b", "n_a", "n_b", "overlap")
    ends = links.select(F.col("class_a").alias("key")).unionByName(links.select(F.col("class_b").alias("key")))
    members = join.docs.join(ends.groupBy("key").agg(F.count("*").alias("n_links")), "key", "left")
    return links, members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with one document of each component, that of the smallest id; all columns stay.

    Rows of null ids stay, as nothing tells them apart. Of rows that repeat the kept id, one stays.
    """
    found = written(ngram_components(df, id_col, text_col, **how))
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    kept = df.join(sized(gone), id_col, "left_anti")
    again = written(again)
    if not again.isEmpty():
        once = kept.join(sized(again), id_col, "left_semi").dropDuplicates([id_col])
        kept = kept.join(sized(again), id_col, "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in df.columns))
