"""A trie of conversations' prefixes. The smallest member of a node owns it; as members of deeper nodes are members
of those above, a conversation owns a suffix of its path, and one group-by of prefixes has every sum of a subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Turns of the base conversation that a rebuilt one begins with are fewer than this.
HEADS = 6
#: Conversations whose base is the same.
FAMILY = 100
#: Ids that go into one piece of text before it is hashed.
ENDS = 4096


def _lanes(*parts: Column) -> list[Column]:
    """120 bits of a SHA-256 as two longs."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def ordered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, content, tokens, block): each turn with its place from 1 in its conversation.

    Turns are dealt by ranges of (conversation, turn), so that a very long conversation is in several blocks;
    places within blocks and the blocks' counts give places. The texts stay where they were read: a turn goes
    on as the digest of its role and text, and its code points. Turns that tie are in the order of their digests.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("content"),
        F.length(text).cast("long").alias("tokens"),
    )
    order = [F.col("turn").asc_nulls_first(), "content"]
    dealt = turns.repartitionByRange(partitions(df.sparkSession), "conv", *order).withColumn("block", F.spark_partition_id())
    dealt = written(dealt)  # blocks must be the same wherever they are read
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    ahead = _ahead(dealt.groupBy("conv", "block").agg(F.count("*").alias("n")), "n")
    placed = dealt.withColumn("place", F.row_number().over(inside).cast("long"))
    return placed.join(ahead, ["conv", "block"]).select("conv", (F.col("place") + F.col("n_ahead")).alias("place"), "content", "tokens", "block")


def _ahead(blocks: DataFrame, *sums: str, xors: tuple[str, ...] = ()) -> DataFrame:
    """Totals of the blocks before each block of a conversation."""
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    made = [(c, F.sum(c)) for c in sums] + [(c, F.bit_xor(c)) for c in xors]
    return blocks.select("conv", "block", *(F.coalesce(f.over(before), F.lit(0)).alias(f"{c}_ahead") for c, f in made))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, hi, lo, tokens, before, up_hi, up_lo, ends): a row for each conversation and depth from 0.

    A conversation is rebuilt from the first h turns of its base and its own after its first h. (hi, lo) are 120 bits
    that stand for the turns so far: the exclusive or of digests of (depth, turn), so that they add up over blocks
    in any order. Different prefixes of n in all meet by a chance of about n^2 / 2^121; they aren't meant
    to withstand made-up texts. before: code points above; up: the bits of the node above; ends: its last depth.
    """
    conv = F.col("conv")
    held = F.crc32(conv.cast("string").cast("binary")) % HEADS
    base = (conv - conv % FAMILY).alias("base")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size")).withColumns({"h": held, "base": base})
    heads = turns.where((F.col("place") < HEADS) & (conv % FAMILY == 0)).select(F.col("conv").alias("base"), "place", "content", "tokens")
    first = heads.groupBy("base").agg(F.count("*").alias("n_heads"))
    known = sizes.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_heads", F.lit(0))))
    known = written(known.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("last")))
    taken = known.join(heads, "base").where(F.col("place") <= F.col("taken")).select("conv", F.lit(-1).alias("block"), F.col("place").alias("depth"), "content", "tokens")
    own = turns.join(known.select("conv", "h", "taken"), "conv").where(F.col("place") > F.col("h"))
    own = own.select("conv", "block", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "content", "tokens")
    parts = taken.unionByName(own)
    hi, lo = _lanes(F.hex("content"), F.col("depth").cast("string"))
    parts = written(parts.select("conv", "block", "depth", "tokens", hi.alias("own_hi"), lo.alias("own_lo")))
    ahead = _ahead(
        parts.groupBy("conv", "block").agg(F.sum("tokens").alias("tokens"), *(F.bit_xor(c).alias(c) for c in ("own_hi", "own_lo"))),
        "tokens", xors=("own_hi", "own_lo"),
    )
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select(
        "conv", "block", "depth", "tokens", "own_hi", "own_lo",
        F.sum("tokens").over(inside).alias("through"), *(F.bit_xor(f"own_{c}").over(inside).alias(f"to_{c}") for c in ("hi", "lo")),
    ).join(ahead, ["conv", "block"])
    lanes = [F.col(f"to_{c}").bitwiseXOR(F.col(f"own_{c}_ahead")).alias(c) for c in ("hi", "lo")]
    above = [F.col(f"to_{c}").bitwiseXOR(F.col(f"own_{c}_ahead")).bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in ("hi", "lo")]
    run = run.withColumn("before", F.col("through") + F.col("tokens_ahead") - F.col("tokens"))
    run = run.select("conv", "depth", *lanes, "tokens", "before", *above)
    nothing = F.lit(0).cast("long")
    roots = known.select("conv", nothing.alias("depth"), *(nothing.alias(c) for c in ("hi", "lo", "tokens", "before", "up_hi", "up_lo")))
    return run.unionByName(roots).join(known.select("conv", "last"), "conv").withColumn("ends", F.col("depth") == F.col("last")).drop("last")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv) rows as pieces of at most ENDS ids joined by commas."""
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        out, start = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][:2] != rows[start][:2] or k - start == ENDS:
                out.append((*rows[start], ",".join(str(r[2]) for r in rows[start:k])))
                start = k
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come sorted; only the state of one hash is held."""
    node, state = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                yield made()
            node, state = (owner, depth), hashlib.sha256(ids.encode())
    if node is not None:
        yield made()


def _ends(ending: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of nodes at which conversations end. Sorted ranges become pieces of text, so that
    a node where very many end is spread; only the pieces meet, and most nodes have one."""
    n = partitions(ending.sparkSession)
    keys = ["owner", "depth", "conv"]
    ranges = ending.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    pieces = ranges.mapInArrow(_pieces, "owner long, depth long, first long, ids string")
    met = pieces.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return met.mapInArrow(_hashed, "owner long, depth long, ends_sha256 string")


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations, as (conv_id, depth) with parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    A node's subtree saves (n_convs - 1) times the code points of each node's last text: the code points that its
    members have below, less those of nodes they own. What member c owns begins at a depth and takes all
    deeper ones, so its share is the code points from the node down to there: a difference of running sums. So one
    group-by, combined before the shuffle, has a node's members, children, leaves and savings, whatever its size.

    Ids are whole numbers. Null roles and texts are empty texts. Turns without an id are left out; equal turns of
    one conversation follow each other in the order of their content, and repeated rows are turns as others are.
    No turns give no nodes. Very long texts count and are hashed where they are read. Other columns are not looked at.
    """
    paths = written(rebuilt_paths(ordered_turns(df.select(id_col, turn_col, role_col, text_col), id_col, turn_col, role_col, text_col)))
    node = ["depth", "hi", "lo"]
    owners = paths.groupBy(*node).agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.count_if("ends").alias("n_ends"), F.min("before").alias("before"))
    owners = written(owners)
    # Where each owner's part of its path begins, and whether a leaf is in it.
    owned = owners.groupBy(F.col("owner").alias("conv")).agg(
        F.min("depth").alias("from"), F.min("before").alias("from_before"), F.max((F.col("n") == F.col("n_ends")).cast("long")).alias("leaf")
    )
    below = F.coalesce("from_before", "whole")
    whole = paths.where("ends").select("conv", F.col("depth").alias("last"), (F.col("before") + F.col("tokens")).alias("whole"))
    state = written(whole.join(owned, "conv", "left").select("conv", "last", "from", F.coalesce("leaf", F.lit(0)).alias("leaf"), below.alias("below")))
    deeper = (F.col("from") <= F.col("depth") + 1) & (F.col("depth") < F.col("last"))
    summed = paths.join(state, "conv").groupBy(*node).agg(
        F.min("conv").alias("owner"),
        F.min("up_hi").alias("up_hi"),
        F.min("up_lo").alias("up_lo"),
        F.count("*").alias("n_convs"),
        F.count_if(deeper).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("below") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    up = owners.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("owner").alias("up_owner"))
    ending = paths.where("ends").join(owners.select(*node, "owner"), node).select("conv", "depth", "owner")
    none = hashlib.sha256(b"").hexdigest()
    return (
        summed.join(up, ["depth", "up_hi", "up_lo"], "left")
        .join(_ends(ending), ["owner", "depth"], "left")
        .select(
            F.col("owner").alias("conv_id"), "depth", F.col("up_owner").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def oracle() -> str:
    """SQL for DuckDB. It has no crc32, so each of the decimal digits' bits goes through the polynomial."""
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295::bigint)"
    return f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p,
  coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
i as (select c, {crc} % {HEADS} as h from (select distinct c from t)),
o as (select c, row_number() over (partition by c order by q) as d, r, x from (
  select i.c, p as q, r, x from i join t on t.c = i.c - i.c % {FAMILY} and p <= h union all
  select i.c, {HEADS} + p, r, x from i join t on t.c = i.c and p > h)),
k as (select c, d, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '' order by d) over (partition by c order by d)) as k, length(x) as w from o
  union all select c, 0, '', 0 from i),
l as (select *, coalesce(lag(k) over (partition by c order by d), '') as up, max(d) over (partition by c) as last from k),
n as (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(w) as w, any_value(up) as up, string_agg(c::varchar, ',' order by c) filter (d = last) as ends from l group by 1, 2),
ch as (select d - 1 as d, up as k, count(*) as n_children from n where d > 0 group by 1, 2),
a as (select distinct v.d, v.k, u.d as ud, u.k as uk from l v join l u on u.c = v.c and u.d >= v.d),
s as (select a.d, a.k, sum((n.n_convs - 1) * n.w) as saved, count(*) filter (ch.k is null) as leaves
  from a join n on n.d = ud and n.k = uk left join ch on ch.d = ud and ch.k = uk group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) as n_children, s.leaves as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from n join s using (d, k) left join ch using (d, k) left join n p on p.d = n.d - 1 and p.k = n.up"""
