"""Benchmark decontamination with DataFrame functions only.

A benchmark item's windows are its runs of ``width`` words (a shorter item is one window). Wherever such
a window of L words occurs in a document, it covers a whole block of B = (L + 1) div 2 words that starts
at a multiple of B. So only one block in B words is hashed; a small bit set, held against all of them
first, lets few pass; those meet the broadcast hash set of the windows' blocks; and around each match the
windows' words are compared themselves. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, fresh, sized

#: Bits of the first test; a benchmark of many more windows only lets more blocks pass it.
BITS = 1 << 16
#: Benchmark windows up to this number are broadcast (under 200 bytes each); more are joined by shuffle.
MOST_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    """The lower-cased words; none for null."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _block(length: int) -> int:
    return (length + 1) // 2


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, length, words) of all distinct windows."""
    length = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    each = items.where(F.size("words") > 0).select("item_id", length.alias("length"), "words", F.explode(starts).alias("at"))
    return each.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("words")).distinct()


def _passing(words: Column, length: int, bits: Column) -> Column:
    """Of the aligned blocks of ``words`` for windows of this length, those whose bit is set, with the
    words around them that such a window can cover."""
    size = _block(length)

    def hashed(k: Column) -> Column:
        return F.xxhash64(F.slice(words, k * size + 1, F.lit(size)))

    def known(k: Column) -> Column:
        bit = F.pmod(hashed(k), F.lit(BITS))
        word = F.element_at(bits, F.floor(bit / 64).cast("int") + 1)
        return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def near(k: Column) -> Column:
        first = F.greatest(k * size - (length - size), F.lit(0))
        around = F.slice(words, first + 1, k * size + length - first)
        return F.struct(F.lit(length).alias("length"), first.alias("at"), hashed(k).alias("h"), around.alias("near"))

    last = F.floor(F.size(words) / size).cast("int")
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, known), near)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10
) -> DataFrame:
    """Per row of ``docs``: id, n_words, hits (sorted array of structs start, length, item_id: each
    occurrence of a window, starts from 0), copies (how many rows have this id and text; one row stands
    for them), row_key.

    Null and wordless texts have no words and no hits, and null or wordless items no windows. Other
    columns are not looked at; benchmark has item_id and text.
    """
    windows = _windows(benchmark.select("item_id", words_of(F.col("text")).alias("words")), width)
    lengths = sorted((r[0], r[1]) for r in windows.groupBy("length").count().collect())  # width rows at most
    small = sum(n for _, n in lengths) <= MOST_BROADCAST
    sent = F.broadcast if small else (lambda x: x)

    words = F.col("words")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.select("id", F.xxhash64("id", "text").alias("row_key"), words_of(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    none = "array<struct<length:int,at:int,h:bigint,near:array<string>>>"
    found = [F.array().cast(none)]
    blocks = None
    for length, _ in lengths:
        size = _block(length)
        parts = F.sequence(F.lit(1), F.lit(length - size + 1))
        own = windows.where(F.col("length") == length).select(
            F.explode(F.transform(parts, lambda i: F.xxhash64(F.slice("words", i, size)))).alias("h")  # noqa: B023
        )
        own = own.distinct()
        blocks = own.withColumn("length", F.lit(length)) if blocks is None else blocks.unionByName(own.withColumn("length", F.lit(length)))
        set_bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) % 64 as int))"))
        rows = dict(own.groupBy(F.expr(f"cast(pmod(h, {BITS}) div 64 as int)").alias("i")).agg(set_bits.alias("b")).collect())
        bits = F.array(*(F.lit(rows.get(i, 0)).cast("bigint") for i in range(BITS // 64)))  # a constant

        found.append(_passing(words, length, bits).cast(none))
    marker = F.array(F.lit(None).cast("struct<length:int,at:int,h:bigint,near:array<string>>"))
    tried = base.select("id", "row_key", "n_words", F.explode(F.concat(marker, *found)).alias("c"))
    rows = tried.where("c is null").groupBy("id", "row_key", "n_words").agg(F.count("*").alias("copies"))
    shape = "array<struct<start:int,length:int,item_id:" + dict(benchmark.dtypes)["item_id"] + ">>"
    if blocks is None:
        return rows.select("id", "row_key", "n_words", "copies", F.array().cast(shape).alias("hits")).withColumnRenamed("id", id_col)

    flat = tried.select("id", "row_key", "n_words", "c.*")
    met = flat.join(sent(blocks.withColumn("met", F.lit(True))), ["h", "length"], "left").where("met or at is null")
    n = F.size("near") - F.col("length")
    spans = F.when(F.col("at").isNotNull() & (n >= 0), F.sequence(F.lit(0), n))
    spread = met.select("id", "row_key", "n_words", "length", "at", "near", F.explode_outer(spans).alias("s"))
    span = F.array_join(F.slice("near", F.col("s") + 1, F.col("length")), " ")
    spread = spread.select("id", "row_key", "n_words", (F.col("at") + F.col("s")).alias("start"), F.col("at").isNull().alias("is_row"), span.alias("span"))
    grams = windows.select("item_id", "length", F.array_join("words", " ").alias("span"))
    hits = spread.join(sent(grams), "span", "left")
    hit = F.when(F.col("length").isNotNull(), F.struct("start", "length", "item_id"))
    return hits.groupBy("id", "row_key", "n_words").agg(
        F.count(F.when(F.col("is_row"), 1)).alias("copies"), F.sort_array(F.collect_set(hit)).cast(shape).alias("hits")
    ).withColumnRenamed("id", id_col)


def hit_words(hits: Column) -> Column:
    """How many words any of the hits covers."""
    each = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(each))).cast("long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10
) -> DataFrame:
    """Per row: id, n_words, n_hit (words in any occurrence of a window), n_items, items_sha256 (of the
    sorted, comma-joined ids of items with occurring windows), contaminated. Repeated rows all stay."""
    found = benchmark_hits(docs, benchmark, id_col, text_col, width)
    items = F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string")))
    return found.select(
        id_col,
        F.col("n_words").cast("long").alias("n_words"),
        hit_words(F.col("hits")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """``docs`` without the rows in whose text a window occurs; all columns stay."""
    key = fresh(docs, "_key")
    bad = benchmark_hits(docs, benchmark, id_col, text_col, width).where(F.size("hits") > 0).select(F.col("row_key").alias(key))
    return docs.join(sized(bad), F.xxhash64(F.col(id_col), F.col(text_col)) == F.col(key), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """``docs`` with the hit words taken out of the contaminated texts, up to the next word each; all columns stay."""
    found = benchmark_hits(docs, benchmark, id_col, text_col, width).where(F.size("hits") > 0)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    key, hit = fresh(docs, "_key"), fresh(docs, "_hit")
    spans = found.select(F.col("row_key").alias(key), covered.alias(hit))
    joined = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))).join(sized(spans), key, "left")
    # Word k with what follows it; what stands before word 0 is kept.
    other = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # no part of a word in either case
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[^{other}]+[{other}]*"), F.lit(0))
    head = F.regexp_extract(F.col(text_col), f"^[{other}]*", 0)
    kept = F.filter(F.transform(pieces, lambda p, i: F.when(F.array_contains(hit, i), None).otherwise(p)), lambda p: p.isNotNull())
    clean = F.concat(head, F.array_join(kept, ""))
    text = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(clean).alias(text_col)
    return joined.select(*(text if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def oracle(width: int = 10) -> str:
    """The registered query as DuckDB SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '{WORD}')"
    return f"""
    with d as (select doc_id, row_number() over () as r, {words} as w from documents),
    b as (select item_id, {words} as w from benchmark),
    bw as (select item_id, least(len(w), {width}) as l, w, unnest(range(1, len(w) - least(len(w), {width}) + 2)) as i from b where len(w) > 0),
    win as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') as s from bw),
    lens as (select distinct l from win),
    dw as (select r, l, w, unnest(range(1, len(w) - l + 2)) as i from d, lens where len(w) >= l),
    hit as (select r, i, dw.l, item_id from dw join win on win.l = dw.l and win.s = array_to_string(w[i:i + dw.l - 1], ' ')),
    n as (select r, count(distinct p) as n from (select r, unnest(range(i, i + l)) as p from hit) group by r),
    it as (select r, count(*) as n, string_agg(t, ',' order by t) as s from (select distinct r, cast(item_id as varchar) as t from hit) group by r)
    select doc_id, len(w) as n_words, coalesce(n.n, 0) as n_hit, coalesce(it.n, 0) as n_items,
           sha256(coalesce(it.s, '')) as items_sha256, n.n is not null as contaminated
    from d left join n using (r) left join it using (r)"""

