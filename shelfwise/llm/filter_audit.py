"""Filter interaction audit: what each filter removes alone, after others and in every order.

A filter is a letter and a Boolean expression over a text and its words that holds where the text FAILS. One more letter,
``E``, stands for exact duplicates: a row fails it when a row with a smaller id has the identical text, whether that row is
removed or not. Duplicates are found with radix text tries:

1. ``adaptive_cuts`` learns range bounds for whole texts: prefixes of a hash sample of distinct texts, lengthened where many
   sampled texts share one (a common header), cut to the shortest prefix that parts two neighbours. The bounds only balance
   the partitions; the result is the same for any bounds.
2. Every map task inserts its texts into a compressed trie whose terminals hold the least id, and sends each distinct text on
   once, so a text that a third of all rows hold arrives as one row a task (``FLUSH`` characters of trie at most).
3. Each text range is inserted into a compressed trie of full texts; its traversal returns the rows with the least id of
   their text, without texts.

Every row then has a mask of the filters that it fails; masks are counted per part and label, and everything else is
arithmetic on at most 32 counts a part. Texts are shuffled once, labels meet ids and masks only.

NULL texts are empty, NULL parts are the empty string. A row with a NULL id is in the counts, fails ``E`` never and makes no
other row fail it; rows that repeat the least id of a text all pass it. Of several labels of one id the largest counts; a row
without label is neither good nor toxic. Without rows there are no parts. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship, text_of, words_of

#: The filters in the order of their bits: each gives the failure condition of (text, words).
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: F.regexp_like(text, F.lit("[#$%&*|]")),
}
DUPLICATE = "E"
#: Characters of text in a map task's trie before it is sent on, and aimed at in the trie of a range.
FLUSH = 8_000_000
RANGE = 16_000_000
#: Ranges for each partition, and sampled texts for each range.
RANGES_EACH = 8
SAMPLED_EACH = 8
_FIRST_LENGTH = 32


class Trie:
    """A compressed trie of texts. A terminal holds the least id met, its mask, and the number of its rows in each part."""

    __slots__ = ("root", "held")

    def __init__(self):
        self.root, self.held = ["", {}, None], 0  # label, children by first character, terminal

    def insert(self, text: str, row_id: int, mask: int, part: str, n: int) -> None:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                self.held += end - at
                node = child
                break
            label = child[0]
            if not text.startswith(label, at):
                k = _common(label, text, at)
                upper = [label[:k], {label[k]: child}, None]
                child[0] = label[k:]
                node[1][text[at]] = upper
                child, label = upper, upper[0]
            node = child
            at += len(label)
        seen = node[2]
        if seen is None or row_id < seen[0]:
            node[2] = (row_id, mask, {part: n})
        elif row_id == seen[0]:
            seen[2][part] = seen[2].get(part, 0) + n

    def terminals(self, texts: bool) -> Iterator[tuple[str | None, int, int, str, int]]:
        """(text or None, least id, mask, part, rows) of every terminal and part, in the order of the texts."""
        stack = [(self.root, "")]
        while stack:
            node, before = stack.pop()
            here = before + node[0] if texts else ""
            if node[2] is not None:
                row_id, mask, parts = node[2]
                for part in sorted(parts):
                    yield here if texts else None, row_id, mask, part, parts[part]
            stack.extend((node[1][c], here) for c in sorted(node[1], reverse=True))


def _common(label: str, text: str, at: int) -> int:
    """Length of the common beginning of a label and what follows in a text; less than the label."""
    low, high = 0, len(label) - 1
    while low < high:
        half = (low + high + 1) // 2
        if text.startswith(label[:half], at):
            low = half
        else:
            high = half - 1
    return low


def adaptive_cuts(docs: DataFrame, ranges: int, sampled_each: int = SAMPLED_EACH, first_length: int = _FIRST_LENGTH) -> list[str]:
    """At most ``ranges - 1`` ascending prefixes that split the distinct texts of ``__text`` into about equal ranges."""
    rows = docs.count()
    wanted = ranges * sampled_each
    bits = 1 << 30
    key = F.xxhash64(F.lit("cuts"), "__text")
    drawn = docs.filter(F.pmod(key, F.lit(bits)) < int(min(1.0, 2 * wanted / max(1, rows)) * bits))
    length, known, open_ = first_length, {}, None
    while open_ is None or open_:
        some = drawn if open_ is None else drawn.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in open_], "h long")), key == F.col("h"), "left_semi")
        got = some.groupBy(key.alias("h")).agg(F.min(F.substring("__text", 1, length)).alias("p"), F.max(F.length("__text")).alias("n"))
        got = got.orderBy("h").limit(2 * wanted).collect()  # a bounded sample of distinct texts
        known.update((r.h, r.p) for r in got)
        shared: dict[str, int] = {}
        for p in known.values():
            shared[p] = shared.get(p, 0) + 1
        # Texts that many others agree with so far, and that go on, are looked at further.
        open_ = [r.h for r in got if r.n > length and shared[r.p] > max(1, sampled_each // 2)]
        length *= 8
    texts = sorted(known.values())
    cuts = []
    for i in range(1, ranges):
        at = i * len(texts) // ranges
        if 0 < at < len(texts) and texts[at - 1] < texts[at]:
            k = 0
            while k < len(texts[at - 1]) and texts[at - 1][k] == texts[at][k]:
                k += 1
            cuts.append(texts[at][: k + 1])
    return sorted(set(cuts))


def _batches(rows: Iterator[tuple], names: list[str], types: list, weigh: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + len(r[1] or "")
        if size > weigh:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


_NAMES, _TYPES = ["slot", "text", "id", "mask", "part", "n"], [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]


def first_rows(docs: DataFrame, flush: int = FLUSH, range_chars: int = RANGE) -> DataFrame:
    """Of ``__id``, ``__part``, ``__text``, ``__mask``: the rows with the least id of their text, as id, mask, part and n."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.filter(F.col("__id").isNotNull())
    chars = docs.agg(F.sum(F.length("__text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // range_chars))
    cuts = spark.sparkContext.broadcast(adaptive_cuts(docs.select("__text"), n * RANGES_EACH))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(trie: Trie) -> Iterator[pa.RecordBatch]:
            bounds = cuts.value
            yield from _batches(((bisect_right(bounds, t[0]), *t) for t in trie.terminals(True)), _NAMES, _TYPES)

        trie = Trie()
        for b in batches:
            for row_id, text, mask, part in zip(*(b.column(c).to_pylist() for c in ("__id", "__text", "__mask", "__part"))):
                trie.insert(text, row_id, mask, part, 1)
                if trie.held > flush:
                    yield from sent(trie)
                    trie = Trie()
        yield from sent(trie)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            for text, row_id, mask, part, k in zip(*(b.column(c).to_pylist() for c in _NAMES[1:])):
                trie.insert(text, row_id, mask, part, k)
        yield from _batches(((0, *t) for t in trie.terminals(False)), _NAMES, _TYPES)

    schema = "slot int, text string, id long, mask int, part string, n long"
    sifted = docs.select("__id", "__text", "__mask", "__part").mapInArrow(sift, schema)
    return sifted.repartition(n, "slot").mapInArrow(merged, schema).select("id", "mask", "part", "n")


def masked(docs: DataFrame, id_col="doc_id", text_col="text", part_col="source", filters=FILTERS) -> DataFrame:
    """``__id``, ``__part``, ``__text`` and ``__mask``: bit i is set where the i-th filter fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(part_col), F.lit("")).alias("__part"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__words", words_of(F.col("__text")))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails(F.col("__text"), F.col("__words")), 1 << i).otherwise(0))
    return rows.select("__id", "__part", "__text", mask.alias("__mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source", filters=FILTERS) -> DataFrame:
    """part, mask (of all filters and the duplicate flag), n, good, toxic: rows that fail exactly the filters of the mask."""
    rows = masked(docs, id_col, text_col, part_col, filters)
    again = 1 << len(filters)
    # All rows count as duplicates at first; then those with the least id of their text move to the mask without the flag.
    every = rows.groupBy(F.col("__id").alias("id"), F.col("__mask").alias("mask"), F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    every = every.withColumn("first", F.when(F.col("id").isNull(), 1).otherwise(0)).withColumn("later", F.when(F.col("id").isNull(), 0).otherwise(1))
    least = first_rows(rows).groupBy("id", "mask", "part").agg(F.sum("n").alias("n")).withColumn("first", F.lit(1)).withColumn("later", F.lit(-1))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic").filter("label_id IS NOT NULL")
    known = known.groupBy("label_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    both = every.unionByName(least).join(known, F.col("id") == F.col("label_id"), "left")
    good, bad = (F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)) for c in ("quality", "toxic"))
    sides = F.array(*[F.struct(m.alias("mask"), (F.col(s) * F.col("n")).alias("n")) for m, s in ((F.col("mask"), "first"), (F.col("mask").bitwiseOR(again), "later"))])
    both = both.select("part", good.alias("good"), bad.alias("toxic"), F.inline(sides))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of the masks."""
    masks = 1 << len(letters)
    held = [F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(masks)]).alias(f"{c}s") for c in ("n", "good", "toxic")]
    per_part = counts.groupBy("part").agg(*held)
    orders = ["".join(p) for p in permutations(letters)]
    steps = len(letters)
    per_part = per_part.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * steps - 1))).alias("i"))
    per_part = per_part.withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), (F.col("i") / steps).cast("int")))
    per_part = per_part.withColumn("step", (F.col("i") % steps + 1).cast("int"))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(letters), c) - 1).cast("int"))
    per_part = per_part.withColumn("bits", bits)
    add = lambda a, x: a.bitwiseOR(x)
    per_part = per_part.withColumn("own", F.get("bits", F.col("step") - 1))
    per_part = per_part.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), add))
    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    total = lambda of, which: F.aggregate(
        F.sequence(F.lit(0), F.lit(masks - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(which(m), of(m)).otherwise(F.lit(0))
    )
    of = lambda c: lambda m: F.get(F.col(c), m)
    removed = lambda m: fails(m) & ~gone(m)
    shares = F.array(*[F.lit(0 if m == 0 else len(orders) // bin(m).count("1")) for m in range(masks)])
    return per_part.select(
        "part",
        "filter_order",
        "step",
        total(of("ns"), lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(of("ns"), removed).alias("removed"),
        total(of("ns"), lambda m: fails(m) & gone(m)).alias("redundant"),
        total(of("ns"), lambda m: m == own).alias("unique_fails"),
        total(of("goods"), removed).alias("good_lost"),
        total(of("toxics"), removed).alias("toxic_lost"),
        # In how many of all orders the filter stands before the others that a row fails: one in as many as it fails.
        total(lambda m: F.get("ns", m) * F.get(shares, m), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source", filters=FILTERS) -> DataFrame:
    """The interactions of all filters and the duplicate flag, for every part, order and step."""
    return interactions(mask_counts(docs, labels, id_col, text_col, part_col, filters), "".join(filters) + DUPLICATE)
