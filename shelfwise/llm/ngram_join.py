"""N-gram Jaccard join by a token-group matrix.

Two texts link when ``den * |A and B| >= num * |A or B|`` over their sets of word shingles. The join returns the
connected components of these links, exactly, without emitting the pairs inside a group of copies:

1. Texts with one and the same set are one *node* (128-bit digest of the set).
2. Similar nodes are partitioned into groups: nodes that share two min-hashes, in chunks of about ``GROUP`` (three
   such partitions). Each chunk links its own nodes in one task, skipping pairs that are connected already. The
   components so far become the groups of the matrix, in chunks of about ``GROUP`` nodes.
3. The matrix (shingle x group) is kept as the rows of its prefix shingles: with one order of all shingles, rare ones
   first, two linked sets share ``k`` shingles among the first ``n - ceil(n * num / den) + k`` of each; ``k`` grows with
   the smaller set (one more each ``STEP`` shingles), so a chance phrase or one common passage makes no candidate of two
   long texts. A query node meets the groups of *other* components that hold ``k`` of its prefix shingles, counting those
   where the sizes and what follows the shingle on both sides allow a link.
4. The union of the members' shingles is stored once for every group that a query meets. A query of n shingles needs
   ``num/den * n`` of them, and ``num / (num + den) * (n + m)`` where m is the group's smallest set: fewer shared with the
   union rule out every member. This bound sees the stored union and the query, no member.
5. Only qualifying groups are opened: the members' texts are fetched and compared one by one, up to the first link; as
   all members are connected, one link joins the components, whichever member it is.

Step 3 misses no link (prefix filter), step 4 rules out no group that holds one (the bound), so the components are exact;
steps 1 and 2 only save work. The order of shingles comes from counts over all texts: every slice of a task reports the
shingles that occur twice or more in it, and the ``KNOWN`` most frequent go last. That list is the only thing on the
driver (``KNOWN`` numbers at most) and affects the cost, not the result.

Texts are re-read where sets are compared and travel only for nodes with a candidate. Lists of candidates are
broadcast up to ``BROADCAST_ROWS`` counted rows, and joined by shuffle beyond that.

NULL and empty texts have no shingles and are linked with nothing (their component is their own doc_id). Repeated rows
are copies. A NULL doc_id never names a component unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CHARS, Scratch, text_of
from shelfwise.llm.components import components
from shelfwise.llm.hashing import buffers, mix, overlap, shingle_sets

GROUP = 64
QUERIES = 256
STEP = 32
ROUNDS = 3
KNOWN = 1 << 16
SLICE = 4_000_000
BROADCAST_ROWS = 1_000_000
_SEEDS = mix(np.arange(101, 101 + 2 * ROUNDS, dtype=np.uint64))


def _digest(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    one = tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))
    two = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.array([one, two], ">u8").tobytes()


def _known_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of all texts, rarest first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            twice = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(token[twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for raws in buffers(batch.column("text").to_pylist()):
                for tokens in shingle_sets(raws, width):
                    held.append(tokens)
                    size += len(tokens)
                if size > SLICE:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counted = docs.select("text").mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(KNOWN).select("token").toPandas()["token"]
    return top.to_numpy(np.int64)[::-1].view(np.uint64)


def _required(n: int, num: int, den: int) -> int:
    """Least number of shared shingles of a set of n with any partner."""
    return -(-num * n // den)


def _shared(n: int, num: int, den: int) -> int:
    """``k`` of a set of n: so many shingles of its prefix it shares with any partner that is not smaller."""
    return min(1 + n // STEP, _required(n, num, den))


def _nodes(docs: DataFrame, known, width: int, num: int, den: int) -> DataFrame:
    """Per row: ``id``, ``n`` shingles, ``node``, its prefix shingles and min-hashes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("prefix", pa.list_(pa.int64())), ("mins", pa.list_(pa.int64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value
        order = np.argsort(frequent)
        values, ranks = frequent[order], order + 1
        for batch in batches:
            rows = {k: [] for k in schema.names}
            rows["id"] = batch.column("id").to_pylist()
            for raws in buffers(batch.column("text").to_pylist()):
                for tokens in shingle_sets(raws, width):
                    n = len(tokens)
                    rows["n"].append(n)
                    if not n:
                        for k in ("node", "prefix", "mins"):
                            rows[k].append(None)
                        continue
                    prefix = tokens
                    if len(values):
                        at = np.searchsorted(values, tokens)
                        at[at == len(values)] = 0
                        rank = np.where(values[at] == tokens, ranks[at], 0)
                        prefix = tokens[np.argsort(rank, kind="stable")]
                    rows["node"].append(_digest(tokens))
                    rows["prefix"].append(prefix[: n - _required(n, num, den) + _shared(n, num, den)].view(np.int64))
                    rows["mins"].append([int(mix(tokens ^ s).min().view(np.int64)) for s in _SEEDS])
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    return docs.select("id", "text").mapInArrow(describe, "id long, n long, node binary, prefix array<long>, mins array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Adjacent rows with equal first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _sets(rows: list[tuple], width: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows (.., node, text) with the shingles of the text, where they are the node's (an id may have several texts)."""
    at = 0
    for raws in buffers([r[-1] for r in rows]):
        for tokens in shingle_sets(raws, width):
            row = rows[at]
            at += 1
            if len(tokens) and _digest(tokens) == row[-2]:
                yield row, tokens


class _Linker:
    """Union-find over the few nodes of one task's group."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        self.up[self.root(b)] = self.root(a)


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``id`` and more) with the texts of its ids."""
    wanted = wanted.withColumnRenamed("id", "__id")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def _near_links(docs, reps: DataFrame, scratch, width, num, den) -> DataFrame:
    """Links inside chunks of nodes that share two min-hashes."""
    pairs = F.array(*[F.struct(F.lit(r).alias("r"), F.col("mins")[2 * r].alias("x"), F.col("mins")[2 * r + 1].alias("y")) for r in range(ROUNDS)])
    rows = reps.select("id", "node", F.inline(pairs))
    sizes = rows.groupBy("r", "x", "y").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = rows.join(sizes, ["r", "x", "y"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", "r"), F.ceil(F.col("size") / GROUP)).cast("int"))
    wanted = scratch.store(rows.select("r", "x", "y", "salt", "id", "node"))
    # docs: id, text
    texts = _with_texts(docs, wanted).select("r", "x", "y", "salt", "id", "node", "text")
    texts = texts.repartition("r", "x", "y", "salt").sortWithinPartitions("r", "x", "y", "salt", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 4):
            seen = {row[1]: tokens for row, tokens in _sets(rows, width)}
            items = sorted(seen.items(), key=lambda x: (len(x[1]), x[0]))
            sets, found = _Linker(), []
            for i, (a, left) in enumerate(items):
                for b, right in items[i + 1 :]:
                    if num * len(right) > den * len(left):
                        break
                    if sets.root(a) != sets.root(b):
                        both = overlap(left, right)
                        if den * both >= num * (len(left) + len(right) - both):
                            sets.join(a, b)
                            found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return texts.mapInArrow(link, "a binary, b binary")


def _far_links(docs, nodes: DataFrame, scratch, width, num, den) -> DataFrame:
    """Links between nodes of different components: the token-group matrix. ``nodes``: id, node, n, prefix, comp. The links are stored."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    info = nodes.join(sizes, "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)).cast("int"))
    info = scratch.store(info.select("id", "node", "n", "comp", "size", "chunk", "prefix"))
    # The matrix by shingle: only shingles that cross components can lead to a link.
    cells = info.select(F.posexplode("prefix").alias("pos", "token"), F.xxhash64("node").alias("h"), F.xxhash64("comp").alias("c"))
    cells = cells.repartition("token")
    crossing = cells.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("token")
    cells_stored = scratch.store(cells.join(crossing, "token").select("token", "pos", "h"))
    slim = info.select(F.xxhash64("node").alias("h"), "node", "id", "n", "comp", "size", "chunk")
    cells = cells_stored.join(slim, "h")
    columns = cells.groupBy("token", F.col("comp").alias("g_comp"), F.col("chunk").alias("g_chunk"), F.col("size").alias("g_size"))
    columns = columns.agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("left_hi"))
    queries = cells.select("token", "pos", "node", "id", "n", "comp", "size")
    # The smaller component asks the larger one.
    asks = F.struct("size", "comp") < F.struct(F.col("g_size").alias("size"), F.col("g_comp").alias("comp"))
    fits = (F.col("n") * den >= F.col("n_lo") * num) & (F.col("n_hi") * den >= F.col("n") * num)

    def shared(n):
        return F.least(1 + F.floor(n / STEP), F.ceil(n * num / den))

    # If this is one of the first k shared shingles of a link, what follows it on both sides and the k - 1 before it
    # have to hold the whole overlap.
    follows = F.least(F.col("n") - F.col("pos"), F.col("left_hi")) + shared(F.col("n")) - 1
    reaches = (num + den) * follows >= num * (F.col("n") + F.col("n_lo"))
    met = queries.join(columns, "token").filter(asks & fits & reaches)
    asked = met.groupBy("g_comp", "g_chunk", "node", "id", "comp").agg(
        F.count(F.lit(1)).alias("met"), F.min(shared(F.least("n", "n_lo"))).alias("k")
    )
    asked = scratch.store(asked.filter("met >= k").drop("met", "k"))
    scratch.drop(cells_stored)
    group, part = ["g_comp", "g_chunk"], ["g_comp", "g_chunk", "part"]
    load = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    members = info.select(F.col("comp").alias("g_comp"), F.col("chunk").alias("g_chunk"), "id", "node").join(load, group)
    members = scratch.store(members)
    scratch.drop(info)
    dealt = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    wanted = scratch.store(asked.join(load, group).select(*group, dealt, "comp", "id", "node"))
    scratch.drop(asked)
    unions = scratch.store(_unions(docs, members, width))
    none = F.lit(None).cast("binary")
    query_rows = _with_texts(docs, wanted).select(*part, F.lit(1).alias("query"), none.alias("tokens"), F.lit(0).cast("long").alias("least"), "comp", "id", "node", "text")
    # A group's union goes to each part of its queries.
    union_rows = unions.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    union_rows = union_rows.select(*part, F.lit(0).alias("query"), "tokens", "least", none.alias("comp"), F.lit(None).cast("long").alias("id"), none.alias("node"), F.lit("").alias("text"))
    bounded = query_rows.unionByName(union_rows).repartition(*part).sortWithinPartitions(*part, "query", "id")
    qualified = scratch.store(bounded.mapInArrow(_bound(width, num, den), "g_comp binary, g_chunk int, part int, comp binary, node binary, tokens binary"))
    scratch.drop(wanted)
    scratch.drop(unions)
    opened = scratch.store(members.join(qualified.select(*part).distinct(), group).select(*part, "id", "node"))
    scratch.drop(members)
    member_rows = _with_texts(docs, opened).select(*part, F.lit(0).alias("query"), none.alias("comp"), none.alias("tokens"), "node", "text")
    asking = qualified.select(*part, F.lit(1).alias("query"), "comp", "tokens", "node", F.lit("").alias("text"))
    rows = member_rows.unionByName(asking).repartition(*part).sortWithinPartitions(*part, "query", "node")
    links = scratch.store(rows.mapInArrow(_open(width, num, den), "a binary, b binary"))
    scratch.drop(qualified)
    scratch.drop(opened)
    return links


def _unions(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Per group: the sorted union of its members' shingles (``tokens``), the size of its smallest set (``least``) and its ``parts``."""
    schema = pa.schema([("g_comp", pa.binary()), ("g_chunk", pa.int32()), ("parts", pa.int32()), ("least", pa.int64()), ("tokens", pa.binary())])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (comp, chunk), rows in _groups(batches, 2):
            sets = {row[-2]: tokens for row, tokens in _sets(rows, width)}
            union = np.unique(np.concatenate(list(sets.values())))
            made = [comp], [chunk], [rows[0][0]], [min(map(len, sets.values()))], [union.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)

    texts = _with_texts(docs, members).select("g_comp", "g_chunk", "parts", "id", "node", "text")
    texts = texts.repartition("g_comp", "g_chunk").sortWithinPartitions("g_comp", "g_chunk", "id")
    return texts.mapInArrow(unite, "g_comp binary, g_chunk int, parts int, least long, tokens binary")


def _bound(width: int, num: int, den: int):
    """Rows (group, part, query, tokens, least, comp, id, node, text), a group's union first: the queries it can hold a link of."""
    schema = pa.schema(
        [("g_comp", pa.binary()), ("g_chunk", pa.int32()), ("part", pa.int32()), ("comp", pa.binary()), ("node", pa.binary()), ("tokens", pa.binary())]
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 3):
            union, least = np.frombuffer(rows[0][1], np.uint64), rows[0][2]
            passed: dict[bytes, tuple] = {}
            for row, tokens in _sets(rows[1:], width):
                n = len(tokens)
                need = max(_required(n, num, den), -(-num * (n + least) // (num + den)))
                if row[-2] not in passed and overlap(tokens, union) >= need:
                    passed[row[-2]] = (*key, row[3], row[-2], tokens.tobytes())
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*passed.values()), schema)], schema=schema)

    return bound


def _open(width: int, num: int, den: int):
    """Rows (group, part, query, comp, tokens, node, text), members first: one link of each query to the group, if it has any."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (comp, _, _), rows in _groups(batches, 3):
            members = {row[-2]: tokens for row, tokens in _sets([r for r in rows if not r[0]], width)}
            found = []
            for _, _, raw, node, _ in (r for r in rows if r[0]):
                tokens = np.frombuffer(raw, np.uint64)
                for other in members.values():
                    if num * len(other) <= den * len(tokens) and num * len(tokens) <= den * len(other):
                        both = overlap(tokens, other)
                        if den * both >= num * (len(tokens) + len(other) - both):
                            found.append((node, comp))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return link


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    known = spark.sparkContext.broadcast(_known_shingles(docs, width))
    described = scratch.store(_nodes(docs, known, width, num, den))
    # Copies: one node, named by its least id.
    first = scratch.store(described.filter("n > 0").groupBy("node").agg(F.min("id").alias("id")))
    one = first.select(F.col("node").alias("__node"), F.col("id").alias("__id"))
    reps = described.join(one, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__id"))).drop("__node", "__id")
    reps = reps.dropDuplicates(["node"])
    near = scratch.store(_near_links(docs, reps.select("id", "node", "mins"), scratch, width, num, den))
    part = components(near, scratch)
    nodes = reps.select("id", "node", "n", "prefix").join(part, "node", "left")
    nodes = nodes.select("id", "node", "n", "prefix", F.coalesce("root", "node").alias("comp"))
    far = _far_links(docs, nodes, scratch, width, num, den)
    part = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(far), scratch)
    rooted = first.join(part, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select(F.col("node").alias("__node"), "component_id")
    out = described.select("id", "n", "node").join(named, F.col("node") == F.col("__node"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays: the one with the least doc_id, columns unchanged.

    The components are of rows, not of ids. A row whose doc_id is NULL or that other rows have too gets a key of its own from id
    and text, above all ids, so a text without a near copy stays whatever its id. Equal texts under such an id are one row, the
    first by all columns. Rows without words are linked with nothing and stay.
    """
    named = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__again"))
    worded = F.btrim(text_of(), F.lit(SPACE_CHARS)) != ""
    own = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), "text"), F.lit(1 << 61))
    rows = docs.filter(worded)
    unique = named.isEmpty()
    if unique:
        rows = rows.withColumn("__key", F.col("doc_id").cast("long"))
    else:
        again = F.col("doc_id").eqNullSafe(F.col("__again"))
        renamed = rows.join(named, again, "left_semi").withColumn("__key", own)
        rows = renamed.unionByName(rows.join(named, again, "left_anti").withColumn("__key", F.col("doc_id").cast("long")))
    found = jaccard_components(rows, "__key", "text", width=width, num=num, den=den).withColumnRenamed("doc_id", "key")
    if unique:
        keep = found.filter("key = component_id").select(F.col("key").alias("__keep")).distinct()
    else:
        ids = renamed.select(F.col("__key").alias("key"), F.col("doc_id").cast("long").alias("id"), F.lit(True).alias("own")).distinct()
        found = found.join(ids, "key", "left").withColumn("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("key")))
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
        keep = found.groupBy("component_id").agg(least.alias("least")).select(F.col("least.key").alias("__keep"))
    kept = rows.join(keep, F.col("__key") == F.col("__keep"), "left_semi")
    whole_row = F.xxhash64(*[f.name for f in docs.schema if f.dataType.typeName() != "map"])
    first = Window.partitionBy("__key").orderBy(whole_row)
    kept = kept.withColumn("__row", F.row_number().over(first)).filter("__row = 1").select(docs.columns)
    return kept.unionByName(docs.filter(~worded))
