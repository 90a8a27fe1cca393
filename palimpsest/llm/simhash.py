"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A document's fingerprint has a bit for each bit of a 64-bit hash: 1 where more
than half of its word shingles' hashes have a 1.  Two documents are linked if
their fingerprints differ in at most ``radius`` bits; a group is a connected
component of links.

Candidates come from Pagh's covering construction ("CoveringLSH", SODA 2016).
Each bit position gets a vector of ``radius + 1`` bits.  For each non-zero
vector v, the mask keeps the positions whose vector has an odd product with v.
``radius`` positions span too little to exclude every v, so whatever bits two
linked fingerprints differ in, some mask leaves all of them out and the pair
shares that table's bucket: no link is lost.  There are ``2**(radius+1) - 1``
tables, each keyed by about 32 bits.

Copies share a fingerprint, so tables hold distinct fingerprints only.  Buckets
are counted before they are gathered.  A bucket above ``BLOCK`` fingerprints is
cut into hashed blocks and every pair of blocks is a task's unit of its own, so
no bucket is ever in one place and none is capped.  A unit returns a minimum
spanning forest of its links, not all pairs.

``keep_one`` promises a Jaccard similarity of texts, which fingerprints bound badly: texts at
0.8 differ in about ten bits, and covering ten bits takes 2,047 tables.  So links of
fingerprints are taken as candidates only.  They put texts into clusters, and a join on
rare shingles adds what lies beyond the radius: two sets that are ``least`` alike meet among
the first ``n - least * n + 1`` shingles of either, rarest first (a prefix filter, which
misses nothing), and buckets that lie in one cluster already are left out.  Then all texts of
a cluster are compared with each other by their shingles, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import ASCII_LOWER, bucket, by_place, cut, hashed_counts, picked, place, restored, sent, texts
from palimpsest.operators.graph import components

#: Fingerprints of a bucket that are compared as one unit.
BLOCK = 2048

#: Bytes of a shingle set's sketch, and what the share of equal bytes may fall below the similarity: five standard deviations at 0.8.
SKETCH, SLACK = 96, 0.205

#: Shingles of a cluster's texts, and texts, that are compared as one unit.
UNIT_SHINGLES, UNIT_TEXTS = 1 << 20, 1024

#: Texts whose ids are sent to all executors to fetch them; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000

_XOR, _ODD = np.random.default_rng(11).integers(0, 1 << 64, (2, SKETCH), np.uint64) | np.array([[0], [1]], np.uint64)

#: Row b holds the eight bits of byte b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined ``width``-word shingles of lower-cased ``text``, repeats included.

    Fewer words give one shingle of all of them; none gives no hash.
    """
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(starts))


def fingerprint(text: bytes, width: int) -> int:
    """The 64-bit fingerprint as a signed integer; a text without words has 0."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """A bit for each of 64: whether over half of the hashes have it."""
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 4, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each text; all rows and other columns stay."""
    rows, at = by_place(docs), docs.columns.index(text_col)
    schema = rows.select("*", F.lit(0).cast("long").alias("print")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, width) for t in texts(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, "print"])

    return rows.mapInArrow(run, schema).toDF(*docs.columns, out)


def masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """The covering masks as signed 64-bit integers."""
    vectors = np.random.default_rng(seed).integers(1, 1 << (radius + 1), bits)
    found = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def tree(prints: np.ndarray, radius: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(i, j): links that connect what all links within ``radius`` would connect, nearest pairs first (Prim's minimum spanning forest).

    ``apart``: 0 or 1 for each print; where given, only prints of different sides are compared.
    """
    far = 65
    best, parent = np.full(len(prints), far, np.int16), np.zeros(len(prints), np.int64)
    left = np.ones(len(prints), bool)
    found: list[tuple[int, int]] = []
    for _ in range(len(prints)):
        here = int(np.argmin(np.where(left, best, far + 1)))
        if best[here] <= radius:
            found.append((int(parent[here]), here))
        left[here] = False
        bits = np.bitwise_count(prints ^ prints[here]).astype(np.int16)
        if apart is not None:
            bits[apart == apart[here]] = far
        nearer = left & (bits < best)
        best[nearer], parent[nearer] = bits[nearer], here
    return found


def whole_units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where units start and the last ends): rows in order, units (equal ``keys``) that follow each other never cut in two."""
    rest: pa.Table | None = None
    batches = iter(batches)
    while True:
        batch = next(batches, None)
        table = rest if batch is None else pa.Table.from_batches([batch])
        if batch is not None and rest is not None:
            table = pa.concat_tables([rest, table])
        if table is not None and table.num_rows:
            columns = [table.column(c).to_numpy() for c in keys]
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
            end = table.num_rows if batch is None else int(starts[-1])
            if end:
                yield table.slice(0, end).combine_chunks(), np.r_[starts[starts < end], end]
            rest = table.slice(end).combine_chunks()
        if batch is None:
            return


UNIT = ("t", "key", "p", "q")


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the units (see ``links``)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for table, edges in whole_units(batches, UNIT):
        prints = table.column("fp").to_numpy().view(np.uint64)
        p, q, side = (table.column(c).to_numpy() for c in ("p", "q", "side"))
        starts, ends = edges[:-1], edges[1:]
        pairs = starts[ends - starts == 2]
        near = (np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= radius) & ((p[pairs] == q[pairs]) | (side[pairs] != side[pairs + 1]))
        found = [np.column_stack([pairs[near], pairs[near] + 1])]
        large = ends - starts > 2
        for s, e in zip(starts[large], ends[large]):
            if links_ := tree(prints[s:e], radius, side[s:e] if p[s] != q[s] else None):
                found.append(np.array(links_, np.int64) + s)
        i, j = np.concatenate(found).T
        a, b = (prints[k].view(np.int64) for k in (i, j))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def in_units(rows: DataFrame) -> DataFrame:
    """``rows`` (t, key, node, blocks and more) dealt out to units (t, key, p, q): every pair of blocks of a bucket is one."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = {"p": F.least("own", "other"), "q": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    return rows.withColumns(unit).drop("own", "other", "blocks").repartition(*UNIT).sortWithinPartitions(*UNIT)


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links among the distinct fingerprints of column ``fp`` that connect all pairs within ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m")) for t, m in enumerate(masks(radius))])
    signed = prints.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    full = signed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    units = in_units(signed.join(full, ["t", "key"]).withColumn("node", F.col("fp")))
    return units.select(*UNIT, "side", "fp").mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest id among the documents that links reach, its own
    included.  Null and blank texts have fingerprint zero and are linked like any other;
    a null id is never the smallest, and a component of null ids only has a null id.
    Repeated rows are returned as often as they come; an empty table gives no rows.  Other
    columns don't matter; of columns with equal names the first is meant.
    """
    rows = cut(with_fingerprint(picked(docs, id=id_col, text=text_col), width=width).select("id", "fingerprint"))
    least = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("first")))
    labels = components(links(least.select(F.col("fingerprint").alias("fp")), radius))
    joined = least.join(labels, least["fingerprint"] == labels["id"], "left").select("fingerprint", "first", F.coalesce("label", "fingerprint").alias("group"))
    component = joined.join(joined.groupBy("group").agg(F.min("first").alias("component_id")), "group").select("fingerprint", "component_id")
    return rows.join(component, "fingerprint", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def similarity(a: bytes, b: bytes, width: int) -> float:
    """Jaccard similarity of the sets of shingles; 1 for two texts without words."""
    x, y = (np.unique(shingle_hashes(t, width)) for t in (a, b))
    shared = len(np.intersect1d(x, y, True))
    return shared / (len(x) + len(y) - shared) if len(x) + len(y) else 1.0


def sketch(own: np.ndarray) -> np.ndarray:
    """A byte of the least value of the distinct shingles ``own`` under each of ``SKETCH`` permutations of 64-bit integers."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, ((own[at : at + 4096, None] ^ _XOR) * _ODD).min(0))
    return (least & np.uint64(255)).astype(np.uint8)


def head_size(n: int, least: float) -> int:
    """So many of ``n`` shingles, in any order that all sets share, hold one of every set that is ``least`` alike."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def with_sets(docs: DataFrame, width: int, least: float) -> DataFrame:
    """Rows (text, o) as (o, node, fp, n, heads, sketch).

    ``node``: hash of the shingle set; ``fp``: the fingerprint; ``n``: size of the set;
    ``heads``: its rarest shingles, as many as ``head_size`` says.
    """
    schema = docs.select("o", *[F.lit(0).cast("long").alias(c) for c in ("node", "fp", "n")], F.array(F.lit(0).cast("long")).alias("heads"), F.lit(b"").alias("sketch")).schema
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
    counted = sent(docs.sparkSession, hashed_counts(docs.select("text"), lambda text: [np.unique(shingle_hashes(text, width))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counted()
        for batch in batches:
            rows = []
            for text in texts(batch.column(0)):
                hashes = shingle_hashes(text, width)
                own = np.unique(hashes)
                heads = own[np.argsort(common[bucket(own)], kind="stable")[: head_size(len(own), least)]]
                node = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)
                rows.append((int(node), majority(hashes), len(own), heads.view(np.int64), sketch(own).tobytes()))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns, kinds)], ["o", "node", "fp", "n", "heads", "sketch"])

    return docs.select("text", "o").mapInArrow(run, schema)


def forest(near: Callable[[int, np.ndarray], np.ndarray], m: int) -> list[tuple[int, int]]:
    """Edges that connect what ``near`` connects; ``near(i, others)`` says which of others are near to i."""
    left, found = np.ones(m, bool), []
    for root in range(m):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            i = todo.pop()
            others = np.flatnonzero(left)
            others = others[near(i, others)]
            left[others] = False
            todo += others.tolist()
            found += [(i, j) for j in others.tolist()]
    return found


def _bridges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): clusters of which texts in a unit may be ``least`` alike by their sizes and sketches; a forest for each unit of over 16."""
    for table, edges in whole_units(batches, UNIT):
        g, n, side, p, q = (table.column(c).to_numpy() for c in ("g", "n", "side", "p", "q"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(g), -1)

        def near(i, j):
            fits = (g[i] != g[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & ((side[i] != side[j]) | (p[j] == q[j]))
            some = np.flatnonzero(fits)
            x = sketches[i] if np.isscalar(i) else sketches[i[some]]
            fits[some] = (x == sketches[j[some]]).mean(1) >= least - SLACK
            return fits

        size = np.diff(edges)
        unit, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= 16, size)
        found = []
        for lag in range(1, min(16, int(size.max()))):
            i = np.flatnonzero((unit[lag:] == unit[:-lag]) & small[lag:])
            for part in np.array_split(i, len(i) // 100_000 + 1):
                part = part[near(part, part + lag)]
                found.append(np.column_stack([g[part], g[part + lag]]))
        for s, e in zip(edges[:-1][size > 16], edges[1:][size > 16]):
            if pairs := forest(lambda i, others: near(s + i, s + others), e - s):
                found.append(g[np.array(pairs) + s])
        a, b = np.unique(np.sort(np.concatenate(found), axis=1), axis=0).T if found else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def bridges(nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): clusters ``g`` of ``nodes`` (node, g, n, heads, sketch) whose texts share a head and may be ``least`` alike."""
    headed = nodes.select("node", "g", F.explode("heads").alias("key"))
    full = headed.groupBy("key").agg(F.count("*").alias("rows"), F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    units = in_units(headed.drop("g").join(full, "key").join(nodes.select("node", "g", "n", "sketch"), "node").withColumn("t", F.lit(0)))
    return units.select(*UNIT, "side", "g", "n", "sketch").mapInArrow(lambda batches: _bridges(batches, least), "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values sets i and j > i share, as a matrix; the other entries mean nothing.

    Values that few sets have are counted by pairs of sets, the others by a product of
    matrices, so the work is bounded for either.
    """
    m, dense = len(sets), 32
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    held = np.diff(np.r_[starts, len(flat)])
    group = np.repeat(np.arange(len(starts)), held)
    few = (held <= dense)[group]
    total = np.zeros(m * m, np.int64)
    for lag in range(1, min(dense, int(held.max(initial=1)))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
        total += np.bincount(owner[i] * m + owner[i + lag], minlength=m * m)
    total = total.reshape(m, m)
    many = np.flatnonzero(held > dense)
    for part in np.array_split(many, len(many) // 2048 + 1) if len(many) else []:
        column = np.full(len(starts), -1)
        column[part] = np.arange(len(part))
        here = np.flatnonzero(column[group] >= 0)
        table = np.zeros((m, len(part)), np.float32)
        table[owner[here], column[group[here]]] = 1
        total += (table @ table.T).astype(np.int64)
    return total


def _alike(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): edges among the texts of each unit that connect all that are ``least`` alike."""
    for table, edges in whole_units(batches, UNIT):
        node, side, p, q = (table.column(c).to_numpy() for c in ("node", "side", "p", "q"))
        found = [np.zeros((0, 2), np.int64)]
        for s, e in zip(edges[:-1], edges[1:]):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts(table.column("text").slice(s, e - s).combine_chunks())]
            n = np.array([len(x) for x in sets])
            shared = np.triu(shared_counts(sets), 1)
            fits = shared >= least * (n[:, None] + n - shared) - 1e-9
            if p[s] != q[s]:
                fits &= side[s:e, None] != side[s:e]
            fits = np.triu(fits, 1)
            fits |= fits.T
            if pairs := forest(lambda i, others: fits[i, others], e - s):
                found.append(node[np.array(pairs) + s])
        a, b = np.concatenate(found).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, then the smallest text hash.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or
    more are linked, and a group is a component of links.  Every link is found by a
    comparison of the texts; fingerprints within ``radius`` bits and rare shingles that two
    texts share say which texts are compared.  Columns are those of ``docs``, whatever their
    names (of equal names the first is meant).  Null ids come last.  Null and blank texts
    have the same, empty set.  Of rows that agree in id and text, one stays.  Texts are
    shuffled for clusters of candidates, and once for the semi-join that keeps the chosen rows.
    """
    rows = by_place(docs)
    id_, text = F.col(place(docs, id_col)), F.col(place(docs, text_col))
    key = ["none", "sid", "hash"]
    keyed = rows.withColumns({"none": id_.isNull(), "sid": F.coalesce(id_.cast("string"), F.lit("")), "hash": F.xxhash64(text)})
    slim = keyed.select(text.alias("text"), F.struct("none", id_.alias("i"), "sid", "hash").alias("o"))
    first = cut(with_sets(slim, width, least).groupBy("node").agg(F.min("o").alias("o"), *[F.first(c).alias(c) for c in ("fp", "n", "heads", "sketch")]))

    def joined(nodes: DataFrame, on: str, edges: DataFrame, out: str) -> DataFrame:
        labels = components(edges).select(F.col("id").alias(on), F.col("label").alias("least_"))
        return nodes.join(labels, on, "left").withColumn(out, F.coalesce("least_", on)).drop("least_")

    clustered = cut(joined(first, "fp", links(first.select("fp").distinct(), radius), "g"))
    clustered = cut(joined(clustered.select("node", "o", "g", "n"), "g", bridges(clustered, least), "key"))
    blocks = F.ceil(F.greatest(F.sum("n") / UNIT_SHINGLES, F.count("*") / UNIT_TEXTS)).cast("int")
    wanted = clustered.join(clustered.groupBy("key").agg(F.count("*").alias("m"), blocks.alias("blocks")).where("m > 1"), "key").select("key", "node", "blocks", *[F.col(f"o.{c}").alias(c) for c in key])
    wanted = cut(wanted)
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    compared = keyed.select(*key, text.alias("text")).join(few, key).dropDuplicates(["node"]).withColumn("t", F.lit(0))
    same = in_units(compared.select("t", "key", "node", "blocks", "text")).select(*UNIT, "side", "node", "text")
    pairs = same.mapInArrow(lambda batches: _alike(batches, width, least), "a long, b long").distinct()
    chosen = joined(clustered.select("node", "o"), "node", pairs, "group").groupBy("group").agg(F.min("o").alias("o")).select("o.none", "o.sid", "o.hash")
    again = Window.partitionBy(*key).orderBy(F.lit(0))
    left = keyed.join(chosen, key, "left_semi").withColumn("again", F.row_number().over(again)).where("again = 1")
    return restored(left, docs)
