"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one node.  A node has 160 minima: 32 bands of
five find candidates, and the low four bits of each minimum, packed into ten numbers,
estimate the similarity by bit counts, corrected for chance collisions.  A bitmap of
the set's hashes modulo 1024, each bit the parity of its hashes, bounds the difference
of two sets from below: a bit that differs needs an element that only one set has.
Estimate and bound only discard; every link is confirmed on the full sets.

No bucket is paired out.  First every node is tested against one node of each of its
buckets, drawn by a hash that differs from bucket to bucket, and confirmed links join nodes into components.  Then only nodes that share a
bucket but not a component are compared, for a link inside a component changes
nothing: their sketches meet in cells of at most two blocks, and only pairs that may
link leave a cell as rows.  So a group of copies of any size costs one pair for each
member, and no link between different components is skipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.llm import repeats
from synthframe.llm.common import BROADCAST_KEYS, stash, texts, tidied
from synthframe.llm.substring_dedup import _words

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
BITS, PER_LONG = 4, 16
SLACK = 0.2  # six standard deviations of the estimate from 160 minima
PARITY_BITS = 1024
WORDS = PARITY_BITS // 64
#: Nodes of a bucket that are compared in one place; a larger bucket is split.
BLOCK = 2048
#: Pairs whose sketches are in memory at once.
PAIRS_AT_ONCE = 65_536
_FACTOR = repeats.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFT = repeats.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lowered; fewer words than `size` are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words()
    numbers = known.numbers(words)
    length = min(size, len(numbers))
    at = np.arange(len(numbers) - length + 1)
    return np.unique(known.first.windows(known.first.prefix(numbers), at, at + length))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    for s in range(0, len(hashes), 2048):
        x = (hashes[s:s + 2048, None] + _SHIFT) * _FACTOR
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=0))
    return least


def signature(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(band keys, low bits of the minima packed into 64-bit numbers)."""
    least = minima(hashes)
    mixed = repeats.mix(least + np.tile(np.arange(1, ROWS + 1, dtype=np.uint64), BANDS) * np.uint64(0xD6E8FEB86659FD93))
    bands = repeats.mix(mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    low = (least >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
    packed = (low.reshape(-1, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return bands.view(np.int64).tolist(), packed.view(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """Bit i: whether an odd number of hashes are i modulo `PARITY_BITS`."""
    places = (hashes >> np.uint64(7)) & np.uint64(PARITY_BITS - 1)
    odd = np.bincount(places.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def node_of(hashes: np.ndarray) -> bytes | None:
    return hashlib.sha256(hashes.tobytes()).digest()[:16] if len(hashes) else None


def text_key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, n, text_key, bands, bits, parity) of every row.

    The node is null without words; the sketches are given once for each node of a
    batch.
    """
    def run(batches):
        for batch in batches:
            rows, seen = [], set()
            for text in batch["text"].to_pylist():
                found = shingles(text, size)
                node = node_of(found)
                new = node is not None and node not in seen
                seen.add(node)
                rows.append((node, len(found), text_key(text) if new else None, *((*signature(found), parities(found)) if new else (None, None, None))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", "node", "n", "text_key", "bands", "bits", "parity"])

    return texts(docs).mapInArrow(tidied(run), "doc_id bigint, node binary, n bigint, text_key binary, bands array<bigint>, bits array<bigint>, parity array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed bits, corrected for the chance that low bits agree."""
    differ = F.lit(0)
    for i in range(MINIMA // PER_LONG):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0 ** -BITS
    return ((1 - differ / F.lit(float(MINIMA))) - chance) / (1 - chance)


def within(a: str, b: str, sizes: Column, percent: int) -> Column:
    """Whether the bits that differ leave a link possible: (100 - percent) * sizes >= (100 + percent) * difference."""
    differ = F.lit(0)
    for i in range(WORDS):
        differ = differ + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return (100 - percent) * sizes >= (100 + percent) * differ


def plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes, parities and estimated similarity leave a link possible."""
    left = signed.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("parity").alias("parity_a"))
    right = signed.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("parity").alias("parity_b"))
    both = pairs.join(left, "a").join(right, "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = both.filter(sizes & within("parity_a", "parity_b", F.col("n_a") + F.col("n_b"), percent))
    return both.filter(estimate("bits_a", "bits_b") >= percent / 100 - SLACK).select("a", "b")


def cells(placed: DataFrame) -> DataFrame:
    """The rows (bucket, node, root, ...) of buckets with several roots, dealt into cells of bounded size.

    A bucket of up to `BLOCK` nodes is one cell.  In a larger one the nodes outside its
    commonest root are cut into blocks, which meet each other and each block of the
    commonest root; that root's nodes never meet among themselves.
    """
    present = placed.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    buckets = present.groupBy("bucket").agg(
        F.sum("of_root").alias("size"), F.count("*").alias("n_roots"), F.max(F.struct("of_root", "root")).alias("most"))
    buckets = buckets.filter("n_roots > 1").select(
        "bucket", "size", F.col("most.root").alias("major_root"),
        F.ceil(F.col("most.of_root") / BLOCK).cast("int").alias("major_parts"),
        F.ceil((F.col("size") - F.col("most.of_root")) / BLOCK).cast("int").alias("minor_parts"))
    rows = placed.join(buckets, "bucket").withColumn("major", F.expr("root = major_root"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(node, 'part'), IF(major, major_parts, minor_parts)) AS int)"))
    dealt = F.expr(f"""CASE WHEN size <= {BLOCK} THEN array(named_struct('i', 0, 'j', 0, 'mixed', false, 'tag', 0))
        WHEN major THEN transform(sequence(0, minor_parts - 1), q -> named_struct('i', q, 'j', part, 'mixed', true, 'tag', -1))
        ELSE concat(
            transform(sequence(0, minor_parts - 1), q -> named_struct('i', least(q, part), 'j', greatest(q, part), 'mixed', false, 'tag', part)),
            transform(sequence(0, major_parts - 1), q -> named_struct('i', part, 'j', q, 'mixed', true, 'tag', part))) END""")
    return rows.select("bucket", "node", "root", F.explode(dealt).alias("cell")).select("bucket", "cell.*", "node", "root")


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: np.ndarray, parity: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of row numbers sizes, parities and estimates leave possible: what `plausible` tests."""
    keep = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    differ = np.bitwise_count(parity[a[keep]] ^ parity[b[keep]]).sum(axis=1, dtype=np.int64)
    keep = keep[(100 - percent) * (n[a[keep]] + n[b[keep]]) >= (100 + percent) * differ]
    x = bits[a[keep]] ^ bits[b[keep]]
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return keep[((1 - differ / MINIMA) - chance) / (1 - chance) >= percent / 100 - SLACK]


def apart(placed: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a bucket, have different roots and may link."""
    sketches = signed.select("node", "n", "bits", "parity")
    key = ["bucket", "mixed", "i", "j"]
    rows = cells(placed).join(sketches, "node").repartition(*key).sortWithinPartitions(*key, F.desc("tag"))

    def compare(table: pa.Table) -> pa.RecordBatch:
        """Pairs of the rows of whole cells."""
        count = table.num_rows
        code = np.column_stack([table[c].to_numpy().astype(np.int64) for c in key])
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])
        end = np.repeat(np.r_[new[1:], count], np.diff(np.r_[new, count]))
        mixed, tag = code[:, 1] == 1, table["tag"].to_numpy()
        halves = mixed | (code[:, 2] != code[:, 3])  # rows with equal tags do not meet here
        root = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        n = table["n"].to_numpy()
        bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(count, -1)
        parity = table["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(count, -1)
        partners = np.where(mixed & (tag < 0), 0, end - np.arange(count) - 1)  # tags fall: a commonest root comes last
        before = np.r_[0, np.cumsum(partners)]
        found = []
        for low in range(0, int(before[-1]), PAIRS_AT_ONCE):
            at = np.arange(low, min(low + PAIRS_AT_ONCE, int(before[-1])))
            a = np.searchsorted(before, at, side="right") - 1
            b = a + 1 + at - before[a]
            meet = (root[a] != root[b]) & ~(halves[a] & (tag[a] == tag[b]))
            a, b = a[meet], b[meet]
            keep = may_link(a, b, n, bits, parity, percent)
            found.append(np.column_stack([a[keep], b[keep]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        node = table["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(pairs[:, 0])), node.take(pa.array(pairs[:, 1]))], ["a", "b"])

    def run(batches):
        """Rows of the last cell of a batch wait for the next one; a cell has two blocks at most."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            code = np.column_stack([table[c].to_numpy().astype(np.int64) for c in key])
            cuts = np.flatnonzero((code[1:] != code[:-1]).any(axis=1))
            whole = int(cuts[-1]) + 1 if len(cuts) else 0
            held = table.slice(whole)
            if whole:
                yield compare(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield compare(held)

    found = rows.mapInArrow(tidied(run), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union; texts travel compressed."""
    pairs = stash(pairs, "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = signed.select("node", "text_key").join(ends, "node", "left_semi")
    if pairs.count() <= BROADCAST_KEYS:  # at most two keys a pair; larger sets are joined by shuffle
        wanted = F.broadcast(wanted)

    def run(batches):
        for batch in batches:
            rows = {}
            for text in batch["text"].to_pylist():
                rows.setdefault(text_key(text), text)
            bodies = [text.encode("utf-8", "surrogatepass") for text in rows.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.binary()), pa.array([len(x) for x in bodies], pa.int64()),
                 pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in bodies], pa.binary())], ["text_key", "size", "body"])

    bodies = texts(docs).select("text").mapInArrow(tidied(run), "text_key binary, size bigint, body binary").join(wanted, "text_key").dropDuplicates(["node"])
    bodies = stash(bodies.select("node", "size", "body"), "near-texts")
    left = bodies.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("body").alias("body_b"))

    def test(batches):
        for batch in batches:
            hit, last, held = [], None, None
            for a, size_a, body_a, size_b, body_b in zip(*(batch[c].to_pylist() for c in ("a", "size_a", "body_a", "size_b", "body_b")), strict=True):
                if a != last:
                    last, held = a, shingles(repeats.body_of(size_a, body_a).decode("utf-8", "surrogatepass"), size)
                other = shingles(repeats.body_of(size_b, body_b).decode("utf-8", "surrogatepass"), size)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                hit.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return stash(pairs.join(left, "a").join(right, "b").mapInArrow(tidied(test), "a binary, b binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link: alternating large and small stars until nothing changes.

    Each star is a minimum per node and a join back, so a node of any degree is
    aggregated before it moves.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-stars")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select("v", "m").filter("v <> m").union(lowest.select("u", "m")).distinct()
        after = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")), "near-stars")
        state = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for t in (edges, after)]
        edges = after
        if state[0] == state[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def link_nodes(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) for all nodes that have a link to another; `rows` is the written result of `sketched`."""
    signed = stash(rows.filter("bands IS NOT NULL").drop("doc_id").dropDuplicates(["node"]), "near-signatures")
    buckets = signed.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    drawn = F.struct(F.xxhash64("node", "bucket").alias("draw"), "node")  # another pivot in each bucket
    shared = buckets.groupBy("bucket").agg(F.min(drawn).alias("low"), F.max("node").alias("top"), F.min("node").alias("bottom"))
    shared = shared.filter("top <> bottom").select("bucket", F.col("low.node").alias("pivot"))
    crowded = stash(buckets.join(shared, "bucket"), "near-buckets")
    stars = crowded.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    links = confirmed(docs, plausible(stars, signed, percent), signed, size, percent)
    roots = components(links)

    placed = crowded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    more = confirmed(docs, apart(placed, signed, percent), signed, size, percent)
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents link if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable and the row with that id is kept.
    Null, empty and wordless texts link with nothing and are kept.  Rows that repeat
    id and text are kept or dropped together.  A null id is never the smallest unless
    the component has no other.  An empty table gives no rows, and no column but
    doc_id and text is read.
    """
    rows = stash(sketched(docs, size), "near-rows")
    return grouped(rows.select("doc_id", "node", "n"), link_nodes(docs, rows, size, percent))


def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    named = placed.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), "node")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that `deduplicate` keeps, with all columns of `docs`."""
    found = deduplicate(docs, size, percent)
    dropped = stash(found.filter("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("node").alias("dropped_node")).distinct(), "near-dropped")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)

    def with_node(batches):
        for batch in batches:
            nodes = pa.array([node_of(shingles(t or "", size)) for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "near node"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    rows = docs.mapInArrow(tidied(with_node), f"{kept}`near node` binary")
    same = rows["doc_id"].eqNullSafe(dropped["dropped_id"]) & (rows["near node"] == dropped["dropped_node"])
    return rows.join(dropped, same, "left_anti").select(*docs.columns)
