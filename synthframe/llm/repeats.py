"""Repeated keys across all texts, found without gathering a common key anywhere.

A text is known by 96 bits of the SHA-256 of its words or bytes, so exact copies are one
text.  A producer turns each batch of texts into (key, text, position) questions.
Inside a batch every key is asked once, and occurrences of a key that the batch itself
holds twice are answered on the spot; so the rows of one key are at most the batches
that hold it, however common it is.  The questions are sorted by key, and equal
neighbours are answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import BROADCAST_KEYS, stash, texts, tidied

ASKED = "key bigint, chk int, d bigint, e int, at bigint, extra binary, known binary"
MARKED = "d bigint, e int, at binary"
_ASK = pa.schema([("key", pa.int64()), ("chk", pa.int32()), ("d", pa.int64()), ("e", pa.int32()), ("at", pa.int64()),
                  ("extra", pa.binary()), ("known", pa.binary())])
#: A text with more copies than this, and than a `BROADCAST_KEYS`th of the rows, is looked up by broadcast.
HEAVY_COPIES = 1000
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def text_key(content: bytes) -> tuple[int, int, str]:
    """(d, e, hex) of a text: the first 64 and the next 32 bits of its SHA-256, and all of it."""
    digest = hashlib.sha256(content)
    raw = digest.digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:12], "little", signed=True), digest.hexdigest()


class Rolling:
    """Hashes of any window of a sequence of 64-bit numbers, modulo 2^64, from one prefix sum."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, self.base))))
        self.inverses = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, self.inverse))))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.powers):
            self.grow(2 * len(values))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[:len(values)])))

    def windows(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def second_rolling() -> Rolling:
    return Rolling(_SECOND)


def questions(keys: list[np.ndarray], checks: list[np.ndarray], owners: list[tuple[int, int]], places: list[np.ndarray],
              extras: np.ndarray | None = None) -> pa.RecordBatch:
    """The questions of a batch: each (key, check[, extra]) once, and answers for those that it holds twice."""
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    check = np.concatenate(checks) if checks else np.zeros(0, np.int32)
    place = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(owners)), sizes)
    d = np.array([o[0] for o in owners], dtype=np.int64)
    e = np.array([o[1] for o in owners], dtype=np.int32)
    words = None if extras is None else np.ascontiguousarray(extras).view(f"S{extras.shape[1]}").ravel()
    order = np.lexsort((check, key)) if words is None else np.lexsort((words, check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    if words is not None:
        x = words[order]
        new[1:] |= x[1:] != x[:-1]
    first = order[new]
    run = np.cumsum(new) - 1
    twice = np.bincount(run, minlength=len(first))[run] > 1 if len(run) else np.zeros(0, bool)
    first = np.sort(first)  # by text again, so that a text's rows lie together and compress
    known = order[twice]
    known = known[np.argsort(owner[known], kind="stable")]
    cuts = np.flatnonzero(np.diff(owner[known], prepend=-1)) if len(known) else np.zeros(0, int)
    groups = [(int(owner[known[s]]), place[known[s:t]].tobytes()) for s, t in zip(cuts, np.append(cuts, len(known))[1:], strict=True)]
    held = np.array([g[0] for g in groups], dtype=np.int64)
    n, m = len(first), len(groups)
    columns = [
        pa.array(np.concatenate((key[first], mix(d[held].view(np.uint64)).view(np.int64) if m else np.zeros(0, np.int64)))),
        pa.array(np.concatenate((check[first], np.zeros(m, np.int32))).astype(np.int32)),
        pa.array(np.concatenate((d[owner[first]], d[held])) if len(d) else np.zeros(0, np.int64)),
        pa.array(np.concatenate((e[owner[first]], e[held])).astype(np.int32) if len(e) else np.zeros(0, np.int32)),
        pa.array(np.concatenate((place[first], np.zeros(m, np.int64)))),
        pa.array([*([None] * n if extras is None else [v.tobytes() for v in extras[first]]), *[None] * m], pa.binary()),
        pa.array([None] * n + [g[1] for g in groups], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ASK)


def sorted_questions(asked: DataFrame) -> DataFrame:
    """Questions brought together by key; answers of a batch travel by their text."""
    return asked.repartition(F.col("key")).sortWithinPartitions("key", "chk")


def answers(asked: DataFrame) -> DataFrame:
    """(d, e, at): packed positions whose key occurs at least twice."""
    def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from known_rows(table)
            table = table.filter(pa.compute.is_null(table["known"])).select(["key", "chk", "d", "e", "at"])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if table.num_rows < 2:
                rest = table
                continue
            key, chk = table["key"].to_numpy(), table["chk"].to_numpy()
            same = (key[1:] == key[:-1]) & (chk[1:] == chk[:-1])
            hit = np.append(same, False) | np.insert(same, 0, False)
            yield marks(table.filter(pa.array(hit)))
            rest = table.slice(table.num_rows - 1)

    return sorted_questions(asked).mapInArrow(tidied(equal_neighbours), MARKED)


def known_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    known = table.filter(pa.compute.is_valid(table["known"]))
    if known.num_rows:
        yield pa.RecordBatch.from_arrays([known[c].combine_chunks() for c in ("d", "e", "known")], ["d", "e", "at"])


def marks(rows: pa.Table) -> pa.RecordBatch:
    """One row per text of these rows, with its positions packed."""
    d, e, at = (rows[c].to_numpy() for c in ("d", "e", "at"))
    order = np.lexsort((e, d))
    d, e, at = d[order], e[order], at[order]
    cuts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]))) if len(d) else np.zeros(0, int)
    packed = [at[s:t].tobytes() for s, t in zip(cuts, np.append(cuts, len(d))[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(d[cuts], pa.int64()), pa.array(e[cuts], pa.int32()), pa.array(packed, pa.binary())], ["d", "e", "at"])


def produce(docs: DataFrame, content: Callable[[str], bytes], build: Callable, schema: str = ASKED) -> DataFrame:
    """`build(list of (d, e, content))` for the distinct texts of every batch."""
    def run(batches):
        for batch in batches:
            found = {}
            for text in batch["text"].to_pylist():
                body = content(text)
                found.setdefault(text_key(body)[:2], body)
            yield from build([(d, e, body) for (d, e), body in found.items()])

    return texts(docs).select("text").mapInArrow(tidied(run), schema)


def with_text(docs: DataFrame, content: Callable[[str], bytes], marked: DataFrame) -> DataFrame:
    """(d, e, at list, body) of every marked text; bodies travel compressed."""
    def build(found):
        bodies = [pa.compress(body, codec="zstd", asbytes=True) for _, _, body in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                                          pa.array([len(f[2]) for f in found], pa.int64()), pa.array(bodies, pa.binary())], ["d", "e", "size", "body"])

    bodies = produce(docs, content, build, "d bigint, e int, size bigint, body binary")
    per_text = stash(marked.groupBy("d", "e").agg(F.collect_list("at").alias("at")), "marked-places")  # at most a text's own positions
    if per_text.count() <= BROADCAST_KEYS:
        bodies = bodies.join(F.broadcast(per_text.select("d", "e")), ["d", "e"], "left_semi")  # other texts need not travel
    return bodies.join(per_text, ["d", "e"])


def body_of(row_size: int, packed: bytes) -> bytes:
    return pa.decompress(packed, decompressed_size=row_size, codec="zstd", asbytes=True)


def positions(packed: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(packed), dtype=np.int64))


def digests(docs: DataFrame, content: Callable[[str], bytes], size: Callable[[bytes], int]) -> DataFrame:
    """(doc_id, d, e, n, sha) of every row."""
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                body = content(text)
                rows.append((*text_key(body), size(body)))
            d, e, sha, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(d, pa.int64()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "d", "e", "n", "sha"])

    return texts(docs).mapInArrow(tidied(run), "doc_id bigint, d bigint, e int, n bigint, sha string")


def finish(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256): spans per text given back to every row.

    A text that occurs more than once and is at least a window long is removed whole.
    The keys of texts with very many copies are broadcast, so their rows stay where they
    are; their number is bounded because each has more than a `BROADCAST_KEYS`th of the rows.
    """
    limit = max(HEAVY_COPIES, -(-rows.count() // BROADCAST_KEYS))
    copies = stash(rows.groupBy("d", "e").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeat-copies")
    uncut = copies.selectExpr("d", "e", "copies", "cast(null AS bigint) AS removed", "cast(null AS bigint) AS spans", "cast(null AS string) AS kept_sha")
    heavy = F.broadcast(uncut.filter(F.col("copies") > limit))
    light = uncut.filter(F.col("copies") <= limit).unionByName(spans.withColumn("copies", F.lit(1).cast("long")))
    changed = rows.join(heavy.select("d", "e"), ["d", "e"], "left_anti").join(light, ["d", "e"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    whole = (F.col("copies") > 1) & (F.col("n") >= window)
    return changed.unionByName(rows.join(heavy, ["d", "e"])).select(
        "doc_id", "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))
