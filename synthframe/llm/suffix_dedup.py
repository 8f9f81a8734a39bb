"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

A text's suffixes are taken at sampled places: the leftmost smallest 64-byte hash of
each window of 200 bytes.  Equal windows sample the same place, so sampling loses no
match.  A suffix array is those suffixes in the order of the hash of their first 64
bytes, under which equal beginnings are neighbours as in the order of the letters.
A batch of texts gets its array; the array is merge-scanned against the levels of the
family, neighbours with equal beginnings being matches; and two levels of equal size
merge into one of twice the size.  Around the matched suffixes, groups of up to 16
windows are compared exactly by their common core and the bytes beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from synthframe.llm import repeats
from synthframe.llm.common import stash, tidied

WINDOW = 200
HEAD = 64
GROUP = 16
SEGMENT = 1 << 20
#: Batches that a table arrives in: one for so many bytes of files, within these bounds.
BATCH_BYTES, LEAST_BATCHES, MOST_BATCHES = 256 << 30, 5, 31
_BYTES = repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def content(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _rolling() -> tuple[repeats.Rolling, repeats.Rolling]:
    return repeats.Rolling(), repeats.second_rolling()


def samples(body: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sampled places, hashes of their beginnings, first and last window start that sampled each)."""
    reach = window - HEAD + 1
    first, _ = _rolling()
    numbers = _BYTES[np.frombuffer(body, dtype=np.uint8)]
    places, hashes, starts = [], [], []
    for s in range(0, len(numbers) - window + 1, SEGMENT):
        part = numbers[s:s + SEGMENT + window - 1]
        at = np.arange(len(part) - HEAD + 1)
        heads = first.windows(first.prefix(part), at, at + HEAD)
        ranked = (heads & ~np.uint64((1 << 21) - 1)) | at.astype(np.uint64)
        blocks = -(-len(ranked) // reach)
        grid = np.full(blocks * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[:len(ranked)] = ranked
        grid = grid.reshape(blocks, reach)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(ranked) - reach + 1
        least = (np.minimum(right[:n], left[reach - 1:reach - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(least, prepend=-1))
        places.append(least[new] + s)
        hashes.append(heads[least[new]])
        starts.append(new + s)
    if not places:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    place, head, start = np.concatenate(places), np.concatenate(hashes), np.concatenate(starts)
    end = np.append(start[1:], len(numbers) - window + 1) - 1
    return place, head, start, end


def suffix_array(docs: DataFrame, window: int, batch: int, batches: int) -> DataFrame:
    """The sampled suffixes of one batch of the distinct texts: (key, text, place), one per place."""
    def build(found):
        keys, checks, owners, places = [], [], [], []
        for d, e, body in found:
            if d % batches != batch or len(body) < window:
                continue
            place, head, _, _ = samples(body, window)
            place, one = np.unique(place, return_index=True)
            keys.append(head[one].astype(np.uint64))
            checks.append(np.zeros(len(place), np.int32))
            owners.append((d, e))
            places.append(place)
        yield repeats.questions(keys, checks, owners, places)

    return repeats.produce(docs, content, build)


class SuffixLevels:
    """Levels of sorted suffix arrays, at most one of each size: 1, 2, 4, ... batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.scanned: list[tuple[int, ...]] = []  # the levels that each batch met

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Merge-scan a new array against every level; (d, e, at) of suffixes with an equal beginning.

        Afterwards the array becomes a level; while one of its size exists, the two merge
        into one of twice the size.  `last` says that no batch follows, so that level need
        not be written.
        """
        array = batch if last else stash(repeats.sorted_questions(batch), "suffix-array")
        met = array
        for level in self.levels.values():
            met = met.unionByName(level)
        self.scanned.append(tuple(sorted(self.levels)))
        if not last:
            carried, size = array.filter("known IS NULL"), 0  # what a batch answers itself is no part of a level
            while size in self.levels:
                carried, size = carried.unionByName(self.levels.pop(size)), size + 1
            self.levels[size] = stash(repeats.sorted_questions(carried), f"suffix-level-{size}") if size else carried
        return repeats.answers(met)


def groups(marked: DataFrame, window: int) -> DataFrame:
    """Questions for groups of windows around the matched suffixes.

    The windows that sampled a place are cut by their distance to it into groups of 16.
    A group asks by the hash of the bytes that all its windows share and carries the 15
    bytes on either side and the range of windows it has.
    """
    core = window - GROUP + 1

    def run(batches):
        first, second = _rolling()
        for batch in batches:
            keys, checks, owners, places, extras = [], [], [], [], []
            for d, e, size, packed, at in zip(*(batch[c].to_pylist() for c in ("d", "e", "size", "body", "at")), strict=True):
                body = repeats.body_of(size, packed)
                place, _, start, end = samples(body, window)
                hit = np.isin(place, repeats.positions(at))
                place, start, end = place[hit], start[hit], end[hit]
                near, far = (place - end) // GROUP, (place - start) // GROUP
                count = far - near + 1
                which = np.repeat(np.arange(len(place)), count)
                number = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                s0 = place[which] - GROUP * number
                low = np.maximum(s0 - end[which], 0)
                high = np.minimum(s0 - start[which], GROUP - 1)
                raw = np.frombuffer(body, dtype=np.uint8)
                padded = np.concatenate((np.zeros(GROUP, np.uint8), raw, np.zeros(GROUP, np.uint8)))
                step = np.arange(GROUP - 1)
                before = padded[s0[:, None] + GROUP - 1 - step] * (step < high[:, None])
                after = padded[s0[:, None] + core + GROUP + step] * (step < (GROUP - 1 - low)[:, None])
                extras.append(np.concatenate((before, after, low[:, None], high[:, None]), axis=1).astype(np.uint8))
                numbers = _BYTES[raw]
                keys.append(first.windows(first.prefix(numbers), s0, s0 + core))
                checks.append((second.windows(second.prefix(numbers), s0, s0 + core) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                owners.append((d, e))
                places.append((s0 - high) * GROUP + high - low)
            yield repeats.questions(keys, checks, owners, places, np.concatenate(extras) if extras else np.zeros((0, 2 * GROUP), np.uint8))

    return marked.mapInArrow(tidied(run), repeats.ASKED)


def _equal_windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Window ranges of these rows (whole runs of a core) that another row of the run has too."""
    key, chk = rows["key"].to_numpy(), rows["chk"].to_numpy()
    new = np.append(True, (key[1:] != key[:-1]) | (chk[1:] != chk[:-1]))
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    rows, run = rows.filter(pa.array(many)), run[many]
    if not rows.num_rows:
        return
    sides = np.frombuffer(b"".join(rows["extra"].to_pylist()), dtype=np.uint8).reshape(-1, 2 * GROUP)
    low, high = sides[:, -2].astype(np.int64), sides[:, -1].astype(np.int64)
    factors = repeats.mix(np.arange(1, 2 * GROUP - 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    summed = np.zeros((2, len(sides), GROUP), np.uint64)
    for side in (0, 1):
        cells = _BYTES[sides[:, side * (GROUP - 1):(side + 1) * (GROUP - 1)]] * factors[side * (GROUP - 1):(side + 1) * (GROUP - 1)]
        summed[side, :, 1:] = np.cumsum(repeats.mix(cells), axis=1)
    lengths = np.arange(GROUP)
    codes = repeats.mix(summed[0] + summed[1][:, ::-1] + repeats.mix(run.astype(np.uint64) + np.uint64(1))[:, None] * (np.uint64(2) * lengths.astype(np.uint64) + np.uint64(1)))
    valid = (lengths >= low[:, None]) & (lengths <= high[:, None])
    asked = codes[valid]
    order = np.argsort(asked, kind="stable")
    same = asked[order][1:] == asked[order][:-1]
    twice = np.zeros(len(asked), bool)
    twice[order] = np.append(same, False) | np.insert(same, 0, False)
    flags = np.zeros((len(sides), GROUP + 2), np.int8)
    flags[:, 1:-1][valid] = twice
    turns = np.diff(flags, axis=1)
    row, begin = np.nonzero(turns == 1)
    _, stop = np.nonzero(turns == -1)
    s0 = rows["at"].to_numpy() // GROUP + high
    at = (s0[row] - (stop - 1)) * GROUP + (stop - begin - 1)
    yield repeats.marks(pa.table({"d": rows["d"].to_numpy()[row], "e": rows["e"].to_numpy()[row], "at": at}))


def repeated_windows(asked: DataFrame) -> DataFrame:
    """(d, e, at) of ranges of repeated windows; `at` packs the first start and the count."""
    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from repeats.known_rows(table)
            table = table.filter(pa.compute.is_null(table["known"])).select(["key", "chk", "d", "e", "at", "extra"])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            key, chk = table["key"].to_numpy(), table["chk"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (chk != chk[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
            if whole:
                yield from _equal_windows(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield from _equal_windows(rest)

    return repeats.sorted_questions(asked).mapInArrow(tidied(run), repeats.MARKED)


def _remove(marked: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for d, e, size, packed, at in zip(*(batch[c].to_pylist() for c in ("d", "e", "size", "body", "at")), strict=True):
                raw = np.frombuffer(repeats.body_of(size, packed), dtype=np.uint8)
                ranges = repeats.positions(at)
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, ranges // GROUP, 1)
                np.add.at(step, ranges // GROUP + ranges % GROUP + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                rows.append((d, e, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "e", "removed", "spans", "kept_sha"])

    return marked.mapInArrow(tidied(run), "d bigint, e int, removed bigint, spans bigint, kept_sha string")


def batches_of(docs: DataFrame) -> int:
    """Batches for a table, from the engine's estimate of its bytes; every text is in exactly one, whatever their number."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(-(-size // BATCH_BYTES), LEAST_BATCHES), MOST_BATCHES)


def deduplicate(docs: DataFrame, window: int = WINDOW, batches: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte goes if a string of `window` bytes over it occurs anywhere else, in the same
    text or another.  Null and empty texts have no bytes; texts shorter than a window
    lose none; repeated rows are copies of each other and go whole; null ids are
    carried; an empty table gives no rows; other columns are never read.
    """
    if window < HEAD + GROUP:
        raise ValueError(f"a window must hold at least {HEAD + GROUP} bytes")
    rows = stash(repeats.digests(docs, content, len), "suffix-texts")
    batches = batches or batches_of(docs)
    family, matched = SuffixLevels(), None
    for batch in range(batches):
        found = family.add(suffix_array(docs, window, batch, batches), last=batch == batches - 1)
        matched = found if matched is None else matched.unionByName(found)
    repeated = repeated_windows(groups(repeats.with_text(docs, content, matched), window))
    single = rows.groupBy("d", "e").count().filter("count = 1").select("d", "e")
    spans = _remove(repeats.with_text(docs, content, repeated.join(single, ["d", "e"], "left_semi")), window)
    return repeats.finish(rows, spans, window).withColumnRenamed("n", "n_bytes")
