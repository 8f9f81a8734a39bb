"""Repeated word windows by difference-cover anchors.

Positions whose remainder modulo 21 lies in a difference cover are anchors: whatever
the remainders of two positions, some shift below 21 brings both onto the cover.  So
any two equal windows of 35 words share 15 words that start at an anchor of both.
Only anchors are hashed and asked for; around the anchors that repeat, whole windows
are hashed with 96 bits and asked for again, which extends the matches exactly.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from synthframe.llm import repeats
from synthframe.llm.common import stash, tidied

WINDOW = 35
#: A perfect difference set modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WORDS_KEPT = 120_000


def content(text: str) -> bytes:
    """The words of a text joined by one space; no word holds one of the six separators."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def count(body: bytes) -> int:
    return body.count(b" ") + 1 if body else 0


class _Words:
    """64-bit numbers of words, through a cache that starts anew when full."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.first, self.second = repeats.Rolling(), repeats.second_rolling()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(words).difference(known)}
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(words)}
        known.update(new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _check(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Questions for every anchor of every text."""
    length = window - PERIOD + 1

    def build(found):
        words = _words()
        keys, checks, owners, places = [], [], [], []
        for d, e, body in found:
            numbers = words.numbers(body.split(b" ") if body else [])
            if len(numbers) < window:
                continue
            at = np.arange(len(numbers) - length + 1)
            at = at[np.isin(at % PERIOD, COVER)]
            keys.append(words.first.windows(words.first.prefix(numbers), at, at + length))
            checks.append(np.zeros(len(at), np.int32))
            owners.append((d, e))
            places.append(at)
        yield repeats.questions(keys, checks, owners, places)

    return repeats.produce(docs, content, build)


def _bodies(batch: pa.RecordBatch):
    for d, e, size, packed, at in zip(*(batch[c].to_pylist() for c in ("d", "e", "size", "body", "at")), strict=True):
        yield d, e, repeats.body_of(size, packed), repeats.positions(at)


def windows(marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Questions for every window that holds a repeated anchor within reach."""
    def run(batches):
        words = _words()
        for batch in batches:
            keys, checks, owners, places = [], [], [], []
            for d, e, body, at in _bodies(batch):
                numbers = words.numbers(body.split(b" "))
                last = len(numbers) - window
                step = np.zeros(last + PERIOD + window + 1, np.int32)
                np.add.at(step, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(step, at + 1, -1)
                start = np.flatnonzero(np.cumsum(step)[:last + 1] > 0)
                keys.append(words.first.windows(words.first.prefix(numbers), start, start + window))
                checks.append(_check(words.second.windows(words.second.prefix(numbers), start, start + window)))
                owners.append((d, e))
                places.append(start)
            yield repeats.questions(keys, checks, owners, places)

    return marked.mapInArrow(tidied(run), repeats.ASKED)


def _remove(marked: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for d, e, body, at in _bodies(batch):
                words = body.split(b" ")
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((d, e, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "e", "removed", "spans", "kept_sha"])

    return marked.mapInArrow(tidied(run), "d bigint, e int, removed bigint, spans bigint, kept_sha string")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every row.

    A word goes if a window of `window` words over it occurs anywhere else, in the same
    text or another.  Null and empty texts have no words; texts shorter than a window
    lose none; repeated rows are copies of each other and go whole; null ids are
    carried; an empty table gives no rows; other columns are never read.
    """
    if window <= PERIOD:
        raise ValueError(f"a window must be longer than the period of the cover, {PERIOD}")
    rows = stash(repeats.digests(docs, content, count), "substring-texts")
    anchored = repeats.with_text(docs, content, repeats.answers(anchors(docs, window)))
    repeated = repeats.answers(windows(anchored, window))
    single = rows.groupBy("d", "e").count().filter("count = 1").select("d", "e")
    spans = _remove(repeats.with_text(docs, content, repeated.join(single, ["d", "e"], "left_semi")), window)
    return repeats.finish(rows, spans, window).withColumnRenamed("n", "n_words")
