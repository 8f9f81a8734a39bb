"""Best-fit packing with swap-based local search.

Texts are tokenized once and cut into pieces of at most one sequence.  Piece lengths
(never texts) are dealt at random into shards of a fixed expected size; a shard is
packed by best fit on decreasing lengths, and a local search then exchanges one for
one, two for one, or moves pieces between underfull bins whenever that raises the
sum of squared fills, which empties bins.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import stash, texts, tidied

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 20_000
CACHE_WORDS = 700_000


class _Tokenizer:
    """Ids of a text as packed little-endian 32-bit numbers, word by word through a cache.

    The vocabulary's pattern never joins characters across white space, so the ids of
    a text are those of its space-separated words in turn.  Words of printable Latin
    letters are normalised and split here and only unseen pieces go to the merges;
    any other word, and any that could hold a special token, goes to the tokenizer
    whole.  Both caches start anew when full.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.inner = Tokenizer.from_file(path)
        self.merges = self.inner.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = re.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+")
        # fixed value: the split pattern of the vocabulary
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if "<|" in text or not self.plain.fullmatch(text):
            return np.array(self.inner.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = b""
        for piece in self.split(text.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                symbols = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
                ids = np.array([t.id for t in self.merges.tokenize(symbols)], dtype="<u4").tobytes()
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = ids
            out += ids
        return out

    def packed(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").lower().split()  # lowers A-Z only; the vocabulary is lower case
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = {w: self.word(w) for w in set(words).difference(known)}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new |= {w: self.word(w) for w in set(words).difference(new)}
        known.update(new)
        return b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Tokenizer:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Tokenizer(path)


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each whole text and one end id, cut every `capacity`."""
    def pieces(batches):
        tokenizer = _tokenizer(vocabulary)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokenizer.packed(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(tidied(pieces), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(lengths: list[int], capacity: int = CAPACITY, rounds: int | None = None) -> list[list[int]]:
    """Bins of indexes of `lengths`: best fit decreasing, then local search over the underfull bins.

    The search ends when no exchange improves or no bin can be saved, or after `rounds` passes.
    """
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], b))
    fewest = -(-sum(lengths) // capacity)
    passes = 0
    while len(bins) > fewest and (rounds is None or passes < rounds):
        changed = _improve(bins, lengths, capacity, fewest)
        bins = [b for b in bins if b]
        passes += 1
        if not changed:
            break
    return bins


def _parts(members: list[int], lengths: list[int]) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Sizes that one and two pieces of a bin have, each with pieces of that size; equal sizes are interchangeable."""
    by: dict[int, list[int]] = {}
    for i in members:
        by.setdefault(lengths[i], []).append(i)
    kinds, pairs = list(by.items()), {}
    for k, (n, own) in enumerate(kinds):
        if len(own) > 1:
            pairs.setdefault(2 * n, (own[0], own[1]))
        for m, others in kinds[k + 1:]:
            pairs.setdefault(n + m, (own[0], others[0]))
    return {n: (own[0],) for n, own in kinds}, pairs


class _Offers:
    """What bins can give back for pieces they take, by size.

    An offer takes up to its reach: its size and its bin's room.  The gain is largest
    for the smallest offer that reaches far enough, found in the running maximum.
    """

    def __init__(self, offers: list[tuple[int, int, tuple]], room: np.ndarray):
        offers.sort(key=lambda x: x[:2])
        self.pieces = [x[2] for x in offers]
        self.size, self.bin = (np.array([x[k] for x in offers], dtype=np.int64) for k in (0, 1))
        self.reach = self.size + room[self.bin]
        self.top = np.maximum.accumulate(self.reach) if offers else self.reach

    def best(self, size: int, usable: np.ndarray) -> int | None:
        """The smallest offer below `size` of a usable bin that takes `size`."""
        at, end = int(np.searchsorted(self.top, size)), int(np.searchsorted(self.size, size))
        if at >= end:
            return None
        if usable[self.bin[at]]:
            return at
        hits = (self.reach[at:end] >= size) & usable[self.bin[at:end]]
        first = int(hits.argmax())
        return at + first if hits[first] else None


def _improve(bins: list[list[int]], lengths: list[int], capacity: int, fewest: int = 0) -> bool:
    """One pass of moves and exchanges from each underfull bin, the emptiest first, into any fuller one; whether any was made.

    A transfer from a bin to one at least as full raises the sum of squared fills, so
    passes end.  Of all targets the one with the largest gain is taken: a piece or two
    (move), a piece for a smaller one (one for one), or two pieces for one and one for
    two.  Offers of bins that changed are kept apart and made anew with each change.
    """
    fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)
    left = sum(1 for b in bins if b)

    def offers(numbers) -> tuple[_Offers, _Offers]:
        few, pairs = [], []
        for b in numbers:
            if 0 < fill[b] < capacity:
                one, two = _parts(bins[b], lengths)
                few += [(0, b, ()), *((n, b, p) for n, p in one.items())]
                pairs += [(n, b, p) for n, p in two.items()]
        return _Offers(few, capacity - fill), _Offers(pairs, capacity - fill)

    clean = np.ones(len(bins), dtype=bool)
    known, fresh, stale = offers(range(len(bins))), offers(()), set()
    changed = False
    for source in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b)):
        while bins[source] and fill[source] < capacity:
            fuller = fill >= fill[source]
            fuller[source] = False
            one, two = _parts(bins[source], lengths)
            gain, best = 0, None
            for (few, pairs), usable in ((known, fuller & clean), (fresh, fuller)):
                for options, given in ((one, few), (two, few), (one, pairs)):
                    for size, take in options.items():
                        at = given.best(size, usable) if size > gain else None
                        if at is not None and size - given.size[at] > gain:
                            gain, best = int(size - given.size[at]), (take, given.pieces[at], int(given.bin[at]))
            if best is None:
                break
            take, give, target = best
            bins[source] = [i for i in bins[source] if i not in take] + list(give)
            bins[target] = [i for i in bins[target] if i not in give] + list(take)
            fill[source] -= gain
            fill[target] += gain
            changed = True
            left -= not bins[source]
            if left <= fewest:
                return True
            stale |= {source, target}
            clean[source] = clean[target] = False
            if len(stale) > 64:
                known, fresh, stale = offers(range(len(bins))), offers(()), set()
                clean[:] = True
            else:
                fresh = offers(stale)
    return changed


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone.  Repeated rows are packed
    as often as they occur; null ids are carried; an empty table gives no rows; columns
    other than doc_id and text are never read.  Pieces are dealt by a hash of id, piece
    and checksum and, for repeated rows, of their place in the written table, so equal
    rows spread over all shards.
    """
    pieces = stash(tokenize(docs, vocabulary, capacity), "packing-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def shard_bins(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        base = table["shard"][0].as_py() << 32
        for number, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(
        shard_bins, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
