"""Benchmark passages in documents, found within an edit budget by pigeonhole pieces.

An item that may be changed by k edits is cut into k + 1 pieces, one of which must
survive unchanged.  All pieces are searched in one pass of an automaton over the whole
text, and around each hit the item is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import texts, tidied

#: One edit for so many characters of an item.
CHARACTERS_PER_EDIT = 20
#: Items are taken in blocks of about so many characters; each block is one pass.
BLOCK_CHARACTERS = 8_000_000
OUT = "doc_id bigint, item_id bigint, distance int, ends_at bigint"


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the `edits` + 1 pieces, as equal as can be."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def closest(item: str, window: str) -> tuple[int, int]:
    """(least edit distance of the item to any part of the window, where the first such part ends).

    The columns of the distance table are two bit vectors of vertical steps, which
    Python's integers hold at any length.
    """
    masks: dict[str, int] = {}
    for i, char in enumerate(item):
        masks[char] = masks.get(char, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, char in enumerate(window):
        equal = masks.get(char, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        across_plus = minus | ~(diagonal | plus) & full
        across_minus = plus & diagonal
        score += bool(across_plus & top) - bool(across_minus & top)
        across_plus = across_plus << 1 & full
        plus = across_minus << 1 & full | ~(diagonal | across_plus) & full
        minus = across_plus & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton of all pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], characters_per_edit: int):
        self.items = [(i, normal(t)) for i, t in items if t and normal(t)]
        self.edits = [len(t) // characters_per_edit for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, self.edits[n]):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the closest part of each item that is within its budget."""
        if not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                begin = last - length + 1 - offset
                windows.setdefault(n, []).append((begin, begin + len(self.items[n][1])))
        found = []
        for n, spans in windows.items():
            item_id, item = self.items[n]
            best = None
            begin, end = None, None
            for a, b in [*sorted(spans), (None, None)]:
                if begin is not None and a is not None and a - self.edits[n] <= end + self.edits[n]:
                    end = max(end, b)  # windows that touch are searched as one
                    continue
                if begin is not None:
                    start = max(0, begin - self.edits[n])
                    distance, stop = closest(item, text[start:end + self.edits[n]])
                    if distance <= self.edits[n] and (best is None or distance < best[0]):
                        best = (distance, start + stop)
                begin, end = a, b
            if best:
                found.append((item_id, *best))
        return sorted(found)


def find(docs: DataFrame, benchmark: DataFrame, characters_per_edit: int = CHARACTERS_PER_EDIT, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """doc_id, item_id, distance and ends_at (in the normalised text) of every item found in a document.

    A part of a text within len(item) // characters_per_edit edits of the item is a
    match; the closest, and of those the first, is given.  Null and empty texts and
    items match nothing; repeated rows and items are matched each; null ids are carried;
    empty tables give no rows; no other column is read.
    """
    rows = texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-total // block_characters) or 1
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # a block's characters

        def search(batches, held=held):
            matcher = Matcher(held.value, characters_per_edit)
            for batch in batches:
                out = [(doc, *match) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for match in matcher.matches(text)]
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "ends_at"])

        searched = rows.mapInArrow(tidied(search), OUT)
        found = searched if found is None else found.unionByName(searched)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, characters_per_edit: int = CHARACTERS_PER_EDIT) -> DataFrame:
    """The rows of `docs`, all columns, in which no item is found."""
    texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    kept = docs
    blocks = -(-total // BLOCK_CHARACTERS) or 1
    for block in range(blocks):
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()])

        def clean(batches, held=held):
            matcher = Matcher(held.value, characters_per_edit)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t or "") for t in batch["text"].to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(tidied(clean), docs.schema)
    return kept
