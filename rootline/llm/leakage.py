"""Passages of held-out test items in a corpus, by a distributed positional inverted index.

The training side is tokenised once and stored, whatever the test items: ``build`` writes an index of
all words of all documents.  It is partitioned by documents: a row (*shard*) holds some documents'
cells laid end to end, and for every term in them the sorted list of its places.  Terms are 64-bit
hashes of words.  Cells are kept apart by gaps no window reaches across, so a place tells document,
cell and position.

A search sends the test items to the shards.  Of every window of ``words`` consecutive words the
rarest term in the shard is looked up; the lists of the other terms, shifted by their offsets, are
intersected with the places found; what is left in an unbroken row of at least ``words`` is an exact
phrase match.  All lists a match needs lie in its shard, so neither postings nor candidates are
shuffled, only matches leave.  No list is capped and no item left out.

Test items travel to the tasks in blocks of at most ``BLOCK_WORDS`` words (8 bytes each); each block
reads the stored index, not the corpus.

A word is a maximal run of letters or digits, case aside; a passage lies within one cell of the
notebook as a reader sees it.

Defined results: null texts and items hold nothing; items of fewer than ``words`` words can't match;
repeated item ids with different texts each count; a document that holds several items gives a row
for each; an empty corpus or test set gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootline.llm.notebooks import batch_cells, compact_columns
from rootline.session import materialize

#: Consecutive words that make a passage.
WORDS = 12

#: Words of test items that are searched for at once: what is sent to every task.
BLOCK_WORDS = 500_000

#: Words after which a shard is closed; a document is never split, so a shard holds one at least.
SHARD_WORDS = 250_000

#: Places between two cells of a shard, more than a window and its slack can reach.
GAP = 1_000

#: Alignments of a test item with a shard that are looked at together.
ALIGNMENTS = 200_000

#: Hashes of words that a task remembers.
CACHE_WORDS = 1_000_000

WORD = re.compile(r"[^\W_]+")

SHARDS = pa.schema([("docs", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
SHARDS_DDL = "docs array<long>, cells array<int>, starts array<int>, terms array<long>, counts array<int>, places array<int>"

MATCHES = "item_id long, doc_id long, cell int, start int, item_start int, words int"


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    return WORD.findall(text.lower()) if text else []


def term(word: str) -> int:
    """The term of a word: a signed 64-bit hash."""
    found = xxhash.xxh64_intdigest(word)
    return found - (1 << 64) if found >= 1 << 63 else found


class _Terms(dict):
    """Terms by word, each hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = term(word)
        return found


def _close(docs: list[int], cells: list[int], starts: list[int], runs: list[np.ndarray]) -> pa.RecordBatch:
    words = np.concatenate(runs)
    at = np.repeat(np.asarray(starts, dtype=np.int64), [len(r) for r in runs])
    at += np.concatenate([np.arange(len(r)) for r in runs])
    order = np.argsort(words, kind="stable")  # places ascend within a term
    terms, counts = np.unique(words[order], return_counts=True)
    row = (docs, cells, starts, terms, counts.astype(np.int32), at[order].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SHARDS, strict=True)], schema=SHARDS)


def _sharder(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, end = _Terms(), ([], [], [], []), 0
        for batch in batches:
            for doc_id, parsed in batch_cells(batch):
                for at, (_, content) in enumerate(parsed):
                    found = WORD.findall(content.lower())
                    if found:
                        docs, cells, starts, runs = held
                        docs.append(doc_id)
                        cells.append(at)
                        starts.append(end)
                        runs.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)))
                        end += len(found) + GAP
                if end >= shard_words:
                    if held[0]:
                        yield _close(*held)
                    held, end = ([], [], [], []), 0
        if held[0]:
            yield _close(*held)

    return run


def build(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of a corpus, stored: one row per shard, see the module.

    ``docs``, ``cells`` and ``starts`` list the cells in order of place; ``places`` holds the lists of
    ``terms`` (ascending) one after the other, ``counts`` their lengths.
    """
    return materialize(compact_columns(documents).mapInArrow(_sharder(shard_words), SHARDS_DDL), "postings")


class Shard:
    """A row of the index, for looking up."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def values(i: int) -> np.ndarray:
            return batch.column(i)[row].values.to_numpy(zero_copy_only=False)

        self.docs, self.cells, self.starts, self.terms, self.counts, self.places = map(values, range(6))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        # (term, place) as one ascending number, so that one search answers whether a term stands at a place
        self.span = int(self.places.max()) + 2 * GAP if len(self.places) else 1
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts) * self.span + self.places + GAP

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this shard, -1 for those it lacks."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def stands(self, numbers: np.ndarray, places: np.ndarray, slack: int = 0) -> np.ndarray:
        """Whether each term stands within ``slack`` of each place."""
        asked = numbers * self.span + places + GAP
        at = np.searchsorted(self.keys, asked - slack)
        near = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (numbers >= 0) & (places > -GAP) & (at < len(self.keys)) & (near <= asked + slack)

    def where(self, places: np.ndarray) -> np.ndarray:
        """The number of the cell that holds each place."""
        return np.searchsorted(self.starts, places, side="right") - 1


class Items:
    """A block of test items as one row of terms; ``room[i]`` words of the same item follow place i."""

    def __init__(self, ids: list[int], texts: list[list[int]]):
        lengths = [len(t) for t in texts]
        self.terms = np.fromiter((t for text in texts for t in text), dtype=np.int64, count=sum(lengths))
        self.owner = np.repeat(np.arange(len(ids)), lengths)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        self.ids = np.asarray(ids, dtype=np.int64)

    def windows(self, words: int) -> np.ndarray:
        """The first places of all windows of so many words within one item."""
        if len(self.owner) < words:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.owner[: len(self.owner) - words + 1] == self.owner[words - 1 :])


def _pieces(anchors: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Anchors in pieces of about ``ALIGNMENTS`` alignments."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(anchors):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + ALIGNMENTS, side="right")))
        yield anchors[at:upto]
        at = upto


def _aligned(shard: Shard, numbers: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place) for all places of the term of each anchor."""
    counts = shard.counts[numbers[anchors]]
    each = np.repeat(anchors, counts)
    offsets = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    return each, shard.places[shard.first[numbers[each]] + offsets].astype(np.int64)


def phrases(shard: Shard, items: Items, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item place, shard place, words) of the maximal rows of at least ``words`` shared words."""
    numbers = shard.number(items.terms)
    starts = items.windows(words)
    frequency = np.where(numbers >= 0, shard.counts[np.maximum(numbers, 0)], 0)
    grid = frequency[starts[:, None] + np.arange(words)]
    whole = grid.min(axis=1, initial=1 << 30) > 0  # windows all of whose terms the shard has
    anchors = np.unique(starts[whole] + grid[whole].argmin(axis=1))
    found = []
    for some in _pieces(anchors, frequency[anchors]):
        each, place = _aligned(shard, numbers, some)
        reach = np.arange(-(words - 1), words)
        # grow both ways from the anchor while terms stand where they should: candidates fall out early
        left, right = np.zeros(len(each), np.int64), np.ones(len(each), np.int64)
        for step, size in ((-1, left), (1, right)):
            alive = np.arange(len(each))
            for d in range(1, int(reach[-1]) + 1):
                at = each[alive] + step * d
                inside = (at >= 0) & (at < len(numbers))
                alive, at = alive[inside], at[inside]
                ok = (items.owner[at] == items.owner[each[alive]]) & shard.stands(numbers[at], place[alive] + step * d)
                alive = alive[ok]
                if not len(alive):
                    break
                size[alive] += 1
        long = left + right >= words
        found.append(np.stack([each[long] - left[long], place[long] - left[long], (left + right)[long]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    at, place, size = np.concatenate(found, axis=1)
    # rows found from several anchors along one alignment, joined where they touch
    order = np.lexsort((at, place - at))
    at, place, size = at[order], place[order], size[order]
    shift = place - at
    owner = items.owner[at] if len(at) else at
    out: list[list[int]] = []
    for a, p, n, s, o in zip(at.tolist(), place.tolist(), size.tolist(), shift.tolist(), owner.tolist(), strict=True):
        if out and out[-1][3] == s and out[-1][4] == o and a <= out[-1][0] + out[-1][2]:
            out[-1][2] = max(out[-1][2], a + n - out[-1][0])
        else:
            out.append([a, p, n, s, o])
    joined = np.array(out, dtype=np.int64).reshape(-1, 5)
    return joined[:, 0], joined[:, 1], joined[:, 2]


def near(shard: Shard, items: Items, words: int, terms: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item place, shard place, terms): alignments with at least ``terms`` of ``words`` consecutive
    words of an item each within ``slack`` places of where they should be, and the most they have."""
    numbers = shard.number(items.terms)
    starts = items.windows(words)
    frequency = np.where(numbers >= 0, shard.counts[np.maximum(numbers, 0)], 0)
    grid = frequency[starts[:, None] + np.arange(words)]
    # such a window has at least one of its ``words - terms + 1`` rarest words, those that are there at all
    rarest = starts[:, None] + np.argsort(grid, axis=1, kind="stable")[:, : words - terms + 1]
    enough = (grid > 0).sum(axis=1) >= terms
    anchors = np.unique(rarest[enough])
    anchors = anchors[frequency[anchors] > 0]
    found = []
    for some in _pieces(anchors, frequency[anchors]):
        each, exact = _aligned(shard, numbers, some)
        for place in (exact + s for s in range(-slack, slack + 1)):  # the anchor itself may be off its place
            hits = np.zeros((len(each), 2 * words - 1), np.int8)
            for i, d in enumerate(range(-(words - 1), words)):
                at = each + d
                inside = (at >= 0) & (at < len(numbers))
                at = np.where(inside, at, 0)
                hits[:, i] = inside & (items.owner[at] == items.owner[each]) & shard.stands(numbers[at], place + d, slack)
            sums = np.cumsum(np.pad(hits, ((0, 0), (1, 0))), axis=1, dtype=np.int64)
            best = (sums[:, words:] - sums[:, :-words]).max(axis=1, initial=0)
            keep = best >= terms
            found.append(np.stack([each[keep], exact[keep], best[keep]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64),) * 3


def _blocks(items: DataFrame, block_words: int) -> Iterator[Items]:
    """Test items in blocks of a bounded number of words, streamed to the driver."""
    ids, texts, held, known = [], [], 0, _Terms()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        found = [known[w] for w in words_of(r.text)]
        if texts and held + len(found) > block_words:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(found)
        held += len(found)
    if texts:
        yield Items(ids, texts)


def _search(index: DataFrame, block: Items, look, schema: str) -> DataFrame:
    """What ``look`` (a function of a shard and the items) finds in all shards: item, document, cell,
    place in the cell and in the item, and a number."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                at, place, number = look(shard, items)
                if not len(at):
                    continue
                cell, owner = shard.where(place), items.owner[at]
                columns = (items.ids[owner], shard.docs[cell], shard.cells[cell], place - shard.starts[cell], at - items.begin[owner], number)
                kinds = (pa.int64(), pa.int64(), *(pa.int32(),) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return index.mapInArrow(run, schema)


def _all_blocks(index: DataFrame, items: DataFrame, block_words: int, look, schema: str) -> DataFrame:
    found = [_search(index, block, look, schema) for block in _blocks(items, block_words)]
    return reduce(DataFrame.unionByName, found) if found else index.sparkSession.createDataFrame([], schema)


def matches_in(index: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, cell, start, item_start, words): the maximal passages that a cell of an
    indexed corpus and an item share, by their first word in the cell and in the item."""
    if not 0 < words < GAP // 2:
        raise ValueError(f"a passage has 1 to {GAP // 2} words")
    return _all_blocks(index, items, block_words, lambda shard, block: phrases(shard, block, words), MATCHES)


def matches(documents: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``matches_in`` an index made for this call."""
    return matches_in(build(documents), items, words, block_words)


def leaked(documents: DataFrame, items: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id): the pairs of a test item and a document that holds a passage of it."""
    return matches(documents, items, words, block_words).select("item_id", "doc_id").distinct()


def proximity_in(index: DataFrame, items: DataFrame, words: int = WORDS, terms: int = 10, slack: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, terms): pairs where a cell of an indexed corpus holds at least ``terms`` of
    some ``words`` consecutive words of an item, each within ``slack`` words of its place along some
    alignment of the two; the most found."""
    if not (0 < terms <= words and words + slack < GAP // 2 and slack >= 0):
        raise ValueError("terms are at most words, which with the slack are fewer than half the gap between cells")
    found = _all_blocks(index, items, block_words, lambda shard, block: near(shard, block, words, terms, slack), MATCHES)
    return found.groupBy("item_id", "doc_id").agg(F.max("words").alias("terms"))


def proximity(documents: DataFrame, items: DataFrame, words: int = WORDS, terms: int = 10, slack: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``proximity_in`` an index made for this call."""
    return proximity_in(build(documents), items, words, terms, slack, block_words)
