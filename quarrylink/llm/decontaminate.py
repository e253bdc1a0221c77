"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are compared in lower case with white space squeezed.  An item of n characters has an
error budget of k = max(1, n * ERROR_RATE) edits (at most n - 1) and is split into k + 1 pieces: an occurrence
within the budget holds at least one piece unchanged.  One automaton finds all exact piece hits in a text.  Hits
are verified bottom-up: the pieces of an item are the leaves of a binary tree whose node over m pieces has the
budget m - 1; an occurrence within the root's budget implies, on the way down to some unchanged piece, one within
the budget of each node passed, so a hit climbs from its piece and stops at the first node that Myers'
bit-parallel distance rejects.  A hit that passes the root is a match, with its smallest distance.  An item of
fewer than EDIT_CHARS characters has no budget: it is one piece, which must stand as whole words.

Result: one row for each (doc_id, item_id) that match: distance (the smallest), hits (verified hits), chars (the
item's normalised length).  Defined results: null and empty texts and items match nothing; texts with a null id
match under that null id; an item with a null id is left out; repeated rows are compared once (rows that repeat id
and text) or give the smallest distance (rows that repeat an id with other texts); extra columns are ignored; an
empty table gives an empty table.  Whole texts are searched.  The benchmark travels to the tasks in slices of about
SLICE_CHARS characters, one search of all texts for each, so that a worker's memory does not grow with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, in_small_batches, map_batches, parts, release

ERROR_RATE = 0.1
EDIT_CHARS = 20
#: About 200 bytes of a worker's memory for each character.
SLICE_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def whole_words(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on beyond either end."""
    return not (begin and text[begin - 1].isalnum() and text[begin].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def semi_global(pattern_bits: dict[str, int], length: int, text: str) -> int:
    """Smallest edit distance between the pattern and any substring of ``text`` (Myers, one big integer a column)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, length
    get = pattern_bits.get
    for c in text:
        eq = get(c, 0)
        across = eq | down
        same = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(same | up) & full, up & same
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best = score
        # The first row is free: a match may begin anywhere.
        more <<= 1
        up, down = (less << 1 | ~(across | more)) & full, more & across & full
    return best


def bits_of(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


@dataclass(frozen=True)
class Node:
    """A stretch of an item, its budget, and the node above it."""

    begin: int
    end: int
    budget: int
    bits: dict[str, int]
    parent: Node | None


class Item:
    def __init__(self, item_id, text: str, error_rate: float):
        self.item_id, self.text = item_id, text
        self.budget = min(max(1, int(len(text) * error_rate)), len(text) - 1) if len(text) >= EDIT_CHARS else 0
        n = self.budget + 1
        self.cuts = [i * len(text) // n for i in range(n + 1)]
        self.leaves: list[Node] = []
        self._grow(0, n, None)

    def _grow(self, first: int, last: int, parent: Node | None) -> None:
        begin, end = self.cuts[first], self.cuts[last]
        if last - first == 1:
            self.leaves.append(Node(begin, end, 0, {}, parent))
            return
        node = Node(begin, end, last - first - 1, bits_of(self.text[begin:end]), parent)
        middle = (first + last + 1) // 2
        self._grow(first, middle, node)
        self._grow(middle, last, node)


class Matcher:
    def __init__(self, items: list[tuple[object, str | None]], error_rate: float = ERROR_RATE):
        self.items = [Item(i, s, error_rate) for i, t in items if i is not None and (s := normalise(t))]
        places: dict[str, list[tuple[int, Node]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for leaf in item.leaves:
                places[item.text[leaf.begin : leaf.end]].append((k, leaf))
        self.finder = ahocorasick.Automaton()
        for piece, at in places.items():
            self.finder.add_word(piece, (len(piece), at))
        if places:
            self.finder.make_automaton()

    def matches(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """item_id to (smallest distance, verified hits, item length)."""
        found: dict[object, tuple[int, int, int]] = {}
        for item, distance in self.hits(text):
            old = found.get(item.item_id, (len(item.text), 0, 0))
            found[item.item_id] = (min(old[0], distance), old[1] + 1, len(item.text))
        return found

    def any_match(self, text: str | None) -> bool:
        return next(self.hits(text), None) is not None

    def hits(self, text: str | None) -> Iterator[tuple[Item, int]]:
        """Each verified hit: the item and its distance."""
        low = normalise(text)
        if not low or not self.items:
            return
        asked: dict[tuple[int, int, int, int], int] = {}
        for last, (width, places) in self.finder.iter(low):
            start = last - width + 1
            for k, leaf in places:
                item, node, distance = self.items[k], leaf.parent, 0
                if not item.budget and not whole_words(low, start, last + 1):
                    continue
                while node is not None:
                    key = (k, node.begin, node.end, start - leaf.begin)
                    if (distance := asked.get(key, -1)) < 0:
                        left = max(0, start - (leaf.begin - node.begin) - node.budget)
                        right = start + node.end - leaf.begin + node.budget
                        distance = asked[key] = semi_global(node.bits, node.end - node.begin, low[left:right])
                    if distance > node.budget:
                        break
                    node = node.parent
                else:
                    yield item, distance


def slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in slices of about SLICE_CHARS characters, dealt by a hash; one at least, which may be empty."""
    rows = id_and_text(benchmark, id_col, text_col).distinct()
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE_CHARS))
    for k in range(n):
        yield [(r["doc_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, hits, chars of each matching pair."""
    kinds = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_id_col]}, distance int, hits int, chars int"

    def search(part: list[tuple[object, str | None]]) -> DataFrame:
        items = docs.sparkSession.sparkContext.broadcast(part)

        def make():
            matcher = Matcher(items.value, error_rate)

            def work(rows):
                out = {k: [] for k in ("doc_id", "item_id", "distance", "hits", "chars")}
                for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                    for item_id, (distance, hits, chars) in sorted(matcher.matches(text).items()):
                        for k, v in zip(out, (doc_id, item_id, distance, hits, chars), strict=True):
                            out[k].append(v)
                return out

            return work

        return map_batches(id_and_text(docs, id_col, text_col), make, kinds)

    found = reduce(DataFrame.unionByName, map(search, slices(benchmark, item_id_col, item_text_col)))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("hits").alias("hits"), F.max("chars").alias("chars"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text matches no item.  Nothing is shuffled."""
    place = docs.columns.index(text_col)

    def kept(rows: DataFrame, part: list[tuple[object, str | None]]) -> DataFrame:
        items = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches):
            import pyarrow as pa

            matcher = Matcher(items.value, error_rate)
            for batch in batches:
                for some in parts(batch):
                    texts = some.column(place).cast(pa.string()).to_pylist()
                    yield some.filter(pa.array([not matcher.any_match(t) for t in texts], pa.bool_()))
            del matcher
            release()

        return in_small_batches(rows).mapInArrow(keep, docs.schema)

    return reduce(kept, slices(benchmark, item_id_col, item_text_col), docs)
