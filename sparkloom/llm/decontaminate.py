"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: lower case, every run of characters that are no letter or digit becomes one space. An item of m
characters may be met with k = m // CHARS_PER_EDIT edits; cut into k + 1 pieces, at least one piece of any such occurrence is intact. One
Aho-Corasick pass finds all intact pieces in a text, and Myers' bit-parallel distance verifies the window each hit points at.
Items that normalise to nothing never match; items shorter than `CHARS_PER_EDIT` need an exact occurrence between word ends. A
null or empty text matches nothing. The benchmark is broadcast, so its size is checked against `max_items_chars`; a larger one is
handled in several passes of that size over the documents, of which the driver holds one part at a time. Items that share an id (null included) are
one item with several texts, of which the best place counts; ties between places go to the first. Ids may have any type. Repeated documents are
judged each; empty tables give no rows; of clashing or extra columns only those named here are read, and `clean` returns all.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from .store import worker_state

CHARS_PER_EDIT = 16
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end of such a substring."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    def __init__(self, items: list[tuple], chars_per_edit: int = CHARS_PER_EDIT):
        self.items = sorted({(i, n) for i, t in items if (n := normal(t or ""))}, key=lambda x: (x[0] is not None, x[0], x[1]) if x[0] is not None else (False, 0, x[1]))
        self.budget = [len(n) // chars_per_edit for _, n in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for nth, ((_, n), k) in enumerate(zip(self.items, self.budget, strict=True)):
            cuts = [len(n) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(n[a:b], []).append((nth, a))
        self.machine = ahocorasick.Automaton()
        for piece, at in places.items():
            self.machine.add_word(piece, (len(piece), at))
        if places:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) in the normalised text: the best place of each item that occurs within its budget."""
        if not self.items:
            return []
        hits: dict[int, set[int]] = {}
        for end, (size, at) in self.machine.iter(text):
            for nth, offset in at:
                hits.setdefault(nth, set()).add(end + 1 - size - offset)
        out: dict[int, tuple[int, int, int]] = {}
        for nth, diagonals in hits.items():
            ident, pattern = self.items[nth]
            k, m = self.budget[nth], len(pattern)
            for first, last in _stretches(sorted(diagonals), 2 * k):
                if k == 0:
                    if text[first : first + m] != pattern or m < CHARS_PER_EDIT and not ((first == 0 or text[first - 1] == " ") and text[first + m : first + m + 1] in ("", " ")):
                        continue
                    found = (0, first, first + m)
                else:
                    a = max(0, first - k)
                    best, end = myers(pattern, text[a : last + m + k])
                    if best > k:
                        continue
                    _, back = myers(pattern[::-1], text[max(a, a + end - m - k) : a + end][::-1])
                    found = (best, a + end - back, a + end)
                out[ident] = min(out.get(ident, (1 << 30, 0, 0)), found)
        return [(i, *v) for i, v in sorted(out.items(), key=lambda x: (x[0] is not None, x[0]) if x[0] is not None else (False, 0))]


def _stretches(diagonals: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of ascending diagonals no more than `gap` apart, which share one window; with no gap each alone."""
    at = 0
    for i in range(1, len(diagonals) + 1):
        if i == len(diagonals) or not gap or diagonals[i] - diagonals[i - 1] > gap:
            yield diagonals[at], diagonals[i - 1]
            at = i


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of `text` from which normal(text)[start:end] was made."""
    places, last = [], False
    for i, c in enumerate(text):
        low = c.lower()
        for x in low:
            if _GAP.match(x):
                if places and not last:
                    places.append(i)
                last = True
            else:
                places.append(i)
                last = False
    return places[start], places[end - 1] + 1


def _groups(items: DataFrame, max_items_chars: int) -> Iterator[list[tuple]]:
    """The items, in lists of bounded size; one list, if empty, at least."""
    group: list[tuple] = []
    size, some = 0, False
    for ident, text in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if size + len(text) > max_items_chars and group:
            yield group
            group, size, some = [], 0, True
        group.append((ident, text))
        size += len(text)
    if group or not some:
        yield group


def _known(shared: Broadcast, key: str, chars_per_edit: int) -> Items:
    return worker_state(key, lambda: Items(shared.value, chars_per_edit))


def contaminated(docs: DataFrame, items: DataFrame, max_items_chars: int = 50_000_000, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """A row (doc_id, item_id, distance, start, end) for each document and item it holds; start and end are code points of the text.

    Texts of one id that are more than a pass apart are reported by each pass.
    """
    out = None
    schema = StructType([docs.schema["doc_id"], items.schema["item_id"]]).add("distance", IntegerType()).add("start", LongType()).add("end", LongType())
    kinds = to_arrow_schema(schema)
    for group in _groups(items, max_items_chars):
        shared, key = docs.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            known = _known(shared, key, chars_per_edit)
            for b in batches:
                found: list[list] = [[], [], [], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for item, distance, start, end in known.find(normal(text)) if text else ():
                        for column, v in zip(found, (doc, item, distance, *original_span(text, start, end)), strict=True):
                            column.append(v)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(found, kinds, strict=True)], names=kinds.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, max_items_chars: int = 50_000_000, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of docs that hold no item; a pass over the documents, no shuffle."""
    at = docs.columns.index("text")
    for group in _groups(items, max_items_chars):
        shared, key = docs.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            known = _known(shared, key, chars_per_edit)
            for b in batches:
                yield b.filter(pa.array([not (t and known.find(normal(t))) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
