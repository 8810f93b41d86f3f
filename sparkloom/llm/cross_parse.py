"""Language ID by cross-parsing: the language whose text parses a document in the fewest phrases wins.

For each language a suffix automaton holds every substring of a labelled sample. A document is cut, left to right, into the
longest phrases that occur in that sample; phrases x log2(sample length) / length is its normalised phrase count. Letters count
without case, and each run of other characters is one gap. Every letter of the samples has a code, whatever their scripts and number; a letter
that a language's sample lacks ends a phrase there. Documents are
parsed whole, in independent blocks of `BLOCK` characters so that numpy advances thousands of blocks at once; a block's end
ends a phrase. Ties go to the language that sorts first. A null text, or one without a letter, is `und` with score 0; so is every text when
nothing could be learned. score is 1 - best / second best. The sample is bounded by the number of its documents (`docs_per_lang`), all else is counted on all rows.
Rows are judged one by one: repeated ones alike, null ids like others, none in an empty table; result columns stand beside those kept by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, trimmed, worker_state

BLOCK, LANES, CELLS, AT_ONCE = 512, 2048, 1 << 23, 1 << 20
UNKNOWN, GAP = 0, 1


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """By code point the letter without case, -1 for other characters."""
    out = np.full(0x110000, -1, np.int32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            out[p] = ord(c.lower()[0])
    return out


class Flat:
    """A table with a row for each state: state and symbol -> next state x 2 + 1 if a phrase ended. States are row offsets."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, size: int, width: int):
        table = np.full((size, width), -1, np.int32)
        table[states, symbols] = to
        ended = table < 0
        np.copyto(table, np.maximum(table[0], 0), where=ended)
        table *= 2 * width
        table += ended
        self.table = table.ravel()

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.table[state + symbol]
        return got >> 1, got & 1


class Hashed:
    """The same for large alphabets: only the moves that exist, in an open-addressing table of at least four slots a move."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, to: np.ndarray, size: int, width: int):
        self.width = width
        self.root = np.zeros(width, np.int64)
        self.root[symbols[states == 0]] = to[states == 0]
        moves = states.astype(np.int64) * width + symbols
        self.shift = np.uint64(64 - max(4, (4 * len(moves)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.moves, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        slot, left = self._slot(moves), np.arange(len(moves))
        while len(left):
            free = left[self.moves[slot[left]] < 0]
            self.moves[slot[free]] = moves[free]
            left = left[self.moves[slot[left]] != moves[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.to[slot] = to

    def _slot(self, moves: np.ndarray) -> np.ndarray:
        return (moves.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move = state * self.width + symbol
        slot = self._slot(move)
        found = self.moves[slot]
        hit = found == move
        left = np.flatnonzero(~hit & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.moves[slot[left]]
            hit[left] = found == move[left]
            left = left[(found >= 0) & (found != move[left])]
        return np.where(hit, self.to[slot], self.root[symbol]), ~hit


class Learned(NamedTuple):
    """What the automata come to, a few bytes a move: the samples' letters, and for each language its own codes, the moves (state, code, next state), the states and the sample's codes."""

    letters: np.ndarray
    langs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]


def _codes_of(letters: np.ndarray) -> np.ndarray:
    by_letter = np.zeros(0x110000, np.int32)
    by_letter[letters] = np.arange(2, len(letters) + 2)
    return np.where(_folded() < 0, GAP, by_letter[_folded()]).astype(np.int32)


def _coded(code: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, one after another, and their number in each; every run of characters that are no letters is one gap."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = code[points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(sizes)
    return codes[keep], total[ends] - total[ends - sizes]


def learned(samples: dict[str, list[str]]) -> Learned:
    """One automaton at a time is built and written down as its moves; its states are many times larger, so this is done once and not in every worker."""
    fold = _folded()
    letters = np.array(sorted({int(fold[ord(c)]) for texts in samples.values() for t in texts for c in set(t)} - {-1}), np.int32)
    code, langs = _codes_of(letters), {}
    for lang in sorted(k for k, v in samples.items() if any(v)):
        codes = [c for t in samples[lang] for c in [*_coded(code, [t])[0].tolist(), UNKNOWN]]
        nxt = suffix_automaton([c if c != UNKNOWN else -1 - i for i, c in enumerate(codes)])
        own = np.array(sorted(set(codes) - {UNKNOWN, GAP}), np.int32)
        sizes = np.fromiter((sum(c > 0 for c in moves) for moves in nxt), np.int32, len(nxt))
        total = int(sizes.sum())
        found = np.fromiter((c for moves in nxt for c in moves if c > 0), np.int32, total)
        to = np.fromiter((t for moves in nxt for c, t in moves.items() if c > 0), np.int32, total)
        langs[lang] = own, np.repeat(np.arange(len(nxt), dtype=np.int32), sizes), found, to, len(nxt), len(codes)
        del nxt
    return Learned(letters, langs)


class CrossParser:
    """A code for each letter of the samples; per language the symbols of its own letters, and the moves of its automaton."""

    def __init__(self, samples: dict[str, list[str]] | Learned):
        known = samples if isinstance(samples, Learned) else learned(samples)
        self.code = _codes_of(known.letters)
        self.langs = list(known.langs)
        self.symbols, self.tables, self.bits = [], [], []
        for own, states, found, to, size, codes in known.langs.values():
            symbol = np.zeros(len(known.letters) + 2, np.int32)
            symbol[[GAP, *own.tolist()]] = np.arange(1, len(own) + 2)
            kind = Flat if size * (len(own) + 2) <= CELLS else Hashed
            self.symbols.append(symbol)
            self.tables.append(kind(states, symbol[found], to, size, len(own) + 2))
            self.bits.append(np.log2(max(2, codes)))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _coded(self.code, texts)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and its number of codes: whole texts, BLOCK codes to a lane."""
        codes, sizes = self.codes(texts)
        begin, blocks = np.cumsum(sizes) - sizes, -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begin[owner] + nth * BLOCK
        stop = np.minimum(start + BLOCK, (begin + sizes)[owner])
        order = np.argsort(start - stop, kind="stable")
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for at in range(0, len(order), LANES):
            lane = order[at : at + LANES]
            sizes_left = (stop - start)[lane]
            width = int(sizes_left[0])
            steps = codes[np.minimum(start[lane] + np.arange(width)[:, None], len(codes) - 1)]
            live = np.searchsorted(-sizes_left, -np.arange(width)).tolist()  # the longest come first
            for k, (symbol, table) in enumerate(zip(self.symbols, self.tables, strict=True)):
                state, count = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int32)
                for n, row in zip(live, steps, strict=True):
                    state[:n], ended = table.step(state[:n], symbol[row[:n]])
                    count[:n] += ended
                # the open phrase at the end counts too
                np.add.at(out[:, k], owner[lane], count + (state > 0))
        return out, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        whole = [t or "" for t in texts]
        letters = [has_letter(t) for t in whole]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        count, sizes = self.phrases(whole)
        rate = count * np.array(self.bits) / np.maximum(1, sizes)[:, None]
        best, low = rate.argmin(axis=1), np.sort(rate, axis=1)
        second = low[:, 1] if len(self.langs) > 1 else low[:, 0] * 2
        score = np.clip(1 - low[:, 0] / np.maximum(second, 1e-12), 0, 1)
        return [(self.langs[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best, score, letters, strict=True)]


def sample_texts(docs: DataFrame, docs_per_lang: int = 24, short: int = 4000, total_docs: int = 20_000) -> dict[str, list[str]]:
    """A bounded labelled sample: for each language whole texts of the documents of smallest hash of the key, those of at most `short` characters first.

    Of so many languages that `total_docs` would be exceeded, each has fewer documents, one at least. Rows that share a doc_id and a language count once.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = max(1, min(docs_per_lang, total_docs // max(1, known.agg(F.approx_count_distinct("lang")).first()[0])))
    keys = known.groupBy("lang", "doc_id").agg(F.min(F.length("text") > short).alias("long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    picked = keys.withColumn("nth", rank).where(F.col("nth") <= per_lang).select("lang", "doc_id")
    rows = known.join(F.broadcast(picked), (known["lang"] == picked["lang"]) & known["doc_id"].eqNullSafe(picked["doc_id"]), "left_semi")
    out: dict[str, list[str]] = {}
    for lang, text in rows.groupBy("lang", "doc_id").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text")).select("lang", "text").collect():
        out.setdefault(lang, []).append(text)
    return {k: sorted(v) for k, v in out.items()}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of AT_ONCE bytes of text together, or one longer text, so that memory follows the text and not the number of rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > AT_ONCE:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def identify(docs: DataFrame, samples: dict[str, list[str]], *keep: Column) -> DataFrame:
    """The rows of docs: columns `keep` (doc_id if none), lang_pred, score. The driver learns from the sample; workers get the automata's moves."""
    import hashlib

    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(learned(samples))
    bounded_batches(docs.sparkSession)
    keep = keep or (F.col("doc_id"),)
    rows = docs.select(F.col("text").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_state(key, lambda: CrossParser(shared.value))
        for whole in batches:
            for b in _slices(whole):
                got = parser.predict(b.column(0).to_pylist())
                yield pa.record_batch([*b.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])
        trimmed()

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*rows.schema.fields[1:]]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(run, schema)


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter: those that predict gives a language once there is one."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
