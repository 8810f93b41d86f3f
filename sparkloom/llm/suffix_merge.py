"""Suffix-array dedup: bytes covered by a `LENGTH`-byte string that also starts in a document with a smaller doc_id are removed.

The suffixes that are sorted are those at synchronising positions, chosen by content alone: a position is one if the hash of its `SEED` bytes is least among all seeds of some
LENGTH-byte string, so equal strings hold such a position at the same place, and each string is judged at its own. Steps:

1. Copies: a document whose whole text occurs under a smaller doc_id goes whole (from LENGTH bytes on), and takes no part in what follows, as the first copy stands for it.
2. Duplicate detection: seed hashes travel packed, dealt by hash range; those in one document only go no further.
3. Distributed merge sort: each task sorts the remaining suffixes, equal ones with equal left contexts once for all places they stand at, front-codes the run and deals it by
   hash range; a loser tree that carries the common prefix with the last winner merges the runs and compares only bytes beyond known prefixes.
4. A string of LENGTH bytes with l of them left of its seed is shared by neighbouring suffixes whose common prefix, as the tree carried it, is LENGTH - l or more and
   whose left contexts agree in l bytes. For each l such groups are given the least doc_id; a document with a larger one loses those bytes. Documents then cut the union of
   their stretches from the input.

Null and short texts (under LENGTH bytes) lose nothing. doc_id identifies a text; a repeated row is returned each time, and is no smaller document than itself. A row
without doc_id is returned whole and counts for no other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import mix, pack, pack_sorted, unpack, unpack_sorted
from .store import bounded_batches, partitions, saved, texts_of

LENGTH, SEED, KEY_BITS, FLUSH, AT_ONCE = 50, 20, 43, 1 << 19, 1 << 18
LEFT = LENGTH - SEED
_P = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Synchronising positions and their keys: hashed anew, as the least of many hashes are small and would meet in the first ranges."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = {1: np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * np.uint64(pow(_P, k, 1 << 64)) + h[k][k:]
    seed = mix(h[16][:-4] * np.uint64(pow(_P, 4, 1 << 64)) + h[4][16:])

    def slide(a, f):
        for k in (1, 2, 4, 8):
            a = f(a[:-k], a[k:])
        return f(a[: len(a) - LEFT + 15], a[LEFT - 15 :])  # LEFT + 1 wide, from two of 16

    least = slide(seed, np.minimum)
    pad = np.zeros(LEFT, np.uint64)
    at = np.flatnonzero(slide(np.concatenate([pad, least, pad]), np.maximum) == seed)
    return at, mix(seed[at]) >> np.uint64(64 - KEY_BITS)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _shared_seeds(docs: DataFrame) -> DataFrame:
    """doc_id, keys: of each document the keys that occur in other documents too."""
    n = partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def flush():
            k, d = np.concatenate(keys), np.concatenate(owner)
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            at = np.searchsorted(_bucket(k, n), np.arange(n + 1))
            used = [i for i in range(n) if at[i] < at[i + 1]]
            return pa.record_batch([pa.array(used, pa.int32()), pa.array([pack_sorted(k[at[i] : at[i + 1]]) for i in used], pa.binary()), pa.array([pack(d[at[i] : at[i + 1]]) for i in used], pa.binary())], names=["bucket", "keys", "docs"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if text.is_valid and doc is not None:
                    k = np.unique(anchors(text.as_buffer().to_pybytes())[1])
                    keys.append(k)
                    owner.append(np.full(len(k), doc, np.int64))
                    held += len(k)
                    if held >= FLUSH:
                        yield flush()
                        keys, owner, held = [], [], 0
        if held:
            yield flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        k = np.concatenate([unpack_sorted(x) for x in group["keys"]])
        d = np.concatenate([unpack(x) for x in group["docs"]])
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.append(first[1:], len(k)) - 1
        several = np.repeat(d[first] != d[last], last - first + 1)
        return pd.DataFrame({"doc_id": d[several], "key": k[several].view(np.int64)})

    sent = docs.mapInArrow(send, "bucket int, keys binary, docs binary")
    return sent.groupBy("bucket").applyInPandas(meet, "doc_id bigint, key bigint").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def front_code(suffixes: list[bytes]) -> bytes:
    """A sorted run: of each string the length of the prefix it shares with the one before, its own length, and the rest."""
    out, last = bytearray(), b""
    for s in suffixes:
        c = common(last, s, 0)
        out += bytes((c, len(s)))
        out += s[c:]
        last = s
    return bytes(out)


def front_decode(code: bytes) -> tuple[list[bytes], list[int]]:
    """The run's strings, and the prefix each shares with the one before."""
    out, shared, at, last = [], [], 0, b""
    while at < len(code):
        c, n = code[at], code[at + 1]
        at += 2
        last = last[:c] + code[at : at + n - c]
        at += n - c
        out.append(last)
        shared.append(c)
    return out, shared


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, `known` of which is known."""
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Run, place in it and prefix shared with the string before, in sorted order: a loser tree of (run, prefix shared with the last winner)."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs]
    place = [0] * k
    heads: list[bytes | None] = [s[0] if s else None for s in strings]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and loser, each with the prefix it shares with the last winner (the loser: with this one)."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, lb, a, 0
        if y is None:
            return a, la, b, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        c = common(x, y, la)
        if c == len(y) and c < len(x) or c < len(x) and c < len(y) and y[c] < x[c]:
            return b, lb, a, c
        return a, la, b, c

    loser: list[tuple[int, int]] = [(0, 0)] * k

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        w, lw, s, ls = play(*build(2 * node), *build(2 * node + 1))
        loser[node] = s, ls
        return w, lw

    win, shared = build(1)
    while heads[win] is not None:
        i = place[win]
        yield win, i, shared
        i += 1
        place[win] = i
        if i < len(strings[win]):
            heads[win], shared = strings[win][i], prefixes[win][i]
        else:
            heads[win], shared = None, 0
        node = (win + k) >> 1
        while node:
            other, lo = loser[node]
            if lo < shared and heads[win] is not None:
                pass  # the challenger shares less with the last winner, so it is larger
            else:
                w, lw, s, ls = play(win, shared, other, lo)
                loser[node] = s, ls
                win, shared = w, lw
            node >>= 1


def _runs(rows: DataFrame) -> DataFrame:
    """Front-coded sorted runs of the suffixes at shared seeds: bucket, run, lefts (contexts), sizes (places of each), docs, places."""
    n = 2 * partitions(rows.sparkSession)
    names = ["bucket", "run", "lefts", "sizes", "docs", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int]] = []

        def flush():
            held.sort()
            out: list[list] = [[] for _ in names]
            at = 0
            while at < len(held):
                end = at
                rights, lefts, sizes = [], [], []
                while end < len(held) and held[end][0] == held[at][0]:
                    if rights and held[end][1] == rights[-1] and held[end][2] == lefts[-1]:
                        sizes[-1] += 1
                    else:
                        rights.append(held[end][1])
                        lefts.append(held[end][2])
                        sizes.append(1)
                    end += 1
                part = held[at:end]
                packed = (np.frombuffer(front_code(rights), np.uint8), np.frombuffer(b"".join(bytes((len(x),)) + x for x in lefts), np.uint8), np.array(sizes, np.int64), np.array([p[3] for p in part], np.int64), np.array([p[4] for p in part], np.int64))
                for column, v in zip(out, (part[0][0], *map(pack, packed)), strict=True):
                    column.append(v)
                at = end
            return pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=names)

        for b in batches:
            docs, keys = b.column(0).to_numpy(), b.column(2)
            offsets, values = keys.offsets.to_numpy(), keys.values.to_numpy().view(np.uint64)
            for i in range(b.num_rows):
                doc, data = int(docs[i]), b.column(1)[i].as_buffer().to_pybytes()
                at, key = anchors(data)
                chosen = np.isin(key, values[offsets[i] : offsets[i + 1]])
                for a, k in zip(at[chosen].tolist(), _bucket(key[chosen], n).tolist(), strict=True):
                    held.append((k, data[a : a + LENGTH], data[max(0, a - LEFT) : a], doc, a))
                if len(held) >= FLUSH // 4:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return rows.mapInArrow(run, "bucket int, run binary, lefts binary, sizes binary, docs binary, places binary")


def removable(shared: np.ndarray, rights: np.ndarray, lefts: list[bytes], sizes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, first, last: starts of strings that a smaller document has.

    Suffixes come sorted: `shared` is the prefix each has in common with the one before, `rights` its length, `lefts` its left context, `sizes` the number of its places.
    """
    n, count = len(shared), np.array([len(x) for x in lefts])
    near = np.zeros((n, LEFT), np.uint8)  # left contexts from the seed outwards
    for i, x in enumerate(lefts):
        near[i, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    ends = np.cumsum(sizes)
    least = np.minimum.reduceat(docs, ends - sizes)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    hit = np.zeros(len(docs), np.uint32)  # a bit for each left length
    code = np.zeros(n, np.uint64)
    for left in range(LEFT + 1):
        if left:
            code = mix(code + near[:, left - 1].astype(np.uint64) + np.uint64(1))
        here = np.flatnonzero((count >= left) & (rights >= LENGTH - left))
        if len(here) < 1:
            continue
        run = np.cumsum(shared < LENGTH - left)[here]
        order = np.lexsort((code[here], run))
        r, c = run[order], code[here][order]
        begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
        if len(begin) == len(order) and sizes.max() == 1:
            continue
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        mine, lead = here[order], here[order[begin[group]]]
        other = mine != lead
        if left and (near[mine[other], :left] != near[lead[other], :left]).any():
            raise RuntimeError("two left contexts with one 64-bit code")
        first = np.full(n, np.iinfo(np.int64).max)
        first[mine] = np.minimum.reduceat(least[here[order]], begin)[group]
        for a in range(0, len(docs), AT_ONCE):
            b = a + AT_ONCE
            hit[a:b] |= (docs[a:b] > first[owner[a:b]]).astype(np.uint32) << np.uint32(left)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for mask in np.unique(hit).tolist():  # few patterns of lengths
        row = np.flatnonzero(hit == mask) if mask else None
        low = 0
        while mask >> low:
            low += ((mask >> low) & -(mask >> low)).bit_length() - 1  # to the next length that is hit
            high = low
            while mask >> (high + 1) & 1:
                high += 1
            found.append((docs[row], places[row] - high, places[row] - low))
            low = high + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (docs[:0], places[:0], places[:0])


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    runs, lefts, sizes, docs, places = [], [], [], [], []
    for code, left, size, doc, place in zip(*(group[c] for c in ("run", "lefts", "sizes", "docs", "places")), strict=True):
        runs.append(front_decode(unpack(code).tobytes()))
        raw, at = unpack(left).tobytes(), 0
        while at < len(raw):
            lefts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        sizes.append(unpack(size))
        docs.append(unpack(doc))
        places.append(unpack(place))
    base = np.cumsum([0, *map(len, sizes)])
    size, doc, place = np.concatenate(sizes), np.concatenate(docs), np.concatenate(places)
    del sizes, docs, places
    order, shared = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for k, (r, i, c) in enumerate(merge_runs(runs)):
        order[k], shared[k] = base[r] + i, c
    rights = np.array([len(x) for strings, _ in runs for x in strings])
    runs.clear()
    begin = np.cumsum(size) - size
    own = size[order]
    at = np.repeat(begin[order] - np.cumsum(own) + own, own) + np.arange(own.sum())
    found = removable(shared, rights[order], [lefts[i] for i in order.tolist()], own, doc[at], place[at])
    return pd.DataFrame(dict(zip(("doc_id", "first", "last"), found, strict=True)))


def stretches(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of the bytes covered by strings that start from first to last."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        b += LENGTH
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: kept, the remaining bytes."""
    bounded_batches(docs.sparkSession, "4m")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = rows.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("size"))
    first = hashed.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep != top").drop("top")
    copies = saved(hashed.join(first, ["h1", "h2", "size"]).where("rep < doc_id").select("doc_id").distinct(), "copies")

    seeds = saved(_shared_seeds(rows).join(copies, "doc_id", "left_anti"), "seeds")
    sources = texts_of(rows, seeds.select("doc_id")).join(seeds, "doc_id").where("text is not null").select("doc_id", "text", "keys")
    found = _runs(sources).groupBy("bucket").applyInPandas(_merged, "doc_id bigint, first bigint, last bigint")
    cuts = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    cuts = saved(cuts.select("doc_id", "cuts", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("cuts"), F.lit(True).alias("copy"))), "cuts")
    joined = rows.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, cut, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                parts = [(0, len(data))] if copy and len(data) >= LENGTH else stretches([(c["first"], c["last"]) for c in cut or ()])
                kept, at = [], 0
                for a, e in parts:
                    kept.append(data[at:a])
                    at = e
                rest = b"".join([*kept, data[at:]])
                for column, v in zip(out, (doc, len(data), len(data) - len(rest), len(parts), hashlib.sha256(rest).hexdigest(), rest if with_text else None), strict=True):
                    column.append(v)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.binary())][: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
