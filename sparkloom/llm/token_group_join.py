"""N-gram Jaccard join with a token-group matrix: exact links between documents and their components.

A document's set holds its distinct word shingles. Two documents link when 100 x intersection >= percent x union.

1. Equal sets become one class, whose least doc_id stands for it.
2. Classes that share min-hashes are compared with the least class of each min-hash only, which gives first links; half of the min-hashes
   in common puts them in one group of similar documents, linked or not.
3. Every class' rarest shingles (so many that two linked classes must share one, however the order is chosen) point at the groups that may
   hold a partner. A corpus-wide count sketch of fixed size orders shingles, so common passages come last; the order only affects cost.
4. Of two such groups the larger is opened for the classes of the smaller: its chunks keep the union of their members' shingles; a query whose overlap
   with the union cannot reach percent of its own size is turned away, others count their overlap with all members in one pass over the matrix.
   Within a group, the classes outside its largest set of linked ones ask all its chunks likewise.
Texts travel only for what is left when parity bitmaps have been compared: a set's bitmap has a bit for each residue that an odd number of its shingles has, so two bitmaps differ in no
more bits than the sets do in shingles, and pairs that differ in too many do not link. Shared passages bring together far more pairs, with the square of the corpus, than are left then.
No pairs are formed within a group, and no link between different texts is lost.

Null, empty and white-space texts have an empty set, link with nothing and are their own component. A text of fewer words than a shingle has one shingle.
Rows that share a doc_id are one document with the links of all its texts; each row is returned. A row without doc_id has its n_shingles and a null component,
and links with nothing. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packing import mix, pack, unpack
from .store import saved, texts_of, worker_state

SLOT_BITS, HASHES, AGREE, ALIKE, CHUNK, CACHED = 20, 8, 2, 4, 256, 1 << 19
_BLOCKS = 64
_P = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


class _Words(dict):
    """Hashes of words already met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_state("word hashes", _Words)
    if len(known) > CACHED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n if n < size else 0, np.uint64)
    for k in range(n):
        out = out * _P + h[k : len(h) - n + 1 + k]
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def parity(s: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, 1 to 2 of them a shingle, rounded to a power of two: set if an odd number of shingles has it."""
    m = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: int, b: int, bits_a: bytes, bits_b: bytes, percent: int) -> bool:
    """False only for sets (of a and b shingles) that do not link: an intersection of percent leaves room for so many shingles of one set only."""
    if 100 * min(a, b) < percent * max(a, b):
        return False
    if len(bits_a) < len(bits_b):
        bits_a, bits_b = bits_b, bits_a
    x, m = int.from_bytes(bits_a, "little"), 8 * len(bits_a)
    while m > 8 * len(bits_b):  # residues of half the modulus
        m //= 2
        x = x >> m ^ x & (1 << m) - 1
    return (x ^ int.from_bytes(bits_b, "little")).bit_count() <= a + b + 2 * (-percent * (a + b) // (100 + percent))


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, two hashes of the set, its min-hashes and parity bitmap; rows without doc_id hold blocks of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.uint32)
        names = ["doc_id", "n", "k1", "k2", "least", "bits", "block", "counts"]
        for b in batches:
            rows, met, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, size)
                if len(s):
                    met.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
                    held += len(s)
                    if held >= 1 << SLOT_BITS:
                        slots += np.bincount(np.concatenate(met), minlength=1 << SLOT_BITS).astype(np.uint32)
                        met, held = [], 0
                    least = np.array([(s * m).min() for m in _ODD])
                    rows.append((doc, len(s), int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s * _P)).view(np.int64)), least.view(np.int64).tolist(), parity(s)))
                else:
                    rows.append((doc, 0, 0, 0, [], b""))
            if met:
                slots += np.bincount(np.concatenate(met), minlength=1 << SLOT_BITS).astype(np.uint32)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
        part = slots.reshape(_BLOCKS, -1)
        used = [i for i in range(_BLOCKS) if part[i].any()]
        n = len(used)
        yield pa.record_batch([pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.array(used, pa.int32()), pa.array([pack(part[i]) for i in used], pa.binary())], names=names)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return saved(rows.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, least array<bigint>, bits binary, block int, counts binary"), "signatures")


def _levels(sigs: DataFrame) -> np.ndarray:
    """For each slot the bit length of its count, from all documents: 2^SLOT_BITS bytes, however large the corpus."""

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << SLOT_BITS) // _BLOCKS, np.int64)
        for c in group["counts"]:
            out += unpack(c)
        return pd.DataFrame({"block": [group["block"].iat[0]], "levels": [np.ceil(np.log2(out + 1)).astype(np.uint8).tobytes()]})

    # partial sums first, so that no task meets the blocks of all input partitions
    part = F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")

    def some(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << SLOT_BITS) // _BLOCKS, np.int64)
        for c in group["counts"]:
            out += unpack(c)
        return pd.DataFrame({"block": [group["block"].iat[0]], "counts": [pack(out)]})

    rows = sigs.where("block is not null").select("block", "counts", part).groupBy("block", "part").applyInPandas(some, "block int, counts binary")
    out = np.zeros((_BLOCKS, (1 << SLOT_BITS) // _BLOCKS), np.uint8)
    for block, levels in rows.groupBy("block").applyInPandas(total, "block int, levels binary").collect():
        out[block] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of class representatives those that may link by their bitmaps."""
    of = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, r in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)) if may_link(*r, percent)]
            yield pa.record_batch([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return saved(rows.mapInArrow(run, "a bigint, b bigint").distinct(), "likely")  # documents of several texts have several bitmaps


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link."""
    text = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    rows = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if ta != last or mine is None:
                    last, mine = ta, shingles(ta, size)
                other = shingles(tb, size)
                if len(mine) and len(other) and 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)):
                    if linked(len(np.intersect1d(mine, other, assume_unique=True)), len(mine), len(other), percent):
                        keep.append(i)
            yield pa.record_batch([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _prefixes(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, and the document's rarest shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            doc, n, out = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, size)
                if len(s):
                    k = len(s) - (percent * len(s) + 99) // 100 + 1
                    rank = np.argsort(level[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")[:k]
                    doc.append(d)
                    n.append(len(s))
                    out.append(s[rank].view(np.int64))
            at = np.cumsum([0, *map(len, out)])
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "n", "rare"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, rare array<bigint>")


def _askable(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of queries (grp, chunk, doc_id, comp, n, bits) those that may link to a member of their chunk by the bitmaps."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        all_ = list(zip(*(held[c].tolist() for c in ("comp", "n", "bits")), strict=True))
        keep = [any(c != comp and may_link(n, m, bits, x, percent) for c, m, x in all_) for comp, n, bits in zip(*(asked[c].tolist() for c in ("comp", "n", "bits")), strict=True)]
        return asked.loc[np.array(keep, bool), ["grp", "chunk", "doc_id", "comp"]]

    found = queries.groupBy("grp", "chunk").cogroup(members.toDF("grp", "chunk", "doc_id", "comp", "n", "bits").groupBy("grp", "chunk"))
    return saved(found.applyInPandas(run, "grp bigint, chunk int, doc_id bigint, comp bigint").distinct(), "askable")


def _opened(queries: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the queries (grp, chunk, doc_id, comp, text) to members of their chunk: one for each other set of linked classes met."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, size) for t in held["text"]]
        found: list[tuple[int, int]] = []
        if sets and len(asked):
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            union, first = np.unique(flat[order], return_index=True)  # the group's row of the matrix
            first, owner = np.append(first, len(flat)), owner[order]
            sizes = np.array([len(s) for s in sets])
            ids, comps = held["doc_id"].tolist(), held["comp"].tolist()
            for doc, own, text in zip(asked["doc_id"], asked["comp"], asked["text"], strict=True):
                q = shingles(text, size)
                at = np.searchsorted(union, q)
                at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == q)]
                if not len(q) or 100 * len(at) < percent * len(q):
                    continue
                runs = first[at + 1] - first[at]
                where = np.repeat(first[at] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                common = np.bincount(owner[where], minlength=len(sets))
                ok = np.flatnonzero(100 * common >= percent * (sizes + len(q) - common))
                found += [(doc, b) for c, b in {comps[i]: ids[i] for i in ok.tolist()}.items() if c != own]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return queries.groupBy("grp", "chunk").cogroup(members.toDF("grp", "chunk", "doc_id", "comp", "text").groupBy("grp", "chunk")).applyInPandas(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    sigs = _signatures(docs, size)
    rows = sigs.where("doc_id is not null")
    full = rows.where("n > 0")
    classes = saved(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("least").alias("least"), F.first("bits").alias("bits")), "classes")

    # 2. groups of similar classes
    hashed = classes.select("rep", F.posexplode("least").alias("pos", "hash"))
    leader = hashed.groupBy("pos", "hash").agg(F.min("rep").alias("lead"), F.count("*").alias("m")).where("m > 1")
    pairs = saved(hashed.join(leader, ["pos", "hash"]).where("rep != lead").groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("m")).where(F.col("m") >= AGREE), "pairs")
    close = saved(_verified(_likely(pairs.select("a", "b"), classes, percent), docs, size, percent), "links")
    linked_, alike = components(close), components(pairs.where(F.col("m") >= ALIKE).select("a", "b").unionByName(close))
    reps = classes.select("rep").distinct()
    groups = reps.join(linked_.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").join(alike.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep", "left")
    groups = saved(groups.select("rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("grp", "rep").alias("grp")), "groups")

    # 3. which groups may hold partners
    rare = _prefixes(docs, _levels(sigs), size, percent).join(groups, F.col("doc_id") == F.col("rep"))
    tokens = rare.select(F.explode("rare").alias("token"), "grp", "n").distinct()
    a, b = tokens.alias("a"), tokens.alias("b")
    fits = (F.col("a.grp") < F.col("b.grp")) & (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    may = saved(a.join(b, (F.col("a.token") == F.col("b.token")) & fits).select(F.col("a.grp").alias("x"), F.col("b.grp").alias("y")).distinct(), "candidates")

    # 4. open the larger group of each pair for the classes of the smaller
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    may = may.join(sizes.select(F.col("grp").alias("x"), F.col("m").alias("mx")), "x").join(sizes.select(F.col("grp").alias("y"), F.col("m").alias("my")), "y")
    swap = F.col("my") > F.col("mx")
    may = saved(may.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("grp"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("asks"), F.greatest("mx", "my").alias("m")), "opened")
    single = _verified(_likely(may.where("m = 1").select(F.col("grp").alias("a"), F.col("asks").alias("b")), classes, percent), docs, size, percent)
    chunks = F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")
    across = may.where("m > 1").select("grp", "asks", chunks).join(groups.select(F.col("rep").alias("doc_id"), "comp", F.col("grp").alias("asks")), "asks").select("grp", "doc_id", "comp", "chunks")
    main = groups.groupBy("grp", "comp").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("m")).where("parts > 1")
    within = groups.join(main, "grp").where("comp != main").select("grp", F.col("rep").alias("doc_id"), "comp", chunks)
    asked = saved(across.unionByName(within), "asked")
    queries = asked.select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "comp")
    held = groups.join(asked.select("grp", "chunks").distinct(), "grp").select("grp", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.col("rep").alias("doc_id"), "comp")
    bits = classes.select(F.col("rep").alias("doc_id"), "n", "bits")
    with_bits = lambda x: x.join(bits, "doc_id").select("grp", "chunk", "doc_id", "comp", "n", "bits")
    queries = _askable(with_bits(queries), with_bits(held), percent)
    held = saved(held.join(queries.select("grp", "chunk").distinct(), ["grp", "chunk"], "left_semi"), "held")
    text = texts_of(docs, queries.select("doc_id").unionByName(held.select("doc_id")))
    with_text = lambda x: x.join(text, "doc_id").select("grp", "chunk", "doc_id", "comp", "text")
    far = _opened(with_text(queries), with_text(held), size, percent)

    # components of the documents
    member = full.join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).select("doc_id", "rep", "n")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.collect_set("rep").alias("all")).where("lo != hi").select(F.col("doc_id").alias("a"), F.explode("all").alias("b"))
    label = components(close.unionByName(single).unionByName(far).unionByName(several))
    out = member.join(label, member["rep"] == label["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))

    def sizes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.record_batch([none, pa.array([len(shingles(t, size)) for t in b.column(0).to_pylist()], pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    keyless = docs.where("doc_id is null").select("text").mapInArrow(sizes_only, "doc_id bigint, n_shingles bigint, component_id bigint")
    return out.unionByName(empty).unionByName(keyless)
