"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V + 1), where b is the bucket of the context's frequency, floor(log2 c(v)) + 1, and
0 for an unseen context. The weights of each bucket come from expectation-maximisation on deleted counts: every training token is
held out in turn, so its own occurrence is taken off the counts that predict it. EM runs on a histogram of (bucket, bigram
estimate, unigram estimate) over all training tokens, whose size is fixed by its logarithmic grid.

Tokens are lower-cased (A-Z) words without ASCII white space, then one end for each text, which is also the context of the first word.
A null text is an empty one. With nothing to learn from, every text scores by the uniform estimate 1/(V + 1) = 1.

Counting exchanges no tokens: documents are packed into chunks; each chunk sends its distinct n-gram hashes with their counts once, dealt by hash, and
gets back the corpus counts of the same n-grams. So no key is hot, however frequent. Words are told apart by 64-bit hashes, bigrams by `PAIR_BITS` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .packing import mix, pack, pack_planes, pack_sorted, unpack, unpack_planes, unpack_sorted
from .store import partitions, released, saved

CHUNK_CHARS, PAIR_BITS, BUCKETS, GRID = 6_000_000, 48, 24, 4
CHUNK = "chunk bigint, doc_ids array<bigint>, train array<boolean>, lens array<bigint>, words binary, tokens binary"
END = np.uint64(xxhash.xxh64_intdigest(b""))


def chunks(docs: DataFrame, train: Column) -> DataFrame:
    """Documents as rows of many: token numbers within the chunk, and the hash of each number's word. Number 0 is the end, frequent words have low numbers."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId() << 24, 0
        held: list = [[], [], []]
        local: dict[bytes, int] = {b"": 0}
        tokens: list[np.ndarray] = []
        size = 0

        def chunk():
            nonlocal held, local, tokens, size, nth
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
            all_ = np.concatenate(tokens)
            order = np.argsort(-np.bincount(all_, minlength=len(hashes))[1:], kind="stable") + 1
            order = np.concatenate([np.zeros(1, np.int64), order])
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            hashes, all_ = hashes[order], number[all_]
            out = pa.record_batch([pa.array([part + nth], pa.int64()), pa.array([held[0]], pa.list_(pa.int64())), pa.array([held[1]], pa.list_(pa.bool_())), pa.array([held[2]], pa.list_(pa.int64())), pa.array([pack(hashes)], pa.binary()), pa.array([pack_planes(all_)], pa.binary())], names=["chunk", "doc_ids", "train", "lens", "words", "tokens"])
            held, local, tokens, size, nth = [[], [], []], {b"": 0}, [], 0, nth + 1
            return out

        for b in batches:
            for doc, flag, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                for w in found:
                    if w not in local:
                        local[w] = len(local)
                ids = np.fromiter(map(local.__getitem__, found), np.uint32, len(found))
                tokens += (ids, np.zeros(1, np.uint32))
                for column, v in zip(held, (doc, flag, len(ids) + 1), strict=True):
                    column.append(v)
                size += len(text or "") + 8
                if size >= CHUNK_CHARS:
                    yield chunk()
        if held[0]:
            yield chunk()

    return saved(rows.mapInArrow(run, CHUNK), "chunks", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


class Chunk:
    """A chunk's tokens, its bigrams (sorted distinct pairs of numbers, and each token's place among them) and, with its words, their hashes."""

    def __init__(self, tokens: bytes, lens, train, words: bytes | None = None):
        self.tokens = unpack_planes(tokens).astype(np.int64)
        self.lens = np.array(lens, np.int64)
        self.train = np.repeat(np.array(train, bool), self.lens)
        before = np.zeros_like(self.tokens)
        before[1:] = self.tokens[:-1]  # every document ends with 0, so the first word's context is 0
        self.before = before
        pairs, self.pair = np.unique(before << 32 | self.tokens, return_inverse=True)
        if words is not None:
            self.words = unpack(words)
            h = mix(self.words[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.words[pairs & 0xFFFFFFFF])
            self.pair_keys = h >> np.uint64(64 - PAIR_BITS)

    def keys(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Kind, hash and training count of each distinct word and bigram."""
        one = np.bincount(self.tokens[self.train], minlength=len(self.words))
        two = np.bincount(self.pair[self.train], minlength=len(self.pair_keys))
        return [("w", mix(self.words), one), ("p", self.pair_keys, two)]


def _bucket_of(kind: str, keys: np.ndarray, n: int) -> np.ndarray:
    bits = 64 if kind == "w" else PAIR_BITS
    return ((keys >> np.uint64(bits - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def corpus_counts(table: DataFrame) -> DataFrame:
    """chunk, kind, bucket, counts: for each chunk the corpus training counts of its sorted distinct keys in that bucket; chunk -1 has (tokens, distinct) of the bucket."""
    n = partitions(table.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out: list[list] = [[], [], [], [], []]
                for kind, keys, count in Chunk(r["tokens"], r["lens"], r["train"], r["words"]).keys():
                    order = np.argsort(keys, kind="stable")
                    keys, count = keys[order], count[order]
                    at = np.searchsorted(_bucket_of(kind, keys, n), np.arange(n + 1))
                    for k in range(n):
                        if at[k] < at[k + 1]:
                            s = slice(at[k], at[k + 1])
                            for column, v in zip(out, (kind, k, r["chunk"], pack_sorted(keys[s]), pack_planes(count[s].astype(np.uint32))), strict=True):
                                column.append(v)
                yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["kind", "bucket", "chunk", "keys", "counts"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in group["keys"]]
        whole = np.concatenate(keys)
        distinct, back = np.unique(whole, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate([unpack_planes(c) for c in group["counts"]]).astype(np.int64))
        mine, at = total[back], np.cumsum([0, *map(len, keys)])
        out = group[["chunk", "kind", "bucket"]].copy()
        out["counts"] = [pack_planes(mine[a:b].astype(np.uint32) if total.max() < 1 << 32 else mine[a:b]) for a, b in zip(at, at[1:], strict=False)]
        stat = pd.DataFrame({"chunk": [-1], "kind": [group["kind"].iat[0]], "bucket": [group["bucket"].iat[0]], "counts": [pack_planes(np.array([total.sum(), (total > 0).sum()], np.int64))]})
        return pd.concat([out, stat])

    sent = table.mapInArrow(send, "kind string, bucket int, chunk bigint, keys binary, counts binary")
    return sent.groupBy("kind", "bucket").applyInPandas(count, "chunk bigint, kind string, bucket int, counts binary")


def counted(table: DataFrame, counts: DataFrame) -> DataFrame:
    """The chunks with the corpus counts of their words and bigrams, in the chunk's own order, which need the words' hashes no more."""
    schema = StructType([f for f in table.schema.fields if f.name != "words"]).add("word_counts", "binary").add("pair_counts", "binary")

    def meet(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({f.name: [] for f in schema})
        out = mine.drop(columns="words")
        r = mine.iloc[0]
        for (kind, keys, _), column in zip(Chunk(r["tokens"], r["lens"], r["train"], r["words"]).keys(), ("word_counts", "pair_counts"), strict=True):
            part = got[got["kind"] == kind].sort_values("bucket")
            order = np.argsort(keys, kind="stable")
            total = np.zeros(len(keys), np.int64)
            total[order] = np.concatenate([unpack_planes(c) for c in part["counts"]]).astype(np.int64)
            out[column] = [pack_planes(total)]
        return out

    return saved(table.groupBy("chunk").cogroup(counts.where("chunk >= 0").groupBy("chunk")).applyInPandas(meet, schema), "counted", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1, BUCKETS - 1)


def _evidence(r: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: count of its context, of the bigram, of the word."""
    c = Chunk(r["tokens"], r["lens"], r["train"])
    one, two = unpack_planes(r["word_counts"]), unpack_planes(r["pair_counts"])
    return c, one[c.before], two[c.pair], one[c.tokens]


def histogram(table: DataFrame, tokens: int) -> list:
    """(bucket, grid place of the deleted bigram estimate, of the deleted unigram estimate, tokens) over all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c, context, two, one = _evidence(r)
                t = c.train
                context, two, one = context[t] - 1, two[t] - 1, one[t] - 1
                i2 = np.where((two > 0) & (context > 0), np.minimum(1 + np.floor(-np.log2(np.maximum(two, 1) / np.maximum(context, 1)) * GRID), 120), 0).astype(np.int64)
                i1 = np.where(one > 0, np.minimum(1 + np.floor(-np.log2(np.maximum(one, 1) / max(1, tokens - 1)) * GRID), 200), 0).astype(np.int64)
                cell, n = np.unique(_bucket(context) << 32 | i2 << 16 | i1, return_counts=True)
                yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    rows = table.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return sorted((r["cell"] >> 32, r["cell"] >> 16 & 0xFFFF, r["cell"] & 0xFFFF, r["n"]) for r in rows)


def learn_weights(cells: list, distinct: int, rounds: int = 40) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate for each bucket, by expectation-maximisation."""
    out = np.tile(np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    a = np.array(cells, float).reshape(-1, 4)
    value = lambda i: np.where(i > 0, 2 ** (-(i - 0.5) / GRID), 0)
    for b in range(BUCKETS):
        own = a[a[:, 0] == b]
        if not len(own):
            out[b] = out[b - 1] if b else out[b]
            continue
        p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1 / (distinct + 1))], 1)
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            post = p * w
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            w = (post * own[:, 3:]).sum(0) / own[:, 3].sum()
        w = np.maximum(w, 1e-5)
        out[b] = w / w.sum()
    return out


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; `train` tells those to learn from."""
    table = chunks(docs, train)
    counts = saved(corpus_counts(table), "counts")
    stats = counts.where("chunk = -1 and kind = 'w'").select("counts").collect()  # one row for each bucket
    n, v = (sum(int(x) for x in col) for col in zip(*(unpack_planes(r[0]) for r in stats), strict=True)) if stats else (0, 0)
    released(docs.sparkSession)  # the counts' exchange is not kept beside the next
    known = counted(table, counts)
    weights = learn_weights(histogram(known, n), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c, context, two, one = _evidence(r)
                w = weights[_bucket(context)]
                p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
                at = np.cumsum(c.lens) - c.lens
                total = lambda x: np.add.reduceat(x, at)  # noqa: E731  every document has its end
                base = np.log10((one + 0.5) / (n + 0.5 * (v + 1)))
                yield pa.record_batch(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([not x for x in r["train"]], pa.bool_()), pa.array(c.lens, pa.int64()), pa.array(total((one > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(at), n), pa.int64()), pa.array(total(base), pa.float64()), pa.array(total(np.log10(p)), pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return known.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
