"""The id files' coder in the executors' JVMs: the bytes of the numpy lanes, no Python on the way back, damaged blocks refused."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jvm, range_coder

FILE = "file_no int, seg_no int, first bigint, doc_ids array<bigint>, lens array<bigint>, blocks array<binary>"


def samples():
    r = np.random.default_rng(7)
    for n in (0, 1, 63, 64, 65, 129, 4096, 4097, 9000):
        yield r.integers(0, 50257, n)
        yield np.repeat(r.integers(0, 65536, n // 90 + 1), 100)[:n]
        yield np.where(r.random(n) < 0.3, r.integers(0, 1 << 32, n), r.geometric(0.02, n))
    yield np.zeros(5000)
    yield np.full(5000, (1 << 32) - 1)


def test_blocks_are_those_of_the_lanes(spark):
    encode = jvm.function(spark, "LaneCoder", "Encode", "array<binary>")
    all_ids = [ids.astype("<u4") for ids in samples()]
    for block in (64, 1000, 4096):
        rows = spark.createDataFrame([(i, ids.tobytes()) for i, ids in enumerate(all_ids)], "i int, ids binary").select("i", encode("ids", F.lit(block)).alias("blocks")).collect()
        for i, blocks in rows:
            if all_ids[i].max(initial=0) < 1 << 16:  # deflated upper halves may differ between zlib's builds
                assert list(map(bytes, blocks)) == range_coder.encode_blocks(all_ids[i], block)
            assert (range_coder.decode_blocks(list(map(bytes, blocks))) == all_ids[i]).all()


def test_blocks_of_the_lanes_are_read(spark):
    rows, want, start = [], [], {0: 0, 2: 0}  # a file without rows between two
    for k, ids in enumerate(samples()):
        ids, file = ids.astype("<u4"), 0 if k < 9 else 2
        lens = [len(ids) // 3, len(ids) - len(ids) // 3]
        rows.append((file, k, start[file], [k, None], lens, range_coder.encode_blocks(ids, 1000)))
        want += [(file, start[file], k, lens[0], zlib.crc32(ids[: lens[0]].tobytes())), (file, start[file] + lens[0], None, lens[1], zlib.crc32(ids[lens[0] :].tobytes()))]
        start[file] += len(ids)
    got = range_coder.read_ids(spark.createDataFrame(rows, FILE)).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=d, start=s + (start[0] if f else 0), n_tokens=n, ids_crc32=c)) for f, s, d, n, c in want)


def test_files_are_read_without_python(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    got = range_coder.read_ids(range_coder.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert [(r.doc_id, r.start, r.n_tokens) for r in got.orderBy("start").collect()] == [(1, 0, 4), (2, 4, 1)]


def test_damaged_files_are_refused(spark):
    ids = np.random.default_rng(2).integers(0, 300, 3000).astype("<u4")
    blocks = range_coder.encode_blocks(ids, 1000)
    r = np.random.default_rng(4)
    for k in range(12):
        bad = [bytearray(b) for b in blocks]
        if k == 0:
            bad = bad[:2]
        elif k == 1:
            bad.append(bad[0])
        else:
            bad[k % 3][int(r.integers(0, len(bad[k % 3]) - 8)) if k > 3 else 4 * (k - 1) - 1] ^= 0x55
        with pytest.raises(Exception, match="checksum|not a block"):
            range_coder.read_ids(spark.createDataFrame([(0, 0, 0, [1], [3000], list(map(bytes, bad)))], FILE)).collect()


def test_long_texts_are_coded_where_they_are(spark):
    texts = ["a", "lorem 1 " * 400, None, "x y " * 300, "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")

    def made(most):
        files = range_coder.write_ids(docs, path, lanes=2, block=128, most_sent=most)
        return [tuple(r) for r in files.orderBy("file_no", "seg_no").collect()], range_coder.read_ids(files).orderBy("start").collect()

    assert made(500) == made(1 << 20) == made(0)
