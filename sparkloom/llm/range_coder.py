"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

File format. A file is a Parquet directory; each row is a segment of whole documents: file_no and seg_no (documents ascend by file_no,
then seg_no, then their place in the row), first (ids of the file before the segment), doc_ids, lens (ids of each document) and blocks. A block
codes BLOCK ids of the segment (the last fewer) and is, little-endian: b"LCM2", u32 number of ids, u32 CRC-32 of the ids as u32 little-endian,
u32 size of the deflated upper halves (0 if all are 0) and these, then the range coder's bytes for the lower halves. The model starts anew in every
block, so each can be read alone.

Model. Order 2 (the two ids before) and order 1 (the id before) each predict one id, with a confidence; both and order 0 are mixed by weights
that adapt for each pair of confidences. Order 0 is the share of each id in the block so far, counted anew whenever the block has doubled; a part of
its range, as large as the share of new ids lately, is for ids not met before. One coding step an id: the flag of the mix and order 0's place together.
All is integer arithmetic, so that encoder and decoder agree on every machine. `LaneCoder.java` codes the files of `write_ids` and `read_ids` in the executors' JVMs,
block by block; `encode_blocks` and `decode_blocks` do the same without Spark, all blocks of a group together, one numpy lane each, and give the same bytes.

Null texts have only the end id; an empty table gives no file rows. Repeated doc_ids are kept, in (doc_id, text) order. Ids may have any 32-bit size. A
document longer than a segment has a segment of its own; one of more than SENT_IDS is coded by the numpy lanes, LANES blocks at a time, as
its ids would take too much of the JVM's heap. Other columns of the table are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jvm
from .bpe_stream import byte_symbols
from .store import bounded_batches, partitions, saved, worker_state

BLOCK, LANES, END_ID = 4096, 1536, 2
SEGMENT_BLOCKS, SENT_IDS = 256, 16 << 20  # ids of a segment sent to the JVM as one value; a longer one is coded where it is
_HEAD = struct.Struct("<4sIII")
_TABLE_BITS, _FIRST, _SLICE, _GROUP = 11, 64, 256, 8
_LEAST, _WIDE = 1 << 40, (1 << 56) - 1  # the coder's range stays between them; 16 bits leave it at a time
_REST = _LEAST - 1
#: Weights of orders 2 and 1 share a cell, 12 bits of 16 each; a hit adds _GAIN, and each loses a 16th.
_GAIN, _KEPT = 240, 0x0FFF0FFF
_NEXT_CONF = np.array([0, 0, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int32)  # by confidence, then by confidence after a hit


class _Contexts:
    """Orders 1 and 2 with their weights, one lane to a block. A cell holds a guess and 3 bits of confidence; row 0 is order 1."""

    def __init__(self, lanes: int):
        size = 1 << _TABLE_BITS
        self.cells = np.zeros(2 * lanes * size, np.int32)
        self.row = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * size
        self.weights = np.full(lanes << 7, 400 << 16 | 400, np.int32)
        self.lane = np.arange(lanes, dtype=np.int64) << 7

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Cells of the contexts (last) and (before, last), steps x orders x lanes."""
        h = np.stack([last, (before * 31) ^ last], axis=-2) * 40503
        return ((h & 0xFFFF) >> 16 - _TABLE_BITS) + self.row

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of orders 2 and 1, out of 4096; order 0 has the rest."""
        self.at, cell = at, self.cells.take(at)
        self.conf, self.guess = cell & 7, cell >> 3
        self.slot = self.lane + (self.conf[1] * 8 + self.conf[0]) + (self.guess[0] == self.guess[1]) * 64
        self.pair = self.weights.take(self.slot)
        return self.pair >> 16, self.pair & 0xFFFF

    def learn(self, symbol: np.ndarray) -> None:
        hit = self.guess == symbol
        self.weights[self.slot] = self.pair - (self.pair >> 4 & _KEPT) + np.where(hit[1], _GAIN << 16, hit[0] * _GAIN)
        kept = np.where(hit | (self.conf > 1), self.guess, symbol)
        self.cells[self.at] = kept << 3 | _NEXT_CONF.take(self.conf + hit * 8)


def _ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of symbols, lanes x steps: each symbol's number in the lane's order of first occurrence, and whether it is the first."""
    rank, first = np.empty(rows.shape, np.int32), np.empty(rows.shape, bool)
    place = np.empty(_GROUP << 16, np.int32)
    at = np.arange(rows.shape[1], dtype=np.int32)
    back = at[::-1].copy()
    for a in range(0, len(rows), _GROUP):
        part = rows[a : a + _GROUP]
        key = part + (np.arange(len(part), dtype=np.int64) << 16)[:, None]
        place[np.ascontiguousarray(key[:, ::-1])] = back  # the earliest place is written last
        met = place.take(key)
        first[a : a + _GROUP] = met == at
        nth = np.cumsum(met == at, axis=1, dtype=np.int32) - 1
        rank[a : a + _GROUP] = np.take_along_axis(nth, met.astype(np.int64), axis=1)
    return rank, first


class _Order0:
    """Counts by rank of the first `upto` symbols (a power of 2) of each lane, in units of a range of 2^20 whose first fresh << 16 are for new ones."""

    def __init__(self, rank: np.ndarray, first: np.ndarray, upto: int):
        rank = rank[:, :upto]
        self.size = int(rank.max()) + 1
        self.base = np.arange(len(rank), dtype=np.int64) * self.size
        self.count = np.bincount((rank + self.base[:, None]).ravel(), minlength=len(rank) * self.size)
        table = self.count.reshape(len(rank), -1)
        self.low = (np.cumsum(table, axis=1) - table).ravel()
        self.fresh = np.clip(first[:, upto // 2 : upto].sum(axis=1) * 32 // upto, 1, 15).astype(np.int64)
        self.unit = (16 - self.fresh) << (17 - upto.bit_length())


def _marks(steps: int) -> list[int]:
    """Steps at which order 0 is counted, between 0 and the last."""
    out = [0]
    while (at := max(_FIRST, 2 * out[-1])) < steps:
        out.append(at)
    return [*out, steps]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """Blocks of a segment's ids; all but the last hold `block` ids."""
    return [b for at in range(0, len(ids), block * lanes) for b in _encoded(ids[at : at + block * lanes], block)]


def _encoded(ids: np.ndarray, block: int) -> list[bytes]:
    lanes = -(-len(ids) // block)
    last = len(ids) - (lanes - 1) * block
    steps = min(len(ids), block)
    grid = np.zeros((lanes, steps), np.int32)
    grid.ravel()[: len(ids)] = ids & 0xFFFF
    columns = np.zeros((steps + 2, lanes), np.int64)  # two zeros before each block
    columns[2:] = grid.T
    model, (rank, first) = _Contexts(lanes), _ranks(grid)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, _WIDE)
    out = np.zeros(lanes * (2 * steps + 2), np.uint32)  # words of 16 bits, carries above
    begin = np.arange(lanes, dtype=np.int64) * (2 * steps + 2)
    used, end = begin.copy(), None
    marks = _marks(steps)
    for a, b in zip(marks, marks[1:], strict=False):
        zero = _Order0(rank, first, a) if a else None
        for c in range(a, b, _SLICE):
            d = min(b, c + _SLICE)
            # order 0 needs no lockstep here: all ids are looked up at once
            symbols = grid[:, c:d]
            if zero is None:
                place, share = symbols.astype(np.int64) * 16, np.full(symbols.shape, 16, np.int64)
            else:
                known = rank[:, c:d] < zero.size
                at = np.where(known, rank[:, c:d] + zero.base[:, None], 0)
                count = zero.count.take(at)
                known &= count > 0
                unit, fresh = zero.unit[:, None], zero.fresh[:, None]
                place = np.where(known, zero.low.take(at) * unit + (fresh << 16), symbols * fresh)
                share = np.where(known, count * unit, fresh)
            place, share, symbols = (np.ascontiguousarray(x.T) for x in (place, share, symbols))
            contexts = model.places(columns[c + 1 : d + 1], columns[c:d])
            for t in range(d - c):
                if c + t == last:
                    end = int(low[-1]), int(used[-1])
                f2, f1 = model.predict(contexts[t])
                is2, is1 = model.guess[1] == symbols[t], model.guess[0] == symbols[t]
                both = f2 + f1
                rest = 4096 - both
                first2 = f2.astype(np.int64) << 20
                size = np.where(is2, first2, np.where(is1, f1.astype(np.int64) << 20, rest * share[t]))
                start = np.where(is2, 0, np.where(is1, first2, (both.astype(np.int64) << 20) + rest * place[t]))
                model.learn(symbols[t])
                wide >>= 32
                low += start * wide
                wide *= size
                while len(go := np.flatnonzero(wide < _LEAST)):
                    x, at = low[go], used[go]
                    out[at] = x >> 40
                    used[go] = at + 1
                    low[go] = (x & _REST) << 16
                    wide[go] <<= 16
    # one more word says where in the range the code ends; zeros follow it
    out[used] = (low + _REST) >> 40
    used += 1
    if end:
        out[end[1]], used[-1] = (end[0] + _REST) >> 40, end[1] + 1
    result = []
    for i in range(lanes):
        part = ids[i * block : (i + 1) * block].astype("<u4")
        words = out[begin[i] : used[i]]
        carry = (words >> 16).astype(">u2").tobytes()[2:] + b"\0\0"
        code = (int.from_bytes((words & 0xFFFF).astype(">u2").tobytes()) + int.from_bytes(carry)).to_bytes(2 * len(words)).rstrip(b"\0")
        upper = zlib.compress((part >> 16).astype("<u2").tobytes()) if (part >> 16).any() else b""
        result.append(_HEAD.pack(b"LCM2", len(part), zlib.crc32(part.tobytes()), len(upper)) + upper + code)
    return result


def decode_blocks(blocks: list[bytes], lanes: int = LANES) -> np.ndarray:
    """The ids of a segment; a damaged block raises ValueError."""
    return np.concatenate([_decoded(blocks[at : at + lanes]) for at in range(0, len(blocks), lanes)]) if blocks else np.zeros(0, "<u4")


def _decoded(blocks: list[bytes]) -> np.ndarray:
    if any(len(b) < _HEAD.size or b[:4] != b"LCM2" for b in blocks):
        raise ValueError("not a block")
    heads = [_HEAD.unpack_from(b) for b in blocks]
    lanes, steps = len(blocks), max(h[1] for h in heads)
    codes = [b[_HEAD.size + h[3] :] for b, h in zip(blocks, heads, strict=True)]
    width = max(map(len, codes)) // 2 + 8
    raw = np.zeros((lanes, 2 * width + 7), np.uint8)
    for i, b in enumerate(codes):
        raw[i, : len(b)] = np.frombuffer(b, np.uint8)
    code = np.zeros(lanes, np.int64)
    for k in range(7):
        code = code << 8 | raw[:, k]
    data = np.ascontiguousarray(raw[:, 7:]).view(">u2").astype(np.int64).ravel()
    used = np.arange(lanes, dtype=np.int64) * width
    top = used + width - 1
    model, wide = _Contexts(lanes), np.full(lanes, _WIDE)
    columns = np.zeros((steps, lanes), np.int32)
    last = before = np.zeros(lanes, np.int64)
    marks = _marks(steps)
    for a, b in zip(marks, marks[1:], strict=False):
        fresh = np.full(lanes, 16, np.int64)
        if a:
            rows = np.ascontiguousarray(columns[:a].T)
            rank, first = _ranks(rows)
            zero = _Order0(rank, first, a)
            symbols = np.zeros(lanes * zero.size, np.int64)
            symbols[(rank + zero.base[:, None])[first]] = rows[first]
            # which cell each unit of a lane's counts belongs to
            cells = np.repeat(np.arange(lanes * zero.size, dtype=np.int32), zero.count)
            fresh, unit, base = zero.fresh, zero.unit, np.arange(lanes, dtype=np.int64) * a
        for t in range(a, b):
            f2, f1 = model.predict(model.places(last, before))
            both = f2 + f1
            wide >>= 32
            found = (code.view(np.uint64) // wide.view(np.uint64)).view(np.int64)
            flag = found >> 20
            is2 = flag < f2
            first2 = f2.astype(np.int64) << 20
            size, start = np.where(is2, first2, f1.astype(np.int64) << 20), np.where(is2, 0, first2)
            symbol = np.where(is2, model.guess[1], model.guess[0])
            if len(e := np.flatnonzero(flag >= both)):
                hits = both[e].astype(np.int64)
                rest, hits = 4096 - hits, hits << 20
                at = np.minimum((found[e] - hits) // rest, (1 << 20) - 1)
                share = fresh[e]
                x = at // share
                place = x * share
                if a:
                    old = np.flatnonzero(at >= share << 16)
                    of, skip = unit[e[old]], share[old] << 16
                    cell = cells.take(np.minimum((at[old] - skip) // of, a - 1) + base[e[old]])
                    x[old], place[old], share[old] = symbols.take(cell), zero.low.take(cell) * of + skip, zero.count.take(cell) * of
                symbol[e], start[e], size[e] = x, hits + rest * place, rest * share
            columns[t] = symbol
            model.learn(symbol)
            last, before = symbol.astype(np.int64), last
            code -= start * wide
            wide *= size
            while len(go := np.flatnonzero(wide < _LEAST)):
                at = used[go]
                code[go] = (code[go] << 16 | data.take(at)) & _WIDE
                used[go] = np.minimum(at + 1, top[go])
                wide[go] <<= 16
    parts = []
    for i, h in enumerate(heads):
        ids = columns[: h[1], i].astype("<u4")
        if h[3]:
            try:
                ids |= np.frombuffer(zlib.decompress(blocks[i][_HEAD.size : _HEAD.size + h[3]]), "<u2").astype("<u4") << 16
            except zlib.error as e:
                raise ValueError("checksum") from e
        if zlib.crc32(ids.tobytes()) != h[2]:
            raise ValueError("checksum")
        parts.append(ids)
    return np.concatenate(parts)


#: The pre-tokenizer's pattern (a fixed value of byte-level BPE).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same where all characters are of `_LATIN`, and spaces only before words; Latin-1's letters are in all tables alike.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ][\n!-~À-ÖØ-öø-ÿ]*")
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[ \n]+(?![^ \n])|[ \n]+")
_GAP = re.compile(r"(?<=\S) ")
_OPEN = r"(^|[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]) "
CACHED, AT_ONCE = 600_000, 8 << 20


class Units:
    """A byte-level tokenizer that asks the library once for each space-led word: a space after a character that is no space always starts a new word of its pattern.

    A batch's words are told apart by Arrow; their ids are gathered from one flat array. Of a word of Latin letters and signs the library's model gets each piece once,
    and all new words of a batch are cut into pieces together; any other word goes to the library whole, as do all where the file does not say plain byte-level BPE.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        j = json.loads(spec)
        self.lib, self.model = Tokenizer.from_str(spec), Tokenizer.from_str(spec).model
        special = [t["content"] for t in j["added_tokens"]]
        pre = j.get("pre_tokenizer") or {}
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = special
        self.splits = level and not j.get("normalizer") and not any(c.isspace() for s in special for c in s)
        self.plain = self.splits and j["model"]["type"] == "BPE" and not any(j["model"].get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.odd = re.compile("|".join(["[\u0370-\U0010ffff]", *map(re.escape, special)]))  # beyond Latin the library's own tables tell letters
        self.symbols = dict(enumerate(byte_symbols()))
        self.blank = self.symbols[32]
        self.reset()

    def reset(self) -> None:
        self.unit: dict[str, int] = {}  # space-led words under the word, others under a zero byte and the word
        self.piece: dict[str, list[int]] = {}
        self.size, self.start, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.part: dict[str, int] = {}  # pieces of words cut together, by number
        self.part_size, self.part_start, self.part_flat = self.size, self.start, self.flat

    def _ids(self, key: str) -> list[int]:
        text = key[1:] if key[:1] == "\0" else " " + key
        if not self.plain or self.odd.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for p in _PIECES.findall(text):
            if (got := self.piece.get(p)) is None:
                got = self.piece[p] = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.symbols))]
            out += got
        return out

    def _cut(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of space-led words of `_LATIN`, cut into pieces together: the space before a word begins a piece."""
        pieces = _LATIN_PIECES.findall(" " + " ".join(keys))
        if missing := [p for p in dict.fromkeys(pieces) if p not in self.part]:
            symbols, tokenize = self.symbols, self.model.tokenize
            new = [[t.id for t in tokenize(self.blank + p[1:] if p[0] == " " and p.isascii() and p[1:].isalpha() else p.encode().decode("latin-1").translate(symbols))] for p in missing]
            self.part.update(zip(missing, range(len(self.part), len(self.part) + len(new)), strict=True))
            self.part_size, self.part_start, self.part_flat = _longer(self.part_size, self.part_start, self.part_flat, np.fromiter(map(len, new), np.int32, len(new)), np.fromiter(chain.from_iterable(new), "<u4"))
        n = np.fromiter(map(self.part.__getitem__, pieces), np.int32, len(pieces))
        begin = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        words = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)) + 1)
        first = np.concatenate([[0], np.searchsorted(begin, words[:-1]) + 1])
        size = self.part_size[n]
        return np.add.reduceat(size, first, dtype=np.int32), _gathered(self.part_flat, self.part_start[n], size)

    def _known(self, keys: list[str]) -> np.ndarray:
        """Numbers of units, new ones added."""
        unit = self.unit
        if missing := list(dict.fromkeys(k for k in keys if k not in unit)):
            latin = [k for k in missing if _LATIN.fullmatch(k)] if self.plain else []
            all_latin = "\0".join(latin)
            if latin and not any(x in all_latin for x in self.special):
                self._add(latin, *self._cut(latin))
                missing = [k for k in missing if k not in unit]
            new = list(map(self._ids, missing))
            self._add(missing, np.fromiter(map(len, new), np.int32, len(new)), np.fromiter(chain.from_iterable(new), "<u4"))
        return np.fromiter(map(unit.__getitem__, keys), np.int32, len(keys))

    def _add(self, keys: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.unit.update(zip(keys, range(len(self.unit), len(self.unit) + len(keys)), strict=True))
        self.size, self.start, self.flat = _longer(self.size, self.start, self.flat, size, ids)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and their number in each."""
        if max(len(self.unit), len(self.part)) > CACHED:
            self.reset()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _OPEN).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        odd = odd | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)  # a zero byte marks heads
        words = pc.split_pattern(pc.if_else(pa.array(~odd), texts, ""), " ")
        each = words.flatten().dictionary_encode()
        first = np.asarray(words.offsets)[:-1] - words.offsets[0].as_py()
        number = self._known(each.dictionary.to_pylist())[each.indices.to_numpy()] if len(each) else np.zeros(0, np.int64)
        heads = pc.take(words.flatten(), pa.array(first)).dictionary_encode()
        number[first] = self._known(["\0" + w for w in heads.dictionary.to_pylist()])[heads.indices.to_numpy()] if len(heads) else number[first]
        size = self.size[number]
        out = _gathered(self.flat, self.start[number], size)
        lens = np.add.reduceat(size, first, dtype=np.int64) if len(first) else size
        if not odd.any():
            return np.insert(out, np.cumsum(lens), end_id), lens + 1
        parts = np.split(out, np.cumsum(lens)[:-1])
        for i in np.flatnonzero(odd).tolist():
            t = texts[i].as_py()
            if self.splits and "\0" not in t:
                head, *led = _GAP.split(t)
                n = self._known(["\0" + head, *led])
                parts[i] = _gathered(self.flat, self.start[n], self.size[n])
            else:
                parts[i] = np.array(self.lib.encode(t, add_special_tokens=False).ids, "<u4")
        end = np.array([end_id], "<u4")
        return np.concatenate([x for p in parts for x in (p, end)]), np.array([len(p) + 1 for p in parts], np.int64)


def _longer(size: np.ndarray, start: np.ndarray, flat: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, starts and values of ragged rows, with further rows."""
    return np.concatenate([size, more]), np.concatenate([start, (len(flat) + np.cumsum(more) - more).astype(np.int32)]), np.concatenate([flat, ids])


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size, dtype=np.int32)  # a batch has under 2^31 ids
    at = np.repeat(start - ends + size, size)
    at += np.arange(len(at), dtype=np.int32)
    return flat.take(at)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of AT_ONCE bytes of text together, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


SEGMENT = "file_no int, seg_no int, first bigint, doc_ids array<bigint>, lens array<bigint>, blocks array<binary>"


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, lanes: int = SEGMENT_BLOCKS, block: int = BLOCK, most_sent: int = SENT_IDS) -> DataFrame:
    """Encodes all texts in ascending doc_id order into files under the shared folder, `lanes` blocks a segment; the DataFrame reads them (`SEGMENT`)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = f"units {zlib.crc32(spec.encode())}"
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(key, lambda: Units(shared.value))
        file_no, seg, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        lens: list[int] = []
        data: list[np.ndarray] = []
        held = 0

        def segment():
            nonlocal ids, lens, data, held, seg, first
            here = held > most_sent
            all_ids = np.concatenate(data).astype("<u4", copy=False)
            blocks = encode_blocks(all_ids, block) if here else None
            sent = None if here else all_ids.tobytes()
            out = pa.record_batch([pa.array([file_no], pa.int32()), pa.array([seg], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary())), pa.array([sent], pa.binary())], names=["file_no", "seg_no", "first", "doc_ids", "lens", "blocks", "ids"])
            seg, first, ids, lens, data, held = seg + 1, first + held, [], [], [], 0
            return out

        for whole in batches:
            for b in _slices(whole):
                coded, sizes = t.encode(b.column(1), end_id)
                at = 0
                for doc, n in zip(b.column(0).to_pylist(), sizes.tolist(), strict=True):
                    if held and held + n > lanes * block:
                        yield segment()
                    ids.append(doc)
                    lens.append(n)
                    data.append(coded[at : at + n])
                    held += n
                    at += n
        if ids:
            yield segment()

    encode = jvm.function(docs.sparkSession, "LaneCoder", "Encode", "array<binary>")
    coded = rows.mapInArrow(run, f"{SEGMENT}, ids binary").withColumn("blocks", F.when(F.col("ids").isNull(), F.col("blocks")).otherwise(encode(F.col("ids"), F.lit(block)))).drop("ids")
    return saved(coded, "ids", **{"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files; a damaged block raises."""
    sizes = {r["file_no"]: r["n"] for r in files.groupBy("file_no").agg(F.max(F.col("first") + F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect()}  # one row for each file
    base = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    bases = F.split(F.lit(",".join(map(str, base))), ",").cast("array<bigint>")  # by file_no
    decode = jvm.function(files.sparkSession, "LaneCoder", "Decode", "array<struct<doc_id: bigint, start: bigint, n_tokens: bigint, ids_crc32: bigint>>")
    return files.select(F.inline(decode("blocks", "doc_ids", "lens", F.col("first") + bases[F.col("file_no")])))
