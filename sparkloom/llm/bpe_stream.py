"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The tokens of a merge list's encoding are exactly those of which every neighbouring pair encodes to itself. So each prefix of a word has one
last token, which depends on the last token of the prefix before it: a chain of back pointers. `sufficient_lookahead` says from the merge list alone how
far right of a token's end a symbol can stand that still changes it: only through a chain of merges of falling rank, each of whose left parts lies
on the right edge of the one before. A token that ends that far back is emitted; no later symbol can change it.
Words are fed symbol by symbol, so memory is constant however long a word is; of a word no longer than the lookahead nothing can leave before its end, so
it is taken at once, longest tokens first, and results of short words are kept in caches of bounded size. Tokens go to the incremental decoder and to the digests as they leave.

Null texts count as empty: no tokens, the digests of the empty string. Characters without a vocabulary entry are left out, as the library does. Each
row is encoded by itself, so repeated rows give repeated results and an empty table gives none; result columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import bounded_batches, trimmed, worker_state

_HIGH = re.compile("[\u0378-\U0010ffff]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]")
STRIDE, CACHED, PAIRS, LONGEST_CACHED, WINDOW = 64, 3 << 15, 1 << 18, 96, 1 << 16
Made = tuple[str, int, str, str]


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: Latin-1's visible characters stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeList:
    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.whole = {a + b for a, b in self.rank} | {s for s in vocab if len(s.removesuffix(suffix) if suffix else s) == 1}
        self.longest = max((len(self.symbols(t)) for t in self.whole), default=1)
        self.reach: dict[str, int] = {}  # most symbols of a token with these first four characters
        for t in self.whole:
            self.reach[t[:4]] = max(self.reach.get(t[:4], 3), len(self.symbols(t)))
        self._pairs: dict[int, bool] = {}  # by the numbers of both tokens
        self._own: dict[str, bool] = {}
        self._number: dict[str, int] = {}  # of tokens that are their own encoding; -1 of others
        self._split: dict[str, tuple[int, str, str]] = {}
        self.lookahead = self.sufficient_lookahead()

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Plain BPE, the pair of least rank first, leftmost first; and the pair merged last."""
        parts, last = list(parts), None
        while len(parts) > 1:
            least, at = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if least == 1 << 60:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def own(self, token: str) -> bool:
        """Whether the token's text encodes to the token itself; then `_split` knows the pair that makes it."""
        if (v := self._own.get(token)) is None:
            parts, last = self.merge(self.symbols(token))
            v = self._own[token] = parts == [token]
            if v:
                self._split[token] = (self.rank[last], *last) if last else (-1, "", "")
        return v

    def number(self, token: str) -> int:
        """A number for a token of `whole` that is its own encoding, else -1."""
        if (v := self._number.get(token)) is None:
            v = self._number[token] = len(self._number) if self.own(token) else -1
        return v

    def joins(self, a: str, b: str) -> bool:
        """Whether a, b is the encoding of their text: going back through the merges of both, the later first, no pair across the border would have come before."""
        key = self.number(a) << 32 | self.number(b)
        if (v := self._pairs.get(key)) is not None:
            return v
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        x, y, limit, right, v = a, b, 1 << 60, False, True
        while True:
            cross = self.rank.get((x, y), 1 << 61)
            if cross < limit or cross == limit and right:
                v = False
                break
            for t in (x, y):
                if t not in self._split:
                    self.own(t)
            (mx, _, x2), (my, y1, _) = self._split[x], self._split[y]
            if mx < 0 and my < 0:
                break
            if mx > my:
                x, limit, right = x2, mx, False
            else:
                y, limit, right = y1, my, True
        self._pairs[key] = v
        return v

    def sufficient_lookahead(self) -> int:
        """Symbols beyond a token's end that can still change it, at most."""
        made_by: dict[str, tuple[str, str]] = {}
        best: dict[str, int] = {}
        most = 0
        for a, b in self.rank:  # in rank order: only merges of lower rank are in best
            reach, x = 0, b
            while True:
                reach = max(reach, best.get(x, 0))
                if x not in made_by:
                    break
                x = made_by[x][1]
            own = len(self.symbols(b)) + reach
            best[a] = max(best.get(a, 0), own)
            most = max(most, own)
            made_by.setdefault(a + b, (a, b))
        return most


class Transducer:
    """Takes a word's symbols one by one and gives each token as soon as it is stable."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.text: list[str] = []  # symbols since the last emitted token
        self.last: list[str | None] = [None]  # last token of each prefix of it
        self.before: str | None = None  # the last emitted token
        self.held = 0  # most symbols ever held

    def _token(self, end: int, symbol: str) -> str | None:
        size = min(end, self.m.longest)
        tail = "".join(self.text[end - size : end - 1]) + symbol
        whole = self.m.whole
        for n in range(size, 0, -1):
            t = tail[size - n :]
            if t in whole and self.m.own(t):
                prior = self.last[end - n] if end > n else self.before
                if (prior is None and end == n and self.before is None) or (prior is not None and self.m.joins(prior, t)):
                    return t
        return None

    def feed(self, symbol: str) -> list[str]:
        self.text.append(symbol)
        self.last.append(self._token(len(self.text), symbol))
        self.held = max(self.held, len(self.text))
        return self._stable() if len(self.text) % STRIDE == 0 else []

    def _start(self, end: int) -> int:
        t = self.last[end]
        return end - (len(t) - len(self.m.suffix) if self.m.suffix and t.endswith(self.m.suffix) else len(t))

    def _stable(self) -> list[str]:
        """Tokens that end the sufficient lookahead or more before the last symbol: nothing to come can change them."""
        cut = len(self.text)
        while cut > 0 and cut > len(self.text) - self.m.lookahead:
            cut = self._start(cut)
        return self._emit(cut)

    def _emit(self, cut: int) -> list[str]:
        out, at = [], cut
        while at:
            out.append(self.last[at])
            at = self._start(at)
        if out:
            self.before = out[0]
            self.text, self.last = self.text[cut:], [None, *self.last[cut + 1 :]]
        return out[::-1]

    def finish(self) -> list[str]:
        if not self.text:
            return []
        if self.m.suffix:
            self.text[-1] += self.m.suffix
            self.last[-1] = self._token(len(self.text), self.text[-1])
        return self._emit(len(self.text))


def at_once(m: MergeList, w: str) -> list[str]:
    """What a Transducer gives for a word short enough to be held whole: the longest token that fits its neighbour, and a step back where none fits.

    A prefix has one encoding, so an end from which nothing led on is never tried again.
    """
    n, whole, number, numbers, pairs = len(w), m.whole, m._number.get, m.number, m._pairs
    text, reach = w + m.suffix, m.reach.get
    out: list[str] = []
    held: list[tuple[int, int]] = []  # number and size of each token of out
    failed: set[int] = set()
    at, prior, size = 0, -1, min(n, reach(text[:4], 3))
    while at < n:
        while size:
            end = at + size
            t = text[at:end] if end < n else text[at:]
            if t in whole and end not in failed:
                if (x := number(t)) is None:
                    x = numbers(t)
                if x >= 0 and (prior < 0 or (m.joins(out[-1], t) if (ok := pairs.get(prior << 32 | x)) is None else ok)):
                    break
            size -= 1
        if size:
            out.append(t)
            held.append((x, size))
            at, prior = end, x
            size = min(n - at, reach(text[at : at + 4], 3))
        else:
            failed.add(at)
            out.pop()
            size = held.pop()[1]
            at -= size
            size -= 1
            prior = held[-1][0] if held else -1
    return out


class Decoder:
    """Bytes to text, one token at a time: holds at most three bytes of an unfinished character."""

    def __init__(self):
        self.held, self.need = b"", 0

    def feed(self, data: bytes) -> str:
        if not self.held and data.isascii():
            return data.decode()
        data, out = self.held + data, []
        i = 0
        while i < len(data):
            b = data[i]
            size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            got = 1
            while size and got < size and i + got < len(data) and (low if got == 1 else 0x80) <= data[i + got] <= (high if got == 1 else 0xBF):
                got += 1
            if size and got == size:
                out.append(data[i : i + size].decode())
            elif size and i + got == len(data):
                break  # unfinished
            else:
                out.append("�")
            i += got
        self.held = data[i:]
        return "".join(out)

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return "�" if rest else ""


class WordBpe:
    """A word-level byte BPE with lower-casing, from a tokenizers JSON."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.merges = MergeList(model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.token = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self._byte = byte_symbols()
        self._back = {s: b for b, s in enumerate(self._byte)}
        self._known: dict[str, Made] = {}  # words since it was last full
        self._older: dict[str, Made] = {}  # those before
        self._spec, self._lib = spec, None
        self._plain = self._whole_characters()

    def word(self, symbols: str) -> list[int]:
        """Ids of a word given as byte symbols."""
        return [self.merges.vocab[t] for tokens in self._tokens(symbols) for t in tokens]

    def _tokens(self, symbols: str) -> Iterator[list[str]]:
        """Tokens of a word as they leave the transducer."""
        if len(symbols) <= self.merges.lookahead:
            yield at_once(self.merges, symbols)
            return
        t = Transducer(self.merges)
        for c in symbols:
            if out := t.feed(c):
                yield out
        yield t.finish()

    def _symbols(self, w: str) -> str:
        """A word as byte symbols."""
        return w if w.isascii() and w.isprintable() else "".join([self._byte[b] for b in w.encode("utf-8", "surrogatepass")])

    def _library(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_str(self._spec)
        return self._lib

    def _word_made(self, w: str) -> Made:
        """Ids, their number, the tokens joined by spaces and the word itself, of a word to be held whole."""
        if (got := self._known.get(w)) is None:
            if (got := self._older.get(w)) is None:
                if len(symbols := self._symbols(w)) > self.merges.lookahead:
                    parts = [m for m in self._streamed(symbols) if m[1]]
                    return " ".join([m[0] for m in parts]), sum(m[1] for m in parts), " ".join([m[2] for m in parts]), "".join([m[3] for m in parts])
                tokens = at_once(self.merges, symbols)
                ids = [self.merges.vocab[t] for t in tokens]
                got = " ".join(map(str, ids)), len(ids), " ".join(tokens), self.text(ids)
            if len(w) <= LONGEST_CACHED:
                if len(self._known) >= CACHED:
                    self._known, self._older = {}, self._known
                self._known[w] = got
        return got

    def _streamed(self, symbols: str) -> Iterator[Made]:
        """A long word's tokens as they leave, and the characters they complete."""
        d = Decoder()
        for tokens in self._tokens(symbols):
            ids = [self.merges.vocab[t] for t in tokens]
            yield " ".join(map(str, ids)), len(ids), self.decode(ids), "".join([self._fed(d, i) for i in ids])
        yield "", 0, "", d.finish()

    def _words_made(self, words: Iterable[str]) -> Iterator[Made]:
        for w in words:
            if len(w) > LONGEST_CACHED and len(symbols := self._symbols(w)) > self.merges.lookahead:
                yield from self._streamed(symbols)
            else:
                yield self._word_made(w)

    def _parts(self, text: str) -> Iterator[list[Made]]:
        """What the text's words give, in order and in lists of bounded size; special tokens come as themselves."""
        parts = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        for nth, part in enumerate(parts):
            if nth % 2:
                yield [(str(self.special[part]), 1, part, part)]
                continue
            if not part.isascii():
                if _HIGH.search(part) and _unassigned().search(part):  # characters newer than Python's tables: the library tells the words
                    lib = self._library()
                    yield from ([m] for m in self._words_made(bytes([self._back[c] for c in w]).decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))))
                    continue
                part = unicodedata.normalize("NFC", part)
                if "Σ" in part:
                    part = part.replace("Σ", "σ")  # no final form: characters are lowered one by one
            part, at = part.lower(), 0
            while at < len(part):
                # a window of whole words
                stop = at + WINDOW
                if stop < len(part):
                    cut = _SPACE.search(part, stop)
                    stop = cut.start() if cut else len(part)
                window = part[at:stop]
                at = stop
                words = self._words.findall(window)
                if len(window) <= 2 * WINDOW:
                    known = self._known.get
                    yield [known(w) or self._word_made(w) for w in words]
                else:
                    yield from ([m] for m in self._words_made(words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for made in self._parts(text) for ids, n, *_ in made if n for i in ids.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library where the file names no decoder: the tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids)

    def _whole_characters(self) -> dict[int, str]:
        """The text of each token that neither begins nor ends within a character."""
        out, suffix = {i: t for t, i in self.special.items()}, self.merges.suffix
        for i, t in self.token.items():
            body = t[: -len(suffix)] if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
            try:
                out.setdefault(i, bytes(self._back[c] for c in body).decode() + (" " if body != t else ""))
            except (KeyError, UnicodeDecodeError):
                pass
        return out

    def _fed(self, d: Decoder, i: int) -> str:
        """What a token completes: its bytes go through the decoder, a space follows an end of word."""
        t, suffix = self.token[i], self.merges.suffix
        if t in self.special:
            return d.finish() + t
        if suffix and t.endswith(suffix) and len(t) > len(suffix):
            return d.feed(bytes([self._back[c] for c in t[: -len(suffix)]])) + d.finish() + " "
        return d.feed(bytes([self._back[c] for c in t]))

    def text(self, ids: Iterable[int]) -> str:
        """The words themselves: an incremental byte-to-text decoder, a space after each end of word. Tokens of whole characters need no decoder among their like."""
        ids = list(ids)
        try:
            return "".join([self._plain[i] for i in ids])
        except KeyError:
            d = Decoder()
            return "".join([self._fed(d, i) for i in ids]) + d.finish()

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, digests of the ids joined by spaces, of the decoded text, and of the words that the byte-to-text decoder gives back."""
        n, digests = 0, [hashlib.sha256() for _ in range(3)]
        for made in self._parts(text):
            if not made:
                continue
            ids, sizes, decoded, words = zip(*made, strict=True)
            size = sum(sizes)
            if 0 in sizes:
                ids, decoded = ([x for x, k in zip(part, sizes, strict=True) if k] for part in (ids, decoded))
            for part, d, gap in ((ids, digests[0], " "), (decoded, digests[1], " "), (words, digests[2], "")):
                whole = gap.join(part)
                d.update((gap + whole if n and size else whole).encode())
            n += size
        return n, *(d.hexdigest() for d in digests)


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points that Python's Unicode tables do not know."""
    runs: list[list[int]] = []
    for c in range(128, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


def round_trip(docs: DataFrame, tokenizer_path: str, *keep: Column) -> DataFrame:
    """Columns `keep` (doc_id if none), n_tokens, ids_sha256, decoded_sha256, text_sha256. The file is read on the driver and broadcast (its size is that of the vocabulary)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    bounded_batches(docs.sparkSession, "4m")
    keep = keep or (F.col("doc_id"),)
    rows = docs.select(F.col("text").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(key, lambda: WordBpe(shared.value))
        for b in batches:
            got = [t.digest(x.as_py() or "") for x in b.column(0)]  # one text at a time
            yield pa.record_batch([*b.columns[1:], pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2, 3))], names=[*b.schema.names[1:], "n_tokens", *digests])
        trimmed()

    digests = ("ids_sha256", "decoded_sha256", "text_sha256")
    schema = StructType([*rows.schema.fields[1:]]).add("n_tokens", "long")
    for name in digests:
        schema = schema.add(name, "string")
    return rows.mapInArrow(run, schema)
