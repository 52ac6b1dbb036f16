"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding. The library's normaliser gives a text's symbols, one per code point. Every two
neighbours whose concatenation is a piece of the vocabulary are on an agenda, ordered by
the piece's score, then from left to right. The best pair is merged, what the merge makes
stale leaves the agenda, its new neighbours enter it, until it is empty. What is no piece
then becomes its UTF-8 byte pieces, or the unknown id in a vocabulary without them.

A merge needs a piece that holds the two code points next to each other. Where no piece of
the vocabulary holds another code point before a word mark, a text falls apart into chunks
before each run of word marks that do not see each other: they are encoded one by one, the
result the same as for the whole text. Without such a vocabulary the text is one chunk.
Equal chunks share one result, in a cache of about ``CACHE`` chunks a worker. The agendas of
all new chunks of up to ``LONGEST`` code points are kept in arrays, a column a chunk, and worked
off together, one merge of each chunk a round, some ``BLOCK`` chunks of like length at a time;
a longer chunk has a heap of its own.

Decoding joins the pieces, word marks as spaces, without the one that the normaliser put in
front; runs of byte pieces are decoded together, a byte that is no UTF-8 as U+FFFD.

Both are checked against the library within each Arrow batch: the new chunks' ids against
its own, and with ``check="texts"`` whole texts' (which takes as long as all the rest).
Decoded texts are the library's, with ``check="texts"`` compared with the pieces'. A
difference is an error, never a result. Ids and decoded text come from one call a batch.

The model file is read on the driver and sent once (its size does not depend on the data).
Null and empty texts have no ids but the asked-for begin and end; null ids decode to an
empty text. Repeated rows get equal results; a text of any length is encoded whole, in
parts of about ``PART`` code points cut between chunks.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewater.llm.common import setup

MARK = "▁"         # the word mark
CACHE = 1_000_000  # chunks of a worker's cache, about
LONGEST = 64       # code points of a chunk whose agenda is in the arrays
BLOCK = 1 << 13    # chunks whose agendas are in the arrays at a time
PART = 1 << 20     # code points worked on at a time
_NEVER = 1 << 23   # above every rank
_MIX = np.uint64(0x9E3779B97F4A7C15)
BPE = 2            # of the model file's trainer settings, field 3: its model type
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model file: types of pieces
UNKNOWN_TEXT = " ⁇ "


class Mismatch(AssertionError):
    """The library's result differs."""


def _fields(message: bytes):
    """(field number, value) of a serialised message: an int, or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at:at + size]
            at += size


class Seen(dict):
    """The ids of the chunks seen; what is asked for and not there is noted in ``missing``."""

    def __init__(self):
        super().__init__()
        self.missing: set = set()

    def __missing__(self, key) -> None:
        self.missing.add(key)


class Encoder:
    """A vocabulary and the ids of the chunks seen, as bytes of int32."""

    def __init__(self, model: bytes):
        top = list(_fields(model))
        trainer = next((dict(_fields(v)) for f, v in top if f == 2), {})
        if trainer.get(3, 1) != BPE:
            raise ValueError("the vocabulary is not merge-type")
        types = [dict(_fields(v)).get(3, NORMAL) for f, v in top if f == 1]
        if not set(types) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the same model without the mark in front, for chunks: a second, merged normaliser message
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        self.texts = self.library.id_to_piece(list(range(len(types))))
        self.types = np.array(types, np.int8)
        self.prefix = self.library.normalize("a").startswith(MARK)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.texts, types)) if t == NORMAL}
        self.rank = dict(zip(self.ids, np.unique([-self.library.get_score(i) for i in self.ids.values()], return_inverse=True)[1].tolist()))
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.texts, types)) if t == BYTE}
        self.high = {i: b for b, i in self.bytes.items() if b > 127}
        self.surface = [p.replace(MARK, " ") if t == NORMAL else UNKNOWN_TEXT if t == UNKNOWN else "" for p, t in zip(self.texts, types)]
        for b, i in self.bytes.items():
            self.surface[i] = chr(b) if b < 128 else ""
        split = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if split else ".+", re.S)
        self.cut = re.compile(f"(?<=[^{MARK}]){MARK}") if split else None
        self.cache = Seen()  # ids of chunks, by key (see `_keys`)
        # symbols: a piece's id, or beyond them a code point that is no piece
        self.symbol = np.arange(0x110000, dtype=np.int64) + len(types)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = [(self._symbol(p[:k]), self._symbol(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p))]
        pairs = np.array([x for x in pairs if None not in x], np.int64).reshape(-1, 3)
        self.border = len(types) + 0x110000  # no symbol: in front of a chunk, behind it, and what a merge took
        ranks = np.zeros(len(types), np.int64)
        ranks[list(self.ids.values())] = list(self.rank.values())
        self._index(pairs[:, 0] * (self.border + 1) + pairs[:, 1], ranks[pairs[:, 2]], pairs[:, 2])

    def _symbol(self, part: str):
        return self.ids.get(part, int(self.symbol[ord(part)]) if len(part) == 1 else None)

    def spelled(self, symbol: str) -> list[int]:
        """The ids of a symbol that is no piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.library.unk_id()]

    def merged(self, chunk: str) -> list[int]:
        """A chunk's ids by an agenda of its adjacent pairs, a heap."""
        rank, parts, n = self.rank, list(chunk), len(chunk)
        agenda = [(rank[chunk[i:i + 2]], i, i + 1, 2) for i in range(n - 1) if chunk[i:i + 2] in rank]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, size = heappop(agenda)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue  # one of the two was merged since
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                whole = parts[a] + parts[b] if a >= 0 and b < n else ""
                if whole in rank:
                    heappush(agenda, (rank[whole], a, b, len(whole)))
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else self.spelled(p) for p in parts if p))

    def _index(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """The pairs by their keys in an open table, each in the first free place from its hash on."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(last + 1, -1, np.int64)
        self.order, self.made = np.full(last + 1, _NEVER, np.int32), np.zeros(last + 1, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one place the last stays
            stays = self.keys[at] == keys[left]
            self.order[at[stays]], self.made[at[stays]] = ranks[left[stays]], made[left[stays]]
            at, left = (at[~stays] + 1) & last, left[~stays]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).view(np.int64)

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; the rank is ``_NEVER`` where there is no piece."""
        key = left * np.int64(self.border + 1) + right
        at = self._place(key)
        there = self.keys[at]
        other = np.flatnonzero((there != key) & (there >= 0))
        rank, made = np.where(there < 0, _NEVER, self.order[at]).astype(np.int32), self.made[at]
        at = at[other]
        while len(other):  # another pair's place
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == key[other]
            rank[other], made[other] = np.where(hit, self.order[at], _NEVER), self.made[at]
            on = ~hit & (there >= 0)
            other, at = other[on], at[on]
        return rank, made

    def merged_all(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk: one agenda each, all in arrays, the best pair of each taken a round."""
        sizes = np.array([len(c) for c in chunks])
        by_size = np.argsort(sizes, kind="stable")
        out: list[bytes] = [b""] * len(chunks)
        for lo in range(0, len(chunks), BLOCK):
            some = by_size[lo:lo + BLOCK]
            while len(some):  # of about one length: the arrays are at most half empty
                n = np.searchsorted(sizes[some], 2 * sizes[some[0]], side="right")
                self._merge([chunks[i] for i in some[:n].tolist()], some[:n], out)
                some = some[n:]
        return out

    def _merge(self, chunks: list[str], places: np.ndarray, out: list[bytes]) -> None:
        """Writes the ids of ``chunks`` to ``places`` of ``out``.

        A chunk is a column, its code points in rows from 1 on, a symbol in the row of its first.
        ``best`` has a pair's rank and row in one number, in the row of its left symbol."""
        sizes = np.array([len(c) for c in chunks])
        longest, n = int(sizes.max()), len(chunks)
        bits = (longest + 1).bit_length()
        number = np.int32 if bits < 8 else np.int64
        never = _NEVER << bits
        flat = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = row * n + np.repeat(np.arange(n), sizes)
        sym = np.full((longest + 2) * n, self.border, np.int32)
        sym[at] = flat
        best, made = np.full(len(sym), never, number), np.zeros(len(sym), np.int32)
        rank, whole = self._agenda(flat, sym[at + n])
        best[at], made[at] = (rank.astype(number) << bits) + row, whole
        after = np.repeat(np.arange(1, longest + 3, dtype=np.int32), n)
        before = after - 2
        while n:
            top = best.reshape(-1, n).min(axis=0)
            going = top < never
            col = np.flatnonzero(going)
            if 4 * len(col) < 3 * n:  # many empty agendas: they leave the arrays
                self._spell(sym.reshape(-1, n)[:, ~going].T, places[~going], out)
                sym, best, made, after, before = (x.reshape(-1, n)[:, col].ravel() for x in (sym, best, made, after, before))
                top, places, n = top[col], places[col], len(col)
                col = np.arange(n)
                if not n:
                    break
            else:
                top = top[col]
            left = top & ((1 << bits) - 1)
            at = left * np.int64(n) + col
            right = after[at] * np.int64(n) + col
            behind = after[right]
            front = before[at]
            at_behind, at_front = behind * np.int64(n) + col, front * np.int64(n) + col
            new = made[at]
            sym[at], sym[right], best[right] = new, self.border, never
            after[at], before[at_behind] = behind, left
            rank, made[at] = self._agenda(new, sym[at_behind])
            best[at] = (rank.astype(number) << bits) + left
            rank, made[at_front] = self._agenda(sym[at_front], new)
            best[at_front] = (rank.astype(number) << bits) + front

    def _spell(self, rows: np.ndarray, places: np.ndarray, out: list[bytes]) -> None:
        """Writes the ids of rows of symbols to ``places`` of ``out``, code points that are no piece as their own ids."""
        real = rows != self.border
        ids, ends = rows[real], np.cumsum(real.sum(axis=1))
        odd = np.flatnonzero(ids >= len(self.types))
        if len(odd):
            known, which = np.unique(ids[odd], return_inverse=True)
            known = [self.spelled(chr(x - len(self.types))) for x in known.tolist()]
            size = np.array([len(x) for x in known])[which]
            width = np.ones(len(ids), np.int64)
            width[odd] = size
            stop = np.cumsum(width)
            ids = np.repeat(ids, width)
            begin = np.repeat(stop[odd] - size, size)
            ids[begin + np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size)] = np.fromiter(
                chain.from_iterable([known[k] for k in which.tolist()]), np.int32)
            ends = np.append(0, stop)[ends]
        raw, lo = ids.tobytes(), 0
        for i, hi in zip(places.tolist(), (4 * ends).tolist()):
            out[i] = raw[lo:hi]
            lo = hi

    def _learn(self, keys: set) -> None:
        """Encodes the chunks of ``keys``, which the cache does not hold, and checks them against the library."""
        if len(self.cache) + len(keys) > CACHE:
            self.cache.clear()
        keys = list(keys)
        chunks = [MARK + k if type(k) is str else k[0] for k in keys]
        short = [c for c in chunks if len(c) <= LONGEST]
        made = self.merged_all(short) if short else []
        if len(short) < len(chunks):
            found = iter(made)
            made = [next(found) if len(c) <= LONGEST else np.array(self.merged(c), np.int32).tobytes() for c in chunks]
        for at in range(0, len(chunks), 1 << 16):
            some, ours = chunks[at:at + (1 << 16)], made[at:at + (1 << 16)]
            theirs = self.inner.encode(some, num_threads=1)
            if self.bytes and [len(x) >> 2 for x in ours] == list(map(len, theirs)) \
                    and b"".join(ours) == np.fromiter(chain.from_iterable(theirs), np.int32).tobytes():
                continue  # every chunk has the library's ids
            for c, own, ids in zip(some, ours, theirs):
                if self._single(own).tolist() != ids:
                    raise Mismatch(f"the library has other ids for {c!r}")
        self.cache.update(zip(keys, made))

    def _keys(self, part: str) -> list:
        """The part's chunks as keys of the cache: what follows the mark in a chunk with one mark
        in front and more behind it, a tuple of any other chunk."""
        if self.cut and part.startswith(MARK) and MARK + MARK not in part and not part.endswith(MARK):
            return part.split(MARK)[1:]
        return [c[1:] if c[0] == MARK and c[1:] and c[1] != MARK else (c,) for c in self.chunk.findall(part)]

    def _single(self, raw: bytes) -> np.ndarray:
        """The ids, neighbouring unknowns as one."""
        ids = np.frombuffer(raw, np.int32)
        if self.bytes:
            return ids
        unknown = ids == self.library.unk_id()
        return ids[~(unknown & np.append(False, unknown[:-1]))] if len(ids) else ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list]] = []
        size = 0

        def flush():
            cache = self.cache
            found = [list(map(cache.__getitem__, keys)) for _, keys in waiting]
            missing, cache.missing = cache.missing, set()
            if missing:
                self._learn(missing)
            for (i, keys), raw in zip(waiting, found):
                if missing:
                    raw = [cache[k] if r is None else r for k, r in zip(keys, raw)]
                out[i].append(b"".join(raw))
            if size > 4 * PART:  # a text in one chunk: not to be kept
                self.cache.clear()
            waiting.clear()
        for i, text in enumerate(texts):
            text, at = self.library.normalize(text), 0
            while at < len(text):
                cut = self.cut.search(text, at + PART) if self.cut and len(text) - at > PART else None
                end = cut.start() if cut else len(text)
                waiting.append((i, self._keys(text[at:end])))
                size, at = size + end - at, end
                if size >= PART:
                    flush()
                    size = 0
        flush()
        return [self._single(b"".join(parts)) for parts in out]

    def decode(self, numbers: list[int]) -> str:
        if self.high.keys().isdisjoint(numbers):
            text = "".join(map(self.surface.__getitem__, numbers))
        else:
            parts, run = [], bytearray()
            for i in numbers:
                if i in self.high:
                    run.append(self.high[i])
                    continue
                parts += [_utf8(run), self.surface[i]]
                run.clear()
            text = "".join(parts) + _utf8(run)
        first = next((i for i in numbers if self.types[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.texts[first].startswith(MARK) else text


def _utf8(run: bytearray) -> str:
    """The run's text; every byte that is part of no code point is U+FFFD."""
    out, at, raw = [], 0, bytes(run)
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_ENCODERS: dict[str, Encoder] = {}  # of this process, by model


def encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def load(spark: SparkSession, path: str):
    """The model file, read here and sent to the executors once."""
    with open(path, "rb") as f:
        return setup(spark).sparkContext.broadcast(f.read())


def _edges(e: Encoder, begin: bool, end: bool) -> tuple[list[int], list[int]]:
    return [e.library.bos_id()] if begin else [], [e.library.eos_id()] if end else []


def _encoded(texts: list[str], model, begin: bool, end: bool, check: str) -> list[np.ndarray]:
    e = encoder(model.value)
    found = e.encode(texts)
    if check == "texts":
        for t, own, theirs in zip(texts, found, e.library.encode(texts, num_threads=1)):
            if own.tolist() != theirs:
                raise Mismatch(f"the library has other ids for a text of {len(t)} code points that begins {t[:80]!r}")
    first, last = _edges(e, begin, end)
    return [np.concatenate((first, x, last)).astype(np.int32) for x in found]


def _decoded(lists: list[np.ndarray], model, check: str) -> list[str]:
    e = encoder(model.value)
    theirs = e.library.decode(lists, num_threads=1) if lists else []
    if check == "texts":
        for x, text in zip(lists, theirs):
            if e.decode(x.tolist()) != text:
                raise Mismatch(f"the library has another text for {x[:20].tolist()}...")
    return theirs


def encode(text: Column, model, begin: bool = False, end: bool = False, check: str = "chunks") -> Column:
    """The ids of a text column as array<int>; ``model`` is from `load`, ``check`` is "chunks" or "texts"."""
    @pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoded(["" if t is None else t for t in texts], model, begin, end, check), dtype="object")
    return ids_of(text)


def decode(ids: Column, model, check: str = "chunks") -> Column:
    """The text of an array<int> column, by the library; with ``check="texts"`` by the pieces too."""
    @pandas_udf("string")
    def text_of(lists: pd.Series) -> pd.Series:
        none = np.zeros(0, np.int32)
        return pd.Series(_decoded([none if x is None else x for x in lists], model, check), dtype="object")
    return text_of(ids)


def round_trip(text: Column, model, begin: bool = False, end: bool = False, check: str = "chunks") -> Column:
    """`encode` and `decode` of its ids as struct<ids, decoded>: Spark would encode a second time for `decode`."""
    @pandas_udf("ids array<int>, decoded string")
    def both_of(texts: pd.Series) -> pd.DataFrame:
        found = _encoded(["" if t is None else t for t in texts], model, begin, end, check)
        return pd.DataFrame({"ids": pd.Series(found, dtype="object"),
                             "decoded": pd.Series(_decoded(found, model, check), dtype="object")})
    return both_of(text)


def tokenize(docs: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str | None = None,
             begin: bool = False, end: bool = False, check: str = "chunks") -> DataFrame:
    """``docs`` with the ids of every text, and with ``decoded`` the text those ids give;
    columns of these names are replaced."""
    model = load(docs.sparkSession, path)
    text = F.col(f"`{text_col}`")
    if decoded is None:
        return docs.withColumn(ids, encode(text, model, begin, end, check))
    both = round_trip(text, model, begin, end, check)
    return docs.withColumns({ids: both.ids, decoded: both.decoded})
