"""SentencePiece BPE encoding and decoding by suffix-array matching.

The text of a batch, each distinct word of it once, is concatenated and indexed
by a suffix array that is sorted to the depth of the longest piece. Every piece is binary-searched for
its range of occurrences; the occurrences become edges, sorted by the position
at which they end, and are relaxed in that order, all words at once.

In byte-pair encoding exactly one path is right: the one on which every two
neighbouring pieces stay apart when they are encoded together. So an edge
relaxes its end if it agrees with the piece before it (``Vocabulary.agree``).
A run of blanks merges last of all and is encoded by itself.

Defined results
---------------
* null or empty text: no ids; decoding gives the empty string;
* characters that no piece has: one byte piece for each UTF-8 byte;
* U+2581 in a text is a blank, as the format has it;
* texts of any length; each row is encoded by itself, so repeated rows give
  equal ids; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import read_table, text_batches
from .text_blocks import Words, bounded, give_back, same_bytes, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_PACK = 4  # characters to a key
_CHAR_BITS = 15


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a BPE model with byte fallback, in order of their making: characters first, then merges by score.

    Internal numbers follow that order; ``ids`` leads from them to the model's ids.
    """

    def __init__(self, model: bytes) -> None:
        pieces, self.byte_id, self.byte_of, self.text_of = [], np.zeros(256, np.int32), {}, {}
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part[1].decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, 1)))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1):
                    raise ValueError("only identity normalisation with a dummy prefix and all blanks kept is supported")
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are supported")
        self.size, self.digest = len(pieces), hashlib.sha256(model).digest()
        normal = []
        for number, (text, score, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_id[int(text[3:5], 16)] = number
                self.byte_of[number] = int(text[3:5], 16)
            elif kind == 1:
                normal.append((text, score, number))
                self.text_of[number] = text
        runs = {t: (s, n) for t, s, n in normal if BLANK * 2 in t}
        if any(t.strip(BLANK) for t in runs) or any(BLANK in t[1:] for t, _, _ in normal if t not in runs):
            raise ValueError("a piece has a blank after its first character")
        self.runs = runs
        chars = sorted((n, t) for t, _, n in normal if len(t) == 1)
        merges = sorted((-s, n, t) for t, s, n in normal if len(t) > 1 and t not in runs)
        self.texts = [t for _, t in chars] + [""] + [t for _, _, t in merges]
        self.unknown = len(chars)
        self.ids = np.array([n for n, _ in chars] + [-1] + [n for _, n, _ in merges], np.int32)
        self.length = np.array([max(len(t), 1) for t in self.texts], np.int32)
        number = {t: i for i, t in enumerate(self.texts) if t}
        self.blank = number.get(BLANK, self.unknown)
        self.left, self.right = np.arange(len(self.texts)), np.arange(len(self.texts))
        reached = np.ones(len(self.texts), bool)
        keys = []
        for i in range(self.unknown + 1, len(self.texts)):
            parts = self._halves(self.texts[i], number)
            if parts is None:
                reached[i] = False
            else:
                self.left[i], self.right[i] = parts
                keys.append((parts[0] * len(self.texts) + parts[1], i))
        keys.sort()
        self.pair_key, self.pair_made = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        self.alphabet = np.array(sorted({ord(c) for t in self.texts for c in t}), np.uint32)
        if len(self.alphabet) >= 1 << _CHAR_BITS:
            raise ValueError("too many characters")
        self.pieces = np.flatnonzero(reached & (np.arange(len(self.texts)) != self.unknown))
        self.deepest = int(self.length.max())
        rows = np.zeros((len(self.pieces), -(-self.deepest // _PACK) * _PACK), np.int64)
        for row, i in zip(rows, self.pieces, strict=True):
            codes = np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32)
            row[: len(codes)] = np.searchsorted(self.alphabet, codes) + 1
        self.low = _packed(rows)
        full = rows.copy()
        full[np.arange(rows.shape[1]) >= self.length[self.pieces][:, None]] = (1 << _CHAR_BITS) - 1
        self.high = _packed(full)

    @staticmethod
    def _halves(text: str, number: dict[str, int]) -> tuple[int, int] | None:
        """The last two parts that merge into ``text``; None if its encoding is another one."""
        parts = list(text)
        while len(parts) > 2:
            made = [number.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            best = min(made)
            if best == 1 << 30:
                return None
            at = made.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2 or parts[0] not in number or parts[1] not in number:
            return None
        return number[parts[0]], number[parts[1]]

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when their texts are encoded as one.

        Undoes the merges inside both from the latest on; apart if at no moment
        the two parts at the seam make a piece that would have come earlier.
        """
        out, rows = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 40, np.int64)
        while len(rows):
            key = a * len(self.texts) + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            joined = (self.pair_key[at] == key) & (self.pair_made[at] < limit)
            out[rows[joined]] = False
            a_ends, b_ends = self.right[a] == a, self.left[b] == b
            undo_a = ~a_ends & ((a > b) | b_ends)
            limit = np.where(undo_a, a, b + 1)
            go = ~joined & ~(a_ends & b_ends)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
        return out

    def run(self, blanks: int) -> list[int]:
        """Ids of a run of blanks: the best score first, then the leftmost."""
        one = int(self.ids[self.blank])
        size, after = [1] * blanks, list(range(1, blanks + 1))
        before = list(range(-1, blanks - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < blanks and (made := self.runs.get(BLANK * (size[i] + size[j]))) and size[i] + size[j] <= self.deepest * 8:
                heapq.heappush(queue, (-made[0], i, size[i], size[j]))

        for i in range(blanks - 1):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if size[i] != left or j >= blanks or size[j] != right:
                continue
            size[i] += right
            size[j] = 0
            after[i] = after[j]
            if after[i] < blanks:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.runs[BLANK * n][1] if n > 1 else one for n in size if n]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Columns of ``_PACK`` character codes as one integer each."""
    out = np.zeros((codes.shape[0], codes.shape[1] // _PACK), np.int64)
    for k in range(_PACK):
        out = (out << _CHAR_BITS) | codes[:, k::_PACK]
    return out


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted by their first ``depth`` codes, and each suffix's keys of ``_PACK`` codes in text order."""
    n, width = len(codes), -(-depth // _PACK)
    padded = np.zeros(n + width * _PACK, np.int64)
    padded[:n] = codes
    key = np.zeros(n + (width - 1) * _PACK, np.int64)
    for k in range(_PACK):
        key = (key << _CHAR_BITS) | padded[k : k + len(key)]
    keys = [key[k * _PACK : k * _PACK + n] for k in range(width)]
    rank = _ranks(keys[0])
    step = _PACK
    while step < depth:  # doubling
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if n > step else 0
        rank = _ranks(rank * (n + 2) + after)
        step *= 2
    return np.argsort(rank), keys


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.zeros(len(keys), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _bisect(keys: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every target in its own sorted range of ``keys``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        value = keys[np.minimum(mid, len(keys) - 1)]
        up = open_ & ((value <= target) if right else (value < target))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def occurrences(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every piece in the text."""
    order, keys = suffix_array(codes, vocabulary.deepest)
    n = len(codes)
    low, high = np.zeros(len(vocabulary.pieces), np.int64), np.full(len(vocabulary.pieces), n, np.int64)
    for k, key in enumerate(keys):
        sorted_ = key[order]
        live = np.flatnonzero((low < high) & (vocabulary.length[vocabulary.pieces] > k * _PACK))
        a = _bisect(sorted_, vocabulary.low[live, k], low[live], high[live], False)
        b = _bisect(sorted_, vocabulary.high[live, k], a, high[live], True)
        low[live], high[live] = a, b
    count = np.maximum(high - low, 0)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first - low, count)
    return order[at].astype(np.int32), np.repeat(vocabulary.pieces.astype(np.int32), count)


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word with a blank before it, flat, and the len(words) + 1 offsets."""
    text = np.frombuffer((BLANK + BLANK.join(words)).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = (ends - sizes).astype(np.int32)
    place = np.minimum(np.searchsorted(vocabulary.alphabet, text), len(vocabulary.alphabet) - 1)
    known = vocabulary.alphabet[place] == text
    codes = np.where(known, place + 1, 0)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    start, piece = occurrences(vocabulary, codes)
    lone = np.ones(len(text), bool)
    lone[start[vocabulary.length[piece] == 1]] = False
    lone = np.flatnonzero(lone).astype(np.int32)
    start, piece = np.concatenate([start, lone]), np.concatenate([piece, np.full(len(lone), vocabulary.unknown, np.int32)])
    stop = start + vocabulary.length[piece]
    ok = stop <= ends[word[start]]
    start, stop, piece = start[ok], stop[ok], piece[ok]
    # no merge crosses a place that no piece spans: what is between two such places is encoded by itself
    wide = stop - start > 1
    n = len(text)
    spanned = np.cumsum(np.bincount(start[wide] + 1, minlength=n + 1) - np.bincount(stop[wide], minlength=n + 1))[:n] > 0
    spanned[starts] = False
    opens = np.flatnonzero(~spanned).astype(np.int32)
    segment = np.cumsum(~spanned) - 1
    reach = stop - opens[segment[start]]
    order = np.argsort(reach.astype(np.uint16) if len(reach) and reach.max() < 1 << 16 else reach, kind="stable")  # 16 bits: by radix
    start, stop, piece, reach = start[order], stop[order], piece[order], reach[order]
    begins = ~spanned[start]
    cuts = np.flatnonzero(np.diff(reach, prepend=-1, append=-1))
    last = np.full(n, -1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        before = np.where(begins[a:b], -2, last[start[a:b] - 1])
        fits = before == -2
        ask = np.flatnonzero(before >= 0)
        fits[ask] = vocabulary.agree(before[ask], piece[a:b][ask])
        last[stop[a:b][fits] - 1] = piece[a:b][fits]
    made = np.full(n, -1, np.int64)
    at = np.append(opens[1:], n).astype(np.int64)
    open_ = np.arange(len(opens))
    while len(open_):
        piece_ = last[at[open_] - 1]
        at[open_] -= vocabulary.length[piece_]
        made[at[open_]] = piece_
        open_ = open_[at[open_] > opens[open_]]
    where = np.flatnonzero(made >= 0)
    ids = vocabulary.ids[made[where]]
    count = np.ones(len(where), np.int64)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelled = [vocabulary.byte_id[list(chr(c).encode())] for c in text[where[odd]].tolist()]
        count[odd] = [len(x) for x in spelled]
        flat = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for i, x in zip(first[odd].tolist(), spelled, strict=True):
            flat[i : i + len(x)] = x
    else:
        flat = ids
    per_word = np.bincount(word[where], count, len(words)).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(per_word)])


class Encoder:
    """Encodes batches; remembers up to ``most_words`` encoded words between them."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 1 << 19) -> None:
        self.vocabulary, self.most = vocabulary, most_words
        self._runs: dict[int, np.ndarray] = {0: np.zeros(0, np.int32)}
        self._forget()

    def _forget(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.leads = np.zeros(0, bool)
        self.raw, self.begin, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: Words, raw: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Encode these words and put them in the pool; returns their places."""
        data = [raw[a:b].tobytes() for a, b in zip(words.start[which].tolist(), words.stop[which].tolist(), strict=True)]
        flat, offsets = encode_words(self.vocabulary, [x.decode("utf-8", "replace") for x in data])
        leads = flat[offsets[:-1]] == self.vocabulary.ids[self.vocabulary.blank]
        base, size = len(self.first), np.array([len(x) for x in data], np.int64)
        self.first, self.count = np.concatenate([self.first, len(self.pool) + offsets[:-1] + leads]), np.concatenate([self.count, np.diff(offsets) - leads])
        self.begin, self.size = np.concatenate([self.begin, len(self.raw) + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.raw, self.pool, self.leads = np.concatenate([self.raw, np.frombuffer(b"".join(data), np.uint8)]), np.concatenate([self.pool, flat]), np.concatenate([self.leads, leads])
        return base + np.arange(len(which))

    def _learn(self, words: Words, raw: np.ndarray) -> np.ndarray:
        """Where each word is in the pool. Found by hash, compared by bytes: a word that only shares another's hash gets a place of its own."""
        distinct, first_seen, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.first) + len(distinct) > self.most or len(self.raw) > 64 * self.most:
            self._forget()
        at = np.searchsorted(self.hash, distinct)
        known = (at < len(self.hash)) & (self.hash[np.minimum(at, len(self.hash) - 1)] == distinct) if len(self.hash) else np.zeros(len(distinct), bool)
        if not known.all():
            hashes = np.concatenate([self.hash, distinct[~known]])
            places = np.concatenate([self.place, self._add(words, raw, first_seen[~known])])
            order = np.argsort(hashes, kind="stable")
            self.hash, self.place = hashes[order], places[order]
        place = self.place[np.searchsorted(self.hash, distinct)][inverse]
        size = words.stop - words.start
        same = self.size[place] == size
        some = np.flatnonzero(same)
        same[some] = same_bytes(raw, words.start[some], self.raw, self.begin[place[some]], size[some])
        if not same.all():
            place[~same] = self._add(words, raw, np.flatnonzero(~same))
        return place

    def _run(self, blanks: int) -> np.ndarray:
        if blanks not in self._runs:
            if len(self._runs) > 4096:
                self._runs = {0: self._runs[0]}
            self._runs[blanks] = np.array(self.vocabulary.run(blanks), np.int32)
        return self._runs[blanks]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the len(column) + 1 offsets."""
        column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), BLANK, " ")
        full = pc.not_equal(column, "")
        column = pc.if_else(full, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())), column)
        raw, offsets = text_bytes(column)
        words = Words(raw, offsets, raw == 32)
        n_docs, n = len(offsets) - 1, len(words.start)
        place = self._learn(words, raw) if n else np.zeros(0, np.int64)
        # items: a run of blanks before each word, the word; and the run that ends each document
        before = words.start - np.where(np.arange(n) == words.bounds[:-1][words.doc], offsets[:-1][words.doc], np.concatenate([[0], words.stop[:-1]]) if n else 0)
        lead = self.leads[place] if n else np.zeros(0, bool)
        tail_from = offsets[:-1].copy()
        some = np.diff(words.bounds) > 0
        tail_from[some] = words.stop[words.bounds[1:][some] - 1]
        blanks = np.concatenate([before - 1 + lead, offsets[1:] - tail_from])
        lengths, which = np.unique(blanks, return_inverse=True)
        spelled = [self._run(int(b)) for b in lengths]
        run_count = np.array([len(x) for x in spelled], np.int64)
        pool = np.concatenate([self.pool, *spelled]) if spelled else self.pool
        run_first = len(self.pool) + np.cumsum(run_count) - run_count
        items = 2 * n + n_docs
        first, count = np.zeros(items, np.int64), np.zeros(items, np.int64)
        slot = 2 * np.arange(n) + words.doc
        tail = 2 * words.bounds[1:] + np.arange(n_docs)
        for at, w in ((slot, which[:n]), (tail, which[n:])):
            first[at], count[at] = run_first[w], run_count[w]
        first[slot + 1], count[slot + 1] = self.first[place], self.count[place]
        ends = np.cumsum(count)
        source = np.arange(int(ends[-1]) if items else 0) + np.repeat(first - (ends - count), count)
        item_ends = np.concatenate([[0], ends])
        doc_bounds = item_ends[np.concatenate([[0], tail + 1])]
        return pool[source], doc_bounds


_KEPT: dict[bytes, Encoder] = {}


def kept_encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process, so its words outlive a task; bounded like any other."""
    if vocabulary.digest not in _KEPT:
        _KEPT.clear()
        _KEPT[vocabulary.digest] = Encoder(vocabulary)
    return _KEPT[vocabulary.digest]


class Decoder:
    """Ids back to text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        spelled = [b""] * vocabulary.size
        for i, t in vocabulary.text_of.items():
            spelled[i] = t.replace(BLANK, " ").encode()
        for i, b in vocabulary.byte_of.items():
            spelled[i] = bytes([b])
        self.count = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        count = self.count[ids]
        ends = np.concatenate([[0], np.cumsum(count)])
        source = np.arange(int(ends[-1])) + np.repeat(self.first[ids] - ends[:-1], count)
        raw, cuts = self.pool[source].tobytes(), ends[offsets].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def read_model(spark: SparkSession, path: str) -> Vocabulary:
    """Read on the driver; the vocabulary is bounded by its model file."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def with_ids(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with ``ids`` put last (an input column of that name is replaced)."""
    names = [c for c in docs.columns if c not in (text, "ids")]
    shared = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(shared.value)
        for batch in bounded(batches, text, 3 << 19):
            ids, offsets = encoder.encode(batch.column(text))
            give_back()
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "ids"])

    schema = docs.select(*names).schema.add("ids", ArrayType(IntegerType()))
    return text_batches(docs.select(*names, text)).mapInArrow(run, schema)


def with_text(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` but ``ids``, with the decoded ``text`` put last."""
    names = [c for c in encoded.columns if c not in ("ids", "text")]
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(encoded.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column("ids").fill_null([])
            offsets = column.offsets.to_numpy()
            texts = decoder.decode(column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts)], names=[*names, "text"])

    schema = encoded.select(*names).schema.add("text", "string")
    return encoded.select(*names, "ids").mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as count and digest, and the digest of the text that they decode to."""
    docs = read_table(spark, sf_dir, "documents")
    shared = spark.sparkContext.broadcast(read_model(spark, MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = kept_encoder(shared.value), Decoder(shared.value)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in bounded(batches, "text", 3 << 19):
            ids, offsets = encoder.encode(batch.column("text"))
            give_back()
            texts = decoder.decode(ids, offsets)
            cuts = offsets.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([digest(ids[a:b].astype("<i4").tobytes()) for a, b in zip(cuts, cuts[1:])]),
                    pa.array([digest(t.encode()) for t in texts]),
                ],
                names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256"],
            )

    return text_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        run, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string"
    )


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left; null and empty texts have none, repeated rows have theirs each, no rows give no rows."""
    return with_ids(docs.select("doc_id", "text")).withColumn("n_ids", F.size("ids").cast("long"))
