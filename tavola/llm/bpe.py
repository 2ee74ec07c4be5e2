"""Byte-level BPE encoding and decoding (operator 3).

``encode``, ``decode`` and ``round_trip`` (both at once) are columns.  Method for one word: the contiguous
rank array.  The list of parts and the list of the ranks of adjacent parts lie
side by side; the smallest rank is looked up, the boundary there is deleted,
and the two ranks beside it are refreshed, until no pair has a rank.  Words of
over ``SHORT`` bytes use the same rule with a heap, so that a text without
spaces stays near-linear.

Texts are split into words and hashed a batch at a time; each distinct word of
a worker is merged once while it is in the bounded memory of words.

Defined results: a null or empty text has no ids; ids that stand for no UTF-8
text decode with U+FFFD, as the tokenizers library does; the strings of added
tokens in a text become their ids.  Repeated rows are encoded alike, and other
columns are never touched.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tavola.llm.textscan import span_hashes
from tavola.llm.workers import lean

SHORT = 256            # bytes; longer words are merged with a heap
MEMORY = 900_000       # distinct words remembered by a worker
SLOTS = 21             # bits of the table that finds them
CHUNK = 1 << 20        # bytes scanned at once

# Fixed value: the word pattern of byte-level BPE.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Classes of bytes for the vectorised splitter; UNSURE bytes send the text to PATTERN.
LETTER, DIGIT, OTHER, BLANK, UNSURE = range(5)


def _byte_classes() -> np.ndarray:
    out = np.full(256, UNSURE, dtype=np.uint8)
    out[0x21:0x7F] = OTHER
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
    out[0x80:0xC0] = LETTER          # second bytes of the letters below
    out[0xC3:0xC9] = LETTER          # U+00C0 to U+023F, but for the two signs below
    out[0x27] = UNSURE               # contractions
    return out


CLASSES = _byte_classes()


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file; one per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.added.items():
            table[i] = token.encode()
        self.token_length = np.fromiter(map(len, table), dtype=np.int64, count=size)
        self.token_offset = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        byte_of = {b: t for t, b in letters.items()}
        self.byte_id = [vocab[byte_of[b]] for b in range(256)]
        self.size, self.rank, self.merged = size, {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] * size + vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.none = len(self.merged)
        self.pair_keys = np.fromiter(self.rank, dtype=np.int64, count=self.none)
        order = np.argsort(self.pair_keys)
        self.pair_keys, self.pair_ranks = self.pair_keys[order], order
        self.merged_ids, self.byte_ids = np.array(self.merged), np.array(self.byte_id)
        import regex
        self.words = regex.compile(PATTERN).findall
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.keys = np.zeros(1 << SLOTS, dtype=np.uint64)
        self.values = np.zeros(1 << SLOTS, dtype=np.int32)
        self.flat = np.empty(1 << 16, dtype=self.dtype)
        self.used = 0
        self.offsets = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int64)
        self.by_text: dict[str, bytes] = {}

    # one word -------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if len(word) > SHORT:
            return self._merge_long(word)
        size, get, none = self.size, self.rank.get, self.none
        parts = [self.byte_id[b] for b in word]
        ranks = [get(a * size + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] * size + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] * size + parts[i + 1], none)
        return parts

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0),
                        self.pair_ranks[at], self.none)

    def _merge_many(self, buf, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words and how many each has: ``merge`` with one row of
        parts and one row of ranks a word, all rows stepping together."""
        lengths = ends - starts
        result: list[np.ndarray | None] = [None] * len(starts)
        done_rows, done_parts = [], []
        low = 0
        for width in (4, 8, 12, 16, 24, 32):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows) == 0:
                continue
            column = np.arange(width)
            inside = column < lengths[rows, None]
            parts = np.where(inside, self.byte_ids[buf[np.minimum(starts[rows, None] + column,
                                                                  len(buf) - 1)]], -1)
            ranks = self._pair_ranks(parts[:, :-1], parts[:, 1:])
            while len(rows):
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
                best = (ranks[np.arange(len(rows)), at] if ranks.shape[1]
                        else np.full(len(rows), self.none))
                stop = best == self.none
                if stop.any():
                    done_rows.append(rows[stop])
                    done_parts.append(parts[stop])
                    go = ~stop
                    rows, parts, ranks, at, best = rows[go], parts[go], ranks[go], at[go], best[go]
                    if not len(rows):
                        break
                each = np.arange(len(rows))
                parts[each, at] = self.merged_ids[best]
                column = np.arange(parts.shape[1] - 1)
                parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
                column = np.arange(ranks.shape[1] - 1)
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
                k = np.flatnonzero(at > 0)
                ranks[k, at[k] - 1] = self._pair_ranks(parts[k, at[k] - 1], parts[k, at[k]])
                k = np.flatnonzero(at < ranks.shape[1])
                ranks[k, at[k]] = self._pair_ranks(parts[k, at[k]], parts[k, at[k] + 1])
        counts = np.zeros(len(starts), dtype=np.int64)
        long = np.flatnonzero(lengths > low)
        for w in long.tolist():
            result[w] = np.array(self.merge(buf[starts[w]:ends[w]].tobytes()))
            counts[w] = len(result[w])
        for rows, parts in zip(done_rows, done_parts):
            counts[rows] = (parts >= 0).sum(axis=1)
        begin = np.cumsum(counts) - counts
        ids = np.empty(counts.sum(), dtype=self.dtype)
        for rows, parts in zip(done_rows, done_parts):
            there = parts >= 0
            ids[(begin[rows, None] + np.arange(parts.shape[1]))[there]] = parts[there]
        for w in long.tolist():
            ids[begin[w]:begin[w] + counts[w]] = result[w]
        return ids, counts

    def _merge_long(self, word: bytes) -> list[int]:
        size, get, none = self.size, self.rank.get, self.none
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1)
                if (r := get(parts[i] * size + parts[i + 1], none)) != none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] * size + parts[j], none) != r:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] * size + parts[b], none)) != none:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    # many texts -----------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list[np.ndarray] = [np.empty(0, dtype=self.dtype)] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(t in text for t in self.added):
                out[i] = self._encode_slowly(text)
                continue
            group.append((i, raw := text.encode()))
            size += len(raw)
            if size >= CHUNK:
                self._encode_group(group, texts, out)
                group, size = [], 0
        if group:
            self._encode_group(group, texts, out)
        return out

    def _encode_group(self, group, texts, out) -> None:
        lengths = np.array([len(raw) for _, raw in group])
        ends = np.cumsum(lengths)
        buf = np.frombuffer(b"".join(raw for _, raw in group), dtype=np.uint8)
        classes = CLASSES[buf]
        unsure = classes == UNSURE
        unsure[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        odd = np.logical_or.reduceat(unsure, ends - lengths)
        plain = []
        for k, (i, raw) in enumerate(group):
            if odd[k]:
                out[i] = self._encode_slowly(texts[i])
            elif lengths[k] > 2 * CHUNK:
                out[i] = np.concatenate([self._scan([piece])[0] for piece in self._pieces(raw)])
            else:
                plain.append((i, raw))
        if plain:
            for (i, _), ids in zip(plain, self._scan([raw for _, raw in plain])):
                out[i] = ids

    @staticmethod
    def _pieces(raw: bytes):
        """Cut a very long text where a blank follows a letter: no word goes across."""
        cut = re.compile(rb"[A-Za-z0-9.,](?=\s)")
        begin = 0
        while begin < len(raw):
            m = cut.search(raw, begin + CHUNK)
            end = m.end() if m else len(raw)
            yield raw[begin:end]
            begin = end

    def _scan(self, raws: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"".join(raws), dtype=np.uint8)
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        begins = np.cumsum(lengths) - lengths
        classes = CLASSES[buf]
        first = np.zeros(len(buf), dtype=bool)
        first[begins] = True
        start = first.copy()
        start[1:] |= classes[1:] != classes[:-1]
        # the last blank of a run stands alone, or leads the next word if it is a space
        last = np.flatnonzero((classes[:-1] == BLANK) & (classes[1:] != BLANK) & ~first[1:])
        start[last] = True
        start[last[buf[last] == 0x20] + 1] = False
        starts = np.flatnonzero(start)
        hashes = span_hashes(buf, starts)
        if self.known > MEMORY:
            self._forget()
        words = self._find(hashes)
        missing = np.flatnonzero(words < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            ends = np.append(starts[1:], len(buf))
            self._learn(new, *self._merge_many(buf, starts[at], ends[at]))
            words[missing] = self._find(hashes[missing])
        count = self.lengths[words]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(self.offsets[words] - (upto - count), count) + np.arange(upto[-1])]
        cuts = (upto - count)[np.searchsorted(starts, begins)]
        return np.split(ids, cuts[1:])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 where it is new."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(left):
            found = self.keys[slot]
            hit = found == hashes[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << SLOTS) - 1)
        return out

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember new words: their ids lie in ``flat`` one after the other."""
        k, n = self.known, len(hashes)
        while k + n > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, self.offsets])
            self.lengths = np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[k:k + n] = counts
        self.offsets[k:k + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known += n
        left, value = hashes, np.arange(k, k + n, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(left):            # of words that want one free slot, one gets it
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = left[won], value[won]
            stay = np.ones(len(left), dtype=bool)
            stay[won] = False
            left, value, slot = left[stay], value[stay], (slot[stay] + 1) & ((1 << SLOTS) - 1)

    def _encode_slowly(self, text: str) -> np.ndarray:
        """By the pattern itself, for texts with letters, blanks or signs of any script."""
        if len(self.by_text) > MEMORY:
            self.by_text = {}
        out = []
        for part in (self.split_added(text) if self.split_added else [text]):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype=self.dtype).tobytes())
                continue
            for word in self.words(part):
                ids = self.by_text.get(word)
                if ids is None:
                    ids = np.array(self.merge(word.encode()), dtype=self.dtype).tobytes()
                    self.by_text[word] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids."""
        if len(ids) == 0:
            return b""
        length = self.token_length[ids]
        upto = np.cumsum(length)
        raw = self.token_bytes[np.repeat(self.token_offset[ids] - (upto - length), length)
                               + np.arange(upto[-1])].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(text: Column, tokenizer: str) -> Column:
    """Ids of a text column as little-endian unsigned 32-bit integers (binary)."""
    def run(texts: pa.Array) -> pa.Array:
        bpe = load(tokenizer)
        return pa.array([ids.astype("<u4").tobytes() for ids in bpe.encode_batch(texts.to_pylist())],
                        type=pa.binary())

    return F.arrow_udf(lean(run), "binary").asNondeterministic()(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """Text of an id column as ``encode`` returns it; special tokens are kept."""
    def run(rows: pa.Array) -> pa.Array:
        bpe = load(tokenizer)
        return pa.array([bpe.decode(np.frombuffer(r or b"", dtype="<u4")).decode()
                         for r in rows.to_pylist()], type=pa.string())

    return F.arrow_udf(lean(run), "string").asNondeterministic()(ids)


def round_trip(text: Column, tokenizer: str) -> Column:
    """Struct (ids binary, decoded string): ``encode`` and then ``decode``, both in
    one Python worker, so that a task holds the vocabulary once."""
    def run(texts: pa.Array) -> pa.Array:
        bpe = load(tokenizer)
        ids = bpe.encode_batch(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([i.astype("<u4").tobytes() for i in ids], type=pa.binary()),
             pa.array([bpe.decode(i).decode() for i in ids], type=pa.string())], ["ids", "decoded"])

    return F.arrow_udf(lean(run), "ids binary, decoded string").asNondeterministic()(text)
