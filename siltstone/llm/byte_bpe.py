"""Byte-level BPE of many texts at once in numpy and Arrow, with the ids of the tokenizers library.

Texts are joined, each with an end mark (byte 0xFF, which UTF-8 never holds). A few passes over the bytes find where the
pre-tokenizer cuts; Arrow finds the distinct pieces; those of one length are merged side by side, a merge in each piece a round,
and the ids are gathered for all places where a piece stands. Nothing is remembered from call to call.

What this doesn't cover goes to the library: pieces of more than `_LONGEST` bytes, each distinct one once a call; whole texts that hold an
added token or a character whose class isn't the same in old and new Unicode, in parts of about `_PART` characters; and all texts of a
tokenizer of another kind."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from .common import as_bytes

_OTHER, _LETTER, _NUMBER, _EDGE, _UNKNOWN, _BLANK, _SPACE = range(7)
_BLANKS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters from here on go to the library.
_PAST = 0x20000
_LONGEST = 40
_ROWS = 1 << 14
_PLACE = 6  # bits of a place in a piece, below its rank
_NEVER = 1 << 30
_PART = 1 << 16
#: Where a text can be cut without a change of its ids: before a single space between two other characters.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    out = np.full(_PAST, _UNKNOWN, np.uint8)
    for i in range(_PAST):
        c = chr(i)
        now, was = new(c), old(c)
        kind = kinds.get(now[0], _OTHER)
        if now not in ("Cn", "Cs") and kind == kinds.get(was[0], _OTHER) and was != "Zs":
            out[i] = kind
    out[_BLANKS] = _BLANK
    out[0x20] = _SPACE
    return out


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while cut := _BETWEEN.search(text, at + _PART):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.covered = self._load(made)

    def _load(self, made: dict) -> bool:
        """Whether the tokenizer is of the kind that this module covers."""
        before, model = made.get("pre_tokenizer") or {}, made["model"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        if any(made.get(k) for k in ("normalizer", "truncation", "padding")) or (made.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel":
            return False
        vocabulary, letters = model["vocab"], _byte_characters()
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(x not in vocabulary for x in letters) or any(x not in vocabulary for a, b in merges for x in (a, b, a + b)):
            return False
        added = made.get("added_tokens") or []
        if len(merges) >= _NEVER >> _PLACE + 1 or any(x.get("lstrip") or x.get("rstrip") or not x["content"] or " " in x["content"] for x in added):
            return False
        self.added = [x["content"].encode() for x in added]
        self.of_byte = np.array([vocabulary[x] for x in letters], np.int32)
        self.pad = max(vocabulary.values()) + 1
        self.width = self.pad + 1
        self.merged = np.array([vocabulary[a + b] for a, b in merges] or [0], np.int32)
        ranks = {vocabulary[a] * self.width + vocabulary[b]: rank for rank, (a, b) in enumerate(merges)}
        keys, values = np.array([*ranks.keys()], np.int64), np.array([*ranks.values()], np.int64)
        # a table by hash that holds one pair a slot; the few others are searched
        self.slots = max(16, (8 * len(keys)).bit_length())
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys, self.ranks = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, _NEVER, np.int32)
        self.keys[slot[first]], self.ranks[slot[first]] = keys[first], values[first] << _PLACE
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_keys, self.rest_ranks = np.append(keys[rest], np.iinfo(np.int64).max), np.append(values[rest] << _PLACE, _NEVER).astype(np.int32)
        pairs = self.of_byte[:, None].astype(np.int64) * self.width + self.of_byte
        self.first_ranks = self._ranks(pairs.ravel())  # by two bytes
        self.classes = _classes()
        self.of_ascii = np.full(256, _OTHER, np.uint8)
        self.of_ascii[:128], self.of_ascii[0xFF] = self.classes[:128], _EDGE
        return True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, shifted past the bits of a place; `_NEVER` for those that aren't merged."""
        slot = self._slot(keys)
        there, out = self.keys[slot], self.ranks[slot]
        odd = np.flatnonzero(there != keys)
        out[odd] = _NEVER
        odd = odd[there[odd] >= 0]
        if len(odd):
            at = np.searchsorted(self.rest_keys, keys[odd])
            out[odd] = np.where(self.rest_keys[at] == keys[odd], self.rest_ranks[at], _NEVER)
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where pieces start, where characters of unknown class stand), as the pattern of the byte-level pre-tokenizer cuts:
        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
        kind = self.of_ascii[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xFF))
        if len(lead):
            first = data[lead].astype(np.int64)
            low = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = np.select([size == 2, size == 3], [(first & 0x1F) << 6 | low[0], (first & 0x0F) << 12 | low[0] << 6 | low[1]], (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2])
            found = np.where(point < _PAST, self.classes[np.minimum(point, _PAST - 1)], _UNKNOWN)
            for k in range(4):
                kind[lead[size > k] + k] = found[size > k]
            unknown = lead[found == _UNKNOWN]
        else:
            unknown = lead
        blank, solid = kind >= _BLANK, kind <= _NUMBER
        starts = np.empty(len(data), np.bool_)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts[1:] &= ~(blank[1:] & blank[:-1])
        starts |= kind == _EDGE
        # of blanks before a solid character the last stands apart; a space goes with what follows
        led = (kind[:-1] == _SPACE) & solid[1:]
        starts[1:] &= ~led
        starts[:-1] |= led
        last = np.flatnonzero((kind[:-1] == _BLANK) & solid[1:])
        for _ in range(2):
            last -= (data[last] & 0xC0) == 0x80
        starts[last] = True
        quote = np.flatnonzero((data == 0x27) & starts)
        if len(quote):
            a, b = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
            starts[quote[one | two] + 1] = False
            starts[quote[one] + 2] = True
            starts[quote[two] + 3] = True
        return np.flatnonzero(starts), unknown

    def _merge(self, pieces: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(rows, their ids, a column for each)] of pieces of one length, a row of bytes each: the lowest rank first, of equal ones the leftmost."""
        size, rows, out = pieces.shape[1], np.arange(len(pieces)), []
        across = np.ascontiguousarray(pieces.T)
        ids = np.full((size + 2, len(rows)), self.pad, np.int32)  # a pad before and after
        ids[1:-1] = self.of_byte[across]
        # ranks[k]: of the pair of ids k and k + 1, with k in the low bits
        ranks = np.full((size + 1, len(rows)), _NEVER, np.int32)
        if size > 1:
            ranks[1:-1] = self.first_ranks[across[:-1].astype(np.int64) << 8 | across[1:]]
            ranks[1:-1] += np.arange(1, size, dtype=np.int32)[:, None]
        for held in range(size, 0, -1):
            best = ranks[: held + 1].min(axis=0)
            going = best < _NEVER // 2
            if not going.all():
                done = np.flatnonzero(~going)
                out.append((rows[done], ids[1 : held + 1].take(done, axis=1)))
                left = np.flatnonzero(going)
                if not len(left):
                    break
                ids, ranks, rows, best = ids[: held + 2].take(left, axis=1), ranks[: held + 1].take(left, axis=1), rows[left], best[left]
            place, column = best & (1 << _PLACE) - 1, np.arange(len(rows))
            for k in range(2, held + 1):
                past = place < k
                np.copyto(ids[k], ids[k + 1], where=past)
                if k < held:
                    np.copyto(ranks[k], ranks[k + 1] - 1, where=past)
            new = self.merged[best >> _PLACE]
            ids[held + 1] = ids[held]  # the pad
            ids[place, column] = new
            ranks[place, column] = self._ranks(new.astype(np.int64) * self.width + ids[place + 1, column]) + place
            ranks[place - 1, column] = self._ranks(ids[place - 1, column].astype(np.int64) * self.width + new) + place - 1
        return out

    def _pieces(self, offsets: np.ndarray, data: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, how many each has)"""
        sizes = np.diff(offsets)
        counts, found = np.zeros(len(sizes), np.int64), []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size > _LONGEST:
                texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows]
                found += [(rows[i : i + 1], ids[:, None]) for i, ids in enumerate(self._library(texts))]
                continue
            for at in range(0, len(rows), _ROWS):
                some = rows[at : at + _ROWS]
                pieces = data[offsets[some][:, None] + np.arange(size)]
                if size == 1:
                    found.append((some, np.where(pieces.T == 0xFF, end_id, self.of_byte[pieces.T])))
                else:
                    found += [(some[done], ids) for done, ids in self._merge(pieces)]
        for rows, ids in found:
            counts[rows] = len(ids)
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for rows, ids in found:
            out[begin[rows] + np.arange(len(ids))[:, None]] = ids
        return out, counts

    def encoded(self, column: pa.Array, end_id: int) -> list[memoryview]:
        """Little-endian 32-bit ids of each text and `end_id`. Null counts as empty; what isn't UTF-8 is an error."""
        column.validate(full=True)
        texts = [t or b"" for t in as_bytes(column)]
        if not texts:
            return []
        odd = {i for i, t in enumerate(texts) if not self.covered or any(x in t for x in self.added)}
        joined, ends = self._joined(texts, odd)
        if self.covered:
            starts, unknown = self._starts(joined)
            if len(unknown):
                odd |= set(np.searchsorted(ends, unknown).tolist())
                joined, ends = self._joined(texts, odd)
                starts, _ = self._starts(joined)
            offsets = np.append(starts, len(joined))
            found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
            _, at, held = found.dictionary.buffers()
            ids, counts = self._pieces(np.frombuffer(at, np.int64, len(found.dictionary) + 1), np.frombuffer(held, np.uint8), end_id)
            of = found.indices.to_numpy(zero_copy_only=False)
            each = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * np.concatenate(([0], np.cumsum(counts)))), pa.py_buffer(ids)])
            flat = memoryview(each.take(found.indices).buffers()[2])
            past = 4 * np.cumsum(counts[of])[np.searchsorted(starts, ends)]
            out = [flat[a:b] for a, b in zip([0, *past[:-1].tolist()], past.tolist(), strict=True)]
        else:
            out = [memoryview(b"")] * len(texts)
        for i in odd:
            text = texts[i].decode()
            out[i] = memoryview(np.concatenate([*self._library(_parts(text) if self.covered else [text]), np.array([end_id], np.uint32)]).tobytes())
        return out

    @staticmethod
    def _joined(texts: list[bytes], without: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(all texts, each with its end mark; where the marks are). Those of `without` are left empty."""
        kept = [b"" if i in without else t for i, t in enumerate(texts)] if without else texts
        sizes = np.fromiter((len(t) + 1 for t in kept), np.int64, len(kept))
        return np.frombuffer(b"\xff".join(kept) + b"\xff", np.uint8), np.cumsum(sizes) - 1
