"""SentencePiece encoding and decoding by shared-prefix forward search.

A text is marked as the model does (a leading mark and marks for spaces) and cut before each run of marks; as no piece has a
mark after another character, these marked words are encoded alone. The distinct words that a task meets for the first
time are sorted into a trie, walked depth-first: the forward states of a word's prefix serve every word that shares it,
and only what follows the common prefix is computed.

For a unigram model the state of a prefix is its best score and that path's last piece (Viterbi). For a BPE model, which
ranks merges and does not add scores, the state is the last piece of the prefix's own BPE encoding: BPE encodings of
prefixes are unique, and piece t can follow the encoding of the prefix before it exactly if BPE keeps the pair (its last
piece, t) apart. So each position has one state that follows from states of shorter prefixes, as in Viterbi, and the path
back gives BPE's encoding. Characters that no piece covers become byte pieces if the model has them, else the unknown
piece. Results equal the reference library's.

Null texts have null ids; empty texts have none. Decoding ignores control pieces and drops the leading mark's space;
null ids give null. Repeated rows are encoded each (from the same cache). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CACHED, _PAIRS = 400_000, 1_000_000


class Vocabulary:
    """Pieces with scores; kind: 'bpe' or 'unigram'."""

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: str, byte_ids: list[int] | None = None, unknown: int = 0, control: Iterable[int] = ()):
        self.pieces, self.kind, self.byte_ids, self.unknown = pieces, kind, byte_ids, unknown
        self.text = {i: p.encode() for p, (i, _) in pieces.items()}
        self.bytes = {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        self.control = set(control)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self._apart: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        if kind == "bpe":  # a piece that BPE does not make out of its own text never occurs
            self.made = {p for p in pieces if len(p) > 1 and len(self.merged(p)) == 1}
        else:
            self.made = {p for p in pieces if len(p) > 1}
        #: By last two characters, the length of the longest piece.
        self.reach: dict[str, int] = {}
        for p in self.made:
            self.reach[p[-2:]] = max(self.reach.get(p[-2:], 0), len(p))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_ids = byte_ids if all(model.is_byte(i) for i in byte_ids) else None
        skipped = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(size) if i not in skipped}
        # a BPE model's scores are its merge ranks: whole numbers down from 0
        kind = "bpe" if all(s == int(s) for _, s in pieces.values()) else "unigram"
        return cls(pieces, kind, byte_ids, model.unk_id(), [i for i in range(size) if model.is_control(i)])

    def merged(self, text: str) -> list[str]:
        """BPE's own merging, for short strings: the best-scored adjacent pair first, the leftmost of equals."""
        parts, pieces = list(text), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether BPE encodes a + b as these two."""
        of_a = self._apart.get(a)
        if of_a is None:
            of_a = self._apart[a] = {}
        known = of_a.get(b)
        if known is None:
            if self._pairs >= _PAIRS:
                self._apart.clear()
                self._pairs, of_a = 0, self._apart.setdefault(a, {})
            known = of_a[b] = self.merged(a + b) == [a, b]
            self._pairs += 1
        return known

    def ids(self, pieces: list[str]) -> list[int]:
        out, last_unknown = [], False
        for p in pieces:
            found = self.pieces.get(p)
            if found is not None:
                out.append(found[0])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not last_unknown:
                out.append(self.unknown)
            last_unknown = found is None
        return out


def shared_prefix_encode(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each of the distinct words, which must be sorted: a depth-first walk of their trie."""
    out: list[list[int]] = []
    last: list[str] = [""]  # the last piece of the prefix of each length
    score: list[float] = [0.0]
    before = ""
    pieces, made, reach, apart, bpe = vocabulary.pieces, vocabulary.made, vocabulary.reach, vocabulary.apart, vocabulary.kind == "bpe"
    for word in words:
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :], score[shared + 1 :]  # score stays as it is for BPE
        for end in range(shared + 1, len(word) + 1):
            if bpe:
                chosen = word[end - 1]
                far = reach.get(word[end - 2 : end]) if end > 1 else None
                if far:
                    for start in range(end - far if far < end else 0, end - 1):
                        piece = word[start:end]
                        if piece in made and (not start or apart(last[start], piece)):
                            chosen = piece
                            break
                last.append(chosen)
            else:
                single = pieces.get(word[end - 1])
                best, chosen = score[end - 1] + (single[1] if single else vocabulary.worst), word[end - 1]
                for start in range(max(0, end - reach.get(word[max(0, end - 2) : end], 0)), end - 1):
                    found = pieces.get(word[start:end])
                    if found is not None and score[start] + found[1] > best:
                        best, chosen = score[start] + found[1], word[start:end]
                last.append(chosen)
                score.append(best)
        path, end = [], len(word)
        while end:
            path.append(last[end])
            end -= len(last[end])
        out.append(vocabulary.ids(path[::-1]))
        before = word
    return out


class Codec:
    """Encodes and decodes with a cache of words that is bounded in entries."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes | None] = {}
        self.pieces = {**vocabulary.text, **vocabulary.bytes, **dict.fromkeys(vocabulary.control, b"")}
        self.pieces.setdefault(vocabulary.unknown, " ⁇ ".encode())

    def _learn(self, words: Iterable[str]) -> None:
        distinct = sorted(words)
        for word, ids in zip(distinct, shared_prefix_encode(distinct, self.vocabulary), strict=True):
            self.known[word] = np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """32-bit ids of each text."""
        cut = [None if t is None else self._words(t) for t in texts]
        new: set[str] = set()
        for words in cut:
            if words:
                new.update(words)
        if len(self.known) > _CACHED:  # what these texts need, the common words with it, stays
            self.known = {w: self.known[w] for w in new if w in self.known}
        new.difference_update(self.known)
        self._learn(new)
        get = self.known.__getitem__
        return [None if words is None else b"".join(map(get, words)) for words in cut]

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return _WORDS.findall(MARK + text.replace(" ", MARK))

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        get = self.pieces.__getitem__
        text = b"".join(map(get, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary.load(path))
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _ids_array(encoded: list[bytes | None]) -> pa.Array:
    sizes = [0 if e is None else len(e) // 4 for e in encoded]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    values = pa.array(np.frombuffer(b"".join(e for e in encoded if e), np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([e is None for e in encoded], pa.bool_()))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), _ids_array(codec.encode(part.column("text").to_pylist()))], names=["id", "ids"])

    return run


def _as_bytes(ids: pa.Array) -> list[bytes | None]:
    offsets = ids.offsets.to_numpy()
    values = ids.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([codec.decode(x) for x in _as_bytes(part.column("ids"))], pa.string())], names=["id", "text"])

    return run


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                texts = part.column("text").to_pylist()
                encoded = codec.encode(texts)
                same = [None if t is None else codec.decode(e) == t.replace(MARK, " ") for t, e in zip(texts, encoded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([None if e is None else len(e) // 4 for e in encoded], pa.int64()),
                        pa.array([None if e is None else zlib.crc32(e) for e in encoded], pa.int64()),
                        pa.array(same, pa.bool_()),
                        _ids_array(encoded),
                    ],
                    names=["id", "n_tokens", "ids_crc32", "round_trip", "ids"],
                )

    return run


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None) -> DataFrame:
    """id_column, ids array<int>"""
    return in_arrow(_texts(docs, id_column, text_column), _encode(model or default_model()), "id long, ids array<int>").withColumnRenamed("id", id_column)


def decoded(rows: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: str | None = None) -> DataFrame:
    """id_column, text"""
    ids = rows.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return in_arrow(ids, _decode(model or default_model()), "id long, text string").withColumnRenamed("id", id_column)


def coded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None) -> DataFrame:
    """id_column, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip (decoding gives the text again; the mark itself reads as a space), ids."""
    schema = "id long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>"
    return in_arrow(_texts(docs, id_column, text_column), _both(model or default_model()), schema).withColumnRenamed("id", id_column)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))
