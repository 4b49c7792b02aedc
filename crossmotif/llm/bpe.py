"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts the UTF-8 text into chunks whose bounds depend on the last 16 bytes
only, so passages that documents share yield the same chunks. A chunk is encoded once and
remembered: the ids of its inner words, settled whatever stands around the chunk, and its
two ends, which begin and end with a settled word each. A join is repaired by encoding the
stretch from the last settled word on its left to the first on its right as one text. Where
the stretch's ids begin and end with the ids of those words the encodings agree and what
lies between is the repair; where they do not, or a chunk has no settled word, the stretch
grows over the next chunks, to the whole text in the end. So the ids equal those of the
whole text. Ids are decoded by the tokenizer as a whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import pick

MASK = np.uint32(0xFFC00000)  # a cut every 1024 bytes on average
MIN_CHUNK, MAX_CHUNK = 64, 1 << 14
REMEMBERED_BYTES = 8 << 20  # of chunk text, for each worker
REMEMBERED_WORDS, SPARE_WORDS = 400_000, 60_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for w in (1, 2, 4, 8):
        if len(h) > w:
            h = np.concatenate([h[:w], h[w:] + (h[:-w] << np.uint32(w))])
    ends, at = [], 0
    for c in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK:
            ends.append(c)
            at = c
    while len(data) - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


WHITE = {bytes([c]) for c in b" \t\n\r\x0b\x0c"}


class ChunkEncoder:
    """Encodes whole texts through remembered chunks; memory is bounded by the limits above."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.held = 0
        self.encoded = self.reused = self.joins = self.grown = 0

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts as native 32-bit integers, straight from the tokenizer."""
        return [array("i", c.ids).tobytes() for c in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of words, remembered. Early, so mostly frequent, ones are kept; later ones come and go."""
        known = self.words
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > REMEMBERED_WORDS + SPARE_WORDS:
                for p in list(islice(known, REMEMBERED_WORDS, None)):
                    del known[p]
            new = list(dict.fromkeys(p for p in pieces if p not in known))
            known.update(zip(new, self.whole(new)))
            return list(map(known.__getitem__, pieces))

    def _chunk(self, chunk: bytes) -> tuple | None:
        """(end of the first settled word, its ids, ids of all between, ids of the last settled word, its start); None for a
        chunk without two settled words. Words that touch an end of the chunk may go on beyond it."""
        known = self.chunks.get(chunk, self)
        if known is not self:
            self.reused += 1
            return known
        self.encoded += 1
        words = chunk.split()
        begin, end = 0, len(chunk)
        if words and chunk[:1] not in WHITE:
            begin = len(words.pop(0))
        if words and chunk[-1:] not in WHITE:
            end -= len(words.pop())
        out = None
        if len(words) >= 2:
            ids = self._ids(words)
            out = (chunk.index(words[0], begin) + len(words[0]), ids[0], b"".join(ids[1:-1]), ids[-1], chunk.rindex(words[-1], begin, end))
        if self.held > REMEMBERED_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[chunk] = out
        self.held += 2 * len(chunk) + 200
        return out

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of the whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts, whose joins are encoded together."""
        cut = [self._joins(t) for t in texts]
        found = iter(self.whole([s for stretches, _ in cut for s, _, _ in stretches]))
        return [np.frombuffer(self._joined(t, stretches, parts, [next(found) for _ in stretches]), dtype=np.int32) for t, (stretches, parts) in zip(texts, cut)]

    def _joins(self, text: bytes) -> tuple[list[tuple[bytes, bytes, bytes]], list[bytes]]:
        """Stretches (text over a join, the ids that it must begin and end with) and the settled ids between them."""
        parts: list[bytes] = []
        stretches: list[tuple[bytes, bytes, bytes]] = []
        tail, lead, at = b"", b"", 0
        for end in chunk_ends(text) if text else []:
            chunk, at = text[at:end], end
            got = self._chunk(chunk)
            if got is None:
                tail += chunk
                self.grown += 1
                continue
            stretches.append((tail + chunk[: got[0]], lead, got[1]))
            parts.append(got[2])
            tail, lead = chunk[got[4] :], got[3]
        stretches.append((tail, lead, b""))  # the whole text if no chunk has a settled word
        return stretches, parts + [b""]

    def _joined(self, text: bytes, stretches: list[tuple[bytes, bytes, bytes]], parts: list[bytes], found: list[bytes]) -> bytes:
        """Ids of the text, by its joins where all of them agree with what they join."""
        out = []
        for (_, left, right), ids, part in zip(stretches, found, parts):
            self.joins += 1
            if len(ids) < len(left) + len(right) or not ids.startswith(left) or not ids.endswith(right):
                self.grown += 1
                return self.whole([text])[0]
            out += (ids, part)
        return b"".join(out)

    def decode(self, many: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([ids.tolist() for ids in many], skip_special_tokens=False)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, len(texts), 64):  # so that long texts do not pile up in one batch
            coded = coder.encode_all([t.as_py() or b"" for t in texts[at : at + 64]])
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[at : at + 64], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded))), pa.array(coder.decode(coded), pa.string())],
                names=["id", "ids", "decoded"],
            )


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text; null and empty texts have no ids and decode to "".

    Repeated rows and equal texts are encoded alike, a row for each, whatever their ids. Very long texts are encoded
    whole, chunk by chunk. An empty table gives no row.
    ``tokenizer`` is the path of a vocabulary file present on every executor.
    """
    path = tokenizer or default_tokenizer()
    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _encode(b, path), f"id {dict(rows.dtypes)['id']}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` returns."""
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
