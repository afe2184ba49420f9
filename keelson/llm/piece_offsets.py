"""SentencePiece encoding that keeps offsets, and decoding.

Text is normalised by the model's compiled character map: at each place the longest
source string that the map's double array holds is replaced, otherwise one character
stays. Every normalised byte records where its source begins and ends, so each piece
projects to the span of original bytes that it came from. The normalised text is then
cut into pieces by the library's merges, so ids are its own.

Defined results: a null or empty text has no ids; ids that are null, and repeated rows, are
rows of their own; an empty table gives no rows; other columns are ignored. A byte
piece spans the original bytes of its share; a piece for the space put before the text spans none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

MARK = "▁"


def _fields(raw: bytes):
    """(number, value) of a serialised message; bytes for strings and messages."""

    def varint(i):
        shift = value = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class CharMap:
    """A compiled character map: a double array of source strings and their replacements."""

    units: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u4"))
    strings: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharMap:
        if not blob:
            return cls()
        n = struct.unpack_from("<I", blob)[0]
        return cls(np.frombuffer(blob, "<u4", n // 4, 4), blob[4 + n :])

    @staticmethod
    def compile(table: dict[str, str]) -> bytes:
        """The blob of a small table, one block of 256 units for each inner node."""
        trie, strings = {}, bytearray()
        for source in sorted(table):
            node = trie
            for byte in source.encode():
                node = node.setdefault(byte, {})
            node[-1] = len(strings)
            strings += table[source].encode() + b"\0"
        units, todo = [0] * 256, [(0, trie)]
        while todo:
            at, node = todo.pop()
            base = len(units)
            units += [0] * 256
            offset = at ^ base
            units[at] |= (offset << 10) | ((-1 in node) << 8)
            for key, below in node.items():
                if key == -1:
                    units[base] = below | 1 << 31
                else:
                    units[base ^ key] |= key
                    todo.append((base ^ key, below))
        return struct.pack("<I", 4 * len(units)) + np.array(units, "<u4").tobytes() + bytes(strings)

    def longest(self, raw: bytes, i: int) -> tuple[bytes, int]:
        """What replaces the text at i, and how many bytes it takes the place of."""
        best, used = None, 0
        if len(self.units):
            unit = int(self.units[0])
            at = (unit >> 10) << ((unit & 512) >> 6)
            for j in range(i, len(raw)):
                at ^= raw[j]
                if at >= len(self.units):
                    break
                unit = int(self.units[at])
                if unit & 0x800000FF != raw[j]:
                    break
                at ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best, used = int(self.units[at]) & 0x7FFFFFFF, j + 1 - i
        if best is not None:
            return self.strings[best : self.strings.index(b"\0", best)], used
        n = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
        return raw[i : i + n], n


@dataclass
class Normaliser:
    chars: CharMap
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes and, for each, the original begin and end of its source."""
        space = MARK.encode() if self.escape else b" "
        if not len(self.chars.units) and not self.squeeze:
            if not raw:
                return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
            a = np.frombuffer(raw, np.uint8)
            at = np.repeat(np.arange(len(a)), np.where(a == 32, len(space), 1))
            lead = np.zeros(len(space) * self.prefix, np.int64)
            return space * self.prefix + raw.replace(b" ", space), np.concatenate([lead, at]), np.concatenate([lead, at + 1])
        out, begins, ends, i = [], [], [], 0
        blank = self.squeeze  # whether a space now would be one too many
        while i < len(raw):
            new, used = self.chars.longest(raw, i)
            for byte in new:
                if byte == 32 and blank and self.squeeze:
                    continue
                blank = byte == 32
                piece = space if byte == 32 else bytes([byte])
                out.append(piece)
                begins += [i] * len(piece)
                ends += [i + used] * len(piece)
            i += used
        if self.squeeze and out and blank:
            out.pop()
            del begins[-len(space) :], ends[-len(space) :]
        if out and self.prefix:
            out.insert(0, space)
            begins[:0], ends[:0] = [begins[0]] * len(space), [begins[0]] * len(space)
        return b"".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


class Encoder:
    """Encodes texts with one model file; made once in a worker."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        spec, trainer = {}, {}
        for k, v in _fields(raw):
            if k == 3:
                spec = dict(_fields(v))
            elif k == 2:
                trainer = {n: x for n, x in _fields(v) if n == 24}
        if trainer.get(24):
            raise ValueError("models that mark spaces behind words are not supported")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = Normaliser(CharMap.parse(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        if not self.normalise.prefix or not self.normalise.escape:
            raise ValueError("models without a space mark before the text are not supported")
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.sizes = np.array([1 if self.lib.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.names = [str(i) for i in range(len(pieces))]

    def __call__(self, texts: list[str]):
        """For each text: its ids, the ids as text joined by commas, and begin and end of every piece in the text's bytes."""
        norms = [self.normalise(t.encode("utf-8")) for t in texts]
        # The library puts the first mark there itself, and takes further marks as they are.
        found = self.lib.encode([n[0].decode("utf-8")[1:] for n in norms], num_threads=1)
        names, unknown = self.names, self.lib.unk_id()
        for (raw, begins, ends), ids in zip(norms, found):
            sizes = self.sizes[np.array(ids, np.int64)]
            if (rest := len(raw) - int(sizes.sum())) and unknown in ids:  # an unknown piece takes what the others leave
                sizes[ids.index(unknown)] += rest
            stop = np.cumsum(sizes)
            at = (begins[stop - sizes], ends[stop - 1]) if ids else (sizes, sizes)
            yield ids, ",".join([names[i] for i in ids]), *at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends (bytes of the text, for each id) and decoded, the library's decoding of the ids."""

    def rows(batches):
        e = encoder(path)
        for b in in_slices(batches, "t", 1 << 20):
            found = list(e([t or "" for t in b.column("t").to_pylist()]))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            cols = [pa.array([f[0] for f in found], ints), pa.array([f[2].tolist() for f in found], longs), pa.array([f[3].tolist() for f in found], longs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(e.lib.decode([f[0] for f in found]), pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(rows, f"doc_id {kind}, ids array<int>, begins array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `encode` gives, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, covered (bytes that pieces span) and spans_crc32.

    The digests are taken where the pieces are made, so that the arrays need not leave the worker.
    """

    def rows(batches):
        e = encoder(path)
        for b in in_slices(batches, "t", 1 << 20):
            found = list(e([t or "" for t in b.column("t").to_pylist()]))
            decoded = e.lib.decode([f[0] for f in found])
            cols = [
                pa.array([len(f[0]) for f in found], pa.int64()), pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                pa.array([int((f[3] - f[2]).sum()) for f in found], pa.int64()), pa.array([zlib.crc32(f[3].astype("<i8").tobytes(), zlib.crc32(f[2].astype("<i8").tobytes())) for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered", "spans_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long, spans_crc32 long"
    )
