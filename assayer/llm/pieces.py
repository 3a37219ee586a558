"""SentencePiece encoding and decoding that keeps every piece's place in the original text.

A text is normalised by the longest prefix that the model's compiled character map knows,
recording for each normalised character where its source begins. Segments between word
boundaries are then cut into pieces and each piece is projected back to source bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.segments import Segments
from assayer.llm.tables import read

MARK = "▁"
SCHEMA = "ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharacterMap:
    """A compiled map: a double array over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        self._units, self._texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self._units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self._texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length in bytes of the longest known prefix at ``at`` and its replacement."""
        units, found = self._units, None
        if not units:
            return None
        node = self._child(0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._child(node)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, value
        if found is None:
            return None
        return found[0], self._texts[found[1] : self._texts.index(b"\0", found[1])].decode()

    def _child(self, node: int) -> int:
        unit = self._units[node]
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def __bool__(self) -> bool:
        return bool(self._units)


class Model:
    """A BPE or unigram model file: normaliser with alignment, pieces of a segment, their surfaces."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that carry the space mark at word ends are not supported")
        kind = pb.ModelProto.SentencePiece
        self.types = np.array([p.type for p in proto.pieces])
        self.pieces = [p.piece for p in proto.pieces]
        self.unknown = proto.trainer_spec.unk_surface
        # Symbols that the model's maker added stand as they are: the map does not reach into them.
        own = sorted((p.piece.encode() for p in proto.pieces if p.type == kind.USER_DEFINED), key=len, reverse=True)
        self.fixed = re.compile(b"|".join(map(re.escape, own))) if own else None
        self.byte_type, self.unknown_type = kind.BYTE, kind.UNKNOWN
        # Of each piece: characters, source bytes (a mark stands for a space), text; and whether it is spelled in bytes or unknown.
        self.chars = np.array([len(p) for p in self.pieces])
        self.sizes = np.array([len(p.replace(MARK, " ").encode()) for p in self.pieces])
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.odd = np.isin(self.types, (kind.BYTE, kind.UNKNOWN))
        long = {c for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED) and len(p.piece) > 1 for c in p.piece[1:]}
        marked = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type != kind.CONTROL)
        # A place before the mark is a boundary when no piece runs over it; so is a line end that no piece holds.
        line = "\n" if "\n" not in long and "\n" not in self.pieces else ""
        by_words = not marked and proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.cut = re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\n+" if line else "")) if by_words else re.compile("(?s).+")
        # What is normalised here is not normalised again.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and the source byte at which each of its characters begins, with the end at last."""
        data = text.encode()
        out, at, i = [], [], 0
        while i < len(data):
            if self.fixed and (symbol := self.fixed.match(data, i)):
                size, new = len(symbol[0]), symbol[0].decode()
            elif hit := self.map.longest(data, i):
                size, new = hit
            else:
                size = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                new = data[i : i + size].decode()
            out += new
            at += [i] * len(new)
            i += size
        if self.squeeze:
            keep = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while keep and (out[keep[-1]] == " " or self.escape and out[keep[-1]] == MARK):  # by then spaces are marks
                keep.pop()
            end = len(data) if not keep else (at[keep[-1] + 1] if keep[-1] + 1 < len(at) else len(data))
            out, at = [out[k] for k in keep], [at[k] for k in keep]
        else:
            end = len(data)
        if self.dummy and out:
            out, at = [" ", *out], [at[0], *at]
        joined = "".join(out)
        return joined.replace(" ", MARK) if self.escape else joined, np.array([*at, end], np.int64)

    def encode(self, segments: list[str]) -> list[np.ndarray]:
        """For each piece of each normalised segment: id, characters it ends after, source bytes if nothing was replaced."""
        found = self._processor.encode(segments, num_threads=1)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ids = np.fromiter(chain.from_iterable(found), np.int32, at[-1])
        rows = np.stack([ids, self.chars[ids], self.sizes[ids]], 1).astype(np.int32)
        out = [rows[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        odd = np.concatenate([[0], np.cumsum(self.odd[ids])])[at]
        for k in np.flatnonzero(odd[1:] > odd[:-1]).tolist():
            out[k] = self._spelled(segments[k], found[k])
        return out

    def _spelled(self, segment: str, ids: list[int]) -> np.ndarray:
        """The same for one segment that holds byte pieces or an unknown one."""
        rows, pending, chars = np.zeros((len(ids), 3), np.int32), b"", iter(segment)
        for k, i in enumerate(ids):
            if self.types[i] == self.byte_type:
                pending += bytes([int(self.pieces[i][3:5], 16)])
                try:
                    part, pending = pending.decode(), b""
                except UnicodeDecodeError:
                    part = ""
            elif self.types[i] == self.unknown_type:
                part = "".join(chars)  # a run without byte pieces; only whole segments reach it
                chars = iter("")
            else:
                part = self.pieces[i]
            if self.types[i] != self.unknown_type:
                for _ in part:
                    next(chars, None)
            rows[k] = i, len(part), sum(1 if c == MARK else len(c.encode()) for c in part)
        return rows

    def surface(self, ids: np.ndarray) -> str:
        """What the library's decode gives for these ids, before a leading mark is dropped."""
        if not self.odd[ids].any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))
        parts = [
            bytes([int(self.pieces[i][3:5], 16)]) if self.types[i] == self.byte_type
            else (self.unknown if self.types[i] == self.unknown_type else self.pieces[i].replace(MARK, " ")).encode()
            for i in ids.tolist()
        ]
        return b"".join(parts).decode(errors="replace")

    def decode(self, surfaces: list[str], ids: np.ndarray) -> str:
        """Without the mark that begins the text; where spaces are squeezed, without one of each piece before its first letter."""
        dropped = 0
        for i in ids if self.dummy or self.squeeze else ():
            if self.pieces[i][:1] != MARK:
                break
            dropped += 1
            if not self.squeeze or len(self.pieces[i]) > 1:
                break
        return "".join(surfaces)[dropped:]


def encode_batches(batches: Iterator[pa.RecordBatch], blob: bytes, key: str, text: str) -> Iterator[pa.RecordBatch]:
    model = Model(blob)
    cache = Segments(model.encode, width=3)
    surfaces: dict[int, str] = {}
    for batch in W.slices(batches, text):
        cache.trim()
        if not cache._codes:
            surfaces.clear()
        texts = W.plain(batch.column(text)).to_pylist()
        plain = not model.map and not model.fixed and not model.squeeze and model.escape
        codes, aligned = [], []
        for t in texts:
            if plain and MARK not in t:
                normal, at = (MARK * model.dummy + t.replace(" ", MARK) if t else ""), None
            else:
                normal, at = model.normalise(t)
            codes.append(cache.codes(model.cut.findall(normal)))
            aligned.append(at)
        every = np.concatenate(codes)
        rows, sizes = cache.values(every)
        for c in np.unique(every).tolist():
            if c not in surfaces:
                surfaces[c] = model.surface(cache._values[cache._at[c] : cache._at[c + 1], 0])
        segments_at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        pieces_at = np.concatenate([[0], np.cumsum(sizes)])[segments_at]
        ends = np.cumsum(rows[:, 2])
        base = np.concatenate([[0], ends])[pieces_at[:-1]]
        # The marks that stand for the dummy prefix have no source: all later places move back by one.
        ends = ends - np.repeat(base + model.dummy, np.diff(pieces_at))
        begins = ends - rows[:, 2]
        for k, at in enumerate(aligned):
            if at is not None:
                mine = slice(pieces_at[k], pieces_at[k + 1])
                upto = np.cumsum(rows[mine, 1])
                begins[mine], ends[mine] = at[upto - rows[mine, 1]], at[np.minimum(upto, len(at) - 1)]
        begins = np.maximum(begins, 0)
        offsets = pa.array(pieces_at.astype(np.int32))
        decoded = [model.decode([surfaces[c] for c in own.tolist()], rows[pieces_at[k] : pieces_at[k + 1], 0]) for k, own in enumerate(codes)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v, np.int32))) for v in (rows[:, 0], begins, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(key), *lists, pa.array(decoded, pa.string())], [key, "ids", "begins", "ends", "decoded"])


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ids, begins, ends (source bytes of each piece), decoded.

    Null text counts as empty and gives empty lists; repeated rows and rows without a key are encoded each for
    itself, and an empty table gives no rows. Symbols that a model defines by hand stand as they are. Bytes of a character that is spelled in byte
    pieces belong to its last piece; the dummy prefix has no source. Other columns are left out, so
    none can clash. Texts are taken whole; memory follows the longest one and a bounded cache.
    """
    with open(model_path, "rb") as f:
        blob = f.read()
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda batches: encode_batches(batches, blob, key, text), f"{key} {kind}, {SCHEMA}")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text, end of the last piece."""
    import public_tokenizers

    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("last_byte"),
    )


def reference_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
