"""SentencePiece encoding and decoding with original byte spans.

The normaliser walks the text with the longest prefix found in the model's compiled character map (a Darts
double array and a block of replacement strings) and records, for every normalised byte, the original byte it
came from.  Its output is what is segmented: the same model, with its own normaliser switched off, turns the
normalised bytes into ids.  Each id owns a known number of normalised bytes, so a running sum over the ids cuts the
normalised text into pieces and the alignment projects every piece to its original span.

Defined results: a null text is the empty text; the empty text has the two ids begin and end, both with empty
spans; a null id stays null; repeated rows give one output row each; extra columns are ignored; an empty table
gives an empty table.  Whole texts are encoded, however long.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quarrylink.llm.common import id_and_text, map_batches

SPACE = "▁".encode()
UNKNOWN_CHAR = "�".encode()


def utf8_length(data: bytes, at: int) -> int:
    """Bytes of the well-formed character at ``at``; 0 if it is malformed."""
    first = data[at]
    n = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    if not n or at + n > len(data):
        return 0
    try:
        data[at : at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n


class CharacterMap:
    """The compiled map: 4 bytes with the size of the double array, the array, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest mapped prefix of ``data[at:]`` and its replacement; length 0 if there is none."""
        units, best, value = self.units, 0, 0
        node = self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child(unit)
            if unit & 0x100:
                best, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return best, self.strings[value : self.strings.index(b"\0", value)] if best else b""


@dataclass
class Encoded:
    ids: list[int]
    begins: np.ndarray
    ends: np.ndarray


def without_normaliser(model: bytes) -> bytes:
    """The model with the identity as its normaliser: it takes bytes that are normalised already."""
    proto = model_pb2.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    spec.name, spec.precompiled_charsmap = "identity", b""
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return proto.SerializeToString()


class Codec:
    """Encodes and decodes with one model; ``model`` is the serialised model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=without_normaliser(model))
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kinds = model_pb2.ModelProto.SentencePiece
        #: Normalised bytes that each id owns; unknown pieces (-1) own what is left of a character.
        self.width = np.array([0 if p.type == kinds.CONTROL else 1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the original byte offset."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map and not self.squeeze and self.escape:
            return self._identity(data)
        out, origin, at = bytearray(), [], 0
        space = SPACE if self.escape else b" "
        if self.squeeze:
            while at < len(data) and (step := self._prefix(data, at))[1] == b" ":
                at += step[0]
            if at == len(data):
                return b"", np.array([at], np.int64)
        if self.dummy_prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            n, piece = self._prefix(data, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for byte in piece:
                    put = space if byte == 32 else bytes((byte,))
                    out += put
                    origin += [at] * len(put)
                after_space = piece.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[-len(space)]
                del origin[-len(space) :]
        return bytes(out), np.array([*origin, at], np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.map:
            n, piece = self.map.longest(data, at)
            if n:
                return n, piece
        n = utf8_length(data, at)
        return (n, data[at : at + n]) if n else (1, UNKNOWN_CHAR)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map, where every character is its own longest prefix."""
        raw = np.frombuffer(data, np.uint8)
        origin = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(SPACE), 1))
        head = np.zeros(len(SPACE) if self.dummy_prefix else 0, np.int64)
        return (SPACE if self.dummy_prefix else b"") + data.replace(b" ", SPACE), np.concatenate([head, origin, [len(raw)]])

    def spans(self, normal: bytes, origin: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of each id of a normalised text."""
        width = self.width[np.asarray(ids, np.int64)]
        if (width < 0).any():
            width = self._with_unknown(normal, ids, width)
        cuts = np.concatenate([[0], np.cumsum(width)])
        if cuts[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        begins, ends = origin[cuts[:-1]], origin[cuts[1:]]
        return begins, np.where(width == 0, begins, ends)

    def _with_unknown(self, normal: bytes, ids: list[int], width: np.ndarray) -> np.ndarray:
        """An unknown id stands for a run that the next known piece ends."""
        width, at = width.copy(), 0
        for i, w in enumerate(width):
            if w < 0:
                rest = [self.library.id_to_piece(x).encode() for x, v in zip(ids[i + 1 :], width[i + 1 :], strict=True) if v > 0][:1]
                stop = normal.find(rest[0], at + 1) if rest else len(normal)
                width[i] = (stop if stop >= 0 else len(normal)) - at
            at += int(width[i])
        return width

    def encode(self, texts: list[str]) -> list[Encoded]:
        return [self.encode_one(text) for text in texts]

    def encode_one(self, text: str) -> Encoded:
        """One text at a time: the alignment has eight bytes for each of its bytes."""
        normal, origin = self.normalise(text.encode())
        ids = self.segmenter.encode(normal.decode(), add_bos=True, add_eos=True)
        return Encoded(ids, *self.spans(normal, origin, ids))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) for x in ids]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_offsets(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: the ids of each text and the byte span of each id; the model travels with the plan."""
    model = read_model(model_path)

    def make():
        codec = Codec(model)

        def work(rows):
            done = codec.encode([x or "" for x in rows["text"]])
            return {"doc_id": rows["doc_id"], "ids": [x.ids for x in done], "begins": [x.begins for x in done], "ends": [x.ends for x in done]}

        return work

    return map_batches(id_and_text(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the decoded text of each list of ids; a null list decodes to the empty text."""
    model = read_model(model_path)

    def make():
        codec = Codec(model)
        return lambda rows: {"doc_id": rows["doc_id"], "text": codec.decode([x or [] for x in rows["ids"]])}

    return map_batches(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), make, f"doc_id {dict(df.dtypes)[id_col]}, text string")


def round_trip_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encode and decode in one pass: n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered_bytes.

    spans_sha256 is of all begins, then all ends, as little-endian unsigned 64-bit integers; covered_bytes is where
    the last span ends.
    """
    model = read_model(model_path)

    def make():
        codec = Codec(model)

        def work(rows):
            done = codec.encode([x or "" for x in rows["text"]])
            back = codec.decode([x.ids for x in done])
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(x.ids) for x in done],
                "ids_sha256": [hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest() for x in done],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back],
                "spans_sha256": [hashlib.sha256(x.begins.astype("<u8").tobytes() + x.ends.astype("<u8").tobytes()).hexdigest() for x in done],
                "covered_bytes": [int(x.ends.max()) for x in done],
            }

        return work

    kind = dict(df.dtypes)[id_col]
    return map_batches(id_and_text(df, id_col, text_col), make, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes bigint")
