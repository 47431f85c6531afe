"""SentencePiece encoding and decoding that keeps byte offsets.

The normaliser here reads the character map compiled into a model (a
double-array trie over UTF-8 bytes, then its replacement strings) and takes the
longest matching prefix at each place. It records, for every byte of the
normalised text, the byte of the original text that it comes from; a piece's
place in the normalised text then projects to a span of original bytes. Merging
is the public library's; the spans are checked against the pieces it returns.

Defined cases: null text is the empty text, whose ids are begin and end alone,
without pieces; repeated rows are encoded each on its own; extra columns pass
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, strings

_SPACE = "▁".encode()


class CharMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if len(blob) > 4:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at a place, and what replaces them."""
        units = self.units
        if not units:
            return None
        node, found = _offset(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """A model's normalisation, with the original byte of each normalised byte."""

    def __init__(self, spec, symbols: list[bytes] = ()):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.plain = not self.map.units and not self.squeeze and self.escape and not self.symbols

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each and the end, the offset in data."""
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._plain(data) if self.plain else self._general(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        wide = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
        source = np.repeat(np.arange(len(data)), wide)
        head = 3 * self.prefix
        return _SPACE * self.prefix + data.replace(b" ", _SPACE), np.concatenate([np.zeros(head, np.int64), source, [len(data)]])

    def _chunks(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement) of each longest prefix in turn."""
        at = 0
        while at < len(data):
            if own := next((s for s in self.symbols if data.startswith(s, at)), None):
                n, put = len(own), own
            elif hit := self.map.longest(data, at):
                n, put = hit
            else:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                put = data[at : at + n]
            yield at, at + n, put
            at += n

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), []
        mark = _SPACE if self.escape else b" "
        started, spaced, last = False, self.squeeze, 0
        for start, end, put in self._chunks(data):
            if spaced:
                put = put.lstrip(b" ")
            if not put:
                if self.squeeze and started:
                    last = last or start
                continue
            if not started:
                started = True
                if self.prefix:
                    out += mark
                    source += [start] * len(mark)
            for b in put:
                if b == 0x20:
                    out += mark
                    source += [start] * len(mark)
                else:
                    out.append(b)
                    source.append(start)
            spaced = self.squeeze and put.endswith(b" ")
            last = end
        if self.squeeze:
            while out.endswith(mark) and out:
                last = source[-1]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, last], np.int64)


class Encoder:
    """A model with its normaliser; encode() returns ids and byte spans."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = model.SentencePiece
        self.normalise = Normaliser(model.normalizer_spec, [p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED])
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.sp.unk_id()

    def encode(self, texts: list[str], edges: bool = True) -> list[np.ndarray]:
        """Ids of each text, with begin and end ids if edges is set."""
        return [np.array(x, "<u4") for x in self.sp.encode(texts, num_threads=1, add_bos=edges, add_eos=edges)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last in the original text, for each id; control ids get empty spans."""
        normal, source = self.normalise(text.encode())
        width = self.width[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():  # an unknown piece has the width of its surface
            surface = self.sp.encode(text, out_type=str)
            width[width > 0] = [len(s.encode()) if i == self.unknown else w for s, i, w in zip(surface, ids[width > 0], width[width > 0], strict=True)]
        place = np.concatenate([[0], np.cumsum(width)])
        if place[-1] != len(normal):
            raise ValueError(f"pieces cover {place[-1]} of {len(normal)} normalised bytes")
        return source[place[:-1]].astype("<u4"), source[place[1:]].astype("<u4")

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.sp.decode([x.tolist() for x in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


ROWS = 256


def encode_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None, decode: bool = True) -> DataFrame:
    """docs' columns (those in keep, by default all) and, packed as little-endian
    unsigned 32-bit integers, `piece_ids`, `span_starts` and `span_ends` (byte
    offsets in the original text), and `decoded` text. Names that docs has
    already are replaced.

    One pass, no shuffle. A model is a file of fixed size at the same path on
    every machine; path resolution happens where the rows are.
    """
    new = ["piece_ids", "span_starts", "span_ends", "decoded"]
    kept = others(docs.columns if keep is None else keep, new)
    fields = [f for f in docs.select(*kept).schema.fields]
    schema = T.StructType([*fields, *(T.StructField(n, T.BinaryType()) for n in new[:3]), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model or public_model())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = strings(batch, len(kept)).to_pylist()
                ids = enc.encode(texts)
                spans = [enc.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                back = enc.decode(ids) if decode else [None] * len(ids)
                packed = [pa.array([x.tobytes() for x in col], pa.binary()) for col in (ids, [s for s, _ in spans], [e for _, e in spans])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *packed, pa.array(back, pa.string())], names=[*kept, *new])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
