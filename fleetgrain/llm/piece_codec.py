"""SentencePiece encoding with byte spans, and decoding.

Normalisation is done here: at every place the longest prefix in the model's compiled
character map is replaced by its normal form, one character is copied where none
matches, and every output byte records the input byte it came from. Blanks become the
piece mark and a leading mark is added if the model says so. The normal text is then
cut before every run of marks; no piece of such a model holds a mark after another
character, so the cuts never split a piece, and each distinct cut is segmented once per
worker by the library with a copy of the model that normalises nothing. Pieces are
projected through the recorded alignment to byte spans of the original text; a byte
piece spans one byte.

Defined cases: null and empty texts have no pieces and decode to the empty text; rows
are encoded one by one, so repeats are equal and an empty table gives an empty result;
very long texts are held one batch at a time; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package

MARK = "▁"
MARK_BYTES = len(MARK.encode())
#: Distinct cuts a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Characters of the texts that are encoded at once.
SLICE_CHARS = 1 << 20
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes and a pool of normal forms."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its normal form."""
        if not self.units:
            return None
        found = None
        node = self._child(0, self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Normalizer:
    """Normal text of a model and, for each of its bytes and its end, the source byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def plain(self) -> bool:
        return not self.map.units and not self.squeeze and self.escape and self.prefix

    def run(self, text: str) -> tuple[bytes, list[int]]:
        source = text.encode()
        parts: list[tuple[bytes, int]] = []
        copied = set()  # places whose character stands for itself, byte by byte
        at = 0
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                lead = source[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (width, source[at : at + width])
                copied.add(at)
            parts.append((hit[1], at))
            at += hit[0]
        out, places = bytearray(), []
        end = len(source)
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
            while parts and not parts[-1][0].strip(b" "):
                end = parts.pop()[1]
        if not parts:
            return b"", [end]
        mark = MARK.encode() if self.escape else b" "
        if self.prefix:
            out += mark
            places += [parts[0][1]] * len(mark)
        blank = self.squeeze  # a leading blank was dropped
        for normal, place in parts:
            for k, byte in enumerate(normal):
                if byte == 0x20:
                    if not (self.squeeze and blank):
                        out += mark
                        places += [place] * len(mark)
                    blank = True
                else:
                    out.append(byte)
                    places.append(place + k if place in copied else place)
                    blank = False
        if self.squeeze:
            while out.endswith(mark) and len(out) > len(mark):
                del out[-len(mark) :], places[-len(mark) :]
        return bytes(out), [*places, end]


class Codec:
    """One model in one worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.normalizer = Normalizer(model.normalizer_spec)
        # the copy sees normal text and must leave it alone
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        bytes_, unknown = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE, model.trainer_spec.unk_id
        self.widths = np.array([1 if p.type == bytes_ else len(p.piece.encode()) for p in model.pieces], dtype=np.int32)
        marks = np.array([0 if p.type == bytes_ else p.piece.count(MARK) for p in model.pieces], dtype=np.int64)
        self.source_widths = self.widths - (MARK_BYTES - 1) * marks
        self.unknown = unknown
        # with a mark inside a piece cuts could split it; then a text is one cut
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.bounds: list[int] = [0]
        self.shown: list[str] = []

    def trim(self) -> None:
        """Between batches: places handed out before are no longer valid."""
        if len(self.index) > REMEMBERED:
            self.forget()

    def learn(self, cuts: list[str]) -> np.ndarray:
        """Place of each cut in the remembered lists; unseen ones are segmented."""
        index = self.index
        new = [c for c in dict.fromkeys(cuts) if c not in index]
        if new:
            for cut, ids in zip(new, self.cutter.encode(new, num_threads=1), strict=True):
                begin = self.bounds[-1]
                while begin + len(ids) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
                self.flat[begin : begin + len(ids)] = ids
                index[cut] = len(self.shown)
                self.bounds.append(begin + len(ids))
                self.shown.append(",".join(map(str, ids)))
        return np.fromiter((index[c] for c in cuts), dtype=np.int64, count=len(cuts))

    def ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cuts at `places` in a row, and where each cut begins and the last ends."""
        bounds = np.array(self.bounds, dtype=np.int64)
        begin = bounds[places]
        count = bounds[places + 1] - begin
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], count)], ends

    def _ends(self, normal: bytes, ids: np.ndarray) -> np.ndarray:
        """End of each piece in the normal bytes."""
        widths = self.widths[ids].astype(np.int64)
        if (ids == self.unknown).any() or widths.sum() != len(normal):
            # unknown pieces have the width of their text: ask the library for it
            proto = self.cutter.encode(normal.decode(), out_type="immutable_proto")
            return np.array([len(normal.decode()[: p.end].encode()) for p in proto.pieces], dtype=np.int64)
        return np.cumsum(widths)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and the first and end byte of each in the UTF-8 text."""
        empty = np.zeros(0, dtype=np.int64)
        if not text:
            return empty.astype(np.int32), empty, empty
        normal, places = self.normalizer.run(text)
        cuts = self._cut(normal.decode())
        if not cuts:
            return empty.astype(np.int32), empty, empty
        ids, _ = self.ids_at(self.learn(cuts))
        ends = self._ends(normal, ids)
        places = np.array(places, dtype=np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        return ids, places[begins], places[ends]

    def _cut(self, normal: str) -> list[str]:
        return _CUT.findall(normal) if self.cuts else [normal] if normal else []

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str, int]]:
        """(pieces, hash of the ids, hash of the decoded text, CRC of the spans) of each text."""
        for part in slices(texts):
            self.trim()
            coded = self._coded(part)
            lengths = [len(c) for c in coded]
            ids, ends = self.ids_at(np.concatenate(coded) if coded else np.zeros(0, np.int64))
            bounds = ends[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
            for text, places, a, b in zip(part, coded, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = ids[a:b]
                shown = ",".join([self.shown[i] for i in places.tolist()])
                decoded = self.whole.decode(own.tolist()) if b > a else ""
                yield (
                    b - a,
                    hashlib.sha256(shown.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                    self._span_crc(text, own),
                )

    def _span_crc(self, text: str, ids: np.ndarray) -> int:
        if not len(ids):
            return 0
        if self.normalizer.plain and MARK not in text and not (ids == self.unknown).any():
            # alignment of the plain map: a mark is one source byte, the leading one none
            ends = np.cumsum(self.source_widths[ids]) - 1
            begins = np.concatenate(([0], ends[:-1]))
        else:
            _, begins, ends = self.encode(text)
        return zlib.crc32(np.column_stack((begins, ends)).astype("<i8").tobytes())

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        """Remembered places of the cuts of each text, many texts at once.

        With a plain map and single blanks, cuts are the words between the blanks.
        """
        plain = self.normalizer.plain and self.cuts
        odd = [not plain or "  " in t or t.endswith(" ") or t.startswith(" ") or MARK in t for t in texts]
        flat = pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], type=pa.large_string())
        lists = pc.split_pattern(flat, " ")
        coded = lists.values.dictionary_encode()
        learned = self.learn([MARK + w for w in coded.dictionary.to_pylist()])
        places = learned[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else learned
        bounds = lists.offsets.to_numpy()
        out = []
        for k, text in enumerate(texts):
            if not text:
                out.append(np.zeros(0, dtype=np.int64))
            elif odd[k]:
                out.append(self.learn(self._cut(self.normalizer.run(text)[0].decode() if not plain else MARK + text.replace(" ", MARK))))
            else:
                out.append(places[bounds[k] : bounds[k + 1]])
        return out

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if len(ids) else ""


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, about SLICE_CHARS at a time."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of every text and their byte spans in it."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codec(model).trim()
            rows = [codec(model).encode(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [r[0] for r in rows], "begins": [r[1] for r in rows], "ends": [r[2] for r in rows]})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text: the text of every list of ids."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [codec(model).decode([] if i is None else [int(x) for x in i]) for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    slim = encoded.select("doc_id", "ids")
    return slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text string")


def round_trip_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of every text, ids kept in the task."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    shape = pa.schema([("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(codec(model).digests(batch.column(1).to_pylist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(shape)[1:], strict=True)]], schema=shape)

    return slim.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
