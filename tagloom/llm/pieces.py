"""SentencePiece encoding and decoding with byte spans.

Normalisation reads a text by longest prefix through the model's compiled character map
and records, for every normalised byte, the source byte it came from; each piece's end in
the normalised text then projects to an end in the source, so pieces carry byte spans of
the original text.  A model with an empty map (piece_bpe_32k.model is one) has no prefix to
look for, so its alignment is made by one pass over the spaces instead of the walk.  The ids
are the library's own, for whole texts; where its pieces don't spell what the normaliser
made, the ids stay and the spans are null.

Defined results: a null or empty text has the end id only, whose span is empty; unknown
pieces span the characters that the library took together; equal rows give equal rows; very
long texts are encoded whole; other columns are ignored; an empty table gives an empty table;
every row gives one row.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

MARK = "▁"


class CharacterMap:
    """A compiled character map: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]) if size else ()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text[at:] in the map, and its replacement."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """Normalised bytes of a text and the source offset of each of them, and of their end."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool):
        self.map, self.dummy, self.remove, self.space = CharacterMap(charsmap), dummy_prefix, remove_extra, MARK.encode() if escape else b" "

    @property
    def plain(self) -> bool:
        return not self.map.units and not self.remove

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(text, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(self.space), 1))
            pre = self.space if self.dummy else b""
            return pre + text.replace(b" ", self.space), np.concatenate([np.zeros(len(pre), np.int64), align, [len(text)]])
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            n, new = hit or (_char_length(text[at]), text[at : at + _char_length(text[at])])
            parts.append((new, at))
            at += n
        out, align, space = bytearray(), [], self.remove
        if self.remove:
            while parts and not parts[-1][0].strip(b" "):
                at = parts.pop()[1]
        first = True
        for new, src in parts:
            if self.remove and space:
                new = new.lstrip(b" ")
            if not new:
                continue
            if first and self.dummy:
                out += self.space
                align += [src] * len(self.space)
            first = False
            for b in new:
                if b == 32:
                    out += self.space
                    align += [src] * len(self.space)
                else:
                    out.append(b)
                    align.append(src)
            space = new.endswith(b" ")
        if self.remove:
            while out.endswith(self.space):
                del out[-len(self.space) :], align[-len(self.space) :]
        return bytes(out), np.array([*align, at], np.int64)


class Coder:
    """The library's processor with a table of pieces' normalised lengths."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        kinds = proto.ModelProto.SentencePiece
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.eos, self.unknown = self.sp.eos_id(), self.sp.unk_id()

    def encode(self, text: str) -> list[int]:
        """Ids of a text without an end id."""
        return self.sp.encode(text, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray | None:
        """len(ids) + 1 offsets: piece k covers source bytes [k] to [k + 1]; null if the pieces don't spell the normalised text."""
        normal, align = self.normalise(text.encode())
        lengths = self.lengths[ids] if len(ids) else np.zeros(0, np.int64)
        if self.unknown in ids:  # an unknown piece is as long as what it stands for
            names = self.sp.encode(text, out_type=str, num_threads=1)
            for k in np.flatnonzero(np.array(ids) == self.unknown).tolist():
                lengths[k] = len(names[k].encode())
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return align[ends] if ends[-1] == len(normal) else None


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model: str, *more: str) -> DataFrame:
    """ids (end id last) and, for each piece, its byte span in the source text."""

    def work(batch: list[bytes]) -> dict:
        c, ids, begins, ends = coder(model), [], [], []
        for t in batch:
            text = t.decode("utf-8", "replace")
            own = c.encode(text)
            at = c.spans(text, own)
            ids.append([*own, c.eos])
            begins.append(None if at is None else [*at[:-1].tolist(), len(t)])
            ends.append(None if at is None else [*at[1:].tolist(), len(t)])
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "begin": pa.array(begins, pa.list_(pa.int64())), "end": pa.array(ends, pa.list_(pa.int64()))}

    return map_texts(docs, work, "ids array<int>, begin array<bigint>, end array<bigint>", *more)


def round_trip(docs: DataFrame, model: str, *more: str, keep_ids: bool = False) -> DataFrame:
    """Per document: how many ids, digests of the ids, the decoded text and the spans, and whether the spans tile the text; ids if asked for.

    spans_sha256 is of the offsets between pieces as little-endian 64-bit numbers, the text's length last.
    """

    def work(batch: list[bytes]) -> dict:
        c = coder(model)
        n, said, decoded, spanned, tiled, every = [], [], [], [], [], []
        for t in batch:
            text = t.decode("utf-8", "replace")
            ids = c.encode(text)
            at = c.spans(text, ids)
            back = c.sp.decode([*ids, c.eos])
            n.append(len(ids) + 1)
            if keep_ids:
                every.append([*ids, c.eos])
            said.append(hashlib.sha256(" ".join(map(str, [*ids, c.eos])).encode()).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
            spanned.append(None if at is None else hashlib.sha256(np.append(at, len(t)).astype("<i8").tobytes()).hexdigest())
            tiled.append(None if at is None else bool(at[0] == 0 and at[-1] == len(t) and (np.diff(at) >= 0).all()))
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "spans_sha256": pa.array(spanned, pa.string()), "spans_tile": pa.array(tiled, pa.bool_())}
        return out | ({"ids": pa.array(every, pa.list_(pa.int32()))} if keep_ids else {})

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, spans_tile boolean"
    return map_texts(docs, work, schema + ", ids array<int>" * keep_ids, *more)
