"""SentencePiece encoding with byte spans of the original text, and decoding (operator 13).

A text is normalised first: at each place the longest key of the model's compiled character map that the text continues with is replaced, other
characters stay; then spaces are escaped as the model says. Each normalised character records where in the original text it begins (in UTF-8 bytes). The
library merges the normalised text behind a normaliser that changes nothing, and the lengths of the pieces project every piece to the bytes it came from.
Characters without a piece become byte pieces; the last of them has the span.

The ids and the decoded text are those of the ``sentencepiece`` library for whole texts; the spans are those of its offsets, in bytes.

Defined results: a null text is encoded as the empty text, which has no pieces; repeated rows are encoded as often as they occur; very long texts
are encoded whole; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read. A model that is not of the BPE kind, that
has no byte pieces, or that holds user-defined or unused pieces, is refused with an error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from specledger.llm.words import bounded

SPACE = "▁"  # stands for a space inside pieces
# Kinds of pieces and of models in a model file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
BPE = 2
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields (number, value) of a message in the protocol-buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else varint()
            yield tag >> 3, data[at:at + size]
            at += size


def read_character_map(blob: bytes) -> dict[str, str]:
    """Key and replacement of every entry of a compiled character map.

    The map is the size of a double-array trie, the trie's 32-bit units, and the replacements with a zero byte after each. All keys are read by
    walking the trie once, so that the texts need no walk in Python.
    """
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size:]

    def child_base(node: int) -> int:
        unit = units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    found, left = {}, [(child_base(0), b"")]
    while left:
        base, key = left.pop()
        for byte in range(1, 256):
            node = base ^ byte
            if node < len(units) and units[node] & 0x800000FF == byte:
                below = child_base(node)
                if units[node] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    found[(key + bytes([byte])).decode()] = strings[start:strings.index(0, start)].decode()
                left.append((below, key + bytes([byte])))
    return found


class Normaliser:
    """Normalised text, and for each of its characters (and its end) the byte of the original text at which it begins."""

    def __init__(self, mapping: dict[str, str], dummy_prefix: bool, trim: bool, escape: bool, suffix: bool):
        self.mapping, self.dummy, self.trim, self.suffix = mapping, dummy_prefix, trim, suffix
        self.space = SPACE if escape else " "
        self.longest: dict[str, list[int]] = {}
        for key in mapping:
            self.longest.setdefault(key[0], []).append(len(key))
        for lengths in self.longest.values():
            lengths.sort(reverse=True)
        self.first = re.compile("[" + "".join(map(re.escape, self.longest)) + "]") if mapping else None

    def key(self, text: str, at: int) -> str:
        """The longest key that the text has at a place, or nothing."""
        return next((key for n in self.longest.get(text[at], ()) if (key := text[at:at + n]) in self.mapping), "")

    def lead(self, text: str) -> int:
        """Where the characters end that become single spaces at the start."""
        at = 0
        while at < len(text):
            key = self.key(text, at)
            if self.mapping.get(key, text[at]) != " ":
                break
            at += len(key) or 1
        return at

    def replaced(self, text: str) -> tuple[str, np.ndarray]:
        """The text after the character map, with the original byte of each character."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=starts[1:])
        if self.first is None:
            return text, starts
        out, places, at = [], [], 0
        while match := self.first.search(text, at):
            begin = match.start()
            size = len(key := self.key(text, begin))
            kept = begin if size else begin + 1
            out.append(text[at:kept])
            places.append(starts[at:kept])
            if size:
                new = self.mapping[key]
                out.append(new)
                places.append(np.full(len(new), starts[begin], np.int64))
            at = kept + size
        out.append(text[at:])
        places.append(starts[at:])
        return "".join(out), np.concatenate(places)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        begin = self.lead(text) if self.trim else 0
        if begin == len(text):
            return "", np.zeros(1, np.int64)
        done, starts = self.replaced(text)
        at = len(text[:begin].encode("utf-8", "surrogatepass"))
        if self.trim:  # no space at the start or after another
            is_space = np.frombuffer(done.encode("utf-32-le"), np.uint32) == 32
            places = np.flatnonzero(~(is_space & np.concatenate(([True], is_space[:-1]))[:len(done)]))
            done, starts = "".join(map(done.__getitem__, places.tolist())), starts[np.append(places, len(done))]
        done = done.replace(" ", self.space)
        if self.dummy and not self.suffix:
            done, starts = self.space + done, np.concatenate(([at], starts))
        if self.trim:  # a character that looks like an escaped space is taken for one here, as in the library
            done = done.rstrip(self.space)
            starts = starts[:len(done) + 1]
        if self.dummy and self.suffix:
            done, starts = done + self.space, np.concatenate((starts, starts[-1:]))
        return done, starts


def field(number: int, value: bytes) -> bytes:
    """A bytes field of a message."""
    size, length = bytearray(), len(value)
    while length > 127:
        size.append(length & 127 | 128)
        length >>= 7
    return bytes([number << 3 | 2, *size, length]) + value


class PieceModel:
    """Encoder and decoder of a model file; see the module."""

    def __init__(self, data: bytes):
        import sentencepiece

        normaliser, trainer, pieces, rest = {}, {}, [], b""
        for number, value in message(data):
            if number == 1:
                pieces.append(dict(message(value)))
            elif number == 2:
                trainer = dict(message(value))
            if number == 3:
                normaliser = dict(message(value))
            elif isinstance(value, bytes):
                rest += field(number, value)
        names, kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or not trainer.get(35) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte pieces and without user-defined or unused ones can be encoded")
        self.normalise = Normaliser(read_character_map(normaliser.get(2, b"")), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)),
                                    bool(normaliser.get(5, 1)), bool(trainer.get(24, 0)))
        # The same pieces behind a normaliser that changes nothing: it merges what has been normalised here.
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=rest + field(3, field(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])))
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=data)
        byte = np.array([int(n[3:5], 16) if k == BYTE else -1 for n, k in zip(names, kinds)])
        self.sizes = np.where(byte < 0, np.fromiter(map(len, names), np.int64, len(names)), 1)
        self.inner = (byte >= 0x80) & (byte < 0xC0)  # bytes that continue a character
        self.is_byte = byte >= 0

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end of each piece in the bytes of the text."""
        done, starts = self.normalise(text)
        ids = np.asarray(self.merger.encode(done), np.int32)
        sizes = self.sizes[ids]
        # Of the byte pieces of a character only the last one stands for it.
        followed = np.append(self.inner[ids[1:]], False)[:len(ids)]
        sizes[self.is_byte[ids] & followed] = 0
        ends = np.cumsum(sizes)
        return ids, starts[ends - sizes], starts[ends]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id``, ``ids``, the byte spans ``begins`` and ``ends`` of the pieces, and the text ``decoded`` from the ids, of every row.

    ``model`` is the path of a model file on the executors; without it they look up the installed public one.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(model or default_model())
        for batch in batches:
            for first, last in bounded(batch["text"], 500_000):
                out = []
                for text in batch["text"].iloc[first:last]:
                    ids, begins, ends = pieces.encode(text if isinstance(text, str) else "")
                    out.append((ids, begins.astype(np.int32), ends.astype(np.int32), pieces.decoder.decode(ids.tolist())))
                got = pd.DataFrame(out, columns=["ids", "begins", "ends", "decoded"])
                got.insert(0, "doc_id", batch["doc_id"].iloc[first:last].astype("Int64").to_numpy())
                yield got

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, SCHEMA)
