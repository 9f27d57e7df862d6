"""Reading of a SentencePiece model file: pieces, scores, kinds and normaliser flags.

Only the wire format of protocol buffers is used, so no generated code is
needed.  A model with a compiled character map is refused: its normaliser is
not the identity with white-space rules that this module compiles.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The visible mark that stands for a space.
SPACE = "▁"


class Memo:
    """What ``make`` gave for recent strings, in bounded memory: a young and an old generation."""

    #: Strings, and characters of them, of a generation.
    MOST, CHARS = 1 << 17, 1 << 21

    def __init__(self, make):
        self.make, self.chars = make, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def clear(self) -> None:
        self.young, self.old, self.chars = {}, {}, 0

    def of(self, parts: list[str]) -> dict:
        """A mapping that has all of ``parts``."""
        if len(self.young) >= self.MOST or self.chars >= self.CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        new = set(parts).difference(self.young)
        if new:
            self.chars += sum(map(len, new))
            lost = [p for p in new if p not in self.old]
            self.young.update((p, self.old[p]) for p in new.difference(lost))
            self.young.update(self.made(lost))
        return self.young

    def made(self, parts: list[str]):
        return ((p, self.make(p)) for p in parts)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        out |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return out, i


def fields(b: bytes):
    """(number, value) of each field of a message; bytes stay bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        wire = tag & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            v, i = b[i : i + n], i + n
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield tag >> 3, v


@dataclass(frozen=True)
class PieceModel:
    """What a BPE piece model holds; ``score`` has the pieces that merges may make."""

    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: tuple[float, ...]
    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    dummy_prefix: bool

    @property
    def longest(self) -> int:
        return max(map(len, self.score), default=1)

    @property
    def newline_splits(self) -> bool:
        """Whether no piece that merges can make holds a line feed beside other characters."""
        return not any("\n" in p and len(p) > 1 for p in self.score)

    @property
    def space_starts(self) -> bool:
        """Whether the space mark only occurs as a leading run of pieces."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.score)

    @property
    def inside(self) -> frozenset[str]:
        """Each two characters that some piece holds side by side; no merge crosses a border between others."""
        return frozenset(p[i : i + 2] for p in self.score for i in range(len(p) - 1))


def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        data = f.read()
    pieces, kinds, scores = [], [], []
    model_type, fallback, dummy, extra, escape, charsmap = 1, False, True, True, True, b""
    for no, v in fields(data):
        if no == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, x in fields(v):
                if n == 1:
                    piece = x.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", x)[0]
                elif n == 3:
                    kind = x
            pieces.append(piece)
            kinds.append(kind)
            scores.append(score)
        elif no == 2:
            for n, x in fields(v):
                if n == 3:
                    model_type = x
                elif n == 35:
                    fallback = bool(x)
        elif no == 3:
            for n, x in fields(v):
                if n == 2:
                    charsmap = x
                elif n == 3:
                    dummy = bool(x)
                elif n == 4:
                    extra = bool(x)
                elif n == 5:
                    escape = bool(x)
    if model_type != 2 or not fallback or charsmap or extra or not escape or {USER, UNUSED} & set(kinds):
        raise ValueError("only BPE piece models with byte fallback and the identity normaliser are compiled")
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
    score = {p: scores[i] for p, i in ids.items()}
    by = {pieces[i]: i for i in range(len(pieces)) if kinds[i] == BYTE}
    return PieceModel(tuple(pieces), tuple(kinds), tuple(scores), ids, score, tuple(by[f"<0x{b:02X}>"] for b in range(256)), kinds.index(UNKNOWN), dummy)
