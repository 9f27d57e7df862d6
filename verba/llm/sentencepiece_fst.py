"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file:

* the *normaliser* (``Normaliser``): two states, with arcs that write the dummy
  prefix before a text and the space mark for a space;
* the *pieces* (``Pieces``): a trie whose arcs read characters and whose accepting
  states write a piece's id, with a byte fallback arc for each character that is no
  piece, which writes the ids of its UTF-8 bytes;
* the *weights* (``Weights``): an acceptor with a state for each piece.  The model
  file is of the BPE kind, whose segmentation is not the path of greatest added
  score.  But a sequence of pieces is the model's segmentation exactly if each two
  neighbours are left alone when they are merged on their own: merges inside two
  neighbours happen in the order of the whole, so a merge across a border would
  show there too.  The arc from one piece to the next weighs 0 if the pair is so,
  and infinity (no arc) if not.

An input is composed with the three; states of the composition are (place, last
piece).  Its path of least weight in the tropical semiring, where weights along a
path are added and the least sum is taken, is the encoding.  The composition is
expanded while the path is searched (``Transducer.shortest``), least sum first.

No piece has the space mark after another character, and none holds a line feed,
so the composition falls into independent parts there, and again before marks at a
part's end if no piece crosses that border.  The rest of a path is itself a
sequence of pieces whose neighbours are left alone, so it is the model's
segmentation of what it reads, whatever came before.  The paths of recent parts and
of their ends are remembered within a partition, in bounded memory, and a search
stops where a known end begins.  Other models (not BPE, with
a character map, without byte fallback, or with pieces across those borders) are
refused with ``ValueError``.

Defined results: a null or empty text has no ids and decodes to the empty text;
null ids and repeated rows stay, one output row per input row; an empty table
gives no rows; a very long text, or one long part without spaces, is encoded whole;
extra columns are ignored.  Ids outside the vocabulary raise ``IndexError``.
"""

from __future__ import annotations

import re
import string
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm import piece_model
from verba.llm.common import settled
from verba.llm.piece_model import BYTE, CONTROL, SPACE, UNKNOWN, Memo, PieceModel

INF = float("inf")
#: Arcs of the acceptor, and histories of pieces, that a worker remembers.
ARCS, HISTORIES = 1 << 18, 1 << 14
#: Characters of a part's end whose path is remembered at most, and such ends of a generation.
END, ENDS = 24, 1 << 16
#: Marks at the end of words, and how many runs of them are remembered.
MARKS, RUNS = string.punctuation, 1 << 12
#: Characters of lines whose parts are looked up at once.
GROUP = 1 << 18
#: Ids that are held until their rows are written.
HELD = 1 << 18


def history(piece: str, score: dict[str, float]) -> list[tuple[float, str, str]] | None:
    """The model's own merges on ``piece`` alone: before each its score, the first and the last symbol; at the end the piece.

    The best pair merges first, the leftmost among equals; none if they do not end as one piece.
    """
    symbols, out = list(piece), []
    pairs = [score.get(symbols[i] + symbols[i + 1]) for i in range(len(symbols) - 1)]
    while pairs:
        best, at = None, -1
        for i, s in enumerate(pairs):
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return None
        out.append((best, symbols[0], symbols[-1]))
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = score.get(symbols[at - 1] + symbols[at])
        if at < len(pairs):
            pairs[at] = score.get(symbols[at] + symbols[at + 1])
    return [*out, (-INF, piece, piece)]


def left_alone(left: list, right: list, score: dict[str, float]) -> bool:
    """Whether the model's merges on two neighbours, given by their histories, end with just these two.

    Until a merge crosses the border, those on either side happen as they do alone.
    The best is next: the left side's among equals, then the one across the border.
    """
    i = j = 0
    while True:
        (a, _, last), (b, first, _) = left[i], right[j]
        across = score.get(last + first)
        if across is not None and across > a and across >= b:
            return False
        if a == b == -INF:
            return True
        if a >= b:
            i += 1
        else:
            j += 1


class Normaliser:
    """Writes the dummy prefix in its first state, and the space mark for each space."""

    def __init__(self, dummy_prefix: bool):
        self.start = SPACE if dummy_prefix else ""

    def write(self, text: str, first: bool) -> str:
        return (self.start if first else "") + text.replace(" ", SPACE)


class Pieces:
    """The trie: a state is (arcs by character, the ways from the root that reach or pass it and accept)."""

    def __init__(self, model: PieceModel):
        #: From here on outputs stand for a single character that is no piece, and is written as bytes.
        self.fallback = len(model.pieces)
        root: dict = {}
        none: dict = {}
        for piece, i in model.ids.items():
            arcs = root
            for c in piece[:-1]:
                arcs = arcs.setdefault(c, [{}, -1])[0]
            arcs.setdefault(piece[-1], [{}, -1])[1] = i
        todo: list[tuple[dict, int, tuple]] = [(root, 1, ())]
        while todo:
            arcs, n, before = todo.pop()
            for c, (after, i) in arcs.items():
                if n == 1 and i < 0:
                    i = self.fallback + ord(c)
                ways = ((n, i), *before) if i >= 0 else before
                arcs[c] = (after or none, ways)
                if after:
                    todo.append((after, n + 1, ways))
        self.root = root

    def arcs(self, text: str) -> tuple[tuple[int, int], ...]:
        """(length, output) of each path from the root that reads the text's start, longest first."""
        arcs, ways = self.root, None
        for c in text:
            state = arcs.get(c)
            if state is None:
                break
            arcs, ways = state
        return ways or ((1, self.fallback + ord(text[0])),)


class Weights:
    """The acceptor over outputs of ``Pieces``; arcs are compiled when they are first met."""

    def __init__(self, model: PieceModel, pieces: Pieces):
        self.model, self.fallback = model, pieces.fallback
        self.start = pieces.fallback + 0x110000
        self.width = self.start + 1
        self.known: dict[int, float] = {}
        self.histories: dict[int, list | None] = {}

    def clear(self) -> None:
        self.known.clear()
        self.histories.clear()

    def name(self, output: int) -> str:
        if output == self.start:
            return ""
        return self.model.pieces[output] if output < self.fallback else chr(output - self.fallback)

    def history(self, output: int) -> list | None:
        if output not in self.histories:
            if len(self.histories) >= HISTORIES:
                self.histories.clear()
            self.histories[output] = history(self.name(output), self.model.score)
        return self.histories[output]

    def arc(self, last: int, output: int) -> float:
        if len(self.known) >= ARCS:
            self.known.clear()
        right = self.history(output)
        if last == self.start or right is None:
            fits = right is not None
        else:
            left = self.history(last)
            fits = left is not None and left_alone(left, right, self.model.score)
        w = self.known[last * self.width + output] = 0.0 if fits else INF
        return w


class Paths(Memo):
    """Ids of recent parts; one that ends with marks falls into what is before them and the marks, unless a piece crosses that border."""

    def __init__(self, transducer: Transducer, lead: str):
        super().__init__(None)
        self.transducer, self.lead, self.inside = transducer, lead, transducer.model.inside

    def made(self, parts: list[str]):
        ids, run, lead, inside, young, old = self.transducer.ids, self.transducer.run, self.lead, self.inside, self.young, self.old
        for part in parts:
            body = part.rstrip(MARKS)
            cut = len(body)
            if cut == len(part) or not cut or part[cut - 1 : cut + 1] in inside or len(part) - cut > END:
                yield part, ids(lead + part)
                continue
            known = young.get(body) or old.get(body)
            if known is None:
                known = young[body] = ids(lead + body)
                self.chars += cut
            yield part, known + run(part[cut:])


class Transducer:
    def __init__(self, model: PieceModel):
        if not (model.newline_splits and model.space_starts):
            raise ValueError("pieces across line feeds or before a space mark")
        self.model = model
        self.normaliser, self.pieces = Normaliser(model.dummy_prefix), Pieces(model)
        self.weights = Weights(model, self.pieces)
        #: Ids of recent parts: with a space mark before them, and as they stand.
        self.spaced, self.plain = Paths(self, SPACE), Paths(self, "")
        #: Ids of recent runs of marks.
        self.run = lru_cache(maxsize=RUNS)(self.ids)
        #: Paths of recent ends of parts, young and old.
        self.ends: dict[str, tuple[int, ...]] = {}
        self.old_ends: dict[str, tuple[int, ...]] = {}
        self.out = [self._written(i) for i in range(len(model.pieces))]
        self.id_bytes = [struct.pack("<i", i) for i in range(len(model.pieces))]
        self.longest = model.longest
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def forget(self) -> None:
        """Drop what is remembered between texts."""
        self.spaced.clear()
        self.plain.clear()
        self.run.cache_clear()
        self.ends, self.old_ends = {}, {}
        self.weights.clear()

    # -- composition and shortest path ---------------------------------------
    def shortest(self, part: str) -> list[int]:
        """The outputs along the path of least weight through the composition with ``part``.

        Dijkstra's search: the open state of least sum is expanded first, the one
        entered last among equals.  As arcs weigh 0 or infinity, all open states
        have the sum 0 and the queue is a stack; the first path that reads the whole
        part is a shortest one.  States are expanded once, and those before a
        remembered end of a part not at all: the path goes on as the end's own, or
        if the arc to that weighs infinity, not at all (see the module's head).
        """
        arcs, known, weigh, width, n = self.pieces.arcs, self.weights.known, self.weights.arc, self.weights.width, len(part)
        ends, old_ends, longest = self.ends, self.old_ends, self.longest
        path: list[int] = []
        ways: list = []
        done: set[tuple[int, int]] = set()
        last, at = self.weights.start, 0
        left = iter(arcs(part[:longest]) if n else ())
        while at < n:
            row = last * width
            for size, output in left:
                w = known.get(row + output)
                if (weigh(last, output) if w is None else w) == 0.0 and (not done or (at + size, output) not in done):
                    break
            else:
                piece = path.pop()
                done.add((at, piece))
                at, left = ways.pop()
                last = path[-1] if path else self.weights.start
                continue
            path.append(output)
            ways.append((at, left))
            at, last = at + size, output
            if n - at <= END:
                if at == n:
                    break
                end = ends.get(part[at:]) or old_ends.get(part[at:])
                if end:
                    w = known.get(last * width + end[0])
                    if (weigh(last, end[0]) if w is None else w) == 0.0:
                        path += end
                        break
                    left = iter(())
                    continue
            left = iter(arcs(part[at : at + longest]))
        for k in range(len(ways) - 1, 0, -1):
            at = ways[k][0]
            if n - at > END:
                break
            ends[part[at:]] = tuple(path[k:])
        if len(ends) >= ENDS:
            self.ends, self.old_ends = {}, ends
        return path

    def ids(self, part: str) -> bytes:
        """The path's ids as 32-bit integers, little-endian."""
        fallback, id_bytes, path = self.pieces.fallback, self.id_bytes, self.shortest(part)
        if path and max(path) >= fallback:
            return b"".join([id_bytes[i] for x in path for i in ([x] if x < fallback else [self.model.byte_ids[b] for b in chr(x - fallback).encode("utf-8")])])
        return b"".join([id_bytes[x] for x in path])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        spaced: list[str] = []
        plain: list[str] = []
        held: list[tuple[Memo, list[str]]] = []

        def write() -> None:
            known = {self.spaced: self.spaced.of(spaced), self.plain: self.plain.of(plain)}
            for memo, parts in held:
                out.extend(map(known[memo].__getitem__, parts))
            for x in (spaced, plain, held):
                x.clear()

        size = 0
        for k, line in enumerate(text.split("\n")):
            first = k == 0
            lead = [] if first else ["\n"]
            parts: list[str] = []
            if not line:
                if first and self.normaliser.start:
                    lead = [self.normaliser.start]
            elif "  " in line or SPACE in line or line[0] == " " or line[-1] == " ":
                lead += self.parts.findall(self.normaliser.write(line, first))
            else:
                parts = line.split(" ")  # the normaliser writes a mark before each of these
                if not (first and self.normaliser.start):
                    lead.append(parts.pop(0))
            if lead:
                plain += lead
                held.append((self.plain, lead))
            if parts:
                spaced += parts
                held.append((self.spaced, parts))
            size += len(line)
            if size >= GROUP:
                write()
                size = 0
        write()
        return np.frombuffer(b"".join(out), "<i4")

    # -- the inverse -------------------------------------------------------------
    def _written(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def compiled(path: str) -> Transducer:
    return Transducer(piece_model.load(path))


def _run(path: str, decoded: bool):
    def rows(keys: pa.Array, ends: list[int], ids: list[np.ndarray], back: list[str]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        cols, names = [keys, lists, pc.list_value_length(lists).cast(pa.int64())], ["id", "ids", "n_tokens"]
        if decoded:
            cols.append(pa.array(back, pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        t = compiled(path)
        t.forget()  # a task before may have been cut short
        for b in batches:
            start, ends, ids, back = 0, [0], [], []
            for k, text in enumerate(b.column(1), 1):
                i = t.encode(text.as_py())
                ids.append(i)
                ends.append(ends[-1] + len(i))
                if decoded:
                    back.append(t.decode(i))
                if ends[-1] >= HELD or k == b.num_rows:
                    yield rows(b.column(0).slice(start, k - start), ends, ids, back)
                    start, ends, ids, back = k, [0], [], []
        t.forget()

    return settled(run)


def encode_documents(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens[, decoded]) of each row's whole text; one row per input row, extra columns are ignored."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run(path, decoded), f"id {kind}, ids array<int>, n_tokens long" + (", decoded string" if decoded else ""))
    return out.withColumnRenamed("id", id_col)


def _decode(path: str):
    def run(batches):
        t = compiled(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["id", "text"])

    return settled(run)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of ids; a null list decodes to the empty text."""
    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decode(path), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
