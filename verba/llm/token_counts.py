"""Token counts by a whole-token shortcut.

Offline, each vocabulary string that starts with the space mark is encoded
alone; those that come out as their own single token are proved.  Pre-tokens
(words between spaces) that are proved count 1 without any merging; only the
rest go to the library, those of many texts in one call, and recent ones are
remembered within a partition, in bounded memory.

Splitting at spaces and line feeds is sound as no piece holds the space mark
after another character, and none holds a line feed beside another character;
both are checked against the model file, and a model that breaks them has its
texts encoded whole.

Defined results: a null text is empty (0 bytes, 0 tokens); null ids and repeated
rows stay, one output row per input row; an empty table gives no rows; a very long
text is counted whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm import piece_model
from verba.llm.common import settled
from verba.llm.piece_model import SPACE, Memo


#: Characters of lines whose pre-tokens are looked up at once: a call of the library for a list starts a thread.
GROUP = 1 << 18


class Counts(Memo):
    """Counts of new strings are made all at once."""

    def made(self, parts: list[str]):
        return self.make(parts) if parts else ()


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = piece_model.load(path)
        self.splits = model.newline_splits and model.space_starts and model.dummy_prefix
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        strings = [p for p in model.ids if p[:1] == SPACE and SPACE not in p[1:] and "\n" not in p and len(p) > 1]
        proofs = self.lib.encode([p[1:] for p in strings], num_threads=1)
        #: The proved vocabulary strings, without their space mark.
        self.proved = {p[1:]: 1 for p, got in zip(strings, proofs, strict=True) if got == [model.ids[p]]}
        #: Counts of recent pre-tokens: with a space mark before them, and after a line feed.
        self.spaced, self.plain = Counts(self._spaced), Counts(self._plain)
        #: Tokens of a line feed, and of the dummy prefix that stands alone before one.
        self.lone = len(self.lib.encode("\n\n")) - 2 * (len(self.lib.encode("\n\n")) - len(self.lib.encode("\n")))
        self.feed = len(self.lib.encode("\n")) - self.lone

    def _spaced(self, parts: list[str]):
        """Proved strings count without merging; the others are merged by the library, all at once."""
        rest = [p for p in parts if p not in self.proved]
        yield from ((p, 1) for p in parts if p in self.proved)
        yield from ((p, len(i)) for p, i in zip(rest, self.lib.encode(rest, num_threads=1), strict=True))

    def _plain(self, parts: list[str]):
        lead = len(self.lib.encode("\n"))
        yield from ((p, len(i) - lead) for p, i in zip(parts, self.lib.encode(["\n" + p.replace(SPACE, " ") for p in parts], num_threads=1), strict=True))

    def forget(self) -> None:
        """Drop what is remembered between texts."""
        self.spaced.clear()
        self.plain.clear()

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """The texts' counts; pre-tokens of many texts are looked up, and new ones merged, in one call."""
        if not self.splits:
            return [len(self.lib.encode(t)) if t else 0 for t in texts]
        totals: list[int] = []
        spaced: list[tuple[int, list[str]]] = []
        plain: list[tuple[int, list[str]]] = []

        def add() -> None:
            for memo, held in ((self.spaced, spaced), (self.plain, plain)):
                known = memo.of([p for _, parts in held for p in parts])
                for i, parts in held:
                    totals[i] += sum(map(known.__getitem__, parts))
                held.clear()

        size = 0
        for i, text in enumerate(texts):
            totals.append(self.feed * text.count("\n") if text else 0)
            for k, line in enumerate(text.split("\n") if text else ()):
                if not line:
                    totals[i] += self.lone if k == 0 else 0
                    continue
                if "  " in line or SPACE in line or line[0] == " " or line[-1] == " ":
                    plain.append((i, self.parts.findall((SPACE if k == 0 else "") + line.replace(" ", SPACE))))
                else:
                    parts = line.split(" ")
                    if k:
                        plain.append((i, parts[:1]))
                        del parts[0]
                    spaced.append((i, parts))
                size += len(line)
                if size >= GROUP:
                    add()
                    size = 0
        add()
        return totals


@lru_cache(maxsize=4)
def compiled(path: str) -> Counter:
    return Counter(path)


def _run(path: str):
    def run(batches):
        c = compiled(path)
        c.forget()  # a task before may have been cut short
        for b in batches:
            text = b.column(1)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(c.counts(t.as_py() for t in text), pa.int64())], ["id", "n_bytes", "n_tokens"])
        c.forget()

    return settled(run)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text; a narrow plan without exchanges."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run(path), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
