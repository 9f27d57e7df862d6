"""Orthography, tokens and letter case (OP-20 to OP-34).

Plain functions over strings, and Arrow wrappers that run them over columns.
A text is tokenised in two steps: every code point is mapped to a one-letter
class, and one regular expression over the string of classes finds the tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.runtime import prepare

# Latin letters that look like Cyrillic ones, and letter maps of the two rule sets.
HOMOGLYPHS = dict(zip("AaBCcEeHKkMOoPpTXxyY", "АаВСсЕеНКкМОоРрТХхуУ", strict=True))
MODERN_LETTERS = {"‐": "-"}
PREREFORM_LETTERS = {"ѣ": "е", "і": "и", "ѵ": "и", "ѳ": "ф", "ѡ": "о", "ꙋ": "у", "ѹ": "у", "ѧ": "я", "ѯ": "кс", "ѱ": "пс", "‐": "-"}


@dataclass(frozen=True)
class Rules:
    """An orthography rule set (DM-1)."""

    name: str
    version: str
    letters: dict[str, str] = field(hash=False)
    homoglyphs: dict[str, str] = field(hash=False)
    keep_marks: frozenset[str] = frozenset("й")
    drop_final_hard_sign: bool = False

    @property
    def label(self) -> str:
        return f"{self.name}-{self.version}"


MODERN = Rules("modern", "3", MODERN_LETTERS, HOMOGLYPHS)
PREREFORM = Rules("prereform", "3", PREREFORM_LETTERS, HOMOGLYPHS | {"i": "і", "I": "І"}, drop_final_hard_sign=True)
RULES = {r.name: r for r in (MODERN, PREREFORM)}

_CYRILLIC = regex.compile(r"\p{Script=Cyrillic}")
_LATIN = regex.compile(r"\p{Script=Latin}")
_BREAKS = "\n\r\v\f\x85\u2028\u2029"
_BREAK = re.compile(f"\r\n|[{_BREAKS}]")


def _class_of(c: str) -> str:
    cat = unicodedata.category(c)
    if c in _BREAKS:
        return "n"
    if c == "\u200b" or c.isspace() or cat[0] == "Z":
        return "s"
    if c == "\u200d":
        return "z"
    if cat[0] == "M" or cat == "Cf" or "\U0001f3fb" <= c <= "\U0001f3ff":
        return "x"
    if cat == "Cc":
        return "s"
    if "0" <= c <= "9":
        return "d"
    if cat[0] == "L":
        return "C" if _CYRILLIC.match(c) else "L"
    if c in "-‐":
        return "h"
    if c in ".!?;…":
        return "e"
    if cat[0] == "P":
        return "p"
    if "\U0001f1e6" <= c <= "\U0001f1ff":
        return "r"
    return "o" if cat == "So" else "y"


class _Classes(dict):
    """Class of a character, by itself or, for ``str.translate``, by its number."""

    def __missing__(self, c: str | int) -> str:
        v = self[c] = _class_of(chr(c) if isinstance(c, int) else c)
        return v


CLASSES = _Classes()
_EXT = "(?:[xz]|(?<=z)[or])*"
_TOKEN = re.compile(
    f"(?P<word>C{_EXT}(?:C{_EXT}|h(?=C))*|L{_EXT}(?:L{_EXT}|h(?=L))*)|(?P<number>(?:d{_EXT})+)|(?P<punct>[peh]{_EXT})|(?P<symbol>(?:rr?|[oy]){_EXT})"
)
_MIXED = re.compile(r"[LCxz]*(?:L[xz]*C|C[xz]*L)[LCxz]*")


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def homoglyph(rules: Rules, c: str) -> str | None:
    """The Cyrillic letter that a Latin one stands for, with or without marks."""
    if c in rules.homoglyphs:
        return rules.homoglyphs[c]
    if c < "\x80":
        return None
    d = unicodedata.normalize("NFD", c)
    return rules.homoglyphs.get(d[0]) if len(d) > 1 and all(map(_is_mark, d[1:])) else None


def folds(rules: Rules, part: str) -> bool:
    """Whether a word part has a Cyrillic letter and only homoglyphs beside (OP-22)."""
    kinds = [(c, CLASSES[c]) for c in part]
    return any(k == "C" for _, k in kinds) and all(homoglyph(rules, c) for c, k in kinds if k == "L")


def _fold(rules: Rules, text: str) -> str:
    cls = "".join(map(CLASSES.__getitem__, text))
    if "L" not in cls or "C" not in cls:
        return text
    # emoji modifiers extend a cluster but are no part of a word
    cls = "".join("y" if "\U0001f3fb" <= c <= "\U0001f3ff" else k for c, k in zip(text, cls, strict=True))
    out = list(text)
    for m in _MIXED.finditer(cls):
        if folds(rules, text[m.start() : m.end()]):
            for i in range(m.start(), m.end()):
                out[i] = homoglyph(rules, out[i]) or out[i]
    return "".join(out)


def orthography(rules: Rules, text: str) -> str:
    """The comparison spelling of a text (OP-20)."""
    if text.isascii():
        return "".join(c for c in text.lower())
    out = []
    for c in _fold(rules, unicodedata.normalize("NFC", text)):
        low = c.lower()
        c = low if len(low) == 1 else low[0]  # code point by code point, without context
        if c in rules.keep_marks:
            out.append(c)
        elif not (_is_mark(c) or unicodedata.category(c) == "Cf"):
            out += [rules.letters.get(x, x) for x in unicodedata.normalize("NFD", c) if not _is_mark(x)]
    return "".join(out)


def normalize_word(rules: Rules, word: str) -> str:
    """Orthography, without the final hard sign of each hyphen part where the rules say so (OP-21)."""
    s = orthography(rules, word)
    return re.sub("ъ(?=-|$)", "", s.replace("\n", "\n")) if rules.drop_final_hard_sign and "ъ" in s else s


def reform_variants(form: str) -> list[str]:
    """Modern spellings of a pre-reform adjective ending, in the order to try (OP-23)."""
    stem, end = form[:-3], form[-3:]
    if end == "яго":
        return [stem + "его"]
    if end == "аго":
        return [stem + x for x in (("ого", "его") if stem[-1:] and stem[-1:] in "жшчщ" else ("ого",))]
    stem, end = form[:-2], form[-2:]
    if end == "ыя":
        return [stem + "ые", stem + "ой"]
    if end == "ия":
        return [stem + "ие", stem + ("ой" if stem[-1:] and stem[-1:] in "кгх" else "ей")]
    return []


def reform_variants_sql(form: str) -> str:
    """The same as an expression over a column."""
    s2, s3 = f"left({form}, char_length({form}) - 2)", f"left({form}, char_length({form}) - 3)"
    return f"""case when endswith({form}, 'яго') then array(concat({s3}, 'его'))
        when endswith({form}, 'аго') then if({s3} rlike '[жшчщ]$', array(concat({s3}, 'ого'), concat({s3}, 'его')), array(concat({s3}, 'ого')))
        when endswith({form}, 'ыя') then array(concat({s2}, 'ые'), concat({s2}, 'ой'))
        when endswith({form}, 'ия') then array(concat({s2}, 'ие'), concat({s2}, if({s2} rlike '[кгх]$', 'ой', 'ей')))
        else cast(array() as array<string>) end"""


def case_of(raw: str) -> str:
    """none, lower, title, upper or mixed (OP-24)."""
    marks = "".join({"Lu": "U", "Ll": "l"}.get(unicodedata.category(c), "-" if c in "-‐" else "") for c in raw)
    letters = marks.replace("-", "")
    if not letters:
        return "none"
    if "U" not in letters:
        return "lower"
    if "l" not in letters and len(letters) > 1:
        return "upper"
    parts = [p for p in marks.split("-") if p]
    return "title" if letters[0] == "U" and letters.count("U") == 1 or all(p[0] == "U" and "U" not in p[1:] for p in parts) else "mixed"


def case_of_sql(raw: str) -> str:
    bare = rf"regexp_replace({raw}, '[^\\p{{Lu}}\\p{{Ll}}]', '')"
    parts = rf"regexp_replace(regexp_replace({raw}, '‐', '-'), '[^\\p{{Lu}}\\p{{Ll}}-]', '')"
    return rf"""case when {bare} = '' then 'none' when not {bare} rlike '\\p{{Lu}}' then 'lower'
        when not {bare} rlike '\\p{{Ll}}' and char_length({bare}) > 1 then 'upper'
        when {bare} rlike '^\\p{{Lu}}\\p{{Ll}}*$' or {parts} rlike '^-*\\p{{Lu}}\\p{{Ll}}*(-+\\p{{Lu}}\\p{{Ll}}*)*-*$' then 'title' else 'mixed' end"""


def utf16_offsets(text: str, offsets: list[int]) -> list[int]:
    """UTF-16 offsets of byte offsets, in any order (OP-25); one inside a code point counts it."""
    raw = text.encode("utf-8")
    out = []
    for o in offsets:
        if not 0 <= o <= len(raw):
            raise ValueError(f"byte offset {o} out of range [0, {len(raw)}]")
        while o < len(raw) and raw[o] & 0xC0 == 0x80:
            o += 1
        out.append(len(raw[:o].decode("utf-8").encode("utf-16-le")) // 2)
    return out


#: A token (DM-3) as the columns of its struct.
TOKEN_FIELDS = ("raw", "form", "start", "end", "rune_start", "rune_end", "kind", "script", "case", "dotted", "sentence_end")
TOKEN_TYPE = "struct<raw:string,form:string,start:int,end:int,rune_start:int,rune_end:int,kind:string,script:string,case:string,dotted:boolean,sentence_end:boolean>"


def classes_of(rules: Rules, text: str) -> str:
    """A letter for each code point; Latin letters of folded parts count as Cyrillic (OP-31)."""
    cls = text.translate(CLASSES)
    if "L" in cls and "C" in cls:
        for m in _MIXED.finditer(cls):
            if folds(rules, text[m.start() : m.end()]):
                cls = cls[: m.start()] + m[0].replace("L", "C") + cls[m.end() :]
    return cls


def tokenize(rules: Rules, text: str) -> list[tuple]:
    """Tokens in order, as tuples of ``TOKEN_FIELDS`` (OP-30 to OP-34)."""
    cls = classes_of(rules, text)
    ascii_only = text.isascii()
    out: list[list] = []
    byte = at = 0  # byte offset of code point ``at``

    def gap(lo: int, hi: int) -> None:
        if out and "n" in cls[lo:hi]:
            part = text[lo:hi]
            if "\u2029" in part or len(_BREAK.findall(part)) >= 2:
                out[-1][10] = True

    for m in _TOKEN.finditer(cls):
        lo, hi = m.span()
        gap(at, lo)
        raw = text[lo:hi]
        start = byte + (lo - at if ascii_only else len(text[at:lo].encode("utf-8")))
        byte = start + (hi - lo if ascii_only else len(raw.encode("utf-8")))
        at = hi
        kind = m.lastgroup
        if kind == "word":
            script = "cyrillic" if cls[lo] == "C" else "latin" if ascii_only or all(_LATIN.match(c) for c in raw if CLASSES[c] == "L") else "mixed"
            out.append([raw, normalize_word(rules, raw), start, byte, lo, hi, kind, script, case_of(raw), text[hi : hi + 1] == ".", False])
        else:
            form = "".join(c for c in raw if "0" <= c <= "9") if kind == "number" else ""
            out.append([raw, form, start, byte, lo, hi, kind, "none", "none", False, cls[lo] == "e"])
    gap(at, len(text))
    return [tuple(t) for t in out]


def split_hyphen(token: tuple) -> list[tuple]:
    """Parts of a hyphenated word token with their own offsets; none for other tokens (OP-26)."""
    raw, form, start, _, rune, _, kind, script, _, dotted, ends = token
    raws, forms = re.split("[-‐]", raw), re.split("[-‐]", form)
    if kind != "word" or len(raws) < 2 or len(raws) != len(forms):
        return []
    out, at = [], 0
    for i, (r, f) in enumerate(zip(raws, forms, strict=True)):
        b = start + len(raw[:at].encode("utf-8"))
        last = i == len(raws) - 1
        out.append((r, f, b, b + len(r.encode("utf-8")), rune + at, rune + at + len(r), "word", script, case_of(r), dotted and last, ends and last))
        at += len(r) + 1
    return out


# --------------------------------------------------------------------------
# columns

_ARROW = dict(zip(TOKEN_FIELDS, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()], strict=True))
_SQL = dict(x.split(":") for x in TOKEN_TYPE[7:-1].split(","))
_KINDS = ["word", "number", "punct", "symbol"]
#: Kind of a token by the class of its first code point.
_KIND_OF = np.full(128, 3, np.int8)
for _letters, _kind in (("CL", 0), ("d", 1), ("peh", 2)):
    for _c in _letters:
        _KIND_OF[ord(_c)] = _kind
_END = ord("e")
#: Words whose spelling, script and case a task remembers.
WORDS = 1 << 16


class Words(dict):
    """(form, script, case) of recent word tokens by their raw text; it alone decides them."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def __missing__(self, raw: str) -> tuple[str, str, str]:
        if len(self) >= WORDS:
            self.clear()
        cyrillic = any(CLASSES[c] == "C" for c in raw)
        script = "cyrillic" if cyrillic else "latin" if raw.isascii() or all(_LATIN.match(c) for c in raw if CLASSES[c] == "L") else "mixed"
        v = self[raw] = (normalize_word(self.rules, raw), script, case_of(raw))
        return v


_MARK = ("", "none", "none")


def _number(raw: str) -> tuple[str, str, str]:
    return "".join(c for c in raw if "0" <= c <= "9"), "none", "none"


def _byte_offsets(text: str, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets of code-point offsets."""
    if text.isascii():
        return offsets
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[offsets]


def _breaks(text: str, cls: str, spans: np.ndarray) -> list[int]:
    """Tokens that a paragraph break follows: two line breaks or a paragraph separator before the next token."""
    out, seen = [], set()
    at = cls.find("n")
    while at >= 0:
        i = int(np.searchsorted(spans[:, 0], at)) - 1  # the token before
        if i >= 0 and i not in seen:
            seen.add(i)
            part = text[spans[i, 1] : spans[i + 1, 0] if i + 1 < len(spans) else len(text)]
            if "\u2029" in part or len(_BREAK.findall(part)) >= 2:
                out.append(i)
        at = cls.find("n", at + 1)
    return out


def _columns_of(rules: Rules, text: str, want: set[str], words: Words) -> dict[str, list | np.ndarray]:
    """The wanted columns of a text's tokens; kinds as numbers."""
    cls = text.translate(CLASSES)
    if "L" in cls and "C" in cls:
        cls = classes_of(rules, text)
    spans = np.array([m.span() for m in _TOKEN.finditer(cls)], np.int32).reshape(-1, 2)
    lo, hi = spans[:, 0], spans[:, 1]
    codes = np.frombuffer(cls.encode("ascii"), np.uint8)
    first = codes[lo]
    kind = _KIND_OF[first]
    out = {"kind": kind, "rune_start": lo, "rune_end": hi}
    spelled = want & {"form", "script", "case"}
    if "raw" in want or spelled:
        out["raw"] = raws = [text[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    if spelled:
        got = [words[r] if k == 0 else _number(r) if k == 1 else _MARK for r, k in zip(raws, kind.tolist(), strict=True)]
        out |= {f: [x[i] for x in got] for i, f in enumerate(("form", "script", "case")) if f in want}
    if "start" in want or "end" in want:
        at = _byte_offsets(text, spans)
        out["start"], out["end"] = at[:, 0], at[:, 1]
    if "dotted" in want:
        out["dotted"] = dots = np.zeros(len(lo), bool)
        for i in np.flatnonzero((kind == 0) & (np.append(codes, 0)[hi] == _END)).tolist():
            dots[i] = text[hi[i]] == "."
    if "sentence_end" in want:
        out["sentence_end"] = stop = (kind != 0) & (first == _END)
        if "n" in cls and len(lo):
            stop[_breaks(text, cls, spans)] = True
    return out


def token_rows(rules: Rules, text: str, words: Words | None = None) -> list[tuple]:
    """``tokenize``, faster: what does not depend on a word's spelling is found for all tokens at once."""
    cols = _columns_of(rules, text, set(TOKEN_FIELDS), Words(rules) if words is None else words)
    cols["kind"] = [_KINDS[k] for k in cols["kind"].tolist()]
    return list(zip(*(c if isinstance(c := cols[f], list) else c.tolist() for f in TOKEN_FIELDS), strict=True))


def token_columns(rules: Rules, texts: Iterable[str | None], fields: Iterable[str], words: Words | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(list offsets, a flat array for each of ``fields``) of the tokens of texts; equal to ``tokenize`` text by text."""
    want, words = set(fields), Words(rules) if words is None else words
    held: dict[str, list] = {f: [] for f in want}
    ends = [0]
    for text in texts:
        cols = _columns_of(rules, text or "", want, words)
        ends.append(ends[-1] + len(cols["kind"]))
        for f in want:
            if isinstance(cols[f], list):
                held[f] += cols[f]
            else:
                held[f].append(cols[f])
    out = {}
    for f in want:
        if f in ("raw", "form", "script", "case"):
            out[f] = pa.array(held[f], pa.string())
        else:
            flat = np.concatenate(held[f]) if held[f] else np.zeros(0, np.int8)
            out[f] = pa.DictionaryArray.from_arrays(pa.array(flat, pa.int8()), pa.array(_KINDS)).cast(pa.string()) if f == "kind" else pa.array(flat).cast(_ARROW[f])
    return np.array(ends, np.int32), out


def _tokens(name: str, keep: list[str], fields: tuple[str, ...]):
    def run(batches):
        rules = RULES[name]
        words = Words(rules)
        for b in batches:
            ends, cols = token_columns(rules, (t.as_py() for t in b.column("text")), fields, words)
            flat = pa.StructArray.from_arrays([cols[f] for f in fields], list(fields))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*keep, "tokens"])

    return run


def with_tokens(docs: DataFrame, rules: Rules = PREREFORM, keep: list[str] | None = None, text_col: str = "text", fields: tuple[str, ...] = TOKEN_FIELDS) -> DataFrame:
    """The columns ``keep`` and ``tokens``, an array of token structs; one Arrow pass, no exchange.

    Only ``fields`` of the tokens are made: a plan should name those that it reads.
    """
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = docs.select(*(F.col(c) for c in keep if c != "text"), F.col(text_col).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = ",".join(f"{f}:{_SQL[f]}" for f in fields)
    return rows.mapInArrow(_tokens(rules.name, keep, tuple(fields)), "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"tokens array<struct<{made}>>")


def explode_tokens(tokens: DataFrame) -> DataFrame:
    """One row per token, with ``idx`` from 0."""
    rest = [c for c in tokens.columns if c != "tokens"]
    return tokens.select(*rest, F.posexplode("tokens").alias("idx", "t")).select(*rest, "idx", "t.*")


def _counted(name: str):
    def run(batches):
        rules = RULES[name]
        words = Words(rules)
        for b in batches:
            ends, cols = token_columns(rules, (t.as_py() for t in b.column("text")), ("kind", "form"), words)
            forms = pc.if_else(pc.equal(cols["kind"], "word"), cols["form"], None).dictionary_encode()
            code = forms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[code >= 0]
            code, size = code[code >= 0], len(forms.dictionary)
            docs = np.bincount(np.unique(row * max(1, size) + code) % max(1, size), minlength=size)
            yield pa.RecordBatch.from_arrays([forms.dictionary, pa.array(np.bincount(code, minlength=size)), pa.array(docs)], ["form", "n", "docs"])

    return run


def form_counts(docs: DataFrame, rules: Rules = PREREFORM, text_col: str = "text") -> DataFrame:
    """(form, n, docs) of all words: how often each form occurs and in how many rows; summed in each Arrow batch before the exchange."""
    prepare(docs.sparkSession)
    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(rules.name), "form string, n long, docs long")
    return part.groupBy("form").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _mapped(name: str, what: str, keep: list[str]):
    def run(batches):
        f = {"orthography": orthography, "word": normalize_word}[what]
        rules = RULES[name]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([None if x is None else f(rules, x) for x in b.column("text").to_pylist()], pa.string())], [*keep, "out"])

    return run


def normalized(df: DataFrame, col: str, out: str, rules: Rules = PREREFORM, word: bool = True) -> DataFrame:
    """The frame with ``out``, the normal form of ``col``: computed once per distinct value and joined back."""
    prepare(df.sparkSession)
    own = df.select(F.col(col).alias("text")).where(F.col(col).isNotNull()).distinct()
    got = own.mapInArrow(_mapped(rules.name, "word" if word else "orthography", ["text"]), "text string, out string")
    return df.join(got.select(F.col("text").alias(col), F.col("out").alias(out)), col, "left")


def fast_tokens(text: Column) -> Column:
    """Raw tokens by SQL alone; equal to ``tokenize`` for texts without marks, symbols in clusters and mixed scripts."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+(?:-\p{L}+)*|[0-9]+|[^\p{L}0-9\s]"), F.lit(0))
