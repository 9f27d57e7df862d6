"""The document kernel: from terms to spans and facts (OP-66 to OP-69, OP-72 to OP-74, OP-7A, OP-81 to OP-8I).

Only what is sequential within a document is here: matches that overlap, rules
that change what later rules see, and the choice among overlapping spans.  No
Spark is imported, so the kernel runs in any worker.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

from verba.operators.lookup import ABBREV, AMBIGUOUS, PREDICTED, UNKNOWN
from verba.plans.rules import Book, Element

# Span flags (DM-28), entry flags (DM-16), weights (DM-31), keys kept of an alias or a normal form.
SPAN_FLAGS = {"ambiguous": 1, "predicted": 2, "abbrev": 4, "candidate": 8, "nested": 16}
S_AMBIGUOUS, S_PREDICTED, S_ABBREV, S_CANDIDATE, S_NESTED = SPAN_FLAGS.values()
NEEDS_CONTEXT, SURFACE_ONLY, CASE_SENSITIVE, BLOCKED = 1, 2, 4, 8
MOST_KEYS = 8


@dataclass(frozen=True)
class Weights:
    surface: float = 3.0
    lemma: float = 2.0
    trigger: float = 1.0
    length_bonus: float = 0.5
    ambiguity_penalty: float = 0.25
    types: dict[str, float] = field(default_factory=dict, hash=False)


@dataclass(slots=True)
class Term:
    """A token with its lemmas as (text, flags, tag)."""

    raw: str
    form: str
    start: int
    end: int
    rune_start: int
    rune_end: int
    kind: str
    script: str
    case: str
    dotted: bool
    sentence_end: bool
    lemmas: list[tuple[str, int, str]]

    @property
    def content(self) -> bool:
        return self.kind in ("word", "number")

    @property
    def abbreviation_like(self) -> bool:
        return self.dotted and (len(self.raw) == 1 or any(f & ABBREV for _, f, _ in self.lemmas))

    def options(self) -> list[str]:
        """Distinct known lemmas, else the form; none for marks (OP-61)."""
        if not self.content:
            return []
        return list(dict.fromkeys(x for x, f, _ in self.lemmas if not f & UNKNOWN)) or [self.form]


def combine(options: list[list[str]], most: int = MOST_KEYS) -> list[tuple[str, ...]]:
    """The product with the last option fastest, up to a limit (OP-62)."""
    return list(itertools.islice(itertools.product(*options), most))


# -- gazetteer -----------------------------------------------------------------


@dataclass(frozen=True)
class Alias:
    """A compiled alias (DM-17)."""

    id: int
    alias: str
    type: str
    ref: str
    canonical: str
    attrs: tuple[tuple[str, str], ...]
    flags: int
    cases: tuple[str, ...]
    lemma_keys: tuple[tuple[str, ...], ...]
    surface_key: tuple[str, ...]


class Index:
    """Aliases of one source by key, with all starts of keys so that a walk ends early."""

    def __init__(self, aliases: list[Alias]):
        self.lemma: dict[tuple[str, ...], list[Alias]] = defaultdict(list)
        self.surface: dict[tuple[str, ...], list[Alias]] = defaultdict(list)
        for a in aliases:
            for k in a.lemma_keys:
                self.lemma[k].append(a)
            self.surface[a.surface_key].append(a)
        self.starts = [{k[:i] for k in keys for i in range(1, len(k) + 1)} for keys in (self.lemma, self.surface)]
        self.firsts = [{k[0] for k in keys} for keys in (self.lemma, self.surface)]

    def matches(self, text: Text):
        """(start, end, surface, alias): all of a position before the next, by lemmas before by forms."""
        for p, word in enumerate(text.words):
            for surface, (keys, starts, firsts) in enumerate(zip((self.lemma, self.surface), self.starts, self.firsts, strict=True)):
                if firsts.isdisjoint((word.form,) if surface else word.options()):
                    continue
                paths: list[tuple[str, ...]] = [()]
                for q in range(p, len(text.at)):
                    words = [text.words[q].form] if surface else text.words[q].options()
                    paths = [k for path in paths for w in words if (k := (*path, w)) in starts]
                    if not paths:
                        break
                    for path in paths:
                        for a in keys.get(path, ()):
                            yield p, q + 1, bool(surface), a
                    if text.breaks[q]:
                        break


class Text:
    """Content words, breaks between them, and sentences (OP-66)."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.at = [i for i, t in enumerate(terms) if t.content]
        self.words = [terms[i] for i in self.at]
        self.breaks = [not self._joined_to(i, j) for i, j in zip(self.at, [*self.at[1:], None], strict=False)]
        # running count of breaks, so that joined() is one subtraction
        self.sums = [0, *itertools.accumulate(self.breaks)]
        self.sentences, lo = [], 0
        for i, t in enumerate(terms):
            ends = t.sentence_end and not t.abbreviation_like and not (t.raw == "." and i and terms[i - 1].abbreviation_like)
            if ends or i == len(terms) - 1:
                self.sentences.append((lo, i + 1))
                lo = i + 1

    def _joined_to(self, i: int, j: int | None) -> bool:
        if j is None:
            return False
        if self.terms[i].abbreviation_like:
            return all(t.raw == "." for t in self.terms[i + 1 : j])
        return j == i + 1 and not self.terms[i].sentence_end

    def joined(self, p: int, q: int) -> bool:
        """No break between two content positions."""
        return self.sums[q] == self.sums[p]


# -- candidates -----------------------------------------------------------------


@dataclass(eq=False)
class Candidate:
    type: str
    start: int
    end: int
    origin: str = "lemma"
    hits: dict[int, tuple[Alias, bool]] = field(default_factory=dict)
    normals: list[str] | None = None
    flags: int = 0
    bonus: float = 0.0
    context: bool = False
    removed: bool = False
    labelled: bool = False
    replaced: Candidate | None = None
    absorbed: set[int] = field(default_factory=set)
    others: list[Candidate] = field(default_factory=list)
    parts: list[Candidate] = field(default_factory=list)
    evidence: list[str] = field(default_factory=list)
    score: float = 0.0
    order: int = 0

    def refs(self) -> list[str]:
        return sorted({a.ref for a, _ in self.hits.values() if a.ref})

    def normal_forms(self) -> list[str]:
        return sorted(set(self.normals)) if self.normals is not None else sorted({a.canonical for a, _ in self.hits.values()})

    def attrs(self) -> dict[str, str]:
        seen: dict[str, set[str]] = defaultdict(set)
        for a, _ in self.hits.values():
            for k, v in a.attrs:
                seen[k].add(v)
        return {k: min(v) for k, v in sorted(seen.items()) if len(v) == 1}

    def set_origin(self) -> None:
        self.origin = "surface" if any(s for _, s in self.hits.values()) else "lemma"


def points(x: float) -> str:
    return f"{x:+g}"


class Document:
    """One document's run through the stages."""

    def __init__(self, text: str, terms: list[Term], indexes: list[Index], weights: Weights, nesting: dict[str, set[str]], min_lemma_runes: int = 3):
        self.source, self.text, self.weights, self.nesting = text, Text(terms), weights, nesting
        self.cands: list[Candidate] = []
        self.blocked: list[Candidate] = []
        self.facts: list[tuple[str, dict[str, Candidate], str]] = []
        by_range: dict[tuple[int, int, str], Candidate] = {}
        for index in indexes:
            for lo, hi, surface, alias in index.matches(self.text):
                key = (lo, hi, alias.type)
                if key not in by_range:
                    self.add(by_range.setdefault(key, Candidate(alias.type, lo, hi)))
                c = by_range[key]
                c.hits[alias.id] = (alias, surface or c.hits.get(alias.id, (None, False))[1])
        for c in self.cands:
            self._early(c, min_lemma_runes)

    def add(self, c: Candidate) -> Candidate:
        c.order = len(self.cands)
        self.cands.append(c)
        return c

    def _early(self, c: Candidate, least: int) -> None:
        """Blocked aliases, letter case, short lemma matches (OP-82)."""
        if any(a.flags & BLOCKED for a, _ in c.hits.values()):
            c.removed = True
            self.blocked.append(c)
            return
        cases = tuple(t.case for t in self.text.words[c.start : c.end])
        for i, (a, surface) in list(c.hits.items()):
            if a.flags & CASE_SENSITIVE and a.cases != cases or not surface and len(a.surface_key) == 1 and len(a.surface_key[0]) < least:
                del c.hits[i]
        c.removed = not c.hits
        c.set_origin()

    def lemma_normals(self, lo: int, hi: int) -> list[str]:
        return [" ".join(k) for k in combine([t.options() for t in self.text.words[lo:hi]])]

    def vetoed(self, kind: str, lo: int, hi: int) -> bool:
        return any(b.type == kind and b.start < hi and b.end > lo for b in self.blocked)

    # -- hints and triggers ------------------------------------------------------
    def absorb(self, c: Candidate, k: int) -> None:
        if k == c.start - 1 and not self.text.breaks[k]:
            c.start = k
        elif k == c.end and not self.text.breaks[c.end - 1]:
            c.end = k + 1
        else:
            return
        c.absorbed.add(k)

    def near(self) -> dict[int, list[Candidate]]:
        """Candidates by each position they could be reached from: their covered words."""
        out = defaultdict(list)
        for c in self.cands:
            if not c.removed:
                for p in range(c.start, c.end):
                    out[p].append(c)
        return out

    def hints(self, sets) -> None:
        rules = [h for s in sets for h in s.hints]
        if not rules:
            return
        covering = self.near()
        for h in rules:
            for k, word in enumerate(self.text.words):
                if not h.keyword.match(word):
                    continue
                spots = [*(range(k + 1, k + 1 + h.window) if h.dir != "left" else ()), *(range(k - h.window, k) if h.dir != "right" else ())]
                for c in dict.fromkeys(c for p in spots for c in covering.get(p, ())):
                    if c.removed or c.type != h.type:
                        continue
                    right = h.dir != "left" and k < c.start <= k + h.window and self.text.joined(k, c.start)
                    left = h.dir != "right" and c.end <= k < c.end + h.window and self.text.joined(c.end - 1, k)
                    if right or left:
                        c.bonus += h.weight
                        c.context = True
                        c.evidence.append(f"hint «{word.raw}» → {h.type} {points(h.weight)}")
                        if h.absorb:
                            self.absorb(c, k)
                            if k in c.absorbed and c not in covering[k]:
                                covering[k].append(c)

    def reach(self, t, k: int) -> tuple[int, int]:
        """The words that a trigger at ``k`` covers."""
        step = -1 if t.dir == "left" else 1
        p = k
        while 0 <= p + step < len(self.text.words) and abs(p - k) < t.most:
            if self.text.breaks[min(p, p + step)] or not t.accepts(self.text.words[p + step]):
                break
            p += step
        return (p, k) if step < 0 else (k + 1, p + 1)

    def triggers(self, sets) -> None:
        rules = [t for s in sets for t in s.triggers]
        if not rules:
            return
        covering = self.near()
        for t in rules:
            for k, word in enumerate(self.text.words):
                if not t.keyword.match(word):
                    continue
                lo, hi = self.reach(t, k)
                if hi - lo < t.least:
                    continue
                found = [c for c in dict.fromkeys(c for p in range(lo, hi) for c in covering.get(p, ())) if not c.removed and c.type == t.type]
                for c in found:
                    c.bonus += -t.weight if t.negative else t.weight
                    c.evidence.append(f"trigger «{word.raw}» → {t.type} {points(-t.weight if t.negative else t.weight)}")
                    if not t.negative:
                        c.context = True
                        if t.absorb:
                            self.absorb(c, k)
                            if k in c.absorbed and c not in covering[k]:
                                covering[k].append(c)
                if not t.negative and not found and not self.vetoed(t.type, lo, hi):
                    c = self.add(Candidate(t.type, lo, hi, "trigger", normals=self.lemma_normals(lo, hi), flags=S_CANDIDATE, bonus=t.weight, context=True))
                    c.evidence.append(f"trigger «{word.raw}» → {t.type} candidate {points(t.weight)}")
                    if t.absorb:
                        self.absorb(c, k)

    # -- patterns ----------------------------------------------------------------
    def patterns(self, sets) -> None:
        for s in sets:
            for p in s.patterns:
                rule = f"{s.name}/{p.name}"
                for lo, hi in self.text.sentences:
                    for m in list(find_all(p.elements, Lattice(self, lo, hi))):
                        self.act(rule, p.actions, m)

    def at(self, kind: str, lo: int, hi: int) -> Candidate | None:
        return next((c for c in self.cands if not c.removed and (c.type, c.start, c.end) == (kind, lo, hi)), None)

    def act(self, rule: str, actions, m: Found) -> None:
        bound = {r: c for r, (_, _, c) in m.roles.items() if c is not None}
        for kind, a in actions:
            if kind == "emit":
                if all(r in bound for r in a["args"].values()):
                    self.facts.append((a["kind"], {arg: bound[r] for arg, r in a["args"].items()}, rule))
            elif kind == "label":
                if a["role"] in m.roles and (c := self.label(rule, m, *m.roles[a["role"]][:2], a["type"], a["weight"])):
                    bound[a["role"]] = c
            elif (c := bound.get(a["role"])) is not None:
                if kind == "boost":
                    c.bonus += a["weight"]
                    c.context = True
                    c.evidence.append(f"pattern {rule} {points(a['weight'])}")
                else:
                    bound[a["role"]] = self.relabel(rule, c, a["type"], a["weight"])

    def relabel(self, rule: str, c: Candidate, kind: str, w: float) -> Candidate:
        if c.type == kind:
            target, said = c, f"pattern {rule} keeps {kind}"
        elif target := self.at(kind, c.start, c.end):
            said = f"pattern {rule} relabel {c.type} → {kind} (existing)"
            c.removed, c.replaced = True, target
            c.evidence.append(f"relabelled by pattern {rule}")
            target.others.append(c)
        elif self.vetoed(kind, c.start, c.end):
            c.evidence.append(f"pattern {rule}: {kind} is blocked here")
            return c
        else:
            said = f"pattern {rule} relabel {c.type} → {kind}"
            old = Candidate(c.type, c.start, c.end, c.origin, dict(c.hits), c.normals, c.flags, c.bonus, c.context, absorbed=set(c.absorbed), evidence=[*c.evidence, f"relabelled by pattern {rule}"])
            c.others.append(old)
            c.type, c.hits, c.normals, target = kind, {}, self.lemma_normals(c.start, c.end), c
            c.flags |= S_CANDIDATE
        target.bonus += w
        target.context = True
        target.evidence.append(said)
        return target

    def label(self, rule: str, m: Found, lo: int, hi: int, kind: str, w: float) -> Candidate | None:
        a, b = bisect_left(self.text.at, lo), bisect_left(self.text.at, hi)
        if a >= b or self.vetoed(kind, a, b):
            return None
        c = self.at(kind, a, b)
        if c is None:
            c = self.add(Candidate(kind, a, b, "pattern", normals=self.lemma_normals(a, b), flags=S_CANDIDATE, labelled=True))
            said = f"labelled by pattern {rule}"
        else:
            said = f"pattern {rule} keeps {kind}"
        c.bonus += w
        c.context = True
        inside = [x for x in m.spans if x is not c and a <= x.start and x.end <= b]
        for x in inside:
            if not x.context and not x.removed:
                x.context = True
                x.evidence.append(f"pattern {rule} gives context")
        if inside and said.startswith("labelled"):
            c.flags &= ~S_CANDIDATE
        c.evidence.append(said)
        return c

    # -- scores and choice ------------------------------------------------------------
    def context(self) -> None:
        """Aliases that need context lose without it (OP-83)."""
        for c in self.cands:
            if not c.removed and not c.context and c.hits:
                c.hits = {i: h for i, h in c.hits.items() if not h[0].flags & NEEDS_CONTEXT}
                c.removed = not c.hits
                c.set_origin()

    def value(self, c: Candidate) -> float:
        w = self.weights
        own = {"surface": w.surface, "lemma": w.lemma}.get(c.origin, w.trigger) + w.types.get(c.type, 0.0)
        words, readings = c.end - c.start, max(len(c.refs()), len(c.normal_forms()), 1)
        raw = own * words + w.length_bonus * (words - 1) + c.bonus - w.ambiguity_penalty * (readings - 1)
        return (1 if raw >= 0 else -1) * int(abs(raw) * 1e6 + 0.5) / 1e6

    def scores(self) -> None:
        for c in self.cands:
            c.score = self.value(c)
            for o in c.others:
                o.score = self.value(o)

    def choose(self) -> list[tuple[Candidate, bool]]:
        """Chosen candidates, an outer one before its nested ones (OP-85, OP-86)."""
        live = sorted((c for c in self.cands if not c.removed and c.score > 0), key=lambda c: (c.end, c.start, -c.score, c.type, c.order))
        self.alive, self.at_range = {id(c) for c in live}, defaultdict(list)
        for c in live:
            self.at_range[c.start, c.end].append(c)
        ends = [c.end for c in live]
        memo: dict[int, tuple[float, list[Candidate]]] = {}

        def inside(c: Candidate):
            if id(c) not in memo:
                kinds = self.nesting.get(c.type) or ()
                pool = live[bisect_right(ends, c.start) : bisect_right(ends, c.end)] if kinds else []
                fit = [x for x in pool if x is not c and x.type in kinds and x.start >= c.start and (x.end - x.start < c.end - c.start or c.labelled and (not x.labelled or x.order < c.order))]
                memo[id(c)] = best(fit)
            return memo[id(c)]

        def best(cs: list[Candidate]):
            """The selection of greatest value among candidates sorted by end; a later one must be strictly better."""
            stops, tops = [c.end for c in cs], [0.0]
            picks: list[tuple[int, bool]] = []
            for j, c in enumerate(cs):
                p = bisect_right(stops, c.start, 0, j)
                v = c.score + inside(c)[0] + tops[p]
                picks.append((p, v > tops[j]))
                tops.append(max(v, tops[j]))
            out, j = [], len(cs)
            while j:
                p, taken = picks[j - 1]
                if taken:
                    out.append(cs[j - 1])
                j = p if taken else j - 1
            return tops[-1], out[::-1]

        out: list[tuple[Candidate, bool]] = []

        def emit(c: Candidate, nested: bool):
            out.append((c, nested))
            c.parts = inside(c)[1]
            for x in c.parts:
                emit(x, True)

        for c in best(live)[1]:
            emit(c, False)
        return out

    # -- output --------------------------------------------------------------------
    def alternatives(self, c: Candidate, chosen: set[int]) -> list[Candidate]:
        if c.labelled and any((p.start, p.end) == (c.start, c.end) for p in c.parts):
            same = []
        else:
            same = [x for x in self.at_range[c.start, c.end] if x.type != c.type and id(x) not in chosen]
        found = {id(x): x for x in [*c.others, *same] if x.score > 0}
        return sorted(found.values(), key=lambda x: (-x.score, x.type))

    def dot(self, c: Candidate) -> Term | None:
        """The dot after an abbreviation that belongs to a span (OP-8E)."""
        i = self.text.at[c.end - 1]
        last = self.text.terms[i]
        if not last.dotted or i + 1 >= len(self.text.terms) or self.text.terms[i + 1].raw != ".":
            return None
        own = any(f & ABBREV for _, f, _ in last.lemmas) or any(a.alias.endswith(".") for a, _ in c.hits.values())
        return self.text.terms[i + 1] if own or any(p.end == c.end and self.dot(p) for p in c.parts) else None

    def composed(self, c: Candidate) -> str:
        out, p = [], c.start
        parts = {x.start: x for x in reversed(sorted(c.parts, key=lambda x: x.start))}
        while p < c.end:
            x = parts.get(p)
            out += (x.normal_forms() if x else self.lemma_normals(p, p + 1))[:1]
            p = x.end if x else p + 1
        return " ".join(out)

    def span(self, c: Candidate, nested: bool, chosen: set[int]) -> dict:
        words = self.text.words[c.start : c.end]
        last = self.dot(c) or words[-1]
        normal = [self.composed(c)] if c.labelled and c.parts else c.normal_forms()
        refs, others = c.refs(), self.alternatives(c, chosen)
        covered = {p for x in c.parts for p in range(x.start, x.end)} if c.labelled else set()
        flags = c.flags | (S_NESTED if nested else 0)
        tie = [x for x in others if x.score == c.score and id(x) in self.alive]
        if len(refs) > 1 or len(normal) > 1 or tie:
            flags |= S_AMBIGUOUS
        for p, t in enumerate(words, c.start):
            marks = [f for _, f, _ in t.lemmas]
            if any(f & ABBREV for f in marks):
                flags |= S_ABBREV
            if p in covered:
                continue
            if p not in c.absorbed and any(f & ABBREV and f & AMBIGUOUS for f in marks):
                flags |= S_AMBIGUOUS
            if c.origin != "surface" and marks and all(f & PREDICTED for f in marks):
                flags |= S_PREDICTED
        alts = [{"type": x.type, "normal": x.normal_forms(), "refs": x.refs(), "score": x.score} for x in others]
        evidence = c.evidence + [f"tie with {x.type}" for x in tie]
        raw = self.source[words[0].rune_start : last.rune_end]
        return {"start": words[0].start, "end": last.end, "rune_start": words[0].rune_start, "rune_end": last.rune_end, "surface": raw, "type": c.type, "normal": normal, "refs": refs, "attrs": c.attrs(), "flags": flags, "score": c.score, "evidence": evidence, "alternatives": alts}

    def output(self, types=()) -> tuple[list[dict], list[dict]]:
        """Spans in order, then facts over their places (OP-8C, OP-8D, OP-8G)."""
        picked = self.choose()
        chosen = {id(c) for c, _ in picked}
        made = [(c, self.span(c, n, chosen)) for c, n in picked]
        made.sort(key=lambda x: (x[1]["start"], -x[1]["end"]))
        made = [x for x in made if not types or x[1]["type"] in types]
        place = {id(c): i for i, (c, _) in enumerate(made)}
        facts, seen = [], set()
        for kind, args, rule in self.facts:
            at = {}
            for arg, c in args.items():
                while c.replaced is not None:
                    c = c.replaced
                at[arg] = place.get(id(c))
            key = (kind, *sorted(at.items(), key=lambda x: x[0]))
            if None not in at.values() and key not in seen:
                seen.add(key)
                facts.append({"kind": kind, "args": at, "rule": rule})
        return [s for _, s in made], facts


def extract(text: str, terms: list[Term], indexes: list[Index], book: Book, weights: Weights, nesting, tags=(), types=(), min_lemma_runes: int = 3):
    """Spans and facts of one document (OP-80)."""
    if not terms:
        return [], []
    d = Document(text, terms, indexes, weights, nesting, min_lemma_runes)
    sets = book.active(tags)
    d.hints(sets)
    d.triggers(sets)
    d.patterns(sets)
    d.context()
    d.scores()
    return d.output(types)


# -- pattern search ---------------------------------------------------------------


class Lattice:
    """A sentence's terms and the candidates that start at each of them, longest first."""

    def __init__(self, doc: Document, lo: int, hi: int):
        self.terms, self.lo, self.hi = doc.text.terms, lo, hi
        self.starting = defaultdict(list)
        at = doc.text.at
        for c in doc.cands:
            if not c.removed and lo <= at[c.start] and at[c.end - 1] < hi:
                self.starting[at[c.start]].append((at[c.end - 1] + 1, c))
        for spans in self.starting.values():
            spans.sort(key=lambda x: (-x[0], x[1].order))


@dataclass
class Found:
    start: int
    end: int
    roles: dict[str, tuple[int, int, Candidate | None]]
    spans: list[Candidate]


def _step(e: Element, lat: Lattice, i: int):
    """(next term, candidate) for each way an element fits at a term, best first."""
    if i >= lat.hi or e.negated and next(_step(e.negated, lat, i), None):
        return
    if e.types:
        for end, c in lat.starting.get(i, ()):
            if c.type in e.types and (not e.wordy or all(e.word_ok(t) for t in lat.terms[i:end] if t.kind == "word")):
                yield end, c
    elif e.word_ok(lat.terms[i]):
        yield i + 1, None


def find_all(elements: tuple[Element, ...], lat: Lattice):
    """Leftmost matches that do not overlap; repeats are greedy, the first way that fits wins (OP-7A).

    Elements become continuations.  A (place, term) that failed once in a run
    fails again, so a run is linear in both.
    """

    def chain(es: tuple[Element, ...], then, dead):
        for e in reversed(es):
            then = one(e, then, dead)
        return then

    def one(e: Element, then, dead):
        body_then = [then]

        def body(i, state):
            if e.group:
                return chain(e.group, lambda j, s: close(j, s, i), dead)(i, state)
            for j, c in _step(e, lat, i):
                roles, spans = state
                if e.role:
                    roles = roles | {e.role: (i, j, c)}
                if got := body_then[0](j, (roles, [*spans, c] if c is not None else spans)):
                    return got
            return None

        def close(j, state, i):
            roles, spans = state
            return body_then[0](j, (roles | {e.role: (i, j, None)} if e.role else roles, spans))

        if e.repeat in ("*", "+"):
            key = object()

            def again(i, state):
                if (key, i) in dead:
                    return None
                dead.add((key, i))
                return body(i, state) or then(i, state)

            body_then[0] = again
            return body if e.repeat == "+" else again
        if e.repeat == "?":
            return lambda i, state: body(i, state) or then(i, state)
        return body

    i = lat.lo
    while i < lat.hi:
        got = chain(elements, lambda j, s, i=i: (j, s) if j > i else None, set())(i, ({}, []))
        if got:
            yield Found(i, got[0], *got[1])
            i = got[0]
        else:
            i += 1
