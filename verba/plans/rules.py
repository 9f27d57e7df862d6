"""Declarative rules: strict loading with located errors, checks, versions (OP-11, OP-70 to OP-7B).

Rules are small driver-side objects.  A file is read as a tree of nodes with line
numbers; a table of fields per kind of record says what may stand there.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from verba.functions.textnorm import PREREFORM, normalize_word
from verba.operators.lookup import STOP, UNKNOWN

try:
    import yaml
except ImportError:  # JSON files still load
    yaml = None

# The fields of each record of a rule file.
FIELDS = {
    "file": {"meta", "sets"},
    "set": {"name", "when", "hints", "triggers", "patterns"},
    "hint": {"lemma", "dotted", "type", "dir", "window", "weight", "absorb"},
    "trigger": {"lemma", "dotted", "type", "dir", "window", "shape", "stop_at", "negative", "weight", "absorb"},
    "pattern": {"name", "elements", "actions"},
    "element": {"type", "lemma", "grammeme", "token", "shape", "not", "any", "group", "repeat", "role"},
    "shape": {"case", "script"},
    "action": {"relabel", "boost", "label", "emit"},
    "relabel": {"role", "type", "weight"}, "boost": {"role", "weight"}, "label": {"role", "type", "weight"}, "emit": {"kind", "args"},
}
TOKEN_KINDS = ("word", "number", "punct", "symbol")
STOP_CLASSES = ("punct", "stop", "number", "latin")


class RuleError(ValueError):
    """A problem at a place of a rule file."""

    def __init__(self, file: str, line: int, where: str, what: str):
        super().__init__(f"{file}:{line}: {where + ': ' if where else ''}{what}")
        self.file, self.line = file, line


class Node(dict):
    """A mapping of a rule file with its line."""

    line = 0


def _tree(text: str, file: str):
    """Nested nodes, lists and strings of one YAML or JSON document."""
    if yaml is None:
        def fix(x):
            return Node({k: fix(v) for k, v in x.items()}) if isinstance(x, dict) else [fix(v) for v in x] if isinstance(x, list) else x

        return fix(json.loads(text))
    try:
        docs = list(yaml.compose_all(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise RuleError(file, mark.line + 1 if mark else 1, "", str(getattr(e, "problem", e))) from None
    docs = [d for d in docs if d is not None]
    if len(docs) != 1:
        raise RuleError(file, 1, "", f"want one document, got {len(docs)}")

    def plain(n):
        line = n.start_mark.line + 1
        if isinstance(n, yaml.MappingNode):
            out = Node()
            out.line = line
            for k, v in n.value:
                if k.value in out:
                    raise RuleError(file, k.start_mark.line + 1, "", f"field {k.value!r} stands twice")
                out[k.value] = plain(v)
            return out
        if isinstance(n, yaml.SequenceNode):
            return [plain(v) for v in n.value]
        if n.style is None and n.value in ("true", "false"):
            return n.value == "true"
        if n.style is None and n.value in ("", "~", "null"):
            return None
        if n.style is None:
            for kind in (int, float):
                try:
                    return kind(n.value)
                except ValueError:
                    pass
        return n.value

    return plain(docs[0])


def load(text: str, file: str = "rules") -> Node:
    """A checked rule file."""
    tree = _tree(text, file)

    def check(x, kind: str, where: str = ""):
        if not isinstance(x, dict):
            raise RuleError(file, 1, where, f"a {kind} is a mapping")
        if bad := sorted(set(x) - FIELDS[kind]):
            raise RuleError(file, x.line, where, f"unknown field {bad[0]!r}")

    check(tree, "file")
    for s in tree.get("sets") or []:
        check(s, "set")
        name = s.get("name") or ""
        for kind in ("hint", "trigger", "pattern"):
            for i, r in enumerate(s.get(kind + "s") or []):
                check(r, kind, f"{name}/{kind}s[{i}]")
                if isinstance(r.get("shape"), dict):
                    check(r["shape"], "shape", name)
                for e in r.get("elements") or []:
                    _check_element(e, check, name)
                for a in r.get("actions") or []:
                    check(a, "action", name)
                    for k, v in a.items():
                        check(v, k, name)
    tree["file"] = file
    return tree


def _check_element(e, check, where):
    check(e, "element", where)
    for sub in e.get("group") or []:
        _check_element(sub, check, where)
    for k in ("not", "shape"):
        if e.get(k) is not None:
            check(e[k], "element" if k == "not" else "shape", where)


def alternatives(text) -> list[str]:
    return [p.strip() for p in str(text or "").split("|") if p.strip()]


@dataclass(frozen=True)
class Keyword:
    """Words that a term's form or a known lemma must be (OP-72); always in pre-reform comparison spelling."""

    words: frozenset[str]
    dotted: bool = False

    @staticmethod
    def of(text, dotted=False) -> Keyword:
        words = frozenset(w for p in alternatives(text) if (w := normalize_word(PREREFORM, p.rstrip(".") if p.endswith(".") else p)))
        if not words:
            raise ValueError("empty lemma")
        return Keyword(words, bool(dotted))

    def match(self, t) -> bool:
        if self.dotted and not t.dotted:
            return False
        form = t.form[:-1] if t.form.endswith(".") else t.form
        return form in self.words or any(not f & UNKNOWN and x in self.words for x, f, _ in t.lemmas)


@dataclass(frozen=True)
class Shape:
    case: str = ""
    script: str = ""

    @staticmethod
    def of(x) -> Shape:
        case, script = (str((x or {}).get(k) or "").lower() for k in ("case", "script"))
        if case not in ("", "lower", "title", "upper"):
            raise ValueError(f"unknown shape case {case!r}")
        if script not in ("", "cyrillic", "latin"):
            raise ValueError(f"unknown shape script {script!r}")
        return Shape(case, script)

    def ok(self, t) -> bool:
        return self.case in ("", t.case) and self.script in ("", t.script)


def window(x) -> tuple[int, int]:
    """``3`` is 1..3; ``2..4`` is itself (OP-76)."""
    if x is None:
        return 1, 1
    lo, dots, hi = str(x).partition("..")
    try:
        a, b = (int(lo), int(hi)) if dots else (1, int(lo))
    except ValueError:
        raise ValueError(f"bad window {x!r}") from None
    if not 1 <= a <= b <= 8:
        raise ValueError(f"window {x!r} is not within 1..8")
    return a, b


def weight(x, default: float = 1.0) -> float:
    if x is not None and (isinstance(x, (bool, str)) or x < 0):
        raise ValueError(f"bad weight {x!r}")
    return float(x) if x else default


@dataclass(frozen=True)
class Hint:
    keyword: Keyword
    type: str
    dir: str
    window: int
    weight: float
    absorb: bool


@dataclass(frozen=True)
class Trigger:
    keyword: Keyword
    type: str
    dir: str
    least: int
    most: int
    shape: Shape
    stop_at: frozenset[str]
    negative: bool
    weight: float
    absorb: bool

    def accepts(self, t) -> bool:
        if t.kind not in ("word", "number") or not self.shape.ok(t):
            return False
        if "number" in self.stop_at and t.kind == "number" or "latin" in self.stop_at and t.script == "latin":
            return False
        return not ("stop" in self.stop_at and any(f & STOP for _, f, _ in t.lemmas))


@dataclass(frozen=True)
class Element:
    """One step of a pattern: a span of some types, a word, or a group (OP-79)."""

    types: tuple[str, ...] = ()
    keyword: Keyword | None = None
    grammemes: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    shape: Shape = Shape()
    negated: Element | None = None
    group: tuple[Element, ...] = ()
    repeat: str = ""
    role: str = ""

    def word_ok(self, t) -> bool:
        if self.keyword and not self.keyword.match(t) or self.kinds and t.kind not in self.kinds or not self.shape.ok(t):
            return False
        return not self.grammemes or any(not f & UNKNOWN and not set(self.grammemes).isdisjoint(tag.replace(",", " ").split(" ")) for _, f, tag in t.lemmas)

    @property
    def wordy(self) -> bool:
        return bool(self.keyword or self.grammemes or self.kinds or self.shape != Shape())


@dataclass(frozen=True)
class Pattern:
    name: str
    elements: tuple[Element, ...]
    actions: tuple[tuple[str, dict], ...]


@dataclass(frozen=True)
class RuleSet:
    name: str
    when: frozenset[str]
    hints: tuple[Hint, ...]
    triggers: tuple[Trigger, ...]
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Book:
    """Compiled rule sets in order."""

    sets: tuple[RuleSet, ...] = ()
    version: str = ""

    def active(self, tags) -> tuple[RuleSet, ...]:
        """Sets all of whose ``when`` tags are present (OP-71)."""
        return tuple(s for s in self.sets if s.when <= set(tags or ()))


def _element(x: Node) -> Element:
    group = tuple(_element(e) for e in x.get("group") or [])
    own = [k for k in ("type", "lemma", "grammeme", "token", "shape", "not") if x.get(k)]
    if group and (own or x.get("any")) or x.get("any") and own:
        raise ValueError("any and group cannot be combined with other conditions")
    if not group and not own and not x.get("any"):
        raise ValueError("an element needs type, lemma, grammeme, token, shape, not, any or group")
    kinds = tuple(alternatives(x.get("token")))
    if bad := [k for k in kinds if k not in TOKEN_KINDS]:
        raise ValueError(f"unknown token kind {bad[0]!r}")
    if (repeat := x.get("repeat") or "") not in ("", "?", "*", "+"):
        raise ValueError(f"unknown repeat {repeat!r}")
    for k in ("type", "grammeme", "token"):
        if x.get(k) and not alternatives(x[k]):
            raise ValueError(f"empty {k} {x[k]!r}")
    neg = x.get("not")
    if neg is not None and (any(neg.get(k) for k in ("role", "repeat", "group", "any", "not")) or not any(neg.get(k) for k in ("type", "lemma", "grammeme", "token", "shape"))):
        raise ValueError("not takes type, lemma, grammeme, token and shape only")
    return Element(tuple(alternatives(x.get("type"))), Keyword.of(x["lemma"]) if x.get("lemma") else None, tuple(alternatives(x.get("grammeme"))), kinds, Shape.of(x.get("shape")), _element(neg) if neg else None, group, repeat, x.get("role") or "")


def _roles(elements, typed: dict[str, bool]) -> dict[str, bool]:
    """Roles, and whether each is bound to a span."""
    for e in elements:
        _roles(e.group, typed)
        if e.role:
            typed[e.role] = typed.get(e.role, True) and bool(e.types)
    return typed


def _pattern(x: Node) -> Pattern:
    elements = tuple(_element(e) for e in x.get("elements") or [])
    if not elements:
        raise ValueError("a pattern needs elements")
    roles = _roles(elements, {})
    made: set[str] = set()
    actions = []
    for a in x.get("actions") or []:
        if len(a) != 1:
            raise ValueError("an action is one of relabel, boost, label and emit")
        ((kind, v),) = a.items()
        named = list((v.get("args") or {}).values()) if kind == "emit" else [v.get("role")]
        for role in named:
            if role not in roles:
                raise ValueError(f"unknown role {role!r}")
            if kind == "label" and roles[role]:
                raise ValueError(f"label needs a role without a span, {role!r} has one")
            if kind != "label" and not roles[role] and role not in made:
                raise ValueError(f"{kind} needs a role with a span, {role!r} has none")
        if kind in ("relabel", "label") and not v.get("type"):
            raise ValueError(f"{kind} needs a type")
        if kind == "emit" and (not v.get("kind") or not named):
            raise ValueError("emit needs a kind and args")
        if kind == "label":
            made.add(v["role"])
        actions.append((kind, dict(v) | ({} if kind == "emit" else {"weight": weight(v.get("weight"))})))
    if not actions:
        raise ValueError("a pattern needs actions")
    return Pattern(x.get("name") or "", elements, tuple(actions))


def _direction(x, allowed) -> str:
    if (d := str(x or "right").lower()) not in allowed:
        raise ValueError(f"unknown dir {x!r}")
    return d


def _typed(x: Node) -> str:
    if not x.get("type"):
        raise ValueError("no type")
    return x["type"]


def _hint(x: Node) -> Hint:
    w = x.get("window")
    if w is not None and (not isinstance(w, int) or not 1 <= w <= 8):
        raise ValueError(f"window {w!r} is not within 1..8")
    return Hint(Keyword.of(x.get("lemma"), x.get("dotted")), _typed(x), _direction(x.get("dir"), ("left", "right", "both")), w or 1, weight(x.get("weight")), bool(x.get("absorb")))


def _trigger(x: Node) -> Trigger:
    stops = x.get("stop_at") or []
    if bad := [s for s in stops if s not in STOP_CLASSES]:
        raise ValueError(f"unknown stop_at class {bad[0]!r}")
    return Trigger(Keyword.of(x.get("lemma"), x.get("dotted")), _typed(x), _direction(x.get("dir"), ("left", "right")), *window(x.get("window")), Shape.of(x.get("shape")), frozenset(stops), bool(x.get("negative")), weight(x.get("weight")), bool(x.get("absorb")))


def compile_book(*files: Node) -> Book:
    """A book of all files' sets; set names are unique (OP-70)."""
    sets: list[RuleSet] = []
    for f in files:
        name = f.get("file", "rules")
        for s in f.get("sets") or []:
            if not s.get("name") or any(x.name == s["name"] for x in sets):
                raise RuleError(name, s.line, "", f"set name {s.get('name')!r} is empty or stands twice")
            made = []
            for kind, make in (("hints", _hint), ("triggers", _trigger), ("patterns", _pattern)):
                out = []
                for i, r in enumerate(s.get(kind) or []):
                    try:
                        out.append(make(r))
                    except ValueError as e:
                        raise RuleError(name, r.line, f"{s['name']}/{r.get('name') or f'{kind}[{i}]'}", str(e)) from None
                made.append(tuple(out))
            sets.append(RuleSet(s["name"], frozenset(s.get("when") or ()), *made))
    text = json.dumps([{k: v for k, v in f.items() if k != "file"} for f in files], ensure_ascii=False, sort_keys=True)
    return Book(tuple(sets), hashlib.sha256(text.encode()).hexdigest() if files else "")


__all__ = ["Book", "Element", "Hint", "Keyword", "Pattern", "RuleError", "RuleSet", "Shape", "Trigger", "compile_book", "field", "load"]
