"""Word lookup of a dictionary: readings to lemmas (OP-41, OP-47, OP-48, OP-52 to OP-55)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from verba.functions.textnorm import Rules, normalize_word

# Lemma flags (DM-7) in display order, service parts of speech.
AMBIGUOUS, PREDICTED, UNKNOWN, ABBREV, STOP, REFORM = 1, 2, 4, 8, 16, 32
FLAGS = {"ambiguous": AMBIGUOUS, "predicted": PREDICTED, "unknown": UNKNOWN, "abbrev": ABBREV, "stop": STOP, "reform": REFORM}
SERVICE = frozenset({"PREP", "CONJ", "PRCL", "INTJ"})

READING_TYPE = "struct<normal:string,tag:string,kind:string,dict:string,predicted:boolean>"
LEMMA_TYPE = "struct<text:string,flags:int,tag:string,kind:string,dict:string>"


@dataclass(frozen=True)
class Profile:
    """Which dictionaries a field is read with, and which readings it keeps (DM-11)."""

    name: str = ""
    kinds: tuple[str, ...] = ()
    grammemes: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)

    def takes(self, kind: str) -> bool:
        return not self.kinds or kind in self.kinds

    def keeps(self, reading: dict) -> bool:
        want = self.grammemes.get(reading["kind"])
        return not want or not grammemes(reading["tag"]).isdisjoint(want)


def grammemes(tag: str) -> frozenset[str]:
    return frozenset(x for x in re.split("[,; ]", tag or "") if x)


def part_of_speech(tag: str) -> str:
    return re.split("[,; ]", tag or "")[0]


def show_flags(flags: int) -> str:
    return ",".join(n for n, f in FLAGS.items() if flags & f)


def lemmas(form: str, readings: list[dict], extra: int, rules: Rules) -> list[dict]:
    """Distinct lemmas in reading order; the first reading of a lemma stands for it."""
    own = normalize_word(rules, form)
    out: dict[str, dict] = {}
    for r in readings:
        text = normalize_word(rules, r["normal"])
        mark = ABBREV if r["kind"] == "abbrev" and text != own else 0
        out.setdefault(text, {"text": text, "flags": extra | mark, "tag": r["tag"], "kind": r["kind"], "dict": r["dict"]})
    if len(out) > 1:
        for x in out.values():
            x["flags"] |= AMBIGUOUS
    return list(out.values())


def unknown(form: str) -> list[dict]:
    return [{"text": form, "flags": UNKNOWN, "tag": "", "kind": "", "dict": ""}]


def lookup_word(form: str, candidates: list[tuple[str, list[dict]]], profile: Profile, rules: Rules) -> tuple[list[dict], bool]:
    """(lemmas, stop) of a form.

    ``candidates`` holds the form and its reform variants, in order, each with its
    readings of all kinds.
    """
    found = {key: [r for r in rs if profile.takes(r["kind"])] for key, rs in reversed(candidates)}
    exact = [r for r in found.get(form, []) if not r["predicted"] and not (len(form) == 1 and r["kind"] == "abbrev")]
    key, extra = form, 0
    if not exact:
        for variant, _ in candidates:
            sure = [r for r in found[variant] if not r["predicted"]] if variant != form else []
            if sure:
                exact, key, extra = sure, variant, REFORM
                break
    service = [r for r in exact if "Abbr" not in grammemes(r["tag"])]
    if service and all(part_of_speech(r["tag"]) in SERVICE for r in service):
        return lemmas(key, service, STOP | extra, rules), True
    if exact:
        got = lemmas(key, [r for r in exact if profile.keeps(r)], extra, rules)
    else:
        got = lemmas(form, [r for r in found.get(form, []) if r["predicted"] and r["kind"] == "base"], PREDICTED, rules)
    return got or unknown(form), False


def lookup_abbrev(key: str, readings: list[dict], rules: Rules) -> list[dict]:
    """Lemmas of an abbreviation key, whatever the profile; a dotted letter is always ambiguous."""
    got = lemmas(key, [r for r in readings if r["kind"] == "abbrev" and not r["predicted"]], 0, rules)
    if len(key) == 2 and key.endswith("."):
        for x in got:
            x["flags"] |= AMBIGUOUS
    return got
