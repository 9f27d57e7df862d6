"""Analyser, registry, inflection, dates and extraction against fixed vectors."""

import pytest

from verba import catalog, fixtures


@pytest.mark.parametrize("name", sorted(n for n in catalog.GOLDEN))
def test_golden(spark, name):
    query, want = catalog.GOLDEN[name]
    got = {tuple(r) for r in query(spark, None).collect()}
    assert got == {tuple(r) for r in want()}


def test_versions(spark, tmp_path):
    from verba.sources.dictionaries import Catalog

    (tmp_path / "abbrev.records.tsv").write_text("село\tс.\tNOUN\n")
    (tmp_path / "nodot.tsv").write_text("a\tb\tc\n")
    (tmp_path / "odd.x.tsv").write_text("a\tb\tc\n")
    c = Catalog.open(spark, str(tmp_path), base=[("кот", "кота", "NOUN")])
    assert [(e.name, bool(e.error)) for e in c.entries] == [("base.builtin", False), ("abbrev.records", False), ("nodot", True), ("odd.x", True)]
    off = c.set_enabled("abbrev.records", False)
    assert off.version() != c.version() and off.set_enabled("abbrev.records", True).version() == c.version()
    with pytest.raises(KeyError):
        c.set_enabled("none", True)
    with pytest.raises(ValueError):
        c.set_enabled("nodot", True)
    with pytest.raises(ValueError):
        Catalog.open(spark, builtins={"other.x": []})
    assert c.summary().count() == 2


def test_rule_errors():
    from verba.plans.rules import RuleError, compile_book, load

    bad = {
        "sets:\n  - name: a\n    hints:\n      - {lemma: x, typ: y}": "rules:4: a/hints[0]: unknown field 'typ'",
        "sets:\n  - name: a\n    hints:\n      - {lemma: x, type: y, window: 9}": "rules:4: a/hints[0]: window 9 is not within 1..8",
        "sets:\n  - name: a\n    triggers:\n      - {lemma: x, type: y, window: 3..2}": "rules:4: a/triggers[0]: window '3..2' is not within 1..8",
        "sets:\n  - name: a\n    patterns:\n      - name: p\n        elements: [{type: y, role: r}]\n        actions: [{label: {role: r, type: z}}]": "rules:4: a/p: label needs a role without a span, 'r' has one",
        "sets:\n  - name: a\n  - name: a": "rules:3: set name 'a' is empty or stands twice",
    }
    for text, want in bad.items():
        with pytest.raises(RuleError) as e:
            compile_book(load(text))
        assert str(e.value) == want
    assert compile_book(load(fixtures.RULES)).version == compile_book(load(fixtures.RULES + "\n")).version


def test_resolution():
    from verba.plans.document import Candidate, Document, Weights

    def choose(nesting, *cands):
        d = Document("", [], [], Weights(), nesting)
        for kind, lo, hi, score in cands:
            c = d.add(Candidate(kind, lo, hi))
            c.score = score
        picked = d.choose()
        ids = {id(c) for c, _ in picked}
        return [(c.type, c.start, c.end, n, [x.type for x in d.alternatives(c, ids)]) for c, n in picked]

    assert choose({}, ("a", 0, 2, 5), ("b", 0, 1, 3), ("c", 1, 2, 3)) == [("b", 0, 1, False, []), ("c", 1, 2, False, [])]
    assert choose({}, ("a", 0, 2, 4), ("b", 1, 3, 3)) == [("a", 0, 2, False, [])]
    assert choose({"x": {"y"}}, ("x", 0, 3, 5), ("y", 1, 2, 2)) == [("x", 0, 3, False, []), ("y", 1, 2, True, [])]
    assert choose({"x": {"z"}}, ("x", 0, 3, 5), ("y", 1, 2, 2)) == [("x", 0, 3, False, [])]
    assert choose({}, ("a", 0, 1, 0), ("b", 1, 2, -1)) == []
    assert choose({}, ("surname", 0, 1, 3), ("patronymic", 0, 1, 3)) == [("patronymic", 0, 1, False, ["surname"])]
    assert choose({}, ("g", 0, 1, 1), ("s", 0, 1, 3), ("p", 0, 1, 2)) == [("s", 0, 1, False, ["p", "g"])]


def test_details(spark):
    spans = {(r["doc_id"], r["surface"]): r for r in catalog.golden_spans(spark).collect()}
    lake = spans["lake", "оз. Налимье"]
    assert lake["refs"] == ["w:20", "w:21"] and lake["score"] == 8.25 and lake["flags"] & 1 and lake["evidence"] == ["hint «оз» → lake +2"]
    guess = spans["guess", "Журавлихе"]
    assert guess["flags"] & 8 and guess["flags"] & 2 and guess["normal"] == ["журавлиха"] and guess["refs"] == []
    assert spans["level", "м."]["flags"] & 4
    basin = spans["basin", "Налимье — Кедровка"]
    assert basin["normal"] == ["Налимье Кедровка"] and not basin["flags"] & 8
    assert spans["basin", "Налимье"]["flags"] & 16
    assert spans["plain", "Кедровке"]["attrs"] == {"bed": "stone"}


def test_golden_cases():
    from verba.sources.tables import golden_cases

    got = golden_cases(['{"text": "да да", "spans": [{"text": "да", "type": "x", "occurrence": 2}]}', "", '{"id": "b", "text": "a"}'])
    assert [(c.id, c.spans) for c in got] == [("line1", ((3, 5, "x"),)), ("b", ())]
    for bad in ('{"text": "a", "extra": 1}', '{"text": "a", "spans": [{"text": "b", "type": "x"}]}'):
        with pytest.raises(ValueError):
            golden_cases([bad])
