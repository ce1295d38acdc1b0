"""License templates: rendered wordings are taken, a text that is off by one word is not."""

import pytest

from clumpwise.llm.license_templates import _MARK, PHRASES, TEMPLATES, Automaton, _hashes, scan_licenses

LONG = {k for k, v in TEMPLATES.items() if len(v.split()) > 20}


def rendered(markup, whole):
    """(words, places of mandatory words), with optional regions and widest gaps (``whole``) or without and narrowest."""
    from tests.llm.test_operators import alnum

    words, places, at = [], [], 0

    def add(text, mandatory):
        new = alnum(text)
        places.extend(range(len(words), len(words) + len(new)) if mandatory else ())
        words.extend(new)

    for m in _MARK.finditer(markup):
        add(markup[at : m.start()], True)
        if m[1] is None:
            add(" ".join(f"any{k}" for k in range(int(m[3 if whole else 2]))), False)
        elif whole:
            add(m[1], False)
        at = m.end()
    add(markup[at:], True)
    return words, places


@pytest.mark.parametrize("name", sorted(TEMPLATES))
@pytest.mark.parametrize("whole", [True, False])
def test_only_exact_wording_is_taken(name, whole):
    automaton = Automaton(TEMPLATES[name])
    words, places = rendered(TEMPLATES[name], whole)
    assert automaton.mandatory == len(places)
    assert automaton.accept(_hashes(" ".join(words)))[1] == 1.0
    for k in places:
        assert automaton.accept(_hashes(" ".join([*words[:k], "zzz", *words[k + 1 :]])))[0] is None
        assert automaton.accept(_hashes(" ".join(words[:k])))[0] is None


def test_labels_of_whole_wordings(spark):
    names = sorted(LONG)
    rows = [(k, "Copyright 2020 A. Person\n" + " ".join(rendered(TEMPLATES[n], whole)[0]) + "\nend") for k, (n, whole) in enumerate((n, w) for n in names for w in (True, False))]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (n, _) in enumerate((n, w) for n in names for w in (True, False)):
        found = {m.label for m in got[k].matches}
        # the X11 wording holds that of the MIT license, the Apache notice its short one
        assert found == {n} | ({"mit"} if n == "x11" else set()) | ({"apache-2.0-notice"} if n == "apache-2.0" else set())
        assert got[k].score == 1.0
        assert got[k].n_base == sum(rows[k][1].lower().count(p) for p, _ in PHRASES)


def test_repeated_openings(spark):
    text = "permission is hereby granted free of charge " * 20_000
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.matches == [] and 0 < row.score < 1 and row.n_words == 140_000
