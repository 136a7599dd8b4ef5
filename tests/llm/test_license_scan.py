from vigilog.llm.license_scan import TEMPLATES, license_paragraphs


def test_templates_unknown_and_clean_paragraphs(make, words):
    rows = [(i, words(i, 40) + "\n" + text + "\n" + words(500 + i, 30)) for i, (_, text) in enumerate(TEMPLATES)]
    rows += [(100 + i, words(900 + i, 60)) for i in range(80)]
    rows += [(200, "You must accept the license agreement before using the software."), (201, None), (202, ""), (None, "All rights reserved."), (203, "x " * 30000 + "\nReleased under the MIT License.")]
    got = license_paragraphs(make(rows, "family, words, grams")).collect()
    by = {x.doc_id: x for x in got}
    for i, (family, _) in enumerate(TEMPLATES):
        assert (by[i].family, by[i].confirmed, by[i].paragraph) == (family, True, 1), TEMPLATES[i]
    assert by[203].family == "MIT" and by[203].paragraph == 1 and by[None].family == "Proprietary"
    assert 200 not in by or by[200].family == "unknown"
    assert not any(i in by for i in (*range(100, 180), 201, 202))
    assert license_paragraphs(make(rows).where("doc_id > 999")).collect() == []


def test_a_template_that_heads_many_texts_keeps_its_words(make, words):
    heads = [text for family, text in TEMPLATES if family in ("BSD", "Unlicense") and "Released" not in text]
    rows = [(100 * k + i, head + ".\n" + words(100 * k + i, 40)) for k, head in enumerate(heads) for i in range(60)]
    rows += [(900 + i, words(900 + i, 60)) for i in range(60)]
    got = {x.doc_id: x for x in license_paragraphs(make(rows)).collect()}
    assert {i: got[i].family for i in got} == {100 * k + i: f for k, f in enumerate(("BSD", "Unlicense")) for i in range(60)}
    assert all(x.confirmed and x.paragraph == 0 for x in got.values())
