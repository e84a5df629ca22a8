from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import licenses
from panelcast.llm.licenses import TEMPLATES, Scanner, Template, words_of
from panelcast.llm.patience import align

LETTERS = st.lists(st.sampled_from("abcdefgh"), max_size=14)


def is_alignment(pairs, a, b):
    return all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@settings(max_examples=200, deadline=None)
@given(LETTERS, LETTERS)
def test_alignments_are_increasing_and_maximal(a, b):
    pairs = align(a, b)
    assert is_alignment(pairs, a, b)
    assert bool(pairs) == bool(set(a) & set(b))
    for (i, j), (k, m) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))]):
        assert not set(a[i + 1:k]) & set(b[j + 1:m])  # nothing alignable is left in a gap


@settings(max_examples=50, deadline=None)
@given(st.permutations(list("abcdefghij")), st.sets(st.integers(0, 9), max_size=4))
def test_unique_words_align_in_full(words, missing):
    kept = [w for i, w in enumerate(words) if i not in missing]
    assert len(align(kept, words)) == len(kept)


def test_repeated_words_align_through_anchors():
    a, b = "the x the y the z the".split(), "the q x the y the the z the".split()
    assert len(align(a, b)) == 7


NOISE = "some other words about the work under version of this that it is for and in to a"


def test_every_template_is_found_where_it_is():
    for name, text in TEMPLATES.items():
        before, after = NOISE.split() * 3, NOISE.split()
        found = {f.name: f for f in Scanner().scan(f"{' '.join(before)}\n{text.upper()}\n{' '.join(after)}".encode())}
        assert found[name].coverage == 1.0
        assert (found[name].start, found[name].end) == (len(before), len(before) + len(words_of(text.encode())))


def test_edits_lower_the_coverage_and_too_many_hide_it():
    words = words_of(TEMPLATES["MIT-text"].encode())
    n = len(words)
    template = Template("t", TEMPLATES["MIT-text"])
    for lost in (1, n // 10, n - template.needed, n - template.needed + 1, n // 2):
        step = n / lost
        gone = {int(i * step) for i in range(lost)}
        text = [b"changed" if i in gone else w for i, w in enumerate(words)]
        where = {w: [i for i, x in enumerate(text) if x == w] for w in set(words)}
        found = template.find(text, where)
        assert (found is not None) == (n - lost >= template.needed)
        if found:
            assert found.coverage == (n - lost) / n


def plain_scan(text):
    """Aligns a stretch at every place of the text, whatever stands there."""
    tokens, found = words_of(text.encode() if text else None), []
    for name, template in sorted(TEMPLATES.items()):
        t = Template(name, template)
        best = max((len(align(tokens[max(0, s - t.slack):max(0, s + len(t.words) + t.slack)], t.words))
                    for s in range(-t.slack, len(tokens) + 1)), default=0)
        if best >= t.needed:
            found.append((-best / len(t.words), -len(t.words), name))
    return [f[2] for f in sorted(found)]


def test_query_equals_brute_force(spark, docs, clashing, empty):
    texts = [
        None, "", NOISE, "Released under the MIT License.", "released Released under under the the MIT License License",
        "All rights reserved. All rights reserved. all RIGHTS reserved", "rights reserved", "under the mit license released",
        TEMPLATES["Apache-2.0-header"], TEMPLATES["GPL-3.0"].replace("General ", "") + " x " + TEMPLATES["CC-BY-NC-4.0"],
        NOISE + " Licensed under the very Apache License, Version 2.0 " + NOISE,
    ]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = docs.where("doc_id <> 115 or doc_id is null").select("doc_id", "text").union(extra)
    want = Counter((r.doc_id, tuple(plain_scan(r.text))) for r in rows.collect())
    got = licenses.query(rows).collect()
    names = lambda r: tuple(x.split(":")[0] for x in r.licenses.split(",") if x)
    assert Counter((r.doc_id, names(r)) for r in got) == want
    assert all(r.license == (names(r) or (None,))[0] for r in got)
    assert licenses.query(empty).collect() == []
    assert Counter(map(tuple, licenses.query(clashing).collect())) == Counter(map(tuple, licenses.query(docs).collect()))
    assert {r.license for r in licenses.query(docs).collect() if r.doc_id == 116} == {"Apache-2.0"}


def stretches(text):
    return [(f.name, f.start, f.end) for f in Scanner().scan_all(text.encode())[1]]


def test_notices_that_come_twice_are_there_twice():
    once = "Released under the MIT License."
    assert stretches(f"{once} {once}") == [("MIT", 0, 5), ("MIT", 5, 10)]
    for name in ("MIT-text", "GPL-3.0-or-later", "BSD-3-Clause"):
        n = len(words_of(TEMPLATES[name].encode()))
        for between in ("", "and some other words"):
            gap = len(between.split())
            assert stretches(f"{TEMPLATES[name]} {between} {TEMPLATES[name]}") == [(name, 0, n), (name, n + gap, 2 * n + gap)]


def test_each_part_of_the_text_names_one_template():
    for name, text in TEMPLATES.items():
        assert stretches(text) == [(name, 0, len(words_of(text.encode())))], name
    joined = [n for n in sorted(TEMPLATES)]
    assert [s[0] for s in stretches(" x y z ".join(TEMPLATES[n] for n in joined))] == joined


def test_phrases_hold_word_by_word():
    for name, text in licenses.PHRASES.items():
        n = len(words_of(text.encode()))
        assert (name, 1, 1 + n) in stretches(f"// see {text}\n#include x"), name
    assert stretches("// SPDX-License-Identifier: GPL-2.0-only") == [("SPDX:GPL-2.0-only", 0, 7)]
    assert stretches("SPDX-License-Identifier: see MIT") == []
    assert [s[0] for s in stretches("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*sorted(TEMPLATES), "x", "the", "license", "under"]), max_size=6))
def test_stretches_do_not_overlap_and_miss_no_template(names):
    scanner = Scanner()
    best, found = scanner.scan_all(" ".join(TEMPLATES.get(n, n) for n in names).encode())
    spans = sorted((f.start, f.end) for f in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for f in best:  # what has no stretch of its own overlaps one that is at least as good
        assert f in found or any(f.start < g.end and g.start < f.end and (-g.coverage, -g.length) <= (-f.coverage, -f.length) for g in found)
