from collections import Counter

import numpy as np
import pytest

from panelcast.llm import langid
from panelcast.llm.langid import Profiles


def plain_counts(text):
    import re

    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        edged = f"_{word}_"
        counts.update(word)
        counts.update(edged[i:i + 2] for i in range(len(edged) - 1))
        counts.update(edged[i:i + 3] for i in range(len(edged) - 2))
    return counts


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


@pytest.mark.parametrize("text", ["The cat. The 2 hats_and", "Éou l'eau ñ", "日本語 text", "x", "a_b"])
def test_grams(text):
    codes, n = langid.counted(text)
    assert dict(zip(codes.tolist(), n.tolist())) == {code(g): k for g, k in plain_counts(text).items()}


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = "word and other words 12 in a line\n" * 50
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "_PIECE", 100)
    pieces = langid.counted(text)
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def plain_prediction(text, learned, size):
    """Out-of-place distance by its definition over rank lists."""
    own = sorted(plain_counts(text or "").items(), key=lambda x: (-x[1], code(x[0])))[:size]
    if not own or not learned:
        return "und", 0.0
    distances = {}
    for lang, ranks in learned.items():
        distances[lang] = sum(abs(ranks[g] - i) if g in ranks else size for i, (g, _) in enumerate(own))
    best = min(distances, key=lambda k: (distances[k], k))
    return best, 1 - distances[best] / (size * len(own))


def test_query_equals_brute_force(docs):
    import zlib

    totals = {}
    rows = docs.collect()
    for r in rows:
        if r.text is not None and r.lang and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            totals.setdefault(r.lang, Counter()).update(plain_counts(r.text))
    size = langid.PROFILE_SIZE
    learned = {
        lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:size])}
        for lang, c in totals.items()}
    want = Counter()
    for r in rows:
        lang, score = plain_prediction(r.text, learned, size)
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        want[r.doc_id, held, lang, round(score, 9)] += 1
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.query(docs).collect())
    assert got == want


def test_held_out_documents_are_identified(docs):
    lang = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 60}
    held = [r for r in langid.query(docs).collect() if r.held_out and r.doc_id in lang]
    assert held and all(r.lang_pred == lang[r.doc_id] for r in held)


def test_no_letters_nothing_learned_and_ties(spark, docs, clashing, empty):
    assert langid.query(empty).collect() == []
    got = {r.doc_id: r for r in langid.query(docs).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (103, 104, 105, 106))
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in langid.query(unlabelled).collect()} == {("und", 0.0)}
    assert Counter(map(tuple, langid.query(clashing).collect())) == Counter(map(tuple, langid.query(docs).collect()))
    even = Profiles.of([("b", code("x"), 0), ("a", code("x"), 0)], 5)
    assert even.predict("x")[0] == "a"


def test_stage_keeps_identified_rows_whole(clashing, empty):
    profiles = langid.fit(langid.learned_rows(clashing))
    kept = langid.keep_identified(clashing, profiles)
    assert kept.columns == clashing.columns
    gone = {103, 104, 105, 106}
    want = Counter(tuple(r) for r in clashing.collect() if r.text is not None and r.doc_id not in gone)
    assert Counter(map(tuple, kept.collect())) == want
    assert langid.keep_identified(empty, profiles).collect() == []


def test_letters_are_those_of_unicode():
    """Numerals of other kinds are no letters, and a mark belongs to its letter."""
    profiles = langid.Profiles.of([("xx", int(c), k) for k, c in enumerate(langid.grams("some letters"))], 400)
    for text in ("²½①", "Ⅷ ⅷ", "̀́", "１２ ٣", "①̀", "_ _"):
        assert langid.grams(text).size == 0 and profiles.predict(text) == ("und", 0.0)
    word = "कि"  # a letter and a vowel sign
    edged = [ord(c) for c in f"_{word}_"]
    two = [a << 21 | b for a, b in zip(edged, edged[1:])]
    three = [a << 42 | b << 21 | c for a, b, c in zip(edged, edged[1:], edged[2:])]
    assert sorted(langid.grams(f"① {word}²").tolist()) == sorted([*edged[1:-1], *two, *three])


def test_a_long_learned_text_is_counted_in_pieces(spark, monkeypatch):
    rows = [("one two three deux " * 40, "en"), ("short", "en"), ("ein zwei " * 50, "de"), ("क्षि ½ " * 30, "hi")]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    want = sorted(map(tuple, langid.gram_counts(docs).collect()))
    got = {}
    for text, lang in rows:  # the workers of the session keep their bound; the piecewise path is checked here
        with monkeypatch.context() as m:
            m.setattr(langid, "_PIECE", 16)
            for code, n in zip(*map(list, langid.counted(text))):
                got[lang, int(code)] = got.get((lang, int(code)), 0) + int(n)
    assert sorted((lang, code, n) for (lang, code), n in got.items()) == want
