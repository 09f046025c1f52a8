import random
import unicodedata as ud

from seriesloom.llm.same_look import HYPHENS, INVISIBLE, LOOK_ALIKE, Look, canonical_documents, canonical_segment, confusable_letters, look_classes, prototypes, same_look_pairs, script
from seriesloom.runtime import table

LOOK = Look(confusable_letters())
TABLE, canonical = LOOK.table, LOOK.fold


def whole(text):
    """The plain path: the whole text at once."""
    return canonical_segment(text, TABLE).replace("\r\n", "\n")


def test_segments_equal_whole_text(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("text").collect() if r.text]
    assert all(canonical(t) == whole(t) for t in texts)
    rng = random.Random(3)
    pool = "aeo éöñ\t\n.-1" + "е́ооіԝ" + "ﬁﬃ１Ａ　   " + "ががｶﾞﾊﾟ" + "̣́̈​‍­͏﻿" + "가각ÅÅΩⅣ½²①"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        c = canonical(t)
        assert c == whole(t) and canonical(c) == c, ascii(t)
        assert canonical(ud.normalize("NFD", t)) == c == canonical(ud.normalize("NFC", t)), ascii(t)


def test_same_and_different():
    same = [("ﬁle", "file"), ("１２，３", "12,3"), ("a b", "a b"), ("a b", "a　b"), ("é", "é"), ("со​ре", "cope"), ("re­al", "real"), ("a‑b", "a-b"), ("ｶﾞ", "ガ"), ("Å", "Å"), ("ё", "ë"), ("Ⅳ", "IV"), ("ẹ́", "ẹ́"), ("а͏́", "á"), ("x\t", "x ")]
    assert all(canonical(a) == canonical(b) for a, b in same)
    different = [("a", "A"), ("e", "é"), ("1", "l"), ("0", "O"), ("a.", "a"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("½", "1/2"), ("①", "1"), ("a-b", "a–b"), ("'", "’"), ("ı", "i"), ("c", "ç"), ("𝐀", "A")]
    assert all(canonical(a) != canonical(b) for a, b in different)
    assert len(set(HYPHENS)) == 6 and len(set(INVISIBLE)) == 13


def test_letters_of_the_public_data():
    letters = confusable_letters()
    assert prototypes()[0].startswith("icu4j-") and letters.items() >= LOOK_ALIKE.items()
    assert {script(c) for c in letters} > {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU"}
    pairs = [(script(a), b) for a, b in letters.items() if a not in LOOK_ALIKE]
    assert len(set(pairs)) == len(pairs)  # letters of one script stay apart
    assert canonical("\u13aa\u13b3\u13d9") == "AWV"[:2] + canonical("\u13d9") and letters["\ua4d0"] == "B"
    assert Look(LOOK_ALIKE).fold("\ua4d0\u13aa") != "BA" and canonical("\ua4d0\u13aa") == "BA"  # the data changes the result


def test_words_keep_their_script(spark, sf_dir):
    rows = table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("text", "lang").collect()
    ru = [r.text for r in rows if r.text and (r.lang or "").lower().startswith("ru")]
    for t in ru:
        c = LOOK.canonical(t)
        assert LOOK.fold(c) == LOOK.fold(t) and LOOK.canonical(c) == c
        for w in c.split():
            seen = {script(x) for x in w if x.isalpha()}
            assert not ({"LATIN", "CYRILLIC"} <= seen) or not any(x in w for x in "дйлнпцшщыэюя")
    assert LOOK.canonical("Среднее и ряд: осе, а сор") == "Среднее и ряд: осе, а сор"
    assert LOOK.canonical("Cpeднee и pяд: oce, a cop") == "Среднее и ряд: осе, а сор"  # look-alikes of Latin in Russian words
    assert LOOK.canonical("thе сору of a series дня") == "the copy of a series дня"
    assert LOOK.canonical("ёлка, моё") == "ёлка, моё" and LOOK.canonical("Ενα νέο όνομα") == "Ενα νέο όνομα"
    rng = random.Random(5)
    pool = "aeocpxy dbfg" + "аеосрху дблж" + "οαν λδ" + "\u0301\u0308ёéй "
    by: dict[str, set] = {}
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        c = LOOK.canonical(t)
        assert LOOK.fold(c) == LOOK.fold(t), ascii(t)
        by.setdefault(LOOK.fold(t), set()).add(c)
    assert all(len(x) == 1 for x in by.values())  # equal looks are equal strings


def test_pairs_and_edges(spark):
    rows = [(1, "abc", "x"), (2, "abc", "x"), (3, "аbc", "x"), (4, None, "x"), (5, "", "x"), (6, "​", "x"), (7, "Abc", "x"), (8, "z" * 300_000 + "е", "x"), (9, "z" * 300_000 + "e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    assert sorted(map(tuple, same_look_pairs(df).collect())) == [(1, 3), (2, 3), (5, 6), (8, 9)]
    assert {r.doc_id: (r.class_id, r.n_links) for r in look_classes(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (1, 2), 5: (5, 1), 6: (5, 1), 7: (7, 0), 8: (8, 1), 9: (8, 1)}
    out = {r.doc_id: (r.text, r.changed) for r in canonical_documents(df).collect()}
    assert out[4] == (None, False) and out[3] == ("abc", True) and out[1] == ("abc", False)
    assert same_look_pairs(df.limit(0)).count() == 0 and look_classes(df.limit(0)).count() == 0


def test_pairs_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, whole(r.text)) for r in docs.collect() if r.text is not None]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if a[2] == b[2] and a[1] != b[1]}
    got = [tuple(r) for r in same_look_pairs(docs).collect()]
    assert set(got) == want and len(got) == len(want)
