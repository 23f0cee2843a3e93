"""Compression language ID: held-out accuracy, learning rule, edge cases."""

from __future__ import annotations

import zlib

import pytest

from verity.llm import common, langid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def dictionaries(spark):
    return langid.learn(common.documents(spark, SF))


def test_held_out_accuracy_and_rejections(spark, dictionaries):
    rows = common.documents(spark, SF).where(langid.held_out("doc_id")).select("doc_id", "lang", "text").orderBy("doc_id").limit(1200).collect()
    classifier = langid.Classifier(dictionaries)
    right = rejected = 0
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        lang, score, gone = classifier.predict(r.text)
        assert 0 <= score <= 1
        right, rejected = right + (lang == r.lang), rejected + gone
    assert right >= 0.98 * len(rows) and rejected <= 0.02 * len(rows)


def test_learns_by_the_rule_only(spark, rows_of):
    text = {"aa": "bana nana naba " * 20, "bb": "kiki riki tiki " * 20}
    rows = [(i, text["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb") for i in range(40)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    poison = [(i, "zzz yyy xxx " * 30, "never") for i in held] + [(None, "zzz", "null id"), (50, "zzz", None)]
    learned = langid.learn(rows_of(("doc_id", "text", "lang"), [r for r in rows if r[0] not in held] * 2 + poison))
    assert sorted(learned) == ["aa", "bb"]
    assert all(len(d) <= langid.SAMPLE_DOCS * (langid.SHARE + 1) for d in learned.values())


def test_edge_cases(spark, rows_of, dictionaries, tmp_path):
    texts = [None, "", "123 !!! ...", "½", "x", "the and of " * 20_000, "漢字かな"]
    df = rows_of(("doc_id", "text", "lang_pred", "score"), [(i, t, "clash", "clash") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in langid.classify(df, "text", dictionaries).collect()}
    for i in range(4):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[5].lang_pred == "en" and not got[5].rejected
    assert got[6].lang_pred in dictionaries
    rows_of(("doc_id", "text", "lang"), []).write.parquet(str(tmp_path / "documents.parquet"))
    assert langid.op7_compression_langid(spark, str(tmp_path)).count() == 0
    nothing = langid.classify(df, "text", {}).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def smallest(text, dictionaries):
    """Language and its and the runner-up's bytes, every segment compressed by a compressor of its own."""
    import zstandard as zstd

    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = (" " * letters.startswith(" ") + " ".join(letters.split()) + " " * letters.endswith(" ")).encode()
    sizes = []
    for lang in sorted(dictionaries):
        size = 0
        for i in range(0, len(words), langid.SEGMENT):
            params = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MIN_MATCH, write_content_size=False,
                                                               write_checksum=False, write_dict_id=False)
            content = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            size += len(zstd.ZstdCompressor(dict_data=content, compression_params=params).compress(words[i:i + langid.SEGMENT]))
        sizes.append((size, lang))
    sizes.sort()
    return sizes[0][1], sizes[0][0], sizes[1][0]


def test_predictions_against_brute_force(spark, dictionaries):
    """Every document of the small table, and those texts end to end, against one compressor a segment."""
    docs = common.documents(spark, "/root/testdata/sf0.001")
    got = {r.doc_id: r for r in langid.classify(docs.select("doc_id", "text"), "text", dictionaries).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    joined = " ".join(t for t in texts.values() if t)
    assert langid.Classifier(dictionaries).predict(joined)[0] == smallest(joined, dictionaries)[0]
    checked = 0
    for key, text in texts.items():
        if not any(map(str.isalpha, text or "")):
            assert got[key].lang_pred == langid.UND
            continue
        lang, first, second = smallest(text, dictionaries)
        assert got[key].lang_pred == lang and got[key].score == (second - first) / second
        assert got[key].rejected == (second < first / (1 - langid.MARGIN))
        checked += 1
    assert checked >= 50


def test_a_tie_goes_to_the_first_language_and_is_rejected():
    content = b"bana nana naba kiki riki " * 20
    assert langid.Classifier({"bb": content, "aa": content}).predict("nana naba kiki") == ("aa", 0.0, True)


def test_a_table_of_one_language(spark, rows_of, tmp_path):
    rows = [(i, "bana nana naba " * (i + 1), "aa", "s", i) for i in range(30)]
    rows += [(30, None, "aa", "s", 0), (31, "12 !", None, "s", 4), (0, rows[0][1], "aa", "s", 0)]
    rows_of(("doc_id", "text", "lang", "source", "n_chars"), rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op7_compression_langid(spark, str(tmp_path)).collect()
    assert len(got) == 33
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred, r.score, r.rejected) == ((langid.UND, 0.0, True) if r.doc_id in (30, 31) else ("aa", 1.0, False))
