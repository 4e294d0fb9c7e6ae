from mediatrends.llm.licenses import KNOWN, known_digests, scan_licenses
from tests.conftest import SF

SCHEMA = "doc_id long, text string"


def scan(spark, texts):
    return {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_every_known_text_is_found_in_any_writing(spark):
    cases = [(name, text) for name, texts in KNOWN.items() for text in texts]
    changed = [f"Copyright (c) 2020 Somebody\n\n{t.upper().replace(' ', '  ')}\n(c) 2021 Others\n© X" for _, t in cases]
    changed = [t.replace("LICENSE", "LICENCE").replace("NON-COMMERCIAL", "NONCOMMERCIAL") if "URL" not in t else t for t in changed]
    got = scan(spark, changed)
    # a digest names one licence, the first by name
    assert [got[i].license for i in range(len(cases))] == [name for name, _ in cases]


def test_other_texts_are_none(spark):
    mit = KNOWN["MIT"][0]
    got = scan(spark, [mit.replace("free of charge", "for a fee"), mit + " Also this.", "", None, "the MIT License", "... \n(c) 2020 X\n"])
    assert all(r.license is None and r.notices == "" for r in got.values())


def test_notices_are_lines(spark):
    got = scan(spark, ["words\nReleased under the MIT License.\nmore\n* LICENSED under CC BY NC 4.0", "Released under the MIT License, or not"])
    assert got[0].license is None and got[0].notices == "CC-BY-NC-4.0,MIT" and got[1].notices == ""


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = {r.doc_id for r in docs.collect() if "icensed under" in r.text or "Released under" in r.text}
    assert {r.doc_id for r in scan_licenses(docs).filter("notices <> ''").collect()} == want and want


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "Licensed under the ISC licence", "x"), (1, "Licensed under the ISC licence", "x"), (2, "a " * 300_000, "x")], SCHEMA + ", license string")
    got = sorted((r.doc_id or 0, r.license or "") for r in scan_licenses(df).collect())
    assert got == [(0, ""), (1, "ISC"), (1, "ISC"), (2, "")]
    assert scan_licenses(df.limit(0)).collect() == []
    assert scan_licenses(df, known=known_digests(spark).limit(0)).filter("license IS NOT NULL").count() == 0
