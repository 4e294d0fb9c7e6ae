import sys

import pytest

from mediatrends.functions import text


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def test_normalize(spark):
    cases = {
        "  Hello\tWorld ? ": "hello world ",
        "A b c!?.": "a b c",
        "\t": "",
        "x ? !": "x ? ",
        "\x1cq\x1f": "q",
        "a  b": "a b",
        "ÉLAN, vital.,": "élan, vital",
        "".join(f"a{s}" for s in SPACES): " ".join("a" * len(SPACES)),
    }
    assert values(spark, text.normalize_query("c"), list(cases)) == list(cases.values())


def test_blank_means_spaces_only(spark):
    assert values(spark, text.non_blank("c"), ["  ", "\t", "a", "", None]) == [False, True, True, False, None]


def test_strip(spark):
    assert values(spark, text.strip_text("c"), ["  a  b\n", "\x1c", "x"]) == ["a  b", "", "x"]


def test_display_phrase(spark):
    df = spark.createDataFrame([(None, "", None), ("", "élan VITAL", "x"), ("a", "b", None), (None, None, "ß Big")], "a string, b string, c string")
    got = [r[0] for r in df.select(text.display_phrase("a", "b", "c")).collect()]
    assert got[:3] == ["", "Élan vital", "A"] and got[3].endswith(" big")


@pytest.mark.parametrize(
    "path, stem, kind",
    [
        ("/a/b.c/clip.MP4", "clip", "video"),
        ("song.tar.flac", "song.tar", "audio"),
        ("x/pic.jpeg", "pic", "image"),
        ("x/notes.txt", "notes", None),
        ("x.y/none", "none", None),
        (".mp4", ".mp4", None),
    ],
)
def test_paths(spark, path, stem, kind):
    assert values(spark, text.file_stem("c"), [path]) == [stem]
    assert values(spark, text.media_type("c"), [path]) == [kind]


def test_top_queries_round_trip(spark):
    df = spark.sql("SELECT array(named_struct('query', 'ä b', 'cnt', 2L), named_struct('query', 'c', 'cnt', 1L)) AS q")
    encoded = df.select(text.encode_top_queries("q").alias("c"))
    assert encoded.select(text.decode_top_queries("c").alias("v")).first()["v"] == ["ä b", "c"]
    cases = ['["x", "y"]', "[('a', 2)]", "plain", None]
    assert values(spark, text.decode_top_queries("c"), cases) == [["x", "y"], ["[('a', 2)]"], ["plain"], None]
