import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "column, given, wanted",
    [
        (X.clean_text, [None, "  a \n b "], ["", "a b"]),
        (X.clean_optional, ["Unknown", " N/A ", "a\x07b", "ﬁne"], [None, None, "ab", "fine"]),
        (X.remove_noise, ["Song (Free Download)", "www.x.com Song - 128 BPM", "Song [320 kbps] [HQ]", "Song - 5A", "Plain"], ["Song", "Song", "Song", "Song", "Plain"]),
        (X.clean_artist, ["One ft. Two", "$1 Three.mp3", "none"], ["One feat. Two", "Three", None]),
        (X.clean_album, ["Untitled Album", "Real (via x)", "Real"], [None, None, "Real"]),
        (lambda c: X.clean_genre(c, ["Blues", "Rock"]), ["(1)", "9", "House House", "@x", "Misc"], ["Rock", None, "House", None, None]),
        (X.clean_date, ["2001", "2001-13", "2001-1", "2001\n"], ["2001", "2001-13", None, "2001"]),
        (X.positive_integer, ["3", "0", "x", None], [3, None, None, None]),
        (X.normalize_identity, ["Straße!", None, "Ärger"], ["strasse", "", "rger"]),
        (X.copy_suffix_depth, ["a", "a (1)", "a (1) - 2", "a 2"], [0, 1, 2, 0]),
        (lambda c: X.sanitize_component(c, F.lit("x")), ["a:b", "a / b", "con", "what?", " . ", None], ["a-b", "a - b", "_con", "what？", "x", "x"]),
        (X.concise_source, ["C:\\a\\b\\c.mp3", "c.mp3"], ["a\\b\\c.mp3", "c.mp3"]),
        (X.suffix, ["C:\\a.b\\c.MP3", "plain"], [".mp3", ""]),
        (X.duration_text, ["5", "65", "3605"], ["5s", "1m 05s", "1h 00m 05s"]),
        (X.proposed_title, ['Title should be "A B"', "should be 'C'", "no"], ["A B", "C", None]),
        (X.repair_mojibake, ["Ïðèâåò ìèð", "Zoë"], ["Привет мир", "Zoë"]),
        (X.core_title, ["song extended mix"], ["song"]),
        (X.context_key, ["Some Song (Remix)", "Track 1", "abc"], ["some song", None, None]),
    ],
)
def test_columns(spark, column, given, wanted):
    assert values(spark, column, *given) == wanted


def test_noise_of_any_depth(spark):
    deep = "Song" + " " + "(" * 12 + ")" * 12
    many = "Song" + " [HQ] - promo" * 15
    assert values(spark, X.remove_noise, deep, many, "", None) == ["Song", "Song", "", None]
    assert values(spark, X.noise_settled, deep, many, "", None) == [True, True, True, None]


def test_title_with_artist(spark):
    rows = spark.createDataFrame([("Band - Song", "Band"), ("Song (Band - 5A)", "Band"), ("01 - Song_mp3", "B.*"), ("Song", None)], "t string, a string")
    assert [r[0] for r in rows.select(X.clean_title(F.col("t"), F.col("a"))).collect()] == ["Song", "Song", "Song", "Song"]


def test_image_and_assignment(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"), "a=b=c"), (bytearray(b"GIF89a.."), "a="), (None, None)], "b binary, s string")
    got = rows.select(X.image_mime(F.col("b")), X.parse_assignment(F.col("s"))).collect()
    assert [r[0] for r in got] == ["image/jpeg", "image/gif", None]
    assert [r[1] and tuple(r[1]) for r in got] == [("a", "b=c"), None, None]
