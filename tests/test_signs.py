"""Signs stand for all patterns that they let a cleaner leave out, and texts without a sign pass unsearched."""

import random

from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions import text as X

PARTS = [
    "Song", "Название", "(", ")", "[", "]", " ", "  ", " ", "-", "–", "|", "_", ".", "/", ":", ",", "'", '"', "\n", "1", "12", "128", "320", "2o19", "01", "8A", "8a", "11m", "bpm", "BPM", "kbps", "mp3", "FLAC", "wav", "aac",
    "free", "d/l", "dl", "download", "promo", "promotional", "use only", "official", "audio", "video", "youtube", "soundcloud", "rip", "exclusive", "premiere", "via", "hq", "hd", "high quality", "energy", "MASTER", "MASTERED", "PREMASTER", "FINAL", "DEMO",
    "AB-12", "www.", "x.com", "https://", "prod", "co-prod", "produced", "by", "DRM", "feat", "feat.", "ft.", "featuring", "Remix", "Live", "ſoundcloud", "٣",
]
PATTERNS = {
    "NOISE_SIGN": [fixed.DOMAIN, fixed.BPM, fixed.EMPTY_BRACKETS, fixed.BRACKETED_NOISE, fixed.TRAILING_NOISE, fixed.KEY_SUFFIX, fixed.MASTER_SUFFIX, fixed.TECHNICAL_SUFFIX, r"[\[(]\s+", r"\s+[\])]"],
    "CREDIT_SIGN": [fixed.PRODUCER, fixed.BARE_PRODUCER, fixed.LEET_YEAR, fixed.DRM, "_"],
    "VERSION_SIGN": [fixed.TRACK_PREFIX, fixed.DASHED_VERSION, fixed.QUOTED_TITLE],
    "GUEST_SIGN": [fixed.PRODUCER, fixed.FEATURE, fixed.DASHED_FEATURE],
}


def test_no_pattern_matches_without_its_sign(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) + r.choice(["", "", " "]) for _ in range(r.randint(1, 5))) for _ in range(40_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, patterns in PATTERNS.items():
        some = [F.col("t").rlike(f"(?iuU){p}") for p in patterns]
        bare = rows.where(~F.col("t").rlike(f"(?iuU){getattr(fixed, name)}"))
        assert bare.count() > 1000
        assert bare.where(F.greatest(*[x.cast("int") for x in some]) == 1).limit(3).collect() == [], name


def test_a_text_without_signs_is_searched_once(spark):
    """Many patterns in a row, each of which reads the text, are left out."""
    seen = []
    pattern = lambda x: seen.append(1) or F.concat(x, F.lit("!"))
    rows = spark.createDataFrame([("Song (Live)",), ("Song (Free Download)",), (None,)], "t string")
    got = [x[0] for x in rows.select(X.where_signs(F.col("t"), fixed.NOISE_SIGN, pattern)).collect()]
    assert got == ["Song (Live)", "Song (Free Download)!", None] and seen
