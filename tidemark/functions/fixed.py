"""Word lists, lookup tables and patterns that the curation rules are defined by."""

# Fixed values.
NULL_WORDS = ["null", "none", "unknown", "unknown album", "unknown artist", "unknown genre", "n/a", "na", "tba", "tbd"]
GENERIC_GENRES = ["other", "misc", "miscellaneous", "unknown", "unknown genre", "n/a"]
GENERIC_ALBUMS = ["album title goes here", "random album title", "random album title promo cd", "unknown album", "untitled album"]
MINOR_WORDS = ["a", "an", "and", "as", "at", "but", "by", "da", "de", "del", "der", "di", "du", "for", "feat", "featuring", "from", "ft", "in", "la", "le", "n", "nor", "of", "on", "or", "the", "to", "van", "von", "vs", "with", "x"]
NOISE_WORDS = ["feat", "featuring", "ft", "the", "and", "with", "vs", "vs."]
VERSION_WORDS = ["remix", "mix", "edit", "extended", "radio", "club", "original", "bootleg", "vip", "mashup", "acapella", "instrumental", "version", "rework", "dub"]
FORMAT_QUALITY = {".flac": 8, ".wav": 7, ".aiff": 7, ".aif": 7, ".alac": 6, ".m4a": 5, ".aac": 4, ".ogg": 4, ".opus": 4, ".mp3": 3, ".wma": 2}
OUTPUT_EXTENSIONS = [".aac", ".aif", ".aiff", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma"]
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
FIELD_WEIGHTS = {"title": 4.0, "artist": 4.0, "album_artist": 1.0, "album": 1.0, "date": 1.0, "track_number": 0.5, "disc_number": 0.5, "genre": 1.0, "compilation": 0.5, "needs_review": 1.0}
PRIORITIES = {"Low": 1, "Medium": 2, "High": 3}

AUDIO_SUFFIX = r"\.(?:mp3|flac|wav|m4a|aac|ogg|opus|wma)$"
SITES = r"(?:com|net|org|co|io|ru|cc|tv|me|fm|biz|info|xyz|uk|au)"
DOMAIN = rf"(?:https?://|www\.)[^\s\])}}]+|\b[\w.-]+\.{SITES}(?:/[^\s\])}}]*)?"
REVIEW_DOMAIN = rf"(?:https?://|www\.)|\b[\w.-]+\.{SITES}(?:\b|/)"
HANDLE = r"(?<![\w@])@[A-Za-z0-9_.-]+"
BPM = r"\b\d{2,3}(?:\s*-\s*\d{2,3})?\s*bpm\b"
TECHNICAL_SUFFIX = r"(?:[-_ ]+(?:mp3|flac|wav|aac))(?:[-_ ]+\d{2,4})?\s*$"
PRODUCER = r"\s*[\[(]\s*(?:co-)?prod(?:uced)?\.?\s*(?:by\s+)?[^\])]*(?:[\])]|$)"
BARE_PRODUCER = r"\s+(?:co-)?prod(?:uced)?\.?\s+by\b.*$"
LEET_YEAR = r"\s*[\[(]\s*[12](?=[0-9oO]*[oO])[0-9oO]{3}\s*[\])]\s*"
DRM = r"\s+DRM\b"
BRACKETED_NOISE = r"\s*[\[(]\s*(?:free\s*(?:d/?l|download)|download|promo(?:tional)?(?:\s+use\s+only)?|official\s*(?:audio|video)|(?:youtube|soundcloud)(?:\s*rip)?|exclusive|premiere|via|(?:hq|hd|high\s*quality)|\d{2,4}\s*kbps|(?:mp3|flac|wav|aac))\s*[\])]\s*"
TRAILING_NOISE = r"\s*(?:[-–—|]\s*|\s+)(?:free\s*(?:d/?l|download)|download|promo(?:tional)?|official\s*(?:audio|video)|(?:youtube|soundcloud)(?:\s*rip)?|\d{2,4}\s*kbps|(?:mp3|flac|wav|aac))\s*$"
KEY = r"(?:[1-9]|1[0-2])(?:[AB]|[mMdD])(?:\s*[/_]\s*(?:[1-9]|1[0-2])(?:[AB]|[mMdD]))?"
KEY_SUFFIX = rf"(?:\s*[-–—|]\s*(?:{KEY}(?:\s*-\s*\d+){{0,3}}|\d{{2,3}}(?:\.\d+)?\s*bpm|energy\s*\d+)|\s*[\[(]\s*{KEY}(?:\s*-\s*\d+){{0,3}}\s*[\])])\s*$"
MASTER_SUFFIX = r"\s+(?:MASTER(?:ED)?|PREMASTER|FINAL(?:\s+MASTER)?|DEMO\s+MASTER)(?:\s+[A-Z]{2,10}[-_]?\d{2,8})?\s*$"
REVIEW_MASTER = r"(?:^|[\s_(\[])(?:premaster|master(?:ed)?|final(?:\s+master)?)(?:\s+[A-Z]{2,10}[-_]?\d{2,8})?[)\]]?\s*$"
PROMOTIONAL = r"\b(?:free\s*(?:d/?l|download)|promo(?:tional)?|official\s+(?:audio|video)|\d{2,3}(?:\.\d+)?\s*bpm)\b"
MOJIBAKE = "�|Ã.|Â.|â[\u0080-¿]"
FEATURE = r"\s+\b(?:feat(?:uring)?|ft)\.?\s*"
CONTEXT_VERSION = r"\s*[\[(][^\])]*(?:remix|mix|edit|version|vip|bootleg|rework|dub|radio|extended|vocal|feat(?:uring)?|ft\.?)[^\])]*[\])]"
TITLE_CONTEXT = r"\s*[\[(][^\])]*(?:remix|mix|edit|version|vip|bootleg|rework|dub|radio|extended|vocal|instrumental|acapella|live|demo|feat(?:uring)?|ft\.?)[^\])]*[\])]"
VERSION_ONLY = r"\s*[\[(].*(?:remix|mix|edit|vip|bootleg|rework|dub|style).*?[\])]\s*"
COMPILATION_ALBUM = r"\b(?:various\s+artists|compilation|anthology|volume|vol\.?\s*0*\d+)\b"
COVER_CONTEXT = r"\bkaraoke\b|\boriginally performed by\b"
COVER_REASON = "Filename identifies a karaoke or cover performer that differs from the model attribution; verify the exact recording identity."
PLACEHOLDER = r"^(?:audio|song|track|unknown|untitled)(?:\s*\d+)?$"
EMPTY_BRACKETS = r"\s*[\[(]\s*[|:/-]*\s*[\])]\s*"
COPY_SUFFIXES = r"(?:\s*\(\d+\)|\s*-\s*\d+)"
EDGE_MARKS = " -–—|_.,>"
CASED_WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?"

# Signs: without a match, none of the patterns that they stand for matches, so a cleaner can leave these out.
#: DOMAIN, BPM, EMPTY_BRACKETS and all patterns of a noise pass.
NOISE_SIGN = r"[./]|\d\s*(?:bpm|kbps)|[-–—|]\s*\d|[-–—|_\s](?:free|download|promo|official|youtube|soundcloud|mp3|flac|wav|aac|master|premaster|final|demo|energy)|[\[(](?:\s|\d|[|:/-]*[\])]|free|download|promo|official|youtube|soundcloud|exclusive|premiere|via|h[qdi]|mp3|flac|wav|aac)|\s[\])]"
#: PRODUCER, BARE_PRODUCER, LEET_YEAR, DRM and underscores; TRACK_PREFIX, DASHED_VERSION and QUOTED_TITLE; PRODUCER, FEATURE and DASHED_FEATURE.
CREDIT_SIGN = r"_|[\[(\s](?:\s*[12]|(?:co-)?prod|drm)"
VERSION_SIGN = r"""^(?:\(?\d|['"])|[-–—]\s*\("""
GUEST_SIGN = r"[\[(\s](?:(?:co-)?prod|feat|ft)"

# Fixed values of tags in evidence.
IMAGE_KEYS = ["apic", "attached picture", "cover art", "coverart", "covr", "metadata block picture", "metadata_block_picture", "picture", "wm/picture"]
EVIDENCE_ALIASES = {
    "title": ["title", "tit2", "©nam"],
    "artist": ["artist", "artists", "tpe1", "©art"],
    "albumArtist": ["albumartist", "album artist", "tpe2", "aart"],
    "album": ["album", "talb", "©alb"],
    "date": ["date", "year", "tdrc", "tyer", "tdor", "tdrl", "©day", "txxx:recording_date", "txxx:release_time", "txxx:year"],
    "trackNumber": ["track", "tracknumber", "track number", "trck", "trkn"],
    "discNumber": ["disc", "discnumber", "disc number", "tpos", "disk"],
    "genre": ["genre", "tcon", "©gen"],
    "compilation": ["compilation", "tcmp", "cpil"],
}
REVIEW_ALIASES = {
    "original_title": ["TIT2", "title", "©nam"],
    "original_artist": ["TPE1", "artist", "©ART"],
    "original_album_artist": ["TPE2", "albumartist", "album artist", "aART"],
    "original_album": ["TALB", "album", "©alb"],
    "original_key": ["TKEY", "initialkey"],
}
VALUE_WRAPPERS = ["text", "value", "values", "data"]

# Fixed values of tags that a rewritten file may have.
ID3_FRAMES = ["APIC", "TALB", "TCMP", "TCON", "TDRC", "TIT2", "TPE1", "TPE2", "TPOS", "TRCK"]
MP4_KEYS = ["©nam", "©ART", "aART", "©alb", "©day", "trkn", "disk", "©gen", "cpil", "covr"]
ID3_FIELDS = {"title": "TIT2", "artist": "TPE1", "album_artist": "TPE2", "album": "TALB", "date": "TDRC", "track_number": "TRCK", "disc_number": "TPOS", "genre": "TCON", "compilation": "TCMP"}
MP4_FIELDS = {"title": "©nam", "artist": "©ART", "album_artist": "aART", "album": "©alb", "date": "©day", "track_number": "trkn", "disc_number": "disk", "genre": "©gen", "compilation": "cpil"}

# Fixed values of the cleaners' own patterns.
PRICE_PREFIX = r"^\$\d+\s+"
CODE_PREFIX = r"^\[\s*[A-Za-z_.-]*\d+[A-Za-z0-9_.-]*\s*\]\s*"
DASHED_FEATURE = r"\s*-\s*\(\s*feat\.\s*(.*?)\s*\)\s*$"
VIA = r"[\[(]\s*via\b"
TRACK_PREFIX = r"^(?:\(?0\d{1,2}\)?(?:\s*[-._]\s*|\s+)|\(?\d{2,3}\)?\s*[-._]\s+)"
DASHED_VERSION = r"\s*[-–—]\s*(\([^)]*(?:remix|mix|edit|vip|bootleg|rework|dub)[^)]*\))\s*$"
QUOTED_TITLE = r"""^['"](.+?)['"](?=\s*(?:\(|$))"""

# Fixed values of the rules for a verifier's feedback.
FILE_TERMS = ["source file", "filename", "file name"]
CASING_TERMS = ["casing", "capitalization", "capitalisation"]
SOUND_TERMS = ["correct and should remain", "already correct", "is sound", "no review needed", "no change needed", "no changes needed", "output metadata is correct", "outputmetadata is correct"]
OPTIONAL_TERMS = ["album", "albumartist", "album artist", "date", "year", "genre", "tracknumber", "track number", "discnumber", "disc number", "compilation"]
SOURCE_TERMS = ["source", "original metadata", "originalmetadata", " tag", "path"]
PRESERVE_TERMS = ["is missing", "should be preserved", "should include", "corrected to include"]
INCLUDE_TERMS = ["include", "preserve", "missing", "lost"]
FEEDBACK_VERSIONS = ["remix", "mix", "edit", "vip", "bootleg"]
REMOVAL_TERMS = ["remove", "drop", "strip"]
LOST_VERSIONS = ["remix", "edit", "mix", "vip", "bootleg"]
