"""Scalar text functions as Column expressions: cleaning, speech rewriting, counts, numerals, sentences, chunks.

Patterns name ASCII word boundaries and the white space of the web's string functions explicitly:
Java's own \\b and \\s cover other characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of String.trim and \s in a browser, for a character class; read alike by Java and RE2.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: An ASCII word boundary.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# They must equal the reference's for equal results.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe"}
HYPHENS = "\u2010\u2011\u2012\u2043\u2212\uff0d"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLES = "\u00ad\u200b\u200c\u200d\u2060\ufeff\ufffd"
BULLETS = "\u2023\u25cf\u25aa\u25e6\u00b7\u2219\u25cb\u25a0"
QUOTES = {"‚": ",", "‛": "'", "„": '"', "′": "'", "″": '"', "ʼ": "'"}
ABBREVIATIONS = (
    "mr mrs ms dr prof rev hon st sr jr fr gen col lt sgt capt cmdr adm maj gov pres sen rep vs etc al ibid cf ca circa approx est inc ltd "
    "co corp dept univ assn bros ed eds vol vols no nos pp p ch chap fig figs sec ref trans jan feb mar apr jun jul aug sep sept oct nov dec "
    "mon tue tues wed thu thur thurs fri sat sun a b c d e f g h i j k l m n o q r s t u v w x y z"
).split()
MAX_CHARS, MIN_TAIL = 260, 40
PAUSES = {"clause": 130, "semicolon": 210, "sentence": 330, "paragraph": 520, "heading": 800, "chapter": 1100}
FOLD_FROM = HYPHENS + SPACES + BULLETS + "".join(QUOTES) + INVISIBLES
FOLD_TO = "-" * len(HYPHENS) + " " * len(SPACES) + "•" * len(BULLETS) + "".join(QUOTES.values())
#: (pattern, replacement with $1), for both engines.
CLEAN_RULES = [
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""),
    (r"[ \t]+", " "),
    (rf"[{WS}]+([,.;:!?%)\]}}])", "$1"),
    (rf"([(\[{{])[{WS}]+", "$1"),
    (rf"(?:[{WS}]*\.){{4,}}[{WS}]*", " "),
    (r"_{3,}", " "),
]
#: (pattern with ~ for a word boundary and {s} for white space, what must follow but stays, replacement, any case).
_S = rf"[{WS}]"
SPEECH_RULES = [
    (r"[\x{B9}\x{B2}\x{B3}\x{2070}\x{2074}-\x{2079}\x{2020}\x{2021}\x{A7}\x{B6}]", "", " ", False),
    (rf"~https?://[^{WS}]+", "", "link", True), (rf"~www\.[^{WS}]+", "", "link", True), (r"~[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+~", "", "email address", False),
    (rf"~e\.{_S}?g\.", f"{_S}|$", "for example,", True), (rf"~i\.{_S}?e\.", f"{_S}|$", "that is,", True), (r"~etc\.", f"{_S}|$", "et cetera.", True), (r"~cf\.", f"{_S}|$", "compare", True),
    (r"~viz\.", f"{_S}|$", "namely", True), (r"~vs\.?", f"{_S}|$", "versus", True), (rf"~ca\.{_S}", "[0-9]", "circa ", True), (rf"~fl\.{_S}", "[0-9]", "flourished ", True),
    (rf"~c\.{_S}", "[0-9]{3,4}~", "circa ", True), (rf"~pp\.{_S}?", "[0-9]", "pages ", True), (rf"~p\.{_S}?", "[0-9]", "page ", True), (rf"~ch\.{_S}?", "[0-9]", "chapter ", True),
    (rf"~vol\.{_S}?", "[0-9]|[IVX]", "volume ", True), (rf"~fig\.{_S}?", "[0-9]", "figure ", True), (rf"~no\.{_S}?", "[0-9]", "number ", True),
    (r"~B\.C\.E\.", "", "B C E", False), (r"~C\.E\.", "", "C E", False), (r"~B\.C\.", "", "B C", False), (r"~A\.D\.", "", "A D", False), (r"~a\.m\.", "", "a m", True), (r"~p\.m\.", "", "p m", True),
    (r"~U\.S\.A\.", "", "U S A", False), (r"~U\.S\.", "", "U S", False), (r"~U\.K\.", "", "U K", False),
    (rf"([0-9]){_S}*[-\x{{2013}}]{_S}*([0-9])", "", "$1 to $2", False), (rf"{_S}[\x{{2013}}\x{{2014}}]{_S}", "", ", ", False), (r"\x{2014}", "", ", ", False), (r"&", "", " and ", False),
    (rf"([0-9]){_S}*%", "", "$1 percent", False), (rf"\${_S}?([0-9,.]+){_S}?(billion|million|trillion)~", "", "$1 $2 dollars", True), (rf"\${_S}?([0-9,.]+)", "", "$1 dollars", False),
    (rf"\x{{A3}}{_S}?([0-9,.]+)", "", "$1 pounds", False), (rf"\x{{20AC}}{_S}?([0-9,.]+)", "", "$1 euros", False), (rf"\x{{B0}}{_S}?C~", "", " degrees Celsius", False), (rf"\x{{B0}}{_S}?F~", "", " degrees Fahrenheit", False),
    (r"\x{B0}", "", " degrees", False), (r"\x{D7}", "", " by ", False), (r"\x{2260}", "", " not equal to ", False), (r"\x{2264}", "", " less than or equal to ", False), (r"\x{2265}", "", " greater than or equal to ", False),
    (rf"{_S}={_S}", "", " equals ", False), (r"\x{2192}", "", " to ", False), (r"\x{BD}", "", " one half", False), (r"\x{BC}", "", " one quarter", False), (r"\x{BE}", "", " three quarters", False), (rf"\[{_S}*sic{_S}*\]", "", "", True),
    (r"[\x{201C}\x{201D}]", "", '"', False), (r"[\x{2018}\x{2019}]", "", "'", False),
]
#: Between the first letter and the rest of a capital word, and behind it.
CAP_MARK, CAP_END = "\u0001", "\u0002"
CAPITALS = r"~([A-Z])([A-Z]{3,})~"
ELLIPSIS = rf"\.{_S}?\.{_S}?\."
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'\x{2019}-]*"
FOLIO = (
    rf"\A(?:[-\x{{2013}}\x{{2014}}\[(]?{_S}*[0-9]{{1,4}}{_S}*[-\x{{2013}}\x{{2014}}\])]?|(?i:[ivxlcdm]{{1,7}})|(?i:page){_S}+[0-9]{{1,4}}({_S}+(?i:of){_S}+[0-9]{{1,4}})?"
    rf"|[0-9]{{1,4}}{_S}*[|\x{{B7}}\x{{2022}}]{_S}*[^\n\r\x{{2028}}\x{{2029}}]{{0,40}}|[^\n\r\x{{2028}}\x{{2029}}]{{0,40}}{_S}*[|\x{{B7}}\x{{2022}}]{_S}*[0-9]{{1,4}})\z"
)
CHAPTER = (
    r"\A(?i:(chapter|chap\.?|part|book|section|canto|volume)" + _S + r"+([0-9]{1,3}|[ivxlcdm]{1,7}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)"
    r"|(prologue|epilogue|introduction|preface|foreword|afterword|conclusion|appendix|epigraph|dedication|acknowledgements?|acknowledgments?|notes|bibliography|index|glossary|about the author))~"
)
# End of the fixed values.


def bounded(pattern: str) -> str:
    """A rule's pattern for Java: a boundary before a letter is tested behind that letter, so that most places fail on the letter alone."""
    pattern = re.sub(r"^~(\[A-Z\]|\(\[A-Z\]\)|[A-Za-z])", lambda m: f"{m[1]}(?<![A-Za-z0-9_]{m[1].strip('()')})", pattern)
    pattern = re.sub(r"~$", "(?![A-Za-z0-9_])", pattern) if re.search(r"(?:[A-Za-z)]|\{3,\}\))~$", pattern) else pattern
    return pattern.replace("~", EDGE)


#: The characters of WS one by one.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation of its own."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean(c: Column) -> Column:
    """Glyphs, white space and control characters of extracted text made plain."""
    return clean_normal(nfc(c))


def clean_normal(c: Column) -> Column:
    """clean() of normalised text."""
    for glyph, letters in LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    c = F.translate(c, FOLD_FROM, FOLD_TO)
    return js_trim(reduce(lambda s, rule: F.regexp_replace(s, *rule), CLEAN_RULES, c))


#: Signs without which the patterns that name them match nothing; looking for one is cheap beside a pass of a pattern.
SIGNS = {"@": "@", "&": "&", "%": "%", "=": "=", r"\$": "$"} | {rf"\x{{{ord(x):X}}}": x for x in "£€°×≠≤≥→½¼¾"}


def speech(c: Column) -> Column:
    """A display text as a voice should read it (T2); the order of the rules matters."""
    for pattern, ahead, put, any_case in SPEECH_RULES:
        p = ("(?i)" if any_case else "") + bounded(pattern) + (f"(?={ahead.replace('$', chr(92) + 'z').replace('~', EDGE)})" if ahead else "")
        sign = next((x for code, x in SIGNS.items() if code in pattern.replace(WS, "")), None)
        # bound in an array of one, since what stands thrice in an expression is made thrice
        c = F.transform(F.array(c), lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, p, put)).otherwise(t))[0] if sign else F.regexp_replace(c, p, put)  # noqa: B023
    parts = F.split(F.regexp_replace(c, bounded(CAPITALS), f"$1{CAP_MARK}$2{CAP_END}"), CAP_MARK)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.lower(F.substring_index(p, CAP_END, 1)), F.substring(p, F.instr(p, CAP_END) + 1, F.length(p))))
    c = F.concat(parts[0], F.array_join(rest, ""))
    c = F.regexp_replace(c, ELLIPSIS, "…")
    c = F.regexp_replace(c, r"([,.;:!?])\1+", "$1")
    return js_trim(F.regexp_replace(c, rf"[{WS}]{{2,}}", " "))


def count_words(c: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens."""
    return F.size(F.regexp_extract_all(c, F.lit(WORD), 0)).cast("long")


def count_tokens(c: Column) -> Column:
    """Runs without white space."""
    return F.size(F.regexp_extract_all(c, F.lit(rf"[^{WS}]+"), 0)).cast("long")


def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral, subtractive but otherwise unchecked; 0 for any other character (T4)."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: F.coalesce(value[x], F.lit(0)))
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(F.exists(digits, lambda v: v == 0), 0).otherwise(F.aggregate(signed, F.lit(0), lambda a, v: a + v)).cast("long")


CLOSERS = r"""["'\x{201D}\x{2019})\]]"""
OPENERS = r"""[A-Z0-9"'\x{201C}\x{2018}(\[\x{C0}-\x{24F}]"""
ABBREVIATION = "|".join(sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
#: The stop itself comes first in the pattern, so the look-behinds run at stops only.
BOUNDARY = rf"(?:[!?\x{{2026}}]|\.(?<!(?<!\p{{L}})(?i:{ABBREVIATION})\.)(?:(?<![0-9]\.)|(?![{WS}]*+[0-9]))){CLOSERS}*+(?=[{WS}]++{OPENERS})"
MARK = "\u0001"


def sentences(c: Column) -> Column:
    """array<struct<text, offset>>: trimmed sentences without empty ones, and where each begins (K1, K2)."""
    raw = F.split(F.regexp_replace(c, BOUNDARY, f"$0{MARK}"), MARK)
    bind = lambda value, body: F.transform(F.array(value), body)[0]

    def placed(raw: Column) -> Column:
        # only numbers are folded; a trimmed sentence stands first where its blanks end
        begins = F.aggregate(F.transform(raw, lambda s: F.length(s)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return bind(begins, lambda at: F.transform(raw, lambda s, i: bind(js_trim(s), lambda t: F.struct(t.alias("text"), (F.get(at, i) + F.instr(s, t) - 1).alias("offset")))))

    return F.filter(bind(raw, placed), lambda s: s["text"] != "")


def last_index(c: Column, part: str) -> Column:
    """Last 0-based place of part in c, -1 for none."""
    return F.when(F.instr(c, part) == 0, -1).otherwise(F.length(c) - F.instr(F.reverse(c), part[::-1]) + 1 - len(part))


def pieces(text: Column, base: Column) -> Column:
    """array<struct<text, offset, pause>>: a sentence cut at the strongest stop within MAX_CHARS, again and again (K3)."""
    kind = "array<struct<text:string,offset:int,pause:int>>"
    one = lambda t, o, p: F.array(F.struct(t.alias("text"), o.cast("int").alias("offset"), p.cast("int").alias("pause")))
    bind = lambda value, body: F.transform(F.array(value), body)[0]

    def cut(w: Column) -> Column:
        strong = F.greatest(last_index(w, "; "), last_index(w, ": "))
        weak = F.greatest(last_index(w, ", "), last_index(w, " — "), last_index(w, " – "))
        blank = last_index(w, " ")
        at = F.when(strong >= MIN_TAIL, strong).when(weak >= MIN_TAIL, weak).when(blank >= MIN_TAIL, blank).otherwise(MAX_CHARS - 1)
        return F.struct(at.alias("at"), F.when(strong >= MIN_TAIL, PAUSES["semicolon"]).otherwise(PAUSES["clause"]).alias("pause"))

    def step(a: Column, _: Column) -> Column:
        c, n = a["c"], F.length(text)
        rest = F.struct(n.alias("c"), F.concat(a["out"], one(js_trim(F.substring(text, c + 1, n)), base + c, F.lit(PAUSES["sentence"]))).alias("out"))
        more = bind(cut(F.substring(text, c + 1, F.lit(MAX_CHARS))), lambda k: F.struct(
            (c + k["at"] + 1).alias("c"), F.concat(a["out"], one(js_trim(F.substring(text, c + 1, k["at"] + 1)), base + c, k["pause"])).alias("out"),
        ))
        return F.when(c >= n, a).when(n - c <= MAX_CHARS, rest).otherwise(more)

    start = F.struct(F.lit(0).alias("c"), F.array().cast(kind).alias("out"))
    many = F.aggregate(F.sequence(F.lit(1), F.ceil(F.length(text) / (MIN_TAIL + 1)).cast("int") + 1), start, step)["out"]
    return F.when(F.length(text) <= MAX_CHARS, one(text, base, F.lit(PAUSES["sentence"]))).otherwise(F.filter(many, lambda p: p["text"] != ""))


def duration(seconds: Column) -> Column:
    """'4h 12m', '38m', '45s'; '--' for negative or undefined (M1)."""
    minutes = F.floor(seconds / 60 + 0.5)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "--")
        .when(seconds < 60, F.concat(F.floor(seconds + 0.5).cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(rest > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h")))
    )


def file_size(n: Column) -> Column:
    """'B', whole 'KB', 'MB' with one decimal (M2)."""
    kb, mb = F.floor(n / 1024 + 0.5), F.floor(n / 1048576 * 10 + 0.5)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(mb / 10).cast("string"), F.lit("."), (mb % 10).cast("string"), F.lit(" MB")))


def percent(fraction: Column) -> Column:
    return F.concat(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * 100 + 0.5).cast("string"), F.lit("%"))


def effective_wpm(measured: Column, base: float, rate: float) -> Column:
    return F.when(measured > 40, measured.cast("double")).otherwise(F.lit(float(base) * rate))


def rate_step(rate: Column, up: bool) -> Column:
    """The rate one key step faster or slower, within 0.5 and 2."""
    return F.least(F.lit(2.0), F.round(rate + 0.05, 2)) if up else F.greatest(F.lit(0.5), F.round(rate - 0.05, 2))


def signature(c: Column) -> Column:
    """A head or foot line without its numbers (H2)."""
    c = F.regexp_replace(F.lower(c), "[0-9]+", "#")
    c = F.regexp_replace(c, "(?<![A-Za-z0-9_])[ivxlcdm]+(?![A-Za-z0-9_])", "#")
    return F.btrim(F.regexp_replace(c, "[^a-z#]+", " "))


def is_folio(c: Column) -> Column:
    """A line that is only a page number (H3)."""
    return js_trim(c).rlike(FOLIO)


def looks_like_chapter(c: Column) -> Column:
    """A heading that opens a chapter."""
    t = js_trim(c)
    bare = t.rlike(r"\A[0-9]{1,3}\z") | (t.rlike(r"\A[IVXLCDM]{1,7}\z") & (roman_to_int(t) > 0))
    return (F.length(t) > 0) & (F.length(t) <= 90) & (t.rlike(CHAPTER.replace("~", EDGE)) | bare)
