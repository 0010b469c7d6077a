"""Column functions on text: predicates, tokens, masks, similarity. All are built-ins, but for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written so that Java and RE2 read it alike.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = f"[^{WHITE}]+"
#: The same for Java alone: what is no white space for most characters is known by their range, before the long class is asked.
GAP, INK = rf"[\x00-\x20\x7F-\x{{10FFFF}}&&[{WHITE}]]+", f"[!-~[^{WHITE}]]"
#: Dates at the start of a token: year-month or a whole month-day; what follows the first form does not matter.
DATE = r"^(?:\p{Nd}{2,4}[-年/]\p{Nd}{1,2}|\p{Nd}{1,2}[-月/]\p{Nd}{1,2}日?\z)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
#: What stands for a person where no recogniser is given: mail names, phone and card numbers.
ENTITY = r"[A-Za-z0-9_+-]+@[A-Za-z0-9-]+|\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{16}"
SENTENCE = r"[^.!?]+[.!?]*"


def words(text: Column) -> Column:
    """Runs without white space: those of ``WORD``. Cutting at the gaps is several times faster than extracting each match."""
    return F.array_remove(F.split(text, GAP, -1), "")


def words_of(text: pa.Array) -> pa.Array:
    """``words`` of an Arrow array (valid UTF-8), as lists; Arrow's white space is that of ``WHITE``. Null for a text without words."""
    bare = pc.utf8_trim_whitespace(text)
    return pc.utf8_split_whitespace(pc.if_else(pc.equal(bare, ""), pa.scalar(None, bare.type), bare))


def word_count(text: Column) -> Column:
    return F.array_size(words(text)).cast("long")


def two_words(text: Column) -> Column:
    """Whether there are at least two words; reads no further than the second."""
    return text.rlike(INK + GAP + INK)


def nonempty(text: Column) -> Column:
    """False for null and ''; ' ' is text."""
    return F.coalesce(F.length(text), F.lit(0)) > 0


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_oneword(tokens: Column) -> Column:
    """Tokens of at least two words."""
    return F.filter(tokens, two_words)


def drop_dates(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(DATE))


def script_words(text: Column) -> Column:
    """Words cut where the script changes between Han, kana and others; for text that has no blanks."""
    return F.regexp_extract_all(text, F.lit(rf"\p{{IsHan}}+|\p{{IsHiragana}}+|\p{{IsKatakana}}+|[^{WHITE}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]+"), F.lit(0))


def mask_pii(text: Column, email: str = "<EMAIL>", phone: str = "<PHONE>") -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, email), PHONE, phone)


def pattern_exceeds(text: Column, pattern: str, most: int) -> Column:
    """Whether ``pattern`` occurs more than ``most`` times."""
    return F.regexp_count(text, F.lit(pattern)) > most


def keyword_ratio_exceeds(text: Column, keywords: str, threshold: float = 0.01) -> Column:
    """Whether the hits of the pattern ``keywords`` are more than ``threshold`` of the words; never without words."""
    return F.coalesce(F.regexp_count(text, F.lit(keywords)) / F.nullif(word_count(text), F.lit(0)) > threshold, F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length; null if both are empty."""
    return 1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def sentences(text: Column) -> Column:
    """Stripped sentences of all lines that end with a full stop, in order."""
    every = F.flatten(F.transform(lines(text), lambda p: F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0))))
    return F.filter(F.transform(every, strip), lambda s: F.endswith(s, F.lit(".")))


def hash32(text: Column) -> Column:
    """The first 32 bits of md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sha256_mod(text: Column, n: int) -> Column:
    """The whole SHA-256 as one number, mod n (n below 2**31): Horner's rule over its eight 32-bit digits."""
    h = F.sha2(text.cast("binary"), 256)
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: (a * ((1 << 32) % n) + x) % n)


def normalizer(form: str = "NFKC"):
    """A function that brings text into a Unicode normal form, a batch at a time."""

    @F.arrow_udf("string")
    def normalize(text: pa.Array) -> pa.Array:
        fix = lambda x: x if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x)
        return pa.array([fix(x) for x in text.to_pylist()], pa.string())

    return normalize


def guarded(change):
    """A column function of a Python function of one text, an Arrow batch at a time; a text on which it raises becomes null."""

    def one(x):
        try:
            return None if x is None else change(x)
        except Exception:  # noqa: BLE001  whatever it is, one text must not end the job
            return None

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in text.to_pylist()], pa.string())

    return run
