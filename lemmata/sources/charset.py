"""The character set of a file's bytes.

UTF-8 if it is valid, or what a byte order mark or ISO-2022 escapes say.  Else every candidate
that can read the bytes does, and the one under which they are likeliest wins.  A candidate's
statistics are of pairs of characters, learned from sentences of its languages (see
``samples``) and smoothed by its alphabet or, of two-byte sets, by the rows that the standard
gives to common characters.  A set that swallows the braces and backslashes of LaTeX pays for
it: plain characters count too.

Told apart: Western European (Windows-1252, Latin-1), Central European (Windows-1250, ISO-8859-2),
Cyrillic (Windows-1251, KOI8-R, ISO-8859-5), Greek (ISO-8859-7, Windows-1253), Hebrew (ISO-8859-8,
Windows-1255), Arabic (Windows-1256, ISO-8859-6), Japanese (EUC-JP, Shift-JIS), Chinese (GB18030,
Big5), Korean (EUC-KR).
"""

from __future__ import annotations

import codecs
import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

from .samples import SAMPLES

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
ESCAPES = ((b"\x1b$)C", "iso2022_kr"), (b"\x1b$", "iso2022_jp_2"), (b"\x1b(", "iso2022_jp_2"))
#: A plain character is taken to be one of so many.
PLAIN = 40


@dataclass(frozen=True)
class Rows:
    """Of a two-byte standard: the first bytes of its common characters, and how many they are."""

    charset: str
    first: int
    last: int
    size: int

    def has(self, c: str) -> bool:
        raw = c.encode(self.charset, "ignore")
        return len(raw) == 2 and self.first <= raw[0] <= self.last


# Where the standards have their common characters, and their signs.
COMMON = {
    "japanese": (Rows("euc_jp", 0xA4, 0xA5, 169), Rows("euc_jp", 0xB0, 0xCF, 2965), Rows("euc_jp", 0xA1, 0xA3, 200)),
    "simplified": (Rows("gb2312", 0xB0, 0xD7, 3755), Rows("gb2312", 0xA1, 0xA3, 200)),
    "traditional": (Rows("big5", 0xA4, 0xC6, 5401), Rows("big5", 0xA1, 0xA3, 400)),
    "korean": (Rows("euc_kr", 0xB0, 0xC8, 2350), Rows("euc_kr", 0xA1, 0xA3, 200)),
}
#: How much a two-byte set's rows count, in their order; the rest is for all other characters.
SHARE = {"japanese": (0.12, 0.12, 0.02), "simplified": (0.25, 0.02), "traditional": (0.25, 0.02), "korean": (0.25, 0.02)}
#: Scripts whose letters don't stand next to Latin ones; the share that does all the same.
APART, MIXED = ("cyrillic", "greek", "hebrew", "arabic"), 0.02
#: Signs that texts in any single-byte set have.
SIGNS = "«»“”„‘’–—…§°©·\xa0€¿¡"


def kind(c: str) -> str:
    """A plain character's kind; other characters are themselves."""
    return c if c > "\x7f" else "a" if c.isalpha() else " "


@dataclass
class Statistics:
    language: str
    pairs: Counter = field(default_factory=Counter)
    before: Counter = field(default_factory=Counter)
    single: Counter = field(default_factory=Counter)

    def __post_init__(self):
        text = SAMPLES[self.language]
        # titles in capitals are as likely as one letter in ten
        for sample, n in ((text, 9), (text.upper(), 1)) if self.language not in COMMON else ((text, 1),):
            for a, b in zip(f" {sample}", sample, strict=False):
                if b > "\x7f":
                    self.pairs[kind(a), b] += n
                    self.single[b] += n
                self.before[kind(a)] += n
        self.total = sum(self.single.values())
        self.known: dict[tuple[str, str], float] = {}

    def smooth(self, c: str) -> float:
        if self.language in COMMON:
            own = next((s / r.size for r, s in zip(COMMON[self.language], SHARE[self.language], strict=True) if r.has(c)), 0.0)
            return own + 1e-2 / 20_000
        return (0.08 if c in self.single else 0.01 if c in SIGNS else 0.002 if c.isalpha() else 0.0002) / 64

    def of(self, a: str, c: str) -> float:
        """The logarithm of how likely c is after a."""
        key = kind(a), c
        if key not in self.known:
            apart = self.language in APART and "a" in (key[0], kind(c)) and (c.isalpha() and a.isalpha())
            if c <= "\x7f":
                p = (MIXED if apart else 1.0) / PLAIN
            else:
                p = 0.55 * self.pairs[key] / (self.before[key[0]] + 2) + (0.25 * self.single[c] / self.total + self.smooth(c)) * (MIXED if apart else 1.0)
            self.known[key] = math.log(p)
        return self.known[key]


@cache
def statistics(language: str) -> Statistics:
    return Statistics(language)


#: (character set, whose statistics, what a lesser claim costs)
CANDIDATES = (
    ("cp1252", "western", 0.0), ("latin_1", "western", 1.0),
    ("euc_jp", "japanese", 1.0), ("shift_jis", "japanese", 1.0), ("cp932", "japanese", 2.0),
    ("gb18030", "simplified", 1.0), ("big5", "traditional", 1.0), ("cp950", "traditional", 2.0), ("euc_kr", "korean", 1.0), ("cp949", "korean", 2.0),
    ("cp1251", "cyrillic", 1.0), ("koi8_r", "cyrillic", 1.0), ("iso8859_5", "cyrillic", 2.0),
    ("cp1250", "central", 1.0), ("iso8859_2", "central", 1.5),
    ("iso8859_7", "greek", 1.5), ("cp1253", "greek", 2.0), ("iso8859_8", "hebrew", 1.5), ("cp1255", "hebrew", 2.0), ("cp1256", "arabic", 1.5), ("iso8859_6", "arabic", 2.0),
)


def likelihood(text: str, language: str) -> float:
    """The logarithm of how likely the whole text is."""
    of = statistics(language).of
    return sum(n * of(a, c) for (a, c), n in Counter(zip(f" {text}", text, strict=False)).items())


def decode(raw: bytes) -> str:
    for mark, charset in MARKS:
        if raw.startswith(mark):
            return raw.decode(charset, errors="replace")
    if raw.isascii():
        for escape, charset in ESCAPES:
            if escape in raw:
                try:
                    return raw.decode(charset)
                except UnicodeDecodeError:
                    continue
    if b"\0" in raw and len(raw) % 2 == 0:
        for charset, zeros in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])):
            if 2 * zeros.count(0) > len(zeros):
                return raw.decode(charset, errors="replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    best, text = -math.inf, None
    for charset, language, cost in CANDIDATES if b"\0" not in raw else ():
        try:
            read = raw.decode(charset)
        except UnicodeDecodeError:
            continue
        # control characters are no text
        if any("\x80" <= c < "\xa0" for c in set(read)) and charset != "latin_1":
            continue
        if (score := likelihood(read, language) - cost) > best:
            best, text = score, read
    return raw.decode("utf-8", errors="replace") if text is None else text
