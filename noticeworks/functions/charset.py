"""Code pages from content: which one makes the bytes of a page the likeliest text.

Each code page has a model of pairs of characters, by kinds: how often a kind follows another, learned from a few sentences of the
languages written in it, and how many characters the code page has of a kind. Kinds come from the code pages themselves: GB 2312,
Big5, JIS X 0208 and KS X 1001 put the common characters into one range and the rare ones into another, so a text read in a wrong code page
turns rare, mixed or broken. The likelihoods of all code pages are of the same bytes, so they can be compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np

#: First article of the Universal Declaration of Human Rights, by language.
ARTICLE = {
    "zh-Hans": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "zh-Hant": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
}


@dataclass(frozen=True)
class CodePage:
    """Codec by name and, for bytes beyond it, its superset; languages written in it; lead bytes of its common ideographs."""

    name: str
    superset: str
    languages: tuple[str, ...]
    common: tuple[int, int] = (0, 0)


#: Where each standard has its first level of ideographs (lead bytes).
CODE_PAGES = (
    CodePage("gb18030", "gb18030", ("zh-Hans",), (0xB0, 0xD7)),
    CodePage("big5", "big5hkscs", ("zh-Hant",), (0xA4, 0xC6)),
    CodePage("shift_jis", "cp932", ("ja",), (0x88, 0x98)),
    CodePage("euc_jp", "euc_jp", ("ja",), (0xB0, 0xCF)),
    CodePage("euc_kr", "cp949", ("ko",), (0, 0)),
    CodePage("cp1252", "cp1252", ("de", "fr", "es")),
    CodePage("cp1251", "cp1251", ("ru",)),
    CodePage("koi8_r", "koi8_r", ("ru",)),
)

KINDS = ("space", "digit", "mark", "lower", "upper", "accented", "Accented", "cyrillic", "Cyrillic", "symbol", "wide mark", "wide letter", "kana", "half kana", "hangul", "common", "rare", "broken")
_KIND = {k: i for i, k in enumerate(KINDS)}
#: Count that every pair of kinds has before any is seen.
_PRIOR = 0.02
#: Fewer bytes beyond ASCII tell nothing.
LEAST_BYTES = 12
_LONG_ASCII = re.compile(rb"([\x00-\x7f]{4})[\x00-\x7f]+([\x00-\x7f]{4})")


def _kind(c: str, page: CodePage) -> str:
    p = ord(c)
    if p < 128:
        return "space" if c.isspace() else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "mark"
    if 0x4E00 <= p <= 0x9FFF or 0xF900 <= p <= 0xFAFF:
        try:
            lead = c.encode(page.name)[0]
        except UnicodeEncodeError:
            return "rare"
        trail = c.encode(page.name)[1]
        standard = trail >= 0xA1 or page.name in ("big5", "shift_jis")
        return "common" if standard and page.common[0] <= lead <= page.common[1] else "rare"
    if 0xAC00 <= p <= 0xD7A3:
        return "hangul" if _in_two_bytes(c, page.name) else "rare"
    if 0x3040 <= p <= 0x30FF:
        return "kana"
    if 0xFF61 <= p <= 0xFF9F:
        return "half kana"
    if 0x3000 <= p <= 0x303F or 0xFF00 <= p <= 0xFF0F or 0xFF1A <= p <= 0xFF20 or 0x2010 <= p <= 0x2026:
        return "wide mark"
    if 0xFF10 <= p <= 0xFF5E:
        return "wide letter"
    if 0x400 <= p <= 0x4FF:
        return "cyrillic" if c.islower() else "Cyrillic"
    if p <= 0x24F and c.isalpha():
        return "accented" if c.islower() else "Accented"
    if p < 0xA0 or c == "�" or 0xE000 <= p <= 0xF8FF:
        return "broken"
    return "symbol"


def _in_two_bytes(c: str, codec: str) -> bool:
    try:
        return len(c.encode(codec)) == 2  # the codec spells other syllables in eight
    except UnicodeEncodeError:
        return False


class PairModel:
    """Log-likelihood of a text in one code page."""

    def __init__(self, page: CodePage):
        self.page = page
        self.kind = np.full(1 << 16, _KIND["broken"], np.uint8)
        seen = {chr(p) for p in range(128)}
        for lead in range(128, 256):
            seen |= set(bytes([lead]).decode(page.superset, "ignore"))
            for trail in range(0x40, 256):
                seen |= set(bytes([lead, trail]).decode(page.superset, "ignore"))
        known = sorted(ord(c) for c in seen if ord(c) < 1 << 16)
        self.kind[known] = [_KIND[_kind(chr(p), page)] for p in known]
        size = np.maximum(np.bincount(self.kind[known], minlength=len(KINDS)), 1)
        size[_KIND["broken"]] = 1 << 12
        pairs = np.full((len(KINDS), len(KINDS)), _PRIOR)
        for language in page.languages:
            whole = ARTICLE[language]
            pieces = (whole[i : i + 6] for i in range(0, len(whole), 6))
            for text in (whole, "\n".join(f"<p class='a1'>{piece}</p> 2024-06-01" for piece in pieces)):
                k = self.kinds(text)
                np.add.at(pairs, (k[:-1], k[1:]), 1)
        pairs[:, _KIND["broken"]] = _PRIOR / 100
        self.log = np.log(pairs / pairs.sum(axis=1, keepdims=True)) - np.log(size)

    def kinds(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.kind[np.where(points < 1 << 16, points, 0xFFFD)]

    def log_likelihood(self, raw: bytes) -> float:
        k = self.kinds(" " + raw.decode(self.page.superset, "replace"))
        return float(self.log[k[:-1], k[1:]].sum())


@cache
def models() -> tuple[PairModel, ...]:
    return tuple(map(PairModel, CODE_PAGES))


def rank_code_pages(raw: bytes) -> list[tuple[str, float]]:
    """(code page, log-likelihood), the likeliest first. Long runs of ASCII, which are alike in all of them, are shortened first."""
    short = _LONG_ASCII.sub(rb"\1\2", raw)
    return sorted(((m.page.name, m.log_likelihood(short)) for m in models()), key=lambda x: -x[1])


def detect(raw: bytes) -> str | None:
    """Code page of a page without a declared one; None if too few bytes are beyond ASCII to tell. Valid UTF-8, ASCII included, is UTF-8."""
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    if len(raw.translate(None, bytes(range(128)))) < LEAST_BYTES:
        return None
    return rank_code_pages(raw)[0][0]


def decode_as(raw: bytes, name: str) -> str:
    """Text in a detected code page, by its superset where that is needed, broken characters replaced."""
    page = next((p for p in CODE_PAGES if p.name == name), None)
    for codec in (name, page.superset if page else name):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode(page.superset if page else name, "replace")

