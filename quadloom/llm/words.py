"""Plain words of a text, whatever its markup and character forms."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_NOTE = re.compile(r"(?is)<(script|style)\b[^<>]*>.*?</\1\s*>|<(sup|sub)\b[^<>]*>.{0,200}?</\2\s*>")  # code, and marks of notes
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strong|u|wbr)(?:\s[^<>]*)?/?>")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_].)[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, in compatibility forms."""
    text = unicodedata.normalize("NFKD", text)
    if not text.isascii():
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = unicodedata.normalize("NFKD", text.casefold())
        return "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def visible(text: str) -> str:
    """The text in compatibility forms, without markup and invisible characters, words split by a line break joined."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        if "<s" in text or "<S" in text:
            text = _NOTE.sub(" ", text)
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text


class Numbered:
    """Words of texts as numbers (-1 for words without one); each spelling is folded once."""

    def __init__(self, numbers: dict[str, int], keep: int = 500_000) -> None:
        self.numbers, self.known, self.keep = numbers, {}, keep

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out, known = [], self.known
        for w in _WORD.findall(visible(text)):
            n = known.get(w)
            if n is None:
                n = self.numbers.get(fold(w), -1)
                if len(known) < self.keep:
                    known[w] = n
            out.append(n)
        return out


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [fold(w) for w in _WORD.findall(visible(text))]
