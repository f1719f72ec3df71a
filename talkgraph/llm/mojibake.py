"""Text that went through a wrong decoding: found and, where still possible, restored.

The characters of a text are mapped back to the bytes of a legacy encoding. An automaton over these bytes
(a regular expression over the characters that stand for them) finds the maximal spans that are well-formed
multibyte UTF-8; only these spans are decoded, and again as long as spans remain (each round shortens the
text), as a text may have gone wrong more than once. Spans that correct text can hold by chance are judged by what they decode to and by
what stands beside them. Texts in a single-byte encoding that were read as another one have no multibyte
spans; for Cyrillic, whose words then consist of nothing but accented letters, the words are mapped back if
the pairs of letters they then have are those of the language. Bytes that a decoder gave up stand as
replacement characters: the text is affected, and what it lost stays lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Legacy encodings a UTF-8 text may have been read in (fixed values).
ENCODINGS = ("cp1252", "iso8859_15", "cp1251", "mac_roman", "cp437", "cp850", "cp1250")
#: Pairs of letters that words mapped back need at least, and the share of them that the language has often.
LEAST_PAIRS, USUAL = 8, 0.2
#: The most frequent pairs of letters in Russian (fixed values).
PAIRS = frozenset("ст но ен то на ов ни ра во ко не по пр от го ро ер ос та ре ла ет ал ли ол ва ка ри ат ан ть ве ле ск ор ин од де ит ел ом ем ся ми ль".split())
#: Letters that a lone Cyrillic letter inside a Latin word may stand for (fixed values).
ACCENTED = frozenset("àâäáãåæçéèêëíìîïñóòôöõøúùûüýÿß")
#: What a decoded span may consist of: letters and signs in common use (fixed values).
COMMON = frozenset(
    [chr(c) for c in (*range(0xA0, 0x100), *range(0x410, 0x450), 0x401, 0x451, *range(0x391, 0x3CA))]
    + list("ŒœŠšŽžŸŁłĆćČčĘęĄąŚśŹźŻżŘřĚěŮůŐőŰűĞğİıŞşƒˆ˜–—‘’‚“”„†‡•…‰‹›€™№→←↑↓∑∞≈≠≤≥√∂∫−×÷")
)
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
#: A word of three letters or more all from the upper half of Latin-1.
_HIGH_WORD = re.compile(r"(?<![A-Za-z])[À-ÿ¸¨]{3,}(?![A-Za-z])")
_HIGH_RUN = re.compile(r"(?<![A-Za-z])[À-ÿ¸¨¹«»\x80-\x9f]+(?![A-Za-z])")
#: What a text needs at least to have gone through a wrong decoding.
_HINT = re.compile(r"[^\x00-\x7f]{2}|�|[a-z][Ѐ-ӿ][a-z]")
_TURNED = re.compile(r"(?<!\w)[а-яё][А-ЯЁ]{2,}(?!\w)")
_CYRILLIC_RUN = re.compile(r"[А-Яа-яЁё]+")
_MIXED = re.compile(r"(?<=[a-z])[Ѐ-ӿ](?=[a-z])")
_MIXED_WORD = re.compile(r"[A-Za-z]*[a-z][Ѐ-ӿ][a-z][A-Za-zЀ-ӿ]*")


def bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte, upper half only. Bytes an encoding leaves open stand for themselves, as controls do."""
    out = {}
    for b in range(0x80, 0x100):
        if encoding == "cp1252":
            out[chr(b)] = b
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


class Automaton:
    """Well-formed multibyte UTF-8 over the characters that one legacy encoding has for the bytes."""

    def __init__(self, encoding: str) -> None:
        self.encoding, self.byte = encoding, bytes_of(encoding)
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi) + "]"
        tail = cls(0x80, 0xBF)
        one = "|".join((
            cls(0xC2, 0xDF) + tail, cls(0xE0, 0xE0) + cls(0xA0, 0xBF) + tail, cls(0xE1, 0xEC) + tail + tail, cls(0xED, 0xED) + cls(0x80, 0x9F) + tail,
            cls(0xEE, 0xEF) + tail + tail, cls(0xF0, 0xF0) + cls(0x90, 0xBF) + tail + tail, cls(0xF1, 0xF3) + tail * 3, cls(0xF4, 0xF4) + cls(0x80, 0x8F) + tail * 2,
        ))
        self.span = re.compile(f"(?:{one})+")

    def decoded(self, span: str) -> str:
        return bytes(self.byte[c] for c in span).decode("utf-8")

    def judged(self, text: str, m: re.Match) -> tuple[str, bool] | None:
        """What a span decodes to and whether that is beyond doubt; null where correct text may well hold it."""
        new = self.decoded(m[0])
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        control = [c for c in new if 0x80 <= ord(c) < 0xA0]
        odd = [c for c in new if c not in COMMON and c not in control]
        if odd and (len(new) < 2 or _LATIN.match(before)) and not all(ord(c) > 0xFFFF for c in odd):
            return None
        if control and self.encoding not in ("cp1252", "iso8859_15"):
            return None
        if len(new) > 1 or self.byte[m[0][0]] >= 0xE0 and new in COMMON:
            return new, True
        beside = _LATIN.match(before) or _LATIN.match(after)
        if self.encoding == "cp1251":  # also an upper-case letter before a quotation mark or a letter like ё
            return new, bool(_LATIN.match(new) and beside and not _CYRILLIC.match(before) and not _CYRILLIC.match(after))
        if self.encoding == "mac_roman":  # also a root sign before a letter of a formula
            return new, bool(_LATIN.match(new) and beside)
        return new, True

    def decode(self, text: str) -> tuple[str, int, int]:
        """The text with its spans decoded, how much of it they explain, and what counts against the encoding:
        upper-case letters that would stand inside words. Doubtful spans are decoded only beside ones beyond doubt."""
        spans = [(m, *got) for m in self.span.finditer(text) if (got := self.judged(text, m))]
        if not any(sure for _, _, sure in spans):
            return text, 0, 0
        gain, against, parts, at = 0, 0, [], 0
        for m, new, _ in spans:
            parts += [text[at : m.start()], new]
            at = m.end()
            gain += len(m[0])
            follows = new[1:2] or text[at : at + 1]
            if new[0].isupper() and text[m.start() - 1 : m.start()].islower() and ("a" <= follows <= "z" or follows >= "ß"):
                against += 2 * len(m[0])
        return "".join(parts) + text[at:], gain, against


AUTOMATA = tuple(Automaton(e) for e in ENCODINGS)


def _chain(automaton: Automaton, text: str) -> tuple[str, int]:
    """Decode with one encoding as often as it has spans, and how much that explains. What stands against it is
    asked of the last text only, as texts on the way are garbled themselves."""
    steps = []
    while (got := automaton.decode(text))[1]:
        steps.append(got)
        text = got[0]
    while steps and steps[-1][1] <= steps[-1][2]:
        steps.pop()
    return (steps[-1][0], sum(s[1] for s in steps) - steps[-1][2]) if steps else (text, 0)


def _round(text: str) -> str:
    """Decode the spans of the encoding that explains most of the text, however often it was read in it."""
    new, gain = max((_chain(a, text) for a in AUTOMATA), key=lambda x: x[1])
    return new if gain > 0 else text


def _recode(run: str, source: str, target: str) -> str:
    try:
        return run.encode(source).decode(target)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run


def usual(text: str) -> bool:
    """Whether a text's pairs of letters are those of Russian."""
    pairs = [w[i : i + 2] for w in _CYRILLIC_RUN.findall(text.lower()) for i in range(len(w) - 1)]
    return len(pairs) >= LEAST_PAIRS and sum(p in PAIRS for p in pairs) >= USUAL * len(pairs)


def single_byte(text: str) -> str:
    """Cyrillic that was read in another single-byte encoding, and accented letters read as Cyrillic, mapped back
    word by word. A text's words have to bear it out together: a few accented capitals or a lone foreign sign are no evidence."""
    words = _HIGH_WORD.findall(text)
    if len(words) >= 2:
        letters = "".join(words)
        target = "cp1251" if sum(c >= "à" for c in letters) * 2 >= len(letters) else "koi8-r"
        if usual(" ".join(_recode(w, "latin-1", target) for w in words)):
            text = _HIGH_RUN.sub(lambda m: _recode(m[0], "latin-1", target), text)
    if _TURNED.search(text) and not usual(text):
        turned = _CYRILLIC_RUN.sub(lambda m: _recode(m[0], "cp1251", "koi8-r"), text)
        if usual(turned):
            text = turned
    mixed = set(_MIXED_WORD.findall(text))
    if len(mixed) >= 2 or any(sum(c.isascii() for c in w) >= 4 for w in mixed):
        back = lambda m: new if (new := _recode(m[0], "cp1251", "cp1252")) in ACCENTED else m[0]
        text = _MIXED.sub(back, text)
    return text


def restore(text: str | None) -> tuple[bool, str | None, bool]:
    """(affected, text as far as it can be restored, whether all of it could be).

    Null, empty and ASCII texts are not affected. A replacement character marks a text as affected; what it
    stands for is lost, and the character stays.
    """
    if not text or text.isascii() or not _HINT.search(text):
        return False, text, True
    was, new = "", text
    while new != was:
        was, new = new, _round(new)
    new = single_byte(new)
    lost = "�" in text
    return new != text or lost, new, not lost and not any(0x80 <= ord(c) < 0xA0 and c != "\x85" for c in new)


def restored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, whole) of each affected row: the text with its garbled spans decoded, and whether nothing
    is lost. Rows are judged where they are read; null and empty texts are never affected."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [(i, new, whole) for i, (hit, new, whole) in zip(part[id_col], map(restore, part[text_col])) if hit]
            yield pd.DataFrame(got, columns=[id_col, "restored", "whole"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).where(f"{text_col} is not null").mapInPandas(run, f"`{id_col}` {kind}, restored string, whole boolean")
