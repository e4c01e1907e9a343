"""One consistent written form for text whose characters only look right.

Pure per-text kernels (no Spark): they run inside Arrow batches of the operators in this subpackage.
"""

from __future__ import annotations

import re
import unicodedata

import regex

# Look-alike letters of the Latin, Cyrillic and Greek alphabets (Unicode confusables, same shape only).
LATIN_LOOKALIKE = "ABCEHIJKMOPSTXYaceijopsxyïëÏË"
CYRILLIC_LOOKALIKE = "АВСЕНІЈКМОРЅТХУасеіјорѕхуїёЇЁ"
GREEK_OF_CYRILLIC = "ΑΒΕΗΙΚΜΟΡΤΥΧαικορχγϲϊ"
CYRILLIC_OF_GREEK = "АВЕНІКМОРТУХаікорхусї"
GREEK_OF_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγϲϊ"
LATIN_OF_GREEK = "ABEZHIKMNOPTYXaikvopuxycï"
INVISIBLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
BLANKS = "\x09\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

TO_CYRILLIC = str.maketrans(LATIN_LOOKALIKE + GREEK_OF_CYRILLIC, CYRILLIC_LOOKALIKE + CYRILLIC_OF_GREEK)
TO_LATIN = str.maketrans(CYRILLIC_LOOKALIKE + GREEK_OF_LATIN, LATIN_LOOKALIKE + LATIN_OF_GREEK)
_AMBIGUOUS = frozenset(LATIN_LOOKALIKE + CYRILLIC_LOOKALIKE + GREEK_OF_LATIN + GREEK_OF_CYRILLIC)

_WIDE = {c: unicodedata.normalize("NFKC", chr(c)) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)}
_PLAIN = {**_WIDE, **{ord(c): " " for c in BLANKS}}
_DROP = {ord(c): None for c in INVISIBLE}
_HIDDEN = frozenset(INVISIBLE)

_LAT, _CYR, _GRK = "A-Za-zÀ-ÖØ-öø-ɏ", "Ѐ-ԯ", "Ͱ-Ͽ"
#: Characters that are never in clean text, whatever stands around them.
_ALWAYS = re.compile(f"[{INVISIBLE}{BLANKS}\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\u0300-\u036f\u0653-\u0655\u3099\u309a]")
_LATIN_OR_GREEK = re.compile(f"[{_LAT}{_GRK}]")
_CYRILLIC_OR_GREEK = re.compile(f"[{_CYR}{_GRK}]")
_LATIN_LETTER = re.compile(f"[{_LAT}]")
_CYRILLIC_LETTER = re.compile(f"[{_CYR}]")
#: Letters of two alphabets side by side, or a Greek letter.
_MIXED = re.compile(f"[{_LAT}](?:(?=[{_CYR}])|(?<=[{_CYR}][{_LAT}]))|[{_GRK}]")
#: Words on their own made of look-alike letters of one alphabet only.
_BEFORE, _AFTER = r"(?<![^\s«(„\"“‘'—–][{0}])", r"(?![^\s»),.!?…:;\"”’'—–])(?![»),.!?…:;\"”’'—–][\w@])"
_LONE_LATIN = re.compile("[{0}]".format(LATIN_LOOKALIKE) + _BEFORE.format(LATIN_LOOKALIKE) + "[{0}]*".format(LATIN_LOOKALIKE) + _AFTER)
_LONE_CYRILLIC = re.compile("[{0}]".format(CYRILLIC_LOOKALIKE) + _BEFORE.format(CYRILLIC_LOOKALIKE) + "[{0}]*".format(CYRILLIC_LOOKALIKE) + _AFTER)
_WORD = re.compile(f"[{_LAT}{_CYR}{_GRK}]+(?:['’ʼ][{_LAT}{_CYR}{_GRK}]+)*")
_EMOJI_JOIN = regex.compile("(?<=[\\p{Extended_Pictographic}\ufe0f\U0001F3FB-\U0001F3FF])\u200d(?=\\p{Extended_Pictographic})")
_WORDS = regex.compile(r"[\p{L}\p{Nd}][\p{L}\p{M}\p{Nd}]*")
#: Where none of these occur, the letters and digits of the standard library's class are the same words.
_MARKS_POSSIBLE = re.compile("[^\x00-±´-¸º»À-ʯЀ-҂Ҋ-ԯ‐-‟…№☀-➿\U0001F000-\U0001FAFF]")
_PLAIN_WORDS = re.compile(r"[^\W_]+")


def _alphabet(word: str) -> tuple[str, bool]:
    """The alphabet of a word's unmistakable letters ('L', 'C', 'G', 'LC' for several, '' for none); whether its letters come from several alphabets."""
    scripts, own = set(), set()
    for ch in word:
        o = ord(ch)
        s = "C" if 0x400 <= o <= 0x52F else "G" if 0x370 <= o <= 0x3FF else "L" if ch.isalpha() else ""
        if s:
            scripts.add(s)
            if ch not in _AMBIGUOUS:
                own.add(s)
    return "".join(sorted(own)), len(scripts) > 1


def _around(words: list[re.Match], k: int, text: str) -> str:
    """The alphabet of the nearest unmistakable words on both sides; where they differ, the text's more frequent one."""
    def near(step: range) -> str:
        for j in step:
            own, _ = _alphabet(words[j].group())
            if own in ("L", "C"):
                return own
        return ""

    left, right = near(range(k - 1, -1, -1)), near(range(k + 1, len(words)))
    if left and right and left != right or not (left or right):
        latin, cyr = len(_LATIN_LETTER.findall(text)), len(_CYRILLIC_LETTER.findall(text))
        return "C" if cyr >= latin else "L"
    return left or right


def _suspects(text: str) -> list[int]:
    """Offsets at which letters may belong to another alphabet than their word's."""
    if not _LATIN_OR_GREEK.search(text) or not _CYRILLIC_OR_GREEK.search(text):
        return []
    hits = [m.start() for m in _MIXED.finditer(text)]
    latin, cyr = len(_LATIN_LETTER.findall(text)), len(_CYRILLIC_LETTER.findall(text))
    hits += [m.start() for m in _LONE_LATIN.finditer(text)]
    if latin > cyr // 8:
        hits += [m.start() for m in _LONE_CYRILLIC.finditer(text)]
    return sorted(hits)


def _letters(text: str) -> str:
    """Brings look-alike letters back to the alphabet of their word."""
    hits = _suspects(text)
    if not hits:
        return text
    found = list(_WORD.finditer(text))
    out, at, h = [], 0, 0
    for k, m in enumerate(found):
        while h < len(hits) and hits[h] < m.start():
            h += 1
        if h == len(hits):
            break
        if hits[h] >= m.end():
            continue
        w = m.group()
        own, mixed = _alphabet(w)
        if own in ("C", "L"):
            if not mixed:
                continue
            to = own
        elif own:
            continue
        else:  # nothing but look-alikes
            to = _around(found, k, text)
            if not mixed and len(w) > 1 and w.isupper() and not 0x370 <= ord(w[0]) <= 0x3FF:
                continue  # an acronym of one alphabet is as good in any text
        fixed = w.translate(TO_CYRILLIC if to == "C" else TO_LATIN)
        if fixed != w:
            out += [text[at:m.start()], fixed]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def _composed(text: str) -> str:
    """Without invisible characters outside emoji and shaping, with ordinary blanks, ASCII full-width forms and composed letters."""
    if not _HIDDEN.isdisjoint(text):
        keep = {m.start() for m in _EMOJI_JOIN.finditer(text)} if "\u200d" in text else set()
        text = "".join(c for i, c in enumerate(text) if c not in _HIDDEN or i in keep)
    return unicodedata.normalize("NFC", text.translate(_PLAIN))


def fix_text(text: str) -> str:
    """The consistent form: composed letters, no invisible characters outside emoji, ordinary blanks, ASCII for full-width letters and digits, look-alikes in their word's own alphabet."""
    if _ALWAYS.search(text):
        text = _composed(text)
    if text.isascii():
        return text
    fixed = _letters(text)
    return text if fixed is text else unicodedata.normalize("NFC", fixed)


def words(text: str) -> list[str]:
    """Maximal runs of letters (with their combining marks) and digits of the consistent form, lower case."""
    text = fix_text(text).lower()
    return (_WORDS if _MARKS_POSSIBLE.search(text) else _PLAIN_WORDS).findall(text)


_VALUE = regex.compile(r"[\p{L}\p{M}\p{Nd}'’ʼ" + INVISIBLE + r"]+|[" + BLANKS + "]+")


def odd_values(text: str) -> list[tuple[int, int, str, str]]:
    """(start, length, value, mapped): runs of letters, digits and invisible characters, and runs of blanks, that the consistent form writes otherwise."""
    mapped = fix_text(text)
    if mapped == text:
        return []
    keep = {m.start() for m in _EMOJI_JOIN.finditer(text)} if "\u200d" in text else set()
    spans = [m.span() for m in _VALUE.finditer(text)]
    pieces = [(a, b, _composed(text[a:b])) for a, b in spans if not (keep and keep.issuperset(range(a, b)))]
    # look-alikes are judged in their context, so the composed pieces are put together first
    out, at, joined, places = [], 0, [], []
    length = 0
    for a, b, v in pieces:
        gap = text[at:a]
        joined += [gap, v]
        places.append((a, b, length + len(gap), len(v)))
        length += len(gap) + len(v)
        at = b
    whole = _letters("".join([*joined, text[at:]]))
    for a, b, pos, n in places:
        v = unicodedata.normalize("NFC", whole[pos:pos + n])
        if v != text[a:b]:
            out.append((a, b - a, text[a:b], v))
    return out


def back_map(raw: str):
    """Maps offsets of the consistent form to the text as stored."""
    pieces = odd_values(raw)
    if not pieces:
        return lambda k: k
    marks, moved = [], 0
    for start, n, _, mapped in pieces:
        marks.append((start - moved, len(mapped), n))
        moved += n - len(mapped)

    def back(k: int) -> int:
        add = 0
        for at, new, old in marks:
            if k >= at + new:
                add += old - new
            elif k > at:
                return k + add + (0 if old == new else min(old - new, k - at) if old > new else 0)
            else:
                break
        return k + add

    return back
