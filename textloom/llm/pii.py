"""Problem 7: personal data inside free text becomes typed placeholders.

Generators of high recall propose overlapping candidate spans, among them much that is no personal data: chat handles, web
addresses, streets without a number, any long number, any run of capitalised words, and in text of one letter case any run
with a known part of a name. There are no labelled rows, so labelling functions (cue words and formats) label the
candidates of a bounded sample of texts, and abstain from many. Gradient-boosted trees are trained there on format and
context features; the functions take no part in scoring. Texts with labelled names are also trained in one letter case.
Thresholds are calibrated on held-out candidates. Parts of names are counted by vote over all texts, not the sample. The
trees score every candidate of every text, and the best non-overlapping spans over their threshold are redacted.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, calibrated_threshold, fit
from .chars import back_map, fix_text
from .common import dropped, written
from .linking import _translit
from .setjoin import bits_of, bloom, in_bloom

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
#: Texts from which the classifier is trained: the ones with the least hash of their text.
TRAINING_TEXTS = 12_000
#: Parts of a name in one candidate; a longer name is met by several, which are joined.
MOST_PARTS = 5

_L = r"[^\W\d_]"
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|ет|собака|собачка|małpa)\s?[)\]}]\s?|\s(?:at|собака|собачка|равлик|małpa)\s)"
_DOT = r"(?:\.|\s\.\s|\s?[(\[{]\s?(?:dot|\.|крапка|точка|kropka)\s?[)\]}]\s?|\s(?:dot|крапка|точка|kropka)\s)"
#: Later parts of a domain: of one letter case, so that the next sentence's first word is none.
_LABEL = r"(?-i:[a-z][a-z0-9-]+|[A-Z][A-Z0-9-]+)(?![A-Za-z])"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+|\s?[(\[](?:dot|крапка|kropka)[)\]]\s?[\w+-]+|\s(?:dot|крапка|kropka)\s[\w+-]+)*{_AT}[\w-]+(?:{_DOT}{_LABEL})+", re.IGNORECASE)
#: What an e-mail address may be mistaken for: chat handles, web addresses, words around an "at" without a domain.
_NO_EMAIL = re.compile(rf"(?<![\w.@])@[\w.-]{{2,}}|(?:https?://|www\.)[^\s,;]+|(?<![\w.+-])[\w+-]+{_AT}[\w-]+(?!\s?[.(\[{{]\s?\w|[\w-])", re.IGNORECASE)
_EMAIL_HINTS = re.compile(r"@|://|www\.|\b(?:at|ет|собак\w|собачка|равлик|małpa)\b", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![\w.,+-])(?:\+\s?)?[(]?\d(?:[ ().\-/]{0,3}\d){6,14}(?![\w])(?!-\d)")
_LETTERED = re.compile(rf"(?<!\w)[A-ZА-ЯІЇЄҐ]{{2,3}}\s?[-№]{{0,2}}\s?№?\s?\d{{6}}(?!\d)")
_DATE = re.compile(r"\(?\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$|\(?(?:19|20)\d\d[./-]\d\d?[./-]\d\d?(?:\s\d\d?)?$")
_HOUSE = r"(?:,?\s*(?:буд(?:инок|\.)?|б\.|дом|house|bldg\.?|nr)?\s*№?\s?)(?<=[\s,.№])\d{1,4}(?!\d)(?:\s?[-/]?\s?(?:\d{1,4}|[A-Za-zА-Яа-яІі])(?![\w]))?"
_FLAT = rf"(?:,?\s*(?:кв(?:артира|\.)?|під['’ʼ]?їзд|оф(?:іс|\.)?|корп(?:ус|\.)?|apt\.?|flat|m\.|lok\.?)\s?№?\s?\d{{1,4}})*"
_STREET = r"(?:вул(?:иця|иці|ицю|\.)?|просп(?:ект|екті|\.)?|пр-т|пр\.|бульв(?:ар|арі|\.)?|б-р|пров(?:улок|улку|\.)?|пл(?:оща|ощі|\.)|шосе|узвіз|наб(?:ережна|\.)?|тупик|проїзд|майдан|ul\.|ulica|ulicy|al\.|aleja|alei|pl\.|os\.)"
_ADDRESS = re.compile(rf"(?<!\w){_STREET}\s{{0,3}}{_L}[\w'’ʼ-]{{1,40}}(?:\s{{1,3}}{_L}[\w'’ʼ-]{{1,40}})?{_HOUSE}{_FLAT}", re.IGNORECASE)
_ADDRESS_EN = re.compile(rf"(?<![\w])\d{{1,4}}[A-Za-z]?(?:/\d+)?\s+(?:[A-Z][\w'’-]+\s+){{1,2}}(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Square)\b\.?(?:,?\s*(?:apt|flat|unit|suite)\.?\s?\d+)?", re.IGNORECASE)
_STREET_ONLY = re.compile(rf"(?<!\w){_STREET}\s{{0,3}}{_L}[\w'’ʼ-]{{1,40}}|(?<!\w)(?:[A-Z][\w'’-]+\s+){{1,2}}(?:Street|Lane|Road|Avenue|Boulevard|Drive|Square)\b", re.IGNORECASE)
_ADDRESS_HINTS = ("вул", "просп", "пр-т", "пр.", "бульв", "б-р", "пров", "пл.", "площ", "шосе", "узвіз", "наб", "тупик", "проїзд", "майдан", "ul.", "ulic", "al.", "alej", "alei", "pl.", "os.", "street", " st", " lane", " ln", " road", " rd", " ave", "boulevard", "blvd", "drive", "square")
_UP = "A-ZА-ЯІЇЄҐŁŚŻŹĆŃÓĄĘ"
_CAP = rf"[{_UP}][\w'’ʼ]{{0,40}}[^\W\d_A-ZА-ЯІЇЄҐ][\w'’ʼ]{{0,40}}(?:-[{_UP}][\w'’ʼ]{{1,40}})?"
_INITIAL = rf"[{_UP}][a-zа-яіїєґ]?\."
_PART = rf"(?:{_INITIAL}|{_CAP}|[{_UP}]['’ʼ{_UP}]{{3,}})"
_NAME = re.compile(rf"(?<![\w'’-]){_PART}(?:(?: {{1,2}}|(?<=\.)){_PART})+(?![\w'’]|-\d)")
_ONE_PART = re.compile(_PART)
#: Two capitals that a name could begin its parts with; texts without skip the patterns above and below.
_NEIGHBOURS = re.compile(rf"[{_UP}][\w'’ʼ-]{{0,40}}(?:\.? +|\.)[{_UP}]")
_WORD = re.compile(rf"{_L}[\w'’ʼ]*")

# Cue stems of the labelling functions, and of features: words for the things themselves and for what is near them in any text.
CUES = {
    "phone": ("тел", "дзвон", "зв'яз", "звяз", "вайбер", "viber", "моб", "call", "phone", "mobile", "dzwoni", "numer to", "number is", "my number", "kom."),
    "id": ("паспорт", "рнокпп", "іпн", "ідентифікаційн", "ід-карт", "id-карт", "посвідк", "демографічн", "унзр", "платника", "taxpayer", "passport", "personal record", "identity card", "id card", "dowód", "dowod", "pesel", "paszport", "podatnik", "osobist", "osobow", "nip", "rejestr"),
    "other": ("талон", "серійн", "рахунок", "заявк", "звернення", "координат", "сума", "бюджет", "термінал", "ticket", "case", "request", "wniosek", "sprawa", "zgłoszenie", "serial", "invoice", "account", "token", "version", "версі", "оновлення"),
    "person": ("звати", "працює", "заявник", "дякую", "подяка", "ask for", "name is", "nazywam", "оператор", "спеціаліст", "керівник", "пан ", "пані", "pan ", "pani", "mr", "ms", "dear", "громадян"),
    "thing": ("ім.", "імені", "бібліотек", "школ", "лікарн", "тов", "фоп «", "пп ", "вул", "просп", "пров", "бульв", "площ", "м. ", "с. ", "смт", "місто", "селище", "населений", "зал ", "обл", "район", "урочищ", "hall", "sala", "street", "desk", "queue", "library", "named", "imienia", "ltd", "llc"),
    "home": ("живу", "адрес", "прописк", "live", "mieszkam", "зареєстров", "reside"),
}


class Lexicon:
    """Parts of names as a Bloom filter of bounded size, and the endings of three letters that they have."""

    def __init__(self, bits: np.ndarray, endings: frozenset[str] = frozenset()):
        self.bits, self.endings, self._seen = bits, endings, {}

    def known(self, word: str) -> bool:
        k = self._seen.get(word)
        if k is None:
            if len(self._seen) > 400_000:
                self._seen.clear()
            k = self._seen[word] = bool(in_bloom(self.bits, np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64))[0])
        return k

    def ends(self, word: str) -> bool:
        return len(word) > 4 and word[-3:] in self.endings


@dataclass
class Model:
    """A boosted classifier and a threshold per type, with the log-odds of context words learned on the training candidates; parts and endings of names learned on all texts."""

    trees: dict[str, Boosted] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)
    odds: dict[str, dict[str, float]] = field(default_factory=dict)
    lexicon: Lexicon = field(default_factory=lambda: Lexicon(bits_of(np.empty(0, np.uint64))))


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, type): overlapping spans that may be personal data; every span a type could have is proposed."""
    out = []
    low = text.lower()
    if _EMAIL_HINTS.search(low):
        out += [(*m.span(), "EMAIL") for p in (_EMAIL, _NO_EMAIL) for m in p.finditer(text)]
    for m in _NUMBER.finditer(text):
        if _DATE.match(m.group()):
            continue
        n = sum(c.isdigit() for c in m.group())
        if 9 <= n <= 13:
            out.append((*m.span(), "PHONE"))
        if 8 <= n <= 14:
            out.append((*m.span(), "ID"))
    out += [(*m.span(), "ID") for m in _LETTERED.finditer(text)]
    if any(h in low for h in _ADDRESS_HINTS):
        out += [(*m.span(), "ADDRESS") for p in (_ADDRESS, _ADDRESS_EN, _STREET_ONLY) for m in p.finditer(text)]
    return list(dict.fromkeys(out + _named(text) + _caseless(text, low, lexicon)))


def _named(text: str) -> list[tuple[int, int, str]]:
    """The NAME spans that letter case shows."""
    out = []
    if not _NEIGHBOURS.search(text):
        return out
    for m in _NAME.finditer(text):
        if m.group().isupper():
            continue
        parts = [x.span() for x in _ONE_PART.finditer(text, m.start(), m.end())]
        whole = [text[x:y] for x, y in parts]
        for i in range(len(parts)):
            for j in range(i + 2, min(i + MOST_PARTS, len(parts)) + 1):
                if sum(w[-1] != "." for w in whole[i:j]) in (1, j - i):
                    out.append((parts[i][0], parts[j - 1][1], "NAME"))
    return out


_ANY = re.compile(rf"{_L}[\w'’ʼ-]*\.?")
_PATRONYMIC = re.compile(r"(?:івн|ович|йович|ївн|ivn|ovych)\w{0,2}$")


def _caseless(text: str, low: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """The NAME spans that letter case does not show, in small letters or all capitals: runs of neighbouring words, at least one a known part of a name, the others known, with the ending of one, an initial, or, once, unknown beside a known one."""
    if len(low) != len(text):
        return []
    known = lexicon.known
    w = [(m.start(), m.end(), m.group()) for m in _ANY.finditer(low)]
    sure = [k for k, (_, _, x) in enumerate(w) if len(x) > 3 and known(x.rstrip("."))]
    out: dict[tuple[int, int, str], None] = {}
    for k in sure:
        lo = k
        while lo > 0 and k - lo < MOST_PARTS - 1 and w[lo][0] - w[lo - 1][1] in (0, 1, 2) and not low[w[lo - 1][1]:w[lo][0]].strip(" ") and (w[lo - 1][2][-1] != "." or len(w[lo - 1][2]) == 2):
            lo -= 1
            if not _namelike(w[lo][2], lexicon):
                break
        for i in range(lo, k + 1):
            odd = 0
            for j in range(i, min(i + MOST_PARTS, len(w))):
                if j > i and (low[w[j - 1][1]:w[j][0]].strip(" ") or w[j - 1][2][-1] == "." and len(w[j - 1][2]) > 2):
                    break
                odd += not _namelike(w[j][2], lexicon)
                if odd > 1:
                    break
                if j > i and j >= k:
                    end = w[j][1] - (w[j][2][-1] == "." and len(w[j][2]) > 2)
                    raw = text[w[i][0]:end]
                    if (raw == low[w[i][0]:end] or raw.isupper()) and sum(len(x[2]) > 2 for x in w[i:j + 1]) > (odd and 1):
                        out[w[i][0], end, "NAME"] = None
    return list(out)


def _namelike(word: str, lexicon: Lexicon) -> bool:
    x = word.rstrip(".")
    return len(word) == 2 and word[1] == "." or len(x) > 3 and (lexicon.known(x) or lexicon.ends(x) or bool(_PATRONYMIC.search(x)))


def _tax_checksum(d: str) -> bool:
    return len(d) == 10 and sum(int(c) * w for c, w in zip(d, (-1, 5, 7, 9, 4, 6, 10, 5, 7))) % 11 % 10 == int(d[9])


_CUE_RE = {k: re.compile("|".join((r"(?<!\w)" if len(c) < 5 else "") + re.escape(c) for c in v)) for k, v in CUES.items()}


def _vote(kind: str, span: str, left: str, right: str) -> float:
    """The labelling functions' vote: 1 personal, -1 not, 0 abstains."""
    digits = "".join(c for c in span if c.isdigit())
    cue = {k: bool(p.search(left)) for k, p in _CUE_RE.items()}
    if kind == "EMAIL":
        if not _EMAIL.fullmatch(span):
            return -1.0
        if "@" in span or re.search(r"[(\[{]", span):
            return 1.0
        local = re.split(r"\s", span)[0]
        return 1.0 if re.search(r"[_\d.]", local) or re.search(r"mail|скринь|адрес|adres|контакт|contact|пиш|write|answer|відповід|odpowied", left) or not re.search(r"\sat\s", span) else -1.0
    if kind == "PHONE":
        if "/" in span and len(digits) > 12 or re.search(r"\d{5}-\d{3}-\d{3}|^\d{8}-\d{5}$|^\d{2}\.\d{5}|,", span):
            return -1.0
        shaped = (digits.startswith("380") and len(digits) == 12) or (digits.startswith("0") and len(digits) == 10) or (digits.startswith("80") and len(digits) == 11) or (span.startswith("+") and 10 <= len(digits) <= 13)
        if cue["other"] or cue["id"] and not cue["phone"]:
            return -1.0
        if shaped and (cue["phone"] or _CUE_RE["phone"].search(right) or span.startswith("+")):
            return 1.0
        return 0.0 if shaped else -1.0
    if kind == "ID":
        if cue["other"] or cue["phone"] and not cue["id"]:
            return -1.0
        if cue["id"] or re.fullmatch(r"(?:19|20)\d{6}-\d{5}", span):
            return 1.0
        return 0.0 if re.match(r"[^\W\d]{2}", span) or _tax_checksum(span) else -1.0
    if kind == "ADDRESS":
        return 1.0 if digits and (_ADDRESS.fullmatch(span) or _ADDRESS_EN.fullmatch(span)) else -1.0
    if span.islower() or span.isupper():
        return 1.0 if _PATRONYMIC.search(span.lower()) and len(_WORD.findall(span)) > 1 else 0.0
    if _CUE_RE["thing"].search(left[-16:]) or left[-1:] in "«\"„“" or left.rstrip()[-3:] in ("ім.", "вул") or re.search(r"[«„“\"][^»”\"]*$", left) or re.match(r"[»”]|\s*(?:Street|Lane|Road|Avenue|обл)|-\d|,?\s[\w-]+ обл", right):
        return -1.0
    if re.search(r"(?:івн|ович|йович|ївн|ivn|ovych)\w{0,2}$|" + rf"[{_UP}]\.", span) or cue["person"]:
        return 1.0
    return -1.0 if not left.strip(" «(") else 0.0


def _words(kind: str, span: str, left: str, right: str) -> list[str]:
    """Context and content tokens whose log-odds are learned."""
    l, r = _WORD.findall(left.lower()), _WORD.findall(right.lower())
    out = [f"l1:{l[-1]}" if l else "l1:", f"l2:{l[-2]}" if len(l) > 1 else "l2:", f"r1:{r[0]}" if r else "r1:", "lc:" + left.rstrip()[-1:], "rc:" + right[:1]]
    out.append("sh:" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", span)))
    if kind == "NAME":
        out += [f"s3:{w[-3:].lower()}" for w in _WORD.findall(span)] + [f"w:{w.lower()}" for w in _WORD.findall(span)]
    return out


_ENDED = re.compile(rf"(?:[!?…]+|(?<=\w{{6}})\.(?=\s+\w)|\.{{2,}})[)»]*\s*|(?:(?<=\w{{4}})(?<!просп)(?<!бульв)(?<!пров)|(?<=[)»\d]))\.\s*(?=[{_UP}])")
_WORDS_OF = re.compile(_L + "+")
_DIGITS_OF = re.compile(r"\d+")
_INITIALS_OF = re.compile(rf"[{_UP}]\.")


def _context(text: str, a: int, b: int) -> tuple[str, str, int]:
    """What stands left and right of a span, and where its sentence begins in the left: what belongs to another sentence is no context."""
    left = text[max(0, a - 48):a]
    left = left[left.rfind("\n") + 1:]
    return left, text[b:b + 32], max((m.end() for m in _ENDED.finditer(left + text[a:b][:1])), default=0)


def features(text: str, cands: list[tuple[int, int, str]], lexicon: Lexicon) -> tuple[list[list[float]], list[float], list[list[str]]]:
    """Format and context features, votes and learnable tokens of each candidate."""
    x, votes, toks = [], [], []
    for a, b, kind in cands:
        span = text[a:b]
        left, right, cut = _context(text, a, b)
        low_r = right.lower()
        near = left.lower()[cut:]
        digits = [c for c in span if c.isdigit()]
        groups = _DIGITS_OF.findall(span)
        letters = _WORDS_OF.findall(span)
        d = "".join(digits)
        part = [w.lower() for w in _WORD.findall(span)] if kind == "NAME" else []
        at = span.find("@")
        x.append([
            len(part), sum(len(w) > 3 and lexicon.known(w) for w in part), sum(lexicon.ends(w) for w in part), sum(len(w) < 3 for w in part), float(span.islower()), float(span[-1:].isdigit()), at, span.count("@") and span[at:].count("."),
            float(bool(kind == "EMAIL" and _EMAIL.fullmatch(span))), float(bool(kind == "ADDRESS" and _STREET_ONLY.match(span))), float(left[-1:].isupper()), sum(w[:1].isupper() for w in letters),
            len(span), len(digits), len(groups), max(map(len, groups), default=0), float(span[:1] == "+"), float(d[:1] == "0"), float(d[:3] == "380"), float(d[:2] == "80"),
            float("(" in span), span.count("-"), span.count(" "), float("/" in span), float("." in span), float(_tax_checksum(d)), float(bool(re.match(r"(?:19|20)\d\d", d))),
            len(letters), sum(map(len, letters)), float(span.isupper()), float(bool(re.search(r"[A-Za-z]", span))), float("@" in span), float(left[-1:] in "«\"„“("),
            float(cut >= len(left)), len(_INITIALS_OF.findall(span)), float(any(_PATRONYMIC.search(w.lower()) for w in letters)),
            *[float(bool(p.search(near))) for p in _CUE_RE.values()], *[float(bool(p.search(low_r))) for p in _CUE_RE.values()],
        ])
        votes.append(_vote(kind, span, near, low_r))
        toks.append(_words(kind, span, left[cut:], right))
    return x, votes, toks


#: The features that say how many parts of a name are known, or have the ending of one.
_LEXICAL = (1, 2)


def _encoded(x: list[list[float]], toks: list[list[str]], odds: dict[str, float]) -> np.ndarray:
    """The feature matrix with the learned log-odds of the tokens: by place, and of the span's own words."""
    extra = []
    for t in toks:
        by = defaultdict(list)
        for w in t:
            by[w.split(":", 1)[0]].append(odds.get(w, 0.0))
        extra.append([by[k][0] if k in by else 0.0 for k in ("l1", "l2", "r1", "lc", "rc", "sh")] + [sum(by["s3"]) / max(1, len(by["s3"])), max(by["s3"], default=0.0), max(by["w"], default=0.0)])
    return np.array([a + b for a, b in zip(x, extra)], dtype=np.float64).reshape(len(x), -1)


def name_votes(texts: list[str]) -> dict[str, list[int]]:
    """Per part of the texts' name candidates, in small letters and of at least four: how many candidates are voted a name, and how many none."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t in map(fix_text, texts):
        for a, b, kind in _named(t):
            span = t[a:b]
            left, right, cut = _context(t, a, b)
            v = _vote(kind, span, left.lower()[cut:], right.lower())
            own = [w.lower() for w in _WORD.findall(span) if len(w) > 3]
            if not v or v < 0 and any(_CUE_RE["person"].search(w) for w in own):
                continue  # a cue word before a name says nothing about the name
            for w in own:
                out[w][v < 0] += 1
    return out


def _is_part(z: str) -> bool:
    return not any(p.search(z) for p in _CUE_RE.values())


def _hashes(parts: list[str]) -> list[int]:
    """Signed 64-bit hashes of parts of names, in their own letters and transliterated."""
    return [h - (1 << 64) if h >= 1 << 63 else h for z in parts if _is_part(z) for w in (z, _translit(z)) for h in (xxhash.xxh3_64_intdigest(w),)]


def lexicon_of(texts: list[str]) -> Lexicon:
    """The lexicon that some texts teach."""
    votes = name_votes(texts)
    ends: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for z, (p, n) in votes.items():
        for e in {z[-3:], _translit(z)[-3:]}:
            ends[e][0] += p
            ends[e][1] += n
    return Lexicon(bits_of(np.array(_hashes([z for z, (p, n) in votes.items() if p > n and p > 1]), dtype=np.int64).view(np.uint64)), frozenset(e for e, (p, n) in ends.items() if p >= 3 and p > n))


def _one_case(text: str, cands: list[tuple[int, int, str]], votes: list[float], lexicon: Lexicon) -> Iterator[tuple[str, tuple[int, int, str], float]]:
    """A text with labelled names in small letters and in capitals, with its NAME candidates and their labels: those of the same spans, none where a name may be."""
    names = {(a, b): v for (a, b, kind), v in zip(cands, votes) if kind == "NAME"}
    if not any(names.values()):
        return
    for t in (text.lower(), text.upper()):
        if len(t) != len(text):
            continue
        for a, b, kind in _caseless(t, t.lower(), lexicon):
            if names.get((a, b), 0) > 0:
                yield t, (a, b, kind), 1.0
            elif not any(v >= 0 and a < d and c < b for (c, d), v in names.items()):
                yield t, (a, b, kind), -1.0


def _odds(toks: list[list[str]], y: np.ndarray, use: np.ndarray) -> dict[str, float]:
    """Log-odds of the tokens of the rows to be used that occur in three of them or more."""
    yes, no = Counter(), Counter()
    for w, v, u in zip(toks, y, use):
        if u:
            (yes if v else no).update(set(w))
    pos, neg = max(1, int(y[use].sum())), max(1, int((1 - y)[use].sum()))
    return {w: float(np.log((yes[w] + 0.5) / (pos + 1)) - np.log((no[w] + 0.5) / (neg + 1))) for w in set(yes) | set(no) if yes[w] + no[w] >= 3}


def _known_vote(span: str, lexicon: Lexicon) -> float:
    """The vote of what other texts say about a name's parts, where nothing else votes: all of them are parts of names, or none is."""
    part = [w.lower() for w in _WORD.findall(span) if len(w) > 2]
    known = [len(w) > 3 and (lexicon.known(w) or bool(_PATRONYMIC.search(w))) for w in part]
    return 1.0 if part and all(known) else -1.0 if not any(known) else 0.0


def train(texts: list[str], lexicon: Lexicon | None = None) -> Model:
    """Fits trees and thresholds on the labelled candidates of the given texts. A third is held out to calibrate. The lexicon is the given one, else that of the texts. A type without labelled candidates is never found."""
    rows: dict[str, list] = {k: [] for k in TYPES}
    model = Model(lexicon=lexicon or lexicon_of(texts))
    for t in texts:
        t = fix_text(t)
        c = candidates(t, model.lexicon)
        x, votes, toks = features(t, c, model.lexicon)
        for k, ((a, b, kind), f, w) in enumerate(zip(c, x, toks)):
            ruled = bool(votes[k])
            if kind == "NAME" and not ruled:
                votes[k] = _known_vote(t[a:b], model.lexicon)
            if votes[k]:
                rows[kind].append((f, votes[k], w, ruled))
        for other, cand, v in _one_case(t, c, votes, model.lexicon):
            f, _, w = features(other, [cand], model.lexicon)
            rows["NAME"].append((f[0], v, w[0], False))
    for kind in TYPES:
        labelled = rows[kind]
        if not labelled:
            model.trees[kind], model.threshold[kind] = Boosted(), 2.0
            continue
        x, toks = [r[0] for r in labelled], [r[2] for r in labelled]
        y, ruled = np.array([r[1] > 0 for r in labelled], dtype=np.float64), np.array([r[3] for r in labelled])
        fold = np.arange(len(y)) % 3  # the last third is held out
        model.odds[kind] = _odds(toks, y, fold < 2)
        # each third of the rows is encoded by what the others teach, as new texts will be
        m = np.zeros((len(y), 0))
        for k in range(3):
            e = _encoded([x[i] for i in np.flatnonzero(fold == k)], [toks[i] for i in np.flatnonzero(fold == k)], model.odds[kind] if k == 2 else _odds(toks, y, fold == 1 - k))
            m = np.zeros((len(y), e.shape[1])) if not m.shape[1] and len(e) else m
            m[fold == k] = e if len(e) else m[fold == k]
        # each row that cues or formats labelled also as if its words, its neighbours and its shape had never been seen: what formats and cues say must do alone
        blank = m[(fold < 2) & ruled]
        blank[:, [*_LEXICAL, *range(blank.shape[1] - 9, blank.shape[1])]] = 0
        both, twice = np.concatenate([m[fold < 2], blank]), np.concatenate([y[fold < 2], y[(fold < 2) & ruled]])
        model.trees[kind] = fit(both, twice, np.zeros(len(twice)))
        model.threshold[kind] = min(calibrated_threshold(1 / (1 + np.exp(-model.trees[kind].margin(m[fold == 2]))), y[fold == 2]), 0.8)
    return model


def detect(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """Per text the selected (start, end, type, probability), without overlaps, by start; offsets count code points of the text as stored. A selected name takes in the names over the threshold that overlap it and have only parts of names."""
    chosen: dict[int, list] = defaultdict(list)
    per: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in TYPES}
    fixed: dict[int, str] = {}
    for i, raw in enumerate(texts):
        if not raw:
            continue
        t = fix_text(raw)
        c = candidates(t, model.lexicon)
        if not c:
            continue
        fixed[i] = t
        for (a, b, kind), f, _, w in zip(c, *features(t, c, model.lexicon)):
            p = per[kind]
            p[0].append(f)
            p[1].append(w)
            p[2].append((i, a, b))
    for kind, (x, w, at) in per.items():
        if not x or kind not in model.trees:
            continue
        score = 1 / (1 + np.exp(-model.trees[kind].margin(_encoded(x, w, model.odds.get(kind, {})))))
        for (i, a, b), s in zip(at, score):
            if s >= model.threshold[kind]:
                chosen[i].append((a, b, kind, float(s)))
    out: list[list] = [[] for _ in texts]
    for i, spans in chosen.items():
        t = fixed[i]
        kept: list = []
        for s in sorted(spans, key=lambda s: (-round(s[3], 3), s[0] - s[1], s[0], s[2])):
            over = [k for k, q in enumerate(kept) if s[0] < q[1] and q[0] < s[1]]
            if not over:
                kept.append(s)
            elif s[2] == "NAME" and all(kept[k][2] == "NAME" for k in over) and all(_namelike(w.lower(), model.lexicon) for w in _ANY.findall(t[s[0]:s[1]])):
                own = [s, *(kept[k] for k in over)]
                kept = [q for k, q in enumerate(kept) if k not in over] + [(min(q[0] for q in own), max(q[1] for q in own), "NAME", max(q[3] for q in own))]
        shift = back_map(texts[i])
        out[i] = sorted((shift(a), shift(b), kind, s) for a, b, kind, s in kept)
    return out


def lexicon(df: DataFrame, text_col: str = "text") -> Lexicon:
    """Parts and endings of names, by the votes of all distinct texts; a part is known from two texts on, so that one text's name is new to its own training. What is shuffled are the parts with their text's hash, no text; what reaches the driver are a Bloom filter of bounded size and endings of three letters."""
    src = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where("t IS NOT NULL")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(h, z, p, n) for h, t in dict(zip(b.column("h").to_pylist(), b.column("t").to_pylist())).items() for z, (p, n) in name_votes([t]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["h", "z", "yes", "no"])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(0).to_pylist()), pa.int64())], names=["h"])

    def endings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(e, p, n) for z, p, n in zip(*(c.to_pylist() for c in b.columns)) for e in {z[-3:], _translit(z)[-3:]}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["e", "yes", "no"])

    # equal texts give equal rows, so each counts once
    votes = src.mapInArrow(kernel, "h BIGINT, z STRING, yes INT, no INT").distinct().groupBy("z").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    votes = written(votes, "name-votes")
    ends = votes.select("z", "yes", "no").mapInArrow(endings, "e STRING, yes BIGINT, no BIGINT").groupBy("e").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where("yes >= 3 AND yes > no")
    out = Lexicon(bloom(votes.where("yes > no AND yes > 1").select("z").mapInArrow(hashed, "h BIGINT"), "h"), frozenset(r.e for r in ends.toLocalIterator()))
    dropped(votes)
    return out


def trained(df: DataFrame, text_col: str = "text", texts: int = TRAINING_TEXTS) -> Model:
    """Trees and thresholds from at most `texts` distinct texts, those with the least hash; parts of names from all texts."""
    rows = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    # thinned by the hash first, so that tasks do not each send a whole sample to the driver, by twice as many distinct texts as needed
    distinct = rows.agg(F.approx_count_distinct("h")).first()[0]
    slots = min(1 << 20, -(-(1 << 20) * 2 * texts // max(1, distinct)))
    sample = rows.where(F.col("h").bitwiseAND((1 << 20) - 1) < slots).dropDuplicates(["h"]).orderBy(F.shiftright("h", 20), "h").limit(texts)
    return train(sorted({r.t for r in sample.collect()}), lexicon(df, text_col))


def spans(df: DataFrame, model: Model, keys: tuple[str, ...] = ("src", "text_id"), text_col: str = "text") -> DataFrame:
    """The operator: (keys..., start_char, end_char, pii_type, score), one row per redacted span of each row. NULL and empty texts have none; other columns are ignored."""
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keys, F.col(text_col).alias("_text")).where("_text IS NOT NULL")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, got = [], []
            for i, s in enumerate(detect(b.column("_text").to_pylist(), held.value)):
                at += [i] * len(s)
                got += s
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(pa.array(at, pa.int64())) for k in keys]
                + [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.float64())],
                names=[*keys, "start_char", "end_char", "pii_type", "score"],
            )

    types = dict(src.dtypes)
    return src.mapInArrow(kernel, ", ".join(f"{k} {types[k]}" for k in keys) + ", start_char INT, end_char INT, pii_type STRING, score DOUBLE")


def redacted(df: DataFrame, model: Model, keys: tuple[str, ...] = ("src", "text_id"), text_col: str = "text") -> DataFrame:
    """(keys..., text, redacted_text): each row with its spans replaced by [TYPE], the rest as stored; NULL stays NULL."""
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keys, F.col(text_col).alias("text"))

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column("text").to_pylist()
            done = []
            for t, ss in zip(texts, detect(texts, held.value)):
                for a, e, kind, _ in reversed(ss):
                    t = f"{t[:a]}[{kind}]{t[e:]}"
                done.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*b.schema.names, "redacted_text"])

    types = dict(src.dtypes)
    return src.mapInArrow(kernel, ", ".join(f"{k} {types[k]}" for k in keys) + ", text STRING, redacted_text STRING")
