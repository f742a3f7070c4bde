"""Matching of rules against texts: literals first, then a near character, then a pattern in a bounded window."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from veilsift.rules import formats
from veilsift.rules.catalogue import Rule, bundled

try:
    import ahocorasick
except ImportError:  # the search for literals is then done one by one
    ahocorasick = None

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEVELS = {"low": 0, "medium": 1, "high": 2}


@dataclass
class Match:
    """A finding in one text; start and end are code points of the secret in it."""

    rule: str
    kind: str
    confidence: str
    label: str
    start: int
    end: int
    secret: str
    canonical: str
    masked: str
    layer: str


def lower_ascii(text: str) -> str:
    """A to Z in lower case; every other character keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def entropy(value: str) -> float:
    """Shannon entropy in bits over the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base62(value: int, width: int = 6) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def valid_checksum(token: str) -> bool:
    """A 40-character token ``gh?_`` ends in the base-62 CRC-32 of its body; anything else isn't judged."""
    if len(token) != 40 or not token.startswith("gh") or token[3] != "_":
        return True
    return base62(zlib.crc32(token[4:34].encode())) == token[-6:]


_KEY_WORD = re.compile(f"BEGIN ({'|'.join(formats.KEY_TYPES)})")


def ends_shown(n: int, shown: tuple[int, int]) -> tuple[int, int]:
    """Characters of a value of ``n`` that its mask shows at its beginning and end."""
    wish, share = (formats.SHORT_SHOWN, formats.SHORT_SHARE) if n < formats.SHORT else (shown, formats.LONG_SHARE)
    left = min(n // share, formats.MOST_SHOWN)
    head = min(wish[0], left)
    return head, min(wish[1], left - head)


def mask(secret: str, kind: str, shown: tuple[int, int]) -> str:
    """What may be shown of a secret, by the tables of ``formats``."""
    if kind == "privateKey":
        word = _KEY_WORD.search(secret)
        return formats.KEY_MASK + (formats.KEY_TYPES[word[1]] if word else formats.OTHER_KEY)
    if kind == "databaseURL":
        told, users = re.subn(formats.URL_USER, rf"\1:{formats.BULLETS}@", re.sub(formats.URL_PATH, r"\1/…", secret))
        return told if users else secret[: formats.URL_SHOWN] + formats.BULLETS
    head, tail = ends_shown(len(secret), shown)
    hidden = sorted((formats.LEAST_BULLETS, len(secret) - head - tail, formats.MOST_BULLETS))[1]
    return secret[:head] + formats.BULLETS[0] * hidden + secret[len(secret) - tail :]


def canonical(secret: str, form: str) -> str:
    """One form for all copies of a secret: PEM blocks without white space, URLs without a sentence's end."""
    if form == "pem":
        return re.sub(r"\\[nrt]|\s", "", secret)
    return secret.rstrip(".,;:!?)") if form == "url" else secret


class Scanner:
    """Compiled rules. Made once in a process by ``scanner``."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.rules = list(rules)
        self.patterns = [re.compile(r.pattern) for r in self.rules]
        self.allowed = [[re.compile(p) for p in r.allowed] for r in self.rules]
        self.allowed_match = [[re.compile(p) for p in r.allowed_match] for r in self.rules]
        self.vetoes = [[re.compile(p) for p in r.vetoes] for r in self.rules]
        self.placeholders = [re.compile(p) for p in formats.PLACEHOLDERS]
        self.global_allowed = [re.compile(p) for p in formats.GLOBAL_ALLOWED]
        self.by_anchor: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for a in r.anchors:
                self.by_anchor.setdefault(a, []).append(i)
        self.automaton = None
        if ahocorasick is not None and self.by_anchor:
            self.automaton = ahocorasick.Automaton()
            for a in self.by_anchor:
                self.automaton.add_word(a, a)
            self.automaton.make_automaton()

    def hits(self, low: str) -> dict[int, list[tuple[int, int]]]:
        """By rule: start and end of the literals found in a lower-cased text, where a near character follows if asked for."""
        found: dict[str, list[int]] = {}
        if self.automaton is not None:
            for end, a in self.automaton.iter(low):
                found.setdefault(a, []).append(end + 1 - len(a))
        else:
            for a in self.by_anchor:
                at = low.find(a)
                while at >= 0:
                    found.setdefault(a, []).append(at)
                    at = low.find(a, at + 1)
        by_rule: dict[int, list[tuple[int, int]]] = {}
        for a, starts in found.items():
            for i in self.by_anchor[a]:
                near = self.rules[i].near
                for s in starts:
                    end = s + len(a)
                    if near is None or any(c in near[0] for c in low[end : end + near[1]]):
                        by_rule.setdefault(i, []).append((s, end))
        return by_rule

    def scan(self, text: str) -> list[Match]:
        """Findings of all rules, overlaps settled, in order."""
        found: list[Match] = []
        for i, hits in self.hits(lower_ascii(text)).items():
            rule, seen, upto = self.rules[i], set(), -1
            windows: list[list[int]] = []
            for s, e in sorted(hits):
                lo, hi = max(0, s - rule.before), min(len(text), e + rule.after)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], hi)
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                for m in self.patterns[i].finditer(text, max(lo, upto), hi):
                    match = self.judged(i, m, text)
                    upto = m.end()
                    if match and (match.start, match.end) not in seen:
                        seen.add((match.start, match.end))
                        found.append(match)
        return settled(found)

    def judged(self, i: int, m: re.Match, text: str) -> Match | None:
        """The finding of a raw match, or None if it is a placeholder, allowed, vetoed, too regular or not valid."""
        rule = self.rules[i]
        group = rule.group or ("secret" if "secret" in m.re.groupindex else next((g for g in range(1, (m.re.groups or 0) + 1) if m[g] is not None), 0))
        secret, (start, end) = m[group], m.span(group)
        if not secret:
            return None
        if any(p.search(secret) for p in self.placeholders) or any(p.search(secret) for p in self.global_allowed):
            return None
        low = secret.lower()
        if any(w in low for w in formats.GLOBAL_STOPWORDS) or any(w in low for w in rule.stopwords):
            return None
        if any(p.search(secret) for p in self.allowed[i]) or any(p.search(m[0]) for p in self.allowed_match[i]):
            return None
        context = text[max(0, m.start() - 16) : m.end() + 16]
        if any(p.search(context) for p in self.vetoes[i]):
            return None
        if rule.layer == "keyed" and (low in ("password", "passwd", "secret", "token") or "(" in text[end : end + 1] or not worth(secret)):
            return None
        if rule.entropy and entropy(secret) < rule.entropy or rule.validator and not valid_checksum(secret):
            return None
        form = canonical(secret, rule.canonical)
        return Match(rule.name, rule.kind, rule.confidence, rule.label, start, start + len(form) if rule.canonical == "url" else end, secret, form, mask(form, rule.kind, rule.shown), rule.layer)


def worth(value: str) -> bool:
    """A value found only by its key word must look like one: two classes of characters and 2.5 bits of entropy, and no path in code."""
    classes = sum(any(t(c) for c in value) for t in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum()))
    if re.fullmatch(r"[A-Za-z_]+(?:[.:/-][A-Za-z_]+)*", value):
        return False
    return classes >= 2 and entropy(value) >= 2.5


def settled(found: list[Match]) -> list[Match]:
    """Findings of which no two overlap: the surest first, then the longest; keyed ones give way to any other.

    Taken in that order, each is kept if it touches none that is kept already, which its neighbours by place tell.
    """
    starts: list[int] = []
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (m.layer == "keyed", -LEVELS[m.confidence], m.start - m.end, m.start, m.rule)):
        at = bisect.bisect_left(starts, m.end)
        if at and kept[at - 1].end > m.start:
            continue
        starts.insert(at, m.start)
        kept.insert(at, m)
    return kept


_scanners: dict[tuple | None, Scanner] = {}


def scanner(rules: tuple[Rule, ...] | None = None) -> Scanner:
    """The process's scanner for some rules, or for all."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(bundled() if rules is None else rules)
    return _scanners[rules]
