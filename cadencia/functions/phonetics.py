"""Metaphone keys by a table of rules, one letter at a time.

The rules are those published for the original algorithm: each letter has its cases in order, a case looks at the letters around it, gives a sound (or none) and
says how many letters it takes. Words keep their places in the key, between blanks; characters other than a to z have no sound.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: For each letter the cases (pattern at the letter, sound, letters taken) in order; the first that fits counts. ^ and \b stand for the word's ends.
RULES: dict[str, list[tuple[str, str, int]]] = {
    "a": [(r"\bae", "E", 2), (r"\ba", "A", 1)],
    "b": [(r"(?<=m)b\b", "", 1), (r"b", "B", 1)],
    "c": [(r"cia", "X", 2), (r"(?<=s)ch", "K", 2), (r"ch", "X", 2), (r"(?<=s)c[iey]", "", 1), (r"c[iey]", "S", 1), (r"ck", "K", 2), (r"c", "K", 1)],
    "d": [(r"dg[eiy]", "J", 2), (r"d", "T", 1)],
    "e": [(r"\be", "E", 1)],
    "f": [(r"f", "F", 1)],
    "g": [(r"\bgn", "", 1), (r"\bgh", "K", 2), (r"gh(?=[aeiou])", "K", 2), (r"gh", "", 2), (r"gn(?=\b|ed\b)", "", 1), (r"(?<!g)g[eiy]", "J", 1), (r"g", "K", 1)],
    "h": [(r"(?<![aeiou])h(?=[aeiou])", "H", 1), (r"(?<=[aeiou])h(?=[aeiou])", "H", 1)],
    "i": [(r"\bi", "I", 1)],
    "j": [(r"j", "J", 1)],
    "k": [(r"\bkn", "", 1), (r"k", "K", 1)],
    "l": [(r"l", "L", 1)],
    "m": [(r"m", "M", 1)],
    "n": [(r"n", "N", 1)],
    "o": [(r"\bo", "O", 1)],
    "p": [(r"\bpn", "", 1), (r"ph", "F", 2), (r"p", "P", 1)],
    "q": [(r"q", "K", 1)],
    "r": [(r"r", "R", 1)],
    "s": [(r"si[oa]", "X", 1), (r"sh", "X", 2), (r"s", "S", 1)],
    "t": [(r"ti[oa]", "X", 1), (r"tch", "", 1), (r"thm", "T", 2), (r"th", "0", 2), (r"t", "T", 1)],
    "u": [(r"\bu", "U", 1)],
    "v": [(r"v", "F", 1)],
    "w": [(r"\bwr", "", 1), (r"\bwh", "W", 2), (r"w(?=[aeiou])", "W", 1)],
    "x": [(r"\bx", "S", 1), (r"x", "KS", 1)],
    "y": [(r"y(?=[aeiou])", "Y", 1)],
    "z": [(r"z", "S", 1)],
}
_CASES = {c: [(re.compile(p), s, n) for p, s, n in cases] for c, cases in RULES.items()}


@lru_cache(maxsize=100_000)
def word_key(word: str) -> str:
    out, at = [], 0
    while at < len(word):
        c, step = word[at], 1
        # a doubled letter sounds once, as the second of both, but for c
        if c == "c" or word[at + 1 : at + 2] != c:
            for pattern, sound, taken in _CASES.get(c, ()):
                if pattern.match(word, at):
                    out.append(sound)
                    step = taken
                    break
        at += step
    return "".join(out)


def metaphone(text: str) -> str:
    return " ".join(k for k in (word_key(w) for w in text.lower().split()) if k)
