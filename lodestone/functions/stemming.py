"""Porter's suffix stripping for English, with the customary exceptions for short and irregular words.

A word is worked on as its letters and its shape (a string of c and v), so every condition of the rules is a
question to a pattern: the measure counts how often a vowel is followed by a consonant.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

#: The rules of the published algorithm. Of a step's suffixes the longest that fits is the one tried.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words that no rule brings to their stem.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c", shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    s = shape(stem)
    return s.endswith("cvc") and stem[-1] not in "wxy" or s == "vc"


def _double(word: str) -> bool:
    return word[-2:-1] == word[-1:] and shape(word).endswith("c")


def _replace(word: str, rules: list[tuple[str, str]], fits: Callable[[str, str], bool]) -> str:
    for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if fits(stem, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word if word.endswith("ss") or not word.endswith("s") else word[:-1]


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    stem = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x)), "")
    if "v" not in shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")) or measure(stem) == 1 and _short(stem):
        return stem + "e"
    return stem[:-1] if _double(stem) and stem[-1] not in "lsz" else stem


def _step_2(word: str) -> str:
    # The rule for -logi counts the l to the stem; -alli leads to more rules.
    out = _replace(word, STEP_2, lambda stem, suffix: measure(stem + "l" if suffix == "logi" else stem) > 0)
    return _step_2(out) if out != word and word.endswith("alli") else out


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in IRREGULAR or len(word) < 3:
        return IRREGULAR.get(word, word)
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and shape(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    word = _replace(_step_2(word), STEP_3, lambda s, _: measure(s) > 0)
    word = _replace(word, [(x, "") for x in STEP_4], lambda s, suffix: measure(s) > 1 and (suffix != "ion" or s.endswith(("s", "t"))))
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
