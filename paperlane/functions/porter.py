"""The stemmer of Porter (1980), written from the paper: suffix rules by step, conditions on the measure of the stem."""

from __future__ import annotations

import re

VOWELS = set("aeiou")

# The suffix rules of steps 2 to 4, longest match first within a step.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in VOWELS or letter == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, rules) -> tuple[str, str] | None:
    hits = [r for r in rules if word.endswith(r[0])]
    return max(hits, key=lambda r: len(r[0])) if hits else None


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        rule = _longest(word, rules)
        if rule and measure(word[: -len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
    rule = _longest(word, [(s, "") for s in STEP4])
    if rule:
        rest = word[: -len(rule[0])]
        if measure(rest) > 1 and (rule[0] != "ion" or rest[-1:] in ("s", "t")):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not _cvc(rest):
            word = rest
    if measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
