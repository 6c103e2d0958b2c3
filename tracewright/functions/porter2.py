"""The English stemmer of the Snowball project (Porter2), after its published description."""

from __future__ import annotations

import re

#: Fixed values of the algorithm.
VOWELS = "aeiouy"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
REGION_HEADS = ("gener", "commun", "arsen")
DOUBLES = {x + x for x in "bdfgmnprt"}
LI_ENDS = set("cdeghkmnrt")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_HAS_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant after a vowel, and the same again within R1."""
    head = next((h for h in REGION_HEADS if word.startswith(h)), None)
    first = len(head) if head else m.end() if (m := _REGION.search(word)) else len(word)
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not _HAS_VOWEL.search(w[: len(w) - len(end)]):
        return w
    w = w[: len(w) - len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w[-2:] in DOUBLES:
        return w[:-1]
    return w + "e" if _SHORT.search(w) and r1 >= len(w) else w


def _derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, (*STEP_2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        stem = w[: len(w) - len(end)]
        if end in STEP_2:
            w = stem + STEP_2[end]
        elif end == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif stem[-1:] in LI_ENDS:
            w = stem
    end = _longest(w, (*STEP_3, "ative"))
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: len(w) - len(end)] + STEP_3.get(end, "")
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(end)]
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in KEPT_LATER:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _derived(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
