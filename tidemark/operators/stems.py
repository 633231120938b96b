"""English stems after the published Porter2 rules, and the words that a search leaves out."""

from __future__ import annotations

from functools import lru_cache

# The common English stop words, and the word lists and endings of the published rules.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
VOWELS, DOUBLES, LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    begun = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(begun) if begun else _region(w, 0)
    r2 = _region(w, r1)

    w = w.removesuffix(_ending(w, ("'s'", "'s", "'")))
    if e := _ending(w, ("sses", "ied", "ies", "us", "ss", "s")):
        if e == "sses":
            w = w[:-2]
        elif e in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif e == "s" and any(c in VOWELS for c in w[:-2]):
            w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    if e := _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        if e.startswith("eed"):
            w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
        elif any(c in VOWELS for c in w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    if (e := _ending(w, STEP2)) and len(w) - len(e) >= r1:
        before = w[-len(e) - 1 : -len(e)]
        if not (e == "ogi" and before != "l" or e == "li" and before not in LI):
            w = w[: -len(e)] + STEP2[e]
    if (e := _ending(w, STEP3)) and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP3[e]
    if (e := _ending(w, STEP4)) and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()
