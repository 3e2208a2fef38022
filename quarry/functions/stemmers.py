"""Stemmers: Porter's algorithm for English as published in 1980, and light suffix strippers for other languages."""

from __future__ import annotations

import re
from collections.abc import Callable


def _shape(w: str) -> str:
    """The word as consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_PAIRS = [sorted((tuple(p.split(":")) for p in s.split(" ")), key=lambda p: -len(p[0])) for s in (_STEP2, _STEP3)]
_ENDS = sorted(_STEP4.split(), key=len, reverse=True)


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (m := re.fullmatch(r"(.*?)(ed|ing)", w)) and "v" in _shape(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in _PAIRS:
        for a, b in pairs:
            if w.endswith(a):
                w = w[: -len(a)] + b if _measure(w[: -len(a)]) else w
                break
    for a in _ENDS:
        if w.endswith(a):
            s = w[: -len(a)]
            if _measure(s) > 1 and (a != "ion" or s[-1:] in ("s", "t")):
                w = s
            break
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def plural(w: str) -> str:
    """The English s-stemmer."""
    if w.endswith("ies") and not w.endswith(("eies", "aies")) and len(w) > 3:
        return w[:-3] + "y"
    if w.endswith("es") and not w.endswith(("aes", "ees", "oes")):
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) and len(w) > 2 else w


def light(suffixes: str, least: int = 3) -> Callable[[str], str]:
    """Strips the longest listed suffix that leaves least letters."""
    ends = sorted(suffixes.split(), key=len, reverse=True)

    def run(w: str) -> str:
        for e in ends:
            if w.endswith(e) and len(w) - len(e) >= least:
                return w[: -len(e)]
        return w

    return run


STEMMERS: dict[str, Callable[[str], str]] = {
    "en": porter,
    "en_plural": plural,
    "de": light("e s n en er em es ern nen heit keit ung lich isch"),
    "fr": light("s x e es ée ées er ment ements ement eux euse euses if ive ation ations ité ités"),
    "es": light("s es a o os as e mente ción ciones ando iendo ar er ir idad"),
    "it": light("i e a o mente zione zioni are ere ire"),
    "pt": light("s es a o os as e mente ção ções ar er ir"),
    "nl": light("e en s heid heden ing"),
    "sv": light("a ar or er en et na arna erna het"),
    "da": light("e er en et erne ene s"),
    "no": light("e er en et ene s"),
    "fi": light("a ä n t ssa ssä sta stä lla llä lta ltä lle ksi in en"),
    "ru": light("а я ы и о е у ю й ь ам ям ах ях ов ев ой ий ый ая яя ое ее ые ие ого его ому ему ость ать ить"),
    "tr": light("lar ler da de dan den ın in un ün ı i u ü"),
    "ro": light("a e i le lor ul ului ii uri"),
    "hu": light("ban ben nak nek val vel k t on en ök ok ek"),
    "pl": light("a e i y ą ę ach ami ego emu ów owi em ie"),
    "hr": light("a e i o u om em ima ama ovi"),
    "ar": light("ها ان ات ون ين يه ية ه ة ي", 2),
    "hi": light("ा े ी ि ो ु ों ें ियों ाओं", 2),
    "ckb": light("ەکان ان ەکە یەک ێک ە ی", 2),
    "id": light("kan an i nya lah kah"),
    "bg": light("а я о и ът та то те ове"),
}
