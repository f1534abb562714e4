"""English and French stemmers after the published Snowball descriptions, and the analyzer that uses both."""

from __future__ import annotations

import re
from itertools import chain

import pandas as pd
from pyspark.sql import functions as F

# Function words that are not indexed.
STOPWORDS = frozenset((
    "a an and are as at be by for from has have how i in is it of on or that the this to was what when where which who why will with you do does can "
    "au aux avec ce ces comment dans de des du elle en est et il je la le les leur lui mais ne nous on ou où par pas pour qu que quel quelle qui quoi "
    "sa se ses son sont sur ta te un une vous y l d c s n j m t").split())


def _regions(word: str, boundary: re.Pattern) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel that follows a vowel, and again."""
    first = boundary.search(word)
    if not first:
        return len(word), len(word)
    second = boundary.search(word, first.end())
    return first.end(), second.end() if second else len(word)


_EN_BOUNDARY = re.compile("[aeiouy][^aeiouy]")
_EN_Y = re.compile(r"(?<=[aeiouy])y|^y")
_EN_VOWEL = re.compile("[aeiouy]")
_EN_SHORT = re.compile(r"[aeiouy][^aeiouy]")
_EN_SHORT_END = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$")
_EN_OWNER = re.compile(r"('s'|'s|')$")
_EN_FINAL_Y = re.compile(r"..*[^aeiouy][yY]$")
_EN_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
             ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
             ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_EN_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_EN_ENDS2, _EN_ENDS3 = (tuple(end for end, _ in step) for step in (_EN_STEP2, _EN_STEP3))
_EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_EN_FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
             "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_KEEP = frozenset("inning outing canning herring earring proceed exceed succeed".split())


def english(word: str) -> str:
    if word in _EN_FIXED:
        return _EN_FIXED[word]
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if "y" in w:
        w = _EN_Y.sub("Y", w)
    r1, r2 = _regions(w, _EN_BOUNDARY)
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            r2 = r1 + _regions(w[r1:], _EN_BOUNDARY)[0]

    def ends_short(x: str) -> bool:
        return bool(_EN_SHORT.fullmatch(x) or _EN_SHORT_END.search(x))

    if "'" in w:
        w = _EN_OWNER.sub("", w)
    # plural
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _EN_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w.lower()
    # past and progressive
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed") if w.endswith(("eedly", "ingly", "edly", "ing", "ed")) else ():
        if w.endswith(end):
            if end in ("eedly", "eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif _EN_VOWEL.search(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                    w = w[:-1]
                elif ends_short(w) and len(w) <= r1:
                    w += "e"
            break
    if w.endswith(("y", "Y")) and len(w) > 2 and _EN_FINAL_Y.search(w):
        w = w[:-1] + "i"
    for end, new in _EN_STEP2 if w.endswith(_EN_ENDS2) else ():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    for end, new in _EN_STEP3 if w.endswith(_EN_ENDS3) else ():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _EN_STEP4 if w.endswith(_EN_STEP4) else ():
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_BOUNDARY = re.compile(f"[{_FR_VOWELS}][^{_FR_VOWELS}]")
_FR_BETWEEN = re.compile(rf"(?<=[{_FR_VOWELS}])([ui])(?=[{_FR_VOWELS}])")
_FR_Y = re.compile(rf"(?<=[{_FR_VOWELS}])y|y(?=[{_FR_VOWELS}])")
_FR_TWO = re.compile(rf"[{_FR_VOWELS}]{{2}}")
_FR_VOWEL = re.compile(f"[{_FR_VOWELS}]")
_FR_S = re.compile(r"(?<=[^aiouès])s$")
_FR_ACCENT = re.compile(rf"[éè]([^{_FR_VOWELS}]+)$")


def _longest(*ends: str) -> tuple[str, ...]:
    return tuple(sorted(ends, key=len, reverse=True))


#: Endings, the longest first; the region that must hold them; what stands in their place.
_FR_STANDARD = ((_longest(*"ance iqUe isme able iste eux ances iqUes ismes ables istes".split()), "r2", ""), (_longest(*"atrice ateur ation atrices ateurs ations".split()), "r2", ""),
                (_longest("logie", "logies"), "r2", "log"), (_longest(*"usion ution usions utions".split()), "r2", "u"), (_longest("ence", "ences"), "r2", "ent"),
                (_longest("ement", "ements"), "rv", ""), (_longest("ité", "ités"), "r2", ""), (_longest(*"if ive ifs ives".split()), "r2", ""), (("eaux",), "0", "eau"), (("aux",), "r1", "al"),
                (_longest("euse", "euses"), "r2", ""), (("amment",), "rv", "ant"), (("emment",), "rv", "ent"), (_longest("ment", "ments"), "rv1", ""))
_FR_ANY_STANDARD = tuple(e for ends, _, _ in _FR_STANDARD for e in ends)
_FR_I_VERBS = _longest(*("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
                         "issantes issants isse issent isses issez issiez issions issons it").split())
_FR_VERBS = {"ions": "r2", **dict.fromkeys("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split(), "rv"),
             **dict.fromkeys("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split(), "rv")}
_FR_VERB_ENDS = _longest(*_FR_VERBS)
_FR_RESIDUAL = _longest("ier", "ière", "Ier", "Ière")


def french(word: str) -> str:
    """A light form of the French algorithm: standard suffixes, verb endings, residual endings and accents."""
    w = _FR_BETWEEN.sub(lambda m: m[1].upper(), word)
    if "y" in w:
        w = _FR_Y.sub("Y", w)
    w = w.replace("qu", "qU")
    if _FR_TWO.match(w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        m = _FR_VOWEL.search(w, 1)
        rv = m.start() + 1 if m else len(w)
    r1, r2 = _regions(w, _FR_BOUNDARY)
    starts = {"0": 0, "r1": r1, "r2": r2, "rv": rv, "rv1": rv + 1}

    def cut(ends: tuple[str, ...], start: int, new: str = "") -> bool:
        nonlocal w
        if not w.endswith(ends):
            return False
        end = next(e for e in ends if w.endswith(e))
        if len(w) - len(end) < start:
            return False
        w = w[: len(w) - len(end)] + new
        return True

    done = w.endswith(_FR_ANY_STANDARD) and any(cut(ends, starts[start], new) for ends, start, new in _FR_STANDARD)
    if not done and w.endswith(_FR_I_VERBS):
        end = next((e for e in _FR_I_VERBS if w.endswith(e) and len(w) > len(e) and w[len(w) - len(e) - 1] not in _FR_VOWELS), None)
        done = bool(end) and cut((end,), rv)
    if not done and w.endswith(_FR_VERB_ENDS):
        end = next(e for e in _FR_VERB_ENDS if w.endswith(e))
        done = cut((end,), starts[_FR_VERBS[end]])
    if done:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        if w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        w = _FR_S.sub("", w)
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
        cut(_FR_RESIDUAL, rv, "i")
        cut(("e",), rv)
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = _FR_ACCENT.sub(r"e\1", w)
    return w.lower()


class _Stems(dict):
    """Word -> its English stem and the French one where it differs; emptied when it holds `most` words."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = () if len(word) < 2 or word in STOPWORDS else tuple(dict.fromkeys((english(word), french(word))))
        return found


_stems = _Stems(400_000)  # some 100 MB a worker
_WORD = re.compile(r"[^\W]+")


def analyse(text: str) -> list[str]:
    """Index terms: words of two letters at least that are no stopwords, by their English stem and the French one where it differs."""
    return list(chain.from_iterable(map(_stems.__getitem__, _WORD.findall(text.lower()))))


def stemmed_terms(c):
    """analyse() as a column: array<string>."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: analyse(t or ""))

    return run(c)


def stemmed_among(c, wanted: list[str]):
    """struct<length, terms>: the number of analyse()'s terms, and those of them that are wanted; the others never leave Python."""
    asked = frozenset(wanted)

    @F.pandas_udf("struct<length: bigint, terms: array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [analyse(t or "") for t in texts]
        return pd.DataFrame({"length": [len(x) for x in found], "terms": [[] if asked.isdisjoint(x) else [y for y in x if y in asked] for x in found]})

    return run(c)


stemmed_terms.among = stemmed_among
