"""Names as people type them: one plain spelling, and how alike two spellings are."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from operator import eq

from tamis.functions.similarity import assigned, edit_distance
from tamis.llm.codepoints import CYRILLIC, GREEK

# Usual romanisation.
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґјљњћђџѕ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya i yi ye g j lj nj c d dz dz".split()))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
ROMAN = {ord(k): v.strip("-") for k, v in {**_CYRILLIC, **_GREEK}.items()} | {ord(k): v for k, v in zip("øłđðþæœıħŧ", ["o", "l", "d", "d", "th", "ae", "oe", "i", "h", "t"])}
LOOKALIKE = {ord(k): v for k, v in {**CYRILLIC, **GREEK}.items()}

#: Short names that are no beginnings of the full name, each with the names it may stand for; a parameter of the operators
#: (`nicknames`), to be replaced by a fuller resource where there is one.
NICKNAMES_TEXT = """
al albert alfred alan ali; alec alexander; alex alexander alexandra alexandre alejandro aleksandr; andi andreas andrea; andy andrew andrea; aziz abdelaziz; babeth elisabeth elizabeth; barney barnaby bernard; basti sebastian
bea beatrice beatriz; becky rebecca; bernd bernhard; bert albert herbert robert; bess elizabeth; beth elizabeth; betty elizabeth beatrice; bill william; bob robert; bobby robert; cathy catherine; charlie charles charlotte
charo rosario; chelo consuelo; chente vicente; chris christopher christine christian; chuck charles; concha concepcion; connie constance concepcion; conny cornelia constance; dan daniel bogdan; dave david; debby deborah
dick richard; dima dmitri; dolly dorothy dolores; dora theodora dorothea; ed edward edmund edwin; eddie edward edmund edwin; ellie eleanor helen; fanfan francoise francois; fedya fyodor; frank francis franklin; franz francis
freddy frederick frederic alfred; fritz friedrich; gabi gabriele gabriela; galya galina; gerd gerhard; gerry gerald geraldine; ginette genevieve; goyo gregorio; grete margarete; grisha grigori; gunni gunther; gus augustus august
hank henry; hanna johanna; hannes johannes; hans johannes; harry henry harold; heiner heinrich; heinz heinrich; helmi wilhelmina; hettie henrietta; hilde brunhild hildegard mathilde; jack john; jandro alejandro; jim james
jimmy james; jochen joachim; joe joseph youssef; johnny john; jojo joseph josephine; jopie josephine; josie josephine; jurg jurgen georg; karim abdelkarim; kate catherine katharina; kathe katharina; katya ekaterina; kerstin christine
khady khadija; kit christopher katherine; kolya nikolai; kostya konstantin; ksenia oksana; lalo eduardo; larry lawrence; lena olena helena magdalena; leni helene magdalena; liesel elisabeth; lisa elisabeth elizabeth; liz elizabeth
lola dolores; loulou louis louise; lupe guadalupe; lyuda lyudmila; maggie margaret; manolo manuel; manu emmanuel manuel; margot marguerite; marge margaret; matze matthias; meche mercedes; memo guillermo; mick michael; mike michael
mimi meriem marie; mina wilhelmina; minna wilhelmine; misha mikhail; molly mary; monty montgomery; nace ignace ignacio; nacho ignacio; nando fernando; nastya anastasia; ned edward; neil cornelius; nelly helen eleanor; paca francisca
paco francisco; paddy patrick; pasha pavel; peggy margaret; pepe jose; pippa philippa; polly mary; quino joaquin; quique enrique; rahim abderrahim; rick richard; rike friederike; rob robert; rolf rudolf; roz rosamund rosalind
sally sarah; sasha aleksandr alexandra; sepp josef; seryozha sergei; slava yaroslav vyacheslav; susi susanne; sveta svetlana; tanya tatiana; tari tarek; ted edward theodore; teddy theodore edward; tilda mathilde; tima timofei
toni anton antonia; tony anthony antonio; trudi gertrud; uli ulrich ulrike; uschi ursula; valya valentina; vanya ivan; volodya vladimir; wil walid william; will william wilhelm guillaume; willi wilhelm; yura yuri; zack zachary; zizi zineb
"""


def nickname_table(text: str = NICKNAMES_TEXT) -> dict[str, frozenset[str]]:
    """Short name to the full names it may stand for, from lines of entries `short full full ...; ...`."""
    table: dict[str, set[str]] = {}
    for entry in re.split(r"[;\n]", text):
        if words := entry.split():
            table.setdefault(words[0], set()).update(words[1:])
    return {k: frozenset(v) for k, v in table.items()}


_nicknames: dict[str, frozenset[str]] = nickname_table()


def use_nicknames(table: dict[str, frozenset[str]]) -> None:
    """Make this process compare names by another table of short names."""
    global _nicknames
    if table != _nicknames:
        _nicknames = table
        likeness.cache_clear()


def full_names(token: str) -> frozenset[str]:
    return _nicknames.get(token, frozenset())


# Linking parts of surnames.
LINKS = frozenset("de la las los del della di da do dos du des le les el al ben bin ibn ould abu von van der den zu zum zur".split())
# Legal forms, each with its spellings.
LEGAL = {
    "sa": ["societe anonyme", "sociedad anonima", "sa"], "sarl": ["societe a responsabilite limitee", "sarl"], "gmbh": ["gesellschaft mit beschrankter haftung", "gesellschaft mbh", "ges mbh", "gmbh"],
    "llc": ["limited liability company", "limited liability co", "llc"], "jsc": ["joint stock company", "joint stock co", "jsc", "j s c"], "fze": ["free zone establishment", "free zone est", "fze"],
    "ltd": ["private limited", "limited", "ltd"], "inc": ["incorporated", "inc"], "ag": ["aktiengesellschaft", "ag"], "plc": ["plc"],
}
_LEGAL = re.compile("|".join(rf"(?P<{k}>\b(?:{'|'.join(v)})\b)" for k, v in LEGAL.items()))
# Trade words with short forms that are no beginnings of them.
_TRADE = {"trdg": "trading", "shpg": "shipping", "hldg": "holding", "intl": "international", "ets": "etablissements", "mfg": "manufacturing", "bros": "brothers", "mv": "", "mt": "", "ss": ""}
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?|\b(?:[a-z]\. ?){3,}(?=\s|$|[,)])")
# Letters that are typed for one another because they sound alike, in order of application.
_SOUNDS = [("sch", "sh"), ("tch", "ch"), ("ph", "f"), ("kh", "k"), ("ck", "k"), ("ch", "k"), ("th", "t"), ("gh", "g"), ("rh", "r"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("qu", "k"), ("x", "ks")]
_WITHOUT_H = [(written, heard) for written, heard in _SOUNDS if "h" not in written]
_LETTERS = str.maketrans("qcwyjz", "kkviis")
_DOUBLED = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[()（）]")


@lru_cache(1 << 16)
def plain(text: str) -> str:
    """Lower-case Latin letters and digits; look-alikes, accents, invisible characters and other scripts resolved."""
    if text.isascii():
        return text.lower()
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    words = []
    for word in re.split(r"(\W+)", text):
        if not word.isascii() and any("a" <= c <= "z" for c in unicodedata.normalize("NFD", word).lower()):
            word = word.translate(LOOKALIKE)
        words.append(word)
    folded = unicodedata.normalize("NFD", "".join(words).casefold())
    return "".join(c for c in folded if not unicodedata.combining(c)).translate(ROMAN)


def person_tokens(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(plain(text).replace("'", "").replace("’", "")))


def company_tokens(text: str) -> tuple[str, ...]:
    """Tokens with the legal form, if any, as one token after '#'."""
    s = _INITIALS.sub(lambda m: re.sub(r"[. ]", "", m[0]) + " ", plain(text))
    s = " ".join(_WORD.findall(s))
    forms: list[str] = []
    s = _LEGAL.sub(lambda m: forms.append(m.lastgroup) or " ", s)
    tokens = [_TRADE.get(t, t) for t in s.split()]
    return (*(t for t in tokens if t), *(f"#{f}" for f in forms[-1:]))


@lru_cache(1 << 15)
def spellings(text: str | None, company: bool) -> list[tuple[str, ...]]:
    """Token tuples of a name; a second name in parentheses is a spelling of its own."""
    if not text:
        return []
    parts = _PARTS.split(text)
    tokens = company_tokens if company else person_tokens
    return [t for p in parts if (t := tokens(p)) and sum(map(len, t)) > 1]


@lru_cache(1 << 16)
def sound(token: str) -> str:
    for written, heard in _SOUNDS if "h" in token else _WITHOUT_H:
        token = token.replace(written, heard)
    token = token.translate(_LETTERS)
    return _DOUBLED.sub(r"\1", token) if any(map(eq, token, token[1:])) else token


def _typed(a: str, b: str) -> float:
    """Likeness by the number of slips, for words of at least four letters."""
    size = max(len(a), len(b))
    most = 3 if size >= 6 else 2 if size >= 4 else 1
    d = edit_distance(a, b, most)
    value = 1 - d / size
    return value if d <= most and value >= 0.5 else 0.0


@lru_cache(1 << 17)
def likeness(a: str, b: str, common: bool = True) -> float:
    """How surely two tokens are spellings of one: 1 equal, 0 not. A beginning counts as a short form only of a common name:
    given names are shared by many and cut short, surnames that begin alike are different ones."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if a.isdigit() or b.isdigit():
        return 0.0
    full, other = full_names(a), full_names(b)
    if len(a) == 1:
        return 0.7 if b[0] == a or any(f[0] == a for f in other) else 0.0
    if b in full or a in other:
        return 0.9
    if len(a) >= 3 and b.startswith(a):
        return 0.9 if common else max(0.6, _typed(a, b))
    best = _typed(a, b)
    if best < 0.95:
        x, y = sound(a), sound(b)
        best = max(best, 0.97 if x == y else 0.97 * _typed(x, y))
    if best < 0.8 and len(b) > 4 and any(edit_distance(f, b, 2) <= (2 if len(f) > 6 else 1) for f in full):
        best = 0.8
    if best < 0.65 and 3 <= len(a) <= 5 and len(b) > len(a) + 1 and edit_distance(a, b[: len(a)], 1) <= 1 and a[0] == b[0]:
        best = 0.65  # a short form with a slip
    return best


@lru_cache(1 << 16)
def _pair_bits(token: str) -> int:
    """The letter pairs of a word by sound, as bits."""
    codes = [*map(ord, sound(token))]
    mask = 0
    for x, y in zip(codes, codes[1:]):
        mask |= 1 << (x * 131 + y) % 251
    return mask


def shape_mask(name: str) -> int:
    """The letter pairs of a name by sound, as bits of a number, or else its letters; equal pairs have equal bits everywhere."""
    tokens = [t for t in name.split() if t[0] != "#"]
    mask = 0
    for t in tokens:
        mask |= _pair_bits(t)
    if not mask:
        for c in sound("".join(sorted(tokens))):
            mask |= 1 << ord(c) % 251
    return mask


def _core(tokens: tuple[str, ...]) -> list[str]:
    core = [t for t in tokens if t not in LINKS]
    return core if core else list(tokens)


@lru_cache(1 << 16)
def _link(token: str) -> bool:
    return len(token) <= 4 and any(edit_distance(token, x, 1) <= 1 for x in LINKS if len(x) > 1)


def person_agreement(a: tuple[str, ...], b: tuple[str, ...], weight, common=lambda t: True) -> tuple[float, float]:
    """Soft weighted token similarity of two persons' names, and its evidence: every token of the shorter name needs a partner.

    weight(token) grows with rarity; the evidence is the sum of the weights of the tokens that found partners, each times
    their likeness. 0 unless two tokens, at least one of them no initial, find partners. Tokens left over in the longer
    name (middle names) cost a little; links count nothing. common(token) tells whether many parties have a token.
    """
    if set(a) == set(b) and len(a) > 1:
        return 1.0, sum(weight(t) for t in set(a) if t not in LINKS)
    best = _aligned(a, b, weight, common)
    if best[0] < 0.8:
        # A blank typed into a word or left out between two.
        for x, y in ((a, b), (b, a)):
            for i in range(len(x) - 1):
                glued = x[i] + x[i + 1]
                if any(abs(len(glued) - len(t)) <= 2 and (glued[0] == t[0] or glued[-2:] == t[-2:]) and _typed(glued, t) >= 0.7 for t in y):
                    value, proof = _aligned((*x[:i], glued, *x[i + 2 :]), y, weight, common, glued)
                    best = max(best, (value - 0.04, proof))
    return best


def person_likeness(a: tuple[str, ...], b: tuple[str, ...], weight, common=lambda t: True) -> float:
    """The similarity of `person_agreement` alone."""
    return person_agreement(a, b, weight, common)[0]


def _aligned(a: tuple[str, ...], b: tuple[str, ...], weight, common, glued: str = "") -> tuple[float, float]:
    x, y = _core(a), _core(b)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        shortened = [t for t in y if not _link(t)]
        if len(shortened) >= len(x):
            y = shortened
    if len(x) < 2:
        p, q = "".join(x), "".join(y)
        return (0.92, sum(map(weight, y))) if len(p) > 7 and edit_distance(p, q, 2) <= 2 else (0.0, 0.0)
    x = sorted(x, key=len, reverse=True)  # long words tell different names apart soonest
    sims = []
    for s in x:
        row = [_typed(s, t) if glued in (s, t) else likeness(s, t, common(s if len(s) > len(t) else t)) for t in y]
        if max(row) < 0.45:
            return 0.0, 0.0
        sims.append(row)
    if not any(max(row) >= 0.5 and len(t) > 1 for row, t in zip(sims, x)):
        return 0.0, 0.0
    weights = [weight(t) for t in x]
    cost = assigned([[w * (1 - s) if s else 3 * w for s in row] for w, row in zip(weights, sims)])
    proof = sum(max(s * min(w, weight(t)) for s, t in zip(row, y)) for w, row in zip(weights, sims))
    return 1 - cost / sum(weights) - 0.03 * min(len(y) - len(x), 2), proof


def company_likeness(a: tuple[str, ...], b: tuple[str, ...], weight) -> float:
    """As person_likeness, for companies and ships: every token of both names needs a partner, but legal forms may be missing."""
    form_a, form_b = ({t for t in x if t[0] == "#"} for x in (a, b))
    if form_a and form_b and form_a != form_b:
        return 0.0
    x, y = ([t for t in s if t[0] != "#" and t not in LINKS] for s in (a, b))
    if sorted(x) == sorted(y) and x:
        return 1.0
    if not x or not y:
        return 0.0
    if sorted(t for t in x if t.isdigit()) != sorted(t for t in y if t.isdigit()):
        return 0.0
    if len(x) != len(y):
        p, q = "".join(x), "".join(y)
        return 0.92 if len(p) > 7 and edit_distance(p, q, 2) <= 2 else 0.0
    sims = [[likeness(s, t) for t in y] for s in x]
    if any(max(row) < 0.55 for row in sims):
        return 0.0
    weights = [weight(t) for t in x]
    cost = assigned([[w * (1 - s) if s else 3 * w for s in row] for w, row in zip(weights, sims)])
    return 1 - cost / sum(weights)
