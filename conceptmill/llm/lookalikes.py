"""Which characters read the same; tables for :mod:`normalize`.

Decompositions come from Python's Unicode database by rule.  Only the look-alike letters are listed.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from functools import lru_cache

# Letters of other scripts, or rare Latin ones, whose usual shape is that of the Latin letter before the
# colon.  Capitals and small letters are listed by shape, not by case: capital В looks like B, small в like no Latin letter.
LOOK_ALIKES = """
A: А Α Ꭺ ᗅ
B: В Β Ᏼ ᗷ
C: С Ϲ Ꮯ
D: Ꭰ ᗞ
E: Е Ε Ꭼ
F: Ϝ ᖴ
G: Ԍ Ꮐ
H: Н Η Ꮋ ᕼ
I: І Ι Ӏ
J: Ј Ꭻ
K: К Κ Ꮶ
L: Ꮮ ᒪ
M: М Μ Ϻ Ꮇ
N: Ν
O: О Ο Օ
P: Р Ρ Ꮲ ᑭ
Q: Ԛ
R: Ꭱ Ꮢ ᖇ
S: Ѕ Տ Ꮪ
T: Т Τ Ꭲ
U: Ս ᑌ
V: Ѵ Ꮩ
W: Ԝ Ꮃ
X: Х Χ
Y: Ү Υ
Z: Ζ Ꮓ
a: а ɑ
c: с ϲ
d: ԁ
e: е
g: ɡ
h: һ հ
i: і
j: ј ϳ
l: ӏ
n: ո
o: о ο օ
p: р ρ
q: ԛ
s: ѕ
u: ս
v: ѵ ν
w: ԝ
x: х
y: у ү
-: ‐ ‑
"""


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    out = {}
    for line in LOOK_ALIKES.split("\n"):
        latin, _, others = line.partition(":")
        for other in others.split():
            out[other] = latin
    return out


def _invisible(c: str) -> bool:
    """Format characters and variation selectors take no space; some format characters are visible signs."""
    if ud.category(c) == "Cf":
        return not ud.name(c, "").startswith(("ARABIC NUMBER", "ARABIC SIGN", "ARABIC FOOTNOTE", "ARABIC END", "ARABIC DISPUTED", "ARABIC POUND", "ARABIC PIASTRE", "SYRIAC ABB", "KAITHI NUMBER", "EGYPTIAN"))
    return "VARIATION SELECTOR" in ud.name(c, "") or c in "͏ᅟᅠ឴឵ㅤﾠ"


def spread(c: str) -> str:
    """What ``c`` reads as, in decomposed characters: width variants, spaces, ligatures and no-break forms are
    resolved, raised, circled and other marked forms stay."""
    if _invisible(c):
        return ""
    if ud.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85":
        return " "
    out = []
    for x in ud.normalize("NFD", c):
        kind, _, rest = ud.decomposition(x).partition("> ")
        same = kind in ("<wide", "<narrow", "<noBreak") or kind == "<compat" and "LIGATURE" in ud.name(x, "")
        if same:
            out.extend(spread(chr(int(h, 16))) for h in rest.split())
        else:
            out.append(look_alikes().get(x, x))
    return "".join(out)


@lru_cache(maxsize=1)
def spread_table() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, its (character, combining class) sequence) for all characters that do not just stand for themselves."""
    rows = []
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or ud.category(c) in ("Cn", "Co"):
            continue
        s = spread(c)
        if s != c or ud.combining(c):
            rows.append((c, [(x, ud.combining(x)) for x in s]))
    rows.extend((c, [(" ", 0)]) for c in "\t\n\r\x0b\x0c")
    return rows


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Primary composites by their pair of characters, without Hangul, which follows a rule."""
    out = {}
    for n in range(0xA0, sys.maxunicode + 1):
        c = chr(n)
        if 0xAC00 <= n <= 0xD7A3:
            continue
        d = ud.decomposition(c)
        if d and d[0] != "<" and " " in d:
            pair = "".join(chr(int(h, 16)) for h in d.split())
            if ud.normalize("NFC", pair) == c:
                out[pair] = c
    return out


@lru_cache(maxsize=1)
def two_faced() -> str:
    """Capitals that look Latin while their small letter does not: they read in two ways."""
    return "".join(c for c, latin in look_alikes().items() if c.lower() != c and spread(c.lower()) != latin.lower())
