"""Stem alternations as a rule table.

A rule belongs to an alternation number and a direction: 'a' maps a stem as found in a form to base stems, 'g' a base stem to the
stem of a form. Rules of one number are split into groups; within a group only the matching rules of the least rank apply (all
of them: a branch may give several stems), and a rule with emit = false gives nothing but keeps later ranks from applying.
Rules are joined to stems by number and last letter; their endings are compared as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "rule_mija int, tail string, grp int, rank int, ord int, ends string, not_ends string, starts string, min_len int, syllables int, third string, not_third string, rule_proper boolean, rule_superlative boolean, head int, cut int, pre string, add string, degree string, mark string, length string, emit boolean, use_third boolean"


@dataclass(frozen=True)
class E:
    """One rule: where it applies (ends, no, starts, least, third ...) and what it does (head and cut characters off, pre
    and add put on). Alternatives in ends are separated by slashes."""

    ends: str = ""
    cut: int = 0
    add: str = ""
    no: str = ""
    starts: str = ""
    least: int = 0
    syllables: int = 0
    third: str = ""
    not_third: str = ""
    proper: bool | None = None
    superlative: bool | None = None
    head: int = 0
    pre: str = ""
    degree: str | None = None
    mark: str | None = None
    length: str | None = None
    emit: bool = True
    use_third: bool = False


P, C, S = "Pamata", "Pārākā", "Vispārākā"
INA = "inā/sargā"
Group = list[list[E]]


def _swap(*pairs: tuple[str, str]) -> Group:
    """One branch a pair: the second is what the stem ends in, the first what it becomes; marked as such."""
    return [[E(b, len(b), a, mark=f"{a} -> {b}")] for a, b in pairs]


def _degrees(*rows: tuple[str, int, str]) -> list[Group]:
    """Both degrees of a chain of (ends, cut, add); the superlative only where asked for."""
    plain = [[E(e, c, a, degree=C)] for e, c, a in rows]
    return [plain, [[E(e, c, a, pre="vis", degree=S, superlative=True)] for e, c, a in rows]]


def _vis(*rows: E) -> Group:
    """A branch with vis- taken off (superlative), else one without (comparative), each of the given rules."""
    from dataclasses import replace

    return [[replace(r, starts="vis", head=3, degree=S) for r in rows], [E(starts="vis", emit=False)], [replace(r, degree=C) for r in rows]]


_LV_CLUSTERS_L = (("sl", "šļ"), ("zl", "žļ"), ("ll", "ļļ"), ("l", "ļ"))
_LV_CLUSTERS_N = (("sn", "šņ"), ("zn", "žņ"), ("ln", "ļņ"), ("nn", "ņņ"))
_PLAIN = "p/b/m/v/t/d/c/z/s/n/l/f"

#: Surface stem to base stems.
ANALYSIS: dict[int, list[Group]] = {
    0: [[[E()]]],
    1: [
        [
            [E("kš", 2, "kst", mark="kst -> kš"), E("nš", 2, "nst", mark="nst -> nš"), E("š", 1, "s", mark="s -> š"), E("š", 1, "t", mark="t -> š")],
            [E("ž", 1, "z", mark="z -> ž"), E("ž", 1, "d", mark="d -> ž")],
            *_swap(("c", "č"), *_LV_CLUSTERS_L, *_LV_CLUSTERS_N),
            [E("zņ/sņ/lņ", emit=False)],
            *_swap(("n", "ņ")),
            [E("pj/bj/mj/vj/fj", 1, mark="p->pj (u.c.)")],
            [E(no=_PLAIN)],
        ]
    ],
    2: [[[E(add="ā"), E(add="ī"), E(add="ē")]]],
    3: [[[E("āk", 2, starts="vis", head=3, least=4, degree=S)]], [[E("āk", 2, least=4, degree=C)]], [[E(degree=P)]]],
    6: [[[E("dī/tī/sī", 2, "s")], [E("šī", 1)], [E("zī", 1), E("zī")], [E(no="d/t/s/z")]]],
    7: [],
    8: [[[E(INA)]], [[E("ā", 1, "ī")]], [[E("a", 1, "ē")]], [[E("a", 1, "ā", no="ina/sarga")]]],
    9: [[[E("ina/sarga", 1, "ā")]], [[E("a", 1, "ī")], [E(add="ē"), E(add="ā"), E(add="o")]]],
    10: [[[E("i", 1, degree=P)]], [[E("āk", 2, starts="vis", head=3, degree=S)], [E("āk", 2, degree=C)]]],
    11: [[[E(no="c/dz")]], [[E("k", 1, "c")]], [[E("g", 1, "dz")]]],
    13: [[[E("āk", 2, starts="vis", head=3, degree=S)], [E("āk", 2, degree=C)]]],
    14: [[[E("c", 1, "k"), E("c")], [E("dz", 2, "g"), E("dz")], [E()]]],
    15: [[[E()]], [[E("z", 1, "s")]]],
    16: [[[E(no="s/z"), E(add="s", no="s/z"), E(add="z", no="s/z")]]],
    17: [[[E(syllables=2)], [E("iņ/īt")]]],
    20: [
        [[E("guļ/gul", 1, "lē")]],
        [[E("k", 1, "cī"), E("k", 1, "cē")], [E("g", 1, "dzī"), E("g", 1, "dzē")], [E("ž", 1, "dē")]],
        [[E("loc/moc/urc", 0, "ī")]],
    ],
    21: [[[E(starts="vis", head=3, degree=S)], [E(degree=C)]]],
    22: [[[E("us", 2, "uš")]]],
    23: [],
    24: [_vis(E(add="ā"), E(add="ī"), E(add="ē"))],
    25: [_vis(E(INA)), _vis(E("ā", 1, "ī"), E("a", 1, "ē"), E("a", 1, "ā", no="ina/sarga"))],
    26: [
        [[E("gul", 1, "lē")]],
        [[E("tec", 0, "ē")], [E("k", 1, "cī", no="tek"), E("k", 1, "cē", no="tek")], [E("g", 1, "dzī"), E("g", 1, "dzē")], [E("loc/moc/urc", 0, "ī")], [E(add="ē")]],
    ],
    27: [[[E("kā", 2, "cī")], [E("gā", 2, "dzī")], [E("ka", 2, "cē")], [E("ža", 2, "dē")], [E("ļa", 2, "lē")], [E("ga", 2, "dzē")]]],
    30: [
        [[E("vajadz", emit=False)], [E("ka", 2, "cī")], [E("ga", 2, "dzī")], [E("k", 1, "cē")], [E("ž", 1, "dē")], [E("ļ", 1, "lē")]],
        [[E("vajag", 1, "dzē")]],
    ],
    32: [_vis(E("k", 1, "cī"), E("k", 1, "cē"), E("g", 1, "dzī"), E("g", 1, "dzē"), E("ž", 1, "dē"), E("ļ", 1, "lē"))],
    33: [_vis(E("kā", 2, "cī"), E("gā", 2, "dzī"), E("ka", 2, "cē"), E("ža", 2, "dē"), E("ga", 2, "dzē"), E("guļa", 2, "lē"))],
    34: [[[E("āka", 3, starts="vis", head=3, least=5, degree=S)]], [[E("āka", 3, least=5, degree=C)]], [[E("a", 1, degree=P)], [E("ē", 0, "j", degree=P)]]],
    35: [[[E("a", 1, degree=P)], [E("ē", 0, "j", degree=P)]]],
    36: [[[E()]], [[E("iet", 3, "ej")]]],
    38: [
        [
            [E("āk", 2, starts="vis", head=3, least=4, degree=S), E("āk", 2, "i", starts="vis", head=3, least=4, degree=S), E("āk", 2, "u", starts="vis", head=3, least=4, degree=S)],
            [E("āk", 2, least=4, degree=C), E("āk", 2, "i", least=4, degree=C), E("āk", 2, "u", least=4, degree=C)],
            [E(degree=P)],
        ]
    ],
}
for _id, _short in ((7, E("odi/ūdi/opi/ūpi/oti/ūti/īti/ieti/sti", 1)), (23, E("od/ūd/op/ūp/ot/ūt/īt/st"))):
    ANALYSIS[_id] = [
        [
            [E("s", 1, "š"), E("s")],
            [_short],
            [E("met/cērt")],
            [E("t", 1, "š")],
            [E("dod/ved")],
            [E("ēd", no="sēd")],
            [E("d", 1, "ž")],
            [E("l", 1, "ļ")],
            [E("m/b", 0, "j", no="ņem")],
            [E("p"), E("p", 0, "j")],
            [E("c", 1, "k"), E("c", 1, "c")],
            [E("z", 1, "ž", no="dz")],
            [E(no="š/ž/ļ/k/g")],
        ]
    ]

_AK = [[E(add="āk", degree=C)]]
_AK_S = [[E(pre="vis", add="āk", degree=S, superlative=True)]]
#: Base stem to the stem of a form.
GENERATION: dict[int, list[Group]] = {
    0: [[[E()]]],
    1: [
        [
            [E("t", 1, "š", proper=True, mark="t -> š")],
            [E("d", 1, "ž", proper=True, mark="d -> ž")],
            *[[E(a, len(a), b, mark=f"{a} -> {b}")] for a, b in (("kst", "kš"), ("nst", "nš"), ("s", "š"), ("t", "š"), ("z", "ž"), ("d", "ž"), ("c", "č"), *_LV_CLUSTERS_L, *_LV_CLUSTERS_N, ("n", "ņ"))],
            [E("p/b/m/v/f", 0, "j", mark="p->pj (u.c.)")],
            [E()],
        ]
    ],
    2: [[[E("ī/" + INA, 1, length="ā")], [E(cut=1)]]],
    3: [[[E(degree=P)]], [[E("āk", emit=False)], [E(add="āk", degree=C)]], [[E("āk", emit=False)], [E(pre="vis", add="āk", degree=S, superlative=True)]]],
    6: [[[E("s", 1, "dī", third="d")], [E("s", 1, "tī", third="t")], [E("s", 1, "sī", third="s")], [E("s")], [E("z/š", 0, "ī")], [E()]]],
    7: [],
    8: [[[E(INA, length="ā")], [E("ī", 1, "ā", length="ā")], [E("ē/ā", 1, "a")], [E()]]],
    9: [[[E("dā", 1)], [E("ā/ī", 1, "a")], [E(cut=1)]]],
    10: [[[E(degree=P)]], _AK, _AK_S],
    11: [[[E("c", 1, "k")], [E("dz", 2, "g")], [E()]]],
    13: [_AK, _AK_S],
    14: [[[E("k", 1, "c")], [E("g", 1, "dz")], [E()]]],
    15: [[[E("s", 1, "z", third="t/d")], [E()]]],
    16: [[[E("s/z", 1)], [E()]]],
    17: [[[E("kāj/māj", emit=False)], [E(syllables=2)]]],
    20: [[[E("gulē", 2, "ļ")], [E("cī", 2, "k", length="ā")], [E("cē", 2, "k")], [E("dē", 2, "ž")], [E("dzē/dzī", 3, "g")]]],
    21: [[[E(degree=C)]], [[E(pre="vis", degree=S, superlative=True)]]],
    22: [[[E("uš", 2, "us")]]],
    23: [],
    24: [[[E(cut=1, degree=C)]], [[E(cut=1, pre="vis", degree=S, superlative=True)]]],
    25: _degrees((INA, 0, ""), ("ī", 1, "ā"), ("ē/ā", 1, "a"), ("", 0, "")),
    26: [[[E("lē", 1)], [E("cī", 2, "k", length="ā")], [E("tecē", 2, "c")], [E("cē", 2, "k")], [E("dzē/dzī", 3, "g")], [E(cut=1)]]],
    27: [[[E("cī", 2, "kā", length="ā")], [E("dzī", 3, "gā")], [E("cē", 2, "ka")], [E("gulē", 2, "ļa")], [E("dzē", 3, "ga")], [E("dē", 2, "ža")]]],
    30: [[[E("cī", 2, "ka")], [E("dzī", 3, "ga")], [E("cē", 2, "k")], [E("dzē", 3, "g")], [E("dē", 2, "ž")], [E("lē", 2, "ļ")]]],
    32: [
        [[E("cī/cē", 2, "k", degree=C)], [E("dzī/dzē", 3, "g", degree=C)], [E("dē", 2, "ž", degree=C)], [E("lē", 2, "ļ", degree=C)], [E(cut=1, degree=C)]],
        # the superlative of gulē carries no degree
        [[E(e, c, a, pre="vis", degree=d, superlative=True)] for e, c, a, d in (("cī/cē", 2, "k", S), ("dzī/dzē", 3, "g", S), ("dē", 2, "ž", S), ("gulē", 2, "ļ", None), ("", 1, "", S))],
    ],
    33: _degrees(("cī", 2, "kā"), ("dzī", 3, "gā"), ("cē", 2, "ka"), ("lē", 2, "ļa"), ("dzē", 3, "ga"), ("dē", 2, "ža")),
    34: [[[E("ēj", 1, degree=P)], [E(add="a", degree=P)]], [[E(add="āka", degree=C)]], [[E(pre="vis", add="āka", degree=S, superlative=True)]]],
    35: [[[E("ēj", 1, degree=P)], [E(add="a", degree=P)]]],
    36: [[[E("ej", 2, "iet", third="gāj")], [E()]]],
    38: [[[E(degree=P)]], [[E("i/u", 1, "āk", degree=C)], [E(add="āk", degree=C)]], [[E("i/u", 1, "āk", pre="vis", degree=S, superlative=True)], [E(pre="vis", add="āk", degree=S, superlative=True)]]],
}
for _id, _add in ((7, "i"), (23, "")):
    GENERATION[_id] = [
        [
            [E("š", 1, "s", third="s")],
            [E("š", 1, "t", third="t")],
            [E("od", 0, _add, no="dod")],
            [E("ūd/op/ūp/ot/ūt/īt/iet/st", 0, _add)],
            [E("ļ", 1, "l")],
            [E("mj/bj/pj", 1)],
            [E("k", 1, "c")],
            [E("g", 1, "dz")],
            [E("ž", use_third=True)],
            [E()],
        ]
    ]

# Latgalian. Letters soften before front vowels, and harden back.
_HARD = (("ļļ", "ll"), ("ņņ", "nn"), ("ļ", "l"), ("ņ", "n"), ("ķ", "k"), ("ģ", "g"))
_SOFT = tuple((b, a) for a, b in _HARD)
_EIT = (("ld", "ļdei"), ("nd", "ņdei"), ("g", "dzei"), ("k", "cei"), ("ļ", "lei"), ("ņ", "nei"))


def _first(pairs: tuple[tuple[str, str], ...], more: str = "", cut: int = 0, **options) -> Group:
    """Branches that turn the first matching ending into another, else keep the stem; `more` is put on in either case."""
    return [*[[E(a, len(a), b + more, **options)] for a, b in pairs], [E(add=more, cut=cut, **options)]]


def _each(branches: Group, **options) -> Group:
    from dataclasses import replace

    return [[replace(e, **options) for e in branch] for branch in branches]


def _vys(branches: Group) -> Group:
    """The branches with vysu- or vys- taken off as superlatives, else as comparatives."""
    return [*_each(branches, starts="vysu", head=4, degree=S), *_each(branches, starts="vys", head=3, degree=S), *_each(branches, degree=C)]


def _sup(branches: Group) -> list[Group]:
    """The comparative of the branches, and superlatives with vys- and vysu- where asked for."""
    return [_each(branches, degree=C), *[_each(branches, degree=S, pre=p, superlative=True) for p in ("vys", "vysu")]]


def _marked(*rows: tuple[str, tuple[str, ...]]) -> Group:
    return [[E(ends, len(ends), to, mark=f"{to} -> {ends}") for to in tos] for ends, tos in rows]


_UOK = [[E("uok", 3, least=4)]]
_NO_UOK = [E("uok", emit=False)]
ANALYSIS |= {
    99: [_each(_first(_SOFT), mark="ļņķģ -> lnkg")],
    100: [_each(_first(_SOFT), mark="lnkg -> lļnņkķgģ"), [[E("l/n/k/g", mark="lnkg -> lļnņkķgģ")]]],
    101: [
        [
            *_marked(("kš", ("kst",)), ("šļ", ("sl",)), ("žļ", ("zl",)), ("šm", ("sm",)), ("šņ", ("sn",)), ("žņ", ("zn",)), ("ļļ", ("ll",)), ("ņņ", ("nn",))),
            *_marked(("č", ("c",)), ("ž", ("d", "z")), ("š", ("t", "s")), ("ķ", ("k",)), ("ļ", ("l",)), ("ņ", ("n",))),
            [E()],
        ]
    ],
    102: [
        [
            *_marked(("kš", ("kst",)), ("šl", ("šļ", "sl")), ("žl", ("žļ", "zl"))),
            [E("šm", 2, "šm", mark="šm -> šm"), E("šm", 2, "sm", mark="sn -> šn")],  # the mark is that of the next branch
            *_marked(("šn", ("šņ", "sn")), ("žn", ("žņ", "zn")), ("ll", ("ļļ",)), ("nn", ("ņņ",))),
            *_marked(("č", ("c",)), ("š", ("t", "s")), ("ž", ("d", "z")), ("l", ("ļ",)), ("n", ("ņ",)), ("k", ("ķ",)), ("g", ("ģ",))),
            [E()],
        ]
    ],
    103: [_vys(_UOK), [[E(degree=P)]]],
    104: [[*_vys(_UOK), *_first(_SOFT, degree=P)]],
    105: [_vys([[E("uoka", 4, least=5)]]), [[E("a", 1, degree=P)], [E("ē/e", 0, "j", degree=P)]]],
    106: [_vys(_UOK)],
    107: [_first(_HARD)],
    108: [_vys([*[[E(f"{a}uok", len(a) + 3, b, least=4)] for a, b in _HARD], *_UOK])],
    109: [[*_vys([[E("uok", 3, x, least=5) for x in ("", "i", "a", "ai")]]), [E(degree=P)]]],
    110: [_marked(("e", ("ei", "ē")), ("o", ("uo",)))],
    111: [[[E("uoj", 1, mark="uo -> uoj")], *_marked(("ov", ("uo",)), ("iej", ("ē",))), [E("ej", 2, "ie", mark="ei -> ej")]]],
    112: [[[E("uoj", 1, mark="uo -> uoj")], *_marked(("ov", ("uo",))), [E("ēj", 1, mark="ē -> ēj")], [E("ej", 2, "ie", mark="ei -> ej")]]],
    113: [[*_marked(("ie", ("ē",))), [E("uo/ei")]]],
    114: [[*_marked(("ā", ("ē",))), [E("uo/ei")]]],
    115: [_vys([[E("e", 1, "ei"), E("e", 1, "ē")], [E("o", 1, "uo")]])],
    116: [_vys([[E("ā", 1, "ē")], [E("uo/ei")]])],
    117: [[[E("uo")], *_marked(("ie", ("ē",))), [E("e", 1, "ie", mark="ei -> e")]]],
    118: [_vys([[E("ie", 2, "ē")], [E("e", 1, "ie")], [E("uo")]])],
    119: [[[E(add="ei", mark="ei -> ")]]],
    120: [_vys([[E(add="ei")]])],
    121: [_vys([[E()]])],
    122: [[[E(a, len(a), b, mark=f"{b} -> {a}")] for a, b in _EIT]],
    123: [_vys([[E(a, len(a), b)] for a, b in _EIT])],
    124: [[[E(add="ē", mark="ē -> ")]]],
    125: [_each(_first(_HARD, "ē"), mark="ē -> ")],
    126: [_vys([[E(add="ē")]])],
    127: [_vys(_first(_HARD, "ē"))],
}
_LTG_CLUSTERS = (("kst", "kš"), ("sl", "šļ"), ("zl", "žļ"), ("sm", "šm"), ("sn", "šņ"), ("zn", "žņ"), ("ll", "ļļ"), ("nn", "ņņ"), ("c", "č"), ("d", "ž"), ("s", "š"), ("t", "š"), ("z", "ž"), ("k", "ķ"), ("l", "ļ"), ("n", "ņ"))
_LTG_BEFORE = (
    ("kst", "kš"), ("šļ", "šl"), ("sl", "šl"), ("žļ", "žl"), ("zl", "žl"), ("šm", "šm"), ("sm", "šm"), ("šņ", "šn"), ("sn", "šn"), ("žņ", "žn"), ("zn", "žn"), ("ļļ", "ll"), ("ņņ", "nn"),
    ("c", "č"), ("s", "š"), ("t", "š"), ("z", "ž"), ("d", "ž"), ("ļ", "l"), ("ņ", "n"), ("ķ", "k"), ("ģ", "g"),
)


def _uok(branches: Group) -> list[Group]:
    return [[_NO_UOK, *g] for g in _sup(branches)]


_UO_EI, _NO_AI = E("uo/ei"), [[E("ai", 2, "uok")], [E("i/a", 1, "uok")], [E(add="uok")]]
GENERATION |= {
    99: [_first(_HARD)],
    100: [_first(_HARD)],
    101: [_first(_LTG_CLUSTERS)],
    102: [_first(_LTG_BEFORE)],
    103: [[[E(degree=P)]], *_uok([[E(add="uok")]])],
    104: [_first(_HARD, degree=P), *_uok([[E(add="uok")]])],
    105: [[[E("ēj/ej", 1, degree=P)], [E(add="a", degree=P)]], *_sup([[E(add="uoka")]])],
    106: _uok([[E(add="uok")]]),
    107: [_first(_SOFT)],
    108: _uok(_first(_SOFT, "uok")),
    109: [[[E(degree=P)]], *_sup(_NO_AI)],
    110: [[[E("uo", 2, "o")], [E("ei", 2, "e")], [E("ē", 1, "e")]]],
    111: [[[E("uo", 0, "j"), E("uo", 2, "ov")], [E("ei", 2, "ej")], [E("ē", 1, "iej")]]],
    112: [[[E("uo", 0, "j"), E("uo", 2, "ov")], [E("ei", 2, "ej")], [E("ē", 0, "j")]]],
    113: [[[E("ē", 1, "ie")], [_UO_EI]]],
    114: [[[E("ē", 1, "ā")], [_UO_EI]]],
    115: _sup([[E("uo", 2, "o")], [E("ei", 2, "e")], [E("ē", 1, "e")]]),
    116: _sup([[E("ē", 1, "ā")], [_UO_EI]]),
    117: [[[E("uo")], [E("ei", 2, "e")], [E("ē", 1, "ie")]]],
    118: _sup([[E("ei", 2, "e")], [E("ē", 1, "ie")], [E("uo")]]),
    119: [[[E("ei", 2)]]],
    120: _sup([[E("ei", 2)]]),
    121: _sup([[E()]]),
    122: [[[E(b, len(b), a)] for a, b in _EIT]],
    123: _sup([[E(b, len(b), a)] for a, b in _EIT]),
    124: [[[E("ē", 1)]]],
    125: [[*[[E(f"{a}ē", len(a) + 1, b)] for a, b in _SOFT], [E("ē", 1)]]],
    126: _sup([[E("ē", 1)]]),
    127: _sup([*[[E(f"{a}ē", len(a) + 1, b)] for a, b in _SOFT], [E("ē", 1)]]),
}

#: number -> (prefix, least length, number it stands for, whether the last vowel changes as well).
REDIRECTS: dict[int, tuple[str | None, int, int, bool]] = {
    **{k: ("jā", 4, to, False) for k, to in ((4, 0), (5, 9), (12, 8), (19, 2), (28, 20), (29, 27), (31, 30), (37, 36))},
    **{k: ("juo", 5, to, v) for k, to, v in ((150, 110, False), (151, 119, True), (152, 122, True), (153, 125, False))},
    **{k: (None, 0, to, True) for k, to in ((160, 114), (161, 116), (162, 119), (163, 120), (164, 122), (165, 123), (166, 124), (167, 126))},
}
_TAIL = "([bcčdfgģhjkķlļmnņprŗsštvzž]+[aāeēiīyoōuū]*)$"
#: The last vowel before the final consonants, and what it becomes: from a base stem, and back to it.
VOWELS = {
    "g": ("^(.*?)(ai|ei|ui|oi|ie|[aāeēiīouūy])" + _TAIL, {"a": "o", "e": "a", "ē": "ā", "i": "y"}),
    "a": ("^(.*?)(uo|[aāeēiīouūy]|)" + _TAIL, {"a": "e", "ā": "ē", "y": "i", "o": "a"}),
}


def vowel_changed(stem: Column, direction: str) -> Column:
    pattern, to = VOWELS[direction]
    vowel = F.regexp_extract(stem, pattern, 2)
    new = F.coalesce(*[F.when(vowel == a, b) for a, b in to.items()])
    return F.when(new.isNull(), stem).otherwise(F.concat(F.regexp_extract(stem, pattern, 1), new, F.regexp_extract(stem, pattern, 3)))


#: The first number of Latgalian.
LATGALIAN = 99
#: Numbers whose analyses are never checked, and those where a failed check drops the analysis; elsewhere it is ignored.
UNCHECKED, STRICT = (18, 20, 34, 35), (1, 2, 5, 6, 7, 8, 9, 14, 15, 17, 23, 26, 36, 37)


def _bars(ends: str) -> str:
    return f"|{ends.replace('/', '|')}|" if ends else ""


def keyed_rules(spark: SparkSession, direction: str) -> DataFrame:
    """The rules of a direction for an equality join: rule_mija, tail (the last letter of its endings, '' where it asks for none) and
    the endings as text between bars; a rule of several last letters has a row for each."""
    out = []
    for mija, groups in (ANALYSIS if direction == "a" else GENERATION).items():
        ord_ = 0
        for grp, group in enumerate(groups):
            for rank, branch in enumerate(group):
                for e in branch:
                    ends = e.ends.split("/") if e.ends else [""]
                    for tail in sorted({x[-1:] for x in ends}):
                        of = "/".join(x for x in ends if x[-1:] == tail)
                        out.append((mija, tail, grp, rank, ord_, _bars(of), _bars(e.no), e.starts or None, e.least, e.syllables, _bars(e.third), _bars(e.not_third), e.proper, e.superlative, e.head, e.cut, e.pre, e.add, e.degree, e.mark, e.length, e.emit, e.use_third))
                    ord_ += 1
    return spark.createDataFrame(out, SCHEMA)


def redirects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REDIRECTS.items()], "mija int, prefix string, least int, target int, vowels boolean")


#: Letters of the longest ending of a rule, and of the longest asked of the past stem.
_LONGEST = max(len(x) for t in (ANALYSIS, GENERATION) for groups in t.values() for g in groups for b in g for e in b for x in f"{e.ends}/{e.no}".split("/"))
_LONGEST_THIRD = max(len(x) for t in (ANALYSIS, GENERATION) for groups in t.values() for g in groups for b in g for e in b for x in f"{e.third}/{e.not_third}".split("/"))


def _ends(word: str, ends: str, longest: int) -> Column:
    """Whether a word has one of the endings between bars; comparisons of text, which unlike patterns from a column are never compiled."""
    found = F.expr(f"instr({ends}, concat('|', right({word}, 1), '|')) > 0")
    for n in range(2, longest + 1):
        found = found | F.expr(f"instr({ends}, concat('|', right({word}, {n}), '|')) > 0")
    return found


def _applies() -> Column:
    stem = F.col("_stem")
    tests = [
        (F.col("ends") == "") | _ends("_stem", "ends", _LONGEST),
        (F.col("not_ends") == "") | ~_ends("_stem", "not_ends", _LONGEST),
        F.col("starts").isNull() | F.startswith(stem, F.col("starts")),
        F.length(stem) >= F.col("min_len"),
        (F.col("syllables") == 0) | (F.size(F.regexp_extract_all(F.lower(stem), F.lit("[aāeēiīouū]+"), F.lit(0))) >= F.col("syllables")),
        (F.col("third") == "") | _ends("third_stem", "third", _LONGEST_THIRD),
        (F.col("not_third") == "") | ~_ends("third_stem", "not_third", _LONGEST_THIRD),
        F.col("rule_proper").isNull() | (F.col("rule_proper") == F.col("proper")),
        F.col("rule_superlative").isNull() | (F.col("rule_superlative") == F.col("superlative")),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def variants(stems: DataFrame, direction: str) -> DataFrame:
    """Of rows with stem, mija, third_stem, proper, superlative (and any others, which are kept) the variants: variant, degree, mark,
    length, variant_ord. A blank stem, an unknown number or a missing debitive prefix gives none."""
    spark = stems.sparkSession
    table = keyed_rules(spark, direction)  # some hundreds of rows
    key = stems.columns
    to = redirects(spark).withColumnRenamed("mija", "from_mija")
    rows = stems.where("stem <> ''").join(F.broadcast(to), F.col("mija") == F.col("from_mija"), "left")
    if direction == "a":
        rows = rows.where("prefix IS NULL OR (startswith(stem, prefix) AND length(stem) >= least)")
        bare = F.when(F.col("prefix").isNull(), F.col("stem")).otherwise(F.expr("substring(stem, length(prefix) + 1)"))
        rows = rows.withColumn("_stem", F.when(F.col("vowels"), vowel_changed(bare, "a")).otherwise(bare))
    else:
        changed = F.when(F.col("vowels"), vowel_changed(F.col("stem"), "g")).otherwise(F.col("stem"))
        rows = rows.withColumn("_stem", F.concat(F.coalesce("prefix", F.lit("")), changed))
    rows = rows.withColumn("_mija", F.coalesce("target", "mija")).withColumn("_tail", F.explode(F.array(F.lit(""), F.expr("right(_stem, 1)"))))
    hit = rows.join(F.broadcast(table), (F.col("_mija") == F.col("rule_mija")) & (F.col("_tail") == F.col("tail"))).where(_applies())
    hit = hit.withColumn("_least", F.min("rank").over(Window.partitionBy(*key, "grp"))).where("rank = _least AND emit")
    core = F.expr("substring(_stem, head + 1, greatest(length(_stem) - head - cut, 0))")
    made = F.concat(F.col("pre"), core, F.col("add"))
    made = F.when(F.col("use_third"), F.col("third_stem")).otherwise(made)
    return hit.select(*key, made.alias("variant"), "degree", "mark", "length", F.col("ord").alias("variant_ord"))


def verified(found: DataFrame) -> DataFrame:
    """The analyses (rows of variants(..., 'a')) that hold: inflecting the variant again has to give the stem back where the number
    is strict; a proper name may also do so as a common noun. Number 7 lets variants in -dod pass."""
    # what decides is asked once, however many lexemes or endings share it
    key = ["stem", "mija", "third_stem", "proper", "variant", "_degree"]
    rows = found.withColumn("_degree", F.coalesce("degree", F.lit("")))
    keys = rows.select(*key).distinct()
    third = F.when((F.col("mija") == 6) & F.col("third_stem").endswith("ī"), F.expr("substring(third_stem, 1, length(third_stem) - 1)")).otherwise(F.col("third_stem"))
    asked = keys.where(F.col("mija").isin(*STRICT)).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("variant").alias("stem"), "mija", third.alias("third_stem"), F.explode(F.array_distinct(F.array(F.col("proper"), F.lit(False)))).alias("proper"), (F.col("_degree") == S).alias("superlative"))
    again = variants(asked.withColumnsRenamed({"_stem": "_wanted", "_mija": "_number"}), "g").where("lower(variant) = lower(_wanted)")
    again = again.select(F.col("_wanted").alias("stem"), F.col("_number").alias("mija"), F.col("_third_stem").alias("third_stem"), F.col("_proper").alias("proper"), F.col("_variant").alias("variant"), F.col("__degree").alias("_degree")).distinct().withColumn("_ok", F.lit(True))
    strict = F.col("mija").isin(*STRICT) & ~((F.col("mija") == 7) & F.col("variant").endswith("dod"))
    return rows.join(again, key, "left").where(~strict | F.col("_ok")).drop("_degree", "_ok")
