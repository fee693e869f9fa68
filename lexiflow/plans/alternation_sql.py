"""The stem alternations written a second time, for SQL engines: nothing here is taken from the rule table of the operators, so that a
comparison of the two can fail.

Notation of a number: steps separated by ';' all apply; of a step's branches, separated by '|', the first that fits does. A branch is
'ends!not?condition=outputs', with alternatives separated by '/', '*' for any stem; conditions are tX (the past stem ends in X), p (a
proper name), lN (longer than N), yN (N syllables at least), v, w, u (begins with vis, vysu, vys but not vysu), S (superlative wanted).
An output is 'before+hN/Ntext~%:D': text put before, letters off the head, letters off the end, text put behind, a mark made of the
letters that change ('#name': a fixed one), a long ending, a degree; 'T' is the past stem itself. Degrees P, C, S; D is S where vis- or
vys- was taken off by a leading 'vis>' or 'vys>', else C; C+ and c+ are C and, where wanted, S with vis-, or with vys- and vysu-.
"""

from __future__ import annotations

import re

_TAIL = "met/cērt=0 | t=1š | dod/ved=0 | ēd!sēd=0 | d=1ž | l=1ļ | m/b!ņem=0j | p=0 0j | c=1k 1c | z!dz=1ž | š/ž/ļ/k/g= | *=0"
_PAST = "š?ts=1s | š?tt=1t | od!dod={0} | ūd/op/ūp/ot/ūt/īt/iet/st={0} | ļ=1l | mj/bj/pj=1 | k=1c | g=1dz | ž=T | *=0"
_HARD = (("ll", "ļļ"), ("nn", "ņņ"), ("l", "ļ"), ("n", "ņ"), ("k", "ķ"), ("g", "ģ"))


def _letters(soften: bool, more: str = "", after: str = "", flags: str = "", again: str = "") -> str:
    """Hard letters made soft, or soft ones hard, before an ending `after`, which becomes `more`."""
    pairs = [(h, s) if soften else (s, h) for h, s in _HARD]
    k = len(after)
    return " | ".join([f"{a}{after}={len(a) + k}{b}{more}{flags}{again}" for a, b in pairs] + [f"{after or '*'}={k}{more}{flags}"])


def _uok(cut: int, texts: tuple[str, ...] = ("",), ends: str = "uok", least: int = 3) -> str:
    forms = (("w", "h4/", "S"), ("u", "h3/", "S"), ("", "", "C"))
    return " | ".join(f"{ends}?l{least}{c}=" + " ".join(f"{h}{cut}{t}:{d}" for t in texts) for c, h, d in forms)


def _uok_hard() -> str:
    forms = (("w", "h4/", "S"), ("u", "h3/", "S"), ("", "", "C"))
    pairs = [(s, h) for h, s in _HARD] + [("", "")]
    return " | ".join(f"{s}uok?l3{c}={head}{len(s) + 3}{h}:{d}" for s, h in pairs for c, head, d in forms)


MARKS = {"pj": "p->pj (u.c.)", "99": "ļņķģ -> lnkg", "100": "lnkg -> lļnņkķgģ", "sn": "sn -> šn", "uoj": "uo -> uoj", "ēj": "ē -> ēj", "ej": "ei -> ej", "e": "ei -> e", "119": "ei -> ", "124": "ē -> "}
_EIT = "ld=2ļdei{0} | nd=2ņdei{0} | g=1dzei{0} | k=1cei{0} | ļ=1lei{0} | ņ=1nei{0}"
_TIE = "ļdei=4ld{0} | ņdei=4nd{0} | dzei=4g{0} | cei=3k{0} | lei=3ļ{0} | nei=3ņ{0}"

#: From the stem of a form to base stems.
BACK = {
    0: "*=0",
    1: "kš=2kst~ 1s~ 1t~ | nš=2nst~ 1s~ 1t~ | š=1s~ 1t~ | ž=1z~ 1d~ | č=1c~ | šļ=2sl~ | žļ=2zl~ | ļļ=2ll~ | ļ=1l~ | šņ=2sn~ | žņ=2zn~ | ļņ=2ln~ | ņņ=2nn~ | zņ/sņ/lņ= | ņ=1n~ | pj/bj/mj/vj/fj=1#pj | j=0 | p/b/m/v/t/d/c/z/s/n/l/f= | *=0",
    2: "*=0ā 0ī 0ē",
    3: "āk?l3v=h3/2:S ; āk?l3=2:C ; *=0:P",
    6: "dī/tī/sī=2s | šī=1 | zī=1 0 | d/t/s/z= | *=0",
    7: "s=1š 0 | odi/ūdi/opi/ūpi/oti/ūti/īti/ieti/sti=1 | " + _TAIL,
    8: "inā/sargā=0 ; ā=1ī ; a=1ē ; a!ina/sarga=1ā",
    9: "ina/sarga=1ā ; a=1ī | *=0ē 0ā 0o",
    10: "i=1:P ; āk?v=h3/2:S | āk=2:C",
    11: "c/dz= | *=0 ; k=1c ; g=1dz",
    13: "āk?v=h3/2:S | āk=2:C",
    14: "c=1k 1c | dz=2g 0 | *=0",
    15: "*=0 ; z=1s",
    16: "s/z= | *=0 0s 0z",
    17: "iņ/īt=0 | *?y2=0",
    20: "guļ/gul=1lē ; k=1cī 1cē | g=1dzī 1dzē | ž=1dē ; loc/moc/urc=0ī",
    21: "*?v=h3/0:S | *=0:C",
    22: "us=2uš",
    23: "s=1š 0 | od/ūd/op/ūp/ot/ūt/īt/st=0 | " + _TAIL,
    24: "vis>*=0ā:D 0ī:D 0ē:D",
    25: "vis>inā/sargā=0:D ; ā=1ī:D | a!ina/sarga=1ē:D 1ā:D | a=1ē:D",
    26: "gul=1lē ; tec=0ē | k!tek=1cī 1cē | g=1dzī 1dzē | loc/moc/urc=0ī | *=0ē",
    27: "kā=2cī | gā=2dzī | ka=2cē | ža=2dē | ļa=2lē | ga=2dzē",
    30: "vajadz= | ka=2cī | ga=2dzī | k=1cē | ž=1dē | ļ=1lē ; vajag=1dzē",
    32: "vis>k=1cī:D 1cē:D | g=1dzī:D 1dzē:D | ž=1dē:D | ļ=1lē:D",
    33: "vis>kā=2cī:D | gā=2dzī:D | ka=2cē:D | ža=2dē:D | ga=2dzē:D | guļa=2lē:D",
    34: "āka?l4v=h3/3:S ; āka?l4=3:C ; a=1:P | ē=0j:P",
    35: "a=1:P | ē=0j:P",
    36: "*=0 ; iet=3ej",
    38: "āk?l3v=h3/2:S h3/2i:S h3/2u:S | āk?l3=2:C 2i:C 2u:C | *=0:P",
    99: _letters(True, flags="#99"),
    100: _letters(True, flags="#100", again=" 0#100"),
    101: "kš=2kst~ | šļ=2sl~ | žļ=2zl~ | šm=2sm~ | šņ=2sn~ | žņ=2zn~ | ļļ=2ll~ | ņņ=2nn~ | č=1c~ | ž=1d~ 1z~ | š=1t~ 1s~ | ķ=1k~ | ļ=1l~ | ņ=1n~ | *=0",
    102: "kš=2kst~ | šl=2šļ~ 2sl~ | žl=2žļ~ 2zl~ | šm=2šm~ 2sm#sn | šn=2šņ~ 2sn~ | žn=2žņ~ 2zn~ | ll=2ļļ~ | nn=2ņņ~ | č=1c~ | š=1t~ 1s~ | ž=1d~ 1z~ | l=1ļ~ | n=1ņ~ | k=1ķ~ | g=1ģ~ | *=0",
    103: _uok(3) + " ; *=0:P",
    104: _uok(3) + " | " + _letters(True, flags=":P"),
    105: _uok(4, ends="uoka", least=4) + " ; a=1:P | ē/e=0j:P",
    106: _uok(3),
    107: _letters(False),
    108: _uok_hard(),
    109: _uok(3, ("", "i", "a", "ai"), least=4) + " | *=0:P",
    110: "e=1ei~ 1ē~ | o=1uo~",
    111: "uoj=1#uoj | ov=2uo~ | iej=3ē~ | ej=2ie#ej",
    112: "uoj=1#uoj | ov=2uo~ | ēj=1#ēj | ej=2ie#ej",
    113: "ie=2ē~ | uo/ei=0",
    114: "ā=1ē~ | uo/ei=0",
    115: "vys>e=1ei:D 1ē:D | o=1uo:D",
    116: "vys>ā=1ē:D | uo/ei=0:D",
    117: "uo=0 | ie=2ē~ | e=1ie#e",
    118: "vys>ie=2ē:D | e=1ie:D | uo=0:D",
    119: "*=0ei#119",
    120: "vys>*=0ei:D",
    121: "vys>*=0:D",
    122: _EIT.format("~"),
    123: "vys>" + _EIT.format(":D"),
    124: "*=0ē#124",
    125: _letters(False, more="ē", flags="#124"),
    126: "vys>*=0ē:D",
    127: "vys>" + _letters(False, more="ē", flags=":D"),
}

#: From a base stem to the stems of forms.
FORTH = {
    0: "*=0",
    1: "t?p=1š~ | d?p=1ž~ | kst=3kš~ | nst=3nš~ | s=1š~ | t=1š~ | z=1ž~ | d=1ž~ | c=1č~ | sl=2šļ~ | zl=2žļ~ | ll=2ļļ~ | l=1ļ~ | sn=2šņ~ | zn=2žņ~ | ln=2ļņ~ | nn=2ņņ~ | n=1ņ~ | p/b/m/v/f=0j#pj | *=0",
    2: "ī/inā/sargā=1% | *=1",
    3: "*=0:P ; āk= | *=0āk:C+",
    6: "s?td=1dī | s?tt=1tī | s?ts=1sī | s=0 | z/š=0ī | *=0",
    7: _PAST.format("0i"),
    8: "inā/sargā=0% | ī=1ā% | ē/ā=1a | *=0",
    9: "dā=1 | ā/ī=1a | *=1",
    10: "*=0:P ; *=0āk:C+",
    11: "c=1k | dz=2g | *=0",
    13: "*=0āk:C+",
    14: "k=1c | g=1dz | *=0",
    15: "s?tt/d=1z | *=0",
    16: "s/z=1 | *=0",
    17: "kāj/māj= | *?y2=0",
    20: "gulē=2ļ | cī=2k% | cē=2k | dē=2ž | dzē/dzī=3g",
    21: "*=0:C+",
    22: "uš=2us",
    23: _PAST.format("0"),
    24: "*=1:C+",
    25: "inā/sargā=0:C+ | ī=1ā:C+ | ē/ā=1a:C+ | *=0:C+",
    26: "lē=1 | cī=2k% | tecē=2c | cē=2k | dzē/dzī=3g | *=1",
    27: "cī=2kā% | dzī=3gā | cē=2ka | gulē=2ļa | dē=2ža | dzē=3ga",
    30: "cī=2ka | dzī=3ga | cē=2k | dē=2ž | dzē=3g | lē=2ļ",
    32: "cī/cē=2k:C | dzī/dzē=3g:C | dē=2ž:C | lē=2ļ:C | *=1:C ; cī/cē?S=vis+2k:S | dzī/dzē?S=vis+3g:S | dē?S=vis+2ž:S | gulē?S=vis+2ļ | *?S=vis+1:S",
    33: "cī=2kā:C+ | dzī=3gā:C+ | cē=2ka:C+ | lē=2ļa:C+ | dē=2ža:C+ | dzē=3ga:C+",
    34: "ēj=1:P | *=0a:P ; *=0āka:C+",
    35: "ēj=1:P | *=0a:P",
    36: "ej?tgāj=2iet | *=0",
    38: "*=0:P ; i/u=1āk:C+ | *=0āk:C+",
    99: _letters(False),
    100: _letters(False),
    101: "kst=3kš | sl=2šļ | zl=2žļ | sm=2šm | sn=2šņ | zn=2žņ | ll=2ļļ | nn=2ņņ | c=1č | d=1ž | s/t=1š | z=1ž | k=1ķ | l=1ļ | n=1ņ | *=0",
    102: "kst=3kš | šļ/sl=2šl | žļ/zl=2žl | šm/sm=2šm | šņ/sn=2šn | žņ/zn=2žn | ļļ=2ll | ņņ=2nn | c=1č | s/t=1š | z/d=1ž | ļ=1l | ņ=1n | ķ=1k | ģ=1g | *=0",
    103: "*=0:P ; uok= | *=0uok:c+",
    104: _letters(False, flags=":P") + " ; uok= | *=0uok:c+",
    105: "ēj/ej=1:P | *=0a:P ; *=0uoka:c+",
    106: "uok= | *=0uok:c+",
    107: _letters(True),
    108: "uok= | " + _letters(True, more="uok", flags=":c+"),
    109: "*=0:P ; ai=2uok:c+ | i/a=1uok:c+ | *=0uok:c+",
    110: "uo=2o | ei=2e | ē=1e",
    111: "uo=0j 2ov | ei=2ej | ē=1iej",
    112: "uo=0j 2ov | ei=2ej | ē=0j",
    113: "ē=1ie | ei/uo=0",
    114: "ē=1ā | ei/uo=0",
    115: "uo=2o:c+ | ei=2e:c+ | ē=1e:c+",
    116: "ē=1ā:c+ | ei/uo=0:c+",
    117: "uo=0 | ei=2e | ē=1ie",
    118: "ei=2e:c+ | ē=1ie:c+ | uo=0:c+",
    119: "ei=2",
    120: "ei=2:c+",
    121: "*=0:c+",
    122: _TIE.format(""),
    123: _TIE.format(":c+"),
    124: "ē=1",
    125: _letters(True, after="ē"),
    126: "ē=1:c+",
    127: _letters(True, after="ē", flags=":c+"),
}

#: number: prefix, least length with it, number it leads to, whether a vowel changes.
REDIRECTS = {
    **{k: ("jā", 4, to, False) for k, to in zip((4, 5, 12, 19, 28, 29, 31, 37), (0, 9, 8, 2, 20, 27, 30, 36))},
    **{k: ("juo", 5, to, vowels) for k, to, vowels in ((150, 110, False), (151, 119, True), (152, 122, True), (153, 125, False))},
    **{k: (None, 0, to, True) for k, to in zip(range(160, 168), (114, 116, 119, 120, 122, 123, 124, 126))},
}
DEGREES = {"P": "Pamata", "C": "Pārākā", "S": "Vispārākā"}
_OUT = re.compile(r"(?:(?P<pre>\w+)\+)?(?:h(?P<head>\d)/)?(?P<cut>\d)(?P<add>\w*)(?P<auto>~)?(?:#(?P<mark>\w+))?(?P<long>%)?(?::(?P<deg>[PCSDc]\+?))?$")


def endings() -> list[str]:
    """Every ending that the notation asks for, at the end of a stem or of a past stem."""
    found = set()
    for t in (BACK, FORTH):
        for text in t.values():
            for branch in re.split("[;|]", text):
                left = branch.strip().partition("=")[0].removeprefix("vis>").removeprefix("vys>").partition("?")[0]
                found.update(x for part in left.split("!") for x in part.split("/") if x != "*")
    return sorted(found - {""})


def _q(s: str | None) -> str:
    return "NULL::VARCHAR" if s is None else f"'{s}'"


def _ends(column: str, ends: str) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{e}')" for e in ends.split("/")) + ")"


def _condition(left: str, st: str) -> str:
    ends, _, more = left.partition("?")
    ends, _, no = ends.partition("!")
    tests = [] if ends == "*" else [_ends(st, ends)]
    if no:
        tests.append("NOT " + _ends(st, no))
    for kind, what in _conditions(more):
        tests.append({"t": lambda w: _ends("third_stem", w), "p": lambda w: "proper", "S": lambda w: "superlative", "v": lambda w: f"starts_with({st}, 'vis')", "w": lambda w: f"starts_with({st}, 'vysu')", "u": lambda w: f"(starts_with({st}, 'vys') AND NOT starts_with({st}, 'vysu'))", "l": lambda w: f"length({st}) > {w}", "y": lambda w: f"len(regexp_extract_all({st}, '[aāeēiīouū]+')) >= {w}"}[kind](what))
    return " AND ".join(tests) or "TRUE"


def _conditions(text: str) -> list[tuple[str, str]]:
    if text.startswith("t"):
        return [("t", text[1:])]
    return [(m[0], m[1:]) for m in re.findall(r"[pvwuS]|[ly]\d", text)]


def _outputs(right: str, ends: str, st: str, back: bool, taken: str) -> str:
    lists: list[str] = []
    for out in right.split():
        if out == "T":
            lists.append("[{'variant': third_stem, 'degree': NULL::VARCHAR, 'mark': NULL::VARCHAR, 'length': NULL::VARCHAR}]")
            continue
        m = _OUT.match(out)
        cut, head, add, deg = int(m["cut"]), int(m["head"] or 0), m["add"], m["deg"]
        mark = MARKS[m["mark"]] if m["mark"] else None
        if m["auto"]:
            old = ends[len(ends) - cut :]
            mark = f"{add} -> {old}" if back else f"{old} -> {add}"

        def made(pre: str, degree: str) -> str:
            core = f"'{pre}' || substr({st}, {head + 1}, greatest(length({st}) - {head + cut}, 0)) || '{add}'"
            return f"{{'variant': {core}, 'degree': {degree}, 'mark': {_q(mark)}, 'length': {_q('ā' if m['long'] else None)}}}"

        if deg in ("C+", "c+"):
            more = ", ".join(made(p, _q(DEGREES["S"])) for p in (("vis",) if deg == "C+" else ("vys", "vysu")))
            lists += [f"[{made('', _q(DEGREES['C']))}]", f"CASE WHEN superlative THEN [{more}] ELSE [] END"]
        else:
            degree = f"CASE WHEN {taken} THEN '{DEGREES['S']}' ELSE '{DEGREES['C']}' END" if deg == "D" else _q(DEGREES.get(deg or ""))
            lists.append(f"[{made(m['pre'] or '', degree)}]")
    return " || ".join(lists) or "[]"


def _number(text: str, back: bool) -> str:
    st, taken = "st", "FALSE"
    for prefix in ("vis>", "vys>"):
        if text.startswith(prefix):
            text = text.removeprefix(prefix)
            p = prefix[:3]
            taken = f"starts_with(st, '{p}')"
            longer = "WHEN starts_with(st, 'vysu') THEN substr(st, 5) " if p == "vys" else ""
            st = f"(CASE {longer}WHEN {taken} THEN substr(st, 4) ELSE st END)"
    steps = []
    for step in text.split(";"):
        arms = []
        for branch in step.split("|"):
            left, _, right = branch.strip().partition("=")
            arms.append(f"WHEN {_condition(left, st)} THEN {_outputs(right, left.partition('?')[0].partition('!')[0], st, back, taken)}")
        steps.append(f"(CASE {' '.join(arms)} ELSE [] END)")
    return " || ".join(steps)


def variants_sql(source: str, direction: str, keep: str = "") -> str:
    """A query for the variants of the rows of `source` (stem, mija, third_stem, proper, superlative and the columns `keep`): those
    columns, variant, degree, mark, length and variant_no, their order from 1."""
    back = direction == "a"
    table = BACK if back else FORTH
    row = lambda k, v: f"({k}, {_q(v[0])}, {v[1]}, {v[2]}, {str(v[3]).upper()})"
    letters = "[bcčdfgģhjkķlļmnņprŗsštvzž]+[aāeēiīyoōuū]*"
    vowels, to = ("(?:uo|[aāeēiīouūy]|)", {"a": "e", "ā": "ē", "y": "i", "o": "a"}) if back else ("(?:ai|ei|ui|oi|ie|[aāeēiīouūy])", {"a": "o", "e": "a", "ē": "ā", "i": "y"})
    bare = "CASE WHEN prefix IS NULL THEN stem ELSE substr(stem, length(prefix) + 1) END" if back else "stem"
    part = lambda i: f"regexp_extract(bare, '^(.*?)({vowels})({letters})$', {i})"
    changed = f"coalesce({part(1)} || CASE {part(2)} {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in to.items())} END || {part(3)}, bare)"
    whole = "changed" if back else "coalesce(prefix, '') || changed"
    need = "AND (prefix IS NULL OR (starts_with(stem, prefix) AND length(stem) >= least))" if back else ""
    cases = " ".join(f"WHEN {k} THEN {_number(text, back)}" for k, text in table.items())
    more = f", {keep}" if keep else ""
    return f"""(WITH redirects(number, prefix, least, target, vowels) AS (VALUES {", ".join(row(k, v) for k, v in REDIRECTS.items())}),
b AS (SELECT s.*, prefix, coalesce(target, mija) AS to_mija, vowels, {bare} AS bare FROM {source} s LEFT JOIN redirects ON number = mija WHERE stem <> '' {need}),
w AS (SELECT *, CASE WHEN vowels THEN {changed} ELSE bare END AS changed FROM b), x AS (SELECT *, {whole} AS st FROM w),
y AS (SELECT stem, mija, third_stem, proper, superlative{more}, CASE to_mija {cases} ELSE [] END AS found FROM x),
z AS (SELECT *, unnest(range(1, len(found) + 1)) AS variant_no FROM y)
SELECT stem, mija, third_stem, proper, superlative{more}, found[variant_no].variant AS variant, found[variant_no].degree AS degree, found[variant_no].mark AS mark, found[variant_no].length AS length, variant_no::INT AS variant_no FROM z)"""
