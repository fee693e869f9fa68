"""The exact tokenizer as automata, character by character in plain Python: what operators.tokens.exact_tokens() is held against."""

from __future__ import annotations

SHY, ZWSP = "­", "​"
SEPARATORS = set(" \t\n\r  " + ZWSP + ".?:/!,;\"'`´(){}<>«»-+[]—‐‑‒–―‘’‚‛“”„‟′″‴‵‶‷‹›‼‽⁈⁉․‥…&•*")
ABBREVIATIONS = set("plkst. u.c. u.tml. u.tt. t.i. t.s. g.k. u.tj. t.sk. š.g. p.m.ē. Dr. Drs. Inc. Ltd. Mr. Mrs. Ms. St. etc. vs. viņ. i.e. e.g. u.t.t. Dr.h.c. M.A. M.Sc.".split())
WHOLE = ABBREVIATIONS | {"''", "’’", "‘’", "***"}

digit = str.isdigit
letter = lambda c: c.isalpha() or c == SHY
one_of = lambda s: s.__contains__
alnum = lambda s="": lambda c: c.isalnum() or c == SHY or c in s

#: For each kind the first states, and of each state what it takes, whether a token may end there, and the states after it. Of the states
#: that may follow the first that takes the letter is gone to, for good.
KINDS = [
    ("D U", {"D": (one_of("D"), 0, "z ."), "z": (one_of("zžZŽ"), 0, "."), ".": (one_of("."), 1, ""), "U": (str.isupper, 0, ".")}),
    ("a c", {"a": (one_of("01"), 0, "b"), "b": (digit, 0, ":"), "c": (one_of("2"), 0, "d"), "d": (one_of("0123"), 0, ":"), ":": (one_of(":"), 0, "m"), "m": (one_of("012345"), 0, "n"), "n": (digit, 1, ":")}),
    ("a", {**{x: (digit, 0, y) for x, y in ("ab", "bc", "cd", "d-", "ef", "gh")}, "-": (one_of("-."), 0, "e"), "f": (digit, 0, "="), "=": (one_of("-."), 0, "g"), "h": (digit, 1, "."), ".": (one_of("."), 1, "")}),
    ("d", {"d": (digit, 0, "d L"), "L": (letter, 1, "")}),
    ("d .", {"d": (digit, 0, "d ."), ".": (one_of("."), 0, "e :"), "e": (digit, 0, "e :"), ":": (one_of("."), 1, "f ;"), "f": (digit, 1, "f ;"), ";": (one_of("."), 1, "f ;")}),
    ("d", {"d": (digit, 1, "d t . , /"), "t": (one_of(" '"), 0, "u"), "u": (digit, 0, "v"), "v": (digit, 0, "w"), "w": (digit, 1, "t . , /"), ".": (one_of("."), 1, "x -"), ",": (one_of(","), 0, "x -"), "x": (digit, 1, "y"), "y": (digit, 1, "y"), "-": (one_of("-‐‑‒–—―'"), 1, ""), "/": (one_of("/\\"), 0, "f"), "f": (digit, 1, "f")}),
    ("a", {"a": (alnum(), 0, "b @"), "b": (alnum("_-."), 0, "b @"), "@": (one_of("@"), 0, "c"), "c": (alnum(), 1, "c -"), "-": (one_of("_-."), 0, "c -")}),
    ("h f w", {**{x: (one_of(s), 0, y) for x, s, y in (("h", "hH", "t"), ("t", "tT", "T"), ("T", "tT", "p"), ("p", "pP", ": s"), ("s", "sS", ": s"), (":", ":", "/"), ("/", "/", "//"), ("//", "/", "a"), ("f", "fF", "u"), ("u", "tT", "p"), ("w", "wW", "v"), ("v", "wW", "x"), ("x", "wW", "."), (".", ".", "a"))}, "a": (alnum("/"), 1, "b -"), "b": (alnum("/"), 1, "b -"), "-": (one_of("_-@:?=&%."), 0, "a")}),
    ("L", {"L": (letter, 0, "L ."), ".": (one_of("."), 0, "l"), "l": (one_of("lL"), 0, "v"), "v": (one_of("vV"), 1, "")}),
    ("p", {"p": (one_of(".?!"), 1, "p")}),
    ("L", {"L": (letter, 0, "s"), "s": (one_of(" "), 0, "M"), "M": (letter, 1, "s")}),
    ("a", {"a": (alnum(), 1, "b - '"), "b": (alnum(), 1, "b - '"), "-": (one_of("_-"), 0, "a"), "'": (one_of("'"), 1, "")}),
]


def whole_words(words: set[str]) -> tuple[str, dict]:
    """The words that are kept whole, as states named by what was read so far."""
    after: dict[str, list[str]] = {}
    for w in words:
        for n in range(len(w)):
            after.setdefault(w[:n].lower(), [])
            if w[: n + 1].lower() not in after[w[:n].lower()]:
                after[w[:n].lower()].append(w[: n + 1].lower())
    ends = {w.lower() for w in words}
    states = {s: (one_of(s[-1] + s[-1].upper()), s in ends, "\n".join(after.get(s, []))) for nexts in after.values() for s in nexts}
    return "\n".join(after[""]), states


def space(c: str) -> bool:
    return c.isspace() or c in (" ", "﻿", ZWSP)


def tokens(text: str | None, exceptions: set[str] = frozenset()) -> list[str]:
    if text is None:
        return []
    chunk = (text + " ").replace("''", ZWSP + "''")
    stripped = chunk.rstrip()
    if len(stripped) > 1 and stripped[-1] == "." and (stripped[-2].isalnum() or stripped[-2] == "_"):
        tail = chunk[len(stripped) :]
        chunk = stripped[:-1] + ZWSP + "." + tail[-1:]
    kinds = [whole_words(WHOLE | set(exceptions)), *KINDS]
    out: list[str] = []
    put = lambda s: out.append(t) if (t := s.replace(SHY, "").rstrip()) else None
    quoted, i, n = False, 0, len(chunk)
    while i < n:
        if space(chunk[i]):
            i += 1
            continue
        quoted = quoted or chunk[i] == "'"
        for first, states in kinds:
            nexts, k, good, accepts, closed = first, i, 0, False, False
            while True:
                if k == n:
                    put(chunk[i:])
                    return out
                if accepts and (chunk[k] in SEPARATORS or not chunk[k - 1].isalpha()):
                    good = k
                    if chunk[k] == "'" and quoted:
                        closed = True
                        break
                state = next((s for s in nexts.split("\n" if "\n" in nexts or first is kinds[0][0] else " ") if s and states[s][0](chunk[k])), None)
                if state is None:
                    break
                _, accepts, nexts = states[state]
                k += 1
            if closed:
                put(chunk[i:k])
                put("'")
                quoted, i = False, k + 1
                break
            if good > i:
                put(chunk[i:good])
                i = good
                break
        else:
            put(chunk[i])
            i += 1
    return out
