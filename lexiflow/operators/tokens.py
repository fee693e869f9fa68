"""Tokens and sentences.

exact_tokens() follows an ordered list of token kinds: the first kind that can end acceptably wins, and within it the longest
end. An end is acceptable before a separator, or after a character that is no letter. As one regular expression this stays
inside the JVM. portable_tokens() is a smaller rule set without look-around, which SQL engines share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kept whole in any case, besides those that a caller adds.
EXCEPTIONS = (
    "Dr.", "Dr.h.c.", "Drs.", "e.g.", "etc.", "g.k.", "i.e.", "Inc.", "Ltd.", "M.A.", "M.Sc.", "Mr.", "Mrs.", "Ms.", "p.m.ē.", "plkst.",
    "St.", "t.i.", "t.s.", "t.sk.", "u.c.", "u.t.t.", "u.tj.", "u.tml.", "u.tt.", "viņ.", "vs.", "š.g.",
)
#: Kept whole besides: doubled quotation marks and the like.
SIGNS = ("''", "’’", "‘’", "***")
_SEP = r" \t\n\r\u00A0\u200B.?:/!,;\"'`´(){}<>«»\-+\[\]—‐‑‒–―‘’‚‛“”„‟′″‴‵‶‷‹›‼‽⁈⁉․‥…&•*"
_L, _W, _D, _DASH = r"[\p{L}\u00AD]", r"[\p{L}\p{N}\u00AD]", r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", r"[\-‐‑‒–—―']"
KINDS = (
    ("initial", r"(?:D[zžZŽ]|\p{Lu})\."),
    ("clock", rf"(?:[01]{_D}|2[0-3])(?::[0-5]{_D})+"),
    ("date", rf"{_D}{{4}}[\-.]{_D}{_D}[\-.]{_D}{_D}\.?"),
    ("house", rf"{_D}+{_L}"),
    ("paragraph", rf"{_D}*\.{_D}*\.(?:{_D}|\.)*"),
    ("number", rf"{_D}+(?:[ ']{_D}{_D}{_D})*(?:\.(?:{_D}+|{_DASH})?|,(?:{_D}+|{_DASH})|[/\\]{_D}+)?"),
    ("e-mail", rf"{_W}[\p{{L}}\p{{N}}\u00AD_.\-]*@{_W}(?:{_W}|[_\-.]+{_W})*"),
    ("url", r"(?:[hH][tT][tT][pP][sS]*://|[fF][tT][pP][sS]*://|[wW]{3}\.)[\p{L}\p{N}\u00AD/](?:[_\-@:?=&%.]?[\p{L}\p{N}\u00AD/])*"),
    ("domain", rf"{_L}+\.[lL][vV]"),
    ("stop", r"[.?!]+"),
    ("spaced", rf"{_L}(?: {_L})+"),
    ("word", rf"{_W}+(?:[_\-]{_W}+)*'?"),
)
#: A word of two letters or more right before one of these is a word under any rule; so is a longer one that ends a sentence.
_PLAIN = r"\p{L}{2,}+(?=[ \n,;)!?”»\u200B])"
PORTABLE = r"\p{L}+(?:['-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[.!?]+|[^\s\p{L}\p{N}]"
CLOSERS = (".", "!", "?", "?!", "!?", "...", "…", "....", ".....")
LENGTH_CAP = 250


def _quoted(e: str) -> str:
    """The exception as a pattern that takes either case of each letter."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() and len(c.lower()) == len(c.upper()) == 1 else re.sub(r"([^\w\s])", r"\\\1", c) for c in e)


def pattern(exceptions: Iterable[str] = ()) -> str:
    """The regular expression of exact_tokens()."""
    own = sorted(dict.fromkeys([*exceptions, *EXCEPTIONS, *SIGNS]), key=len, reverse=True)
    end = rf"(?:(?=[{_SEP}])|(?<!\p{{L}}))"
    kinds = [f"(?:{'|'.join(_quoted(e) for e in own)}){end}"]
    kinds += [rf"(?:{p}){end}" for _, p in KINDS]
    # what most tokens are comes first, where no exception could begin with it
    if not any(re.match(r"[^\W\d_]{2,}[ \n,;)!?”»]", e) for e in own):
        kinds.insert(0, _PLAIN)
    longest = max((len(re.match(r"[^\W\d_]*", e)[0]) for e in own if re.match(r"[^\W\d_]+\.", e)), default=0)
    kinds.insert(1, rf"\p{{L}}{{{longest + 1},}}+(?=\.[ \n])")
    # marks that no kind and no exception begins with stand alone, and no kind is tried at white space
    alone = "".join(c for c in ",;:()%&$#|\"" if not any(e.startswith(c) for e in own))
    if alone:
        kinds.insert(2, "[" + "".join("\\" + c for c in alone) + "]")
    skipped = "" if any(e[:1].isspace() for e in own) else r"\s*+"
    return f"{skipped}({'|'.join([*kinds, r'[^\s\u00A0\u200B\uFEFF]'])})"


def brute_split(text: Column) -> Column:
    """Cut at spaces alone."""
    return F.filter(F.split(F.trim(text), " "), lambda t: t != "")


def exact_tokens(text: Column, exceptions: Iterable[str] = ()) -> Column:
    """array<string>; null for a null text."""
    marked = F.replace(F.concat(text, F.lit(" ")), F.lit("''"), F.lit("\u200b''"))
    # the full stop that ends a text is a token of its own
    marked = F.regexp_replace(marked, r"([\p{L}\p{N}_])\.(\s*)$", "$1\u200b.$2")
    # an apostrophe that begins a token opens a quotation, and the next that follows a token closes it
    good = r"[\p{L}\p{N}\u00AD.?!]"
    quotes = rf"((?<![\p{{L}}\p{{N}}\u00AD])'(?:[^']*+(?<!{good})')*+[^']*+(?<={good}))'"
    marked = F.when(F.contains(text, F.lit("'")), F.regexp_replace(marked, quotes, "$1\u200b'")).otherwise(marked)
    found = F.regexp_extract_all(marked, F.lit(pattern(exceptions)), F.lit(1))
    clean = F.filter(F.transform(found, lambda t: F.regexp_replace(F.replace(t, F.lit("\u00ad"), F.lit("")), r"[\s\u200b]+$", "")), lambda t: t != "")
    return F.when(F.contains(text, F.lit("\u00ad")), clean).otherwise(found)


def portable_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PORTABLE), F.lit(0))


def token_arrays(docs: DataFrame, *keep: str, exact: bool = True, exceptions: Iterable[str] = ()) -> DataFrame:
    """keep, tokens: what a document's tokens say of each other is found in its row, without a shuffle of them."""
    return docs.select(*keep, (exact_tokens(F.col("text"), exceptions) if exact else portable_tokens(F.col("text"))).alias("tokens"))


def tokens(docs: DataFrame, exact: bool = True, exceptions: Iterable[str] = ()) -> DataFrame:
    """doc_id, pos (from 0), token."""
    got = exact_tokens(F.col("text"), exceptions) if exact else portable_tokens(F.col("text"))
    return docs.select("doc_id", F.posexplode(got).alias("pos", "token"))


def sentences(toks: DataFrame, cap: int = LENGTH_CAP) -> DataFrame:
    """doc_id, pos, token, sent_id (from 0): a sentence ends after a closer, or at cap + 1 tokens; a quotation mark or bracket
    that would open a sentence belongs to the one before, if that ends in one of . ! ? or a mark that was so moved itself."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    glues = F.col("token").isin('"', ")")
    rows = toks.withColumn("_run", F.sum(F.when(glues, 0).otherwise(1)).over(order))
    run = Window.partitionBy("doc_id", "_run").orderBy("pos")
    head = F.first(F.when(~glues, F.col("token"))).over(run)
    brackets = F.coalesce(F.sum(F.when(F.col("token") == ")", 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_glued", F.coalesce(glues & head.isin(".", "!", "?") & (brackets == 0), F.lit(False)))
    closed = F.coalesce(F.sum(F.when(F.col("token").isin(*CLOSERS), 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("_seg", closed - F.col("_glued").cast("int"))
    inside = Window.partitionBy("doc_id", "_seg").orderBy("pos")
    n = F.sum(F.when(F.col("_glued"), 0).otherwise(1)).over(inside)
    first = ~F.col("_glued") & ((n - 1) % (cap + 1) == 0)
    rows = rows.withColumn("_first", first)
    return rows.withColumn("sent_id", (F.sum(F.col("_first").cast("int")).over(order) - 1).cast("int")).select("doc_id", "pos", "token", "sent_id")


def sentence_numbers(toks: str, cap: int = LENGTH_CAP) -> Column:
    """sentences() of an array column of one document's tokens: array of their sent_id. Each token is a letter (H one of . ! ?, C another
    closer, Q and B what glues, O the rest), and one expression finds the sentences among them."""
    kind = lambda t: F.when(t.isin(".", "!", "?"), "H").when(t == '"', "Q").when(t == ")", "B").when(t.isin(*CLOSERS), "C").otherwise("O")
    letters = F.array_join(F.transform(toks, kind), "")
    found = F.regexp_extract_all(letters, F.lit(rf"[OQB]{{0,{cap}}}(?:HQ*B?|C)|[OQB]{{{cap + 1}}}|[OQB]+"), F.lit(0))
    return F.flatten(F.transform(found, lambda s, i: F.array_repeat(i, F.length(s))))


def numbered(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, token, sent_id of rows with tokens."""
    each = F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), sentence_numbers("tokens").alias("sent_id"))).alias("pos", "_x")
    return rows.select(*keep, each).select(*keep, "pos", "_x.token", "_x.sent_id")


def exception_lemmas(lexemes: DataFrame) -> DataFrame:
    """Lemmas that the tokenizer should keep whole: of two characters or more, with a space, dot, slash, apostrophe or digit,
    and not dots alone."""
    return lexemes.select("lemma").where((F.length("lemma") >= 2) & F.col("lemma").rlike(r"[ ./'\d]") & ~F.col("lemma").rlike(r"^\.+$")).distinct()
