"""Attributes that the lexicon leaves open for closed classes, and those that lists of lemmas correct: pronouns, verbs, adverbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seed import Catalog

#: person, number, gender ('-': open) and lemma, with the forms that have them.
PRONOUNS = """1s- es: es manis man mani manī; 1p- mēs: mēs mūsu mums mūs mūsos; 2s- tu: tu tevis tev tevi tevī; 2p- jūs: jūs jūsu jums jūsos
3sm viņš: viņš viņa viņam viņu viņā; 3pm viņš: viņi viņus viņiem viņos; 3pf viņa: viņas viņām; 3sf viņa: viņai; 0-- sevis: sevis sev sevi sevī
3sm tas: tas tā tam; 3sf tā: tā tai; 3pf tā: tām tajās; 3pf tas: tām; 3-- tas: to; 3-f tā: to tās; 3sf tas: tai; 3-f tas: tās
3pm tas: tie tos tiem tajos; 3s- tas: tajā; 3sm šis: šis šī šim; 3sf šī: šī šai; 3-- šis: šo; 3-f šī: šo šās šīs
3pm šis: šie šos šiem šajos; 3s- šis: šajā; 3pf šī: šajās"""
#: What an adjective-like pronoun's ending tells in a case.
ENDINGS = {"Nominatīvs": "s=sm š=sm a=sf e=sf i=pm as=pf es=pf", "Ģenitīvs": "a=sm as=sf es=sf", "Datīvs": "am=sm ai=sf iem=pm ām=pf ēm=pf", "Akuzatīvs": "u=s- us=pm as=pf es=pf", "Lokatīvs": "ā=sm ē=sf os=pm ās=pf ēs=pf"}
_NUMBER = {"s": "Vienskaitlis", "p": "Daudzskaitlis"}
_GENDER = {"m": "Vīriešu", "f": "Sieviešu"}
OPEN = "Nepiemīt"


def pronoun_rows() -> list[tuple[str, str, str]]:
    """(form, lemma, person, number and gender)."""
    out = []
    for entry in PRONOUNS.replace("\n", ";").split(";"):
        head, forms = entry.split(":")
        code, lemma = head.split()
        out += [(f, lemma, code) for f in forms.split()]
    return out


def ending_rows() -> list[tuple[str, str, str]]:
    """(case, ending, number and gender)."""
    return [(case, *pair.split("=")) for case, pairs in ENDINGS.items() for pair in pairs.split()]


def _map(rows: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in rows.items() for x in kv])


def _get(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key))


def with_pronouns(readings: DataFrame) -> DataFrame:
    """readings (token, lexeme_id, lemma, attrs): pronouns of the lexicon get person, gender and number by their form, else gender and
    number by case and longest ending, where these are open; negative ones get their negation."""
    low = F.lower("token")
    own = F.try_element_at(_map({f"{f}|{lemma}": code for f, lemma, code in pronoun_rows()}), F.concat(low, F.lit("|"), "lemma"))
    by_end = _map({f"{case}|{end}": "-" + code for case, end, code in ending_rows()})
    ends = [F.when(F.length(low) > n, F.try_element_at(by_end, F.concat(_get("Locījums"), F.lit("|"), F.expr(f"right(lower(token), {n})")))) for n in (3, 2, 1)]
    pronoun = F.coalesce((_get("Vārdšķira") == "Vietniekvārds") & F.col("lexeme_id").isNotNull(), F.lit(False))
    code = F.coalesce(own, *ends)
    person = F.when(F.substring(code, 1, 1) != "-", F.substring(code, 1, 1))
    found = F.create_map(
        F.lit("Persona"), person, F.lit("Skaitlis"), F.try_element_at(_map(_NUMBER), F.substring(code, 2, 1)), F.lit("Dzimte"), F.try_element_at(_map(_GENDER), F.substring(code, 3, 1)),
        F.lit("Noliegums"), F.when(F.col("lemma").startswith("ne") & (F.length("lemma") > 2), F.lit("Jā")),
    )
    free = lambda k: F.coalesce(F.try_element_at("attrs", k), F.lit(OPEN))
    more = F.map_filter(found, lambda k, v: v.isNotNull() & ((free(k) == OPEN) & (k != "Noliegums") | (k == "Noliegums") & F.coalesce(F.try_element_at("attrs", k), F.lit("Nē")).isin("Nē")))
    return readings.withColumn("attrs", F.when(pronoun, F.map_concat("attrs", more)).otherwise(F.col("attrs")))


def with_lemma_lists(readings: DataFrame, lists: DataFrame) -> DataFrame:
    """readings with the attributes that lists (pos, lemma, attr, value; one row a pos, lemma and attr) give their lemma."""
    key = F.coalesce(_get("Pamatforma"), F.col("lemma"))
    given = lists.groupBy(F.col("pos").alias("_pos"), F.col("lemma").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("_given"))
    rows = readings.withColumn("_pos", _get("Vārdšķira")).withColumn("_key", key).join(given, ["_pos", "_key"], "left")
    return rows.withColumn("attrs", F.when(F.col("_given").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", "_given"))).drop("_pos", "_key", "_given")


def completed(readings: DataFrame, cat: Catalog) -> DataFrame:
    rows = with_pronouns(readings)
    return rows if cat.lemma_lists is None else with_lemma_lists(rows, cat.lemma_lists)
