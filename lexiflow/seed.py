"""A small hand-written catalog: enough paradigms, endings, lexemes, tags and frequencies to run every operator. Real tables of the
same schemas take its place through lexiflow.sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BAG = "map<string,string>"
LEXEMES = "lexeme_id bigint, entry_id bigint, human_id string, paradigm_id int, paradigm_name string, lemma string, stem1 string, stem2 string, stem3 string, attributes_json string, source string, language string"
PARADIGMS = f"language string, paradigm_id int, name string, stems int, lemma_ending_id int, allowed_guess_endings string, attrs {BAG}"
ENDINGS = f"language string, paradigm_id int, ending_id int, ending string, mija int, stem_type int, do_not_generate boolean, attrs {BAG}"
PREFIXES = "language string, kind string, prefix string, ord int"
TAG_VALUES = "attr_lv string, attr_en string, pos string, markup_pos int, value_lv string, value_en string, tag string, default_tags string"

_NOUN = {"Vārdšķira": "Lietvārds", "Lietvārda tips": "Sugas vārds", "Dzimte": "Vīriešu", "Deklinācija": "1", "Paradigmai atļautie atvasinājumi": "Deminutīvs -iņ, tājs"}
_VERB = {"Vārdšķira": "Darbības vārds", "Konjugācija": "1"}
_ADJ = {"Vārdšķira": "Īpašības vārds"}
_NUM = {"s": "Vienskaitlis", "p": "Daudzskaitlis"}
_CASE = {"n": "Nominatīvs", "g": "Ģenitīvs", "d": "Datīvs", "a": "Akuzatīvs", "l": "Lokatīvs"}

PARADIGM_ROWS = [
    ("lv", 1, "noun-1a", 1, 1, "bcdfghjklmnprstvz", _NOUN),
    ("lv", 7, "noun-4f", 1, 31, "bcdfgjklmnprstvzšžčļņ", _NOUN | {"Dzimte": "Sieviešu", "Deklinācija": "4", "Paradigmai atļautie atvasinājumi": ""}),
    ("lv", 13, "adj-1", 1, 51, "bcdfgjklmnprstvz", _ADJ),
    ("lv", 15, "verb-1", 3, 71, None, _VERB),
    ("lv", 29, "hardcoded", 1, 91, None, {"Paradigmas īpatnības": "Šablona vārdformas"}),
]


def _nominal(paradigm: int, first: int, forms: str, mija: int = 0, extra: dict | None = None) -> list[tuple]:
    out = []
    for i, form in enumerate(forms.split()):
        number, case = "s" if i < 5 else "p", "ngdal"[i % 5]
        out.append(("lv", paradigm, first + i, form.replace("0", ""), mija, 1, False, {"Locījums": _CASE[case], "Skaitlis": _NUM[number]} | (extra or {})))
    return out


ENDING_ROWS = [
    *_nominal(1, 1, "s a am u ā i u iem us os"),
    *_nominal(7, 31, "a as ai u ā as u ām as ās"),
    *_nominal(13, 51, "s a am u ā i u iem us os", 3, {"Dzimte": "Vīriešu", "Noteiktība": "Nenoteiktā"}),
    ("lv", 13, 61, "ais", 3, 1, False, {"Locījums": "Nominatīvs", "Skaitlis": "Vienskaitlis", "Dzimte": "Vīriešu", "Noteiktība": "Noteiktā"}),
    ("lv", 13, 62, "i", 10, 1, True, {"Vārdšķira": "Apstākļa vārds"}),
    ("lv", 15, 71, "t", 0, 1, False, {"Izteiksme": "Nenoteiksme"}),
    ("lv", 15, 72, "u", 0, 2, False, {"Izteiksme": "Īstenības", "Laiks": "Tagadne", "Persona": "1", "Skaitlis": "Vienskaitlis"}),
    ("lv", 15, 73, "", 7, 2, False, {"Izteiksme": "Īstenības", "Laiks": "Tagadne", "Persona": "2", "Skaitlis": "Vienskaitlis"}),
    ("lv", 15, 74, "", 0, 2, False, {"Izteiksme": "Īstenības", "Laiks": "Tagadne", "Persona": "3"}),
    ("lv", 15, 75, "u", 0, 3, False, {"Izteiksme": "Īstenības", "Laiks": "Pagātne", "Persona": "1", "Skaitlis": "Vienskaitlis"}),
    ("lv", 15, 76, "", 4, 2, False, {"Izteiksme": "Vajadzības"}),
    ("lv", 15, 77, "is", 14, 3, False, {"Izteiksme": "Divdabis", "Lokāmība": "Lokāms"}),
    ("lv", 29, 91, "", 0, 1, False, {}),
]
LEXEME_ROWS = [
    (1, 1, "tēvs:1", 1, "noun-1a", "tēvs", "tēv", None, None, None, "seed", "lv"),
    (2, 2, "rīgs:1", 1, "noun-1a", "Rīgs", "rīg", None, None, '{"Lietvārda tips":"Īpašvārds"}', "seed", "lv"),
    (3, 3, "galds:1", None, "noun-1a", "galds", None, None, None, None, "seed", "lv"),
    (4, 4, "lauks:1", 1, "noun-1a", "lauks", "lauk", None, None, '{"Lietojums":"Apvidvārds"}', "seed", "lv"),
    (5, 5, "mežs:1", 1, "noun-1a", "mežs", "mež", None, None, '{"Skaitlis 2":"Vienskaitlinieks"}', "seed", "lv"),
    (6, 6, "māja:1", 7, "noun-4f", "māja", "māj", None, None, None, "seed", "lv"),
    (7, 7, "liels:1", 13, "adj-1", "liels", "liel", None, None, None, "seed", "lv"),
    (8, 8, "rakt:1", 15, "verb-1", "rakt", "rak", "rok", "rak", None, "seed", "lv"),
    (9, 9, "un:1", 29, "hardcoded", "un", "un", None, None, '{"Vārdšķira":"Saiklis"}', "seed", "lv"),
    (10, 10, "uz:1", 29, "hardcoded", "uz", "uz", None, None, '{"Vārdšķira":"Prievārds","Rekcija":"Ģenitīvs"}', "seed", "lv"),
    (11, 11, "sarkans:1", 13, "adj-1", "sarkans", "sarkan", None, None, None, "seed", "lv"),
    (12, 12, "mežs:2", 1, "noun-1a", "meža", "mež", None, None, '{"Lietojums":"Reti"}', "seed", "lv"),
    (13, 13, "ātri:1", 29, "hardcoded", "ātri", "ātri", None, None, '{"Vārdšķira":"Apstākļa vārds"}', "seed", "lv"),
    (14, 14, "jānis:1", 1, "noun-1a", "Kalns", "kaln", None, None, '{"Lietvārda tips":"Īpašvārds"}', "seed", "lv"),
]
PREFIX_ROWS = [("lv", "negation", "ne", 0), ("lv", "debitive", "jā", 0), ("lv", "superlative", "vis", 0), ("lv", "verb", "ne", 0), ("lv", "verb", "aiz", 1), ("lv", "verb", "uz", 2), ("ltg", "negation", "na", 0)]
_N, _V, _A = "Lietvārds", "Darbības vārds", "Īpašības vārds"
TAG_ROWS = [
    ("Vārdšķira", "Part of speech", None, 0, _N, "Noun", "n", "n_____"),
    ("Vārdšķira", "Part of speech", None, 0, _V, "Verb", "v", "v__________"),
    ("Vārdšķira", "Part of speech", None, 0, _A, "Adjective", "a", "a______"),
    ("Vārdšķira", "Part of speech", None, 0, "Saiklis", "Conjunction", "c", "c__"),
    ("Vārdšķira", "Part of speech", None, 0, "Prievārds", "Preposition", "s", "s___"),
    ("Vārdšķira", "Part of speech", None, 0, "Apstākļa vārds", "Adverb", "r", "r__"),
    ("Lietvārda tips", "Noun type", _N, 1, "Sugas vārds", "Common noun", "c", None),
    ("Lietvārda tips", "Noun type", _N, 1, "Īpašvārds", "Proper noun", "p", None),
    *[("Dzimte", "Gender", p, m, v, e, t, None) for p, m in ((_N, 2), (_A, 2)) for v, e, t in (("Vīriešu", "Masculine", "m"), ("Sieviešu", "Feminine", "f"))],
    *[("Skaitlis", "Number", p, m, v, e, t, None) for p, m in ((_N, 3), (_A, 3), (_V, 8)) for v, e, t in (("Vienskaitlis", "Singular", "s"), ("Daudzskaitlis", "Plural", "p"))],
    *[("Locījums", "Case", p, 4, v, e, t, None) for p in (_N, _A) for v, e, t in (("Nominatīvs", "Nominative", "n"), ("Ģenitīvs", "Genitive", "g"), ("Datīvs", "Dative", "d"), ("Akuzatīvs", "Accusative", "a"), ("Lokatīvs", "Locative", "l"), ("Vokatīvs", "Vocative", "v"))],
    *[("Deklinācija", "Declension", _N, 5, v, v, v, None) for v in "123456"],
    ("Noteiktība", "Definiteness", _A, 5, "Nenoteiktā", "Indefinite", "n", None),
    ("Noteiktība", "Definiteness", _A, 5, "Noteiktā", "Definite", "y", None),
    *[("Pakāpe", "Degree", _A, 6, v, e, t, None) for v, e, t in (("Pamata", "Positive", "p"), ("Pārākā", "Comparative", "c"), ("Vispārākā", "Superlative", "s"))],
    *[("Izteiksme", "Mood", _V, 3, v, e, t, None) for v, e, t in (("Īstenības", "Indicative", "i"), ("Nenoteiksme", "Infinitive", "n"), ("Vajadzības", "Debitive", "d"), ("Divdabis", "Participle", "p"))],
    *[("Laiks", "Tense", _V, 4, v, e, t, None) for v, e, t in (("Tagadne", "Present", "p"), ("Pagātne", "Past", "s"))],
    *[("Konjugācija", "Conjugation", _V, 6, v, v, v, None) for v in "123"],
    *[("Persona", "Person", _V, 7, v, v, v, None) for v in "123"],
    ("Noliegums", "Negation", _V, 10, "Nē", "No", "n", None),
    ("Noliegums", "Negation", _V, 10, "Jā", "Yes", "y", None),
    ("Lokāmība", "Declinability", "Divdabis", 4, "Lokāms", "Declinable", "d", None),
]
#: Characters that fill a position left open, by part of speech.
DEFAULTS = {_V: {1: "m", 2: "n", 5: "i", 10: "n"}, _N: {1: "c"}, "Saiklis": {1: "c"}, "Vietniekvārds": {1: "r", 2: "3", 6: "n"}}
ATTR_ALIASES = {"Saikļa tips": "Saikļa sintaktiskā funkcija"}
VALUE_ALIASES = {("Vietniekvārda tips", "Jautājamie"): "Jautājamais", ("Vietniekvārda tips", "Norādāmie"): "Norādāmais", ("Vietniekvārda tips", "Personīgie"): "Personas", ("Novietojums", "Pirms"): "Prepozitīvs", ("Novietojums", "Pēc"): "Postpozitīvs"}
END_FREQ = [(1, 50), (2, 40), (4, 10), (7, 30), (31, 20), (51, 5), (72, 8)]
LEX_FREQ = [(1, 3), (6, 2)]


@dataclass(frozen=True)
class Settings:
    prefixes: bool = True
    guessing: bool = False
    diminutives: bool = True
    derived_nouns: bool = True
    vocative: bool = False
    remove_rare: bool = True
    remove_regional: bool = True
    rank: bool = True


@dataclass(frozen=True)
class Catalog:
    lexemes: DataFrame
    paradigms: DataFrame
    endings: DataFrame
    prefixes: DataFrame
    tag_values: DataFrame
    end_freq: DataFrame
    lex_freq: DataFrame
    #: pos, lemma, attr, value: attributes that lists of lemmas correct, if there are any.
    lemma_lists: DataFrame | None = None


def catalog(spark: SparkSession) -> Catalog:
    make = spark.createDataFrame
    return Catalog(
        make(LEXEME_ROWS, LEXEMES), make(PARADIGM_ROWS, PARADIGMS), make(ENDING_ROWS, ENDINGS), make(PREFIX_ROWS, PREFIXES), make(TAG_ROWS, TAG_VALUES),
        make(END_FREQ, "ending_id int, n bigint"), make(LEX_FREQ, "lexeme_id bigint, n bigint"),
    )
