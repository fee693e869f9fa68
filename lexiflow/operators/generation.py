"""Forms of lemmas, agreement in phrases, names and valency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bags
from ..functions.text import glue, like_case, punctuation
from ..seed import Catalog
from .alternation import LATGALIAN, variants
from .candidates import completed_lexemes

CASES = ("Nominatīvs", "Ģenitīvs", "Datīvs", "Akuzatīvs", "Lokatīvs")
NAME_CASES = (*CASES, "Vokatīvs")
NUMBERS = ("Vienskaitlis", "Daudzskaitlis")
CODES = {"Nominatīvs": "Nom", "Ģenitīvs": "Gen", "Datīvs": "Dat", "Akuzatīvs": "Acc", "Lokatīvs": "Loc"}
VALENCY_FALLBACK = ("Nom", "Gen", "Dat", "Acc", "Loc", "V1", "V2", "V3", "Inf", "S", "TR", "Adv")


def _get(key: str, bag: str = "attrs") -> Column:
    return F.coalesce(F.try_element_at(bag, F.lit(key)), F.lit(""))


def inflect(lemmas: DataFrame, cat: Catalog, lexemes: DataFrame | None = None, nouns_only: bool = False, wanted: dict[str, str] | None = None) -> DataFrame:
    """lemma, lexeme_id, ending_id, form, attrs, ord: all forms of every lexeme of each lemma; of verbs the negated ones too.

    A lexeme's stem of the ending's type falls back to its first. The superlative is made for definite endings and adverbs only,
    negated debitives and forms of a number that the noun lacks are left out."""
    lex = (lexemes if lexemes is not None else completed_lexemes(cat)).join(lemmas.select("lemma").distinct(), "lemma")
    if nouns_only:
        lex = lex.where(F.element_at("paradigm_attrs", "Vārdšķira") == "Lietvārds")
    e = cat.endings.withColumnRenamed("attrs", "ending_attrs").where("NOT do_not_generate")
    rows = lex.join(e, ["language", "paradigm_id"])
    stem = F.when(F.col("stem_type") == 2, F.coalesce("stem2", "stem1")).when(F.col("stem_type") == 3, F.coalesce("stem3", "stem1")).otherwise(F.col("stem1"))
    definite = F.coalesce(F.try_element_at("ending_attrs", F.lit("Noteiktība")), F.lit("")) == "Noteiktā"
    adverb = F.coalesce(F.try_element_at("ending_attrs", F.lit("Vārdšķira")), F.lit("")) == "Apstākļa vārds"
    proper = F.coalesce(F.try_element_at("lexeme_attrs", F.lit("Lietvārda tips")), F.lit("")) == "Īpašvārds"
    rows = rows.withColumn("stem", F.lower(stem)).withColumn("third_stem", F.coalesce("stem3", F.lit(""))).withColumn("proper", proper).withColumn("superlative", definite | adverb)
    keys = rows.select("stem", "mija", "third_stem", "proper", "superlative").distinct()
    made = rows.join(variants(keys, "g"), ["stem", "mija", "third_stem", "proper", "superlative"])
    none = F.create_map().cast("map<string,string>")
    degree = F.when(F.col("degree").isNotNull(), F.create_map(F.lit("Pakāpe"), F.col("degree"))).otherwise(none)
    frowned = F.when((F.col("degree") == "Vispārākā") & (F.col("mija") >= LATGALIAN), F.create_map(F.lit("Valodas normēšana"), F.lit("Nevēlams"))).otherwise(none)
    attrs = bags.reading(F.map_concat(degree, frowned), F.col("paradigm_attrs"), F.col("lexeme_attrs"), F.col("ending_attrs"))
    forms = made.select("lemma", "lexeme_id", "language", "ending_id", like_case(F.col("lemma"), F.concat("variant", "ending")).alias("form"), attrs.alias("attrs"), (F.col("ending_id") * 100 + F.col("variant_ord")).alias("ord"))
    neg = F.broadcast(cat.prefixes.where("kind = 'negation' AND ord = 0").select("language", F.col("prefix").alias("neg")))
    verbs = forms.where((_get("Vārdšķira") == "Darbības vārds") & (_get("Noliegums") != "Jā") & (_get("Izteiksme") != "Vajadzības"))
    negated = verbs.join(neg, "language", "left").select("lemma", "lexeme_id", "language", "ending_id", F.concat(F.coalesce("neg", F.lit("ne")), "form").alias("form"), bags.add(F.col("attrs"), "Noliegums", "Jā").alias("attrs"), (F.col("ord") + 10_000_000).alias("ord"))
    out = forms.unionByName(negated)
    bad = ((_get("Skaitlis 2") == "Vienskaitlinieks") & (_get("Skaitlis") == "Daudzskaitlis")) | ((_get("Skaitlis 2") == "Daudzskaitlinieks") & (_get("Skaitlis") == "Vienskaitlis"))
    out = out.where(~bad)
    if wanted:
        out = out.where(bags.weak_all(F.col("attrs"), F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])))
    return out.select("lemma", "lexeme_id", "ending_id", "form", "attrs", "ord")


def inflect_from_paradigm(lemmas: DataFrame, cat: Catalog, paradigm: str, language: str = "lv", stem1: str | None = None, stem2: str | None = None, stem3: str | None = None) -> DataFrame:
    """Forms of lemmas that need not be in the lexicon, by a named paradigm. Explicit stems are used as stems; without them a
    paradigm of several stems, or an unknown one, falls back to the lexicon."""
    p = cat.paradigms.where((F.col("name") == paradigm) & (F.col("language") == language))
    row = p.first()
    if row is None or (row["stems"] > 1 and not stem2):
        return inflect(lemmas, cat)
    end = cat.endings.where((F.col("language") == language) & (F.col("paradigm_id") == row["paradigm_id"]) & (F.col("ending_id") == row["lemma_ending_id"])).select(F.col("ending").alias("lemma_ending"))
    rows = lemmas.select("lemma").distinct().crossJoin(F.broadcast(p)).crossJoin(F.broadcast(end))
    cut = F.when(F.col("lemma").endswith(F.col("lemma_ending")), F.expr("left(lower(lemma), length(lemma) - length(lemma_ending))")).otherwise(F.lower("lemma"))
    adhoc = rows.select("language", "paradigm_id", F.lit(None).cast("bigint").alias("lexeme_id"), "lemma", (F.lit(stem1) if stem1 else cut).alias("stem1"), F.lit(stem2).cast("string").alias("stem2"), F.lit(stem3).cast("string").alias("stem3"), F.create_map().cast("map<string,string>").alias("lexeme_attrs"), F.col("attrs").alias("paradigm_attrs"), "lemma_ending_id", "lemma_ending", F.col("name").alias("paradigm_name"))
    return inflect(lemmas, cat, adhoc)


def _choose(tokens: DataFrame, targets: DataFrame, readings: DataFrame, forms: DataFrame) -> DataFrame:
    """Of each token (phrase_id, pos, token) and target of its phrase (target, case, number, gender) the form that agrees best in case,
    number, gender and definiteness, in this order; nouns keep their own gender; a token without forms stays."""
    best = readings.where("rank = 1").select("token", "lemma", F.col("attrs").alias("own"))
    rows = tokens.join(best, "token", "left").join(targets, "phrase_id")
    alts = forms.select("lemma", "form", F.col("attrs").alias("fa"), "ord")
    rows = rows.join(alts, "lemma", "left")
    noun = _get("Vārdšķira", "own") == "Lietvārds"
    gender = F.when(noun, _get("Dzimte", "own")).otherwise(F.col("gender"))
    flags = [_get("Locījums", "fa") == F.col("case"), _get("Skaitlis", "fa") == F.col("number"), _get("Dzimte", "fa") == gender, _get("Noteiktība", "fa") == _get("Noteiktība", "own"), _get("Pakāpe", "fa") == _get("Pakāpe", "own")]
    order = Window.partitionBy("phrase_id", "target", "pos").orderBy(*[F.coalesce(f, F.lit(False)).desc() for f in flags], "ord")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select("phrase_id", "target", "case", "pos", F.when(F.col("form").isNull() | (_get("Locījums", "fa") != F.col("case")), F.col("token")).otherwise(like_case(F.col("token"), F.col("form"))).alias("form"))


def heads(tokens: DataFrame, readings: DataFrame) -> DataFrame:
    """phrase_id, pos, gender, number, plural_only of the head: the rightmost noun, else the rightmost analysed token, else the last."""
    rows = tokens.join(readings.where("rank = 1").select("token", "attrs"), "token", "left")
    grade = F.when(_get("Vārdšķira") == "Lietvārds", 2).when(F.col("attrs").isNotNull(), 1).otherwise(0)
    head = F.max_by(F.struct("pos", _get("Dzimte").alias("gender"), _get("Skaitlis").alias("number"), (_get("Skaitlis 2") == "Daudzskaitlinieks").alias("plural_only")), F.struct(grade, "pos"))
    return rows.where(~punctuation(F.col("token"))).groupBy("phrase_id").agg(head.alias("h")).select("phrase_id", "h.*")


def inflect_phrase(tokens: DataFrame, readings: DataFrame, forms: DataFrame) -> DataFrame:
    """phrase_id, case, phrase: the phrase in five cases, in the head's number."""
    spark = tokens.sparkSession
    cases = F.broadcast(spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "target int, case string"))
    targets = heads(tokens, readings).crossJoin(cases).select("phrase_id", "target", "case", F.when(F.col("number") == "", "Vienskaitlis").otherwise(F.col("number")).alias("number"), "gender")
    chosen = _choose(tokens, targets, readings, forms)
    return chosen.groupBy("phrase_id", "target", "case").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("f")).select("phrase_id", "case", glue(F.transform("f", lambda x: x["form"])).alias("phrase"))


def normalize_phrase(tokens: DataFrame, readings: DataFrame, forms: DataFrame) -> DataFrame:
    """phrase_id, phrase in the nominative, singular unless the head has a plural only."""
    targets = heads(tokens, readings).select("phrase_id", F.lit(0).alias("target"), F.lit("Nominatīvs").alias("case"), F.when(F.col("plural_only"), "Daudzskaitlis").otherwise("Vienskaitlis").alias("number"), "gender")
    chosen = _choose(tokens, targets, readings, forms)
    return chosen.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("f")).select("phrase_id", glue(F.transform("f", lambda x: x["form"])).alias("phrase"))


def inflect_people(tokens: DataFrame, readings: DataFrame, forms: DataFrame, gender: str | None = None) -> DataFrame:
    """phrase_id, pos, number, case, form of each name component: two numbers by six cases, the first form that matches; proper
    nouns are preferred, another gender than the asked one is left out, and a component without forms gives itself once."""
    spark = tokens.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate((n, c) for n in NUMBERS for c in NAME_CASES)], "cell int, number string, case string"))
    want = {"m": "Vīriešu", "f": "Sieviešu"}.get(gender or "", gender)
    own = readings if want is None else readings.where(_get("Dzimte").isin("", want))
    order = Window.partitionBy("token").orderBy((_get("Lietvārda tips") == "Īpašvārds").desc(), "rank")
    best = own.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("token", "lemma")
    rows = tokens.join(best, "token", "left").crossJoin(grid)
    alts = forms.select("lemma", "form", _get("Skaitlis").alias("number"), _get("Locījums").alias("case"), "ord").groupBy("lemma", "number", "case").agg(F.min_by("form", "ord").alias("form"))
    got = rows.join(alts, ["lemma", "number", "case"], "left").select("phrase_id", "pos", "cell", "number", "case", "token", "form")
    found = got.where("form IS NOT NULL").select("phrase_id", "pos", "number", "case", like_case(F.col("token"), F.col("form")).alias("form"))
    none = got.groupBy("phrase_id", "pos", "token").agg(F.count("form").alias("n")).where("n = 0").select("phrase_id", "pos", F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("case"), F.col("token").alias("form"))
    return found.unionByName(none)


def valency_tags(tokens: DataFrame, readings: DataFrame, prefer_verb: bool = True) -> DataFrame:
    """phrase_id, tags of queries (phrase_id, pos, token): one token by its best reading, a verb being preferred or not; several by the
    governed cases of a preposition at their head, as a clause after a conjunction, else by the last token, not as a verb."""
    code = lambda case: F.coalesce(*[F.when(case == k, v) for k, v in CODES.items()])
    n = F.count("*").over(Window.partitionBy("phrase_id"))
    rows = tokens.withColumn("n", n)
    verb = _get("Vārdšķira") == "Darbības vārds"
    for_verb = F.when(F.lit(prefer_verb) & (F.col("n") == 1), verb).otherwise(~verb)
    each = rows.join(readings, "token", "left").withColumn("s", F.col("score") + F.when(for_verb, 200).otherwise(0))
    last = Window.partitionBy("phrase_id").orderBy(F.desc("pos"), F.desc_nulls_last("s"), "cand_idx")
    best = each.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    person, case = _get("Persona"), code(_get("Locījums"))
    verb_tags = F.array_distinct(F.array_compact(F.array(F.when(F.length(person) == 1, F.concat(F.lit("V"), person)), F.when(_get("Izteiksme") == "Nenoteiksme", F.lit("Inf")), *[F.lit(x) for x in ("V1", "V2", "V3", "Inf")])))
    noun_tags = F.array_distinct(F.array_compact(F.array(case, *[F.lit(x) for x in CODES.values()])))
    none = F.array().cast("array<string>")
    tags = F.concat(F.when(verb, verb_tags).otherwise(none), F.when(_get("Vārdšķira").isin("Lietvārds", "Vietniekvārds"), noun_tags).otherwise(none), F.when(_get("Vārdšķira") == "Apstākļa vārds", F.array(F.lit("Adv"))).otherwise(none))
    single = best.select("phrase_id", "n", F.when(F.size(tags) == 0, F.array(*[F.lit(x) for x in VALENCY_FALLBACK])).otherwise(tags).alias("tags"))
    first = rows.where("n > 1").join(rows.groupBy("phrase_id").agg(F.min("pos").alias("pos")), ["phrase_id", "pos"]).join(readings, "token")
    lead = first.where("rank = 1").select("phrase_id", _get("Vārdšķira").alias("lead"))
    governed = first.where(_get("Vārdšķira") == "Prievārds").groupBy("phrase_id").agg(F.array_sort(F.collect_set(F.concat("token", code(_get("Rekcija"))))).alias("g"))
    out = single.join(lead, "phrase_id", "left").join(governed, "phrase_id", "left")
    chosen = F.when((F.col("n") > 1) & (F.col("lead") == "Prievārds") & (F.size(F.coalesce("g", none)) > 0), F.col("g")).when((F.col("n") > 1) & (F.col("lead") == "Saiklis"), F.array(F.lit("S"))).otherwise(F.col("tags"))
    return out.select("phrase_id", chosen.alias("tags"))


def prepositions_agree(tagged: DataFrame) -> DataFrame:
    """tagged (doc_id, sent_id, pos, token, attrs; null attrs: not analysed): a preposition before a plural gets plural and dative. What
    counts is the next analysed token that is no particle, conjunction or punctuation mark."""
    after = Window.partitionBy("doc_id", "sent_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    skip = F.col("attrs").isNull() | _get("Vārdšķira").isin("Partikula", "Saiklis", "Pieturzīme")
    number = F.first(F.when(~skip, _get("Skaitlis")), ignorenulls=True).over(after)
    more = F.create_map(F.lit("Skaitlis"), F.lit("Daudzskaitlis"), F.lit("Rekcija"), F.lit("Datīvs"))
    rows = tagged.withColumn("_next", number)
    return rows.withColumn("attrs", F.when((_get("Vārdšķira") == "Prievārds") & (F.col("_next") == "Daudzskaitlis"), F.map_concat("attrs", more)).otherwise(F.col("attrs"))).drop("_next")
