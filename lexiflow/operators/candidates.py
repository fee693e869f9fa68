"""Candidate readings of distinct tokens: suffix join, alternation, stem join, verification, then tiers of fallbacks.

Everything is analysed once per distinct token and joined back to occurrences by the caller. Order among candidates, which
survives ties in ranking, is carried as cand_idx: by tier, then longer endings first, then the catalog's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bags
from ..functions.text import fallback_class, first_capital, like_case
from ..seed import Catalog, Settings
from ..session import cut
from . import closed
from .alternation import LATGALIAN, variants, verified


def suffixes(vocab: DataFrame, longest: Column | int) -> DataFrame:
    """token, low, k, suffix, stem: every ending length that may be cut off, 0 and up to two less than the token has."""
    low = F.lower("token")
    rows = vocab.select("token", low.alias("low")).where("low <> ''")
    lengths = F.sequence(F.lit(0), F.greatest(F.least(F.length("low") - 2, longest if isinstance(longest, Column) else F.lit(longest)), F.lit(0)))
    rows = rows.withColumn("k", F.explode(lengths))
    return rows.select("token", "low", "k", F.expr("right(low, k)").alias("suffix"), F.expr("left(low, length(low) - k)").alias("stem"))


def ending_matches(vocab: DataFrame, endings: DataFrame) -> DataFrame:
    """Endings that end a token: suffixes joined by equality, never by a comparison of every pair."""
    longest = F.coalesce(endings.agg(F.max(F.length("ending"))).scalar(), F.lit(0))
    return suffixes(vocab, longest).join(endings, F.col("suffix") == F.col("ending"))


def completed_lexemes(cat: Catalog) -> DataFrame:
    """Lexemes with paradigm by id, else by name, their own attributes as a bag, and stem1 from the lemma where it is missing."""
    p = cat.paradigms.select("language", "paradigm_id", "name", "lemma_ending_id", F.col("attrs").alias("paradigm_attrs"))
    by_id = (p)
    by_name = (p.groupBy("language", "name").agg(F.max("paradigm_id").alias("named_id")))
    rows = cat.lexemes.join(by_name, (cat.lexemes.language == by_name.language) & (cat.lexemes.paradigm_name == by_name.name), "left").drop(by_name.language).drop("name")
    rows = rows.withColumn("paradigm_id", F.coalesce("paradigm_id", "named_id")).drop("named_id")
    lemma_end = (cat.endings.select("language", "paradigm_id", F.col("ending_id").alias("lemma_ending_id"), F.col("ending").alias("lemma_ending")))
    rows = rows.join(by_id, ["language", "paradigm_id"]).join(lemma_end, ["language", "paradigm_id", "lemma_ending_id"], "left")
    cut = F.when(F.col("lemma").endswith(F.col("lemma_ending")), F.expr("left(lower(lemma), length(lemma) - length(lemma_ending))")).otherwise(F.lower("lemma"))
    own = F.coalesce(F.from_json("attributes_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select("language", "paradigm_id", "lexeme_id", "lemma", F.coalesce("stem1", cut).alias("stem1"), "stem2", "stem3", own.alias("lexeme_attrs"), "paradigm_attrs", "lemma_ending_id", "lemma_ending", F.col("name").alias("paradigm_name"))


def stems(cat: Catalog) -> DataFrame:
    """A row for each lexeme and stem type, other stems falling back to the first."""
    rows = completed_lexemes(cat)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("stem_type"), F.coalesce(f"stem{i}", "stem1").alias("stem")) for i in (1, 2, 3)]))
    return rows.withColumn("x", each).select("*", "x.stem_type", F.col("x.stem").alias("base_stem")).drop("x")


def _proper(token: str = "token") -> Column:
    return F.coalesce(first_capital(F.col(token)), F.lit(False))


def endings_of(vocab: DataFrame, cat: Catalog) -> DataFrame:
    """Every ending of a token with the base stems it may go back to."""
    e = cat.endings.withColumnsRenamed({"attrs": "ending_attrs"})
    m = ending_matches(vocab, e).withColumn("proper", _proper()).withColumn("third_stem", F.lit("")).withColumn("superlative", F.lit(False))
    keys = m.select("stem", "mija", "third_stem", "proper", "superlative").distinct()
    return m.join(variants(keys, "a"), ["stem", "mija", "third_stem", "proper", "superlative"])


def _bag(*parts: Column) -> Column:
    return bags.reading(*parts)


def _variant_bag() -> Column:
    none = F.create_map().cast("map<string,string>")
    degree = F.when(F.col("degree").isNotNull(), F.create_map(F.lit("Pakāpe"), F.col("degree"))).otherwise(none)
    mark = F.when(F.col("mark").isNotNull(), F.create_map(F.lit("Mija"), F.col("mark"))).otherwise(none)
    # Latgalian superlatives with vys- are discouraged
    frowned = F.when((F.col("degree") == "Vispārākā") & (F.col("mija") >= LATGALIAN), F.create_map(F.lit("Valodas normēšana"), F.lit("Nevēlams"))).otherwise(none)
    return F.map_concat(degree, mark, frowned)


_READING = ["token", "tier", "lexeme_id", "ending_id", "paradigm_id", "language", "lemma", "attrs", "k", "ord"]


def lexicon_readings(vocab: DataFrame, cat: Catalog, split: DataFrame | None = None) -> DataFrame:
    """Readings by lexicon, hardcoded forms first. split: endings_of(vocab, cat), where the caller has it."""
    s = stems(cat)
    hard = s.where("stem_type = 1 AND paradigm_name = 'hardcoded'")
    none = F.create_map().cast("map<string,string>")
    own = vocab.select("token", F.lower("token").alias("low")).join((hard), F.col("low") == F.col("base_stem"))
    fixed = own.select("token", F.lit(0).alias("tier"), "lexeme_id", F.col("lemma_ending_id").alias("ending_id"), "paradigm_id", "language", "lemma", _bag(none, F.col("paradigm_attrs"), F.col("lexeme_attrs"), none).alias("attrs"), F.lit(0).alias("k"), F.lit(0).alias("ord"))
    split = endings_of(vocab, cat) if split is None else split
    known = s.where("paradigm_name <> 'hardcoded'").withColumnRenamed("base_stem", "variant")
    found = split.join((known), ["language", "paradigm_id", "stem_type", "variant"])
    found = found.withColumn("third_stem", F.coalesce("stem3", "stem"))
    checked = verified(found)
    attrs = _bag(_variant_bag(), F.col("paradigm_attrs"), F.col("lexeme_attrs"), F.col("ending_attrs"))
    regular = checked.select("token", F.lit(1).alias("tier"), "lexeme_id", "ending_id", "paradigm_id", "language", "lemma", attrs.alias("attrs"), "k", (F.col("ending_id") * 100 + F.col("variant_ord")).cast("int").alias("ord"))
    return fixed.select(*_READING).unionByName(regular.select(*_READING))


def acceptable(readings: DataFrame, settings: Settings) -> DataFrame:
    """Without vocatives, unless wanted, and without numbers that a noun of one number lacks."""
    a = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    bad = ((a("Skaitlis 2") == "Vienskaitlinieks") & (a("Skaitlis") == "Daudzskaitlis")) | ((a("Skaitlis 2") == "Daudzskaitlinieks") & (a("Skaitlis") == "Vienskaitlis"))
    return readings.where(~bad & (F.lit(settings.vocative) | (a("Locījums") != "Vokatīvs")))


def derived_readings(vocab: DataFrame, cat: Catalog, settings: Settings, split: DataFrame | None = None) -> DataFrame:
    """Diminutives in -iņ- and -īt- of nouns, and agent nouns in -tāj- and -ēj- of verbs, where the paradigm allows them."""
    s = stems(cat)
    split = endings_of(vocab, cat) if split is None else split
    allowed = (cat.paradigms.select("language", "paradigm_id", F.col("attrs").alias("paradigm_attrs"), F.coalesce(F.try_element_at("attrs", F.lit("Paradigmai atļautie atvasinājumi")), F.lit("")).alias("allowed"), F.col("name").alias("paradigm_name"), "lemma_ending_id"))
    lemma_end = (cat.endings.select("language", "paradigm_id", F.col("ending_id").alias("lemma_ending_id"), F.col("ending").alias("lemma_ending")))
    rows = split.join(allowed, ["language", "paradigm_id"]).join(lemma_end, ["language", "paradigm_id", "lemma_ending_id"], "left")
    base = F.expr("left(variant, length(variant) - 2)")
    soft = F.when(base.endswith("dz"), F.concat(F.expr("left(variant, length(variant) - 4)"), F.lit("g"))).when(base.endswith("c"), F.concat(F.expr("left(variant, length(variant) - 3)"), F.lit("k")))
    dims = F.when(F.col("variant").endswith("īt") & F.col("allowed").contains("Deminutīvs -īt"), F.array(base))
    dims = dims.when(F.col("variant").endswith("iņ") & F.col("allowed").contains("Deminutīvs -iņ") & ~((F.col("paradigm_name") == "noun-1b") & base.rlike("[ļkg]$")), F.array_compact(F.array(base, soft)))
    out = []
    if settings.diminutives:
        found = rows.withColumn("base", F.explode(dims)).join((s.select("language", "paradigm_id", "stem_type", F.col("base_stem").alias("base"), "lexeme_id", "lexeme_attrs", F.col("lemma").alias("source_lemma"))), ["language", "paradigm_id", "stem_type", "base"])
        marker = F.expr("right(variant, 2)")
        extra = F.create_map(F.lit("Pamazinājums"), F.concat(F.lit("-"), marker, F.lit("-")), F.lit("Avots"), F.lit("pamazināmo formu atvasināšana"), F.lit("Minējums"), F.lit("Pamazinājums"), F.lit("Avota pamatforma"), F.col("source_lemma"))
        lemma = like_case(F.col("token"), F.concat("base", marker, "lemma_ending"))
        attrs = F.map_concat(_bag(_variant_bag(), F.col("paradigm_attrs"), F.col("lexeme_attrs"), F.col("ending_attrs")), extra, F.create_map(F.lit("Pamatforma"), lemma))
        out.append(found.select("token", F.lit(2).alias("tier"), "lexeme_id", "ending_id", "paradigm_id", "language", lemma.alias("lemma"), attrs.alias("attrs"), "k", F.col("ending_id").alias("ord")))
    if settings.derived_nouns:
        may = rows.where("allowed LIKE '%tājs%' OR allowed LIKE '%ējs%'")
        agent = may.withColumn("verb_stem", F.when(F.col("variant").endswith("tāj"), F.expr("left(variant, length(variant) - 3)")).when(F.col("variant").endswith("ēj"), F.expr("left(variant, length(variant) - 2)"))).withColumn("of", F.when(F.col("variant").endswith("tāj"), F.lit(1)).otherwise(F.lit(3)))
        verbs = s.where("paradigm_name IN ('verb-1', 'verb-2', 'verb-3a')").select(F.col("stem_type").alias("of"), F.col("base_stem").alias("verb_stem"), "lexeme_id", F.col("lemma").alias("source_lemma"), F.col("paradigm_name").alias("verb_name"))
        # -ēj- goes by the past stem, whose last consonant may have changed
        again = F.when(F.col("of") == 1, F.array("verb_stem")).otherwise(F.array_compact(F.array("verb_stem", F.when(F.col("verb_stem").endswith("c"), F.concat(F.expr("left(verb_stem, length(verb_stem) - 1)"), F.lit("k"))), F.when(F.col("verb_stem").endswith("dz"), F.concat(F.expr("left(verb_stem, length(verb_stem) - 2)"), F.lit("g"))))))
        agent = agent.where("verb_stem IS NOT NULL").withColumn("verb_stem", F.explode(again)).join((verbs), ["of", "verb_stem"]).where("of = 1 OR verb_name = 'verb-1'")
        lemma = like_case(F.col("token"), F.concat("variant", "lemma_ending"))
        extra = F.create_map(F.lit("Avots"), F.lit("sufiksāls atvasinājums"), F.lit("Avota pamatforma"), F.col("source_lemma"), F.lit("Minējums"), F.lit("Pamazinājums"), F.lit("Pamatforma"), lemma)
        attrs = F.map_concat(_bag(_variant_bag(), F.col("paradigm_attrs"), F.create_map().cast("map<string,string>"), F.col("ending_attrs")), extra)
        out.append(agent.select("token", F.lit(2).alias("tier"), "lexeme_id", "ending_id", "paradigm_id", "language", lemma.alias("lemma"), attrs.alias("attrs"), "k", F.col("ending_id").alias("ord")))
    empty = rows.sparkSession.createDataFrame([], "token string, tier int, lexeme_id bigint, ending_id int, paradigm_id int, language string, lemma string, attrs map<string,string>, k int, ord int")
    for x in out:
        empty = empty.unionByName(x.select(*_READING))
    return empty


def prefix_residues(vocab: DataFrame, prefixes: DataFrame) -> DataFrame:
    """token, prefix, residue, superlative: a verb prefix taken off, also under jā- (which stays) or vis-."""
    p = (prefixes.where("kind = 'verb' AND language = 'lv'").select("prefix", F.col("ord").alias("prefix_ord")))
    rows = vocab.select("token", F.lower("token").alias("low")).where(~F.col("low").contains(" "))
    deb = F.col("low").startswith("jā")
    rows = rows.withColumn("cur", F.when(deb, F.expr("substring(low, 3)")).otherwise(F.col("low"))).withColumn("keep", F.when(deb, F.lit("jā")).otherwise(F.lit("")))
    # joined by the first letter of what may begin with a prefix; under vis- that takes precedence
    starts = F.explode(F.array_compact(F.array(F.struct(F.lit(False).alias("under"), F.col("cur").alias("rest")), F.when(F.col("cur").startswith("vis"), F.struct(F.lit(True).alias("under"), F.expr("substring(cur, 4)").alias("rest"))))))
    met = rows.withColumn("x", starts).select("token", "low", "keep", "x.*").withColumn("letter", F.expr("left(rest, 1)")).join(p.withColumn("letter", F.expr("left(prefix, 1)")), "letter").where("startswith(rest, prefix)")
    got = met.groupBy("token", "low", "keep", "prefix", "prefix_ord").agg(F.max_by("rest", "under").alias("rest"), F.max("under").alias("sup"))
    rest = F.concat(F.when(F.col("sup"), F.lit("vis")).otherwise(F.lit("")), F.expr("substring(rest, 1 + length(prefix))"))
    return got.select("token", "prefix", "prefix_ord", F.concat("keep", rest).alias("residue"), F.col("sup").alias("superlative_prefix")).where("residue <> ''")


def prefix_readings(vocab: DataFrame, cat: Catalog) -> DataFrame:
    """Readings of what is left without a verb prefix, for verbs; one level of prefixes."""
    res = prefix_residues(vocab, cat.prefixes)
    inner = lexicon_readings(res.select(F.col("residue").alias("token")).distinct(), cat).withColumnRenamed("token", "residue")
    a = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    neg = F.col("prefix") == "ne"
    rows = res.join(inner, "residue").where(a("Konjugācija") != "")
    rows = rows.where(~(neg & (a("Izteiksme").isin("Vajadzības", "Vajadzības, atstāstījuma paveids") | (a("Noliegums") == "Jā")))).where(~((a("Pakāpe") == "Vispārākā") & ~F.col("superlative_prefix")))
    lemma = F.when(neg & (a("Vārdšķira") == "Darbības vārds"), F.col("lemma")).otherwise(F.concat("prefix", "lemma"))
    extra = F.create_map(F.lit("Avots"), F.lit("priedēkļu atvasināšana"), F.lit("Priedēklis"), F.col("prefix"), F.lit("Pamatforma"), lemma, F.lit("Minējums"), F.lit("Priedēklis"), F.lit("Noliegums"), F.when(neg, "Jā").otherwise("Nē"))
    return rows.select("token", F.lit(3).alias("tier"), "lexeme_id", "ending_id", "paradigm_id", "language", lemma.alias("lemma"), F.map_concat("attrs", extra).alias("attrs"), "k", (F.col("prefix_ord") * 100_000 + F.col("ord")).cast("int").alias("ord")).select(*_READING)


def pattern_readings(vocab: DataFrame) -> DataFrame:
    """Ordinals, numbers and abbreviations by their looks."""
    rows = vocab.withColumn("cls", fallback_class(F.col("token"))).where("cls <> 'none'")
    pos = F.when(F.col("cls").isin("ordinal", "number"), "Skaitlis").otherwise("Saīsinājums")
    attrs = F.create_map(F.lit("Vārdšķira"), pos, F.lit("Pamatforma"), F.col("token"), F.lit("Avots"), F.col("cls"))
    return rows.select("token", F.lit(4).alias("tier"), F.lit(None).cast("bigint").alias("lexeme_id"), F.lit(None).cast("int").alias("ending_id"), F.lit(None).cast("int").alias("paradigm_id"), F.lit("lv").alias("language"), F.col("token").alias("lemma"), attrs.alias("attrs"), F.lit(0).alias("k"), F.lit(0).alias("ord"))


def ending_guesses(vocab: DataFrame, cat: Catalog, settings: Settings, split: DataFrame | None = None) -> DataFrame:
    """Readings of unknown words by their longest ending that allows one; a word in -o keeps those of shorter endings as well."""
    p = (cat.paradigms.select("language", "paradigm_id", "name", "allowed_guess_endings", "lemma_ending_id", F.col("attrs").alias("paradigm_attrs")))
    lemma_end = (cat.endings.select("language", "paradigm_id", F.col("ending_id").alias("lemma_ending_id"), F.col("ending").alias("lemma_ending")))
    split = endings_of(vocab, cat) if split is None else split
    rows = split.join(p, ["language", "paradigm_id"]).join(lemma_end, ["language", "paradigm_id", "lemma_ending_id"], "left").where("name <> 'hardcoded'")
    may = F.col("allowed_guess_endings").isNull() | F.expr("instr(allowed_guess_endings, right(variant, 1)) > 0") | (F.col("proper") & F.col("name").isin("noun-4m", "noun-4ma", "noun-3f"))
    lemma = like_case(F.col("token"), F.concat("variant", "lemma_ending"))
    none = F.create_map().cast("map<string,string>")
    extra = F.create_map(F.lit("Avots"), F.lit("minējums pēc galotnes"), F.lit("Minējums"), F.lit("Galotne"), F.lit("Pamatforma"), lemma)
    # the bag is made for what is left; until then its values are those of the ending, else of the paradigm
    a = lambda k: F.coalesce(F.try_element_at("ending_attrs", F.lit(k)), F.try_element_at("paradigm_attrs", F.lit(k)), F.lit(""))
    ok = (a("Vārdšķira").isin("Darbības vārds", "Īpašības vārds", "Reziduālis") | (a("Izteiksme") == "Divdabis") | ((a("Vārdšķira") == "Lietvārds") & (F.lit(settings.vocative) | (a("Locījums") != "Vokatīvs"))))
    bare = a("Deklinācija").isin("Nelokāms", "Ģenitīveniskais") | (a("Vārdšķira") == "Reziduālis")
    rows = rows.where(may & ok & ((F.col("k") > 0) | bare))
    longest = F.max("k").over(Window.partitionBy("token"))
    rows = rows.withColumn("_top", longest).where((F.col("k") == F.col("_top")) | F.col("low").endswith("o"))
    rows = rows.withColumn("attrs", F.map_concat(_bag(_variant_bag(), F.col("paradigm_attrs"), none, F.col("ending_attrs")), extra)).withColumn("lemma", lemma)
    return rows.select("token", F.lit(5).alias("tier"), F.lit(None).cast("bigint").alias("lexeme_id"), "ending_id", "paradigm_id", "language", "lemma", "attrs", "k", F.col("ending_id").alias("ord"))


def drop_rare(readings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rare readings go where the token has another; regional ones always go."""
    use = F.coalesce(F.try_element_at("attrs", F.lit("Lietojums")), F.lit(""))
    rare, regional = use == "Reti", use == "Apvidvārds"
    common = F.max(F.when(rare, 0).otherwise(1)).over(Window.partitionBy("token"))
    rows = readings.withColumn("_common", common)
    if settings.remove_rare:
        rows = rows.where(~rare | (F.col("_common") == 0))
    if settings.remove_regional:
        rows = rows.where(~regional)
    return rows.drop("_common")


def ranked(readings: DataFrame, cat: Catalog, settings: Settings = Settings()) -> DataFrame:
    """readings with cand_idx, score and rank: 0.1 + the ending's frequency + 1000 times the lexeme's, five less for guesses; among
    equals those first whose being a proper noun agrees with the token's capital, then the order of candidates."""
    by = Window.partitionBy("token")
    rows = readings.withColumn("cand_idx", (F.row_number().over(by.orderBy("tier", F.desc("k"), "ord", "lexeme_id", "lemma")) - 1).cast("int"))
    rows = rows.join((cat.end_freq.withColumnRenamed("n", "_e")), "ending_id", "left").join((cat.lex_freq.withColumnRenamed("n", "_l")), "lexeme_id", "left")
    score = F.lit(0.1) + F.coalesce("_e", F.lit(0)) + 1000 * F.coalesce("_l", F.lit(0)) - F.when(F.col("lexeme_id").isNull(), 5).otherwise(0)
    agrees = ((F.coalesce(F.try_element_at("attrs", F.lit("Lietvārda tips")), F.lit("")) == "Īpašvārds") == _proper()).cast("int")
    rows = rows.withColumn("score", score)
    order = by.orderBy(F.desc("score"), agrees.desc(), "cand_idx") if settings.rank else by.orderBy("cand_idx")
    return rows.withColumn("rank", F.row_number().over(order)).select("token", "cand_idx", "tier", "lexeme_id", "ending_id", "paradigm_id", "language", "lemma", "attrs", "score", "rank")


def analyze(vocab: DataFrame, cat: Catalog, settings: Settings = Settings()) -> DataFrame:
    """Ranked readings of distinct tokens (token); rank 1 is best."""
    # every tier starts from the words, and three from the same splits of them
    words = cut(vocab.select("token").where("trim(token) <> ''").distinct())
    split = cut(endings_of(words, cat))
    tiers = acceptable(lexicon_readings(words, cat, split), settings)
    if settings.diminutives or settings.derived_nouns:
        tiers = tiers.unionByName(derived_readings(words, cat, settings, split))
    if settings.prefixes:
        tiers = tiers.unionByName(prefix_readings(words, cat))
    tiers = tiers.unionByName(pattern_readings(words))
    if settings.guessing:
        tiers = tiers.unionByName(ending_guesses(words, cat, settings, split))
    # every tier once for all tokens, then one pass over each token's readings decides which tiers count
    by = Window.partitionBy("token")
    a = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    has = lambda cond: F.coalesce(F.max(F.when(cond, 1).otherwise(0)).over(by), F.lit(0)) == 1
    rows = tiers.withColumn("_lex", has(F.col("tier") <= 1)).withColumn("_in", (F.col("tier") <= 1) | ((F.col("tier") == 2) & ~F.col("_lex")))
    rows = rows.withColumn("_known", has(F.col("_in"))).withColumn("_verb", has(F.col("_in") & (a("Vārdšķira") == "Darbības vārds"))).withColumn("_part", has(F.col("_in") & (a("Izteiksme") == "Divdabis")))
    asked = ~F.col("_known") | F.col("_part") | (F.lower("token").startswith("ne") & ~F.col("_verb"))
    rows = rows.withColumn("_in", F.col("_in") | ((F.col("tier") == 3) & asked))
    rows = rows.withColumn("_in", F.col("_in") | ((F.col("tier") == 4) & ~has(F.col("_in"))))
    rows = rows.withColumn("_in", F.col("_in") | ((F.col("tier") == 5) & ~has(F.col("_in"))))
    return ranked(drop_rare(closed.completed(rows.where("_in").select(*_READING), cat), settings), cat, settings)


def analyze_lemma(vocab: DataFrame, cat: Catalog, settings: Settings = Settings()) -> DataFrame:
    """Readings whose ending is their paradigm's lemma ending."""
    return analyze(vocab, cat, settings).join((cat.paradigms.select("language", "paradigm_id", F.col("lemma_ending_id").alias("ending_id"))), ["language", "paradigm_id", "ending_id"], "left_semi")


def suitable_paradigms(vocab: DataFrame, cat: Catalog) -> DataFrame:
    """token, paradigm_id, name, n: paradigms that a lemma may belong to, by lexicon or guess, most frequent lemma ending first."""
    found = analyze_lemma(vocab, cat, Settings(guessing=True)).select("token", "paradigm_id", "language")
    guess = ending_guesses(vocab, cat, Settings()).join((cat.paradigms.select("language", "paradigm_id", F.col("lemma_ending_id").alias("ending_id"))), ["language", "paradigm_id", "ending_id"], "left_semi").select("token", "paradigm_id", "language")
    p = cat.paradigms.select("language", "paradigm_id", "name", F.col("lemma_ending_id").alias("ending_id"))
    return found.union(guess).distinct().join((p), ["language", "paradigm_id"]).join((cat.end_freq), "ending_id", "left").select("token", "paradigm_id", "name", F.coalesce("n", F.lit(0)).alias("n"))
