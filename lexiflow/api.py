"""The public functions, DataFrames in and out."""

from .functions.tags import from_tag, to_tag, translated
from .operators.candidates import analyze, analyze_lemma, suitable_paradigms
from .operators.generation import inflect, inflect_from_paradigm, inflect_people, inflect_phrase, normalize_phrase, valency_tags
from .operators.lookups import by_frequency, lexemes_by_id, lexemes_by_lemma, lexemes_by_paradigm, of_language, without_proper
from .operators.tagging import tag
from .operators.tokens import sentences, tokens
from .seed import Catalog, Settings, catalog
from .session import configure
from .sources.tables import counts

__all__ = [
    "Catalog", "Settings", "analyze", "analyze_lemma", "by_frequency", "catalog", "configure", "counts", "from_tag", "inflect", "inflect_from_paradigm", "inflect_people",
    "inflect_phrase", "lexemes_by_id", "lexemes_by_lemma", "lexemes_by_paradigm", "normalize_phrase", "of_language", "sentences", "suitable_paradigms", "tag", "to_tag", "tokens", "translated", "valency_tags", "without_proper",
]
