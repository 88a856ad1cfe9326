"""All components register themselves on import."""

from . import core, folding, languages, metrics_and_numbers, normalizers, phonetics, rule_stemmers, sequences, social_and_unicode, stemmers, text, tokenizers, web_and_privacy

__all__ = ["core", "folding", "languages", "metrics_and_numbers", "normalizers", "phonetics", "rule_stemmers", "sequences", "social_and_unicode", "stemmers", "text", "tokenizers", "web_and_privacy"]
