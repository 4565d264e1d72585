"""Fixed dictionaries used by the registered queries (written for the driver's data).

The driver's `documents` are invented prose in four languages, so the
"complaint categories" are the languages and the dictionary holds function
words and phrases of each.  Order and repeats are part of the value.
"""

from __future__ import annotations

from textlens.sources.lexicon import Lexicon

# Weighted (second-generation) language lexicon, category -> phrases.
LANG_LEXICON = Lexicon.from_mapping({
    "en": ["the", "and", "of the", "in the", "that", "with", "is the", "to the"],
    "fr": ["les", "des", "et", "de la", "dans", "pour", "et la", "sur le"],
    "de": ["der", "und", "die", "nicht", "sich", "von", "in der", "und die"],
    "es": ["que", "los", "el", "del", "para", "por", "en el", "de los"],
})

# First-generation lexicon (unweighted, case variants listed twice).
LANG_LEXICON_V1 = Lexicon.from_mapping({
    "en": ["The", "the", "and", "with"],
    "fr": ["les", "Les", "dans", "pour"],
    "de": ["der", "Der", "und", "nicht"],
    "es": ["que", "los", "para", "por"],
})

# Lexicon over the ten embedding classes ('0'..'9'), used with the
# centroid base scorer so that every rung of the hybrid ladder is exercised.
EMBED_LEXICON = Lexicon.from_mapping({
    "0": ["the"],
    "1": ["of the"],
    "2": ["and", "in the"],
    "3": ["les"],
    "4": ["et"],
    "5": ["der", "und"],
    "6": ["el"],
    "7": ["que", "los"],
    "8": ["to"],
    "9": ["with", "of the the"],
})
