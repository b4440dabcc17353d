"""Language by script, and by votes of frequent words where several languages share one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import language_sample

#: A few of the most frequent words of each language.
WORDS = {
    "bg": ("на", "да", "се", "от", "за", "не", "са", "това", "със", "като"),
    "cs": ("je", "se", "na", "že", "jsou", "byl", "které", "pro", "jako", "také"),
    "da": ("og", "det", "er", "ikke", "til", "af", "på", "med", "den", "blev"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit", "für", "von"),
    "en": ("the", "and", "of", "to", "is", "that", "was", "for", "with", "are"),
    "es": ("el", "los", "que", "del", "una", "por", "con", "las", "para", "se"),
    "fi": ("ja", "on", "ei", "että", "se", "hän", "oli", "ovat", "mutta", "myös"),
    "fr": ("le", "les", "des", "est", "pour", "dans", "une", "sur", "du", "et"),
    "hu": ("és", "hogy", "nem", "egy", "az", "van", "volt", "ez", "meg", "csak"),
    "id": ("yang", "dan", "ini", "dengan", "untuk", "dari", "dalam", "itu", "pada", "adalah"),
    "it": ("il", "che", "di", "per", "non", "sono", "della", "gli", "anche", "nel"),
    "nl": ("de", "het", "een", "van", "niet", "dat", "op", "zijn", "voor", "wordt"),
    "pl": ("nie", "się", "na", "jest", "że", "jak", "przez", "dla", "oraz", "są"),
    "pt": ("o", "que", "não", "uma", "com", "para", "os", "dos", "mais", "em"),
    "ro": ("și", "este", "nu", "în", "care", "pentru", "din", "mai", "sunt", "cu"),
    "ru": ("и", "в", "не", "на", "что", "он", "это", "как", "для", "по"),
    "sv": ("och", "att", "det", "som", "är", "inte", "av", "för", "med", "den"),
    "tr": ("ve", "bir", "bu", "için", "ile", "olarak", "çok", "daha", "olan", "gibi"),
    "uk": ("і", "що", "не", "на", "та", "від", "це", "як", "для", "є"),
    "vi": ("và", "của", "là", "có", "được", "cho", "không", "trong", "một", "những"),
}
#: Languages that are alone with a script (of those that are told apart here), by its Unicode name. Japanese mixes
#: two of its own with Han and comes first.
SCRIPTS = {
    "ja": ("Hiragana", "Katakana"), "ko": ("Hangul",), "zh-cn": ("Han",), "th": ("Thai",), "el": ("Greek",), "he": ("Hebrew",), "ar": ("Arabic",),
    "hi": ("Devanagari",), "bn": ("Bengali",), "ta": ("Tamil",), "te": ("Telugu",), "gu": ("Gujarati",), "kn": ("Kannada",), "ml": ("Malayalam",), "pa": ("Gurmukhi",),
}
#: A text whose letters are at least a fifth of such a script is of its language.
SHARE = 5


def votes(sample: Column) -> Column:
    """array<struct<hits, lang>>; words are split at anything that is no letter. Words that no list has are left out first."""
    every = sorted({w for own in WORDS.values() for w in own})
    words = F.filter(F.split(F.lower(sample), r"[^\p{L}]+"), lambda w: w.isin(*every))
    among = lambda own: lambda w: w.isin(*own)
    one = lambda ws: F.array(*[F.struct(F.size(F.filter(ws, among(own))).alias("hits"), F.lit(lang).alias("lang")) for lang, own in WORDS.items()])
    return F.try_element_at(F.transform(F.array(words), one), F.lit(1))


def by_script(sample: Column) -> Column:
    """The language of the first script that has its share of the letters, or null."""
    n = lambda inner: F.length(F.regexp_replace(sample, f"[^{inner}]", ""))
    letters = n(r"\p{L}")
    out = F.lit(None).cast("string")
    for lang, scripts in reversed(SCRIPTS.items()):
        own = n("".join(rf"\p{{Is{s}}}" for s in scripts))
        out = F.when((own > 0) & (own * SHARE >= letters), F.lit(lang)).otherwise(out)
    # Most texts have no letter of these scripts: one look decides.
    return F.when(sample.rlike("[" + "".join(rf"\p{{Is{s}}}" for own in SCRIPTS.values() for s in own) + "]"), out)


def language(text: Column, chars: int = 2000) -> Column:
    """The language of the text's script, else the one with most hits, the first by name on a tie; null without hits or below 20
    characters."""
    sample = language_sample(text, chars)
    best = F.aggregate(votes(sample), F.struct(F.lit(0).alias("hits"), F.lit(None).cast("string").alias("lang")), lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a))
    return F.when(sample.isNotNull(), F.coalesce(by_script(sample), best["lang"]))
