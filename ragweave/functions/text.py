"""Text functions as column expressions; they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a text is cleaned of and split at.
SPACE = r"(?U)[\s\x1c-\x1f]+"
LEADING = r"(?U)^[\s\x1c-\x1f.,;:!?\-—–*#>)(]+"
#: Fixed value: the characters of SPACE.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A character that canonical composition may change; all below U+0300 are composed.
NOT_COMPOSED = r"[^\x{0}-\x{2FF}]"
TOKEN = r"([\p{L}\p{N}]+)"
TOKEN_WITH_MARKS = r"([\p{L}\p{M}\p{N}]+)"
BETWEEN_TOKENS, BETWEEN_TOKENS_WITH_MARKS = r"[^a-z0-9\p{L}\p{N}]+", r"[^a-z0-9\p{L}\p{M}\p{N}]+"
#: Fixed value: characters whose lower case hangs on those beside them, or is a token's character where they are none, or the reverse.
NOT_FOLDED_WHOLE = "İΣ\ua7cb\ua7dc"
SENTENCE_END = r"(?U)(?<=[.!?।؟۔…])\s+"
CLAIM_END = r"(?U)(?<=[.!?।؟۔])\s+"
#: Function words that grounding leaves out.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "of", "and", "or", "to", "in",
    "on", "as", "it", "its", "has", "have", "such", "for", "with", "that", "this", "at", "by", "from",
)
#: The language that a script stands for.
SCRIPTS = {
    "Latin": "en", "Devanagari": "hi", "Bengali": "bn", "Gujarati": "gu", "Gurmukhi": "pa", "Kannada": "kn",
    "Malayalam": "ml", "Oriya": "or", "Tamil": "ta", "Telugu": "te", "Arabic": "ur", "Cyrillic": "cyrillic",
    "Greek": "greek", "Hebrew": "hebrew", "Thai": "thai", "Hiragana": "hiragana", "Katakana": "katakana", "Hangul": "hangul", "Han": "cjk",
}


def squeeze(c: Column) -> Column:
    """White space (any script's) collapsed to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACE, " "), F.lit(" "))


def _composed(c: Column) -> Column:
    """Canonical composition of texts that aren't null, by the library that Spark's collations use."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))


def nfc(c: Column) -> Column:
    """Unicode canonical composition (ICU's); only texts that may change are composed."""
    return F.when(c.rlike(NOT_COMPOSED), _composed(c)).otherwise(c)


def nfc_each(c: Column) -> Column:
    """``nfc`` of the elements of an array."""
    open_ = F.exists(c, lambda x: F.coalesce(x.rlike(NOT_COMPOSED), F.lit(False)))
    return F.when(open_, F.transform(c, nfc)).otherwise(c)


def cleaned(c: Column, leading: bool = False, compose: bool = False) -> Column:
    """A text squeezed, without leading punctuation if asked, null where nothing is left."""
    out = squeeze(nfc(c) if compose else c)
    out = squeeze(F.regexp_replace(out, LEADING, "")) if leading else out
    return F.nullif(out, F.lit(""))


def folded(c: Column) -> Column:
    """Lower case; sharp s as ss, as case folding has it."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def dedupe_key(c: Column) -> Column:
    return folded(squeeze(c))


def tokens(c: Column, marks: bool = False) -> Column:
    """Folded runs of letters and digits. Combining marks end a token unless ``marks``.

    A text is folded as a whole and cut between its tokens, unless it has characters for which that differs.
    """
    text = F.coalesce(c, F.lit(""))
    each = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_WITH_MARKS if marks else TOKEN), F.lit(1)), folded)
    whole = F.array_remove(F.split(folded(text), BETWEEN_TOKENS_WITH_MARKS if marks else BETWEEN_TOKENS), "")
    return F.when(reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in NOT_FOLDED_WHOLE)), each).otherwise(whole)


def _split(c: Column, end: str) -> Column:
    parts = F.transform(F.split(squeeze_ends(c), end), lambda s: squeeze_ends(s))
    return F.filter(parts, lambda s: s != "")


def squeeze_ends(c: Column) -> Column:
    """White space stripped from both ends only."""
    return F.btrim(c, F.lit(BLANKS))


def sentences(c: Column) -> Column:
    return _split(F.coalesce(c, F.lit("")), SENTENCE_END)


def claims(c: Column) -> Column:
    return _split(F.coalesce(c, F.lit("")), CLAIM_END)


def profile_sentences(c: Column) -> Column:
    """The profiler's coarser sentences: an end of sentence or a line break separates."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?।؟۔])\s+|\n"), lambda s: squeeze_ends(s) != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda s: squeeze_ends(s) != "")


def joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda s: squeeze_ends(s) != ""), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def coverage(a: Column, b: Column) -> Column:
    """Share of the distinct elements of ``a`` that ``b`` has; 0 if ``a`` has none."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)))


def content_tokens(c: Column) -> Column:
    """Distinct tokens without stop words and digit runs."""
    kept = F.array_except(tokens(c), F.array(*(F.lit(w) for w in STOP_WORDS)))
    return F.filter(kept, lambda t: ~t.rlike(r"^[\p{Nd}²³¹]+$"))


def script_language(c: Column) -> Column:
    """Language of the script with the most letters (the first seen of equals); ``und`` without letters.

    Texts without any letter beyond Latin, told by one scan, need no counting.
    """
    text = F.coalesce(c, F.lit(""))

    def counted(script: str, code: str) -> Column:
        letter = rf"[\p{{Is{script}}}&&\p{{L}}]"
        n = F.regexp_count(text, F.lit(letter))
        first = F.when(n > 0, -F.length(F.regexp_extract(text, rf"(?s)^(.*?){letter}", 1)))
        return F.struct(n.alias("n"), first.alias("first"), F.lit(code).alias("code"))

    best = F.array_max(F.array(*(counted(s, code) for s, code in SCRIPTS.items())))
    mixed = F.when(best["n"] > 0, best["code"]).otherwise("und")
    latin = F.when(text.rlike(r"\p{L}"), F.lit("en")).otherwise("und")
    return F.when(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), mixed).otherwise(latin)


def passage_id(query_id: Column, index: Column, language: Column) -> Column:
    return F.concat_ws(":", query_id.cast("string"), index.cast("string"), language)


def short_language(code: Column) -> Column:
    """The two-letter code of a FLORES code; null without a script suffix or if unknown."""
    pairs = [x for long, short in LANGUAGE_STEMS.items() for x in (F.lit(long), F.lit(short))]
    return F.when(F.instr(code, "_") > 0, F.try_element_at(F.create_map(*pairs), F.lower(F.split_part(code, F.lit("_"), F.lit(1)))))


#: Language codes of file stems and FLORES prefixes.
LANGUAGE_STEMS = {
    "asm": "as", "ben": "bn", "guj": "gu", "hin": "hi", "kan": "kn", "mal": "ml", "mar": "mr", "nep": "ne",
    "ori": "or", "ory": "or", "npi": "ne", "pan": "pa", "san": "sa", "tam": "ta", "tel": "te", "urd": "ur", "eng": "en",
}

#: Fixed value: the namespace of the ids of index points.
POINT_NAMESPACE = "7c3f1a904d2e5b68a1c49e0d8f7b6a52"


def name_uuid(c: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cache_key(model: str, text: Column) -> Column:
    """Content hash of a model's input."""
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), text), 256)


def model_slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def prefixed(c: Column, kind: str) -> Column:
    """The embedder's input: ``query`` or ``passage`` stands before the text."""
    return F.concat(F.lit(f"{kind}: "), c)
