"""Text columns: tokens, language codes, tags, rule-based (de)tokenisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Blanks that separate words, line ends, and token classes.
BLANK = r"(?U)[\s\x{1c}-\x{1f}]"
BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|\r|\n"
ALPHA = r"^\p{L}+$"
DIGIT = r"^\p{Nd}+$"
SYMBOL = r"^[^\p{L}\p{Nd}]+$"
TAG = "LANG_TOK_"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def words(text: Column) -> Column:
    """Whitespace tokens; a blank text gives an empty array."""
    body = strip(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK + "+"))


def squeeze(text: Column) -> Column:
    return F.array_join(words(text), " ")


def is_alpha(word: Column) -> Column:
    return word.rlike(ALPHA)


def is_digit(word: Column) -> Column:
    return word.rlike(DIGIT)


def is_symbol(word: Column) -> Column:
    return word.rlike(SYMBOL)


def lang_short(code: Column) -> Column:
    """``en_XX`` -> ``en``."""
    return F.substring(code, 1, 2)


def lang_tag(code: Column) -> Column:
    """``en_XX`` -> ``LANG_TOK_EN``."""
    return F.concat(F.lit(TAG), F.upper(lang_short(code)))


def with_tag(text: Column, code: Column) -> Column:
    return F.concat(lang_tag(code), F.lit(" "), text)


def untag(text: Column) -> Column:
    """Drop the first blank-separated field; a text without a blank is kept."""
    return F.regexp_replace(text, "^[^ ]* ", "")


def untag_lang(text: Column, code: Column) -> Column:
    """Drop every ``LANG_TOK_XX `` of one language."""
    return F.replace(text, F.concat(lang_tag(code), F.lit(" ")), F.lit(""))


def postedit(text: Column, lang: Column) -> Column:
    """French output: paired straight quotes become guillemets."""
    return F.when(lang == "fr", F.regexp_replace(text, '"([^"]*)"', "« $1 »")).otherwise(text)


def scorer_tokenizer(lang: Column) -> Column:
    return F.when(lang == "zh", "zh").when(lang == "ja", "ja-mecab").otherwise("none")


def remove_bpe(text: Column, mark: str = "@@ ") -> Column:
    """Join subword units; the text is padded by one blank so a last mark also goes."""
    return F.rtrim(F.replace(F.concat(text, F.lit(" ")), F.lit(mark), F.lit("")))


def unpaste(text: Column, field: int) -> Column:
    """Field 1 or 2 of a ``source ||| target`` line."""
    return F.get(F.split(text, r" \|\|\| "), F.lit(field - 1))


def paste(src: Column, tgt: Column) -> Column:
    return F.concat(src, F.lit(" ||| "), tgt)


# Ordered (pattern, replacement) rules of the tokenizer.
TOKENIZE = [
    (r"[\x00-\x1f]", " "),
    (r"([^\p{L}\p{Nd}\s.'`,\-])", " $1 "),
    (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", "$1 @-@ $2"),
    (r"([\p{L}\p{Nd}])-([\p{L}\p{Nd}])", "$1 @-@ $2"),
    (r"([^\p{Nd}]),", "$1 , "),
    (r",([^\p{Nd}])", " , $1"),
    (r",$", " ,"),
    (r"\.$", " ."),
]
# A quote next to a non-letter stands alone; between letters it goes with one side.
LONE_QUOTE = [(r"(^|[^\p{L}])'", "$1 ' "), (r"'([^\p{L}]|$)", " ' $1")]
APOSTROPHE = {
    "fr": LONE_QUOTE + [(r"(\p{L})'(\p{L})", "$1' $2")],
    "en": LONE_QUOTE + [(r"(\p{L})'(\p{L})", "$1 '$2")],
    "": [(r"'", " ' ")],
}
# Undo the rules above, in this order.
DETOKENIZE = [
    (r" @-@ ", "-"),
    (r" ([.,!?;:%)\]}])", "$1"),
    (r"([(\[{¿¡]) ", "$1"),
]
DETOKENIZE_APOSTROPHE = {"fr": (r"(\p{L}') (\p{L})", "$1$2"), "en": (r"(\p{L}) ('\p{L})", "$1$2")}


def _apply(text: Column, rules) -> Column:
    for pattern, repl in rules:
        text = F.regexp_replace(text, pattern, repl)
    return text


def tokenize(text: Column, lang: Column) -> Column:
    """Separate punctuation, split hyphens between letters, then squeeze blanks."""
    base = _apply(text, TOKENIZE)
    by_lang = (
        F.when(lang == "fr", _apply(base, APOSTROPHE["fr"]))
        .when(lang == "en", _apply(base, APOSTROPHE["en"]))
        .otherwise(_apply(base, APOSTROPHE[""]))
    )
    return squeeze(by_lang)


def detokenize(text: Column, lang: Column) -> Column:
    base = _apply(text, DETOKENIZE)
    out = base
    for code in ("fr", "en"):
        out = F.when(lang == code, F.regexp_replace(base, *DETOKENIZE_APOSTROPHE[code])).otherwise(out)
    return F.trim(out)


def decode_pieces(pieces: Column) -> Column:
    """Subword pieces to text: concatenate, word mark to blank, trim."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" ")))
