"""Null predicates and identity keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as no value, by family of tables.
EMPTY_WORDS_STATISTICS = ("nan", "none", "null", "<na>")
EMPTY_WORDS_PARSING = ("nan", "none", "null")
#: Tokens that only say which stage wrote a file.
STAGE_SUFFIXES = ("parsed", "parse", "annotations", "annotation", "output", "out")
#: Unicode white space, as Spark's trim removes plain spaces only.
_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _EDGES, "")


def nonempty(c: Column) -> Column:
    """Not blank and not a word for no value (statistics tables)."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return s.rlike(r"(?U)\S") & ~s.rlike(rf"(?iU)^\s*({'|'.join(EMPTY_WORDS_STATISTICS)})\s*$")


def nonblank(c: Column) -> Column:
    """Not blank (signing-space tables)."""
    return strip(F.coalesce(c.cast("string"), F.lit(""))) != ""


def clean_cell(c: Column) -> Column:
    """A stripped cell; blanks and words for no value become empty (parsing tables)."""
    s = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(*EMPTY_WORDS_PARSING), "").otherwise(s)


def file_key(name: Column) -> Column:
    """Identity of a recording: alphanumeric tokens of the stem without trailing stage words, joined in lower case."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    words = F.regexp_replace(F.lower(F.regexp_replace(stem, r"[^A-Za-z0-9]+", " ")), r"^ +| +$", "")
    trailing = rf"( ({'|'.join(STAGE_SUFFIXES)}))+$"
    return F.replace(F.regexp_replace(words, trailing, ""), F.lit(" "), F.lit(""))


def region_of(name: Column) -> Column:
    """Region code: what stands before the first underscore of the stem, in upper case."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.upper(F.split_part(stem, F.lit("_"), F.lit(1)))


def signer_stem(name: Column) -> Column:
    """XX_NN for names that start with two letters and a number; other text as it is."""
    pattern = r"^([A-Za-z]{2})[ _-]?0*(\d+)"
    number = F.regexp_extract(name, pattern, 2)
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.when(name.rlike(pattern), F.concat(F.upper(F.regexp_extract(name, pattern, 1)), F.lit("_"), padded)).otherwise(name)


def participant_of_tier(tier: Column) -> Column:
    """What stands before the word-tier marker of a tier id."""
    return F.regexp_replace(F.regexp_replace(tier, r"(?i)[-_]?Word[-_ ]?jp.*$", ""), r"^[-_ ]+|[-_ ]+$", "")


def signer_key(name: Column) -> Column:
    """Upper-case tokens joined by underscores, without leading zeros of numbers."""
    tokens = F.regexp_replace(F.upper(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")
    return F.regexp_replace(tokens, r"(?<![0-9])0+(?=[0-9])", "")


def clip_key(path: Column) -> Column:
    """A clip's name for exclusion lists: no quotes, forward slashes, no extension, trimmed, in lower case."""
    s = F.replace(F.translate(strip(path), "\"'", ""), F.lit("\\"), F.lit("/"))
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,4}$", ""), r"^/+|/+$", ""))


def hms(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS, seconds rounded half to even."""
    s = F.bround(ms / 1000.0).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def alnum_lower(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


# Full-width digits, keyword spellings in the order in which they are replaced, marks.
_WIDE_DIGITS = "０１２３４５６７８９"
KEYWORD_SPELLINGS = (("ｆａｌ", "FAL"), ("ＦＡＬ", "FAL"), ("口形", "M"), ("口型", "M"), ("ｍ", "M"), ("Ｍ", "M"))
_NOT_LETTER = "A-Za-z"


def normalise_digits(c: Column) -> Column:
    """Full-width digits as ASCII digits."""
    return F.translate(c, _WIDE_DIGITS, "0123456789")


def drop_first_tilde(c: Column) -> Column:
    """Without the first tilde of any width."""
    return F.regexp_replace(c, r"^([^˜~〜]*)[˜~〜]", "$1")


def drop_exclamations(c: Column) -> Column:
    """Without exclamation marks."""
    return F.translate(c, "!！", "")


def normalise_keywords(c: Column) -> Column:
    """One spelling for each keyword."""
    for old, new in KEYWORD_SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(c, "(?i)dr", "dw"), r"(?i)(?<![\p{L}\p{N}_])REPEAT(?![\p{L}\p{N}_])", "REP")


def drop_leading_slashes(c: Column) -> Column:
    """Without slashes that only open an annotation."""
    return strip(F.regexp_replace(c, r"(?U)^\s*/+", ""))


def normalise_slashes(c: Column) -> Column:
    """Slashes between parts become plus signs; plus signs and slashes at the edges go."""
    s = F.replace(strip(c), F.lit("／"), F.lit("+"))
    lead = s.startswith("/")
    body = F.when(lead, F.substr(s, F.lit(2))).otherwise(s)
    for pattern, new in ((r"/+$", ""), (r"(?U)\s*/\s*", "+"), (r"(?U)^\s*\++\s*", ""), (r"(?U)\s*\++\s*$", "")):
        body = F.regexp_replace(body, pattern, new)
    return F.concat(F.when(lead, "/").otherwise(""), strip(body))


def normalise_annotation(c: Column) -> Column:
    """The spelling under which annotations are compared and parsed."""
    c = drop_leading_slashes(normalise_keywords(drop_exclamations(drop_first_tilde(F.coalesce(c, F.lit(""))))))
    return strip(normalise_slashes(F.translate(c, "&＋", "++")))


def without_compound_marks(c: Column) -> Column:
    """Without angle brackets of either width."""
    return F.translate(c, "<>＜＞", "")


def has_compound_open(c: Column) -> Column:
    """Holds an opening angle bracket."""
    return c.rlike("[<＜]")


def has_compound_close(c: Column) -> Column:
    """Holds a closing angle bracket."""
    return c.rlike("[>＞]")


def too_many_slashes(c: Column) -> Column:
    """More than one slash, and not just a pair around a text without any."""
    s = strip(c)
    wrapped = s.rlike(r"(?Us)^/[^/]+/$") & (strip(F.translate(s, "/", "")) != "")
    return (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) > 1) & ~wrapped


#: Everything that a resolved lexical item may hold.
_ALLOWED = r"぀-ゟ゠-ヿ一-鿿ー々〆〤0-9０-９、。，．〒「」”“\"：:\s＋+\-−\(\)（）\[\];"


def has_residue(c: Column) -> Column:
    """Holds characters that no lexical item should; pointing signs, ok and bracketed letters are fine."""
    only_known = F.forall(F.filter(F.transform(F.split(c, ";"), strip), lambda p: p != ""), lambda p: p.rlike("(?i)^(ok|pt[0-9]*)$"))
    rest = F.regexp_replace(F.regexp_replace(c, r"(?iU)(^|;)\s*pt[0-9]*\s*(?=;|$)", ";"), r"\[[A-Za-z]+\]", "[]")
    some = strip(F.translate(c, ";", "")) != ""
    return F.when(some & only_known, False).otherwise(rest.rlike(f"(?U)[^{_ALLOWED}]"))


def blocking_flag(c: Column) -> Column:
    """The blocking marker that an annotation opens or closes with, in lower case; null without one."""
    s = F.regexp_replace(strip(c), "^/+", "")
    first = F.regexp_extract(s, r"(?i)^(FAL|UN|D)(?![A-Za-z])", 1)
    last = F.regexp_extract(s, r"(?iU)[\(（]\s*(FAL|UN|D)\s*[\)）]\s*$", 1)
    return F.lower(F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))


def token_flag(c: Column, word: str) -> Column:
    """Holds a word that no Latin letters touch."""
    return c.rlike(rf"(?i)(^|[^{_NOT_LETTER}]){word}([^{_NOT_LETTER}]|$)")


def question_flag(c: Column) -> Column:
    """Marked as a question."""
    return c.rlike("[?？]") | token_flag(c, "QM")


def lexical_components(c: Column) -> Column:
    """Parts between commas of any kind, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)[、,，]\s*"), strip), lambda p: p != "")


def pointing_item(pt: Column) -> Column:
    """Lexical item of a pointing value list: pt with the first number, if it is not 0."""
    values = F.filter(F.transform(F.split(F.coalesce(pt, F.lit("")), ";"), lambda v: normalise_digits(strip(v))), lambda v: v != "")
    number = F.element_at(F.concat(F.filter(values, lambda v: v.rlike("^[0-9]+$")), F.array(F.lit("0"))), 1)
    return F.when(F.size(values) == 0, "").when(number == "0", "pt").otherwise(F.concat(F.lit("pt"), number))


def split_outside_brackets(c: Column, separator: str) -> Column:
    """Parts between separators that stand outside all brackets, stripped, blanks dropped.

    A fold over the characters keeps the depth (never below 0) and marks the separators at depth 0.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("（", "(", "{", "｛"), state["depth"] + 1).when(ch.isin("）", ")", "}", "｝"), F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        kept = F.when((ch == separator) & (state["depth"] == 0), "\u0000").otherwise(ch)
        return F.struct(depth.alias("depth"), F.concat(state["out"], kept).alias("out"))

    marked = F.aggregate(F.split(c, ""), start, step, lambda s: s["out"])
    return F.filter(F.transform(F.split(marked, "\u0000"), strip), lambda p: p != "")


def safe_tier_id(c: Column) -> Column:
    """An identifier of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
