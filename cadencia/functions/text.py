"""Text functions as columns: Arabic normalisation, stems, units, tails, languages, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Affixes in the order in which they are tried.
PREFIXES = ("وال", "فال", "كال", "بال", "لل", "ال")
SUFFIXES = ("ات", "ين", "ون", "ها", "هم", "هن", "كم", "نا", "يه", "ية")
#: Diacritics and tatweel.
MARKS = "[ؐ-ًؚ-ْۖ-ۭـ]"
#: Units of strength, forms of dosage.
UNITS = "mg|g|gm|mcg|μg|iu|ml|%"
FORMS = "tab|tabs|cap|caps|tablet|tablets|capsule|capsules|sachet|sachets|drop|drops|puff|puffs|pen|pens|vial|vials|amp|amps|susp|suspension|syrup|ml"
STRENGTH = rf"(?i)(\d+(?:\.\d+)?\s*(?:{UNITS})(?![a-z]))"


def normalize_arabic(c: Column, collapse: bool = False) -> Column:
    """Without diacritics and tatweel, letter variants unified; collapse cuts runs of three or more of a letter to two."""
    bare = F.regexp_replace(c, MARKS, "")
    plain = F.translate(bare, "إأآةىؤئ", "اااهيوي")
    return F.trim(F.regexp_replace(plain, r"(.)\1{2,}", "$1$1") if collapse else plain)


def light_stem(c: Column) -> Column:
    """Words over three letters lose the first prefix and then the first suffix that leave at least three."""

    def first(word: Column, affixes: tuple[str, ...], front: bool) -> Column:
        out = word
        for a in reversed(affixes):
            rest = F.length(word) - len(a)
            cut = F.substring(word, F.lit(len(a) + 1), rest) if front else F.substring(word, F.lit(1), rest)
            out = F.when((F.startswith(word, F.lit(a)) if front else F.endswith(word, F.lit(a))) & (rest >= 3), cut).otherwise(out)
        return out

    return F.when(F.length(c) <= 3, c).otherwise(first(first(c, PREFIXES, True), SUFFIXES, False))


def normalize_line(c: Column) -> Column:
    """Lower case, numbers and letters apart, single blanks, gm as g."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d)([a-z])", "$1 $2"), r"([a-z])(\d)", "$1 $2")
    return F.regexp_replace(F.trim(F.regexp_replace(apart, r"\s+", " ")), r"\bgm\b", "g")


def strip_sig_tail(c: Column) -> Column:
    """Without a dosing tail (- 1 tab BID), a leading list number and extra blanks."""
    tail = F.regexp_replace(F.trim(c), rf"(?i)\s*[-–]\s*\d+\s*(?:{FORMS})(?![a-z]).*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(tail, r"^\s*\d+[.)]\s*", ""), r"\s+", " "))


def strength_token(c: Column) -> Column:
    """The last strength in the text without blanks, grams in mg; null without one."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(STRENGTH), F.lit(1)), F.lit(-1))
    token = F.lower(F.regexp_replace(last, r"\s+", ""))
    grams = F.regexp_extract(token, r"^(\d+(?:\.\d+)?)(?:g|gm)$", 1)
    mg = F.regexp_replace((F.try_to_number(grams, F.lit("9999999.999")) * 1000).cast("string"), r"\.0+$", "")
    return F.when(grams != "", F.concat(F.regexp_replace(mg, r"(\.\d*?)0+$", "$1"), F.lit("mg"))).otherwise(token)


def quantity_tail(c: Column) -> Column:
    """A trailing count of at most 300 after a dash, star or x."""
    n = F.regexp_extract(F.trim(c), r"[\s\-–—*xX×]+(\d{1,3})\s*$", 1)
    return F.when((n != "") & (n.cast("int") <= 300), n.cast("int"))


def dosage_form(c: Column) -> Column:
    found = F.lower(F.regexp_extract(c, r"(?i)\b(tablets?|tabs?|capsules?|caps?|syrup|suspension|susp|drops?|cream|gel|ointment|vials?|ampoules?|inhaler|sachets?)\b", 1))
    return F.nullif(found, F.lit(""))


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9-]", "-"), "-+", "-"))


def script_language(c: Column, ties: str = "Mixed") -> Column:
    arabic, latin = F.regexp_count(c, F.lit("[؀-ۿ]")), F.regexp_count(c, F.lit("[a-zA-Z]"))
    return F.when(arabic > latin, "Arabic").when(latin > arabic, "English").otherwise(ties)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def fingerprint(c: Column) -> Column:
    return F.md5(F.lower(F.trim(c)))


def loose_fingerprint(c: Column) -> Column:
    """md5 without punctuation, digits and extra blanks."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\p{N}+", "")
    return F.md5(F.trim(F.regexp_replace(letters, r"\s+", " ")))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def labelled_field(c: Column, label: str) -> Column:
    """The value after `LABEL:` up to the end of its line, null without one."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^\s*{label}\s*:\s*(.*)$", 1)), F.lit(""))


def fenced_json(c: Column, schema: str) -> Column:
    """A JSON object, with or without a code fence around it; null if it can't be read."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(body, schema)


def json_or_fields(c: Column, *names: str) -> Column:
    """A struct of texts: each field from the (fenced) JSON object, or, where that can't be read, from a `"name": value` in the text."""
    read = fenced_json(c, ", ".join(f"`{n}` string" for n in names))
    loose = lambda n: F.nullif(F.trim(F.regexp_extract(c, rf'"{n}"\s*:\s*"?([^",}}\n]*)', 1)), F.lit(""))
    return F.struct(*(F.coalesce(read[n], loose(n)).alias(n) for n in names))


def line_fields(c: Column) -> Column:
    """Strength, form and quantity that stand in a product line, and its text without a dosing tail."""
    return F.struct(strip_sig_tail(c).alias("text"), strength_token(c).alias("strength"), dosage_form(c).alias("form"), quantity_tail(c).alias("quantity"))


def count_words(c: Column, words) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def last_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


def truncated(c: Column, most: int = 1500) -> Column:
    return F.trim(F.substring(F.trim(c), 1, most))


def price_after_discount(price: Column, quantity: Column, per_cent: Column) -> Column:
    return F.bround(price * quantity * (1 - per_cent / 100), 2)


def boxes_needed(per_day: Column, days: Column, per_box: Column) -> Column:
    return F.ceil(per_day * days / F.greatest(per_box, F.lit(1)))
