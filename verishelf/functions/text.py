"""Column expressions for product texts. All are built-in expressions; none needs Python workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verishelf.functions import vocab

# The patterns of sizes (SIZE) and tokens (TOKEN), and the seven of pack_count, decide what a description means.
UNITS = "|".join(sorted({**vocab.VOLUME, **vocab.MASS}, key=lambda u: (-len(u), u)))
#: A size: a number and a unit, not within a word or number.
SIZE = rf"(?iU)(?<![\w.])(\d+(?:[.,]\d+)?)\s*({UNITS})(?![a-zA-Z])"
TOKEN = r"(?U)[\w&%+.\-']+"


def words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it. No Python UDF may be in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trims any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null for no match."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\w&]", "")


def format_g(c: Column, digits: int = 6) -> Column:
    """A double as C's %g prints it: `digits` significant digits and no trailing zeros."""
    plain = F.format_string(f"%.{digits - 1}e", c)
    power = F.regexp_extract(plain, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(-?[\d.]+)e", 1), r"\.?0+$", "")
    places = F.greatest(F.lit(0), F.lit(digits - 1) - power).cast("int")
    number = F.when(power.between(-4, digits - 1), F.regexp_replace(F.regexp_replace(_fixed(c, places, digits), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    sign = F.when(power < 0, "-").otherwise("+")
    return F.when(c == 0, "0").otherwise(F.coalesce(number, F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))))


def _fixed(c: Column, places: Column, digits: int) -> Column:
    """c with that many decimals; the number varies by row, so each is an arm of a CASE."""
    out = F.format_string("%.0f", c)
    for k in range(1, digits + 5):
        out = F.when(places == k, F.format_string(f"%.{k}f", c)).otherwise(out)
    return out


# ---- record fields --------------------------------------------------------------------------


def clean_cell(c: Column) -> Column:
    """A cell read as text: blanks and nan/None markers are null, 123.0 is 123."""
    text = strip(c.cast("string"))
    text = F.when(~text.isin("", "nan", "None"), text)
    return F.when(text.rlike(r"^\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)


def external_code(c: Column) -> Column:
    return blank_to_null(strip(F.regexp_replace(clean_cell(c), "^'+", "")))


def int_key(c: Column) -> Column:
    return F.coalesce(clean_cell(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def barcode_corrupt(code: Column) -> Column:
    """Rounded by a spreadsheet: up to three digits and at least six zeros."""
    return F.coalesce(code.rlike(r"^\d{1,3}0{6,}$"), F.lit(False))


def barcode(code: Column) -> Column:
    return F.when(~barcode_corrupt(code), code)


def barcode_valid(code: Column) -> Column:
    return F.coalesce(F.length(code).isin(8, 12, 13, 14), F.lit(False))


def brand_name(raw: Column) -> Column:
    return F.coalesce(first_match(strip(raw), r"(?U)^(.+?)\s*\(([^)]+)\)\s*$", 1), strip(raw))


def brand_owner(raw: Column) -> Column:
    owner = first_match(strip(raw), r"(?U)^(.+?)\s*\(([^)]+)\)\s*$", 2)
    return F.when(owner.isNotNull(), strip(owner))


def countries(raw: Column) -> Column:
    return F.transform(F.split(raw, ","), strip)


def characteristic_name(raw: Column, alias: dict[str, str] | None = None) -> Column:
    name = strip(raw)
    plain = F.translate(F.upper(name), "/ ", "__")
    for old, new in (alias or {}).items():
        plain = F.when(name == old, new).otherwise(plain)
    return plain


def yes_no(c: Column) -> Column:
    """Y or N as a boolean; anything else fails."""
    return F.when(c == "Y", True).when(c == "N", False).otherwise(F.raise_error(F.concat(F.lit("neither Y nor N: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def open_close(c: Column) -> Column:
    return F.when(c.isin("Close", "Open-ended"), c).otherwise(F.raise_error(F.concat(F.lit("neither Close nor Open-ended: "), F.coalesce(c, F.lit("null")))))


def looks_garbled(c: Column) -> Column:
    """UTF-8 bytes that were once read as Latin-1."""
    return F.coalesce(c.rlike("^[\\x00-\\x{FF}]*$") & c.rlike("[\\x{C2}-\\x{F4}][\\x{80}-\\x{BF}]") & ~c.rlike("(?<![\\x{C2}-\\x{F4}\\x{80}-\\x{BF}])[\\x{80}-\\x{BF}]|[\\x{C2}-\\x{F4}](?![\\x{80}-\\x{BF}])"), F.lit(False))


# The characters that Windows-1252 has at bytes 80 to 9F, and the control characters with these numbers.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))


def repair_encoding(c: Column, rounds: int = 2) -> Column:
    """Mends UTF-8 that was read as Latin-1 or Windows-1252, up to `rounds` times over; other texts stay."""

    def once(x: Column) -> Column:
        raw = F.translate(x, WINDOWS, CONTROLS)
        return F.when(looks_garbled(raw), F.decode(F.encode(F.when(looks_garbled(raw), raw), "ISO-8859-1"), "UTF-8")).otherwise(x)

    for _ in range(rounds):
        c = let(c, once)
    return c


# ---- descriptions ---------------------------------------------------------------------------


def keep_words(parts: Column, retailer_words: Column) -> Column:
    """How many leading words stay when trailing ones that name the retailer, or nothing, go."""
    junk = lambda w: (alnum(w) != "") & F.array_contains(retailer_words, alnum(w))
    return F.coalesce(F.array_max(F.transform(parts, lambda w, i: F.when(junk(w), 0).otherwise(i + 1))), F.lit(0))


def without_repeats(desc: Column, pattern: Column, key) -> tuple[Column, Column]:
    """desc without later matches of the pattern whose key came before; and what was removed."""
    found = F.regexp_extract_all(desc, pattern, F.lit(0))
    keys = F.transform(found, key)
    again = lambda i: F.array_position(keys, F.element_at(keys, i + 1)) < i + 1
    parts = F.split(desc, pattern, -1)
    kept = F.transform(parts, lambda p, i: F.concat(p, F.when((i < F.size(found)) & ~again(i), F.try_element_at(found, i + 1)).otherwise("")))
    return F.when(F.size(found) > 1, F.array_join(kept, "")).otherwise(desc), F.filter(found, lambda m, i: again(i))


def size_key(m: Column) -> Column:
    return F.concat_ws("|", F.replace(F.regexp_extract(m, SIZE, 1), F.lit(","), F.lit(".")), F.lower(F.regexp_extract(m, SIZE, 2)))


def size_number(desc: Column) -> Column:
    return F.replace(first_match(desc, SIZE, 1), F.lit(","), F.lit(".")).cast("double")


def _factor(unit: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), unit)


def size_parts(desc: Column) -> dict[str, Column]:
    """value, ml, g of a text's first size: one match each for the number and the unit."""
    value, unit = size_number(desc), F.lower(first_match(desc, SIZE, 2))
    return {"value": value, "ml": value * _factor(unit, vocab.VOLUME), "g": value * _factor(unit, vocab.MASS)}


def size_ml(desc: Column) -> Column:
    return size_parts(desc)["ml"]


def size_g(desc: Column) -> Column:
    return size_parts(desc)["g"]


def size_unit(desc: Column) -> Column:
    return F.when(size_ml(desc).isNotNull(), "ml").when(size_g(desc).isNotNull(), "g")


def pack_count(desc: Column, claim_words: Sequence[str] = vocab.CLAIM_WORDS) -> Column:
    """The number of units; the first of seven patterns, by rank, that is there.

    Fixed values: "3 x" unless a claim follows, "x 3" unless a size follows, "pack of 3", "3 pack", "twin pack", "3's", "3 count".
    """
    claims = "|".join(claim_words)
    number = lambda pattern: first_match(desc, pattern).try_cast("int")
    return F.coalesce(
        number(rf"(?iU)\b(\d+)\s*x\b(?!\s*(?:{claims})(?![a-zA-Z]))"),
        number(rf"(?iU)\bx\s*(\d+)\b(?!\.\d)(?!\s*(?:{UNITS})\b)"),
        number(r"(?iU)\bpacks?\s+of\s+(\d+)\b"),
        number(r"(?iU)\b(\d+)\s*[-\s]?(?:pack|pk)s?\b"),
        F.when(desc.rlike(r"(?iU)\btwin\s*pack\b"), F.lit(2)),
        number(r"(?iU)\b(\d+)'?s\b"),
        number(r"(?iU)\b(\d+)\s*(?:count|ct)\b"),
    )


def format_hints(desc: Column, formats: Sequence[str] = vocab.FORMATS) -> Column:
    return F.array_intersect(F.transform(tokenize(desc), alnum), words(formats))


def variant_terms(desc: Column, brand: Column, owner: Column, stop: Sequence[str] = vocab.STOPWORDS, formats: Sequence[str] = vocab.FORMATS) -> Column:
    """What is left of the tokens without brand, owner, formats, stop words, numbers and sizes."""
    named = F.transform(F.concat(tokenize(F.coalesce(brand, F.lit(""))), tokenize(F.coalesce(owner, F.lit("")))), alnum)
    number = r"^\d+(?:[.,]\d+)?$"
    size = rf"(?iU)^\d+(?:[.,]\d+)?\s*({UNITS})$"
    content = F.filter(tokenize(desc), lambda t: ~t.rlike(number) & ~t.rlike(size) & ~alnum(t).rlike(r"(?U)^\d*$"))
    return F.array_except(F.transform(content, alnum), F.concat(named, words(formats), words(stop)))


def char_ngrams(c: Column, sizes: Sequence[int] = (4,)) -> Column:
    """All n-grams, repeats included, of the lower-cased text with runs of non-words as one space and
    a space on each side; each is tagged with its length."""
    padded = F.concat(F.lit(" "), strip(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " ")), F.lit(" "))
    none = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.concat(F.lit(f"{n}:"), F.substring(padded, i, F.lit(n))))).otherwise(none)

    return F.concat(*map(grams, sizes))
