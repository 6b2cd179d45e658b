"""Field cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value, and the order of product grades.
NULL_TOKENS = ("null", "none", "nil", "nan", "undefined")
GRADES = ("PS", "S", "A", "B", "C", "D")
GRADE_SUFFIX = "级"
#: Country names of the sources and their codes.
COUNTRIES = {
    "美国": "US", "日本": "JP", "德国": "DE", "英国": "GB", "法国": "FR", "西班牙": "ES", "墨西哥": "MX", "加拿大": "CA", "意大利": "IT",
    "澳大利亚": "AU", "中国": "CN", "巴西": "BR", "韩国": "KR", "荷兰": "NL", "波兰": "PL", "瑞典": "SE", "印度": "IN",
}
#: Spellings of one tag in several product lines.
SYNONYMS = {
    "产品包装品质": "包装品质", "产品包装外观": "包装外观", "产品包装完整性": "包装完整性", "噪音控制": "噪声控制", "标准螺丝接口": "标准螺纹接口",
    "vlog(含生活记录）": "Vlog", "vlog(含生活记录)": "Vlog", "产品瑕疵": "整体质量", "产品成色": "整体质量", "产品质量": "整体质量", "产品部件": "产品组件",
}
#: What separates the parts of a product code, letters of Latin words, characters of scripts without spaces.
CODE_SEPARATORS = r"[\s\x{2D}\x{AD}\x{2010}-\x{2015}\x{2212}\x{FE63}\x{FF0D}]+"
LATIN_WORD = r"^[A-Za-z\x{C0}-\x{FF}]+$"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"

_BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"
_SPACE = f"^{_BLANKS}|{_BLANKS}$"


def strip(c: Column) -> Column:
    """Without white space of any script at the ends; trim() takes blanks alone."""
    return F.regexp_replace(c, _SPACE, "")


def null_token(c: Column) -> Column:
    s = strip(c)
    return F.when((s == "") | F.lower(s).isin(*NULL_TOKENS), F.lit(None)).otherwise(s)


def fix_tail_repeat(c: Column) -> Column:
    """Drop what a truncated export repeats at the end.

    Text with CJK: the longest of 4 to 1 last characters that equal those before them, if more than that is left.
    Where a word or letters go, the words left are joined by single blanks.
    Other text: the last word if it equals the one before (any case), else 3 to 1 last letters of an all-letter
    last word of more than 4 that equal those before them. Under 4 characters nothing is dropped.
    """
    s = strip(c)
    n = F.length(s)
    tail = lambda x, k, skip=0: F.substring(x, F.length(x) - (k + skip) + 1, F.lit(k))
    cjk = s
    for k in (1, 2, 3, 4):  # the last branch built is tried first
        cjk = F.when((n > 2 * k) & (tail(s, k) == tail(s, k, k)), F.substring(s, F.lit(1), n - k)).otherwise(cjk)
    words = F.split(s, _BLANKS)
    last, before = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    front = F.slice(words, F.lit(1), F.size(words) - 1)
    low, m = F.lower(last), F.length(last)
    cut = s
    for k in (1, 2, 3):
        shorter = F.array_join(F.concat(front, F.array(F.substring(last, F.lit(1), m - k))), " ")
        cut = F.when((m > 2 * k) & (tail(low, k) == tail(low, k, k)), shorter).otherwise(cut)
    latin = F.when((F.size(words) > 1) & (low == F.lower(before)), F.array_join(front, " ")).when(last.rlike(LATIN_WORD) & (m > 4), cut).otherwise(s)
    return F.when(n < 4, s).when(s.rlike(CJK), cjk).otherwise(latin)


def parse_array(c: Column) -> Column:
    inner = F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", "")
    parts = F.filter(F.transform(F.split(inner, ","), strip), lambda v: v != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def normalize_code(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, CODE_SEPARATORS, "")), F.lit(""))


def clean_codes(c: Column) -> Column:
    """struct(spu, spu_raw, spu_unmatched): distinct codes in order of first sight, the raw values, those without a code."""
    raw = parse_array(c)
    codes = F.array_distinct(F.filter(F.transform(raw, normalize_code), lambda v: v.isNotNull()))
    return F.struct(codes.alias("spu"), raw.alias("spu_raw"), F.filter(raw, lambda v: normalize_code(v).isNull()).alias("spu_unmatched"))


def first_value(c: Column) -> Column:
    return F.try_element_at(parse_array(c), F.lit(1))


def scalar(c: Column) -> Column:
    """A single value in brackets; null if nothing is in them."""
    return F.nullif(strip(F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", "")), F.lit(""))


def country(c: Column) -> Column:
    x = strip(F.split_part(scalar(c), F.lit(","), F.lit(1)))
    known = F.element_at(F.create_map(*[v for k, w in COUNTRIES.items() for v in (F.lit(k), F.lit(w))]), x)
    return F.coalesce(known, F.when(F.length(x) <= 3, F.upper(x)).otherwise(x))


def own_brand(c: Column, marker: str = "本品") -> Column:
    """Null where nothing is named, else whether any value holds the marker."""
    parts = parse_array(c)
    return F.when(F.size(parts) > 0, F.exists(parts, lambda v: v.contains(marker)))


def grade_rank(v: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, GRADES)), F.regexp_replace(v, GRADE_SUFFIX + "$", ""))
    return F.when(at > 0, at).otherwise(F.lit(len(GRADES) + 1).cast("long"))


def highest_grade(c: Column) -> Column:
    return F.array_min(F.transform(parse_array(c), lambda v, i: F.struct(grade_rank(v).alias("r"), i.alias("i"), v.alias("v"))))["v"]


def tax_levels(path: Column) -> Column:
    """struct(stage, domain, sub, leaf): positions 2 to 5, an empty slot null and not closed up."""
    part = lambda n: F.nullif(F.trim(F.split_part(path, F.lit("/"), F.lit(n))), F.lit(""))
    return F.struct(*[part(i + 2).alias(x) for i, x in enumerate(("stage", "domain", "sub", "leaf"))])


def synonym(c: Column, mapping: dict[str, str] = SYNONYMS) -> Column:
    s = strip(c)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), s), s) if mapping else s


def prod_line(lines: Column) -> Column:
    n = F.size(F.array_distinct(lines))
    return F.when(n == 1, F.element_at(lines, 1)).when(n > 1, "common").otherwise("undetermined")


def assemble(*fields: Column, limit: int = 800) -> Column:
    """Distinct non-blank fields joined by new lines, at most ``limit`` characters: what a classifier reads."""
    told = F.filter(F.transform(F.array(*fields), strip), lambda v: v.isNotNull() & (v != ""))
    return F.substring(F.array_join(F.array_distinct(told), "\n"), 1, limit)


def triples(tags: Column, sentiments: Column, snippets: Column) -> Column:
    """Three parallel arrays zipped by position: short ones give nulls, nothing beyond the tags."""
    return F.slice(F.arrays_zip(tags.alias("tag"), sentiments.alias("sentiment"), snippets.alias("snippet")), 1, F.size(tags))


def misaligned(tags: Column, sentiments: Column) -> Column:
    return (F.size(tags) > 0) & (F.size(tags) != F.size(sentiments))


def json_object(c: Column) -> Column:
    """The outermost braces of a text, parsed; null where that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))
