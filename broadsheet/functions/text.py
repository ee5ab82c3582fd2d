"""Text columns: keys, matching forms, clean-up, shortening and display rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed


def squash(text: Column) -> Column:
    # A lone blank needs no replacement, and most white space is a lone blank.
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[^\S ]\s*", " "))


def fold_case(text: Column) -> Column:
    """Lower case plus the foldings that plain lower-casing leaves out."""
    lowered = F.lower(text)
    for source, target in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        lowered = F.replace(lowered, F.lit(source), F.lit(target))
    return lowered


def title_key(text: Column) -> Column:
    return F.regexp_replace(fold_case(text), r"[^\p{L}\p{N}_]", "")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize(text: Column) -> Column:
    # Matches every run of other characters except the lone blank that is already in place.
    runs = r" *[^a-z0-9一-鿿 ][^a-z0-9一-鿿]*| {2,}"
    return F.trim(F.regexp_replace(F.lower(text), runs, " "))


def padded(normal: Column) -> Column:
    """Normalised text with every word and ideograph standing between spaces.

    A Latin term bounded by non-alphanumerics is then a plain substring test for ' term ',
    which needs no regular expression per rule.
    """
    spaced = F.regexp_replace(normal, r"([一-鿿])", " $1 ")
    return F.concat(F.lit(" "), spaced, F.lit(" "))


def has_ideograph(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")


def contains_term(normal: Column, term: Column) -> Column:
    """Normalised term in normalised text: substring for CJK terms, whole words for Latin ones."""
    latin = padded(normal).contains(F.concat(F.lit(" "), term, F.lit(" ")))
    return (term != "") & F.when(has_ideograph(term), normal.contains(term)).otherwise(latin)


def py_normalize(text: str) -> str:
    """The same normal form for configuration values known when the plan is built."""
    return re.sub(r"[^a-z0-9一-鿿]+", " ", text.lower()).strip()


def term_in(normal: Column, padded_text: Column, term: str) -> Column:
    """contains_term for a configured term."""
    import re

    if not term:
        return F.lit(False)
    if re.search(r"[一-鿿]", term):
        return normal.contains(term)
    return padded_text.contains(f" {term} ")


def any_term(normal: Column, padded_text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | term_in(normal, padded_text, term)
    return found


def interest_terms(interest: str) -> list[str]:
    """A phrase, its words of two letters or more, and its known aliases."""
    phrase = py_normalize(interest)
    words = [w for w in phrase.split() if len(w) >= 2]
    aliases = [py_normalize(a) for a in fixed.INTEREST_ALIASES.get(phrase, [])]
    return [t for t in dict.fromkeys([phrase, *words, *aliases]) if t]


def interest_terms_column(interest: Column) -> Column:
    """interest_terms for interests held in a table."""
    phrase = normalize(interest)
    words = F.filter(F.split(phrase, " "), lambda w: F.length(w) >= 2)
    aliases = F.create_map(
        *[
            part
            for name, values in fixed.INTEREST_ALIASES.items()
            for part in (F.lit(name), F.array(*[F.lit(py_normalize(v)) for v in values]))
        ]
    )
    known = F.coalesce(F.try_element_at(aliases, phrase), F.array().cast("array<string>"))
    return F.array_distinct(
        F.filter(F.concat(F.array(phrase), words, known), lambda t: t != "")
    )


def pieces_of(name: Column) -> Column:
    """All substrings of a name that is not empty."""
    ends = lambda i: F.sequence(F.lit(1), F.length(name) - i + 1)
    starts = F.sequence(F.lit(1), F.length(name))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda n: F.substring(name, i, n)))))


def given(value: Column, use) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_tags(markup: Column) -> Column:
    """Visible text of a fragment: tags become spaces, common entities are decoded."""
    bare = F.regexp_replace(markup, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return squash(decode_entities(bare))


_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&amp;", "&"),
)


def decode_entities(text: Column) -> Column:
    for name, value in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


_MARKUP, _BLANKS = re.compile(r"(?s)<!--.*?-->"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_TAG, _LONG_BLANK = re.compile(r"<[^>]*>"), re.compile("  |[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def py_decode_entities(text: str) -> str:
    for name, value in _ENTITIES if "&" in text else ():
        text = text.replace(name, value)
    return text


def py_strip_tags(markup: str) -> str:
    """The same as strip_tags for a string."""
    if "<" in markup:
        markup = _TAG.sub(" ", _MARKUP.sub(" ", markup))
    markup = py_decode_entities(markup)
    # a lone blank needs no replacement, and most white space is a lone blank
    return (_BLANKS.sub(" ", markup) if _LONG_BLANK.search(markup) else markup).strip(" ")


def ordered_unique(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def truncate(text: Column, limit: int) -> Column:
    clean = F.trim(text)
    cut = F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def escape_markdown(text: Column) -> Column:
    return F.replace(
        F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1"), F.lit("\n"), F.lit(" ")
    )


def shorten(text: Column, limit: int = 100) -> Column:
    """Leading whole sentences that fit, else a marked extract."""
    clean = squash(text)
    sentences = F.split(clean, r"(?<=[。！？!?])\s*|(?<!\d)\.(?!\d)\s*")
    start = F.struct(F.lit("").alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, sentence: Column) -> Column:
        fits = acc["open"] & (F.length(acc["kept"]) + F.length(sentence) <= limit)
        return F.struct(
            F.when(fits, F.concat(acc["kept"], sentence)).otherwise(acc["kept"]).alias("kept"),
            fits.alias("open"),
        )

    kept = F.aggregate(sentences, start, step)["kept"]
    extract = F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(clean) <= limit, clean).when(kept != "", kept).otherwise(extract)


def fit(text: Column, limit: int = 100) -> Column:
    """Hard length guard that prefers a sentence end, then a clause end."""
    clean = squash(F.coalesce(text, F.lit("")))
    head = F.substring(clean, 1, limit)
    sentence = F.regexp_extract(head, r"^(?s)(.*[。！？!?])", 1)
    clause = F.regexp_extract(head, r"^(?s)(.*)[，,；;：:]", 1)
    tidy = lambda c, marks: F.concat(F.regexp_replace(c, marks, ""), F.lit("。"))
    return (
        F.when(F.length(clean) <= limit, clean)
        .when(F.length(sentence) > 40, F.trim(sentence))
        .when(F.length(clause) >= 50, tidy(clause, r"[，,；;：:、 ]+$"))
        .otherwise(tidy(F.substring(clean, 1, limit - 1), r"[，,；;：:、。！？!? ]+$"))
    )


def usable_summary(text: Column, title: Column) -> Column:
    clean = squash(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(clean, r"[^A-Za-z一-鿿]", ""))
    return (
        (F.length(clean) >= 12)
        & (clean != F.trim(title))
        & (letters >= 8)
        & ~F.lower(clean).isin(*fixed.UNUSABLE_SUMMARIES)
        & ~clean.startswith("Abstract page for arXiv paper")
        & ~clean.rlike(r"^[\d.+\-$]")
    )


def displayable_summary(text: Column, title: Column) -> Column:
    ideographs = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    return (
        usable_summary(text, title)
        & (F.length(text) <= 100)
        & (ideographs >= 6)
        & ~text.endswith("…")
        & ~text.endswith("...")
    )


def numbers(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(f"({fixed.NUMBER})"), F.lit(1))


def funding_rounds(title: Column) -> Column:
    found = F.regexp_extract_all(title, F.lit(fixed.FUNDING_ROUND), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda r: F.upper(r))))


def standard_numbers(text: Column) -> Column:
    """'YYT1234:2024' style keys of industry and national standards named in the text."""
    pattern = F.lit(fixed.STANDARD_NUMBER)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("p"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("n"),
        F.regexp_extract_all(text, pattern, F.lit(3)).alias("y"),
    )
    return F.transform(
        parts,
        lambda s: F.concat(
            F.regexp_replace(F.upper(s["p"]), r"\s|/", ""), s["n"], F.lit(":"), s["y"]
        ),
    )


def policy_document(title: Column, category: Column) -> Column:
    named = F.regexp_extract(title, f"({fixed.POLICY_DOCUMENT})", 1)
    return F.when(category == fixed.POLICY, title_key(named)).otherwise(F.lit(""))


def aliases(title: Column, summary: Column, category: Column, source_urls: Column) -> Column:
    """Fingerprints under which an item counts as already delivered or removed."""
    urls = F.transform(source_urls, lambda u: digest(F.concat(F.lit("url:"), u)))
    keyed = F.array(digest(F.concat(F.lit("title:"), title_key(title))))
    standards = F.transform(
        standard_numbers(F.concat_ws(" ", title, summary)),
        lambda s: digest(F.concat(F.lit("standard:"), s)),
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(urls, keyed, F.when(category == fixed.POLICY, standards).otherwise(none))
    )


def stars(score: Column) -> Column:
    halves = F.greatest(F.lit(0), F.least(F.lit(10), F.floor(score / 10 + 0.5))).cast("int")
    half = F.when(halves % 2 == 1, F.lit("☆")).otherwise(F.lit(""))
    return F.concat(F.repeat(F.lit("★"), F.floor(halves / 2).cast("int")), half)


def subject_first(text: Column, subject: Column) -> Column:
    lead = (subject != "") & ~F.startswith(text, subject)
    return F.when(lead, F.concat(subject, F.lit("："), text)).otherwise(text)


def product_name(source_name: Column) -> Column:
    bare = F.trim(F.regexp_replace(source_name, r"(?i)\s+Releases?$", ""))
    return F.when(bare == "", source_name).otherwise(bare)


def display_title(channel: Column, title: Column, source_id: Column, source_name: Column,
                  product_names: dict[str, str]) -> Column:
    known = F.lit(None).cast("string")
    for key, value in product_names.items():
        known = F.when(source_id == key, F.lit(value)).otherwise(known)
    bare = F.trim(F.regexp_replace(source_name, r" Releases$", ""))
    product = F.coalesce(known, F.when(bare == "", source_id).otherwise(bare))
    return F.when(channel == "products", F.concat(product, F.lit("："), title)).otherwise(title)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def clean_interests(values: Column) -> Column:
    """Collapse spaces, drop blanks and case-insensitive repeats, keep first spelling and order."""
    tidy = F.filter(F.transform(values, squash), lambda v: v != "")
    lowered = F.transform(tidy, lambda v: F.lower(v))
    return F.filter(tidy, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
