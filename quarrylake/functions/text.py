"""Text functions: tokens, lexical terms, identifiers, slugs, snippets, fingerprints and path classes, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The token grammar and connector variants.
CONNECTORS = "._/'-"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[._/'-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*"
CONNECTOR_RUN = r"[._/'-]+"
# what a token has that is more than one word
COMPOUND = r"[._/'-]|[\p{Ll}\p{N}]\p{Lu}"
# where a text may have it; begins with rare characters, so that most are passed at once
MAYBE_COMPOUND = r"[._/'\-\p{Lu}](?:(?<=[._/'-])(?=[\p{L}\p{N}])|(?<=[\p{Ll}\p{N}]\p{Lu}))"
APOSTROPHES, DASHES = "ʼ’", "‐‑‒–—―−"

# Words that no exact lane looks for.
STOPWORDS = ("about", "after", "and", "are", "but", "does", "for", "from", "has", "have", "how", "into", "not", "the", "that", "this", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you")

# Classes of paths.
DOCUMENTATION_DIRECTORIES = ("doc", "docs", "documentation")
DOCUMENTATION_EXTENSIONS = (".adoc", ".markdown", ".md", ".mdx", ".rst", ".txt")
TEST_DIRECTORIES = ("__mocks__", "__tests__", "fixtures", "spec", "specs", "test", "testdata", "tests")
TEST_FILE = r"(^|[._-])(spec|test)s?\.[^.]+$"
DOCUMENTATION_TERMS = ("adoc", "doc", "docs", "documentation", "guide", "markdown", "md", "mdx", "readme", "rst")
TEST_TERMS = ("__mocks__", "__tests__", "fixture", "fixtures", "mock", "mocks", "spec", "specs", "test", "testdata", "tests")
SIDE_EFFECT_KINDS = ("constructor", "function", "method")
SIDE_EFFECT_TERMS = ("activate", "apply", "clear", "close", "delete", "dismiss", "erase", "invalidate", "logout", "perform", "purge", "remove", "reset", "revoke", "save", "sync", "terminate", "update", "wipe")
KIND_ORDER = ("class", "interface", "protocol", "struct", "enum", "type_alias", "function", "method", "constructor", "module", "package", "field", "property")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def canonical_connectors(text: Column) -> Column:
    """One apostrophe, one dash. Input is taken as NFC (see versions.nfc for other input)."""
    # most texts have none of them: a look for their bytes spares these the walk over characters
    has = reduce(lambda a, b: a | b, [text.contains(c) for c in APOSTROPHES + DASHES])
    return F.when(has, F.translate(text, APOSTROPHES + DASHES, "''" + "-" * len(DASHES))).otherwise(text)


def raw_tokens(text: Column) -> Column:
    """Words and compound identifiers of any length."""
    return F.regexp_extract_all(canonical_connectors(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_token(t: Column) -> Column:
    """3 characters or more, or 2 with a letter outside ASCII."""
    return (F.length(t) >= 3) | ((F.length(t) == 2) & t.rlike(r"\p{L}") & t.rlike(r"[^\x00-\x7F]"))


def tokens(text: Column) -> Column:
    return F.filter(raw_tokens(text), is_token)


def token_parts(t: Column) -> Column:
    """The lower-case components between a token's connectors and capitals, but not the token itself."""
    low = F.lower(t)
    parts = F.transform(F.split(F.regexp_replace(t, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), CONNECTOR_RUN), F.lower)
    return F.filter(parts, lambda p: (F.length(p) >= 2) & (p != low))


def token_terms(t: Column) -> Column:
    """The lower-case token, then the components between its connectors."""
    # most tokens are plain words: one test spares them the split
    return F.when(t.rlike(COMPOUND), F.concat(F.array(F.lower(t)), token_parts(t))).otherwise(F.array(F.lower(t)))


def compound_parts(text: Column) -> Column:
    """The components of all compound tokens of a text of canonical connectors: what lexical_terms has beside the tokens. Texts without any are not split."""
    opened = F.flatten(F.transform(F.filter(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), is_token), lambda t: t.rlike(COMPOUND)), token_parts))
    return F.when(text.rlike(MAYBE_COMPOUND), opened).otherwise(F.array().cast("array<string>"))


def lexical_terms(text: Column) -> Column:
    """Lower-case tokens, each followed by the components between its connectors."""
    return F.flatten(F.transform(tokens(text), token_terms))


def normalized_terms(text: Column) -> Column:
    """At most 32 distinct symbol terms: camel case is opened, runs of letters, digits and _ $ . - of 2 or more."""
    opened = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(opened), F.lit(r"[\p{L}\p{N}_$.-]{2,}"), F.lit(0))), 1, 32)


def cased_identifiers(text: Column) -> Column:
    """Identifiers with inner capitals, underscores or digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.rlike(r"[a-z0-9][A-Z]|_|[0-9]")))


def document_identifiers(text: Column) -> Column:
    return F.slice(cased_identifiers(text), 1, 64)


def identities(text: Column) -> Column:
    """Paths, dotted names and cased identifiers of a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_$][\p{L}\p{N}_$./#:-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.rlike(r"[./#]|[a-z0-9][A-Z]|_")))


def identity_selectors(text: Column) -> Column:
    """At most 8 of these, in order, of a longer query."""
    return F.slice(identities(text), 1, 8)


def exact_term_score(term: Column) -> Column:
    """Length, +8 with a capital, +6 with a digit or punctuation."""
    return F.length(term) + F.when(term.rlike(r"\p{Lu}"), 8).otherwise(0) + F.when(term.rlike(r"[\p{N}._/'-]"), 6).otherwise(0)


def exact_terms(query: Column, limit: int = 4) -> Column:
    """The most distinctive tokens of a query: 4 characters or more (3 if distinctive), no stopwords, best first, ties by text."""
    kept = F.filter(F.array_distinct(tokens(query)), lambda t: ~F.lower(t).isin(*STOPWORDS) & ((F.length(t) >= 4) | ((F.length(t) == 3) & t.rlike(r"[\p{Lu}\p{N}]"))))
    ranked = F.array_sort(F.transform(kept, lambda t: F.struct((-exact_term_score(t)).alias("s"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda x: x.t), 1, limit)


def strip_anchor(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def uri_slug(uri: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(strip_anchor(uri), r"(?i)\.[a-z0-9]+$", ""), "/", -1))


def slug_names_term(slug: Column, term: Column) -> Column:
    """The slug has the term as a whole token."""
    return F.concat(F.lit("-"), F.regexp_replace(slug, r"[^a-z0-9]+", "-"), F.lit("-")).contains(F.concat(F.lit("-"), F.regexp_replace(F.lower(term), r"[^a-z0-9]+", "-"), F.lit("-")))


def snippet(text: Column, width: int = 180) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("…"))).otherwise(flat)


def query_fingerprint(query: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))), 256)


def path_class(path: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda s: s != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    folders = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.when(extension.isin(*DOCUMENTATION_EXTENSIONS) | F.arrays_overlap(folders, strings(DOCUMENTATION_DIRECTORIES)), "documentation").when(F.arrays_overlap(folders, strings(TEST_DIRECTORIES)) | name.rlike(TEST_FILE), "test").otherwise("implementation")


def path_multiplier(path: Column, query_terms: Column) -> Column:
    """Documentation .55 and tests .7, unless the query asks for them."""
    c = path_class(path)
    asks = F.when(c == "test", F.arrays_overlap(query_terms, strings(TEST_TERMS))).otherwise(F.arrays_overlap(query_terms, strings(DOCUMENTATION_TERMS)))
    return F.when((c == "implementation") | asks, 1.0).when(c == "test", 0.7).otherwise(0.55)


def search_multiplier(path: Column, kind: Column, name: Column, query_terms: Column) -> Column:
    """path_multiplier, times 1.12 for implementation members named after a side effect."""
    words = F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    owner = (path_class(path) == "implementation") & ~F.arrays_overlap(query_terms, strings(TEST_TERMS + DOCUMENTATION_TERMS)) & kind.isin(*SIDE_EFFECT_KINDS) & F.arrays_overlap(words, strings(SIDE_EFFECT_TERMS))
    return path_multiplier(path, query_terms) * F.when(owner, 1.12).otherwise(1.0)


def kind_order(kind: Column) -> Column:
    at = F.array_position(strings(KIND_ORDER), kind)
    return F.when(at > 0, at - 1).otherwise(len(KIND_ORDER)).cast("int")


def category_of(uri: Column) -> Column:
    return F.when(uri.contains("/memories/"), "memories").when(uri.contains("/agent-skills/"), "skills").otherwise("resources")


def is_excluded_uri(uri: Column) -> Column:
    return uri.rlike(r"\.(overview|abstract)\.md(#|$)")


def sanitize(text: Column) -> Column:
    """Control characters become spaces."""
    return F.regexp_replace(text, r"[\p{Cntrl}&&[^\n\t]]", " ")


def markdown_outline(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"^#{1,6} "))


def claims(text: Column, limit: int = 16) -> Column:
    """Distinct sentences outside fences and headings, bullets stripped."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " "), r"(?m)^#{1,6} .*$", " ")
    body = F.regexp_replace(body, r"(?m)^[ \t]*([-*+]|\d+[.)])[ \t]+", "")
    parts = F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: s != "")), 1, limit)


NEGATION = r"(?i)\b(not|never|no longer|cannot|don't|doesn't|isn't|aren't|won't|without)\b"


def without_negation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, NEGATION, " "), r"\s+", " "))


def is_denied(text: Column) -> Column:
    return text.rlike(NEGATION)


def basis_tokens(text: Column) -> Column:
    """Distinct lower-case words of 3 characters or more."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)))


def similarity_milli(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) + F.size(b)) > 0, F.round(F.lit(1000.0) * both / (F.size(a) + F.size(b) - both))).otherwise(0.0).cast("int")


def natural_key(text: Column) -> Column:
    """Digit runs compare as numbers: runs padded to 20 digits."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(r, 20, "0")).otherwise(r)), "")


def redact(text: Column) -> Column:
    """Home folders, addresses and key-like runs give way to a mark."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(/Users|/home)/[^/\s]+", "$1/~"), r"[\w.+-]+@[\w-]+\.[\w.]+", "[mail]"), r"\b[A-Za-z0-9+/_-]{32,}\b", "[key]")


_ISO = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"


def iso_utc(text: Column) -> Column:
    """A time in one of the ISO 8601 forms (year, month, day, minute or second; with or without a zone, which is then UTC) as yyyy-MM-ddTHH:mm:ss.SSSZ, cut to milliseconds; null for any other text and for days and times that do not exist."""
    t = F.trim(text)
    part = lambda k, default: F.when(F.regexp_extract(t, _ISO, k) == "", default).otherwise(F.regexp_extract(t, _ISO, k))
    number = lambda k, default: part(k, default).cast("int")
    zone = F.regexp_replace(F.regexp_extract(t, _ISO, 8), ":", "")
    minutes = F.when(zone.isin("", "Z"), 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1))
    second = F.concat(part(6, "0"), F.substring(F.concat(F.regexp_extract(t, _ISO, 7), F.lit("")), 1, 4)).try_cast("decimal(16,6)")
    at = F.try_make_timestamp_ntz(number(1, "0"), number(2, "1"), number(3, "1"), number(4, "0"), number(5, "0"), second)
    fits = t.rlike(_ISO) & (F.abs(minutes) < 24 * 60) & (second < 60)
    return F.when(fits, F.date_format(at - F.make_dt_interval(F.lit(0), F.lit(0), minutes), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
