"""Scalar expressions over formulas, names, servers, paths and versions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -----------------------------------------------------------
# Functions that expose who is looking at the workbook.
USER_IDENTITY_FUNCTIONS = ("USERNAME", "ISUSERNAME", "ISMEMBEROF", "FULLNAME", "USERDOMAIN")

# Field-name vocabulary by label, in order of precedence.
PII_TERMS = {
    "ssn": r"ssn|social[\s_-]?security(?:[\s_-]?number)?",
    "dob": r"dob|date[\s_-]?of[\s_-]?birth|birth[\s_-]?date",
    "email": r"email(?:[\s_-]?address)?|e[\s_-]?mail",
    "phone": r"phone(?:[\s_-]?number)?|mobile(?:[\s_-]?number)?|telephone",
    "address": r"(?:street|home|mailing|residential)[\s_-]?address|(?:postal|zip)[\s_-]?code",
    "credit_card": r"credit[\s_-]?card|cc[\s_-]?(?:num|number)|primary[\s_-]?account[\s_-]?number"
                   r"|pan[\s_-]?number|card[\s_-]?pan",
    "medical": r"mrn|medical[\s_-]?record(?:[\s_-]?number)?|diagnosis(?:[\s_-]?code)?",
    "personal_name": r"(?:first|last|middle|maiden|given|family|sur)[\s_-]?name|full[\s_-]?name",
    "ip_address": r"ip[\s_-]?address|ip[\s_-]?addr|(?:ip4|ip6|ipv4|ipv6)[\s_-]?address",
}

# Servers that never count as external.
APPROVED_SERVER = r"(?i)^(localhost|127\.0\.0\.1|(.+\.)?internal\.example\.com)$"

# Files below somebody's own profile folder.
PROFILE_PATH = r"^(?:[A-Za-z]:\\(?i:Users)\\|/home/[^/]+/|/Users/[^/]+/)"

COLUMN_REFERENCE = r"(\[[^\[\]\r\n]+\])"
# -----------------------------------------------------------------------------

def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; a column of its own would copy the whole row one more time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def calls_function(formula: Column, names: Iterable[str]) -> Column:
    """True where the formula calls one of the functions, in any letter case."""
    # Few formulas call anything: a search for the bracket settles the others.
    return formula.contains("(") & formula.rlike(rf"(?iU)\b(?:{'|'.join(names)})\s*\(")


def references_user_identity(formula: Column) -> Column:
    return F.coalesce(calls_function(formula, USER_IDENTITY_FUNCTIONS), F.lit(False))


def normalize_formula(formula: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    # Single plain blanks, by far the most white space, need no replacement.
    return F.lower(F.trim(F.regexp_replace(formula, r"(?U)\s{2,}|[^\S ]", " ")))


def column_references(formula: Column) -> Column:
    """Distinct bracketed column references of a formula."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit(COLUMN_REFERENCE), F.lit(1)))


def field_words(name: Column, caption: Column) -> Column:
    """Name and caption as plain words: brackets gone, ``_`` and ``-`` as blanks."""
    words = F.concat_ws(" | ", name, F.nullif(caption, F.lit("")))
    for sign, plain in (("_", " "), ("-", " "), ("[", ""), ("]", "")):
        words = F.replace(words, F.lit(sign), F.lit(plain))
    return words


def pii_pattern(*labels: str, flags: str = "(?iU)") -> str:
    """Regular expression for all terms of some labels."""
    return rf"{flags}\b(?:{'|'.join(PII_TERMS[label] for label in labels)})\b"


def pii_label(name: Column, caption: Column, disabled: Iterable[str] = ()) -> Column:
    """First enabled label whose vocabulary matches the field, else null."""
    off = {label.lower() for label in disabled}
    labels = [label for label in PII_TERMS if label not in off]
    if not labels:
        return F.lit(None).cast("string")

    def found(words: Column) -> Column:
        first = F.coalesce(*[F.when(words.rlike(pii_pattern(label)), label) for label in labels])
        # Most fields match nothing: one search over all terms settles those. In plain ASCII the terms, which are lower
        # case, mean the same without regard to Unicode, and are found several times as fast.
        plain = F.octet_length(words) == F.length(words)
        any_term = F.when(plain, F.lower(words).rlike(pii_pattern(*labels, flags=""))).otherwise(words.rlike(pii_pattern(*labels)))
        return F.when(any_term, first)

    return held(field_words(name, caption), found)


def is_external_server(server: Column, allowed: Iterable[str] = ()) -> Column:
    """True for a non-empty server neither approved nor on the allow list."""
    external = (server != "") & ~server.rlike(APPROVED_SERVER)
    names = sorted({name.lower() for name in allowed})
    return external & ~F.lower(server).isin(names) if names else external


def is_profile_path(filename: Column) -> Column:
    return filename.rlike(PROFILE_PATH)


def version_number(version: Column) -> Column:
    """Version text as a number, null if it is none (``1d`` is not one)."""
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(version.rlike(number), F.trim(version).try_cast("double"))


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_folded(text: Column, term: str) -> Column:
    """Literal containment that ignores the case of ASCII letters."""
    lowered = "".join(ch.lower() if ch.isascii() else ch for ch in term)
    return fold_ascii(text).contains(F.lit(lowered))


def artifact_uri(path: Column) -> Column:
    """File URI of an absolute path; a relative path only gets forward slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    # url_encode is made for forms: undo what it does to path characters.
    encoded = F.url_encode(slashed)
    kept = {"%20": r"\+"} | {f"%{ord(ch):02X}": ch for ch in "/:~!$&'(),;=@"}
    for code, char in [(kept.pop("%20"), "%20"), ("%2B", "+"), *kept.items()]:
        char = r"\$" if char == "$" else char
        encoded = F.regexp_replace(encoded, code, char)
    return (
        F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("file:///"), encoded))
        .when(path.rlike(r"^[\\/]{2}[^\\/]"), F.concat(F.lit("file:"), encoded))
        .when(path.startswith("/"), F.concat(F.lit("file://"), encoded))
        .otherwise(slashed)
    )


def rule_slug(rule_id: Column, title: Column) -> Column:
    """Rule id and title as one capitalised identifier."""
    words = F.split(F.concat_ws(" ", rule_id, title), "[^A-Za-z0-9]+")
    capitals = F.transform(words, lambda w: F.concat(F.upper(w.substr(1, 1)), F.substring(w, 2, 1 << 30)))
    return F.array_join(capitals, "")
