"""Personal-data column expressions, all on the JVM side.

``(?U)`` makes \\b, \\w, \\s and \\d Unicode-aware and ``(?iu)`` does so for case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pultwerk import fixed_values as fv

DETECTORS = {
    "email": fv.EMAIL_PATTERN,
    "phone": "(?U)" + fv.PHONE_PATTERN,
    # the letters every birth word starts with come first, then the word edge is looked up behind
    # them: twice as fast as trying the edge at every character
    "birth_date": rf"(?iuU)geb(?<=\bgeb)(?:{'|'.join(w.removeprefix('geb') for w in fv.BIRTH_WORDS.split('|'))}){fv.BIRTH_GAP_DATE}\b",
    "student_context": rf"(?iuU)\b(?:{fv.STUDENT_WORDS})\b",
    "person_name": rf"(?U)\b(?:{fv.NAME_LEAD_WORDS})\s+{fv.CAPITALISED_NAME}",
    "student_identifier": rf"(?iuU)\b{fv.STUDENT_ID}\b",
}


# What a text must contain for a detector to have a chance. Plain substring tests cost a
# fraction of a regular expression, and most texts fail them.
HINTS_AS_WRITTEN = {
    "email": ["@"],
    "phone": ["0", "+49"],
    "person_name": ["von", "für", "fuer", "heißt", "heisst", "namens", "name:"],
}
HINTS_ANY_CASE = {
    "birth_date": ["geb"],
    "student_context": ["schüler", "schueler", "lernende", "kind", "sohn", "tochter", "sus", "zeugnis", "förderplan", "foerderplan",
                        "nachteilsausgleich", "lerntagebuch", "benotung", "korrektur"],
    "student_identifier": ["sus", "schüler", "schueler"],
}


def _any_case(text: Column) -> Column:
    """Folds case at least as widely as a case-insensitive expression does (also ſ and K)."""
    return F.lower(F.upper(text))


def may_contain(text: Column, detector: str) -> Column:
    hints = HINTS_AS_WRITTEN.get(detector)
    # bound as a lambda variable, so that folding a long text happens once and not per hint
    once = F.array(text if hints else _any_case(text))
    return F.exists(once, lambda t: reduce(Column.__or__, [t.contains(h) for h in hints or HINTS_ANY_CASE[detector]]))


def detected(text: Column, detector: str) -> Column:
    return may_contain(text, detector) & text.rlike(DETECTORS[detector])


def findings(text: Column) -> Column:
    """Sorted names of the detectors that hit."""
    return F.array_compact(F.array(*[F.when(detected(text, name), F.lit(name)) for name in sorted(DETECTORS)]))


def string_leaves(column: Column, kind: T.DataType) -> Column:
    """Every string inside a nested value, as one array; built from the column's type."""
    empty = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(column))
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.coalesce(F.transform(column, lambda item: string_leaves(item, kind.elementType)), F.array(empty)))
    if isinstance(kind, T.MapType):
        return string_leaves(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [string_leaves(column[f.name], f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else empty
    return empty


def findings_in(texts: Column) -> Column:
    """Findings over an array of texts, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, findings))))


def finding_labels(found: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in fv.FINDING_LABELS for x in pair])
    return F.transform(found, lambda name: F.coalesce(labels[name], name))


def redact(text: Column) -> Column:
    """Email, then phone, then dates; dates only if a birth word is left in the text."""
    masked = text
    for detector, label in (("email", "[E-Mail]"), ("phone", "[Telefon]")):
        masked = F.when(may_contain(masked, detector), F.regexp_replace(masked, DETECTORS[detector], label)).otherwise(masked)
    birth = may_contain(text, "birth_date") & masked.rlike(r"(?iuU)(geb\b\.?|geboren|geburtstag|geburtsdatum)")
    return F.when(birth, F.regexp_replace(masked, rf"(?U)\b{fv.REDACTED_DATE}\b", "[Datum]")).otherwise(masked)


def loopback(url: Column) -> Column:
    """True for http(s) URLs whose host is this machine."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^\[|\]$|\.+$", "")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    local = (host == "localhost") | host.rlike(rf"^127(\.{octet}){{3}}$") | host.rlike("^(::|(0{1,4}:){7})0{0,3}1$")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & local, F.lit(False))


def endpoint_problem(url: Column, allow_http: bool = False) -> Column:
    """NULL if the URL may be called, else why not. Name resolution is not part of it."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, host, user = F.lower(part("PROTOCOL")), part("HOST"), part("USERINFO")
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d*)$", 1)
    number = F.when(port == "", F.when(scheme == "https", 443).otherwise(80)).otherwise(port.try_cast("int"))
    schemes = ["https", "http"] if allow_http else ["https"]
    return (F.when(~F.coalesce(scheme.isin(schemes), F.lit(False)) | (F.coalesce(host, F.lit("")) == ""), "not_https")
            .when(F.coalesce(user, F.lit("")).rlike("[^:]"), "credentials")
            .when(~F.coalesce(number.isin(80, 443), F.lit(False)), "port"))


def cloud_guard(classification: Column, url: Column) -> Column:
    """NULL if the call may go out, else the reason it is blocked."""
    allowed = (classification == "public_curriculum") | loopback(url)
    return F.when(~F.coalesce(allowed, F.lit(False)), F.concat(F.lit("cloud_blocked:"), F.coalesce(classification, F.lit("unknown"))))


def remote_model(tag: Column, metadata: Column | None = None) -> Column:
    """Tag or metadata says that the model runs elsewhere."""
    name = F.lower(F.trim(tag))
    variant = F.lower(F.regexp_extract(tag, "(?s)^[^:]*:(.*)$", 1))
    remote = name.endswith(":cloud") | name.endswith("-cloud") | variant.endswith("-cloud")
    if metadata is not None:
        keys = "|".join(k.replace("_", "[_-]") for k in fv.UPSTREAM_KEYS)
        filled = rf'(?i)"(?:{keys})"\s*+:\s*+(?!null\b|false\b|""|\[\s*\]|\{{\s*\}}|-?0(?:\.0+)?\s*[,}}\]])'
        remote = remote | F.coalesce(metadata.rlike(filled), F.lit(False))
    return F.coalesce(remote, F.lit(False))
