"""Keys of catalogs, requirements, documents and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and the words that retrieval leaves out.
CONTROL_ID = r"\b([A-Za-z]{2}-\d+(?:\(\d+\))?)"
REGULATION_ID = r"\b(\d{3}\.\d+(?:\([A-Za-z0-9]+\))*)"
CATALOG_ID = r"(?i)\b(\d{1,2}\.(?:[a-z]{1,2}|\d{2}))\b"
CROSSWALK_ID = r"[A-Za-z]{1,4}-\d+(\([A-Za-z0-9]+\))?"
STOPWORDS = (
    "a an and are as at be been by do does for from had has have how i if in into is it its of on or our that the their them there these they "
    "this to was we were what when where which who why will with you your"
).split()
# Acronyms that texts write out, with their words.
ACRONYMS = {
    "mfa": "multi factor authentication", "2fa": "two factor authentication", "sso": "single sign on", "rbac": "role based access control", "iam": "identity access management",
    "pii": "personally identifiable information", "phi": "protected health information", "ephi": "electronic protected health information", "vpn": "virtual private network",
    "edr": "endpoint detection response", "dlp": "data loss prevention", "siem": "security information event management", "rto": "recovery time objective",
    "rpo": "recovery point objective", "sla": "service level agreement", "bcdr": "business continuity disaster recovery",
}
# Words that are followed closely by a citation.
CUE = r"(?i)(?:\b(?:hitrust|csf|cfr|hipaa)\b|§|\[)[^\]\n]{0,12}"
# The private, link-local, documentation and reserved ranges of addresses.
PRIVATE = r"^(0\.|10\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.[02]\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(4[0-9]|5[0-5])\.)"
PRIVATE6 = r"^((f[cd]|fe[89ab])[0-9a-f]{0,2}:|2001:db8:)"
ANAPHORA = "it its that this these those they them their there same one ones above below former latter".split()


def parent(id_: Column) -> Column:
    """The id that an enhancement or numbered subcategory belongs to, else null."""
    bracket = F.nullif(F.regexp_extract(id_, r"^(.+)\([^()]*\)$", 1), F.lit(""))
    dotted = F.nullif(F.regexp_extract(id_, r"^([A-Za-z]+ \d+)\.\d+$", 1), F.lit(""))
    return F.coalesce(bracket, dotted)


def slug(text: Column) -> Column:
    """Lower-case letters and digits, with one hyphen for everything between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digest(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def tokens(text: Column) -> Column:
    """Lower-case [a-z0-9]+ runs of two or more characters outside the stopwords and ids, in order, unstemmed."""
    blanked = text
    for id_ in (CONTROL_ID, REGULATION_ID, CATALOG_ID):
        blanked = F.regexp_replace(blanked, id_, " ")
    words = F.regexp_extract_all(F.lower(F.when(text.rlike("[0-9]"), blanked).otherwise(text)), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def spelled_out(word: Column) -> Column:
    """The words of an acronym without stopwords, else none."""
    known = F.create_map(*(F.lit(x) for k, v in ACRONYMS.items() for x in (k, " ".join(w for w in v.split() if w not in STOPWORDS))))
    words = F.try_element_at(known, word)
    return F.when(words.isNull(), F.array().cast("array<string>")).otherwise(F.split(words, " "))


def cued(text: Column, id_: Column) -> Column:
    """Whether the text has the id shortly behind a word that announces a citation."""
    return F.regexp_like(text, F.concat(F.lit(CUE + r"\Q"), id_, F.lit(r"\E")))


def identifiers(text: Column) -> Column:
    """Control (upper), regulation and catalog (lower) ids, the first of equal ones."""
    return F.array_distinct(F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(CONTROL_ID), 1), F.upper),
        F.regexp_extract_all(text, F.lit(REGULATION_ID), 1),
        F.transform(F.regexp_extract_all(text, F.lit(CATALOG_ID), 1), F.lower),
    ))


def host(url: Column) -> Column:
    """The host in lower case, of an IPv6 address without its brackets; null where there is none."""
    plain = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^\[\]:/?#]+)", 1)
    six = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?\[([0-9A-Fa-f:.]+)\]", 1)
    return F.lower(F.coalesce(F.nullif(six, F.lit("")), F.nullif(plain, F.lit(""))))


def exposure(url: Column) -> Column:
    """local, self-hosted or third-party by the URL's host; without a host third-party.

    Addresses count by their range only where the host is a whole dotted quad or an IPv6 address; 10.example.com is a name."""
    h = host(url)
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    quad, six = h.rlike(rf"^{octet}(\.{octet}){{3}}$"), h.contains(":")
    return (
        F.when(h.isNull(), "third-party")
        .when((h == "localhost") | h.endswith(".localhost") | (quad & h.rlike(r"^127\.")) | (six & h.rlike(r"^(::1|0{1,4}(:0{1,4}){6}:0{0,3}1)$")), "local")
        .when(h.endswith(".local") | h.endswith(".internal") | (quad & h.rlike(PRIVATE)) | (six & h.rlike(PRIVATE6)), "self-hosted")
        .otherwise("third-party")
    )


def framework_key(name: Column, aliases: list[tuple[str, str]]) -> Column:
    """The key of the first alias that the name contains, else its first word, in lower case."""
    out = F.lit(None).cast("string")
    for needle, key in reversed(aliases):
        pattern = "\\Q" + needle.lower() + "\\E" + ("(?![0-9])" if needle[-1].isdigit() else "")
        out = F.when(F.lower(name).rlike(pattern), key).otherwise(out)
    return F.coalesce(out, F.lower(F.regexp_extract(name, r"^\s*(\S+)", 1)))


def is_followup(text: Column) -> Column:
    """A turn that points back: an anaphora word, or at most one word of content."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)
    return F.arrays_overlap(words, F.array(*map(F.lit, ANAPHORA))) | (F.size(tokens(text)) <= 1)


def modality(sentence: Column) -> Column:
    """prohibition, obligation, recommendation, permission or none by the modal verb, in this order."""
    s = F.lower(F.regexp_replace(sentence, r"[*_`]+", ""))
    return (
        F.when(s.rlike(r"\b(must|shall|may|should)\s+not\b|\b(is|are)\s+(prohibited|forbidden|not\s+(permitted|allowed))\b|\bcannot\b"), "prohibition")
        .when(s.rlike(r"\b(must|shall)\b|\b(is|are)\s+(required|mandatory)\b"), "obligation")
        .when(s.rlike(r"\bshould\b"), "recommendation")
        .when(s.rlike(r"\bmay\b"), "permission")
        .otherwise("none")
    )
