"""Pattern specifications: what each finding type looks like and how it is shown when redacted.

Patterns are written once, in the dialect-neutral form below, and translated by
``portable`` so that JVM, Python and RE2 engines agree on digits and white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------
# Results only agree when these patterns, scores and placeholders are exactly so.
# ---------------------------------------------------------------------------------------------
EMAIL = r"\b([A-Za-z0-9._%+-])[^@\s]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
PHONE = r"\+?\d[\d\s\-\(\)]{7,}\d"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
MRN = r"(?i)\b(?:MRN|Medical\s*Record(?:\s*Number)?|Patient\s*ID)\s*[:#]?\s*([A-Z0-9\-]{6,20})\b"
MEMBER_ID = r"(?i)\b(?:Member|Policy|Insurance)\s*(?:ID|Number)\s*[:#]?\s*([A-Z0-9\-]{6,24})\b"
NPI = r"(?i)\b(?:NPI|National\s*Provider\s*Identifier)\s*[:#]?\s*(\d{10})\b"
DEA = r"(?i)\b(?:DEA|DEA\s*Number)\s*[:#]?\s*([A-Z]{2}\d{7})\b"
DOB = (
    r"(?i)\b(?:DOB|Date\s*of\s*Birth)\s*[:#]?\s*"
    r"((?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?\d{2})\b"
)
CVV = r"(?i)\b(?:cvv|cvc|cvn|security\s*code)\s*[:#]?\s*(\d{3,4})\b"
EXPIRY = (
    r"(?i)\b(?:exp(?:iry|iration)?|valid\s*thru)\s*[:#]?\s*"
    r"((?:0[1-9]|1[0-2])[/-](?:\d{2}|\d{4}))\b"
)
SSN_DASHED = r"\b\d{3}-\d{2}-\d{4}\b"
SSN_OPTIONAL_DASH = r"\b(?!000|666|9\d{2})\d{3}[-]?(?!00)\d{2}[-]?(?!0000)\d{4}\b"
SSN_PLAIN = r"\b(?!000|666|9\d{2})\d{9}\b"
SSN_CONTEXT = r"(?i)\b(ssn|social\s*security|tax\s*id|social\s*security\s*number)\b"
PASSWORD = r"(?i)\b(?:password|pwd|pass)\s*[:=]\s*\S+"
PAYMENT = (
    r"(?i)\$\d+(?:\.\d{2})?|\b\d+(?:\.\d{2})?\s*(?:dollars?|USD|usd)\b"
    r'|"(?:amount|price|cost)":\s*"?\d+(?:\.\d{2})?"?'
)
PAYMENT_NUMBER = r"(\d+(?:\.\d{2})?)"
API_KEY = r"(?:sk|pk|AKIA|ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,40}"
JWT = r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*"
PASSWORD_FIELD_WORDS = ("password", "pass", "pwd", "secret", "key", "token", "auth")
PASSWORD_WORDS = ("password", "pwd", "pass")

PLACEHOLDERS = {
    "email_address": "<USER_EMAIL>",
    "phone_number": "<USER_PHONE>",
    "credit_card": "<USER_CARD>",
    "us_ssn": "<USER_SSN>",
    "us_medical_record_number": "<USER_MRN>",
    "us_health_member_id": "<USER_MEMBER_ID>",
    "us_npi": "<USER_NPI>",
    "us_dea": "<USER_DEA>",
    "us_date_of_birth": "<USER_DOB>",
    "pci_cvv": "<PCI_CVV>",
    "pci_expiry": "<PCI_EXPIRY>",
    "ip_address": "<USER_IP>",
    "iban_code": "<USER_IBAN>",
    "api_key": "<API_KEY>",
    "jwt_token": "<JWT_TOKEN>",
    "password": "<PASSWORD>",
    "payment_amount": "<PAYMENT_AMOUNT>",
}
MASKED_PHONE = "+***-***-****"
MASKED_CARD = "**** **** **** ****"
# ------------------------------------ end of fixed values ------------------------------------

# The same e-mail matches in time linear in the text. A match holds one @ and no white space, so each
# stretch up to an @ is decided once, at its start or behind the match before: the part from the @ on
# must fit, and the match begins at the first place that can begin one. Group 1 is what is skipped.
_EMAIL_START, _EMAIL_TAIL = EMAIL.split(r"[^@\s]*", 1)
_FITS = _EMAIL_TAIL.replace("(", "(?:", 1)
EMAIL_SCAN = (
    rf"(?:\G|(?<![^@\s]))(?=[^@\s]*+{_FITS})([^@\s]*?)({_EMAIL_START}[^@\s]*+{_EMAIL_TAIL})"
)

# Our own patterns for the two types that have no pattern above.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"

# Code points Python treats as white space in str patterns, spelled out, and the ones Java's
# Unicode class leaves out of them.
SPACE_CHARS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
JAVA_SPACE_CHARS = r"\s\x1c-\x1f"


def portable(pattern: str, space: str = SPACE_CHARS) -> str:
    r"""Spell ``\d``, ``\s`` and ``\S`` out so every engine reads them the Unicode way."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif pair == r"\S":
            out.append(f"[^{space}]")
        elif pair.startswith("\\"):
            out.append(pair)
        else:
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def java(pattern: str) -> str:
    """The pattern for Spark's regex functions; ``(?U)`` makes classes and word boundaries
    Unicode-aware. Java's own white space class is much faster than the one spelled out."""
    return "(?U)" + portable(pattern, JAVA_SPACE_CHARS)


def python_regex(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern)


@dataclass(frozen=True)
class PatternSpec:
    """One finding type. ``gate`` names cheap tests that all hold for every text with a match:
    ``digit``, ``at``, ``underscore``, and ``words:a,b`` (some word, any case). ``scan`` finds the
    same matches faster: group 1 is text it skips, group 2 the match. ``placeholder`` is for types of
    one's own. ``context`` are words or phrases, in lower case, that make a match more likely."""

    pii_type: str
    pattern: str
    score: float
    gate: str
    validator: str | None = None
    scan: str | None = None
    placeholder: str | None = None
    context: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return f"PII:{self.pii_type}"


EMAIL_SPEC = PatternSpec("email_address", EMAIL, 0.8, "at", scan=EMAIL_SCAN)
PHONE_SPEC = PatternSpec("phone_number", PHONE, 0.8, "digit")
CARD_SPEC = PatternSpec("credit_card", CARD, 0.9, "digit", "card")
HEALTH_AND_PAYMENT_SPECS = (
    PatternSpec("us_medical_record_number", MRN, 0.82, "words:mrn,medical,patient"),
    PatternSpec("us_health_member_id", MEMBER_ID, 0.8, "words:member,policy,insurance"),
    PatternSpec("us_npi", NPI, 0.85, "digit words:npi,national"),
    PatternSpec("us_dea", DEA, 0.85, "digit words:dea"),
    PatternSpec("us_date_of_birth", DOB, 0.78, "digit words:dob,date"),
    PatternSpec("pci_cvv", CVV, 0.88, "digit words:cvv,cvc,cvn,security"),
    PatternSpec("pci_expiry", EXPIRY, 0.84, "digit words:exp,valid"),
)
PASSWORD_SPEC = PatternSpec("password", PASSWORD, 0.8, "words:pass,pwd")
PAYMENT_SPEC = PatternSpec("payment_amount", PAYMENT, 0.9, "digit")
CREDENTIAL_SPECS = (
    PatternSpec("api_key", API_KEY, 0.6, "underscore"),
    PatternSpec("jwt_token", JWT, 0.8, "words:eyj"),
)
SSN_SPECS = (
    PatternSpec("us_ssn", SSN_DASHED, 0.9, "digit"),
    PatternSpec("us_ssn", SSN_OPTIONAL_DASH, 0.9, "digit"),
    PatternSpec("us_ssn", SSN_PLAIN, 0.9, "digit"),
)

# Order is precedence: a later type never takes text an earlier one holds.
REGEX_PROFILE = (EMAIL_SPEC, PHONE_SPEC, CARD_SPEC, *HEALTH_AND_PAYMENT_SPECS)
SPECIFIC_FIRST_PROFILE = (
    CREDENTIAL_SPECS[1],
    CREDENTIAL_SPECS[0],
    EMAIL_SPEC,
    *HEALTH_AND_PAYMENT_SPECS,
    PatternSpec("iban_code", IBAN, 0.9, "digit", "iban"),
    CARD_SPEC,
    PatternSpec("us_ssn", SSN_OPTIONAL_DASH, 0.8, "digit"),
    PatternSpec("ip_address", IPV4, 0.8, "digit", "ipv4"),
    PHONE_SPEC,
)
PROFILES = {"regex": REGEX_PROFILE, "specific_first": SPECIFIC_FIRST_PROFILE}

# By how much a context word raises a score, what it raises it to at least, and how many
# words before and behind a match are looked at.
CONTEXT_RAISE = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_BEFORE = 5
CONTEXT_AFTER = 0

# Characters on a side of a match in which those words are looked for.
CONTEXT_CHARS = 200

# Runs of ASCII letters and digits and of anything beyond ASCII.
CONTEXT_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
