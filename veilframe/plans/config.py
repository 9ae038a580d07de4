"""Rule packs, policy and catalogue, and the planning of which rules run.  Tables are fixed values; planning happens before Spark sees anything."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.dialect import groups, term_pattern, to_java
from ..functions.required import folded, label_ends, required
from . import pack_de, pack_en, pack_zh

PACKS = {"en": pack_en, "de": pack_de, "zh": pack_zh}

# Rules that every language keeps on, and the always-present key.
BASE_ALWAYS_ON = ["secret", "url", "email", "phone", "account", "bank", "company", "money"]

# Catalogue of switches, by tier: key and default.
CATALOG = {
    "l1": [
        ("email", True), ("phone", True), ("url", True), ("secret", True), ("security_answer", True), ("account", True), ("bank", True), ("bank_routing_ids", True),
        ("card_expiry", True), ("card_security", True), ("dob", True), ("place_of_birth", False), ("id_card", True), ("passport", True), ("driver_license", True),
        ("license_plate", False), ("ip_label", False), ("ip_address", False), ("mac_label", False), ("mac_address", False), ("imei", False), ("device_fingerprint", False),
        ("uuid", False), ("address_cn", True), ("address_de_street", True), ("address_en_inline_street", True), ("address_en_extra_block", False), ("address_en_extra", False),
        ("company", True), ("person_name", True), ("wallet_id", False), ("tx_hash", False), ("crypto_wallet", False),
    ],
    "l2": [("handle_label", True), ("handle", True), ("cust_id", True), ("ref_label_tail", True), ("ref", True), ("title", True)],
    "l3": [("money", False), ("number", False)],
}

# Category of each key; others are "other".
CATEGORIES = {
    "contact": [
        "phone", "email", "url", "address_cn", "address_de_street", "address_de_street_partial", "address_de_inline_street", "address_de_extra_partial",
        "address_en_inline_street", "address_en_extra_block", "address_en_extra", "handle", "handle_label", "person_name", "person_name_keep_title",
    ],
    "identity": [
        "dob", "place_of_birth", "passport", "driver_license", "ssn", "ein", "national_id", "tax_id", "insurance_id", "insurance_id2", "intl_itin", "intl_nino", "intl_nhs",
        "intl_sin", "intl_tfn", "intl_abn", "secret", "api_key_token", "bearer_token", "security_answer", "otp", "pin", "2fa",
    ],
    "business": [
        "account", "bank", "bank_routing_ids", "card_expiry", "card_expiry_de", "card_security", "card_security_de", "money", "money_label", "ref", "ref_label_tail",
        "ref_generic_tail", "legal_ref_tail", "company",
    ],
    "tracking": ["ip_label", "ip_address", "mac_label", "mac_address", "imei", "imei2", "uuid", "uuid2", "device_fingerprint", "wallet_id", "tx_hash", "crypto_wallet"],
    "manual": ["manual_term"],
}

# Risk groups with their keys, weights and saturation; ranking weights; thresholds and bonuses.
RISK_GROUPS = {
    "critical": ["secret", "api_key_token", "bearer_token", "card_security", "card_security_de", "security_answer"],
    "financial": ["account", "bank", "bank_routing_ids", "card_expiry", "card_expiry_de"],
    "identity": ["dob", "place_of_birth", "passport", "driver_license", "ssn", "ein", "national_id", "tax_id", "insurance_id", "insurance_id2", "intl_itin", "intl_nino", "intl_nhs", "intl_sin", "intl_tfn", "intl_abn"],
    "contact": [
        "phone", "email", "url", "address_cn", "address_de_street", "address_en_inline_street", "address_en_extra_block", "address_en_extra", "address_de_inline_street",
        "address_de_extra_partial", "address_de_street_partial", "handle_label", "handle", "person_name", "person_name_keep_title", "company",
    ],
    "tracking": ["ip_label", "ip_address", "mac_label", "mac_address", "imei", "uuid", "imei2", "uuid2", "device_fingerprint", "wallet_id", "tx_hash", "crypto_wallet"],
}
GROUP_WEIGHT = {"critical": 0.32, "financial": 0.28, "identity": 0.18, "contact": 0.12, "tracking": 0.10}
GROUP_K = {"critical": 0.35, "financial": 0.30, "identity": 0.22, "contact": 0.18, "tracking": 0.20}
RISK_WEIGHTS = {
    "bank": 28, "account": 26, "email": 14, "url": 10, "secret": 30, "phone": 16, "address_de_street": 18, "address_cn": 18, "address_de_street_partial": 18,
    "address_de_inline_street": 18, "address_de_extra_partial": 8, "handle_label": 10, "ref_label_tail": 6, "handle": 10, "ref": 6, "title": 4, "number": 2, "money": 0,
    "company": 8, "card_expiry_de": 12, "card_security_de": 30, "imei2": 10, "uuid2": 10, "insurance_id2": 16, "manual_term": 10,
}
THRESHOLDS = {"mid": 40, "high": 70}
BONUS = {"base": 0, "len1500": 2, "len4000": 3, "from_pdf": 2}
CAP_PER_KEY = 12
MOST_TERMS, LONGEST_TERM = 24, 80


@dataclass(frozen=True)
class Rule:
    """One matcher: a Java pattern, which part of a match it masks, and its place in the order."""

    key: str
    tag: str
    mode: str
    order: int
    pattern: str
    groups: int = 0
    placeholder: str = ""
    term: str = ""
    needs: tuple[frozenset[str], ...] = ()
    ends: frozenset[str] = frozenset()


@dataclass(frozen=True)
class ScrubConfig:
    """Everything a run depends on.  ``enabled``: keys switched on by the user; None takes the catalogue's defaults.

    ``parity`` keeps the original's shifted ranges of values that stand apart from their label.
    """

    lang: str = "zh"
    enabled: frozenset[str] | None = None
    money_mode: str = "m1"
    terms: tuple[str, ...] = ()
    from_pdf: bool = False
    parity: bool = False
    extra_rules: tuple[Rule, ...] = field(default=())


def norm_lang(lang: str | None) -> str:
    """A known language in lower case, or the empty string."""
    low = str(lang or "").lower()
    return low if low in PACKS else ""


def default_enabled() -> frozenset[str]:
    return frozenset(k for tier in CATALOG.values() for k, on in tier if on)


def effective_enabled(config: ScrubConfig) -> frozenset[str]:
    """The user's keys, those the policy and the pack keep on, and companies."""
    mine = default_enabled() if config.enabled is None else config.enabled
    return mine | set(BASE_ALWAYS_ON) | set(PACKS[norm_lang(config.lang) or "zh"].ALWAYS_ON) | {"company"}


def parse_terms(text: str) -> tuple[str, ...]:
    """Manual terms of a user's list: split at line ends, commas and semicolons (also full-width ones), trimmed, the first of equal ones (any case), at most 24."""
    seen: dict[str, str] = {}
    for term in re.split(r"[\n,，;；、]", text or ""):
        if term.strip():
            seen.setdefault(term.strip().lower(), term.strip())
    return tuple(seen.values())[:MOST_TERMS]


def term_rules(config: ScrubConfig) -> list[Rule]:
    """Matchers of manual terms; they come before all rules.  Empty and overlong terms are left out."""
    mark = PACKS[norm_lang(config.lang) or "zh"].PLACEHOLDERS["TERM"]
    out: dict[str, Rule] = {}
    for term in (t.strip() for t in config.terms):
        if term and len(term) <= LONGEST_TERM and term.lower() not in out:
            pattern, group = term_pattern(term)
            out[term.lower()] = Rule("manual_term", "TERM", "manual", -100000, pattern, group, mark, term, needs=(frozenset([folded(term)]),))
    return list(out.values())


def plan_rules(config: ScrubConfig) -> list[Rule]:
    """Rules that run, manual terms first, then the pack's in its order; disabled rules are never compiled."""
    lang = norm_lang(config.lang) or "zh"
    pack, enabled = PACKS[lang], effective_enabled(config)
    rules = {k: (tag, mode, flags, pattern) for k, tag, mode, flags, pattern in pack.RULES}
    out = term_rules(config)
    for order, key in enumerate(pack.PRIORITY):
        on = (config.money_mode or "m1").lower() != "off" if key == "money" else key in enabled
        if on and key in rules:
            tag, mode, flags, pattern = rules[key]
            out.append(Rule(key, tag, mode, order, to_java(pattern, flags, led=True), groups(pattern), pack.PLACEHOLDERS.get(tag, f"[{tag}]"), needs=required(pattern), ends=label_ends(pattern)))
    return out + list(config.extra_rules)


def category_of() -> dict[str, str]:
    return {k: c for c, keys in CATEGORIES.items() for k in keys}


def group_of() -> dict[str, str]:
    """Risk group of each key: the first that lists it."""
    out: dict[str, str] = {}
    for g, keys in RISK_GROUPS.items():
        for k in keys:
            out.setdefault(k, g)
    return out
