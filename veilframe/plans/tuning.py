"""Tuning of boxes on a raster: fixed values, and overrides merged over them for a language or a run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import NamedTuple


class Width(NamedTuple):
    """Width limits of a key group."""

    #: share of the page's width at most
    page: float
    #: share of the estimated width at most
    estimate: float
    #: ratio to the estimate beyond which a width is implausible, and the ratio that replaces it
    implausible: float
    instead: float


class Pad(NamedTuple):
    """Padding: shares of a box's width and height, and at least so many pixels."""

    wide: float
    high: float
    least_x: float
    least_y: float


class Font(NamedTuple):
    """Height of a font: factor, least and most; width of a character as a share of it."""

    factor: float
    least: float
    most: float
    character: float


class Special(NamedTuple):
    """A key's own widths: a factor, the most as shares of page and estimate, the least as shares of estimate and page."""

    factor: float
    page_most: float
    estimate_most: float
    estimate_least: float
    page_least: float


# Longest span of each key (others 120).
LONGEST = {
    "manual_term": 80, "person_name": 30, "person_name_keep_title": 30, "account_holder_name_keep_title": 30, "company": 50, "email": 70, "phone": 40, "account": 70, "bank": 100,
    "address_de_street": 120, "address_de_postal": 120, "address_de_street_partial": 120, "address_de_extra_partial": 120, "address_de_inline_street": 120, "address_en_inline_street": 120,
    "address_en_extra_block": 120, "address_en_extra": 120, "address_cn": 120, "handle": 70, "ref": 70, "title": 70, "money": 50, "money_label": 50, "number": 50,
}
# Width limits of each key group: share of the page, of the estimate, ratio to the estimate beyond which a width is implausible, and what replaces it.
WIDTHS = {
    "default": Width(page=0.24, estimate=1.28, implausible=1.9, instead=1.08),
    "longValue": Width(page=0.42, estimate=1.7, implausible=2.2, instead=1.22),
    "address": Width(page=0.5, estimate=1.8, implausible=2.5, instead=1.35),
    "money": Width(page=0.26, estimate=1.35, implausible=1.85, instead=1.08),
    "manual_term": Width(page=0.34, estimate=1.55, implausible=2.1, instead=1.2),
}
# Padding as a share of width and height, and at least so many pixels.
PAD = Pad(wide=0.0022, high=0.02, least_x=0.22, least_y=0.34)
# Font height factor, least and most, and width of a character as a share of it, for items and for rectangles.
ITEM_FONT = Font(factor=1.08, least=6.0, most=96.0, character=0.72)
RECT_FONT = Font(factor=1.1, least=6.0, most=104.0, character=0.82)
SHORT_TOKEN, ITEM_CAP = 1.10, 1.18
# Shares from which a covered item is covered whole, by language.
COVER = {"en": 0.90, "": 0.72}
NAME_KEYS = ("person_name", "person_name_keep_title", "account_holder_name_keep_title")


@dataclass(frozen=True)
class BoxTuning:
    """What a language may set: key groups, labels that are not part of a value, padding by key, and keys whose items are covered whole."""

    longest: dict[str, int] = field(default_factory=lambda: dict(LONGEST))
    groups: dict[str, str] = field(default_factory=dict)
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pads: dict[str, Pad] = field(default_factory=dict)
    whole: tuple[str, ...] = ()
    keep_label: tuple[str, ...] = ()
    #: keys whose preferred part is not looked at
    ignore_part: tuple[str, ...] = ()
    cover: float = COVER[""]
    down: float = 3.0
    trim: float = 2.0
    widths: dict[str, Width] = field(default_factory=lambda: dict(WIDTHS))
    pad: Pad = PAD
    #: keys with widths of their own
    special: dict[str, Special] = field(default_factory=dict)
    collapse: tuple[str, ...] = ()
    #: keys whose boxes join only when they touch
    strict: tuple[str, ...] = ()


# Fixed values of the languages' packs, for pages drawn at print density, each key with its own; fields as above.
LANGUAGES: dict[str, dict] = {
    "en": {
        "ignore_part": (
            "person_name", "person_name_keep_title", "account_holder_name_keep_title", "company", "account", "phone", "money", "money_label", "address_en_inline_street",
            "address_en_street_line", "address_en_extra_block", "address_en_extra", "handle_label",
        ),
        "longest": {
            "manual_term": 90,
            "person_name": 40,
            "person_name_keep_title": 40,
            "account_holder_name_keep_title": 40,
            "company": 70,
            "email": 90,
            "phone": 60,
            "account": 90,
            "bank": 140,
            "address_en_inline_street": 160,
            "address_en_extra_block": 160,
            "address_en_extra": 160,
            "handle": 90,
            "ref": 90,
            "title": 90,
            "money": 70,
            "money_label": 70,
            "number": 70,
        },
        "widths": {
            "default": Width(page=0.3, estimate=1.45, implausible=2.2, instead=1.15),
            "longValue": Width(page=1.0, estimate=3.0, implausible=2.8, instead=1.6),
            "address": Width(page=0.75, estimate=2.4, implausible=3.2, instead=1.7),
            "money": Width(page=0.35, estimate=1.8, implausible=2.2, instead=1.15),
            "manual_term": Width(page=0.4, estimate=1.8, implausible=2.2, instead=1.15),
        },
        "down": 30.0,
        "trim": 30.0,
        "cover": 0.9,
        "pad": Pad(wide=0.004, high=0.035, least_x=0.5, least_y=0.7),
        "pads": {
            "person_name": Pad(wide=0.002, high=0.03, least_x=0.25, least_y=0.55),
            "company": Pad(wide=0.004, high=0.032, least_x=0.5, least_y=0.6),
            "manual_term": Pad(wide=0.004, high=0.035, least_x=0.55, least_y=0.65),
            "uuid": Pad(wide=0.006, high=0.045, least_x=0.8, least_y=0.75),
            "ip_address": Pad(wide=0.006, high=0.045, least_x=0.7, least_y=0.75),
            "wallet_id": Pad(wide=0.006, high=0.045, least_x=0.7, least_y=0.75),
            "email": Pad(wide=0.004, high=0.03, least_x=0.0, least_y=0.0),
            "phone": Pad(wide=0.004, high=0.03, least_x=0.0, least_y=0.0),
            "account": Pad(wide=0.004, high=0.03, least_x=0.0, least_y=0.0),
            "money": Pad(wide=0.004, high=0.03, least_x=0.0, least_y=0.0),
        },
    },
    "de": {
        "ignore_part": (
            "ref_generic_tail_de", "id_label_tail", "aktenzeichen_tail", "legal_ref_tail", "cust_id", "person_name_keep_title", "account_holder_name_keep_title", "person_name", "company",
            "account", "phone", "money", "money_label", "address_de_inline_street", "address_de_street_partial", "address_de_extra_partial", "klingel_name", "handle_label",
        ),
        "longest": {
            "manual_term": 90,
            "person_name": 40,
            "person_name_keep_title": 40,
            "account_holder_name_keep_title": 40,
            "company": 70,
            "email": 90,
            "phone": 60,
            "account": 90,
            "bank": 140,
            "address_en_inline_street": 160,
            "address_en_extra_block": 160,
            "address_en_extra": 160,
            "handle": 90,
            "ref": 90,
            "title": 90,
            "money": 70,
            "money_label": 70,
            "number": 70,
            "address_de_street": 160,
            "address_de_postal": 160,
            "address_de_street_partial": 160,
            "address_de_extra_partial": 160,
            "address_de_inline_street": 160,
            "address_cn": 160,
        },
        "widths": {
            "default": Width(page=0.3, estimate=1.45, implausible=2.2, instead=1.15),
            "longValue": Width(page=0.55, estimate=2.2, implausible=2.8, instead=1.6),
            "address": Width(page=0.6, estimate=2.1, implausible=3.2, instead=1.7),
            "money": Width(page=0.35, estimate=1.8, implausible=2.2, instead=1.15),
            "manual_term": Width(page=0.4, estimate=1.8, implausible=2.2, instead=1.15),
        },
        "down": 30.0,
        "trim": 30.0,
        "pad": Pad(wide=0.005, high=0.045, least_x=0.55, least_y=0.75),
        "pads": {
            "person_name": Pad(wide=0.002, high=0.03, least_x=0.25, least_y=0.55),
            "person_name_keep_title": Pad(wide=0.002, high=0.03, least_x=0.25, least_y=0.55),
            "account_holder_name_keep_title": Pad(wide=0.002, high=0.03, least_x=0.25, least_y=0.55),
            "company": Pad(wide=0.0045, high=0.032, least_x=0.55, least_y=0.6),
            "manual_term": Pad(wide=0.004, high=0.035, least_x=0.55, least_y=0.65),
        },
    },
    "zh": {
        "longest": {
            "manual_term": 90,
            "person_name": 40,
            "person_name_keep_title": 40,
            "account_holder_name_keep_title": 40,
            "company": 70,
            "email": 90,
            "phone": 60,
            "account": 90,
            "bank": 140,
            "address_en_inline_street": 160,
            "address_en_extra_block": 160,
            "address_en_extra": 160,
            "handle": 90,
            "ref": 90,
            "title": 90,
            "money": 70,
            "money_label": 70,
            "number": 70,
            "address_de_street": 160,
            "address_de_postal": 160,
            "address_de_street_partial": 160,
            "address_de_extra_partial": 160,
            "address_de_inline_street": 160,
            "address_cn": 160,
        },
        "widths": {
            "longValue": Width(page=0.5, estimate=2.0, implausible=2.2, instead=1.22),
        },
        "down": 25.0,
        "trim": 20.0,
        "pad": Pad(wide=0.003, high=0.01, least_x=0.3, least_y=0.1),
        "pads": {
            "person_name": Pad(wide=0.0005, high=0.014, least_x=0.5, least_y=0.24),
            "person_name_keep_title": Pad(wide=0.0005, high=0.014, least_x=0.5, least_y=0.24),
            "account_holder_name_keep_title": Pad(wide=0.0005, high=0.014, least_x=0.5, least_y=0.24),
            "company": Pad(wide=0.0025, high=0.022, least_x=0.28, least_y=0.36),
            "company_label_inline_zh": Pad(wide=0.0023, high=0.02, least_x=0.24, least_y=0.34),
            "company_label_inline_zh_no_colon": Pad(wide=0.0023, high=0.02, least_x=0.24, least_y=0.34),
            "phone": Pad(wide=0.0022, high=0.02, least_x=0.24, least_y=0.34),
            "email": Pad(wide=0.0022, high=0.02, least_x=0.24, least_y=0.34),
            "account": Pad(wide=0.004, high=0.005, least_x=0.4, least_y=0.05),
            "account_cn_inline": Pad(wide=0.004, high=0.005, least_x=0.4, least_y=0.05),
            "ref_label_tail": Pad(wide=0.006, high=0.005, least_x=0.6, least_y=0.05),
            "ref_inline_zh": Pad(wide=0.006, high=0.005, least_x=0.6, least_y=0.05),
            "money": Pad(wide=0.0018, high=0.018, least_x=0.18, least_y=0.3),
            "money_label": Pad(wide=0.0018, high=0.018, least_x=0.18, least_y=0.3),
            "money_cn_inline_label": Pad(wide=0.0018, high=0.018, least_x=0.18, least_y=0.3),
            "money_label_currency_zh": Pad(wide=0.0018, high=0.018, least_x=0.18, least_y=0.3),
            "address_inline_zh": Pad(wide=0.0035, high=0.014, least_x=10.0, least_y=0.24),
            "place_of_birth": Pad(wide=0.004, high=0.014, least_x=8.0, least_y=0.24),
            "license_plate": Pad(wide=0.004, high=0.014, least_x=8.0, least_y=0.24),
            "license_plate_inline_zh": Pad(wide=0.004, high=0.014, least_x=8.0, least_y=0.24),
            "security_answer": Pad(wide=0.004, high=0.014, least_x=8.0, least_y=0.24),
            "secret_inline_zh": Pad(wide=0.004, high=0.014, least_x=8.0, least_y=0.24),
            "manual_term": Pad(wide=0.003, high=0.024, least_x=0.3, least_y=0.4),
        },
        "groups": {
            "account": "longValue",
            "account_cn_inline": "longValue",
            "phone": "longValue",
            "email": "longValue",
            "bank": "longValue",
            "uuid": "longValue",
            "wallet_id": "longValue",
            "ip_address": "longValue",
            "ip_label": "longValue",
            "device_fingerprint": "longValue",
            "api_key_token_zh": "longValue",
            "secret": "longValue",
            "secret_inline_zh": "longValue",
            "security_answer": "longValue",
            "tax_id_zh": "longValue",
            "passport": "longValue",
            "passport_inline_zh": "longValue",
            "id_card": "longValue",
            "id_card_inline_zh": "longValue",
            "driver_license": "longValue",
            "license_plate": "longValue",
            "license_plate_inline_zh": "longValue",
            "address_inline_zh": "address",
            "address_cn": "address",
            "address_de_street": "address",
            "address_de_postal": "address",
            "address_de_street_partial": "address",
            "address_de_extra_partial": "address",
            "address_de_inline_street": "address",
            "address_en_inline_street": "address",
            "address_en_extra_block": "address",
            "address_en_extra": "address",
            "money": "money",
            "money_label": "money",
            "money_cn_inline_label": "money",
            "money_label_currency_zh": "money",
        },
        "whole": (
            "account", "account_cn_inline", "api_key_token_zh", "device_fingerprint", "dob", "driver_license", "email", "handle_label", "id_card", "id_card_inline_zh", "ip_address",
            "ip_label", "money", "money_label", "money_cn_inline_label", "money_label_currency_zh", "passport", "passport_inline_zh", "phone", "ref_inline_zh", "ref_label_tail", "secret",
            "secret_inline_zh", "tax_id_zh", "uuid", "wallet_id",
        ),
        "collapse": (
            "address_inline_zh", "phone", "money", "company", "license_plate", "license_plate_inline_zh",
        ),
        "strict": (
            "ref_label_tail", "ref_inline_zh", "company", "company_label_inline_zh", "company_label_inline_zh_no_colon", "account", "account_cn_inline", "id_card", "id_card_inline_zh",
            "passport", "passport_inline_zh", "driver_license", "license_plate", "license_plate_inline_zh", "tax_id_zh", "uuid", "wallet_id", "ip_address", "ip_label", "secret",
            "secret_inline_zh", "security_answer", "api_key_token_zh", "device_fingerprint", "handle_label",
        ),
        "special": {
            "ref_label_tail": Special(factor=0.6, page_most=0.24, estimate_most=0.768, estimate_least=0.5, page_least=0.15),
            "ref_inline_zh": Special(factor=0.6, page_most=0.24, estimate_most=0.768, estimate_least=0.5, page_least=0.15),
            "company_label_inline_zh": Special(factor=1.18, page_most=0.34, estimate_most=1.7, estimate_least=0.98, page_least=0.22),
        },
    },
}


def language_tuning(lang: str, **overrides) -> BoxTuning:
    """A language's own tuning, merged over the defaults, with overrides merged over it.  Labels stay empty: values begin after their label already."""
    base = tuned(lang, **LANGUAGES.get(lang, {}))
    return replace(base, **_merged(base, overrides))


def _merged(base: BoxTuning, overrides: dict) -> dict:
    return {k: {**getattr(base, k), **v} if isinstance(v, dict) else v for k, v in overrides.items()}


def tuned(lang: str = "", **overrides) -> BoxTuning:
    """Defaults without the language's own pack (but for the share that covers an item), with overrides: tables are merged entry by entry, other values replaced."""
    base = BoxTuning(cover=COVER.get(lang, COVER[""]))
    return replace(base, **_merged(base, overrides))
