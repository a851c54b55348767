"""Vocabularies and tables of the product domain, and the tunables of matching."""

from __future__ import annotations

from dataclasses import dataclass

# Units with their factors to millilitres or grams.
VOLUME = {"ml": 1.0, "mls": 1.0, "cl": 10.0, "l": 1000.0, "ltr": 1000.0, "litre": 1000.0, "litres": 1000.0, "millilitre": 1.0, "millilitres": 1.0, "milliliter": 1.0, "milliliters": 1.0}
MASS = {"g": 1.0, "gm": 1.0, "gms": 1.0, "gr": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "mg": 0.001, "oz": 28.349523125}

# Words of the description parser.
UNIT_OF_SALE = ("each", "ea", "sgl", "std", "u", "pmp")
CLAIM_WORDS = ("more", "less", "stronger", "longer", "better", "whiter", "faster", "cleaner", "softer", "harder", "brighter", "healthier", "smoother", "deeper")
FORMATS = ("pump", "gel", "tablets", "rinse", "paste", "powder", "spray", "foam", "floss", "tape", "strips", "sachets", "wipes", "capsules", "lozenges", "gum", "mouthwash", "mouthrinse", "toothpaste", "toothbrush")
STOPWORDS = ("of", "for", "and", "with", "the", "to", "de", "a", "in", "on", "pack", "packs", "count", "ct", "ml", "g", "x")

# Parameters of a URL that don't identify a page, and characters folded or deleted.
TRACKING = ("gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "ref", "referrer", "sessionid", "session_id", "sid", "phpsessid", "jsessionid")
DASHES = "‐‑‒–—―−"
INVISIBLE = "­​‌‍﻿"

# Marks of pages that aren't a product's own.
NEGATIVE_FLAGS = ("refill", "refills", "travel", "sample", "bundle", "gift set", "giftset", "multipack", "value pack", "trial")
LISTING_PATTERNS = ("/s?k=", "/s/", "/search?", "/search/", "?q=", "?query=", "/catalogsearch/", "/results?", "/sr?", "/sch/", "/b/bn_", "_nkw=", "/bn_", "/collections/", "/product-collections/")
DIRECTORIES = (
    "buycott.com", "grocefully.com", "prodlookup.co.uk", "barcodelookup.com", "barcodeindex.com", "upcitemdb.com", "go-upc.com", "ean-search.org", "barcode-list.com", "123pricecheck.com",
    "pricerunner.com", "idealo.co.uk", "pricespy.co.uk", "callchecker.co.uk", "cosmos.bluesoft.com.br",
)
NON_COMMERCE = (
    "wikipedia.org", "wikidata.org", "wiktionary.org", "facebook.com", "instagram.com", "youtube.com", "reddit.com", "pinterest.com", "pinterest.co.uk", "twitter.com", "x.com", "tiktok.com",
    "linkedin.com", "quora.com",
)
MARKETS = {"GB": ".co.uk", "IE": ".ie", "FR": ".fr", "DE": ".de", "NL": ".nl"}
ABOUT_FLAGS = ("directory", "listing_page", "non_commerce", "site_root")

# The characteristics, and the header of the output, in order.
CHARACTERISTICS = (
    "GLOBAL_INTERSPACE_CLAIM", "GLOBAL_CONSUMER_LIFESTAGE_CLAIM", "GLOBAL_PACKAGING", "GLOBAL_IF_MEDICATED", "GLOBAL_PERCENTAGE_NATURAL_INGREDIENTS", "GLOBAL_IF_WITH_SENSITIVE_CLAIM",
    "GLOBAL_ORAL_CARE_FUNCTION", "GLOBAL_IF_WITH_FLUORIDE", "GLOBAL_FLAVOUR_FRAGRANCE_INGREDIENT_GROUP", "GLOBAL_METHOD_OF_APPLICATION_DISPENSE", "GLOBAL_PACKAGING_MATERIAL",
    "GLOBAL_DESCRIPTIVE_SIZE_OF_TOOTHBRUSH_HEAD_CLAIM", "GLOBAL_BRISTLE_STRENGTH_CLAIM",
)
CHARACTERISTIC_ALIASES = {"GLOBAL IF WITH INTERSPACE CLAIM": "GLOBAL_INTERSPACE_CLAIM"}
OUTPUT_COLUMNS = ("ITEM_CODE", "NAN_KEY", "EXTERNAL_CODE", "COUNTRY", "RETAILER_DESC", "RETAILER", "BRAND", "PRODUCT_URL", "REASONING", "MODULE", *CHARACTERISTICS)
STAGES = ("normalize", "retrieve", "fetch", "match", "classify", "characteristics", "reason", "assemble")
STRATEGY_ORDER = ("S2", "S3", "S4", "S5", "S1")


@dataclass(frozen=True)
class MatchConfig:
    """Weights and penalties of the matcher; the weights sum to one. The defaults are fixed values."""

    brand: float = 0.35
    variant: float = 0.30
    format: float = 0.15
    retailer: float = 0.10
    market: float = 0.10
    size_penalty: float = 0.60
    count_penalty: float = 0.60
    flag_penalty: float = 0.40
    floor: float = 0.01
    text_chars: int = 300
    gap: float = 0.15
    top_k: int = 4

    def __post_init__(self) -> None:
        if abs(self.brand + self.variant + self.format + self.retailer + self.market - 1) > 1e-6:
            raise ValueError("the weights must sum to 1")


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits of a search. The defaults are fixed values."""

    candidates: int = 20
    fetch_budget: int = 8
    per_strategy: int = 8

    def __post_init__(self) -> None:
        if max(self.per_strategy, self.fetch_budget) > self.candidates:
            raise ValueError("the limits must not exceed the number of candidates")


@dataclass(frozen=True)
class RegistryConfig:
    """Thresholds of the registry. The defaults are fixed values."""

    tau_ann: float = 0.75
    tau_merge: float = 0.95
    tau_abstain: float = 0.0

    def __post_init__(self) -> None:
        if not 0 < self.tau_ann <= 1 or self.tau_merge <= self.tau_ann:
            raise ValueError("0 < tau_ann <= 1 and tau_ann < tau_merge are needed")
