"""Rule tables and parameters, shipped as plain data.

Labels are derived by folding these tables into Column expressions
(see ``labels.py``); nothing here runs per row in Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must stay exactly as written so derived labels match
# the behaviour being reproduced.  Order matters wherever noted.
# ---------------------------------------------------------------------------

# Exact-token category rules.  A row's tokens are tried in the row's own
# order; the first token present in this table decides the label.
TOKEN_CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    ("indian_restaurant", "Indian"),
    ("chinese_restaurant", "Chinese"),
    ("italian_restaurant", "Italian"),
    ("japanese_restaurant", "Japanese"),
    ("thai_restaurant", "Thai"),
    ("seafood_restaurant", "Seafood"),
    ("fast_food_restaurant", "Fast Food"),
    ("pizza_restaurant", "Pizza"),
    ("hamburger_restaurant", "Burgers"),
    ("vegetarian_restaurant", "Vegetarian"),
    ("steak_house", "Steakhouse"),
    ("sushi_restaurant", "Sushi"),
    ("korean_restaurant", "Korean"),
    ("vietnamese_restaurant", "Vietnamese"),
    ("middle_eastern_restaurant", "Middle Eastern"),
    ("mexican_restaurant", "Mexican"),
    ("turkish_restaurant", "Turkish"),
    ("lebanese_restaurant", "Lebanese"),
    ("bakery", "Bakery"),
    ("cafe", "Café"),
    ("bar", "Bar & Grill"),
    ("meal_takeaway", "Takeaway"),
    ("meal_delivery", "Delivery"),
    ("ice_cream_shop", "Desserts"),
    ("buffet_restaurant", "Buffet"),
    ("breakfast_restaurant", "Breakfast"),
    ("brunch_restaurant", "Brunch"),
    ("coffee_shop", "Coffee"),
    ("food_court", "Food Court"),
)

# Case-sensitive substring category rules.  Rule order decides: the first
# needle contained anywhere in the raw text wins.
CONTAINS_CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    ("indian_restaurant", "Indian"),
    ("chinese_restaurant", "Chinese"),
    ("italian_restaurant", "Italian"),
    ("japanese_restaurant", "Japanese"),
    ("thai_restaurant", "Thai"),
    ("seafood_restaurant", "Seafood"),
    ("fast_food_restaurant", "Fast Food"),
    ("pizza_restaurant", "Pizza"),
    ("hamburger_restaurant", "Burgers"),
    ("vegetarian_restaurant", "Vegetarian"),
    ("steak_house", "Steakhouse"),
    ("sushi_restaurant", "Sushi"),
    ("korean_restaurant", "Korean"),
    ("vietnamese_restaurant", "Vietnamese"),
    ("middle_eastern_restaurant", "Middle Eastern"),
    ("bakery", "Bakery"),
    ("cafe", "Café"),
    ("bar", "Bar & Grill"),
    ("ice_cream_shop", "Desserts"),
)

DEFAULT_CATEGORY = "Restaurant"

# Numbered-area pattern, label prefix and default label.
AREA_PATTERN = r"(?i)Colombo\s+(\d+)"
AREA_PREFIX = "Colombo "
DEFAULT_AREA = "Colombo"

# Named areas, in match order (first listed substring found wins,
# case-insensitive).
NAMED_AREAS: tuple[str, ...] = (
    "Nugegoda",
    "Dehiwala",
    "Mount Lavinia",
    "Borella",
    "Pettah",
    "Maradana",
    "Wellawatte",
    "Bambalapitiya",
    "Kollupitiya",
    "Cinnamon Gardens",
    "Fort",
)

# Level (price) vocabularies.
LEVEL_LABELS_SERVING: dict[int, str] = {
    0: "Budget",
    1: "Inexpensive",
    2: "Moderate",
    3: "Expensive",
    4: "Very Expensive",
}
LEVEL_LABELS_ARTEFACT: dict[int, str] = {
    0: "Free",
    1: "Budget",
    2: "Moderate",
    3: "Expensive",
    4: "Luxury",
}
UNKNOWN_LEVEL = "Unknown"

# Output defaults applied at the edge.
DEFAULT_NAME = "Unknown"
DEFAULT_BASE_RATING = 3.0

# Model / serving parameters.
ALS_RANK = 10
ALS_MAX_ITER = 10
ALS_REG_PARAM = 0.1
SEED = 42
TRAIN_FRACTION = 0.8
RATINGS_PER_USER = (20, 50)
MIN_REVIEWS = 10
TOP_LIST_SIZE = 50
TRENDING_K = 5
BROWSE_DEFAULT_LIMIT = 50
BROWSE_MAX_LIMIT = 200
RECOMMEND_DEFAULT_N = 10
RECOMMEND_MAX_N = 50
TOP_LIST_READ_DEFAULT = 20
TOP_LIST_READ_MAX = 100
RATING_MIN = 0.5
RATING_MAX = 5.0
SORT_KEYS = ("rating", "popularity", "reviews", "price")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AreaRules:
    """How an address-like text becomes an area label."""

    pattern: str = AREA_PATTERN
    prefix: str = AREA_PREFIX
    named: tuple[str, ...] = NAMED_AREAS
    default: str = DEFAULT_AREA
    mode: str = "intpad"  # "intpad" (integer pad + named areas) or "lpad2"


@dataclass(frozen=True)
class RuleSet:
    """Everything ``prepare_catalog`` needs to label a catalogue.

    ``category_mode`` is ``"tokens"`` (exact token, row order decides) or
    ``"contains"`` (substring, rule order decides).
    """

    category_mode: str = "tokens"
    token_rules: tuple[tuple[str, str], ...] = TOKEN_CATEGORY_RULES
    contains_rules: tuple[tuple[str, str], ...] = CONTAINS_CATEGORY_RULES
    default_category: str = DEFAULT_CATEGORY
    area: AreaRules = field(default_factory=AreaRules)
    level_labels: dict[int, str] = field(default_factory=lambda: dict(LEVEL_LABELS_ARTEFACT))
    unknown_level: str = UNKNOWN_LEVEL


# The two behaviours the original serving and artefact code paths had.
ARTEFACT_RULES = RuleSet()
SERVING_RULES = RuleSet(
    category_mode="contains",
    area=AreaRules(named=(), mode="lpad2"),
    level_labels=dict(LEVEL_LABELS_SERVING),
)
