"""Policy values of the pricing watch.

Everything here is a FIXED VALUE: results are only right when these equal the
values of the system whose answers we reproduce.  They are kept together, in
natural order, as plain text.  The tables that a caller may want to replace are
bundled at the end (link weights, page signals, crawl delays, plan tiers), and
operators take a bundle as a keyword argument with these values as its default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: clocks (seconds) -------------------------------------------
CRAWL_LEASE_SECONDS = 6 * 60
OK_DELAY_SECONDS = 24 * 3600
ERROR_DELAY_SECONDS = 6 * 3600
BLOCKED_DELAY_SECONDS = 36 * 3600
MANUAL_DELAY_SECONDS = 48 * 3600
DELIVERY_LOCK_SECONDS = 5 * 60
DIGEST_LOOKBACK_DAYS = 7
OVERVIEW_WINDOW_DAYS = 7
TRIAL_DAYS = 7

# --- fixed values: thresholds and limits ------------------------------------------
DEFAULT_CRAWL_LIMIT = 3
MAX_CRAWL_LIMIT = 20
VERIFIED_CONFIDENCE = 0.75
DISCOVERY_MIN_CONFIDENCE = 0.35
DISCOVERY_MAX_CANDIDATES = 8
PRIMARY_MIN_CONFIDENCE = 0.86
PRIMARY_MIN_GAP = 0.08
DIGEST_MAX_DIFFS = 30
FEED_DEFAULT_LIMIT = 20
FEED_MAX_LIMIT = 100
ERROR_TEXT_LIMIT = 400
AUDIT_TEXT_LIMIT = 500
AUDIT_KEY_LIMIT = 40
AUDIT_DEPTH_LIMIT = 3
PLAN_HEADING_MAX_CHARS = 80
MIN_ABSOLUTE_CHANGE = 0.5
MIN_PERCENT_CHANGE = 1.0

# --- fixed values: enum domains ------------------------------------------------------
PERIODS = ("day", "week", "month", "year", "one_time", "unknown")
CRAWL_STATUSES = ("idle", "ok", "blocked", "manual_needed", "error")
SEVERITIES = ("low", "medium", "high")
VERIFICATION_STATES = ("verified", "unverified")
COMPANY_TYPES = ("self", "competitor")
BILLING_PERIODS = ("month", "year", "custom")

# --- fixed values: period words on a page -> period -----------------------------------
PERIOD_WORDS = {
    "day": "day", "daily": "day", "d": "day",
    "week": "week", "weekly": "week", "wk": "week", "w": "week",
    "month": "month", "monthly": "month", "mo": "month", "m": "month",
    "year": "year", "yearly": "year", "annual": "year", "annually": "year",
    "yr": "year", "y": "year",
    "once": "one_time", "one-time": "one_time", "onetime": "one_time",
}

# --- fixed values: currency symbols and codes -------------------------------------------
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_CODES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY")

# --- fixed values: phrases looked for in lower-cased page text -----------------------------
BLOCKED_SIGNALS = (
    "access denied", "temporarily blocked", "captcha", "cloudflare",
    "attention required", "verify you are human", "bot detection",
)
PRICING_SIGNALS = (
    "pricing", "plans", "per month", "monthly", "yearly", "annual", "billed",
    "free trial",
)
CUSTOM_PRICING_SIGNALS = (
    "contact sales", "custom pricing", "talk to sales", "enterprise pricing",
    "request a quote", "book a demo",
)
PLAN_HEADING_WORDS = ("plan", "pricing", "starter", "pro", "business", "enterprise")
BLOCKED_HTTP_STATUSES = (401, 403, 429)

# --- fixed values: confidence by evidence ------------------------------------------------------
CONFIDENCE_MANY_PRICES = 0.9
CONFIDENCE_PRICE_AND_SIGNAL = 0.78
CONFIDENCE_PRICE_ONLY = 0.72
CONFIDENCE_CUSTOM_HINT = 0.45
CONFIDENCE_SIGNAL_ONLY = 0.4

# --- fixed values: link scoring (pattern, weight) ---------------------------------------------
# Patterns see lower-cased input.  WORD marks an ASCII word boundary.
PATH_PLUS = (
    (r"^/pricing(?:/|$)", 0.85),
    (r"^/plans?(?:/|$)", 0.78),
    (r"(?:^|/)(pricing|plans?)(?:/|$)", 0.52),
    (r"(?:^|/)(subscriptions?|billing|cost|prices?)(?:/|$)", 0.35),
)
TEXT_PLUS = (
    (r"\bpricing\b", 0.42),
    (r"\bplans?\b", 0.38),
    (r"\bcompare plans?\b", 0.26),
    (r"\bfree trial\b", 0.22),
    (r"\bsubscriptions?\b", 0.20),
    (r"\bget started\b", 0.14),
)
PATH_MINUS = (
    (r"(?:^|/)(blog|docs?|documentation|help|support)(?:/|$)", 0.35),
    (r"(?:^|/)(about|contact|careers?|jobs?|team)(?:/|$)", 0.25),
    (r"(?:^|/)(privacy|terms|legal|status)(?:/|$)", 0.45),
    (r"(?:^|/)(login|signin|sign-in|signup|sign-up|register|auth)(?:/|$)", 0.35),
    (r"\.(?:png|jpe?g|svg|gif|webp|pdf|zip|xml)$", 1.0),
)
TEXT_MINUS = (
    (r"\bblog\b", 0.30),
    (r"\bdocs?\b", 0.30),
    (r"\bhelp\b", 0.25),
    (r"\blogin\b|\bsign in\b|\bsign up\b", 0.25),
)
LINK_BASE_SCORE = 0.04
LINK_AGREEMENT_BONUS = 0.12
LINK_ROOT_PENALTY = 0.12

# --- fixed values: subscription plans ----------------------------------------------------------
# (ordinal, tier, competitor limit, gate, weekly digest)
PLAN_TIERS = {
    "starter": dict(competitor_limit=3, gate="high_only", digest=True),
    "pro": dict(competitor_limit=10, gate="high_and_medium", digest=True),
}
SEVERITY_GATES = {"high_only": ("high",), "high_and_medium": ("high", "medium")}
TRIAL_TIER = "starter"
PAID_FALLBACK_TIER = "starter"

# --- fixed values: subscription states ----------------------------------------------------------
GRANTING_SUBSCRIPTION_STATES = ("active", "trialing", "past_due")
REVOKING_SUBSCRIPTION_STATES = ("canceled", "incomplete_expired", "unpaid")

# --- fixed values: texts that appear in results ---------------------------------------------------
TEXT_INVALID_URL = "Invalid pricing URL"
TEXT_NOT_HTML = "Pricing URL did not return HTML content"
TEXT_BOT_PREFIX = "Bot protection detected: "
TEXT_NO_SIGNALS = "Pricing signals not detected on the page"
TEXT_NO_FETCH = "Unknown fetch error"
TEXT_NO_URL = "No crawl URL is available"
TEXT_NO_USER = "User not found for company"
TEXT_NOT_ELIGIBLE = "User is not eligible for competitor crawling"
TEXT_UNKNOWN_COMPANY = "Unknown company"
TEXT_ACTION_REVIEW = "Review competitor positioning and update your pricing strategy within 24 hours."
TEXT_ACTION_COMPARE = "Compare changed price points against your plan tiers and conversion funnel performance."
TEXT_ACTION_AUDIT = "Audit your sales messaging for affected segments and adjust objection handling."
TEXT_ACTION_VERIFY = "Manually verify the competitor pricing page before acting on this change."
TEXT_ACTION_MONITOR = "Monitor this competitor for repeated movement before making pricing changes."
TEXT_HEADLINE = ("Competitor pricing moved (", ")")
TEXT_SUMMARY_UPDATED = " existing price points changed."
INSIGHT_MODEL = "rules-v1"
TEXT_SUMMARY_NEW = "New pricing structure changes were detected."

# --- fixed values: lifecycle event -> (actor, resource, status) --------------------------------------
AUDIT_EVENTS = {
    "trial_started": ("user", "trial", "success"),
    "trial_start_blocked": ("user", "trial", "rejected"),
    "company_created": ("user", "company", "success"),
    "competitor_cap_hit": ("user", "company", "rejected"),
    "primary_pricing_url_changed": ("user", "company", "success"),
    "webhook_access_granted": ("stripe_webhook", "webhook", "success"),
    "webhook_access_revoked": ("stripe_webhook", "webhook", "success"),
    "crawl_blocked": ("cron", "crawl", "rejected"),
    "crawl_manual_needed": ("cron", "crawl", "rejected"),
    "crawl_error": ("cron", "crawl", "rejected"),
}

# --- fixed values: where lifecycle events come from ---------------------------------------------------
AUDIT_SOURCES = {
    "trial": "api:trial.start",
    "company": "api:companies.post",
    "primary": "api:companies.primary-pricing.patch",
    "crawl": "crawler:runner",
}

# --- fixed values: request budgets (name -> (max requests, window seconds)) ---------------------------
REQUEST_BUDGETS = {
    "company-create": (10, 60),
    "self-pricing-put": (12, 60),
    "trial-start": (3, 60),
    "discover-pricing": (6, 60),
    "primary-pricing": (12, 60),
    "crawl-now": (10, 60),
    "retry-crawl": (10, 60),
}


# --- bundles that operators take as arguments ----------------------------------------------------------
Weights = tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class LinkPolicy:
    """How links are scored and when one of them is the clear winner."""

    path_plus: Weights = PATH_PLUS
    text_plus: Weights = TEXT_PLUS
    path_minus: Weights = PATH_MINUS
    text_minus: Weights = TEXT_MINUS
    base: float = LINK_BASE_SCORE
    agreement_bonus: float = LINK_AGREEMENT_BONUS
    root_penalty: float = LINK_ROOT_PENALTY
    primary_confidence: float = PRIMARY_MIN_CONFIDENCE
    primary_gap: float = PRIMARY_MIN_GAP


@dataclass(frozen=True)
class PagePolicy:
    """Phrases looked for in page text, which the caller gives in lower case, and statuses that mean a block."""

    blocked: tuple[str, ...] = BLOCKED_SIGNALS
    pricing: tuple[str, ...] = PRICING_SIGNALS
    custom: tuple[str, ...] = CUSTOM_PRICING_SIGNALS
    blocked_statuses: tuple[int, ...] = BLOCKED_HTTP_STATUSES


@dataclass(frozen=True)
class CrawlPolicy:
    """Seconds until the next look by outcome, and those of a lease."""

    ok: int = OK_DELAY_SECONDS
    blocked: int = BLOCKED_DELAY_SECONDS
    manual_needed: int = MANUAL_DELAY_SECONDS
    error: int = ERROR_DELAY_SECONDS
    lease: int = CRAWL_LEASE_SECONDS


@dataclass(frozen=True)
class TierPolicy:
    """What each plan tier allows, and the tiers of trials and of prices that no plan knows."""

    tiers: dict[str, dict] = field(default_factory=lambda: PLAN_TIERS)
    gates: dict[str, tuple[str, ...]] = field(default_factory=lambda: SEVERITY_GATES)
    trial: str = TRIAL_TIER
    fallback: str = PAID_FALLBACK_TIER


LINKS, PAGES, CRAWLS, TIERS = LinkPolicy(), PagePolicy(), CrawlPolicy(), TierPolicy()
