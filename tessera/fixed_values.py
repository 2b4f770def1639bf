"""Values that results depend on. All of them are fixed values, stated as text."""

# The number a cell starts with.
PREFIX_NUMBER = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

# Column classes.
NUMERIC_SHARE = 0.9
CATEGORY_MAX_DISTINCT = 20
CATEGORY_MAX_SHARE = 0.5
SAMPLE_SIZE = 5
SUMMARY_TEXT = "Dataset with %d rows and %d columns. %d numeric features available for clustering."

# Input guard and preview.
MIN_ROWS = 10
PREVIEW_ROWS = 5
PREVIEW_COLUMNS = 8
PREVIEW_CHARS = 20

# Feature recommendation.
UNREADABLE_COLUMNS, UNREADABLE_CONFIDENCE = 3, 0.6
NONE_VALID_COLUMNS, NONE_VALID_CONFIDENCE = 6, 0.7
FAILED_COLUMNS = 4
ANSWER_CONFIDENCE = 0.8
NONE_VALID_REASONING = "Using available numeric features for clustering analysis."
ANSWER_REASONING = "Features selected for customer segmentation."

# Segmentation.
DEFAULT_K, MIN_K, MAX_K = 5, 2, 10
SEEDS = (42, 43, 44, 45, 46)
MAX_ROUNDS = 100
COMPONENTS = 2
TOP_FEATURES = 5

# Quality labels, as (lower bound, label), first match wins.
REPORT_QUALITY = ((0.5, "Good"), (0.25, "Fair"))
SCREEN_QUALITY = ((0.5, "Excellent"), (0.35, "Good"), (0.2, "Fair"))
LOWEST_QUALITY = "Weak"
QUALITY_ADVICE = {
    "Excellent": "Excellent cluster separation. Segments are well-defined and distinct.",
    "Good": "Good cluster separation. Segments are reasonably distinct.",
    "Fair": "Fair cluster separation. Some overlap between segments exists.",
    "Weak": "Weak cluster separation. Consider using different features or fewer clusters.",
}

# Texts of a segment nobody has interpreted.
DEFAULT_SEGMENT_NAME = "Segment %d"
DEFAULT_CHARACTERISTICS = ("Customer segment identified",)
DEFAULT_DESCRIPTION = "A segment of %d customers with distinct behavioral patterns."
DEFAULT_ACTIONS = ("Analyze segment", "Develop campaigns")
UNREADABLE_DESCRIPTION = "A segment of %d customers"
UNREADABLE_ACTIONS = ("Analyze further",)

# Churn.
CHURN_WINDOW_DAYS = 90
OBSERVATION_DAYS = 365
RETAIL_BASE_RATE = 0.25
FINTECH_BASE_RATE = 0.20
RECENCY_SLOPE, RECENCY_MIDPOINT, RECENCY_WEIGHT = 0.02, 60, 0.6
SESSION_GAP_MINUTES = 30
TAX_RATE = "0.10"
LARGE_OUTFLOW = 10000
INCOME_CUTS = (50000, 100000, 150000)
INCOME_BANDS = ("<50k", "50-100k", "100-150k", ">150k")
CREDIT_TYPES = ("Transfer In", "Interest Credit", "Payroll Credit", "Refund")
TIER_UP, TIER_DOWN, TIER_SAME = "Upgraded", "Downgraded", "No Change"

# Campaign per segment; unknown segments use DEFAULT_STRATEGY.
DEFAULT_STRATEGY = "New Potential"
STRATEGIES = (
    (
        "High-Value Loyalists",
        "VIP Appreciation Campaign",
        [
            "You deserve the best. Here is your exclusive offer.",
            "A special thank you for being our top customer",
            "Unlock your VIP-only benefits today",
        ],
        "As one of our most valued customers, we wanted to personally thank you for your continued loyalty. To show our appreciation, we are offering you an exclusive 25% discount on your next purchase, plus early access to our upcoming product launches.",
        "Hi [Name]! As a VIP customer, enjoy 25% off your next order. Use code VIP25 at checkout. Shop now: [link]",
    ),
    (
        "At-Risk Champions",
        "Win-Back Re-engagement",
        [
            "We miss you. Come back for 30% off.",
            "Your account has special rewards waiting",
            "It has been a while. Let us make it up to you.",
        ],
        "We noticed it has been a while since your last visit, and we miss having you as part of our community. We would love to welcome you back with an exclusive 30% discount and free shipping on your next order.",
        "Hey [Name], we miss you! Here is 30% off + free shipping to welcome you back. Expires in 48hrs: [link]",
    ),
    (
        "New Potential",
        "Nurture and Educate",
        [
            "Getting started? Here is everything you need to know.",
            "Welcome! Discover what makes us different.",
            "Your journey with us starts here.",
        ],
        "Welcome to our community! We are thrilled to have you here. To help you get the most out of your experience, we have put together a special guide showcasing our most popular products and features.",
        "Welcome to [Brand]! Reply YES to get personalized product recommendations based on your interests.",
    ),
    (
        "Casual Browsers",
        "Conversion Incentive",
        [
            "Still thinking about it? Here is 15% off.",
            "Your cart misses you.",
            "Ready to take the leap? We will sweeten the deal.",
        ],
        "We noticed you have been exploring our collection. To help you make your first purchase, we are offering an exclusive 15% discount for new customers. Plus, enjoy free returns for 30 days.",
        "Still browsing? Grab 15% off your first order with code FIRST15. Free returns included! Shop: [link]",
    ),
    (
        "Dormant Users",
        "Reactivation Campaign",
        [
            "A lot has changed. Come see what is new.",
            "We have got something special just for you.",
            "Ready for a fresh start? 40% off inside.",
        ],
        "It has been a while! We have made some exciting updates and would love for you to see what is new. As a special welcome-back offer, enjoy 40% off your next purchase. This is our way of saying we would love to reconnect.",
        "Long time no see! We have got a 40% off surprise waiting for you. Valid this week only: [link]",
    ),
)
