"""Table scoring R11: defaults (C18) -> validation (C19) -> score -> decide -> advise.

One projection per entity table: no shuffle, whole-stage codegen.  Rejected
rows keep their error codes in a separate DataFrame (the quarantine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.advice import recommendations
from shopcast.functions.scorecards import CARDS, decision, decision_label, probability
from shopcast.operators.cleaning import apply_defaults, validate_split

# Request defaults and required fields of the four entity records.
SALES_DEFAULTS = {
    "discount_pct": 0.0, "stock": 30, "images_count": 3, "description_length": 400, "featured": 0,
    "payment_settings_enabled": 1, "has_whatsapp": 1, "plan_id": "basic",
    "business_type_slug": "store", "business_category_slug": "retail",
}
SALES_REQUIRED = ["price"]
CHURN_DEFAULTS = {
    "cancellation_rate": 0.05, "profile_visits_count": 10, "link_click_to_order_ratio": 1.2,
    "preferred_payment_method": "cash", "preferred_notification": "whatsapp",
}
CHURN_REQUIRED = ["days_since_last_order", "total_orders_paid", "avg_order_value"]
DESIGN_DEFAULTS = {
    "payment_settings_enabled": 1, "hero_has_cta": 1, "hero_slides_count": 2,
    "navigation_menu_items_count": 5, "has_custom_logo": 1, "has_cover_image": 1,
    "products_with_image_pct": 0.80, "products_with_description_pct": 0.60,
    "total_products_active": 60, "products_with_discount_pct": 0.25, "avg_images_per_product": 2.5,
    "plan_id": "basic", "template_slug": "Minimal", "business_type_slug": "store",
}
DESIGN_REQUIRED: list[str] = []
GROWTH_DEFAULTS = {
    "posts_count_30d": 10, "stories_count_30d": 20, "pct_posts_with_video": 0.50,
    "days_between_posts": 3.0, "avg_views_per_post": 1500.0, "avg_likes_per_post": 60.0,
    "avg_comments_per_post": 6.0, "avg_rating": 4.5, "pct_1_2_star": 0.05,
    "reviews_with_photo_pct": 0.20, "post_engagement_rate": 0.04, "business_type_slug": "store",
    "has_instagram": 1, "has_tiktok": 1, "has_facebook": 1, "has_whatsapp": 1,
}
GROWTH_REQUIRED: list[str] = []

DEFAULTS = {"sales": SALES_DEFAULTS, "churn": CHURN_DEFAULTS, "design": DESIGN_DEFAULTS,
            "growth": GROWTH_DEFAULTS}
REQUIRED = {"sales": SALES_REQUIRED, "churn": CHURN_REQUIRED, "design": DESIGN_REQUIRED,
            "growth": GROWTH_REQUIRED}


def prepare(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """C18 + C19: (valid rows with defaults applied, rejected rows)."""
    filled = apply_defaults(df, DEFAULTS[kind])
    return validate_split(filled, REQUIRED[kind])


def score(df: DataFrame, kind: str) -> DataFrame:
    """Add probability, prediction, label, threshold and recommendations."""
    card = CARDS[kind]
    return (df.withColumn("probability", probability(card))
              .withColumns({"prediction": decision(card),
                            "threshold": F.lit(card.threshold),
                            "recommendations": recommendations(kind)})
              .withColumn("label", decision_label(card)))


def predict(df: DataFrame, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Unified prediction records for valid rows, plus the reject table."""
    ok, bad = prepare(df, kind)
    out = score(ok, kind).select(key, "probability", "prediction", "label", "threshold", "recommendations")
    return out, bad
