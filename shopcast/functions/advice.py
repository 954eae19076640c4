"""Recommendations R6-R9: each rule that fires adds a short code; none -> default.

``array_compact(array(when ...))`` keeps the fired codes in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col

# Trigger conditions and our own short codes, in rule order.
SALES_ADVICE = (
    [(lambda: c("discount_pct") == 0, "try_small_discount"),
     (lambda: c("images_count") < 3, "add_photos"),
     (lambda: c("description_length") < 150, "improve_description"),
     (lambda: c("stock") == 0, "restock"),
     (lambda: c("payment_settings_enabled") == 0, "enable_online_payments")],
    "listing_ok_ab_test_price")
CHURN_ADVICE = (
    [(lambda: c("days_since_last_order") >= 30, "winback_message"),
     (lambda: c("total_orders_paid") <= 1, "second_purchase_campaign"),
     (lambda: c("cancellation_rate") >= 0.12, "reduce_friction"),
     (lambda: (c("profile_visits_count") >= 15) & (c("total_orders_paid") == 0), "intent_coupon"),
     (lambda: c("preferred_payment_method") == "cash", "offer_card_or_transfer")],
    "healthy_upsell")
DESIGN_ADVICE = (
    [(lambda: c("payment_settings_enabled") == 0, "enable_online_payments"),
     (lambda: c("hero_has_cta") == 0, "add_hero_cta"),
     (lambda: c("navigation_menu_items_count") > 9, "shorten_menu"),
     (lambda: c("products_with_image_pct") < 0.75, "add_product_photos"),
     (lambda: c("products_with_description_pct") < 0.55, "improve_descriptions"),
     (lambda: c("avg_images_per_product") < 2.0, "more_images_per_product")],
    "design_ok_ab_test")
GROWTH_ADVICE = (
    [(lambda: c("pct_posts_with_video") < 0.45, "more_video"),
     (lambda: c("days_between_posts") > 4, "post_more_often"),
     (lambda: c("stories_count_30d") < 12, "more_stories"),
     (lambda: c("post_engagement_rate") < 0.03, "improve_engagement"),
     (lambda: c("pct_1_2_star") > 0.10, "handle_bad_reviews"),
     (lambda: c("avg_rating") < 4.2, "improve_reputation"),
     (lambda: c("has_whatsapp") == 0, "enable_whatsapp")],
    "content_ok_ab_test")

ADVICE = {"sales": SALES_ADVICE, "churn": CHURN_ADVICE, "design": DESIGN_ADVICE, "growth": GROWTH_ADVICE}


def recommendations(kind: str) -> Column:
    rules, default = ADVICE[kind]
    fired = F.array_compact(F.array(*[F.when(cond(), F.lit(code)) for cond, code in rules]))
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(default)))
