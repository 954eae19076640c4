"""Rule scorecards R1-R5, R10, R12 and the plan bonus T8 as column expressions.

A scorecard is data: a list of groups, each a list of (condition, points)
tiers with an ``else`` value.  The first matching tier of a group counts, the
groups are added left to right, then the sum is clipped and rounded to 4
digits before it is compared with the threshold.  Everything folds into one
projection (no UDF), so scoring a table is a single codegen'd stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Cond = Callable[[], Column]


def c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Card:
    name: str
    groups: Sequence[tuple[Sequence[tuple[Cond, float]], float]]
    threshold: float
    clip_low: float | None
    labels: tuple[str, str]          # (label when 0, label when 1)


def tiers(conds: Sequence[tuple[Cond, float]], otherwise: float = 0.0) -> Column:
    expr = None
    for cond, pts in conds:
        expr = F.when(cond(), F.lit(pts)) if expr is None else expr.when(cond(), F.lit(pts))
    return F.lit(otherwise) if expr is None else expr.otherwise(F.lit(otherwise))


def plan_bonus(plan_col: str, table: dict[str, float], other: float) -> Column:
    """Map lookup with a default for unknown plans."""
    return tiers([((lambda p=p: c(plan_col) == p), v) for p, v in table.items()], other)


# Plan bonus of the sales and design scorecards; unknown plan 0.02.
SALES_PLAN_BONUS = {"free": 0.0, "basic": 0.03, "pro": 0.05, "enterprise": 0.05}
DESIGN_PLAN_BONUS = {"free": 0.0, "basic": 0.03, "pro": 0.06, "enterprise": 0.06}
UNKNOWN_PLAN_BONUS = 0.02

# Sales scorecard (threshold 0.55, score capped at 1).
SALES = Card("sales", [
    ([(lambda: c("price").between(5, 200), 0.20),
      (lambda: (c("price") < 5) | (c("price") > 500), 0.05)], 0.12),
    ([(lambda: c("discount_pct") >= 10, 0.15), (lambda: c("discount_pct") > 0, 0.08)], 0.0),
    ([(lambda: c("stock") == 0, 0.0), (lambda: (c("stock") == -1) | (c("stock") >= 10), 0.15)], 0.08),
    ([(lambda: c("images_count") >= 4, 0.15), (lambda: c("images_count") >= 2, 0.10),
      (lambda: c("images_count") == 1, 0.04)], 0.0),
    ([(lambda: c("description_length") >= 400, 0.10), (lambda: c("description_length") >= 150, 0.06),
      (lambda: c("description_length") >= 50, 0.02)], 0.0),
    ([(lambda: c("payment_settings_enabled") == 1, 0.10)], 0.0),
    ([(lambda: c("has_whatsapp") == 1, 0.05)], 0.0),
    ([(lambda: c("featured") == 1, 0.05)], 0.0),
    ([((lambda p=p: c("plan_id") == p), v) for p, v in SALES_PLAN_BONUS.items()], UNKNOWN_PLAN_BONUS),
], threshold=0.55, clip_low=None, labels=("wont_sell", "will_sell"))

# Churn scorecard (threshold 0.40, score capped at 1).
CHURN = Card("churn", [
    ([(lambda: c("days_since_last_order") >= 60, 0.30), (lambda: c("days_since_last_order") >= 30, 0.20),
      (lambda: c("days_since_last_order") >= 14, 0.08)], 0.0),
    ([(lambda: c("total_orders_paid") == 0, 0.25), (lambda: c("total_orders_paid") == 1, 0.18),
      (lambda: c("total_orders_paid") <= 3, 0.08)], 0.0),
    ([(lambda: c("avg_order_value") < 20, 0.10), (lambda: c("avg_order_value") < 50, 0.05)], 0.0),
    ([(lambda: c("cancellation_rate") >= 0.30, 0.15), (lambda: c("cancellation_rate") >= 0.12, 0.08)], 0.0),
    ([(lambda: (c("profile_visits_count") >= 10) & (c("total_orders_paid") == 0), 0.10),
      (lambda: c("profile_visits_count") == 0, 0.08)], 0.0),
    ([(lambda: c("preferred_payment_method") == "cash", 0.05)], 0.0),
], threshold=0.40, clip_low=None, labels=("stable", "at_risk"))

# Design scorecard (threshold 0.50, score clipped to 0..1).
DESIGN = Card("design", [
    ([(lambda: c("payment_settings_enabled") == 1, 0.20)], 0.0),
    ([(lambda: c("hero_has_cta") == 1, 0.12)], 0.0),
    ([(lambda: c("has_custom_logo") == 1, 0.06)], 0.0),
    ([(lambda: c("has_cover_image") == 1, 0.06)], 0.0),
    ([(lambda: c("products_with_image_pct") >= 0.90, 0.12), (lambda: c("products_with_image_pct") >= 0.70, 0.08),
      (lambda: c("products_with_image_pct") >= 0.50, 0.04)], 0.0),
    ([(lambda: c("products_with_description_pct") >= 0.80, 0.10),
      (lambda: c("products_with_description_pct") >= 0.55, 0.06),
      (lambda: c("products_with_description_pct") >= 0.30, 0.02)], 0.0),
    ([(lambda: c("avg_images_per_product") >= 3.0, 0.08), (lambda: c("avg_images_per_product") >= 2.0, 0.05)], 0.0),
    ([(lambda: c("navigation_menu_items_count").between(3, 8), 0.05),
      (lambda: c("navigation_menu_items_count") > 12, -0.03)], 0.0),
    ([(lambda: c("products_with_discount_pct") >= 0.20, 0.06),
      (lambda: c("products_with_discount_pct") >= 0.05, 0.03)], 0.0),
    ([((lambda p=p: c("plan_id") == p), v) for p, v in DESIGN_PLAN_BONUS.items()], UNKNOWN_PLAN_BONUS),
], threshold=0.50, clip_low=0.0, labels=("medium_low", "high_conversion"))


def channels() -> Column:
    """Number of active social channels."""
    return c("has_instagram") + c("has_tiktok") + c("has_facebook") + c("has_whatsapp")


# Growth scorecard (threshold 0.45, score clipped to 0..1).
GROWTH = Card("growth", [
    ([(lambda: c("days_between_posts") <= 1.5, 0.18), (lambda: c("days_between_posts") <= 3.0, 0.12),
      (lambda: c("days_between_posts") <= 5.0, 0.05)], 0.0),
    ([(lambda: c("posts_count_30d") >= 15, 0.10), (lambda: c("posts_count_30d") >= 8, 0.06),
      (lambda: c("posts_count_30d") >= 3, 0.02)], 0.0),
    ([(lambda: c("stories_count_30d") >= 25, 0.08), (lambda: c("stories_count_30d") >= 12, 0.05)], 0.0),
    ([(lambda: c("pct_posts_with_video") >= 0.60, 0.10), (lambda: c("pct_posts_with_video") >= 0.35, 0.06),
      (lambda: c("pct_posts_with_video") >= 0.15, 0.02)], 0.0),
    ([(lambda: c("post_engagement_rate") >= 0.06, 0.12), (lambda: c("post_engagement_rate") >= 0.03, 0.07),
      (lambda: c("post_engagement_rate") >= 0.01, 0.03)], 0.0),
    ([(lambda: c("avg_rating") >= 4.7, 0.08), (lambda: c("avg_rating") >= 4.2, 0.05),
      (lambda: c("avg_rating") < 3.5, -0.05)], 0.0),
    ([(lambda: c("pct_1_2_star") <= 0.05, 0.04), (lambda: c("pct_1_2_star") >= 0.20, -0.04)], 0.0),
    ([(lambda: channels() >= 3, 0.08), (lambda: channels() >= 2, 0.05), (lambda: channels() == 1, 0.02)], 0.0),
], threshold=0.45, clip_low=0.0, labels=("stable_or_down", "will_grow"))

CARDS = {card.name: card for card in (SALES, CHURN, DESIGN, GROWTH)}


def raw_score(card: Card) -> Column:
    """Sum of the groups, added left to right from 0.0."""
    total = F.lit(0.0)
    for conds, otherwise in card.groups:
        total = total + tiers(conds, otherwise)
    return total


def probability(card: Card) -> Column:
    """Clip (upper 1, lower as the card says) and round to 4 digits."""
    s = F.least(raw_score(card), F.lit(1.0))
    if card.clip_low is not None:
        s = F.greatest(s, F.lit(card.clip_low))
    return F.round(s, 4)


def decision(card: Card, prob: str = "probability") -> Column:
    """1 when the rounded probability reaches the threshold."""
    return (F.col(prob) >= F.lit(card.threshold)).cast("int")


def decision_label(card: Card, pred: str = "prediction") -> Column:
    return F.when(F.col(pred) == 1, F.lit(card.labels[1])).otherwise(F.lit(card.labels[0]))


def confidence_band(prob: str = "probability") -> Column:
    """> 0.7 high, 0.4..0.7 moderate, < 0.4 low."""
    p = F.col(prob)
    return F.when(p > 0.7, "high").when(p >= 0.4, "moderate").otherwise("low")
