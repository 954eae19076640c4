"""Golden rows: the reference's 12 manual requests, scored by hand (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from shopcast.operators.scoring import predict

SALES_SCHEMA = ("price double, discount_pct double, stock int, images_count int, description_length int, "
                "featured int, payment_settings_enabled int, has_whatsapp int, plan_id string, "
                "business_type_slug string, business_category_slug string, id int")
CHURN_SCHEMA = ("days_since_last_order int, total_orders_paid int, avg_order_value double, cancellation_rate double, "
                "profile_visits_count int, link_click_to_order_ratio double, preferred_payment_method string, "
                "preferred_notification string, id int")
DESIGN_SCHEMA = ("payment_settings_enabled int, hero_has_cta int, hero_slides_count int, "
                 "navigation_menu_items_count int, has_custom_logo int, has_cover_image int, "
                 "products_with_image_pct double, products_with_description_pct double, total_products_active int, "
                 "products_with_discount_pct double, avg_images_per_product double, plan_id string, "
                 "template_slug string, business_type_slug string, id int")
GROWTH_SCHEMA = ("posts_count_30d int, stories_count_30d int, pct_posts_with_video double, days_between_posts double, "
                 "avg_views_per_post double, avg_likes_per_post double, avg_comments_per_post double, "
                 "avg_rating double, pct_1_2_star double, reviews_with_photo_pct double, "
                 "post_engagement_rate double, business_type_slug string, has_instagram int, has_tiktok int, "
                 "has_facebook int, has_whatsapp int, id int")

N = None
SALES_ROWS = [
    (55.0, 10.0, 30, 4, 500, 1, 1, 1, "pro", "store", "retail", 1),
    (120.0, 0.0, 0, 0, 20, 0, 0, 0, "free", "store", "retail", 2),
    (35.0, N, N, N, N, N, N, N, N, N, N, 3),
]
CHURN_ROWS = [
    (45, 1, 35.0, 0.20, 3, 0.5, "cash", "sms", 1),
    (5, 12, 150.0, 0.02, 20, 2.5, "card", "whatsapp", 2),
    (15, 3, 80.0, N, N, N, N, N, 3),
]
DESIGN_ROWS = [
    (1, 1, 3, 6, 1, 1, 0.92, 0.85, 80, 0.30, 3.5, "pro", "NikeStyle", "store", 1),
    (0, 0, 1, 12, 0, 0, 0.40, 0.25, 10, 0.05, 1.0, "free", "Minimal", "store", 2),
    (N, N, N, N, N, N, N, N, N, N, N, N, N, N, 3),
]
GROWTH_ROWS = [
    (18, 35, 0.65, 1.7, 3000.0, 120.0, 15.0, 4.8, 0.02, 0.35, 0.06, "store", 1, 1, 1, 1, 1),
    (2, 3, 0.10, 15.0, 100.0, 5.0, 0.5, 3.8, 0.20, 0.05, 0.01, "restaurant", 0, 0, 0, 1, 2),
    (N, N, N, N, N, N, N, N, N, N, N, N, N, N, N, N, 3),
]

GOLDEN = {
    "sales": (SALES_SCHEMA, SALES_ROWS, [(1.00, 1), (0.20, 0), (0.73, 1)],
              [["listing_ok_ab_test_price"],
               ["try_small_discount", "add_photos", "improve_description", "restock", "enable_online_payments"],
               ["try_small_discount"]]),
    "churn": (CHURN_SCHEMA, CHURN_ROWS, [(0.56, 1), (0.00, 0), (0.21, 0)],
              [["winback_message", "second_purchase_campaign", "reduce_friction", "offer_card_or_transfer"],
               ["healthy_upsell"], ["offer_card_or_transfer"]]),
    "design": (DESIGN_SCHEMA, DESIGN_ROWS, [(0.91, 1), (0.03, 0), (0.77, 1)],
               [["design_ok_ab_test"],
                ["enable_online_payments", "add_hero_cta", "shorten_menu", "add_product_photos",
                 "improve_descriptions", "more_images_per_product"],
                ["design_ok_ab_test"]]),
    "growth": (GROWTH_SCHEMA, GROWTH_ROWS, [(0.72, 1), (0.01, 0), (0.53, 1)],
               [["content_ok_ab_test"],
                ["more_video", "post_more_often", "more_stories", "improve_engagement", "handle_bad_reviews",
                 "improve_reputation"],
                ["content_ok_ab_test"]]),
}


@pytest.mark.parametrize("kind", sorted(GOLDEN))
def test_golden_requests(spark, kind):
    schema, rows, expected, recs = GOLDEN[kind]
    df = spark.createDataFrame(rows, schema)
    out, bad = predict(df, kind, "id")
    got = {r["id"]: r for r in out.collect()}
    assert bad.count() == 0
    for i, (p, d) in enumerate(expected, start=1):
        assert got[i]["probability"] == pytest.approx(p, abs=1e-9), (kind, i)
        assert got[i]["prediction"] == d, (kind, i)
        assert list(got[i]["recommendations"]) == recs[i - 1], (kind, i)


def test_sales_edges(spark):
    rows = [(p, "x") for p in (4.99, 5.0, 200.0, 200.01, 500.0, 500.01)]
    df = spark.createDataFrame(rows, "price double, plan_id string").withColumn(
        "stock", F.lit(-5)).withColumn("images_count", F.lit(0)).withColumn("description_length", F.lit(0)) \
        .withColumn("payment_settings_enabled", F.lit(0)).withColumn("has_whatsapp", F.lit(0)) \
        .withColumn("featured", F.lit(0)).withColumn("discount_pct", F.lit(0.0))
    from shopcast.functions.scorecards import SALES, probability
    got = [r[0] for r in df.select(probability(SALES)).collect()]
    # price points + negative stock (+0.08) + unknown plan (+0.02)
    assert got == pytest.approx([0.15, 0.30, 0.30, 0.22, 0.22, 0.15])


def test_missing_required_goes_to_reject(spark):
    df = spark.createDataFrame([(None, 1), (10.0, 2)], "price double, id int")
    out, bad = predict(df, "sales", "id")
    assert [r["id"] for r in out.collect()] == [2]
    assert [(r["id"], list(r["errors"])) for r in bad.collect()] == [(1, ["missing:price"])]


def test_confidence_band(spark):
    from shopcast.functions.scorecards import confidence_band
    df = spark.createDataFrame([(0.39,), (0.4,), (0.7,), (0.71,)], "probability double")
    assert [r[0] for r in df.select(confidence_band()).collect()] == ["low", "moderate", "moderate", "high"]
