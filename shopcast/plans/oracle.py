"""Independent DuckDB SQL for each catalog query (the correctness oracle).

The SQL is written from the operator definitions, not generated from the Spark
plans.  Tables are the driver's views (lineitem, orders, ...).  Doubles are
rounded to 6 digits, counts cast to BIGINT, small ints to INTEGER, to match the
Spark output types.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = text


# ---------------------------------------------------------------- adapters
SALES_LINES = """
sales_lines AS (
  SELECT (CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
         l.l_partkey AS stock_code,
         p.p_name AS description,
         CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
         l.l_shipdate AS invoice_date,
         l.l_extendedprice / l.l_quantity AS unit_price,
         o.o_custkey AS customer_id
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
clean_lines AS (
  SELECT invoice_no, stock_code, coalesce(description, '') AS description,
         coalesce(customer_id, -1) AS customer_id, quantity, unit_price, invoice_date,
         (starts_with(invoice_no, 'C') OR quantity < 0) AS is_cancel,
         quantity * unit_price AS line_total,
         CAST(invoice_date AS DATE) AS date
  FROM sales_lines
  WHERE invoice_date IS NOT NULL AND stock_code IS NOT NULL AND invoice_no IS NOT NULL
    AND unit_price IS NOT NULL AND quantity IS NOT NULL
),
daily AS (
  SELECT stock_code, date,
         avg(unit_price) AS price,
         CAST(trunc(avg(length(description))) AS INTEGER) AS description_length,
         coalesce(sum(CASE WHEN quantity > 0 THEN quantity END), 0.0) AS sold_qty,
         coalesce(sum(CASE WHEN line_total > 0 THEN line_total END), 0.0) AS revenue,
         coalesce(sum(CASE WHEN quantity < 0 THEN -quantity END), 0.0) AS cancelled_qty,
         CAST(count_if(is_cancel) AS BIGINT) AS cancelled_rows,
         CAST(count(invoice_no) AS BIGINT) AS "rows",
         CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_buyers
  FROM clean_lines GROUP BY stock_code, date
)"""

M1_WINDOWS = """
m1_win AS (
  SELECT *,
    sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS product_sales_7d,
    sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS product_sales_30d,
    sum(revenue) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS product_revenue_7d,
    sum(revenue) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS product_revenue_30d,
    avg(unique_buyers) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS product_unique_buyers_30d,
    least(greatest(
      sum(cancelled_rows) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
      / (sum("rows") OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) + 1e-9),
      0.0), 1.0) AS product_cancelled_rate_30d,
    CAST(least(greatest(coalesce(date - last_value(CASE WHEN sold_qty > 0 THEN date END IGNORE NULLS)
        OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 999), 0), 999) AS INTEGER)
      AS product_last_sale_days_ago,
    CAST(coalesce(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 0.0) > 0 AS INTEGER)
      AS will_sell_next_7d
  FROM daily
),
m1_features AS (
  SELECT *,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
    CAST(month(date) AS INTEGER) AS month,
    CAST(weekofyear(date) AS INTEGER) AS week_of_year,
    CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
    0 AS featured, 1 AS images_count, 0 AS has_specifications, CAST(0.0 AS DOUBLE) AS discount_pct,
    -1 AS stock, 'basic' AS plan_id, 'store' AS business_type_slug, 'retail' AS business_category_slug,
    1 AS payment_settings_enabled, 1 AS has_whatsapp
  FROM m1_win
  WHERE product_sales_30d IS NOT NULL
    AND date <= (SELECT max(date) FROM m1_win) - INTERVAL 7 DAY
)"""

M1_FEATURE_COLS = """stock_code, date, round(price, 6) AS price, description_length,
  round(sold_qty, 6) AS sold_qty, round(revenue, 6) AS revenue, round(cancelled_qty, 6) AS cancelled_qty,
  cancelled_rows, "rows", unique_buyers,
  round(product_sales_7d, 6) AS product_sales_7d, round(product_sales_30d, 6) AS product_sales_30d,
  round(product_revenue_7d, 6) AS product_revenue_7d, round(product_revenue_30d, 6) AS product_revenue_30d,
  round(product_unique_buyers_30d, 6) AS product_unique_buyers_30d,
  round(product_cancelled_rate_30d, 6) AS product_cancelled_rate_30d,
  product_last_sale_days_ago, will_sell_next_7d, day_of_week, month, week_of_year, is_weekend,
  featured, images_count, has_specifications, discount_pct, stock, plan_id, business_type_slug,
  business_category_slug, payment_settings_enabled, has_whatsapp"""

# ---------------------------------------------------------------- module 1
sql("product_day_agg", f"""WITH {SALES_LINES}
SELECT stock_code, date, round(price, 6) AS price, description_length, round(sold_qty, 6) AS sold_qty,
       round(revenue, 6) AS revenue, round(cancelled_qty, 6) AS cancelled_qty, cancelled_rows, "rows", unique_buyers
FROM daily""")

sql("rolling_sales", f"""WITH {SALES_LINES}
SELECT stock_code, date,
  round(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS product_sales_7d,
  round(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS product_sales_30d
FROM daily""")

sql("rolling_revenue", f"""WITH {SALES_LINES}
SELECT stock_code, date,
  round(sum(revenue) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS product_revenue_7d,
  round(sum(revenue) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS product_revenue_30d
FROM daily""")

sql("rolling_buyers", f"""WITH {SALES_LINES}
SELECT stock_code, date,
  round(avg(unique_buyers) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS product_unique_buyers_30d
FROM daily""")

sql("rolling_cancel_rate", f"""WITH {SALES_LINES}, {M1_WINDOWS}
SELECT stock_code, date, round(product_cancelled_rate_30d, 6) AS product_cancelled_rate_30d FROM m1_win""")

sql("days_since_last_sale", f"""WITH {SALES_LINES}, {M1_WINDOWS}
SELECT stock_code, date, product_last_sale_days_ago FROM m1_win""")

sql("forward_sum", f"""WITH {SALES_LINES}
SELECT stock_code, date,
  round(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 6) AS sold_next_7d
FROM daily""")

sql("forward_label", f"""WITH {SALES_LINES}, {M1_WINDOWS}
SELECT {M1_FEATURE_COLS} FROM m1_features""")


# ---------------------------------------------------------------- entities
PLAN_CASE = """CASE {k} % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'basic' WHEN 2 THEN 'pro'
                  WHEN 3 THEN 'enterprise' ELSE 'gold' END"""

CUSTOMERS = """
cust_orders AS (
  SELECT o_custkey, max(o_orderdate) AS last_order,
         CAST(count_if(o_orderstatus = 'F') AS INTEGER) AS total_orders_paid,
         CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) / count(o_totalprice) / 1000.0 AS avg_order_value,
         avg(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cancellation_rate
  FROM orders GROUP BY o_custkey
),
cust_visits AS (
  SELECT user_id, CAST(count(*) AS INTEGER) AS profile_visits_count
  FROM events WHERE event_type = 'view' GROUP BY user_id
),
customers AS (
  SELECT c.c_custkey AS customer_id,
         CAST(date_diff('day', CAST(co.last_order AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS INTEGER)
           AS days_since_last_order,
         co.total_orders_paid, co.avg_order_value, co.cancellation_rate, cv.profile_visits_count,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'cash' WHEN 'BUILDING' THEN 'card'
              WHEN 'FURNITURE' THEN 'transfer' WHEN 'HOUSEHOLD' THEN 'cash' WHEN 'MACHINERY' THEN 'card' END
           AS preferred_payment_method
  FROM customer c
  LEFT JOIN cust_orders co ON c.c_custkey = co.o_custkey
  LEFT JOIN cust_visits cv ON c.c_custkey = cv.user_id
),
customers_in AS (
  SELECT customer_id, days_since_last_order, total_orders_paid, avg_order_value,
         coalesce(cancellation_rate, 0.05::DOUBLE) AS cancellation_rate,
         coalesce(profile_visits_count, 10) AS profile_visits_count,
         coalesce(preferred_payment_method, 'cash') AS preferred_payment_method,
         1.2::DOUBLE AS link_click_to_order_ratio, 'whatsapp' AS preferred_notification,
         concat_ws('|', CASE WHEN days_since_last_order IS NULL THEN 'missing:days_since_last_order' END,
                        CASE WHEN total_orders_paid IS NULL THEN 'missing:total_orders_paid' END,
                        CASE WHEN avg_order_value IS NULL THEN 'missing:avg_order_value' END) AS errors
  FROM customers
),
customers_ok AS (SELECT * FROM customers_in WHERE errors = '')"""

PRODUCTS = f"""
part_lines AS (
  SELECT l_partkey, max(l_discount) * 100.0 AS discount_pct,
         CAST(count(DISTINCT l_suppkey) AS INTEGER) AS images_count
  FROM lineitem GROUP BY l_partkey
),
products AS (
  SELECT p.p_partkey AS product_id, p.p_retailprice / p.p_size AS price, pl.discount_pct,
         CAST(p.p_size % 20 - 1 AS INTEGER) AS stock, pl.images_count,
         CAST(length(p.p_name) * 40 AS INTEGER) AS description_length,
         CASE WHEN ends_with(p.p_brand, '1') THEN 1 ELSE 0 END AS featured,
         CASE WHEN p.p_type = 'PROMO' THEN 0 ELSE 1 END AS payment_settings_enabled,
         {PLAN_CASE.format(k='p.p_partkey')} AS plan_id,
         lower(p.p_type) AS business_category_slug
  FROM part p LEFT JOIN part_lines pl ON p.p_partkey = pl.l_partkey
),
products_ok AS (
  SELECT product_id, price, coalesce(discount_pct, 0.0::DOUBLE) AS discount_pct, stock,
         coalesce(images_count, 3) AS images_count, description_length, featured, payment_settings_enabled,
         1 AS has_whatsapp, plan_id, business_category_slug
  FROM products WHERE price IS NOT NULL
)"""

STORES = f"""
supp_part AS (
  SELECT l_suppkey, l_partkey, max(l_discount) AS max_disc FROM lineitem GROUP BY l_suppkey, l_partkey
),
per_store AS (
  SELECT sp.l_suppkey, CAST(count(*) AS INTEGER) AS total_products_active,
         avg(CASE WHEN p.p_size >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS products_with_image_pct,
         avg(CASE WHEN length(p.p_name) >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS products_with_description_pct,
         avg(CASE WHEN sp.max_disc >= 0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS products_with_discount_pct,
         avg(p.p_size) / 10.0 AS avg_images_per_product
  FROM supp_part sp JOIN part p ON sp.l_partkey = p.p_partkey GROUP BY sp.l_suppkey
),
stores AS (
  SELECT s.s_suppkey AS store_id,
         CASE WHEN s.s_acctbal > 0 THEN 1 ELSE 0 END AS payment_settings_enabled,
         CASE WHEN s.s_acctbal > 1000 THEN 1 ELSE 0 END AS hero_has_cta,
         CAST(floor(s.s_nationkey / 2) AS INTEGER) AS navigation_menu_items_count,
         ps.products_with_image_pct, ps.products_with_description_pct, ps.total_products_active,
         ps.products_with_discount_pct, ps.avg_images_per_product,
         {PLAN_CASE.format(k='s.s_suppkey')} AS plan_id
  FROM supplier s LEFT JOIN per_store ps ON s.s_suppkey = ps.l_suppkey
),
stores_ok AS (
  SELECT store_id, payment_settings_enabled, hero_has_cta, navigation_menu_items_count,
         1 AS has_custom_logo, 1 AS has_cover_image,
         coalesce(products_with_image_pct, 0.80::DOUBLE) AS products_with_image_pct,
         coalesce(products_with_description_pct, 0.60::DOUBLE) AS products_with_description_pct,
         coalesce(products_with_discount_pct, 0.25::DOUBLE) AS products_with_discount_pct,
         coalesce(avg_images_per_product, 2.5::DOUBLE) AS avg_images_per_product,
         coalesce(total_products_active, 60) AS total_products_active, plan_id
  FROM stores
)"""

CONTENT = """
recent_events AS (
  SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY
),
content_g AS (
  SELECT user_id,
         CAST(count_if(event_type = 'click') AS INTEGER) AS posts_count_30d,
         CAST(count_if(event_type = 'view') AS INTEGER) AS stories_count_30d,
         avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_posts_with_video,
         (max(CASE WHEN event_type = 'click' THEN epoch_us(ts) END)
          - min(CASE WHEN event_type = 'click' THEN epoch_us(ts) END)) / 86400e6 AS span_days,
         avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_1_2_star,
         avg(value) AS mean_value,
         count_if(event_type = 'signup') AS signups,
         count_if(event_type = 'error') AS errors_n,
         count_if(event_type = 'purchase') AS purchases_n
  FROM recent_events GROUP BY user_id
),
content AS (
  SELECT user_id AS account_id, posts_count_30d, stories_count_30d, pct_posts_with_video,
         CASE WHEN posts_count_30d >= 2 THEN span_days / (posts_count_30d - 1) END AS days_between_posts,
         greatest(1.0::DOUBLE, least(5.0::DOUBLE, 5.5::DOUBLE - mean_value / 20.0::DOUBLE)) AS avg_rating,
         pct_1_2_star, mean_value / 1000.0::DOUBLE AS post_engagement_rate,
         CASE WHEN signups > 0 THEN 1 ELSE 0 END AS has_tiktok,
         CASE WHEN errors_n > purchases_n THEN 0 ELSE 1 END AS has_whatsapp
  FROM content_g
),
content_ok AS (
  SELECT account_id, coalesce(posts_count_30d, 10) AS posts_count_30d,
         coalesce(stories_count_30d, 20) AS stories_count_30d,
         coalesce(pct_posts_with_video, 0.50::DOUBLE) AS pct_posts_with_video,
         coalesce(days_between_posts, 3.0::DOUBLE) AS days_between_posts,
         coalesce(avg_rating, 4.5::DOUBLE) AS avg_rating, coalesce(pct_1_2_star, 0.05::DOUBLE) AS pct_1_2_star,
         coalesce(post_engagement_rate, 0.04::DOUBLE) AS post_engagement_rate,
         1 AS has_instagram, coalesce(has_tiktok, 1) AS has_tiktok, 1 AS has_facebook,
         coalesce(has_whatsapp, 1) AS has_whatsapp
  FROM content
)"""

# ---------------------------------------------------------------- scorecards
SALES_SCORE = """CAST(round(least(0.0
  + CASE WHEN price BETWEEN 5 AND 200 THEN 0.20 WHEN price < 5 OR price > 500 THEN 0.05 ELSE 0.12 END
  + CASE WHEN discount_pct >= 10 THEN 0.15 WHEN discount_pct > 0 THEN 0.08 ELSE 0.0 END
  + CASE WHEN stock = 0 THEN 0.0 WHEN stock = -1 OR stock >= 10 THEN 0.15 ELSE 0.08 END
  + CASE WHEN images_count >= 4 THEN 0.15 WHEN images_count >= 2 THEN 0.10 WHEN images_count = 1 THEN 0.04 ELSE 0.0 END
  + CASE WHEN description_length >= 400 THEN 0.10 WHEN description_length >= 150 THEN 0.06
         WHEN description_length >= 50 THEN 0.02 ELSE 0.0 END
  + CASE WHEN payment_settings_enabled = 1 THEN 0.10 ELSE 0.0 END
  + CASE WHEN has_whatsapp = 1 THEN 0.05 ELSE 0.0 END
  + CASE WHEN featured = 1 THEN 0.05 ELSE 0.0 END
  + CASE plan_id WHEN 'free' THEN 0.0 WHEN 'basic' THEN 0.03 WHEN 'pro' THEN 0.05 WHEN 'enterprise' THEN 0.05 ELSE 0.02 END
  , 1.0), 4) AS DOUBLE)"""

CHURN_SCORE = """CAST(round(least(0.0
  + CASE WHEN days_since_last_order >= 60 THEN 0.30 WHEN days_since_last_order >= 30 THEN 0.20
         WHEN days_since_last_order >= 14 THEN 0.08 ELSE 0.0 END
  + CASE WHEN total_orders_paid = 0 THEN 0.25 WHEN total_orders_paid = 1 THEN 0.18
         WHEN total_orders_paid <= 3 THEN 0.08 ELSE 0.0 END
  + CASE WHEN avg_order_value < 20 THEN 0.10 WHEN avg_order_value < 50 THEN 0.05 ELSE 0.0 END
  + CASE WHEN cancellation_rate >= 0.30 THEN 0.15 WHEN cancellation_rate >= 0.12 THEN 0.08 ELSE 0.0 END
  + CASE WHEN profile_visits_count >= 10 AND total_orders_paid = 0 THEN 0.10
         WHEN profile_visits_count = 0 THEN 0.08 ELSE 0.0 END
  + CASE WHEN preferred_payment_method = 'cash' THEN 0.05 ELSE 0.0 END
  , 1.0), 4) AS DOUBLE)"""

DESIGN_SCORE = """CAST(round(greatest(least(0.0
  + CASE WHEN payment_settings_enabled = 1 THEN 0.20 ELSE 0.0 END
  + CASE WHEN hero_has_cta = 1 THEN 0.12 ELSE 0.0 END
  + CASE WHEN has_custom_logo = 1 THEN 0.06 ELSE 0.0 END
  + CASE WHEN has_cover_image = 1 THEN 0.06 ELSE 0.0 END
  + CASE WHEN products_with_image_pct >= 0.90 THEN 0.12 WHEN products_with_image_pct >= 0.70 THEN 0.08
         WHEN products_with_image_pct >= 0.50 THEN 0.04 ELSE 0.0 END
  + CASE WHEN products_with_description_pct >= 0.80 THEN 0.10 WHEN products_with_description_pct >= 0.55 THEN 0.06
         WHEN products_with_description_pct >= 0.30 THEN 0.02 ELSE 0.0 END
  + CASE WHEN avg_images_per_product >= 3.0 THEN 0.08 WHEN avg_images_per_product >= 2.0 THEN 0.05 ELSE 0.0 END
  + CASE WHEN navigation_menu_items_count BETWEEN 3 AND 8 THEN 0.05
         WHEN navigation_menu_items_count > 12 THEN -0.03 ELSE 0.0 END
  + CASE WHEN products_with_discount_pct >= 0.20 THEN 0.06 WHEN products_with_discount_pct >= 0.05 THEN 0.03 ELSE 0.0 END
  + CASE plan_id WHEN 'free' THEN 0.0 WHEN 'basic' THEN 0.03 WHEN 'pro' THEN 0.06 WHEN 'enterprise' THEN 0.06 ELSE 0.02 END
  , 1.0), 0.0), 4) AS DOUBLE)"""

GROWTH_SCORE = """CAST(round(greatest(least(0.0
  + CASE WHEN days_between_posts <= 1.5 THEN 0.18 WHEN days_between_posts <= 3.0 THEN 0.12
         WHEN days_between_posts <= 5.0 THEN 0.05 ELSE 0.0 END
  + CASE WHEN posts_count_30d >= 15 THEN 0.10 WHEN posts_count_30d >= 8 THEN 0.06
         WHEN posts_count_30d >= 3 THEN 0.02 ELSE 0.0 END
  + CASE WHEN stories_count_30d >= 25 THEN 0.08 WHEN stories_count_30d >= 12 THEN 0.05 ELSE 0.0 END
  + CASE WHEN pct_posts_with_video >= 0.60 THEN 0.10 WHEN pct_posts_with_video >= 0.35 THEN 0.06
         WHEN pct_posts_with_video >= 0.15 THEN 0.02 ELSE 0.0 END
  + CASE WHEN post_engagement_rate >= 0.06 THEN 0.12 WHEN post_engagement_rate >= 0.03 THEN 0.07
         WHEN post_engagement_rate >= 0.01 THEN 0.03 ELSE 0.0 END
  + CASE WHEN avg_rating >= 4.7 THEN 0.08 WHEN avg_rating >= 4.2 THEN 0.05 WHEN avg_rating < 3.5 THEN -0.05 ELSE 0.0 END
  + CASE WHEN pct_1_2_star <= 0.05 THEN 0.04 WHEN pct_1_2_star >= 0.20 THEN -0.04 ELSE 0.0 END
  + CASE WHEN has_instagram + has_tiktok + has_facebook + has_whatsapp >= 3 THEN 0.08
         WHEN has_instagram + has_tiktok + has_facebook + has_whatsapp >= 2 THEN 0.05
         WHEN has_instagram + has_tiktok + has_facebook + has_whatsapp = 1 THEN 0.02 ELSE 0.0 END
  , 1.0), 0.0), 4) AS DOUBLE)"""

SALES_RECS = """coalesce(nullif(concat_ws('|',
    CASE WHEN discount_pct = 0 THEN 'try_small_discount' END,
    CASE WHEN images_count < 3 THEN 'add_photos' END,
    CASE WHEN description_length < 150 THEN 'improve_description' END,
    CASE WHEN stock = 0 THEN 'restock' END,
    CASE WHEN payment_settings_enabled = 0 THEN 'enable_online_payments' END), ''), 'listing_ok_ab_test_price')"""
CHURN_RECS = """coalesce(nullif(concat_ws('|',
    CASE WHEN days_since_last_order >= 30 THEN 'winback_message' END,
    CASE WHEN total_orders_paid <= 1 THEN 'second_purchase_campaign' END,
    CASE WHEN cancellation_rate >= 0.12 THEN 'reduce_friction' END,
    CASE WHEN profile_visits_count >= 15 AND total_orders_paid = 0 THEN 'intent_coupon' END,
    CASE WHEN preferred_payment_method = 'cash' THEN 'offer_card_or_transfer' END), ''), 'healthy_upsell')"""
DESIGN_RECS = """coalesce(nullif(concat_ws('|',
    CASE WHEN payment_settings_enabled = 0 THEN 'enable_online_payments' END,
    CASE WHEN hero_has_cta = 0 THEN 'add_hero_cta' END,
    CASE WHEN navigation_menu_items_count > 9 THEN 'shorten_menu' END,
    CASE WHEN products_with_image_pct < 0.75 THEN 'add_product_photos' END,
    CASE WHEN products_with_description_pct < 0.55 THEN 'improve_descriptions' END,
    CASE WHEN avg_images_per_product < 2.0 THEN 'more_images_per_product' END), ''), 'design_ok_ab_test')"""
GROWTH_RECS = """coalesce(nullif(concat_ws('|',
    CASE WHEN pct_posts_with_video < 0.45 THEN 'more_video' END,
    CASE WHEN days_between_posts > 4 THEN 'post_more_often' END,
    CASE WHEN stories_count_30d < 12 THEN 'more_stories' END,
    CASE WHEN post_engagement_rate < 0.03 THEN 'improve_engagement' END,
    CASE WHEN pct_1_2_star > 0.10 THEN 'handle_bad_reviews' END,
    CASE WHEN avg_rating < 4.2 THEN 'improve_reputation' END,
    CASE WHEN has_whatsapp = 0 THEN 'enable_whatsapp' END), ''), 'content_ok_ab_test')"""

CARD_SQL = {
    # kind: (entity CTEs, valid table, key, score, threshold, labels, recs)
    "sales": (PRODUCTS, "products_ok", "product_id", SALES_SCORE, 0.55, ("wont_sell", "will_sell"), SALES_RECS),
    "churn": (CUSTOMERS, "customers_ok", "customer_id", CHURN_SCORE, 0.40, ("stable", "at_risk"), CHURN_RECS),
    "design": (STORES, "stores_ok", "store_id", DESIGN_SCORE, 0.50, ("medium_low", "high_conversion"), DESIGN_RECS),
    "growth": (CONTENT, "content_ok", "account_id", GROWTH_SCORE, 0.45, ("stable_or_down", "will_grow"), GROWTH_RECS),
}


def scored_cte(kind: str) -> str:
    ctes, table, key, score, thr, labels, recs = CARD_SQL[kind]
    return f"""{ctes},
{kind}_scored AS (
  SELECT *, {score} AS probability FROM {table}
),
{kind}_pred AS (
  SELECT *, CAST(probability >= {thr} AS INTEGER) AS prediction, CAST({thr} AS DOUBLE) AS threshold,
         CASE WHEN probability >= {thr} THEN '{labels[1]}' ELSE '{labels[0]}' END AS label,
         {recs} AS recommendations
  FROM {kind}_scored
)"""


sql("customer_features", f"""WITH {CUSTOMERS}
SELECT customer_id, days_since_last_order, total_orders_paid, round(avg_order_value, 6) AS avg_order_value,
       round(cancellation_rate, 6) AS cancellation_rate, profile_visits_count, preferred_payment_method
FROM customers""")
sql("product_facts", f"""WITH {PRODUCTS}
SELECT product_id, round(price, 6) AS price, round(discount_pct, 6) AS discount_pct, stock, images_count,
       description_length, featured, payment_settings_enabled, plan_id, business_category_slug FROM products""")
sql("store_facts", f"""WITH {STORES}
SELECT store_id, payment_settings_enabled, hero_has_cta, navigation_menu_items_count,
       round(products_with_image_pct, 6) AS products_with_image_pct,
       round(products_with_description_pct, 6) AS products_with_description_pct, total_products_active,
       round(products_with_discount_pct, 6) AS products_with_discount_pct,
       round(avg_images_per_product, 6) AS avg_images_per_product, plan_id FROM stores""")
sql("content_facts", f"""WITH {CONTENT}
SELECT account_id, posts_count_30d, stories_count_30d, round(pct_posts_with_video, 6) AS pct_posts_with_video,
       round(days_between_posts, 6) AS days_between_posts, round(avg_rating, 6) AS avg_rating,
       round(pct_1_2_star, 6) AS pct_1_2_star, round(post_engagement_rate, 6) AS post_engagement_rate,
       has_tiktok, has_whatsapp FROM content""")

for _kind, (_c, _t, _key, *_rest) in CARD_SQL.items():
    sql(f"score_{_kind}", f"WITH {scored_cte(_kind)}\nSELECT {_key}, probability, prediction FROM {_kind}_pred")
    sql(f"recommend_{_kind}", f"WITH {scored_cte(_kind)}\nSELECT {_key}, recommendations FROM {_kind}_pred")
    sql(f"predict_{_kind}", f"""WITH {scored_cte(_kind)}
SELECT {_key}, probability, prediction, label, threshold, recommendations FROM {_kind}_pred""")

sql("confidence_band", f"""WITH {scored_cte('sales')}
SELECT product_id, probability,
       CASE WHEN probability > 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'moderate' ELSE 'low' END AS confidence
FROM sales_pred""")

sql("plan_bonus", f"""WITH {PRODUCTS}
SELECT product_id, plan_id,
  CAST(CASE plan_id WHEN 'free' THEN 0.0 WHEN 'basic' THEN 0.03 WHEN 'pro' THEN 0.05 WHEN 'enterprise' THEN 0.05 ELSE 0.02 END AS DOUBLE) AS sales_plan_bonus,
  CAST(CASE plan_id WHEN 'free' THEN 0.0 WHEN 'basic' THEN 0.03 WHEN 'pro' THEN 0.06 WHEN 'enterprise' THEN 0.06 ELSE 0.02 END AS DOUBLE) AS design_plan_bonus
FROM products""")

sql("apply_defaults", f"""WITH {CUSTOMERS}
SELECT customer_id, days_since_last_order, total_orders_paid, round(avg_order_value, 6) AS avg_order_value,
       round(cancellation_rate, 6) AS cancellation_rate, profile_visits_count, preferred_payment_method,
       link_click_to_order_ratio, preferred_notification
FROM customers_in""")

sql("validate_split", f"""WITH {CUSTOMERS}
SELECT customer_id, CASE WHEN errors = '' THEN 'valid' ELSE 'rejected' END AS status, errors FROM customers_in""")

sql("derive_total_spent", f"""WITH {CUSTOMERS}
SELECT customer_id, round(total_orders_paid * avg_order_value, 6) AS total_spent, 1 AS registered FROM customers_ok""")

sql("align_columns", f"""WITH {PRODUCTS}
SELECT round(price, 6) AS price, round(discount_pct, 6) AS discount_pct, stock, images_count, description_length,
       featured, CAST(NULL AS INTEGER) AS has_specifications, plan_id, business_category_slug FROM products""")

sql("filter_isin", f"""WITH {PRODUCTS}
SELECT product_id, round(price, 6) AS price, round(discount_pct, 6) AS discount_pct, stock, images_count,
       description_length, featured, payment_settings_enabled, plan_id, business_category_slug
FROM products WHERE plan_id IN ('basic', 'pro')""")

sql("store_report", f"""WITH {scored_cte('design')}, {scored_cte('sales')}, {scored_cte('growth')},
pairs AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
sales_by_store AS (
  SELECT pr.l_suppkey AS store_id, avg(s.probability) AS sales_mean_probability, count(*) AS products_scored
  FROM pairs pr JOIN sales_pred s ON pr.l_partkey = s.product_id GROUP BY pr.l_suppkey
)
SELECT d.store_id, d.probability AS design_probability, d.prediction AS design_prediction,
       round(sb.sales_mean_probability, 6) AS sales_mean_probability, sb.products_scored,
       g.probability AS growth_probability, g.prediction AS growth_prediction
FROM design_pred d
LEFT JOIN sales_by_store sb ON d.store_id = sb.store_id
LEFT JOIN growth_pred g ON d.store_id = g.account_id""")

sql("top_products", f"""WITH {scored_cte('sales')}
SELECT product_id, probability, prediction FROM sales_pred ORDER BY probability DESC, product_id LIMIT 20""")
sql("top_risk_customers", f"""WITH {scored_cte('churn')}
SELECT customer_id, probability, prediction FROM churn_pred ORDER BY probability DESC, customer_id LIMIT 50""")
sql("top_filtered", f"""WITH {scored_cte('sales')},
cats AS (SELECT DISTINCT business_category_slug FROM sales_pred ORDER BY 1 LIMIT 3)
SELECT product_id, business_category_slug, plan_id, probability FROM sales_pred
WHERE business_category_slug IN (SELECT business_category_slug FROM cats)
ORDER BY probability DESC, product_id LIMIT 20""")
sql("distinct_sorted", f"""WITH {PRODUCTS}
SELECT DISTINCT business_category_slug AS value FROM products""")
sql("histogram_40", f"""WITH {scored_cte('sales')},
b AS (SELECT CAST(least(greatest(floor(probability * 40), 0), 39) AS INTEGER) AS bin FROM sales_pred
      WHERE probability IS NOT NULL)
SELECT bin, count(*) AS n, round(bin / 40.0, 6) AS bin_lo, round((bin + 1) / 40.0, 6) AS bin_hi FROM b GROUP BY bin""")
sql("kpi_strip", f"""WITH {scored_cte('sales')}
SELECT CAST(0.55 AS DOUBLE) AS threshold, round(avg(probability), 6) AS mean_probability,
       round(avg(CASE WHEN probability >= 0.55 THEN 1.0 ELSE 0.0 END), 6) AS predicted_rate, count(*) AS n_rows
FROM sales_pred""")


# ---------------------------------------------------------------- evaluation
def scored_sql(label: str = "quality") -> str:
    return f"""
scored AS (
  SELECT l.doc_id, round(d.n_chars / (d.n_chars + 1000.0::DOUBLE), 4) AS score, CAST(l.{label} AS INTEGER) AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


CONFUSION_05 = """
cm AS (
  SELECT CAST(count_if(score < 0.5 AND label <> 1) AS BIGINT) AS tn,
         CAST(count_if(score >= 0.5 AND label <> 1) AS BIGINT) AS fp,
         CAST(count_if(score < 0.5 AND label = 1) AS BIGINT) AS fn,
         CAST(count_if(score >= 0.5 AND label = 1) AS BIGINT) AS tp
  FROM scored
)"""

RATES = """tn, fp, fn, tp,
  round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
  round(CASE WHEN tp + tn + fp + fn <> 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 6) AS accuracy"""

GRID = """
grid AS (SELECT CAST(range AS INTEGER) AS i, range / 200.0::DOUBLE AS thr FROM range(10, 191)),
grid_counts AS (
  SELECT g.i, g.thr,
         count_if(s.score >= g.thr AND s.label = 1) AS tp, count_if(s.score >= g.thr AND s.label <> 1) AS fp,
         count_if(s.score < g.thr AND s.label = 1) AS fn, count_if(s.score < g.thr AND s.label <> 1) AS tn
  FROM grid g, scored s WHERE s.score IS NOT NULL GROUP BY g.i, g.thr
),
grid_f1 AS (
  SELECT i, thr, tp, fp, fn, tn,
         CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM grid_counts
),
grid_best AS (SELECT * FROM grid_f1 ORDER BY f1 DESC, i ASC LIMIT 1)"""

CURVE = """
score_counts AS (
  SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored
  WHERE score IS NOT NULL GROUP BY score
),
totals AS (SELECT sum(pos) AS P, sum(neg) AS N FROM score_counts),
curve AS (
  SELECT score AS threshold, pos, neg,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
         sum(neg) OVER (ORDER BY score ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below0
  FROM score_counts
),
pr AS (
  SELECT c.*, coalesce(c.neg_below0, 0) AS neg_below, t.P, t.N,
         CASE WHEN c.tp + c.fp <> 0 THEN c.tp / (c.tp + c.fp) ELSE 0.0 END AS precision,
         CASE WHEN t.P > 0 THEN c.tp / t.P ELSE 1.0 END AS recall
  FROM curve c, totals t
)"""

ROC = """SELECT CASE WHEN max(P) > 0 AND max(N) > 0
   THEN round(CAST(sum(pos * (neg_below + 0.5 * neg)) AS DOUBLE) / CAST(max(P) * max(N) AS DOUBLE), 6) END AS roc_auc
FROM pr"""

AP = """SELECT CASE WHEN max(P) > 0 THEN round(coalesce(sum(CASE WHEN pos > 0 THEN pos / P * (tp / (tp + fp)) END), 0.0), 6) END
  AS average_precision FROM pr"""

PR_F1 = """SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT threshold, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr
) ORDER BY f1 DESC, threshold ASC LIMIT 1"""

sql("confusion_matrix", f"WITH {scored_sql()}, {CONFUSION_05}\nSELECT * FROM cm")
sql("f1_accuracy", f"WITH {scored_sql()}, {CONFUSION_05}\nSELECT {RATES} FROM cm")
for _name, _lab in (("threshold_grid_f1", "quality"), ("threshold_grid_f1_toxic", "toxic")):
    sql(_name, f"""WITH {scored_sql(_lab)}, {GRID}
SELECT round(thr, 6) AS threshold, round(f1, 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM grid_best""")
sql("threshold_pr_f1", f"WITH {scored_sql()}, {CURVE}\n{PR_F1}")
sql("threshold_pr_f1_toxic", f"WITH {scored_sql('toxic')}, {CURVE}\n{PR_F1}")
sql("pr_curve", f"""WITH {scored_sql()}, {CURVE}
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr""")
sql("roc_auc", f"WITH {scored_sql()}, {CURVE}\n{ROC}")
sql("roc_auc_toxic", f"WITH {scored_sql('toxic')}, {CURVE}\n{ROC}")
sql("average_precision", f"WITH {scored_sql()}, {CURVE}\n{AP}")

sql("classification_report", f"""WITH {scored_sql()}, {CONFUSION_05},
per_class AS (
  SELECT '0' AS class,
         CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE 0.0 END AS precision,
         CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall, CAST(tn + fp AS DOUBLE) AS support
  FROM cm
  UNION ALL
  SELECT '1', CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END,
         CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END, CAST(tp + fn AS DOUBLE) FROM cm
),
rows_ AS (
  SELECT class, precision, recall,
         CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support
  FROM per_class
),
allrows AS (
  SELECT * FROM rows_
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rows_
  UNION ALL SELECT 'weighted avg',
         CASE WHEN sum(support) <> 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END,
         CASE WHEN sum(support) <> 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END,
         CASE WHEN sum(support) <> 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END, sum(support) FROM rows_
)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allrows""")

sql("metrics_record", f"""WITH {scored_sql()}, {GRID}, {CURVE},
cm AS (
  SELECT CAST(count_if(score < (SELECT thr FROM grid_best) AND label <> 1) AS BIGINT) AS tn,
         CAST(count_if(score >= (SELECT thr FROM grid_best) AND label <> 1) AS BIGINT) AS fp,
         CAST(count_if(score < (SELECT thr FROM grid_best) AND label = 1) AS BIGINT) AS fn,
         CAST(count_if(score >= (SELECT thr FROM grid_best) AND label = 1) AS BIGINT) AS tp,
         avg(CAST(label AS DOUBLE)) AS pos_rate_test,
         avg(CASE WHEN score >= (SELECT thr FROM grid_best) THEN 1.0 ELSE 0.0 END) AS pred_rate_test,
         count(*) AS n_test
  FROM scored
)
SELECT round((SELECT thr FROM grid_best), 6) AS threshold, round((SELECT f1 FROM grid_best), 6) AS f1_best,
       ({ROC}) AS roc_auc, ({AP}) AS pr_auc, tn, fp, fn, tp,
       round(pos_rate_test, 6) AS pos_rate_test, round(pred_rate_test, 6) AS pred_rate_test, n_test
FROM cm""")

sql("class_weights", f"""WITH {scored_sql()},
c AS (SELECT label, count(*) AS n_class FROM scored GROUP BY label)
SELECT label, n_class, round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * n_class), 6) AS weight FROM c""")

sql("majority_class", f"""WITH {scored_sql()}
SELECT label AS majority_label FROM (SELECT label, count(*) AS n FROM scored GROUP BY label)
ORDER BY n DESC, label ASC LIMIT 1""")

sql("select_champion", f"""WITH {scored_sql()}, {CURVE},
prior AS (SELECT avg(CAST(label AS DOUBLE)) AS p FROM scored),
cands AS (
  SELECT 'text_length' AS model, ({AP}) AS pr_auc, 0 AS priority
  UNION ALL
  SELECT 'class_prior', CASE WHEN (SELECT sum(label) FROM scored) > 0 THEN (SELECT p FROM prior) END, 1
)
SELECT model AS champion, round(pr_auc, 6) AS best_pr_auc FROM cands ORDER BY pr_auc DESC, priority ASC LIMIT 1""")

STRAT = """
ranked AS (
  SELECT doc_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS rk,
         count(*) OVER (PARTITION BY label) AS n_c
  FROM scored
),
strat AS (
  SELECT doc_id, label, CASE WHEN rk <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split FROM ranked
)"""

sql("stratified_split", f"WITH {scored_sql()}, {STRAT}\nSELECT doc_id, label, split FROM strat")
sql("positive_rate_by_split", f"""WITH {scored_sql()}, {STRAT}
SELECT split, count(*) AS n_rows, round(avg(label), 6) AS mean_label FROM strat GROUP BY split""")
sql("baseline_majority", f"""WITH {scored_sql()}, {STRAT},
maj AS (SELECT label FROM (SELECT label, count(*) AS n FROM strat WHERE split = 'train' GROUP BY label)
        ORDER BY n DESC, label ASC LIMIT 1),
cm AS (
  SELECT CAST(count_if(m.label <> 1 AND s.label <> 1) AS BIGINT) AS tn,
         CAST(count_if(m.label = 1 AND s.label <> 1) AS BIGINT) AS fp,
         CAST(count_if(m.label <> 1 AND s.label = 1) AS BIGINT) AS fn,
         CAST(count_if(m.label = 1 AND s.label = 1) AS BIGINT) AS tp
  FROM strat s, maj m WHERE s.split = 'test'
)
SELECT {RATES} FROM cm""")

sql("temporal_split", f"""WITH {SALES_LINES}, {M1_WINDOWS},
pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM m1_features),
cutoff AS (SELECT date FROM pos WHERE p = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM m1_features))
SELECT stock_code, date,
       CASE WHEN (SELECT count(*) FROM cutoff) = 0 OR date <= (SELECT date FROM cutoff) THEN 'train' ELSE 'test' END AS split
FROM m1_features""")
sql("ordered_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.8)
                        THEN 'train' ELSE 'test' END AS split
FROM orders""")
sql("composite_ordered_split", """
SELECT o_custkey, o_orderdate, o_orderkey,
       CASE WHEN row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8)
            THEN 'train' ELSE 'test' END AS split
FROM orders""")


# ---------------------------------------------------------------- preparation
WEB_EVENTS = """
web_events AS (
  SELECT event_id,
         user_id * 100000 + (CAST(ts AS DATE) - DATE '1970-01-01') AS ga_session_id,
         user_id,
         CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'ES' ELSE 'MX' END AS country,
         CASE user_id % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'Mobile Safari' WHEN 2 THEN 'mobile' ELSE NULL END AS device,
         CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
              WHEN 'purchase' THEN 'purchase' ELSE event_type END AS type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         ts AS date, value
  FROM events
),
flagged AS (
  SELECT *, CAST(coalesce(type = 'purchase', false) AS INTEGER) AS is_purchase,
            CAST(coalesce(type = 'page_view', false) AS INTEGER) AS is_pageview,
            CAST(coalesce(type = 'add_to_cart', false) AS INTEGER) AS is_add_to_cart
  FROM web_events
),
sessions_g AS (
  SELECT ga_session_id,
         arg_min(user_id, event_id) FILTER (WHERE user_id IS NOT NULL) AS user_id,
         arg_min(country, event_id) FILTER (WHERE country IS NOT NULL) AS country,
         arg_min(device, event_id) FILTER (WHERE device IS NOT NULL) AS device,
         count(type) AS events_count,
         CAST(sum(is_pageview) AS BIGINT) AS pageviews_count,
         CAST(sum(is_add_to_cart) AS BIGINT) AS add_to_cart_count,
         CAST(sum(is_purchase) AS BIGINT) AS purchases,
         count(DISTINCT item_id) AS unique_items_viewed,
         min(date) AS session_date
  FROM flagged WHERE ga_session_id IS NOT NULL GROUP BY ga_session_id
),
sessions AS (
  SELECT *, CAST(purchases > 0 AS INTEGER) AS high_conversion_session,
         CAST(isodow(session_date) - 1 AS INTEGER) AS session_day_of_week,
         CAST(month(session_date) AS INTEGER) AS session_month,
         CAST(coalesce(contains(lower(device), 'mobile'), false) AS INTEGER) AS is_mobile,
         CAST(pageviews_count <= 1 AS INTEGER) AS bounce
  FROM sessions_g
)"""

sql("session_rollup", f"WITH {WEB_EVENTS}\nSELECT * FROM sessions")
sql("bounce_rate", f"""WITH {WEB_EVENTS}
SELECT device, count(*) AS sessions, round(avg(bounce), 6) AS bounce_rate,
       round(avg(high_conversion_session), 6) AS conversion_rate FROM sessions GROUP BY device""")
sql("event_flags", f"WITH {WEB_EVENTS}\nSELECT event_id, is_purchase, is_pageview, is_add_to_cart FROM flagged")
sql("contains_ci", f"""WITH {WEB_EVENTS}
SELECT event_id, device, coalesce(contains(lower(device), 'mobile'), false) AS is_mobile FROM web_events""")
sql("drop_required_nulls", f"WITH {WEB_EVENTS}\nSELECT event_id, device, type FROM web_events WHERE device IS NOT NULL")
sql("fill_null_constants", f"""WITH {WEB_EVENTS}
SELECT event_id, coalesce(device, '') AS device, coalesce(item_id, -1) AS item_id FROM web_events""")
sql("parse_ts_coerce", """
SELECT o_orderkey,
       try_strptime(trim(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_orderdate AS VARCHAR) END),
                    '%Y-%m-%d %H:%M:%S') AS order_ts
FROM orders""")
sql("parse_num_coerce", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN isnan(TRY_CAST(trim(t) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(t) AS DOUBLE) END AS tax
FROM (SELECT l_orderkey, l_linenumber,
             CASE WHEN l_linestatus = 'O' THEN ' ' || CAST(l_tax AS VARCHAR) || ' ' ELSE l_returnflag END AS t
      FROM lineitem)""")
sql("map_binary_label", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS label FROM orders""")
sql("flag_cancelled", f"WITH {SALES_LINES}\nSELECT invoice_no, stock_code, quantity, is_cancel FROM clean_lines")
sql("line_total", f"WITH {SALES_LINES}\nSELECT invoice_no, stock_code, round(line_total, 6) AS line_total FROM clean_lines")
sql("floor_day", f"WITH {SALES_LINES}\nSELECT invoice_no, stock_code, invoice_date, date FROM clean_lines")
sql("avg_text_length", f"""WITH {SALES_LINES}
SELECT stock_code, CAST(trunc(avg(length(description))) AS INTEGER) AS description_length
FROM clean_lines GROUP BY stock_code""")
sql("calendar_features", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS week_of_year,
       CAST(isodow(o_orderdate) - 1 >= 5 AS INTEGER) AS is_weekend
FROM orders""")
sql("constant_defaults", f"""WITH {SALES_LINES}
SELECT stock_code, date, 0 AS featured, 1 AS images_count, 0 AS has_specifications,
       CAST(0.0 AS DOUBLE) AS discount_pct, -1 AS stock, 'basic' AS plan_id, 'store' AS business_type_slug,
       'retail' AS business_category_slug, 1 AS payment_settings_enabled, 1 AS has_whatsapp
FROM daily""")
sql("trim_incomplete_future", f"""WITH {SALES_LINES}
SELECT stock_code, date FROM daily WHERE date <= (SELECT max(date) FROM daily) - INTERVAL 7 DAY""")
sql("feature_projection", f"""WITH {SALES_LINES}, {M1_WINDOWS}
SELECT round(price, 6) AS price, description_length,
  round(product_sales_7d, 6) AS product_sales_7d, round(product_sales_30d, 6) AS product_sales_30d,
  round(product_revenue_7d, 6) AS product_revenue_7d, round(product_revenue_30d, 6) AS product_revenue_30d,
  round(product_unique_buyers_30d, 6) AS product_unique_buyers_30d,
  round(product_cancelled_rate_30d, 6) AS product_cancelled_rate_30d,
  product_last_sale_days_ago, day_of_week, month, week_of_year, is_weekend,
  featured, images_count, has_specifications, discount_pct, stock, plan_id, business_type_slug,
  business_category_slug, payment_settings_enabled, has_whatsapp
FROM m1_features""")


# ---------------------------------------------------------------- features, models, files
sql("impute_median", f"""WITH {PRODUCTS}
SELECT 'price' AS feature, round(CAST(median(price) AS DOUBLE), 6) AS median FROM products
UNION ALL SELECT 'discount_pct', round(CAST(median(discount_pct) AS DOUBLE), 6) FROM products
UNION ALL SELECT 'images_count', round(CAST(median(images_count) AS DOUBLE), 6) FROM products
UNION ALL SELECT 'description_length', round(CAST(median(description_length) AS DOUBLE), 6) FROM products""")

sql("impute_mode", f"""WITH {PRODUCTS},
m1 AS (SELECT plan_id AS v, count(*) AS n FROM products WHERE plan_id IS NOT NULL GROUP BY 1),
m2 AS (SELECT business_category_slug AS v, count(*) AS n FROM products WHERE business_category_slug IS NOT NULL GROUP BY 1)
SELECT 'plan_id' AS feature, (SELECT v FROM m1 ORDER BY n DESC, v ASC LIMIT 1) AS mode
UNION ALL SELECT 'business_category_slug', (SELECT v FROM m2 ORDER BY n DESC, v ASC LIMIT 1)""")

sql("standardize", f"""WITH {PRODUCTS},
mo AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(description_length) AS md,
              stddev_pop(description_length) AS sd FROM products)
SELECT product_id,
       round((price - mp) / CASE WHEN sp IS NULL OR sp = 0 THEN 1.0 ELSE sp END, 6) AS price_z,
       round((description_length - md) / CASE WHEN sd IS NULL OR sd = 0 THEN 1.0 ELSE sd END, 6) AS description_length_z
FROM products, mo""")

sql("one_hot", f"""WITH {CUSTOMERS}
SELECT customer_id,
       CAST(coalesce(preferred_payment_method = 'card', false) AS INTEGER) AS pay_card,
       CAST(coalesce(preferred_payment_method = 'cash', false) AS INTEGER) AS pay_cash,
       CAST(coalesce(preferred_payment_method = 'transfer', false) AS INTEGER) AS pay_transfer
FROM customers""")

sql("score_linear", f"""WITH {WEB_EVENTS}
SELECT ga_session_id, round(p, 6) AS probability, CAST(p >= 0.5 AS INTEGER) AS prediction
FROM (SELECT ga_session_id,
             1.0 / (1.0 + exp(-(-2.0 + 0.05 * events_count + 0.10 * pageviews_count + 0.30 * add_to_cart_count
                                + 0.02 * unique_items_viewed - 0.20 * is_mobile - 0.50 * bounce))) AS p
      FROM sessions)""")

sql("scan_parquet", """
SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05""")

sql("scan_csv_na_tokens", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       round(o_totalprice, 6) AS o_totalprice, o_orderdate
FROM orders""")

sql("sink_split_parquet", f"""WITH {SALES_LINES}, {M1_WINDOWS},
pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM m1_features),
cutoff AS (SELECT date FROM pos WHERE p = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM m1_features)),
sp AS (SELECT will_sell_next_7d, CASE WHEN date <= (SELECT date FROM cutoff) THEN 'train' ELSE 'test' END AS split
       FROM m1_features)
SELECT split, count(*) AS n_rows, round(avg(will_sell_next_7d), 6) AS positive_rate FROM sp GROUP BY split""")

sql("metrics_json", ORACLE["metrics_record"])

sql("score_stream", ORACLE["predict_sales"])


# ---------------------------------------------------------------- M4 and M2 chains
CONTENT_WEEKS = """
weekly AS (
  SELECT user_id AS store_id, CAST(date_trunc('week', ts) AS DATE) AS week,
         CAST(count_if(event_type = 'click') AS INTEGER) AS posts_count_week,
         CAST(count_if(event_type = 'view') AS INTEGER) AS stories_count_week,
         avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_posts_with_video,
         avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_1_2_star,
         avg(value) / 1000.0::DOUBLE AS post_engagement_rate,
         CAST(count(*) AS INTEGER) AS profile_visits,
         CAST(count_if(event_type = 'signup') AS INTEGER) AS new_customers
  FROM events GROUP BY 1, 2
),
weeks_next AS (
  SELECT w.*, n.profile_visits AS nv, n.new_customers AS nc
  FROM weekly w LEFT JOIN weekly n ON n.store_id = w.store_id AND n.week = w.week + INTERVAL 7 DAY
),
content_weeks AS (
  SELECT store_id, week, posts_count_week, stories_count_week, pct_posts_with_video, pct_1_2_star,
         post_engagement_rate, profile_visits, new_customers,
         CAST(coalesce(nv, 0) AS INTEGER) AS profile_visits_next_week,
         CAST(coalesce(nc, 0) AS INTEGER) AS new_customers_next_week,
         CAST(coalesce(nv, 0) > profile_visits AS INTEGER) AS growth_next_week
  FROM weeks_next WHERE week < (SELECT max(week) FROM weekly)
)"""

sql("content_weeks", f"""WITH {CONTENT_WEEKS}
SELECT store_id, week, posts_count_week, stories_count_week, round(pct_posts_with_video, 6) AS pct_posts_with_video,
       round(pct_1_2_star, 6) AS pct_1_2_star, round(post_engagement_rate, 6) AS post_engagement_rate,
       profile_visits, new_customers, profile_visits_next_week, new_customers_next_week, growth_next_week
FROM content_weeks""")

sql("growth_split", f"""WITH {CONTENT_WEEKS},
sp AS (SELECT growth_next_week,
              CASE WHEN row_number() OVER (ORDER BY store_id, week) <= floor(count(*) OVER () * 0.8)
                   THEN 'train' ELSE 'test' END AS split FROM content_weeks)
SELECT split, count(*) AS n_rows, round(avg(growth_next_week), 6) AS mean_growth_next_week FROM sp GROUP BY split""")

CHURN_TABLE = """
cutoff AS (SELECT CAST((SELECT max(o_orderdate) FROM orders) AS DATE) - INTERVAL 30 DAY AS c),
o AS (SELECT o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders),
past AS (
  SELECT o_custkey, max(d) AS last_order,
         CAST(count_if(o_orderstatus = 'F') AS INTEGER) AS total_orders_paid,
         CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) / count(o_totalprice) / 1000.0 AS avg_order_value,
         avg(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cancellation_rate
  FROM o WHERE d <= (SELECT c FROM cutoff) GROUP BY o_custkey
),
future AS (
  SELECT o_custkey, count(*) AS nxt FROM o
  WHERE d > (SELECT c FROM cutoff) AND d <= (SELECT c FROM cutoff) + INTERVAL 30 DAY GROUP BY o_custkey
),
churn AS (
  SELECT p.o_custkey AS customer_id,
         CAST(date_diff('day', p.last_order, CAST((SELECT c FROM cutoff) AS DATE)) AS INTEGER) AS days_since_last_order,
         p.total_orders_paid, p.avg_order_value, p.cancellation_rate, c.c_acctbal AS account_balance,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'cash' WHEN 'BUILDING' THEN 'card'
              WHEN 'FURNITURE' THEN 'transfer' WHEN 'HOUSEHOLD' THEN 'cash' WHEN 'MACHINERY' THEN 'card' END
           AS preferred_payment_method,
         CASE WHEN f.nxt IS NULL THEN 1 ELSE 0 END AS will_churn_30d
  FROM past p JOIN customer c ON p.o_custkey = c.c_custkey LEFT JOIN future f ON p.o_custkey = f.o_custkey
)"""

sql("churn_table", f"""WITH {CHURN_TABLE}
SELECT customer_id, days_since_last_order, total_orders_paid, round(avg_order_value, 6) AS avg_order_value,
       round(cancellation_rate, 6) AS cancellation_rate, round(account_balance, 6) AS account_balance,
       preferred_payment_method, will_churn_30d FROM churn""")

sql("churn_split", f"""WITH {CHURN_TABLE},
ranked AS (
  SELECT will_churn_30d,
         row_number() OVER (PARTITION BY will_churn_30d ORDER BY md5(CAST(customer_id AS VARCHAR) || '42'), customer_id) AS rk,
         count(*) OVER (PARTITION BY will_churn_30d) AS n_c
  FROM churn
)
SELECT CASE WHEN rk <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split, will_churn_30d, count(*) AS n_rows
FROM ranked GROUP BY 1, 2""")

sql("rolling_sales_calendar", f"""WITH {SALES_LINES}
SELECT stock_code, date,
  round(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date
        RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS sales_7_days,
  round(sum(sold_qty) OVER (PARTITION BY stock_code ORDER BY date
        RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), 6) AS sales_30_days
FROM daily""")

sql("session_feature_projection", f"""WITH {WEB_EVENTS}
SELECT country, device, events_count, pageviews_count, add_to_cart_count, unique_items_viewed,
       high_conversion_session, session_day_of_week, session_month, is_mobile, bounce
FROM sessions""")

sql("impute_transform", """WITH o AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 10 AS DOUBLE) END AS a,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS b,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS DOUBLE) END AS c,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS d FROM orders),
m AS (SELECT median(a) AS a, median(b) AS b, median(c) AS c FROM o),
md AS (SELECT d FROM o WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
f AS (SELECT o_orderkey, coalesce(o.a, m.a) AS a, coalesce(o.b, m.b) AS b, coalesce(o.c, m.c) AS c, coalesce(o.d, md.d) AS d
      FROM o, m, md),
st AS (SELECT avg(b) AS mean, stddev_pop(b) AS sd FROM f)
SELECT o_orderkey, round(a * 1e6) / 1e6 AS a, round((b - mean) / sd * 1e6) / 1e6 AS b, c, d, round(b * 1e6) / 1e6 AS b_raw FROM f, st""")

NUM_SLOTS = ("events_count", "pageviews_count", "add_to_cart_count", "unique_items_viewed", "session_day_of_week",
             "session_month", "is_mobile", "bounce")

sql("feature_matrix", f"""WITH {WEB_EVENTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY high_conversion_session
                     ORDER BY md5(CAST(ga_session_id AS VARCHAR) || '42'), ga_session_id) AS rk,
                  count(*) OVER (PARTITION BY high_conversion_session) AS n_c FROM sessions),
sp AS (SELECT *, CASE WHEN rk <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split FROM ranked),
tr AS (SELECT * FROM sp WHERE split = 'train'),
mc AS (SELECT country FROM tr WHERE country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
mv AS (SELECT device FROM tr WHERE device IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ct AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT country AS v FROM tr WHERE country IS NOT NULL)),
dv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT device AS v FROM tr WHERE device IS NOT NULL)),
long AS (
""" + " UNION ALL ".join(
    f"SELECT ga_session_id, split, {i} AS slot, (CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM tr)) / "
    f"(SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM tr) AS value FROM sp"
    for i, c in enumerate(NUM_SLOTS)) + f"""
UNION ALL SELECT ga_session_id, split, {len(NUM_SLOTS)} + i, 1.0 FROM sp JOIN ct ON ct.v = coalesce(country, (SELECT country FROM mc))
UNION ALL SELECT ga_session_id, split, {len(NUM_SLOTS)} + (SELECT count(*) FROM ct) + i, 1.0
          FROM sp JOIN dv ON dv.v = coalesce(device, (SELECT device FROM mv)))
SELECT ga_session_id, split, CAST(slot AS INTEGER) AS slot, round(value * 1e6) / 1e6 AS value FROM long WHERE value <> 0""")

sql("train_class_weights", f"""WITH {SALES_LINES}, {M1_WINDOWS}, {CONTENT_WEEKS},
pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM m1_features),
cutoff AS (SELECT date FROM pos WHERE p = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM m1_features)),
m1 AS (SELECT will_sell_next_7d AS label FROM m1_features
       WHERE (SELECT count(*) FROM cutoff) = 0 OR date <= (SELECT date FROM cutoff)),
m4 AS (SELECT label FROM (SELECT growth_next_week AS label, row_number() OVER (ORDER BY store_id, week) AS r, count(*) OVER () AS n
                          FROM content_weeks) WHERE r <= floor(n * 0.8)),
c AS (SELECT 'm1' AS module, label, count(*) AS n_class FROM m1 GROUP BY label
      UNION ALL SELECT 'm4', label, count(*) FROM m4 GROUP BY label)
SELECT module, label, n_class,
       round(sum(n_class) OVER (PARTITION BY module) / (count(*) OVER (PARTITION BY module) * n_class) * 1e6) / 1e6 AS weight FROM c""")

sql("ordered_split_text", """
SELECT p_partkey, p_name, CASE WHEN row_number() OVER (ORDER BY p_name, p_partkey) <= floor(count(*) OVER () * 0.8)
                               THEN 'train' ELSE 'test' END AS split FROM part""")

sql("top_filtered_plans", f"""WITH {scored_cte('sales')},
cats AS (SELECT DISTINCT business_category_slug FROM sales_pred ORDER BY 1 LIMIT 3)
SELECT product_id, business_category_slug, plan_id, probability FROM sales_pred
WHERE business_category_slug IN (SELECT business_category_slug FROM cats) AND plan_id IN ('basic', 'pro')
ORDER BY probability DESC, product_id LIMIT 20""")

sql("map_binary_strict", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders WHERE o_orderstatus IN ('F', 'O')""")

sql("validate_types", """WITH r AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' WHEN p_partkey % 11 = 0 THEN NULL
           ELSE CAST(p_retailprice AS VARCHAR) END AS price,
         CASE WHEN p_partkey % 5 = 0 THEN '2.5' ELSE CAST(p_size AS VARCHAR) END AS stock FROM part)
SELECT product_id, concat_ws('|', CASE WHEN price IS NULL THEN 'missing:price' END,
       CASE WHEN price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL THEN 'type:price' END,
       CASE WHEN stock = '2.5' THEN 'type:stock' END) AS errors FROM r""")

sql("csv_product_day", f"""WITH {SALES_LINES}
SELECT stock_code, date, round(price, 6) AS price, description_length, round(sold_qty, 6) AS sold_qty,
       round(revenue, 6) AS revenue, round(cancelled_qty, 6) AS cancelled_qty, cancelled_rows, "rows", unique_buyers
FROM daily""")


# ---------------------------------------------------------------- inferred inputs, file order, fits
def newton_sql(features: tuple[str, ...], steps: int) -> str:
    """Penalised Newton steps as a recursive query: sums, then elimination pivot by pivot (intercept ``x0`` first)."""
    n = len(features) + 1
    dot = " + ".join(f"b{i} * x{i}" for i in range(n))
    sums = [f"sum(w * p * (1 - p) * x{i} * x{j})" + (" + 1" if i == j > 0 else "") + f" AS a_{i}_{j}" for i in range(n) for j in range(n)]
    sums += [f"sum(w * (y - p) * x{i})" + (f" - any_value(b{i})" if i else "") + f" AS r_{i}" for i in range(n)]
    keep = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(n))
    inner = f"(SELECT any_value(k) AS k, {keep}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({dot}))) AS p FROM it, m WHERE k < {steps}) HAVING count(*) > 0)"
    same = "k, " + ", ".join(f"b{i}" for i in range(n))
    for v in range(n):                                  # after pivot v, column v is a unit column
        rows = []
        for i in range(n):
            for j in range(v + 1, n):
                rows.append((f"a_{i}_{j} / a_{v}_{v}" if i == v else f"a_{i}_{j} - a_{i}_{v} * a_{v}_{j} / a_{v}_{v}") + f" AS a_{i}_{j}")
            rows.append((f"r_{i} / a_{v}_{v}" if i == v else f"r_{i} - a_{i}_{v} * r_{v} / a_{v}_{v}") + f" AS r_{i}")
        inner = f"(SELECT {same}, {', '.join(rows)} FROM {inner})"
    start = ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(n))
    nexts = ", ".join(f"b{i} + r_{i}" for i in range(n))
    return f"it AS (SELECT 0 AS k, {start} UNION ALL SELECT k + 1, {nexts} FROM {inner})"


NEWTON = ("events_count", "pageviews_count", "unique_items_viewed", "is_mobile", "bounce")
sql("logistic_newton", f"""WITH RECURSIVE {WEB_EVENTS},
share AS (SELECT high_conversion_session AS y, count(*) AS n FROM sessions GROUP BY 1),
m AS (SELECT CAST(y AS DOUBLE) AS y, (SELECT sum(n) FROM share) / ((SELECT count(*) FROM share) * n) AS w, CAST(1 AS DOUBLE) AS x0,
             {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(NEWTON, 1))}
      FROM sessions JOIN share ON high_conversion_session = y),
{newton_sql(NEWTON, 14)}
SELECT f AS feature, round(b * 1e6) / 1e6 AS coefficient
FROM (SELECT unnest(['(intercept)', {', '.join(f"'{c}'" for c in NEWTON)}]) AS f, unnest([{', '.join(f'b{i}' for i in range(len(NEWTON) + 1))}]) AS b
      FROM it WHERE k = 14)""")

sql("rolling_distinct_buyers", f"""WITH {SALES_LINES}
SELECT d.stock_code, d.date, count(DISTINCT l.customer_id) AS distinct_buyers_30d
FROM (SELECT DISTINCT stock_code, date FROM clean_lines) d
JOIN (SELECT DISTINCT stock_code, date, customer_id FROM clean_lines) l
  ON l.stock_code = d.stock_code AND l.date BETWEEN d.date - 29 AND d.date
GROUP BY d.stock_code, d.date""")

sql("bootstrap_class_weights", f"""WITH {WEB_EVENTS},
terms AS (SELECT k, exp(-1) * sum(1 / factorial(CAST(k AS INTEGER))) OVER (ORDER BY k) AS c FROM range(12) t(k)),
u AS (SELECT ga_session_id, high_conversion_session AS label, CAST(b AS INTEGER) AS bootstrap,
             CAST(CAST('0x' || substr(md5(ga_session_id || '|42|' || b), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM sessions, range(5) t(b)),
drawn AS (SELECT bootstrap, label, (SELECT count(*) FROM terms WHERE c <= u) AS times FROM u),
n AS (SELECT bootstrap, label, CAST(sum(times) AS BIGINT) AS n_class FROM drawn WHERE times > 0 GROUP BY ALL)
SELECT bootstrap, label, n_class, round(sum(n_class) OVER (PARTITION BY bootstrap)
       / (count(*) OVER (PARTITION BY bootstrap) * n_class) * 1e6) / 1e6 AS weight FROM n""")

sql("feature_matrix_reloaded", ORACLE["feature_matrix"])

sql("csv_inferred_schema", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey,
       CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice * 1e6) / 1e6 END AS o_totalprice,
       date_trunc('minute', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority, o_orderstatus = 'F' AS filled
FROM orders""")

sql("parse_ts_detected", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN date_trunc('second', o_orderdate)::TIMESTAMP END AS iso,
       CASE WHEN o_orderstatus <> 'P' THEN date_trunc('minute', o_orderdate)::TIMESTAMP END AS month_first,
       CASE WHEN o_orderstatus <> 'P' THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS day_first
FROM orders""")

sql("parse_ts_report", """
SELECT c AS column_name, f AS format, count(*) FILTER (o_orderstatus <> 'P') AS parsed, count(*) FILTER (o_orderstatus = 'P') AS unparsed
FROM orders, (VALUES ('iso', 'yyyy-MM-dd''T''HH:mm:ss'), ('month_first', 'M/d/yyyy H:mm'), ('day_first', 'd/M/yyyy')) t(c, f)
GROUP BY c, f""")

sql("first_in_file_order", """WITH e AS (SELECT user_id, event_type, value, row_number() OVER () AS p FROM events)
SELECT user_id, arg_min(event_type, p) FILTER (event_type IS NOT NULL) AS first_event_type,
       round(arg_min(value, p) FILTER (value IS NOT NULL) * 1e6) / 1e6 AS first_value FROM e GROUP BY user_id""")

sql("positional_split", """
SELECT event_id, CASE WHEN p <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT event_id, row_number() OVER () AS p, count(*) OVER () AS n FROM events)""")

sql("histogram_nice", """WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, (max(o_totalprice) - min(o_totalprice)) / 39.0::DOUBLE AS raw FROM orders),
p AS (SELECT *, pow(10.0::DOUBLE, floor(log10(raw))) AS power FROM e),
s AS (SELECT low, high, (CASE WHEN raw / power <= 1 THEN 1.0::DOUBLE WHEN raw / power <= 2 THEN 2.0 WHEN raw / power <= 5 THEN 5.0 ELSE 10.0 END) * power AS step FROM p),
b AS (SELECT step, unnest(range(floor(low / step)::BIGINT, floor(high / step)::BIGINT + 1)) AS bin FROM s),
c AS (SELECT floor(o_totalprice / step)::BIGINT AS bin, count(*) AS n FROM orders, s GROUP BY 1)
SELECT round(bin * step * 1e6) / 1e6 AS bin_lo, round((bin + 1) * step * 1e6) / 1e6 AS bin_hi, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
