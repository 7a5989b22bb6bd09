"""The derived customer table reproduces the FIXTURES.md §2 statistics (sf0.001 column)."""

from pyspark.sql import functions as F

from retentio.plans import portfolio as P


def test_fixture_statistics_sf0001(spark, sf_small):
    df = P.customers(spark, sf_small)
    c = F.col
    row = df.agg(
        F.count(F.lit(1)), F.round(F.avg("churned"), 3),
        F.count_if((c("age") < 18) | (c("age") > 100)),
        F.count_if((c("cart_abandonment_rate") < 0) | (c("cart_abandonment_rate") > 100)),
        F.count_if(c("social_engagement_score") > 100), F.count_if(c("credit_balance") < 0),
        F.count_if(c("total_purchases") <= 5), F.count_if((c("total_purchases") > 5) & (c("total_purchases") <= 15)),
        F.count_if((c("total_purchases") > 15) & (c("total_purchases") <= 30)), F.count_if(c("total_purchases") > 30),
        F.count_if(c("days_since_last_purchase") <= 30),
        F.count_if((c("days_since_last_purchase") > 30) & (c("days_since_last_purchase") <= 60)),
        F.count_if((c("days_since_last_purchase") > 60) & (c("days_since_last_purchase") <= 90)),
        F.count_if(c("days_since_last_purchase") > 90), F.count_if(c("days_since_last_purchase").isNull()),
        F.count_if(c("lifetime_value") <= 1000), F.count_if((c("lifetime_value") > 1000) & (c("lifetime_value") <= 2500)),
        F.count_if((c("lifetime_value") > 2500) & (c("lifetime_value") <= 5000)), F.count_if(c("lifetime_value") > 5000),
        F.count_if(c("lifetime_value").isNull()),
    ).first()
    assert tuple(row) == (150, 0.467, 11, 6, 0, 11, 16, 131, 3, 0, 15, 18, 15, 102, 0, 8, 83, 58, 1, 0)
