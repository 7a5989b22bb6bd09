"""Column vocabulary and business constants.

Everything below the "FIXED VALUES" marker must stay equal to the behaviour
being reproduced (header aliases, column groups, bin edges, score weights,
risk cut-offs, quantile levels of presets, signals and scenarios).  Canonical
names are English snake_case; label texts are English.
"""

from __future__ import annotations

TARGET = "churned"
ID = "customer_id"
SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES — source header aliases.  Each canonical column accepts its
# English source header and its Spanish source header (both exact spellings).
# canonical: (english header, spanish header)
# ---------------------------------------------------------------------------
HEADER_ALIASES: dict[str, tuple[str, str]] = {
    "age": ("Age", "Edad"),
    "gender": ("Gender", "Genero"),
    "country": ("Country", "Pais"),
    "city": ("City", "Ciudad"),
    "membership_years": ("Membership_Years", "Anos_Membresia"),
    "login_frequency": ("Login_Frequency", "Frecuencia_Login"),
    "session_duration_avg": ("Session_Duration_Avg", "Duracion_Sesion_Promedio"),
    "pages_per_session": ("Pages_Per_Session", "Paginas_Por_Sesion"),
    "cart_abandonment_rate": ("Cart_Abandonment_Rate", "Tasa_Abandono_Carrito"),
    "wishlist_items": ("Wishlist_Items", "Articulos_Lista_Deseos"),
    "total_purchases": ("Total_Purchases", "Total_Compras"),
    "average_order_value": ("Average_Order_Value", "Valor_Promedio_Pedido"),
    "days_since_last_purchase": ("Days_Since_Last_Purchase", "Dias_Desde_Ultima_Compra"),
    "discount_usage_rate": ("Discount_Usage_Rate", "Tasa_Uso_Descuento"),
    "returns_rate": ("Returns_Rate", "Tasa_Devoluciones"),
    "email_open_rate": ("Email_Open_Rate", "Tasa_Apertura_Email"),
    "customer_service_calls": ("Customer_Service_Calls", "Llamadas_Servicio_Cliente"),
    "product_reviews_written": ("Product_Reviews_Written", "Resenas_Productos_Escritas"),
    "social_engagement_score": ("Social_Media_Engagement_Score", "Puntuacion_Engagement_Redes_Sociales"),
    "mobile_app_usage": ("Mobile_App_Usage", "Uso_App_Movil"),
    "payment_method_diversity": ("Payment_Method_Diversity", "Diversidad_Metodo_Pago"),
    "lifetime_value": ("Lifetime_Value", "Valor_Vida_Util"),
    "credit_balance": ("Credit_Balance", "Balance_Credito"),
    "churned": ("Churned", "Fuga_Cliente"),
    "signup_quarter": ("Signup_Quarter", "Trimestre_Registro"),
}

# FIXED VALUES — the 19 base numeric columns, in their declared order.
BASE_NUMERIC = [
    "age",
    "membership_years",
    "login_frequency",
    "session_duration_avg",
    "pages_per_session",
    "cart_abandonment_rate",
    "wishlist_items",
    "total_purchases",
    "average_order_value",
    "days_since_last_purchase",
    "discount_usage_rate",
    "returns_rate",
    "email_open_rate",
    "customer_service_calls",
    "product_reviews_written",
    "social_engagement_score",
    "mobile_app_usage",
    "lifetime_value",
    "credit_balance",
]

# FIXED VALUES — source categorical columns and defaults used when a column is absent.
SOURCE_CATEGORICAL = ["gender", "country", "city", "signup_quarter", "payment_method_diversity"]
ABSENT_DEFAULTS = {
    "gender": "Unknown",
    "country": "Unknown",
    "signup_quarter": "Q1",
    "payment_method_diversity": "Unknown",
}
# Text cells read as missing (pandas' default missing-value tokens).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# FIXED VALUES — derived columns.
BINARY_COLUMNS = ["uses_app", "has_credit"]
DERIVED_CATEGORICAL = ["age_group", "purchase_segment", "recency_segment", "ltv_segment"]
NUMERIC = BASE_NUMERIC + BINARY_COLUMNS
CATEGORICAL = ["gender", "country", "signup_quarter", "payment_method_diversity"] + DERIVED_CATEGORICAL
PREDICTION_COLUMNS = NUMERIC + CATEGORICAL
SELECTED_FEATURES_K = 35

# FIXED VALUES — current preprocessing column groups, in declared order.
LOG_COLUMNS = [
    "lifetime_value",
    "total_purchases",
    "days_since_last_purchase",
    "average_order_value",
    "credit_balance",
]
CAP_COLUMNS = [
    "age",
    "membership_years",
    "login_frequency",
    "session_duration_avg",
    "pages_per_session",
    "cart_abandonment_rate",
    "wishlist_items",
    "discount_usage_rate",
    "returns_rate",
    "email_open_rate",
    "customer_service_calls",
    "product_reviews_written",
    "social_engagement_score",
    "mobile_app_usage",
]
NOMINAL_COLUMNS = ["gender", "country", "signup_quarter", "age_group", "payment_method_diversity"]
ORDINAL_COLUMNS = ["recency_segment", "ltv_segment", "purchase_segment"]
ORDINAL_LEVELS = {
    "recency_segment": ["recent", "medium", "risk", "inactive"],
    "ltv_segment": ["low", "medium", "high", "very_high"],
    "purchase_segment": ["occasional", "regular", "frequent", "vip"],
}
# FIXED VALUES — group prefixes used in transformed feature names ("group__column[_level]").
GROUP_LOG, GROUP_CAP, GROUP_BINARY, GROUP_NOMINAL, GROUP_ORDINAL = (
    "num_log", "num_cap", "binary", "cat_nom", "cat_ord",
)
# FIXED VALUES — legacy profile groups: all numerics with median + robust scaling, all categoricals one-hot.
LEGACY_GROUP_NUMERIC, LEGACY_GROUP_CATEGORICAL = "num", "cat"

# FIXED VALUES — validity rules.
AGE_RANGE = (18.0, 100.0)
RATE_COLUMNS = [
    "cart_abandonment_rate",
    "discount_usage_rate",
    "returns_rate",
    "email_open_rate",
    "social_engagement_score",
]
NON_NEGATIVE_COLUMNS = [
    "lifetime_value",
    "total_purchases",
    "days_since_last_purchase",
    "average_order_value",
    "credit_balance",
    "membership_years",
    "login_frequency",
    "session_duration_avg",
    "pages_per_session",
    "wishlist_items",
    "customer_service_calls",
    "product_reviews_written",
    "mobile_app_usage",
]

# FIXED VALUES — segment bins (right-closed intervals).  (edges, labels);
# None as first edge means -inf, None as last edge means +inf.
CURRENT_BINS = {
    "age_group": ("age", [17, 25, 40, 60, 100], ["young", "young_adult", "adult", "senior_adult"]),
    "purchase_segment": ("total_purchases", [None, 5, 15, 30, None], ["occasional", "regular", "frequent", "vip"]),
    "recency_segment": ("days_since_last_purchase", [None, 30, 60, 90, None], ["recent", "medium", "risk", "inactive"]),
    "ltv_segment": ("lifetime_value", [None, 1000, 2500, 5000, None], ["low", "medium", "high", "very_high"]),
}
# Legacy profile; its age bins include the lowest edge (0 <= age <= 25).
LEGACY_BINS = {
    "age_group": ("age", [0, 25, 35, 50, 65, None], ["young", "young_adult", "adult", "senior_adult", "senior"]),
    "purchase_segment": ("total_purchases", [None, 5, 10, 20, None], ["low", "medium", "high", "very_high"]),
    "recency_segment": ("days_since_last_purchase", [None, 7, 30, 60, None], ["recent", "medium", "far", "very_far"]),
    "ltv_segment": ("lifetime_value", [None, 500, 1000, 2000, None], ["low", "medium", "high", "premium"]),
}
LEGACY_INCLUDE_LOWEST = {"age_group"}

# FIXED VALUES — rule score weights (linear logit, offset 2.3, no noise term).
SCORE_WEIGHTS = [
    ("cart_abandonment_rate", 0.030),
    ("days_since_last_purchase", 0.018),
    ("customer_service_calls", 0.110),
    ("returns_rate", 0.018),
    ("email_open_rate", -0.026),
    ("login_frequency", -0.055),
    ("mobile_app_usage", -0.016),
    ("total_purchases", -0.0020),
    ("lifetime_value", -0.00016),
]
SCORE_OFFSET = 2.3

# FIXED VALUES — risk levels, decision threshold and retention actions.
RISK_HIGH_AT, RISK_MEDIUM_AT = 0.70, 0.40
DEFAULT_THRESHOLD = 0.50
RISK_LEVELS = ["high", "medium", "low"]
RISK_ACTIONS = {
    "high": "Prioritise contact, personalised incentive and a review of support or cart friction.",
    "medium": "Launch a preventive campaign, monitor recency and reinforce retention benefits.",
    "low": "Keep regular loyalty care and watch for sudden behaviour changes.",
}
CHURN_LABEL, ACTIVE_LABEL = "churn", "active"

# FIXED VALUES — demo presets: (scenario, [(column, quantile)]), other columns take medians/modes.
PRESETS = [
    ("stable", [
        ("login_frequency", 0.80),
        ("days_since_last_purchase", 0.20),
        ("cart_abandonment_rate", 0.20),
        ("email_open_rate", 0.80),
        ("customer_service_calls", 0.20),
        ("mobile_app_usage", 0.80),
        ("total_purchases", 0.75),
        ("lifetime_value", 0.75),
    ]),
    ("medium_risk", [
        ("login_frequency", 0.45),
        ("days_since_last_purchase", 0.65),
        ("cart_abandonment_rate", 0.65),
        ("email_open_rate", 0.40),
        ("customer_service_calls", 0.65),
        ("mobile_app_usage", 0.40),
    ]),
    ("high_risk", [
        ("login_frequency", 0.10),
        ("days_since_last_purchase", 0.90),
        ("cart_abandonment_rate", 0.90),
        ("email_open_rate", 0.10),
        ("customer_service_calls", 0.90),
        ("mobile_app_usage", 0.10),
        ("total_purchases", 0.25),
        ("lifetime_value", 0.25),
        ("returns_rate", 0.85),
    ]),
]

# FIXED VALUES — risk signals: (signal, column, comparison, quantile, criterion text, reading).
# Comparisons are inclusive (>= / <=).
SIGNALS = [
    ("high_cart_abandonment", "cart_abandonment_rate", ">=", 0.75, "> p75", "Direct friction before purchase."),
    ("high_recency", "days_since_last_purchase", ">=", 0.75, "> p75", "Too long since the last purchase."),
    ("low_email_open", "email_open_rate", "<=", 0.25, "< p25", "Weaker response to retention campaigns."),
    ("many_support_calls", "customer_service_calls", ">=", 0.75, "> p75", "May signal friction, complaints or poor experience."),
    ("low_app_usage", "mobile_app_usage", "<=", 0.25, "< p25", "Weaker digital habit and lower recurrence."),
    ("low_lifetime_value", "lifetime_value", "<=", 0.25, "< p25", "Smaller accumulated economic history."),
]
NO_SIGNAL = ("no_strong_signal", "-", "within central ranges",
             "Risk depends on softer combinations of behaviour.")

# FIXED VALUES — what-if scenarios: (scenario, [(column, quantile)]).
SCENARIOS = [
    ("reduce_cart_friction", [("cart_abandonment_rate", 0.35)]),
    ("reactivate_recent_purchase", [("days_since_last_purchase", 0.35)]),
    ("improve_digital_engagement", [("email_open_rate", 0.70), ("mobile_app_usage", 0.70)]),
    ("resolve_support_friction", [("customer_service_calls", 0.25)]),
]

# FIXED VALUES — model comparison comments (English renderings).
MODEL_COMMENTS = {
    "majority_baseline": "Minimum reference: predicts the most frequent class.",
    "logistic_regression": "Interpretable, fast linear model.",
    "random_forest": "Robust ensemble, harder to explain.",
    "gradient_boosting": "Classic boosting close to the winning approach.",
    "mlp": "Multilayer network; flexible but less transparent and more tuning-sensitive.",
    "hist_gradient_boosting": "Best balance of performance, stability, cost and operational explainability.",
}

# FIXED VALUES — permutation importance.
IMPORTANCE_COLUMNS = BASE_NUMERIC + ["gender", "country", "signup_quarter", "payment_method_diversity"]
IMPORTANCE_SAMPLE_SIZE = 4000        # size of the importance sample (L4)
IMPORTANCE_REPEATS = 8

# FIXED VALUES — sampling and report sizes.
TEST_FRACTION = 0.20
COMPARISON_MAX_ROWS = 20000
SCATTER_SAMPLE_ROWS = 6000
HISTOGRAM_MAX_BINS = 45
TOP_COUNTRIES = 12
TOP_NULL_COLUMNS = 12
RANKED_ROWS = 200

# FIXED VALUES — display labels (English renderings of the variable labels).
VARIABLE_LABELS = {
    "age": "Age",
    "gender": "Gender",
    "country": "Country",
    "city": "City",
    "membership_years": "Membership Years",
    "login_frequency": "Login Frequency",
    "session_duration_avg": "Session Duration",
    "pages_per_session": "Pages per Session",
    "cart_abandonment_rate": "Cart Abandonment Rate",
    "wishlist_items": "Wishlist Items",
    "total_purchases": "Total Purchases",
    "average_order_value": "Average Order Value",
    "days_since_last_purchase": "Days since Last Purchase",
    "discount_usage_rate": "Discount Usage Rate",
    "returns_rate": "Returns Rate",
    "email_open_rate": "Email Open Rate",
    "customer_service_calls": "Customer Service Calls",
    "product_reviews_written": "Reviews Written",
    "social_engagement_score": "Social Media Engagement",
    "mobile_app_usage": "Mobile App Usage",
    "payment_method_diversity": "Payment Method Diversity",
    "lifetime_value": "Customer Lifetime Value",
    "credit_balance": "Credit Balance",
    "signup_quarter": "Signup Quarter",
    "churned": "Churned",
    "age_group": "Age Group",
    "purchase_segment": "Purchase Segment",
    "recency_segment": "Recency Segment",
    "ltv_segment": "Lifetime Value Segment",
    "uses_app": "Uses Mobile App",
    "has_credit": "Has Credit Balance",
}
