"""Table schemas and the fixed domains the operators rely on."""

from __future__ import annotations

from pyspark.sql import types as T

DEMOGRAPHICS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("income_range", T.StringType()),
    T.StructField("risk_profile", T.StringType()),
    T.StructField("occupation", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("contract_date", T.DateType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("description", T.StringType()),
])

CLIENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("income_range", T.StringType()),
    T.StructField("risk_profile", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("profile_category", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("acquisition_date", T.TimestampType()),
    T.StructField("last_contact_date", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("opportunity_value", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

PREDICTIONS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("is_target", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

CONTACTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("contacted_at", T.TimestampType()),
    T.StructField("channel", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("outcome", T.StringType()),
])

STATUS_CHANGES = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("new_status", T.StringType()),
    T.StructField("changed_at", T.TimestampType()),
])

# ---------------------------------------------------------------------------
# Words, edges and defaults that results depend on.
# ---------------------------------------------------------------------------
PRODUCT_FLAGS = ["checking_account", "savings_account", "credit_card", "insurance", "investment"]
PRODUCT_RECODE = {"investment_account": "investment"}
MERCHANT_CATEGORIES = [
    "entertainment", "food", "health", "shopping", "supermarket", "transport", "travel",
]
INCOME_RANGES = ["30k-50k", "50k-100k", "100k-150k", "150k+"]
RISK_PROFILES = ["conservative", "moderate", "aggressive"]

AGE_EDGES = [18.0, 24.5, 31.0, 37.5, 44.0, 50.5, 57.0, 63.5, 70.0]
AGE_LABELS = ["18–24", "25–31", "32–38", "39–45", "46–52", "53–59", "60–66", "67–70"]
AMOUNT_RANGE = (5.17, 1989.25)
AMOUNT_BINS = 11

COMBO_NONE = "sin_productos"
COMBO_MANY = "multi_producto"
COMBO_OTHER = "OTRA_COMBINACION"
COMBO_LISTED = [
    "checking_account",
    "savings_account",
    "credit_card + savings_account",
    "insurance + savings_account",
    "checking_account + insurance",
    "checking_account + credit_card",
    "checking_account + investment",
    "investment + savings_account",
]

NO_SECOND_PRODUCT = "none"
NO_SECOND_DATE = "1900-01-01"
REFERENCE_DATE = "2024-01-01"
TARGET = "insurance"

COLLINEAR_COLUMNS = [
    "total_spend", "monto_promedio_mensual", "monto_promedio_transaccion",
    "hhi", "share_fav", "total_transacciones",
]

STATUSES = ["pending", "contacted", "interested", "not_interested", "converted", "lost"]
OUTCOMES = ["success", "pending", "not_interested", "unreachable", "other"]
HEATMAP_VARIABLES = [
    "age", "income_range", "risk_profile", "occupation", "segment", "probability",
]
HEATMAP_BANDS = {
    "age": ["18-25", "26-35", "36-45", "46-55", "56+"],
    "income_range": ["0-50k", "50k-100k", "100k-150k", "150k+"],
    "risk_profile": ["conservative", "moderate", "aggressive"],
    "status": ["pending", "contacted"],
}
INCOME_CODES = {"0-50k": 1, "50k-100k": 2, "100k-150k": 3, "150k+": 4}
RISK_CODES = {"conservative": 1, "moderate": 2, "aggressive": 3}
SERVICE_THRESHOLD = 0.5
MODEL_THRESHOLD = 0.23885836
BUSINESS_THRESHOLD = 0.23
CLIENT_DEFAULTS = {
    "profile_category": "standard",
    "segment": "potential",
    "status": "pending",
    "priority": "medium",
    "probability": 0.5,
}
INCOME_FALLBACK = 3000.0
EXPECTED_TABLES = [
    "demographics", "prediction_results", "contacts", "contact_history",
    "products", "transactions", "goals",
]
