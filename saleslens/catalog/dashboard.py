"""Business queries, paging, client merges and status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.catalog.base import Tables, over, query, rounded
from saleslens.functions import (
    dashboard_age_band,
    income_lower_bound,
    label_probability,
    priority_band,
    series_name,
)
from saleslens.operators import buckets as BU
from saleslens.operators import cleaning as C
from saleslens.operators import cube as CU
from saleslens.operators import dashboard as D
from saleslens.operators import merge as M
from saleslens.operators import paging as PG
from saleslens.session import scratch
from saleslens.sources import tables as IO
from saleslens.sources.adapters import table

AS_OF = "2024-01-20"
LIST = """SELECT id, user_id, probability, status, age, risk_profile, income_range,
 CASE WHEN probability > 0.7 THEN 'high' WHEN probability > 0.4 THEN 'medium' ELSE 'low' END AS priority FROM clients"""


@query("d01_kpi_summary", over("clients", "contacts") + """
SELECT count(*) AS total_clients, round(avg(probability), 6) AS churn_risk_mean,
 count(*) FILTER (probability >= 0.5) AS at_risk_count, 0.0::DOUBLE AS conversion_rate,
 (SELECT count(id) FROM contacts) AS contacted FROM clients""")
def kpis(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(D.kpi_summary(t.clients, t.contacts), 6, "churn_risk_mean")


@query("d02_business_kpis", over("clients", more="""
k AS (SELECT count(*) AS total_clients, round_even(avg(probability), 2) AS churn_risk_mean,
 count(*) FILTER (status <> 'pending') AS contacted, count(*) FILTER (probability >= 0.23) AS potential FROM clients)""") + """
SELECT total_clients, churn_risk_mean, contacted, 0.0::DOUBLE AS conversion_rate, potential AS at_risk_count,
 potential AS potential_clients, CAST(floor(potential * 0.2::DOUBLE) AS BIGINT) AS expected_conversion,
 potential * 1000 AS financial_opportunity, contacted AS contact_progress FROM k""")
def business(spark, sf_dir):
    return D.business_kpis(Tables(spark, sf_dir).clients)


@query("d03_probability_histogram", over("clients", more="""
bins AS (SELECT i, 0.2::DOUBLE * i AS lo FROM range(5) t(i)), n AS (SELECT count(probability) AS total FROM clients)""") + """
SELECT (20 * i) || '-' || (20 * i + 20) || '%' AS range,
 count(*) FILTER (probability >= i / 5.0::DOUBLE AND probability < (i + 1) / 5.0::DOUBLE) AS count,
 round_even(count(*) FILTER (probability >= i / 5.0::DOUBLE AND probability < (i + 1) / 5.0::DOUBLE)::DOUBLE
   / any_value(total) * 100, 2) AS percentage
FROM bins, clients, n GROUP BY i""")
def histogram(spark, sf_dir):
    return D.probability_histogram(Tables(spark, sf_dir).clients)


@query("d03_missing_probabilities", over("clients") + """
SELECT count(*) FILTER (probability IS NULL) AS sin_probabilidad FROM clients""")
def missing(spark, sf_dir):
    return D.missing_probabilities(Tables(spark, sf_dir).clients)


@query("d03_missing_probabilities_found", over("clients") + """
SELECT count(*) FILTER (id % 10 = 3) AS sin_probabilidad FROM clients""")
def missing_found(spark, sf_dir):
    """Clients of which a tenth has no probability."""
    clients = Tables(spark, sf_dir).clients
    return D.missing_probabilities(clients.withColumn("probability", F.when(F.col("id") % 10 != 3, F.col("probability"))))


@query("d04_contacted_histogram", over("clients", more="bins AS (SELECT i FROM range(10) t(i))") + """
SELECT (10 * i) || '-' || (10 * i + 10) || '%' AS range,
 count(*) FILTER (status = 'pending' AND probability >= i / 10.0::DOUBLE AND probability < (i + 1) / 10.0::DOUBLE) AS no_contacted,
 count(*) FILTER (status <> 'pending' AND probability >= i / 10.0::DOUBLE AND probability < (i + 1) / 10.0::DOUBLE) AS contacted,
 0.2389::DOUBLE AS threshold FROM bins, clients GROUP BY i""")
def contacted_histogram(spark, sf_dir):
    return D.contacted_histogram(Tables(spark, sf_dir).clients)


for x, y in (("income_range", "segment"), ("age", "risk_profile"), ("occupation", "risk_profile")):
    query(f"d05_heatmap_{x}_{y}", over("clients") + f"""
SELECT coalesce(CAST({x} AS VARCHAR), 'N/A') AS x, coalesce(CAST({y} AS VARCHAR), 'N/A') AS y, count(id) AS value
FROM clients GROUP BY {x}, {y}""")(
        lambda spark, sf_dir, x=x, y=y: D.heatmap(Tables(spark, sf_dir).clients, x, y))


@query("d05_heatmap_axis", over("clients") + "SELECT DISTINCT coalesce(segment, 'N/A') AS value FROM clients")
def axis(spark, sf_dir):
    return D.heatmap_axis(Tables(spark, sf_dir).clients, "segment")


AGES = """CASE WHEN age BETWEEN 18 AND 25 THEN '18-25' WHEN age BETWEEN 26 AND 35 THEN '26-35'
 WHEN age BETWEEN 36 AND 45 THEN '36-45' WHEN age BETWEEN 46 AND 55 THEN '46-55' ELSE '56+' END"""
GRID = """xs AS (SELECT * FROM (VALUES (0, '18-25'), (1, '26-35'), (2, '36-45'), (3, '46-55'), (4, '56+')) t(x_pos, x)),
ys AS (SELECT * FROM (VALUES (0, 'conservative'), (1, 'moderate'), (2, 'aggressive')) t(y_pos, y))"""
for metric, value, zero in (("count", "count(id)", "0"), ("probability", "round_even(avg(probability), 2)", "0.0::DOUBLE")):
    query(f"d06_banded_heatmap_{metric}", over("clients", more=GRID) + f"""
SELECT y_pos, x_pos, y, x, coalesce({value}, {zero}) AS value FROM xs CROSS JOIN ys
LEFT JOIN clients ON {AGES} = x AND risk_profile = y GROUP BY ALL""")(
        lambda spark, sf_dir, metric=metric: D.banded_heatmap(Tables(spark, sf_dir).clients, "age", "risk_profile", metric))


@query("d06_banded_matrix", over("clients") + f"""
SELECT CAST(CASE risk_profile WHEN 'conservative' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS INTEGER) AS y_pos, risk_profile AS y, """
       + ", ".join(f"count(*) FILTER ({AGES} = '{b}') AS \"{b}\"" for b in S.HEATMAP_BANDS["age"])
       + " FROM clients GROUP BY risk_profile")
def matrix(spark, sf_dir):
    return D.banded_matrix(Tables(spark, sf_dir).clients, "age", "risk_profile", "count")


def _cube(spark, sf_dir):
    return CU.build(Tables(spark, sf_dir).clients, scratch(spark))


_PAIRS = [(x, y) for i, x in enumerate(["age", "income_range", "risk_profile", "occupation", "segment"])
          for y in ["age", "income_range", "risk_profile", "occupation", "segment"][i + 1:]]


@query("d05_heatmaps_from_cube", over("clients") + " UNION ALL ".join(f"""
SELECT '{x}' AS eje_x, '{y}' AS eje_y, coalesce(CAST({x} AS VARCHAR), 'N/A') AS x, coalesce(CAST({y} AS VARCHAR), 'N/A') AS y, count(id) AS value
FROM clients GROUP BY {x}, {y}""" for x, y in _PAIRS))
def cube_heatmaps(spark, sf_dir):
    """Every pair of the heat maps from the stored counts."""
    cube = _cube(spark, sf_dir)
    parts = [cube.heatmap(x, y).select(F.lit(x).alias("eje_x"), F.lit(y).alias("eje_y"), "x", "y", "value") for x, y in _PAIRS]
    return reduce(DataFrame.unionByName, parts)


for metric, value, zero in (("count", "count(id)", "0"), ("probability", "round_even(avg(probability), 2)", "0.0::DOUBLE")):
    query(f"d06_banded_heatmap_{metric}_from_cube", over("clients", more=GRID) + f"""
SELECT y_pos, x_pos, y, x, coalesce({value}, {zero}) AS value FROM xs CROSS JOIN ys
LEFT JOIN clients ON {AGES} = x AND risk_profile = y GROUP BY ALL""")(
        lambda spark, sf_dir, metric=metric: _cube(spark, sf_dir).banded_heatmap("age", "risk_profile", metric))


@query("a26_contingency_from_cube", over("clients") + "SELECT occupation, " + ", ".join(
    f"count(*) FILTER (income_range = '{v}') AS \"{v}\"" for v in S.INCOME_RANGES) + " FROM clients GROUP BY occupation")
def cube_contingency(spark, sf_dir):
    return _cube(spark, sf_dir).contingency("occupation", "income_range", S.INCOME_RANGES)


@query("d14_segment_opportunity", over("clients") + """
SELECT income_range AS x, risk_profile AS y, count(*) AS value,
 CAST(floor(count(*) * 0.2::DOUBLE + 0.5) AS BIGINT) AS expected_conversion,
 CAST(floor(count(*) * 0.2::DOUBLE + 0.5) AS BIGINT) * 1000 AS financial FROM clients GROUP BY ALL""")
def opportunity(spark, sf_dir):
    return D.segment_opportunity(D.heatmap(Tables(spark, sf_dir).clients, "income_range", "risk_profile"))


@query("f20_percent_cells", over("clients") + """
SELECT risk_profile, printf('%.0f%%', avg(probability) * 100) AS celda,
 round(avg(probability) * 100, 2) AS porcentaje FROM clients GROUP BY risk_profile""")
def percents(spark, sf_dir):
    means = Tables(spark, sf_dir).clients.groupBy("risk_profile").agg(F.avg("probability").alias("p"))
    return means.select("risk_profile", D.percent_cell("p").alias("celda"), F.round(F.col("p") * 100, 2).alias("porcentaje"))


# -- contacts -------------------------------------------------------------------

OUTCOMES = ", ".join(
    f"count(*) FILTER (coalesce(outcome, 'other') = '{o}') AS {o}" for o in S.OUTCOMES)


@query("d08_contact_progress", over("contacts") + f"""
SELECT CAST(contacted_at AS DATE) AS date, {OUTCOMES} FROM contacts GROUP BY 1""")
def progress(spark, sf_dir):
    return D.contact_progress(Tables(spark, sf_dir).contacts)


@query("d08_contact_progress_in_range", over("contacts") + f"""
SELECT CAST(contacted_at AS DATE) AS date, {OUTCOMES} FROM contacts
WHERE contacted_at >= TIMESTAMP '2024-01-05' AND contacted_at <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def progress_range(spark, sf_dir):
    return D.contact_progress(Tables(spark, sf_dir).contacts, "2024-01-05", "2024-01-20")


@query("d08_contact_series", over("contacts", more="""
names AS (SELECT * FROM (VALUES ('success', 'Success'), ('pending', 'Pending'), ('not_interested', 'Not Interested'),
 ('unreachable', 'Unreachable'), ('other', 'Other')) t(outcome, name)),
days AS (SELECT DISTINCT CAST(contacted_at AS DATE) AS date FROM contacts)""") + """
SELECT date, name, count(c.id) AS data FROM days CROSS JOIN names n
LEFT JOIN contacts c ON CAST(c.contacted_at AS DATE) = date AND coalesce(c.outcome, 'other') = n.outcome GROUP BY ALL""")
def series(spark, sf_dir):
    return D.contact_series(Tables(spark, sf_dir).contacts)


PACE = over("clients", more="""
k AS (SELECT count(*) FILTER (status <> 'pending') AS done, count(*) FILTER (probability >= 0.23) AS prioritized FROM clients),
d AS (SELECT *, 2000::BIGINT AS target, 31 - 20 AS days_left, greatest(0, 2000 - done) AS remaining FROM k),
pace AS (SELECT done AS total_contacted, prioritized AS total_prioritized, CAST(target AS INTEGER) AS monthly_target,
 done AS contacted_this_month, CAST(days_left AS INTEGER) AS days_remaining, remaining AS remaining_contacts,
 CAST(ceil(remaining::DOUBLE / days_left) AS BIGINT) AS daily_needed, done // 20 AS daily_expected FROM d)""")


@query("d09_contact_pace", PACE + """
SELECT *, daily_expected - daily_needed AS difference,
 CASE WHEN contacted_this_month >= monthly_target THEN '¡Meta mensual de ' || monthly_target || ' contactos alcanzada!'
  WHEN daily_expected >= daily_needed THEN 'Ritmo actual (' || daily_expected || '/día) suficiente para alcanzar la meta.'
  ELSE 'Ritmo actual (' || daily_expected || '/día) insuficiente. Necesitas ' || daily_needed || '/día.' END AS projection_message
FROM pace""")
def pace(spark, sf_dir):
    return D.contact_pace(Tables(spark, sf_dir).clients, 2000, AS_OF)


@query("d10_pace_percentages", PACE.rstrip() + """,
j AS (SELECT *, contacted_this_month + daily_expected * days_remaining AS projected FROM pace)
SELECT CAST(floor(total_contacted * 100.0::DOUBLE / total_prioritized + 0.5) AS BIGINT) AS general_pct,
 CAST(floor(contacted_this_month * 100.0::DOUBLE / monthly_target + 0.5) AS BIGINT) AS monthly_pct, projected AS projected_contacts,
 least(CAST(floor(projected * 100.0::DOUBLE / monthly_target + 0.5) AS BIGINT), 100) AS projected_pct,
 projected >= monthly_target AS will_reach_target FROM j""")
def percentages(spark, sf_dir):
    return D.pace_percentages(D.contact_pace(Tables(spark, sf_dir).clients, 2000, AS_OF))


@query("d13_health_counts", over("clients", "contacts") + """
SELECT (SELECT count(*) FROM clients WHERE probability >= 0.7) AS high_probability,
 (SELECT count(*) FROM contacts WHERE contacted_at >= TIMESTAMP '2024-02-14' - INTERVAL 30 DAYS) AS recent_predictions,
 (SELECT count(*) FROM contacts) AS contacts""")
def health(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.health_counts(t.clients, t.contacts, t.contacts, "2024-02-14", date="contacted_at")


@query("d13_health_counts_of_predictions", over("clients", "contacts") + """
SELECT (SELECT count(*) FROM clients WHERE probability >= 0.7) AS high_probability,
 (SELECT count(*) FROM clients WHERE DATE '2024-02-14' - CAST(id % 60 AS INTEGER) >= DATE '2024-02-14' - 30) AS recent_predictions,
 (SELECT count(*) FROM contacts) AS contacts""")
def health_of_predictions(spark, sf_dir):
    """Predictions of the last sixty days, each client on a day of its own."""
    t = Tables(spark, sf_dir)
    predictions = t.clients.select(F.date_sub(F.lit("2024-02-14").cast("date"), (F.col("id") % 60).cast("int")).alias("prediction_date"))
    return D.health_counts(t.clients, predictions, t.contacts, "2024-02-14")


# -- lists ----------------------------------------------------------------------


@query("o01_page_of_clients", over("clients") + """
SELECT id, probability FROM clients ORDER BY probability DESC NULLS FIRST, id LIMIT 25 OFFSET 50""")
def page(spark, sf_dir):
    return D.ranked_page(Tables(spark, sf_dir).clients, 3, 25).select("id", "probability")


@query("o01_page_by_position", over("clients") + """
SELECT id, probability FROM clients ORDER BY probability DESC NULLS FIRST, id LIMIT 10 OFFSET (SELECT count(*) // 20 * 10 FROM clients)""")
def page_by_position(spark, sf_dir):
    """A page from the middle of the ranked clients, from the ranges it lies in."""
    ranked = PG.ranked_clients(Tables(spark, sf_dir).clients, scratch(spark), rows_per_range=100)
    return ranked.page(ranked.total() // 20 + 1, 10).select("id", "probability")


@query("o01_next_page_by_key", over("clients", more="""
lastrow AS (SELECT probability AS p, id AS i FROM clients ORDER BY probability DESC NULLS FIRST, id LIMIT 1 OFFSET 49)""") + """
SELECT c.id, probability FROM clients c, lastrow WHERE probability < p OR (probability = p AND c.id > i)
ORDER BY probability DESC, c.id LIMIT 25""")
def next_page(spark, sf_dir):
    clients = Tables(spark, sf_dir).clients
    last = D.ranked_page(clients, 50, 1).first()
    return D.ranked_page(clients, size=25, after=(last["probability"], last["id"])).select("id", "probability")


@query("d12_priority_list", over("clients") + LIST + " ORDER BY probability DESC NULLS FIRST, id LIMIT 10")
def priority(spark, sf_dir):
    return D.priority_list(Tables(spark, sf_dir).clients, 1, 10)


@query("d12_all_list_rows", over("clients") + LIST)
def list_rows(spark, sf_dir):
    return D.list_row(Tables(spark, sf_dir).clients)


@query("o02_resorted", over("clients") + "SELECT id, income_range FROM clients ORDER BY income_range, id")
def resorted(spark, sf_dir):
    return D.resort(Tables(spark, sf_dir).clients.select("id", "income_range"), "income_range", descending=False)


@query("s10_exported_list", over("clients", more=f"list AS ({LIST})") + """
SELECT id, user_id, printf('%.2f', probability) AS probability, status, CAST(age AS VARCHAR) AS age, income_range,
 risk_profile, priority FROM list WHERE status IN ('pending', 'contacted') AND priority IN ('high')""")
def export(spark, sf_dir):
    return D.export_list(D.list_row(Tables(spark, sf_dir).clients), ["pending", "contacted"], [], ["high"])


@query("p09_multi_select", over("clients") + """
SELECT id, status, risk_profile FROM clients WHERE status IN ('pending') AND risk_profile IN ('moderate', 'aggressive')""")
def multi_select(spark, sf_dir):
    picked = C.any_of(Tables(spark, sf_dir).clients,
                      {"status": ["pending"], "risk_profile": ["moderate", "aggressive"], "segment": []})
    return picked.select("id", "status", "risk_profile")


@query("p10_threshold", over("clients") + "SELECT id, probability FROM clients WHERE probability >= 0.23885836")
def threshold(spark, sf_dir):
    return C.at_least(Tables(spark, sf_dir).clients, S.MODEL_THRESHOLD).select("id", "probability")


@query("p08_date_range", over("contacts") + """
SELECT id, contacted_at FROM contacts WHERE contacted_at >= TIMESTAMP '2024-01-05' AND contacted_at < TIMESTAMP '2024-01-11'""")
def date_range(spark, sf_dir):
    return C.between_dates(Tables(spark, sf_dir).contacts, "contacted_at", "2024-01-05", "2024-01-10",
                           end_inclusive_day=True).select("id", "contacted_at")


@query("p11_recent", over("contacts") + """
SELECT id, contacted_at FROM contacts WHERE contacted_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS""")
def recent(spark, sf_dir):
    return C.recent(Tables(spark, sf_dir).contacts, "contacted_at", AS_OF, 7).select("id", "contacted_at")


# -- scalar rules ----------------------------------------------------------------


@query("p18_three_feature_encoding", over("clients") + """
SELECT user_id, age, CASE income_range WHEN '0-50k' THEN 1 WHEN '50k-100k' THEN 2 WHEN '100k-150k' THEN 3
 WHEN '150k+' THEN 4 ELSE 1 END AS income_code,
 CASE risk_profile WHEN 'conservative' THEN 1 WHEN 'moderate' THEN 2 WHEN 'aggressive' THEN 3 ELSE 2 END AS risk_code FROM clients""")
def encoding(spark, sf_dir):
    return C.three_feature_encoding(Tables(spark, sf_dir).clients)


@query("f03_dashboard_age_band", over("clients") + f"SELECT id, {AGES} AS banda FROM clients")
def age_bands(spark, sf_dir):
    return Tables(spark, sf_dir).clients.select("id", dashboard_age_band("age").alias("banda"))


@query("f15_f16_priority_bands", over("clients") + """
SELECT id, CASE WHEN probability > 0.7 THEN 'high' WHEN probability > 0.4 THEN 'medium' ELSE 'low' END AS abierta,
 CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'medium' ELSE 'low' END AS cerrada FROM clients""")
def priority_bands(spark, sf_dir):
    return Tables(spark, sf_dir).clients.select(
        "id", priority_band("probability").alias("abierta"), priority_band("probability", inclusive=True).alias("cerrada"))


@query("f17_income_lower_bound", over("clients") + """
SELECT id, 3000.0::DOUBLE * (income_range <> '150k+')::INTEGER + 3000.0::DOUBLE * (income_range = '150k+')::INTEGER AS segun_texto,
 CASE income_range WHEN '30k-50k' THEN 30000.0::DOUBLE WHEN '50k-100k' THEN 50000 WHEN '100k-150k' THEN 100000 ELSE 3000 END AS con_miles
FROM clients""")
def incomes(spark, sf_dir):
    return Tables(spark, sf_dir).clients.select(
        "id", income_lower_bound("income_range").alias("segun_texto"),
        income_lower_bound("income_range", read_thousands=True).alias("con_miles"))


@query("f18_f19_outcome_names", over("contacts") + """
SELECT id, CASE coalesce(outcome, 'other') WHEN 'success' THEN 'Success' WHEN 'pending' THEN 'Pending'
 WHEN 'not_interested' THEN 'Not Interested' WHEN 'unreachable' THEN 'Unreachable' ELSE 'Other' END AS nombre FROM contacts""")
def outcome_names(spark, sf_dir):
    outcome = F.when(F.col("outcome").isin(S.OUTCOMES), F.col("outcome")).otherwise("other")
    return Tables(spark, sf_dir).contacts.select("id", series_name(outcome).alias("nombre"))


@query("f21_ceil_floor_rates", over("clients") + """
SELECT income_range, CAST(ceil(count(*)::DOUBLE / 7) AS BIGINT) AS por_dia_arriba, count(*) // 7 AS por_dia_abajo
FROM clients GROUP BY income_range""")
def rates(spark, sf_dir):
    n = Tables(spark, sf_dir).clients.groupBy("income_range").agg(F.count("*").alias("n"))
    return n.select("income_range", F.ceil(F.col("n") / 7).alias("por_dia_arriba"), F.floor(F.col("n") / 7).alias("por_dia_abajo"))


@query("f23_labelled_probability", over("clients") + """
SELECT id, CAST(probability >= 0.5 AS INTEGER) AS etiqueta FROM clients""")
def labelled(spark, sf_dir):
    return Tables(spark, sf_dir).clients.select("id", label_probability("probability", 0.5).alias("etiqueta"))


# -- merges ----------------------------------------------------------------------

# Stored: a prediction for every customer. Incoming: new ones for the customers met in the events,
# some of them several times, and for suppliers, which are not stored yet.
UPDATES = """stored AS (SELECT user_id, probability, probability >= 0.5 AS is_target, TIMESTAMP '2023-01-01' AS created_at FROM clients),
arrived AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS created_at, (value + 1000) / 11000 AS probability FROM events
 UNION ALL SELECT 's' || s_suppkey, TIMESTAMP '2024-02-01', (s_acctbal + 1000) / 11000 FROM supplier),
incoming AS (SELECT user_id, probability, probability >= 0.5 AS is_target, created_at FROM arrived
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, probability DESC) = 1)"""


def _stored_and_arrived(t):
    columns = ["user_id", "probability", (F.col("probability") >= 0.5).alias("is_target"), "created_at"]
    stored = t.clients.withColumn("created_at", F.lit("2023-01-01").cast("timestamp"))
    events = table(t.spark, t.sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"), ((F.col("value") + 1000) / 11000).alias("probability"),
        F.col("ts").cast("timestamp").alias("created_at"))
    suppliers = table(t.spark, t.sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("user_id"),
        ((F.col("s_acctbal") + 1000) / 11000).alias("probability"),
        F.lit("2024-02-01").cast("timestamp").alias("created_at"))
    return stored.select(*columns), events.unionByName(suppliers).select(*columns)


UPSERT_SQL = over("clients", more=UPDATES) + """
SELECT * FROM incoming UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.user_id = s.user_id)"""


@query("s06_prediction_upsert", UPSERT_SQL)
def prediction_upsert(spark, sf_dir):
    return M.upsert_predictions(*_stored_and_arrived(Tables(spark, sf_dir)))


def _in_batches(store, rows, update, key=None):
    """Merge rows in three batches, the second one twice."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    for i in (0, 1, 1, 2):
        store.merge(rows.where(part == i), update, f"batch {i}", key)
    return store.read()


@query("s06_bucket_merge", UPSERT_SQL)
def prediction_buckets(spark, sf_dir):
    """The predictions kept in buckets; the new ones come in three batches, the latest of a client first of all."""
    stored, arrived = _stored_and_arrived(Tables(spark, sf_dir))
    store = BU.create(stored, scratch(spark), "user_id", 16)

    def update(old, new):
        newer = M.latest_per_key(old.where("created_at > '2023-01-01'").unionByName(new), "user_id", ["created_at", "probability"])
        return M.upsert_predictions(old, newer)

    return _in_batches(store, arrived, update)


@query("u04_union_of_upsert_halves", UPSERT_SQL)
def upsert_union(spark, sf_dir):
    return M.upsert(*_stored_and_arrived(Tables(spark, sf_dir)), order=["created_at", "probability"])


@query("j08_existence_checks", over("clients", more=UPDATES) + """
SELECT a.user_id, a.created_at, EXISTS (SELECT 1 FROM stored s WHERE s.user_id = a.user_id) AS existe FROM arrived a""")
def existence(spark, sf_dir):
    stored, arrived = _stored_and_arrived(Tables(spark, sf_dir))
    rows = arrived.select("user_id", "created_at")
    there = M.already_in(rows, stored).withColumn("existe", F.lit(True))
    return there.unionByName(M.not_in(rows, stored).withColumn("existe", F.lit(False)))


PEOPLE = """people AS (SELECT d.* FROM demographics d WHERE user_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)
 UNION ALL SELECT 's' || s_suppkey, 40, '150k+', 'moderate', 'SUPPLIER' FROM supplier)"""


CLIENT_UPSERT = over("clients", "demographics", more=PEOPLE) + """
SELECT coalesce(c.user_id, d.user_id) AS user_id, coalesce(d.age, c.age) AS age, coalesce(d.occupation, c.occupation) AS occupation,
 CASE WHEN d.user_id IS NULL THEN c.status ELSE 'pending' END AS status,
 CASE WHEN d.user_id IS NULL THEN c.probability ELSE 0.5 END AS probability,
 CASE WHEN d.user_id IS NULL THEN c.segment ELSE 'potential' END AS segment
FROM clients c FULL JOIN people d ON c.user_id = d.user_id"""


def _people(t):
    seen = table(t.spark, t.sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"))
    suppliers = table(t.spark, t.sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("user_id"), F.lit(40).alias("age"),
        F.lit("150k+").alias("income_range"), F.lit("moderate").alias("risk_profile"), F.lit("SUPPLIER").alias("occupation"))
    return M.already_in(t.demographics, seen).unionByName(suppliers)


@query("s07_client_upsert", CLIENT_UPSERT)
def client_upsert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    merged = M.upsert_clients(t.clients, _people(t), "2024-01-01")
    return merged.select("user_id", "age", "occupation", "status", "probability", "segment")


@query("s07_bucket_merge", CLIENT_UPSERT)
def client_buckets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    store = BU.create(t.clients, scratch(spark), "user_id", 16)
    merged = _in_batches(store, _people(t), lambda old, new: M.upsert_clients(old, new, "2024-01-01"))
    return merged.select("user_id", "age", "occupation", "status", "probability", "segment")


NUMBERED = """loaded AS (SELECT *, row_number() OVER (PARTITION BY user_id, product_type, contract_date ORDER BY 1) AS k FROM products)"""
PRODUCT_ID = "md5(concat_ws('|', user_id, coalesce(product_type, ''), CAST(contract_date AS VARCHAR), CAST(k AS VARCHAR))) AS id"
LOADED = " user_id, product_type, CAST(contract_date AS TIMESTAMP) AS contract_date, 'active' AS status, 1000.0::DOUBLE AS product_value"


@query("s08_loaded_products", over("products", more=NUMBERED) + f"""
SELECT {PRODUCT_ID},{LOADED}, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM loaded""")
def loaded_products(spark, sf_dir):
    return M.load_products(Tables(spark, sf_dir).products, "2024-01-01")


@query("s08_loaded_products_with_repeats", over("products", more=NUMBERED.replace(
    "FROM products", "FROM (SELECT * FROM products UNION ALL SELECT * FROM products)")) + f"""
SELECT {PRODUCT_ID},{LOADED}, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM loaded""")
def repeated_products(spark, sf_dir):
    products = Tables(spark, sf_dir).products
    return M.load_products(products.unionByName(products), "2024-01-01")


@query("s08_upserted_products", over("products", more=NUMBERED) + f"""
SELECT {PRODUCT_ID},{LOADED}, CASE WHEN year(contract_date) < 1998 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS created_at,
 TIMESTAMP '2024-02-01' AS updated_at FROM loaded""")
def upserted_products(spark, sf_dir):
    products = Tables(spark, sf_dir).products
    first = M.load_products(products.where("year(contract_date) < 1998"), "2024-01-01")
    return M.upsert_loaded(first, M.load_products(products, "2024-02-01"))


@query("s08_loaded_transactions", over("transactions") + """
SELECT md5(transaction_id) AS id, user_id, date AS transaction_date, amount, 'payment' AS transaction_type,
 TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM transactions""")
def loaded_transactions(spark, sf_dir):
    return M.load_transactions(Tables(spark, sf_dir).transactions, "2024-01-01")


STATUS = over("clients", "changes", more="""
known AS (SELECT * FROM changes WHERE new_status <> 'archived' AND client_id IN (SELECT id FROM clients)),
latest AS (SELECT client_id, first(new_status ORDER BY changed_at DESC, new_status DESC) AS new_status,
 max(changed_at) AS changed_at FROM known GROUP BY client_id)""")


@query("d11_status_update_clients", STATUS + """
SELECT id, coalesce(new_status, status) AS status, changed_at AS last_contact_date
FROM clients LEFT JOIN latest ON id = client_id""")
def status_clients(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.apply_status_changes(t.clients, t.changes).clients.select("id", "status", "last_contact_date")


@query("d11_bucket_merge", STATUS + """
SELECT id, coalesce(new_status, status) AS status, changed_at AS last_contact_date
FROM clients LEFT JOIN latest ON id = client_id""")
def status_buckets(spark, sf_dir):
    """The changes come in one batch and again; buckets without a change keep their files."""
    t = Tables(spark, sf_dir)
    store = BU.create(t.clients, scratch(spark), "id", 16)
    for batch in ("first", "again"):
        store.merge(t.changes, lambda old, new: M.apply_status_changes(old, new).clients, batch, "client_id")
    return store.read().select("id", "status", "last_contact_date")


@query("d11_status_update_contacts", STATUS + """
SELECT client_id, changed_at AS contacted_at, 'app' AS channel, 'Actualización de estado vía API' AS notes,
 CAST(NULL AS VARCHAR) AS outcome FROM known WHERE new_status = 'contacted'""")
def status_contacts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.apply_status_changes(t.clients, t.changes).new_contacts


@query("d11_status_update_rejected", STATUS + """
SELECT client_id, new_status, changed_at, 'status not allowed' AS reason FROM changes WHERE new_status = 'archived'
UNION ALL SELECT client_id, new_status, changed_at, 'client not found' FROM changes
WHERE new_status <> 'archived' AND client_id NOT IN (SELECT id FROM clients)""")
def status_rejected(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.apply_status_changes(t.clients, t.changes).rejected


@query("s09_score_rows", over("clients") + """
SELECT user_id, round_even(probability * 10000, 0) / 10000 AS t0, CAST(probability >= 0.23885836 AS INTEGER) AS t0b, CAST(0 AS INTEGER) AS t1 FROM clients""")
def score_rows(spark, sf_dir):
    return IO.score_rows(Tables(spark, sf_dir).clients, S.MODEL_THRESHOLD)
