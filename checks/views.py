"""Input views over the given tables, one text for Spark SQL and DuckDB.

Every view reads its tables whole.  Only values are made up from the keys, so
that the awkward spellings occur; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PARTICIPANT = """
       CAST(CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS STRING)
         || CASE WHEN c_custkey % 3 = 0 THEN '.0' ELSE '' END AS id,
       c_mktsegment AS school,
       'Ana' || CAST(c_custkey % 17 AS STRING) AS adult_name,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'Soto' || CAST(c_custkey % 23 AS STRING) END AS adult_surname,
       CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '12345' ELSE
       CASE c_custkey % 4
         WHEN 0 THEN '+56 9 ' || lpad(CAST(c_custkey AS STRING), 8, '0')
         WHEN 1 THEN '569' || lpad(CAST(c_custkey AS STRING), 8, '0') || '.0'
         WHEN 2 THEN '9' || lpad(CAST(c_custkey AS STRING), 8, '0')
         ELSE '(56) 9-' || lpad(CAST(c_custkey AS STRING), 8, '0') END END AS phone,
       CASE c_custkey % 12
         WHEN 1 THEN 'No tiene tiempo' WHEN 2 THEN 'Error app' WHEN 3 THEN 'Falso completado'
         WHEN 4 THEN ' DESISTE ' WHEN 5 THEN NULL WHEN 6 THEN 'no completado'
         WHEN 7 THEN 'Trabaja mucho' ELSE 'Notificado' END AS state,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            WHEN c_custkey % 2 = 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 31 AS STRING), 2, '0')
            ELSE lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/12/2023 08:30:00' END AS enrolled_at,
       CASE WHEN c_custkey % 37 = 0 THEN 'pendiente'
            WHEN c_custkey % 13 = 0 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '-12-2023'
            WHEN c_custkey % 8 = 0 THEN '2024-01-20 09:00:00' END AS first_log_at,
       CASE WHEN c_custkey % 21 = 0 THEN '2024-01-10T08:00:00.500' END AS last_used_at,
       CASE c_custkey % 10 WHEN 0 THEN '12' WHEN 1 THEN '1900-01-05' WHEN 2 THEN '3.7' WHEN 3 THEN 'nan' END AS days_since_use,
       CASE WHEN c_custkey % 14 = 0 THEN '15/01/2024 10:00:00' END AS finished_at,
       CASE WHEN c_custkey % 11 = 0 THEN 'L1B2S1_3' WHEN c_custkey % 37 = 0 THEN 'L1B3S4' END AS current_screen,
       CASE c_custkey % 6 WHEN 0 THEN '31.25' WHEN 1 THEN 'nan' WHEN 2 THEN '6.25' END AS progress_pct,
       CASE WHEN c_custkey % 29 = 0 THEN 'True' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'False' END AS completed,
       CASE WHEN c_custkey % 16 = 0 THEN 'llamar' END AS comments"""

_DAY = "substr(t, 9, 2)"
_MONTH = "substr(t, 6, 2)"
_YEAR = "substr(t, 1, 4)"
_TIME = "substr(t, 12, 8)"
_DATE = "substr(t, 1, 10)"

VIEWS = {
    "fx_participants": f"SELECT c_custkey AS row_no, {_PARTICIPANT} FROM {{customer}}",
    # The roster before processing: some ids unknown, some cells different, and
    # later rows that repeat the ids of earlier ones.
    "fx_original": f"""
SELECT row_no, CASE WHEN row_no % 10 = 9 THEN 'N' || id ELSE id END AS id,
       CASE WHEN row_no % 10 = 8 THEN 'OTHER' ELSE school END AS school,
       adult_name, adult_surname, phone,
       CASE WHEN row_no % 15 = 0 THEN NULL ELSE state END AS state,
       enrolled_at, first_log_at, last_used_at, days_since_use, finished_at, current_screen, progress_pct, completed, comments
FROM (SELECT c_custkey AS row_no, {_PARTICIPANT} FROM {{customer}}) p
UNION ALL
SELECT 1000000000000 + s_suppkey, CAST(s_suppkey AS STRING), 'REPEATED', s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       NULL, NULL, NULL, NULL
FROM {{supplier}}""",
    # Customers are on the roster, suppliers are not; two suppliers share an id.
    "fx_contacts": """
SELECT c_custkey AS row_no, CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '.0' ELSE '' END AS id,
       c_mktsegment AS school,
       'Ana' || CAST(c_custkey % 17 AS STRING) AS adult_name_1, 'Soto' AS adult_name_2, 'Rey' AS adult_name_3,
       'Leo' AS child_name_1, 'Soto' AS child_name_2, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Paz' END AS child_name_3,
       '9' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone,
       CASE c_custkey % 5 WHEN 0 THEN 'Participante' WHEN 1 THEN ' participante ' WHEN 2 THEN 'contactado'
         WHEN 3 THEN NULL ELSE 'PARTICIPANTE' END AS contact_state
FROM {customer}
UNION ALL
SELECT 1000000000000 + s_suppkey, ' S' || CAST(s_suppkey - s_suppkey % 2 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '.0' ELSE '' END,
       'REGION ' || CAST(s_nationkey AS STRING), s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Vera' END, 'Lagos',
       'Eva', NULL, 'Sol', CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '8' || lpad(CAST(s_suppkey AS STRING), 8, '0') END,
       CASE s_suppkey % 4 WHEN 0 THEN 'Participante' WHEN 1 THEN ' PARTICIPANTE ' WHEN 2 THEN 'participante' ELSE 'contactado' END
FROM {supplier}""",
    "fx_logs": f"""
SELECT event_id,
       CASE WHEN event_id % 101 = 0 THEN '12345'
            WHEN event_id % 3 = 0 THEN '+56 9 ' || lpad(CAST(user_id AS STRING), 8, '0')
            WHEN event_id % 3 = 1 THEN '569' || lpad(CAST(user_id AS STRING), 8, '0') || '.0'
            ELSE '9' || lpad(CAST(user_id AS STRING), 8, '0') END AS phone,
       CASE event_id % 7
         WHEN 0 THEN {_DATE} || 'T' || {_TIME} || '.250'
         WHEN 1 THEN {_DATE} || 'T' || {_TIME}
         WHEN 2 THEN t || ':250'
         WHEN 3 THEN t
         WHEN 4 THEN {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} || ' ' || {_TIME}
         WHEN 5 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} || ' ' || {_TIME}
         ELSE CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE t END END AS entered_at,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'X9Z9' WHEN event_id % 83 = 0 THEN 'L1B1S0' ELSE
       CASE k WHEN 0 THEN 'L1B1S0_15' WHEN 1 THEN 'L1B2S1_3' WHEN 2 THEN 'L1B3S1_33' WHEN 3 THEN 'L1B2S2_3'
              WHEN 4 THEN 'L1B3S2_9' WHEN 5 THEN 'L1B2S3_3' WHEN 6 THEN 'L1B3S3_15' WHEN 7 THEN 'L1B3S4_14'
              WHEN 8 THEN 'L2B1S0_14' WHEN 9 THEN 'L2B2S1_3' WHEN 10 THEN 'L2B3S1_33' WHEN 11 THEN 'L2B2S2_3'
              WHEN 12 THEN 'L2B3S2_9' WHEN 13 THEN 'L2B2S3_3' WHEN 14 THEN 'L2B3S3_15' ELSE 'L2B3S4_15' END END AS screen,
       CASE WHEN event_id % 53 = 0 THEN NULL ELSE
       CASE event_type WHEN 'error' THEN 'SYSTEM ALERT ' || CAST(event_id AS STRING)
                       WHEN 'signup' THEN 'ENVÍO de Notificación por inactividad' ELSE 'Uso ' || event_type END END AS entry
FROM (SELECT event_id, user_id, event_type, substr(CAST(ts AS STRING), 1, 19) AS t,
             CASE WHEN event_id % 16 < user_id % 17 THEN event_id % 16 ELSE user_id % 17 END AS k FROM {{events}}) s""",
    # One text per event, in all accepted spellings of a time and some others.
    "fx_texts": f"""
SELECT event_id,
       CASE event_id % 37
         WHEN 0 THEN {_DATE} || 'T' || {_TIME} || '.250'
         WHEN 1 THEN {_DATE} || 'T' || {_TIME}
         WHEN 2 THEN t || ':250'
         WHEN 3 THEN t
         WHEN 4 THEN {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} || ' ' || {_TIME}
         WHEN 5 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} || ' ' || {_TIME}
         WHEN 6 THEN {_DATE}
         WHEN 7 THEN {_DAY} || '-' || {_MONTH} || '-' || {_YEAR}
         WHEN 8 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR}
         WHEN 9 THEN t || '.123'
         WHEN 10 THEN substr(t, 1, 16)
         WHEN 11 THEN {_DATE} || 'T' || substr(t, 12, 5)
         WHEN 12 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} || ' ' || substr(t, 12, 5)
         WHEN 13 THEN {_DAY} || '-' || {_MONTH} || '-' || substr(t, 3, 2)
         WHEN 14 THEN {_YEAR} || '/' || {_MONTH} || '/' || {_DAY} || ' ' || {_TIME}
         WHEN 15 THEN {_YEAR} || '/' || {_MONTH} || '/' || {_DAY}
         WHEN 16 THEN {_DAY} || '.' || {_MONTH} || '.' || {_YEAR}
         WHEN 17 THEN {_YEAR} || {_MONTH} || {_DAY}
         WHEN 18 THEN substr(t, 1, 7)
         WHEN 19 THEN {_MONTH} || '/' || {_YEAR}
         WHEN 20 THEN {_YEAR}
         WHEN 21 THEN {_MONTH} || '-' || {_DAY} || '-' || {_YEAR} || ' ' || {_TIME}
         WHEN 22 THEN {_MONTH} || '/' || {_DAY} || '/' || {_YEAR}
         WHEN 23 THEN {_YEAR} || '-' || {_DAY} || '-' || {_MONTH}
         WHEN 24 THEN '30-02-2024'
         WHEN 25 THEN t || 'Z'
         WHEN 26 THEN ' NaN '
         WHEN 27 THEN '  ' || t || ' '
         WHEN 28 THEN {_DATE} || '   ' || {_TIME}
         WHEN 29 THEN ''
         WHEN 30 THEN NULL
         WHEN 31 THEN 'sin dato'
         WHEN 32 THEN CAST(1 + event_id % 9 AS STRING) || '/' || CAST(1 + event_id % 7 AS STRING) || '/' || {_YEAR}
         WHEN 33 THEN '1600' || substr(t, 5, 15)
         WHEN 34 THEN 'None'
         WHEN 35 THEN {_DATE} || ' 24:00:00'
         ELSE {_DAY} || '/' || {_MONTH} || '/' || substr(t, 3, 2) END AS text
FROM (SELECT event_id, substr(CAST(ts AS STRING), 1, 19) AS t FROM {{events}}) s""",
    # One number-like text per event.
    "fx_numbers": """
SELECT event_id,
       CASE event_id % 23
         WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN CAST(event_id AS STRING) || '.0'
         WHEN 2 THEN '-' || CAST(event_id AS STRING) || '.75' WHEN 3 THEN '1e3' WHEN 4 THEN 'nan' WHEN 5 THEN ' '
         WHEN 6 THEN 'abc' WHEN 7 THEN '1900-01-05' WHEN 8 THEN '1900-02-10 00:00:00' WHEN 9 THEN '05-01-1900'
         WHEN 10 THEN '06-03-1900 10:30:00' WHEN 11 THEN 'inf' WHEN 12 THEN '2024-01-05' WHEN 13 THEN ' 7.9 '
         WHEN 14 THEN NULL WHEN 15 THEN '5d' WHEN 16 THEN '1_000' WHEN 17 THEN '+4' WHEN 18 THEN '.5'
         WHEN 19 THEN '1e300' WHEN 20 THEN '05/01/1900' WHEN 21 THEN '1900-02-30' ELSE '3.' END AS text
FROM {events}""",
    # Pairs of cells for the comparison.
    "fx_pairs": """
SELECT event_id,
       CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN NULL WHEN 3 THEN '12.0' WHEN 4 THEN 'True'
         WHEN 5 THEN 'False' WHEN 6 THEN '2024-01-20 09:00:00' WHEN 7 THEN '2024-01-20T09:00:00.250' WHEN 8 THEN ' Hola '
         WHEN 9 THEN '1.05' WHEN 10 THEN 'casa.0' WHEN 11 THEN 'TRUE' WHEN 12 THEN '20/01/2024' WHEN 13 THEN '2024-01-20'
         WHEN 14 THEN 'x' || CAST(event_id AS STRING) WHEN 15 THEN '1e2' WHEN 16 THEN '0' WHEN 17 THEN '2024'
         WHEN 18 THEN CAST(event_id AS STRING) ELSE substr(CAST(ts AS STRING), 1, 19) END AS a,
       CASE event_id % 20 WHEN 0 THEN ' NaT ' WHEN 1 THEN '' WHEN 2 THEN '5' WHEN 3 THEN '12' WHEN 4 THEN '1'
         WHEN 5 THEN '0.0' WHEN 6 THEN '20-01-2024 09:00:00' WHEN 7 THEN '2024-01-20 09:00:00' WHEN 8 THEN 'hola'
         WHEN 9 THEN '15' WHEN 10 THEN 'CASA' WHEN 11 THEN 'false' WHEN 12 THEN '2024-01-20 00:00:00' WHEN 13 THEN '21/01/2024'
         WHEN 14 THEN 'X' || CAST(event_id AS STRING) || '.0' WHEN 15 THEN '100' WHEN 16 THEN 'no' WHEN 17 THEN '2025'
         WHEN 18 THEN CAST(event_id + event_id % 3 AS STRING) || '.0' ELSE substr(CAST(ts AS STRING), 1, 10) END AS b
FROM {events}""",
    "fx_comments": """
SELECT CAST(user_id AS STRING) AS id, 'nota ' || CAST(event_id AS STRING) AS comment, ts AS updated_at FROM {events}
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING) || '.0', 'sin participante', TIMESTAMP_NTZ '2024-01-15 00:00:00' FROM {supplier}""",
    "fx_state_old": """
SELECT 'k' || CAST(o_custkey AS STRING) AS key, CAST(o_orderdate AS STRING) || o_orderstatus AS content, o_orderdate AS updated_at
FROM {orders}""",
    "fx_state_new": """
SELECT 'k' || CAST(user_id AS STRING) AS key, props AS content, ts AS updated_at FROM {events}""",
}

# Columns of the given tables; stated, so that no file is opened to find them.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a Spark table."""
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def view_sql(name: str) -> str:
    """A view as DuckDB text over the registered tables."""
    text = VIEWS[name].replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    return text.format(**{t: t for t in TABLES})
