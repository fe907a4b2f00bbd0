"""Board and tournament tables made from the driver's events: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOARDS = """
SELECT event_id, ts AS Date, CAST(CAST(ts AS DATE) AS STRING) || '/' || CAST(user_id % 4 AS STRING) AS session_id,
  CAST(event_id % 3 AS INT) AS Round, CAST(event_id AS INT) AS Board,
  'p' || CAST(user_id % 20 AS STRING) AS Player_ID_N, 'p' || CAST(20 + (user_id + event_id) % 23 AS STRING) AS Player_ID_S,
  'p' || CAST(43 + event_id % 17 AS STRING) AS Player_ID_E,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'p' || CAST(60 + (user_id * 7 + event_id) % 19 AS STRING) END AS Player_ID_W,
  CASE WHEN event_id % 2 = 0 THEN 'Nan ' ELSE 'Ned ' END || CAST(user_id % 20 AS STRING) AS Player_Name_N,
  'Sam ' || CAST((user_id + event_id) % 23 AS STRING) AS Player_Name_S, 'Eve ' || CAST(event_id % 17 AS STRING) AS Player_Name_E,
  'Wim ' || CAST((user_id * 7 + event_id) % 19 AS STRING) AS Player_Name_W,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(user_id % 20 * 137 % 1000 AS DOUBLE) END AS MasterPoints_N,
  CAST((user_id + event_id) % 23 * 91 AS DOUBLE) AS MasterPoints_S, CAST(event_id % 17 * 53 AS DOUBLE) AS MasterPoints_E,
  CAST((user_id * 7 + event_id) % 19 * 29 AS DOUBLE) AS MasterPoints_W,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS Pct_NS,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 211 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(1200 + user_id % 20 * 13 + event_id * 37 % 400 AS DOUBLE) END AS Elo_R_N,
  CAST(1100 + (user_id + event_id) % 23 * 11 + event_id * 41 % 500 AS DOUBLE) AS Elo_R_S,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(1000 + event_id % 17 * 17 + event_id * 43 % 600 AS DOUBLE) END AS Elo_R_E,
  CAST(1300 + (user_id * 7 + event_id) % 19 * 7 + event_id * 47 % 300 AS DOUBLE) AS Elo_R_W,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(1150 + event_id * 53 % 450 AS DOUBLE) END AS Elo_R_NS,
  CAST(1250 + event_id * 59 % 350 AS DOUBLE) AS Elo_R_EW,
  CAST(1195 + event_id * 37 % 400 AS DOUBLE) AS Elo_R_N_Before, CAST(1095 + event_id * 41 % 500 AS DOUBLE) AS Elo_R_S_Before,
  CAST(995 + event_id * 43 % 600 AS DOUBLE) AS Elo_R_E_Before, CAST(1295 + event_id * 47 % 300 AS DOUBLE) AS Elo_R_W_Before,
  CAST(1145 + event_id * 53 % 450 AS DOUBLE) AS Elo_R_NS_Before, CAST(1245 + event_id * 59 % 350 AS DOUBLE) AS Elo_R_EW_Before,
  event_id % 3 = 0 AS Is_Par_Suit, event_id % 5 < 2 AS Is_Par_Contract, event_id % 7 = 0 AS Is_Sacrifice,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id * 31 % 9 - 4 AS DOUBLE) / 2 END AS DD_Tricks_Diff,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'view' THEN TRUE ELSE FALSE END AS is_virtual_game,
  CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN '0-299' WHEN 2 THEN '0-749' ELSE 'other-restricted' END AS strata_bucket
FROM {events}"""

#: Players' numbers in BOARDS, and what they are where players grow with the events: each has a few boards.
MANY = {
    "user_id % 20": "event_id - event_id % 6", "20 + (user_id + event_id) % 23": "event_id - event_id % 7 + 1000000000", "43 + event_id % 17": "event_id - event_id % 5 + 2000000000",
    "60 + (user_id * 7 + event_id) % 19": "event_id - event_id % 8 + 3000000000",
}
MANY_BOARDS = BOARDS
for own, many in MANY.items():
    MANY_BOARDS = MANY_BOARDS.replace(f"'p' || CAST({own} AS STRING)", f"'p' || CAST({many} AS STRING)")

RESULTS = """
SELECT event_id, event_id AS row_seq, CAST(CAST(ts AS DATE) AS STRING) || '-' || CAST(user_id % 3 AS STRING) AS tournament_id,
  'Night ' || CAST(CAST(ts AS DATE) AS STRING) AS tournament_name, CAST(CAST(ts AS DATE) AS STRING) || 'T20:00:00' AS date, CAST(user_id % 3 AS BIGINT) AS series_id,
  'u' || CAST(user_id % 40 AS STRING) AS player1_id, 'u' || CAST(40 + (user_id * 3 + event_id) % 37 AS STRING) AS player2_id,
  'Ann ' || CAST(user_id % 40 AS STRING) AS player1_name, 'Bob ' || CAST((user_id * 3 + event_id) % 37 AS STRING) AS player2_name,
  'u' || CAST(user_id % 40 AS STRING) || '_u' || CAST(40 + (user_id * 3 + event_id) % 37 AS STRING) || '#' || CAST(event_id AS STRING) AS pair_key,
  'u' || CAST(user_id % 40 AS STRING) || '_u' || CAST(40 + (user_id * 3 + event_id) % 37 AS STRING) AS pair_id,
  'Ann ' || CAST(user_id % 40 AS STRING) || ' - Bob ' || CAST((user_id * 3 + event_id) % 37 AS STRING) AS pair_name,
  CAST(30 + event_id * 17 % 400 AS DOUBLE) / 8 AS percentage, CAST(30 + event_id * 17 % 400 AS DOUBLE) / 8 AS scratch_percentage,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(30 + event_id * 17 % 400 AS DOUBLE) / 8 + event_id % 8 END AS handicap_percentage,
  CAST(event_id % 8 AS DOUBLE) AS iv_bonus, CAST(event_id * 7 % 60 AS BIGINT) AS "rank", 'Club ' || CAST(event_id % 6 AS STRING) AS club_name,
  CAST(1900 + event_id * 29 % 700 AS DOUBLE) AS player1_scratch_elo_before, CAST(1910 + event_id * 29 % 700 AS DOUBLE) AS player1_scratch_elo_after,
  CAST(1800 + event_id * 31 % 800 AS DOUBLE) AS player1_handicap_elo_before, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1815 + event_id * 31 % 800 AS DOUBLE) END AS player1_handicap_elo_after,
  CAST(1700 + event_id * 37 % 900 AS DOUBLE) AS player2_scratch_elo_before, CAST(1690 + event_id * 37 % 900 AS DOUBLE) AS player2_scratch_elo_after,
  CAST(1600 + event_id * 41 % 1000 AS DOUBLE) AS player2_handicap_elo_before, CAST(1620 + event_id * 41 % 1000 AS DOUBLE) AS player2_handicap_elo_after,
  CAST(1805 + event_id * 43 % 800 AS DOUBLE) AS scratch_pair_elo, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1755 + event_id * 47 % 850 AS DOUBLE) END AS handicap_pair_elo,
  CAST(1805 + event_id * 43 % 800 AS DOUBLE) AS pair_elo
FROM {events}"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOARDS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def many_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANY_BOARDS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tournament ids that tell each result apart in time: date, tournament, and pair key."""
    return spark.sql(RESULTS.replace('"rank"', "rank"), events=spark.read.parquet(f"{sf_dir}/events.parquet")).drop("pair_key")


def sql(view: str) -> str:
    return view.format(events="events")
