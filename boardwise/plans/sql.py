"""DuckDB SQL that gives the same rows as the queries of this package, written apart from them."""

from __future__ import annotations

import datetime as dt
import re

from . import views

_B, _R = views.sql(views.BOARDS), views.sql(views.RESULTS)
_VALID = "(Pct_NS IS NULL OR (Pct_NS >= 0 AND Pct_NS <= 1))"
_BANDS = ["SGM", "GM", "IM", "FM", "CM", "Expert", "Advanced", "Intermediate", "Novice"]
_LEAST = [2600, 2500, 2400, 2300, 2200, 2000, 1800, 1600, 1400]


def _title(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {n} THEN '{t}'" for n, t in zip(_LEAST, _BANDS)) + " ELSE 'Beginner' END"


def _title_no(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 10 " + " ".join(f"WHEN {x} >= {n} THEN {i}" for i, n in enumerate(_LEAST, 1)) + " ELSE 10 END"


def _int(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


def _chess(x: str, m: str = "m", s: str = "s") -> str:
    return f"CAST(CASE WHEN {s} IS NULL OR {s} <= 0 THEN 1500 ELSE least(greatest(round(1500.0 + (CAST({x} AS DOUBLE) - {m}) / {s} * 400.0), 0.0), 3500.0) END AS INTEGER)"


def _show(x: str) -> str:
    return f"CAST(round(least(greatest({x}, 0.0), 3500.0)) AS INTEGER)"


def _shrunk(x: str, n: str, anchor: str, prior: float) -> str:
    return f"(CAST({n} AS DOUBLE) * {x} + {prior:.1f}::DOUBLE * {anchor}) / ({n} + {prior:.1f}::DOUBLE)"


_r6 = lambda x: f"round(({x}) * 1000000.0) / 1000000.0"
_fix = lambda x, n: f"(round(({x}) * {10 ** n}::DOUBLE) / {10 ** n}::DOUBLE + 0.0::DOUBLE)"  # no negative zero
_r9 = lambda x: f"round(({x}) * 1000000000::DOUBLE)"

_mean = lambda x, n: _fix(f"round(avg({x}) * 1000000000::DOUBLE) / 1000000000::DOUBLE", n)

_SEATS = " UNION ALL ".join(
    f"SELECT Date, session_id, Round, Board, Is_Par_Suit, Is_Par_Contract, Is_Sacrifice, DD_Tricks_Diff, Player_ID_{p} AS id, Player_Name_{p} AS name, MasterPoints_{p} AS mp, Elo_R_{p} AS elo FROM b WHERE Player_ID_{p} IS NOT NULL AND Elo_R_{p} IS NOT NULL AND NOT isnan(Elo_R_{p})"
    for p in "NESW"
)
_SIDES = " UNION ALL ".join(
    f"""SELECT Date, session_id, Round, Board, Is_Par_Suit, Is_Par_Contract, Is_Sacrifice, DD_Tricks_Diff, CASE WHEN Player_ID_{p} < Player_ID_{q} THEN Player_ID_{p} || '-' || Player_ID_{q} ELSE Player_ID_{q} || '-' || Player_ID_{p} END AS id,
    CASE WHEN Player_ID_{p} <= Player_ID_{q} THEN Player_Name_{p} || ' - ' || Player_Name_{q} ELSE Player_Name_{q} || ' - ' || Player_Name_{p} END AS name,
    Elo_R_{p}{q} AS elo, (coalesce(MasterPoints_{p}, 0) + coalesce(MasterPoints_{q}, 0)) / 2.0 AS mp, sqrt(coalesce(MasterPoints_{p}, 0) * coalesce(MasterPoints_{q}, 0)) AS geo,
    CASE WHEN Elo_R_{p} IS NOT NULL AND Elo_R_{q} IS NOT NULL AND NOT isnan(Elo_R_{p}) AND NOT isnan(Elo_R_{q}) THEN (Elo_R_{p} + Elo_R_{q}) / 2.0 END AS seat_elo FROM b WHERE Elo_R_{p}{q} IS NOT NULL AND NOT isnan(Elo_R_{p}{q})"""
    for p, q in ("NS", "EW")
)


def _last(x: str, table: str = "x", order: str = "Date DESC NULLS FIRST, session_id DESC NULLS FIRST, Round DESC NULLS FIRST, Board DESC NULLS FIRST") -> str:
    return f"first({x} ORDER BY {order})"


def _pool(rows: str, least: int, prior: int, extra: str, tie: str) -> str:
    """CTEs up to p (pool with all ranks and scales), from b (boards)."""
    return f"""x AS ({rows}), g AS (SELECT id, {_last('name')} AS name, {_last('elo')} AS elo, count(DISTINCT session_id) AS n, {extra},
        avg(CAST(Is_Par_Suit AS INT)) AS suit, avg(CAST(Is_Par_Contract AS INT)) AS contract, avg(CAST(Is_Sacrifice AS INT)) AS sac, avg(DD_Tricks_Diff) AS dd FROM x GROUP BY id HAVING count(DISTINCT session_id) >= {least}),
    h AS (SELECT *, {_int('coalesce(elo, 0)')} AS raw, {_int('coalesce(' + _shrunk('elo', 'n', '1400.0::DOUBLE', prior) + ', 0)')} AS pub FROM g),
    r AS (SELECT *, row_number() OVER (ORDER BY pub DESC, mp DESC NULLS LAST, {tie}) AS pool_rank, rank() OVER (ORDER BY {_r9('suit')} DESC NULLS LAST) AS suit_rank, rank() OVER (ORDER BY {_r9('contract')} DESC NULLS LAST) AS contract_rank,
        rank() OVER (ORDER BY {_r9('sac')} DESC NULLS LAST) AS sac_rank, rank() OVER (ORDER BY {_r9('dd')} DESC NULLS LAST) AS dd_rank, rank() OVER (ORDER BY {_r9('mp')} DESC NULLS LAST) AS mp_rank FROM h),
    st AS (SELECT avg(CAST(pub AS DOUBLE)) AS m, stddev_pop(CAST(pub AS DOUBLE)) AS s, avg(suit) AS m1, stddev_pop(suit) AS s1, avg(contract) AS m2, stddev_pop(contract) AS s2, avg(dd) AS m3, stddev_pop(dd) AS s3 FROM h),
    z AS (SELECT *, rank() OVER (ORDER BY (pool_rank + suit_rank + contract_rank + dd_rank) / 4.0) AS quality, ((suit - m1) / nullif(s1, 0) + (contract - m2) / nullif(s2, 0) + (dd - m3) / nullif(s3, 0)) / 3.0 AS skill, {_chess('pub')} AS score, {_chess('raw')} AS raw_score FROM r, st),
    p AS (SELECT *, CAST(row_number() OVER (ORDER BY pool_rank) AS INT) AS place FROM z WHERE skill >= -0.5)"""


_RATES = f"""CAST(quality AS INT) AS Quality_Rank, {_fix('suit * 100', 1)} AS Par_Suit_Rate_Pct, CAST(suit_rank AS INT) AS Par_Suit_Rank, {_fix('contract * 100', 1)} AS Par_Contract_Rate_Pct, CAST(contract_rank AS INT) AS Par_Contract_Rank,
    {_fix('sac * 100', 1)} AS Sacrifice_Rate_Pct, CAST(sac_rank AS INT) AS Sacrifice_Rank, {_fix('dd', 2)} AS DD_Tricks_Diff_Avg, CAST(dd_rank AS INT) AS DD_Tricks_Diff_Rank"""
_PLAYER_POOL = _pool(_SEATS, 3, 50, "max(mp) AS mp", "id")


def _history(parts: str, cols: list[str]) -> str:
    stats = " UNION ALL ".join(f"SELECT {c} AS v FROM b" for c in cols)
    scale = lambda c: f"CAST(round(least(greatest(1500.0 + ({c} - m) / s * 400.0, 0.0), 3500.0)) AS INTEGER)"
    return f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID}), x AS ({parts}), st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM ({stats}) WHERE v IS NOT NULL AND NOT isnan(v)),
    h AS (SELECT * EXCLUDE (eb, ea), CASE WHEN eb IS NOT NULL THEN {scale('eb')} END AS Elo_Before, {scale('ea')} AS Elo_After FROM x, st) """


def _player(pid: str) -> str:
    parts = []
    for side, other in (("NS", "EW"), ("EW", "NS")):
        for p, q in (side, side[::-1]):
            pct = "Pct_NS * 100" if side == "NS" else "(1 - Pct_NS) * 100"
            parts.append(f"SELECT Date, session_id AS Session, Round, Board, '{p}' AS Seat, Player_Name_{q} AS Partner, Player_Name_{other[0]} || ' - ' || Player_Name_{other[1]} AS Opponents, {_fix(pct, 1)} AS Pct, Elo_R_{p}_Before AS eb, Elo_R_{p} AS ea FROM b WHERE Player_ID_{p} = '{pid}' AND Elo_R_{p} IS NOT NULL AND NOT isnan(Elo_R_{p})")
    return _history(" UNION ALL ".join(parts), [f"Elo_R_{p}" for p in "NESW"])


def _pair(a: str, c: str) -> str:
    parts = []
    for (p, q), other in (("NS", "EW"), ("EW", "NS")):
        pct = "Pct_NS * 100" if p == "N" else "(1 - Pct_NS) * 100"
        parts.append(f"SELECT Date, session_id AS Session, Board, '{p}{q}' AS Side, Player_Name_{other[0]} || ' - ' || Player_Name_{other[1]} AS Opponents, {_fix(pct, 1)} AS Pct, Elo_R_{p}{q}_Before AS eb, Elo_R_{p}{q} AS ea FROM b WHERE ((Player_ID_{p} = '{a}' AND Player_ID_{q} = '{c}') OR (Player_ID_{p} = '{c}' AND Player_ID_{q} = '{a}')) AND Elo_R_{p}{q} IS NOT NULL AND NOT isnan(Elo_R_{p}{q})")
    return _history(" UNION ALL ".join(parts), ["Elo_R_NS", "Elo_R_EW"])


def _known(x: str) -> str:
    return f"arg_max({x}, (date, tournament_id, row_seq))"


def _people(handicap: bool) -> str:
    t = "handicap" if handicap else "scratch"
    pct = "coalesce(handicap_percentage, scratch_percentage)" if handicap else "scratch_percentage"
    rows = " UNION ALL ".join(f"SELECT date, tournament_id, row_seq, player{i}_id AS player_id, player{i}_name AS player_name, player{i}_scratch_elo_after AS s, player{i}_handicap_elo_after AS h, player{i}_{t}_elo_after AS e, scratch_percentage, handicap_percentage, iv_bonus FROM res" for i in (1, 2))
    return f"""res AS ({_R}), long AS ({rows}), people AS (SELECT player_id, {_known('player_name')} AS player_name, {_fix(_known('s'), 1)} AS scratch_elo, {_fix(_known('coalesce(h, s)'), 1)} AS handicap_elo, {_fix(_known('e'), 1)} AS elo_rating, count(*) AS games_played,
        {_fix('avg(scratch_percentage)', 2)} AS avg_scratch_pct, {_fix('avg(coalesce(handicap_percentage, scratch_percentage))', 2)} AS avg_handicap_pct, {_fix('avg(iv_bonus)', 1)} AS avg_iv_bonus, {_fix(f'avg({pct})', 2)} AS avg_percentage, {_fix(f'stddev_samp({pct})', 2)} AS stdev_percentage FROM long GROUP BY player_id)"""


_SHOWN = f"{_fix('avg_scratch_pct', 1)} AS Avg_Scratch, {_fix('avg_handicap_pct', 1)} AS Avg_Handicap, {_fix('avg_iv_bonus', 1)} AS Avg_IV_Bonus, {_fix('stdev_percentage', 1)} AS Pct_Stdev, CAST(games_played AS INT) AS Games"


def _pairs(handicap: bool, least: int) -> str:
    elo = "handicap_pair_elo" if handicap else "scratch_pair_elo"
    pct = "coalesce(handicap_percentage, scratch_percentage)" if handicap else "scratch_percentage"
    return f"""pairs AS (SELECT pair_id, {_known('pair_name')} AS pair_name, {_known('player1_id')} AS p1, {_known('player2_id')} AS p2, {_known('scratch_pair_elo')} AS scratch, {_known(elo)} AS elo, avg(scratch_percentage) AS avg_scratch_pct,
        avg(coalesce(handicap_percentage, scratch_percentage)) AS avg_handicap_pct, avg(iv_bonus) AS avg_iv_bonus, stddev_samp({pct}) AS stdev_percentage, count(*) AS games_played FROM res GROUP BY pair_id HAVING count(*) >= {least}),
    an AS (SELECT median(elo) AS a, median(scratch) AS sa FROM pairs)"""


_MINE = "(player1_id = 'u7' OR player2_id = 'u7')"
_OTHERS = f"FROM res WHERE NOT {_MINE} AND tournament_id IN (SELECT tournament_id FROM res WHERE {_MINE})"
_U50 = f"""WITH res AS ({_R}), h AS (SELECT substr(date, 1, 10) AS Date, tournament_id AS Event_ID, row_seq AS Seq, pair_name AS Partner, club_name AS Club, {_fix('scratch_percentage', 2)} AS Pct_Used, CAST("rank" AS INT) AS Rank,
    CAST(round(CASE WHEN player1_id = 'u50' THEN player1_scratch_elo_before ELSE player2_scratch_elo_before END) AS INT) AS Elo_Before, CAST(round(CASE WHEN player1_id = 'u50' THEN player1_scratch_elo_after ELSE player2_scratch_elo_after END) AS INT) AS Elo_After
    FROM res WHERE player1_id = 'u50' OR player2_id = 'u50')"""


def _ago(days: int) -> str:
    return str(dt.date(1998, 3, 1) - dt.timedelta(days=days))


def _elo_fold(pool: str, tail: str, pct: str = "scratch_percentage") -> str:
    """The fold as a recursion over a pool's rows: ratings by player in two maps, and the fields' means at a session's start."""
    scale = lambda f: f"CASE WHEN {f} >= 1200 THEN 1.0 ELSE greatest(0.7, 0.7 + 0.3 * (({f} - 1200) / 6.0 + 2) / 2) END"
    step = lambda x, p, f: f"{x} + 32 * ({scale(f)}) * ({p} / 100 - 1 / (1 + pow(10.0, least(greatest(({f} - {x}) / 400.0, -10.0), 10.0))))"
    mean = lambda m: f"list_avg(list_transform(r.pairs, lambda x: (coalesce({m}[x.a], 1200) + coalesce({m}[x.b], 1200)) / 2))"
    shown = lambda x: f"round_even(least(greatest(least(greatest({x}, -1000.0), 10000.0) * 2.0, 0.0), 3500.0), 1)"
    return f"""WITH RECURSIVE res AS ({_R}), r0 AS (SELECT {pool} AS pool, event_id, date, tournament_id, row_seq, player1_id AS a, player2_id AS b, {pct} AS sp, handicap_percentage AS hp,
        row_number() OVER (PARTITION BY {pool} ORDER BY date, tournament_id, row_seq) AS i, row_number() OVER (PARTITION BY {pool}, date, tournament_id ORDER BY row_seq) AS k FROM res),
    sessions AS (SELECT pool, date, tournament_id, list({{'a': a, 'b': b}} ORDER BY row_seq) AS pairs FROM r0 GROUP BY ALL),
    r AS (SELECT r0.*, sessions.pairs FROM r0 LEFT JOIN sessions ON r0.k = 1 AND r0.pool = sessions.pool AND r0.date = sessions.date AND r0.tournament_id = sessions.tournament_id),
    f AS (SELECT DISTINCT pool, 0::BIGINT AS i, MAP {{}}::MAP(VARCHAR, DOUBLE) AS s, MAP {{}}::MAP(VARCHAR, DOUBLE) AS h, 0::DOUBLE AS fs, 0::DOUBLE AS fh, [0::DOUBLE] AS v FROM r0 UNION ALL
      SELECT pool, i, map_concat(s, MAP {{a: v[5], b: v[6]}}), map_concat(h, MAP {{a: v[7], b: v[8]}}), fs, fh, v FROM (
        SELECT pool, i, s, h, fs, fh, a, b, [s1, s2, h1, h2, {step('s1', 'sp', 'fs')}, {step('s2', 'sp', 'fs')}, {step('h1', 'coalesce(hp, sp)', 'ft')}, {step('h2', 'coalesce(hp, sp)', 'ft')}] AS v FROM (
          SELECT *, CASE WHEN hp IS NULL THEN fs ELSE fh END AS ft, coalesce(s[a], 1200) AS s1, coalesce(s[b], 1200) AS s2, coalesce(h[a], 1200) AS h1, coalesce(h[b], 1200) AS h2 FROM (
            SELECT f.pool, r.i, f.s, f.h, r.a, r.b, r.sp, r.hp, CASE WHEN r.pairs IS NULL THEN f.fs ELSE {mean('f.s')} END AS fs, CASE WHEN r.pairs IS NULL THEN f.fh ELSE {mean('f.h')} END AS fh FROM f JOIN r ON r.pool = f.pool AND r.i = f.i + 1)))),
    rated AS (SELECT r.event_id, r.date, r.tournament_id, r.row_seq, r.a, r.b, r.sp AS scratch_percentage, f.fs AS scratch_field_avg, f.fh AS handicap_field_avg, {scale('f.fs')} AS scratch_field_strength, {scale('f.fh')} AS handicap_field_strength,
      {shown('v[1]')} AS player1_scratch_elo_before, {shown('v[5]')} AS player1_scratch_elo_after, {shown('v[2]')} AS player2_scratch_elo_before, {shown('v[6]')} AS player2_scratch_elo_after, {shown('v[7]')} AS player1_handicap_elo_after, {shown('v[8]')} AS player2_handicap_elo_after,
      {shown('(v[5] + v[6]) / 2')} AS scratch_pair_elo, {shown('(v[7] + v[8]) / 2')} AS handicap_pair_elo FROM f JOIN r USING (pool, i)) {tail}"""


def _moments() -> str:
    """The ten best of each entity by each moment's columns, in place of those of the current rating."""
    out = []
    moments = {"Current Rating (End of Session)": "{0}", "Rating at Start of Session": "{0}_Before", "Rating at Event Start": "({0} - 3.0::DOUBLE)", "Rating at Event End": "({0} + 5.0::DOUBLE)"}
    side = {k: v for k, v in moments.items()} | {"Expected Rating": "({0} * 0.5::DOUBLE + 700.0::DOUBLE)"}
    for entity, rows, tie, extra in (("Players", _SEATS, "id", "max(mp) AS mp"), ("Pairs", _SIDES, "id NULLS LAST", "avg(mp) AS mp")):
        for moment, form in (moments if entity == "Players" else side).items():
            own = rows
            for c in ("NS", "EW") if entity == "Pairs" else "NESW":
                own = re.sub(rf"\bElo_R_{c}\b", form.format(f"Elo_R_{c}"), own)
            out.append(f"SELECT * FROM (WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID}), {_pool(own, 3, 50, extra, tie)} SELECT '{moment}' AS moment, '{entity}' AS entity, place, id, score FROM p ORDER BY place LIMIT 10)")
    return " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    prior = _shrunk("coalesce({0}.scratch_elo, 0)", "coalesce({0}.games_played, 0)", "pa", 10)
    fold_sql = _elo_fold("series_id", f"SELECT event_id, {', '.join(f'{_r6(c)} AS {c}' for c in ['scratch_field_avg', 'handicap_field_avg', 'scratch_field_strength', 'handicap_field_strength', 'player1_scratch_elo_before', 'player1_scratch_elo_after', 'player2_handicap_elo_after', 'scratch_pair_elo', 'handicap_pair_elo'])} FROM rated")
    lines = "WITH l AS (SELECT l_orderkey || '/' || l_linenumber AS line, CASE WHEN l_linenumber <> 5 THEN max(CAST(l_quantity AS DOUBLE)) END AS quantity, max(CAST(l_extendedprice AS DOUBLE)) AS price, min(CAST(l_discount AS DOUBLE)) AS discount FROM lineitem GROUP BY l_orderkey, l_linenumber)"
    codes = "CAST(event_id % 9 AS STRING)"
    bands = [0, 5, 20, 50, 100, 200, 300, 500, 750, 1000, 1500, 2500, 3500, 5000, 7500, 10000]
    band = "CASE " + " ".join(f"WHEN c_acctbal >= {a} AND c_acctbal < {b} THEN '{a}-{b}'" for a, b in zip(bands, bands[1:])) + " WHEN c_acctbal >= 10000 THEN '10000+' END"
    plain = {
        "leaderboard_players": f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID}), {_PLAYER_POOL}
            SELECT place AS Player_Elo_Rank, score AS Player_Elo_Score, raw_score AS Player_Elo_Raw, score AS Player_Elo_Published, {_title('score')} AS Title, {_fix('skill', 3)} AS Skill_Z, id AS Player_ID, name AS Player_Name, {_int('mp')} AS MasterPoints,
            CAST(mp_rank AS INT) AS MasterPoint_Rank, CAST(n AS INT) AS Sessions_Played, {_RATES} FROM p ORDER BY place LIMIT 60""",
        "leaderboard_many_players": f"""WITH b AS (SELECT * FROM ({views.sql(views.MANY_BOARDS)}) WHERE {_VALID}), {_pool(_SEATS, 2, 50, "max(mp) AS mp", "id")}
            SELECT place AS Player_Elo_Rank, score AS Player_Elo_Score, raw_score AS Player_Elo_Raw, score AS Player_Elo_Published, {_title('score')} AS Title, {_fix('skill', 3)} AS Skill_Z, id AS Player_ID, name AS Player_Name, {_int('mp')} AS MasterPoints,
            CAST(mp_rank AS INT) AS MasterPoint_Rank, CAST(n AS INT) AS Sessions_Played, {_RATES} FROM p ORDER BY place LIMIT 500""",
        "ranks_of_lines": f"""{lines} SELECT line, CAST(rank() OVER (ORDER BY quantity DESC NULLS LAST) AS INT) AS by_quantity, CAST(rank() OVER (ORDER BY price DESC) AS INT) AS by_price, CAST(rank() OVER (ORDER BY discount) AS INT) AS by_discount FROM l""",
        "medians_of_lines": f"{lines} SELECT median(quantity) AS quantity, median(price) AS price, median(discount) AS discount FROM l",
        "leaderboard_pairs": f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID}), {_pool(_SIDES, 3, 20, "avg(mp) AS mp, avg(geo) AS geo, avg(seat_elo) AS seat_elo, rank() OVER (ORDER BY round(avg(seat_elo) * 1000000000) DESC NULLS LAST) AS seat_rank, rank() OVER (ORDER BY round(avg(geo) * 1000000000) DESC NULLS LAST) AS geo_rank", "id NULLS LAST")}
            SELECT place AS Pair_Elo_Rank, score AS Pair_Elo_Score, raw_score AS Pair_Elo_Raw, score AS Pair_Elo_Published, {_title('score')} AS Title, {_fix('skill', 3)} AS Skill_Z, CAST(seat_rank AS INT) AS Avg_Elo_Rank, id AS Pair_IDs, name AS Pair_Names, {_int('mp')} AS Avg_MPs,
            CAST(mp_rank AS INT) AS Avg_MPs_Rank, CAST(geo_rank AS INT) AS Geo_MPs_Rank, CAST(n AS INT) AS Sessions, {_RATES} FROM p ORDER BY place LIMIT 80""",
        "crossover_enrich": f"""WITH all_b AS ({_B}), b AS (SELECT * FROM all_b WHERE strata_bucket <> 'open' AND {_VALID}), {_PLAYER_POOL}, board AS (SELECT place, id FROM p ORDER BY place LIMIT 60),
            o AS (SELECT * FROM all_b WHERE strata_bucket = 'open' AND {_VALID}), ox AS ({_SEATS.replace('FROM b ', 'FROM o ')}), own AS (SELECT * FROM ox WHERE id IN (SELECT id FROM board)), os AS (SELECT avg(elo) AS m, stddev_pop(elo) AS s FROM own),
            oe AS (SELECT id, count(DISTINCT session_id) AS n, first(elo ORDER BY Date DESC, session_id DESC, Board DESC) AS elo FROM own GROUP BY id)
            SELECT place AS Player_Elo_Rank, board.id AS Player_ID, coalesce(n, 0) AS Tournament_Sessions_Played, CASE WHEN oe.id IS NOT NULL THEN CAST({_chess(_shrunk('elo', 'n', '1400.0::DOUBLE', 50))} AS BIGINT) END AS Tournament_Elo FROM board CROSS JOIN os LEFT JOIN oe ON board.id = oe.id""",
        "report_filtered": f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID} AND Date >= TIMESTAMP '2024-01-10 00:00:00' AND is_virtual_game = FALSE AND strata_bucket = '0-749'), x AS ({_SEATS}),
            g AS (SELECT id, avg(elo) AS elo, count(DISTINCT session_id) AS n, max(mp) AS mp, avg(CAST(Is_Par_Suit AS INT)) AS suit FROM x GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY {_int('elo')} DESC, mp DESC NULLS LAST, id) AS place, rank() OVER (ORDER BY suit DESC) AS sr FROM g)
            SELECT id AS Player_ID, CAST(n AS INT) AS Sessions_Played, {_int('mp')} AS MasterPoints, {_fix('suit * 100', 1)} AS Par_Suit_Rate_Pct, CAST(sr AS INT) AS Par_Suit_Rank FROM r ORDER BY place LIMIT 25""",
        "player_detail": _player("p3") + f"SELECT Date, Session, Round, Board, Seat, Partner, Opponents, Pct, Elo_Before, Elo_After, Elo_After - Elo_Before AS Elo_Delta, {_title('Elo_After')} AS Title FROM h",
        "pair_detail": _pair("p24", "p3") + "SELECT Date, Session, Board, Side, Opponents, Pct, Elo_Before, Elo_After, Elo_After - Elo_Before AS Elo_Delta FROM h",
        "opponent_breakdown": _player("p3") + f"""SELECT Opponents, count(*) AS Boards, {_fix('avg(Pct)', 1)} AS Avg_Pct, first(Elo_Before ORDER BY Round, Board) AS Elo_Start, last(Elo_After ORDER BY Round, Board) AS Elo_End,
            last(Elo_After ORDER BY Round, Board) - first(Elo_Before ORDER BY Round, Board) AS Elo_Delta FROM h WHERE Session = '2024-01-05/3' GROUP BY Opponents""",
        "opponent_summary": _player("p3") + f"SELECT Opponents, count(*) AS Boards, count(DISTINCT Session) AS Sessions, {_fix('avg(Pct)', 1)} AS Avg_Pct, {_fix('avg(Elo_After - Elo_Before)', 1)} AS Avg_Elo_Delta FROM h GROUP BY Opponents",
        "players_from_results": f"WITH {_people(True)} SELECT * FROM people",
        "top_result_players": f"""WITH {_people(False)}, f AS (SELECT * FROM people WHERE games_played >= 5), an AS (SELECT median(elo_rating) AS a, median(scratch_elo) AS sa FROM f),
            q AS (SELECT *, {_show('elo_rating')} AS raw, {_show(_shrunk('elo_rating', 'games_played', 'a', 50))} AS pub, {_show(_shrunk('scratch_elo', 'games_played', 'sa', 50))} AS sc FROM f, an)
            SELECT CAST(row_number() OVER (ORDER BY pub DESC, games_played DESC, player_name, player_id) AS INT) AS Rank, pub AS Player_Elo, raw AS Player_Elo_Raw, {_title('sc')} AS Title, player_id AS Player_ID, player_name AS Player_Name, {_SHOWN} FROM q ORDER BY Rank LIMIT 40""",
        "top_result_pairs": f"""WITH res AS ({_R}), {_pairs(True, 3)}, q AS (SELECT *, {_show('elo')} AS raw, {_show(_shrunk('elo', 'games_played', 'a', 10))} AS pub, {_show(_shrunk('scratch', 'games_played', 'sa', 10))} AS sc FROM pairs, an)
            SELECT CAST(row_number() OVER (ORDER BY pub DESC, games_played DESC, pair_name, pair_id) AS INT) AS Rank, pub AS HC_Pair_Elo, raw AS HC_Pair_Elo_Raw, {_title('sc')} AS Scratch_Title, pair_id AS Pair_ID, pair_name AS Pair_Name, {_SHOWN} FROM q ORDER BY Rank LIMIT 60""",
        "top_result_pairs_titles": f"""WITH {_people(False)}, {_pairs(False, 3)}, ka AS (SELECT median(scratch_elo) AS pa FROM people WHERE games_played >= 3), q AS (SELECT pairs.*, {_show(_shrunk('elo', 'pairs.games_played', 'a', 10))} AS pub,
            {_show(prior.format('x1'))} AS s1, {_show(prior.format('x2'))} AS s2 FROM pairs CROSS JOIN an CROSS JOIN ka LEFT JOIN people x1 ON p1 = x1.player_id LEFT JOIN people x2 ON p2 = x2.player_id)
            SELECT CAST(row_number() OVER (ORDER BY pub DESC, games_played DESC, pair_name, pair_id) AS INT) AS Rank, pair_id AS Pair_ID, pub AS Pair_Elo, list_extract(['SGM','GM','IM','FM','CM','Expert','Advanced','Intermediate','Novice','Beginner'], greatest({_title_no('s1')}, {_title_no('s2')})) AS Title, CAST(games_played AS INT) AS Games FROM q ORDER BY Rank LIMIT 60""",
        "metric_cards": f"""WITH {_people(False)}, pe AS (SELECT count(*) AS games, avg(scratch_pair_elo) AS elo FROM res GROUP BY pair_id HAVING count(*) >= 3)
            SELECT 'players' AS card, count(*) AS n, {_r6('avg(games_played)')} AS mean_games, {_r6('max(elo_rating)')} AS best FROM people WHERE games_played >= 5 UNION ALL SELECT 'pairs', count(*), {_r6('avg(games)')}, {_r6('max(elo)')} FROM pe""",
        "tournament_opponents": f"""WITH res AS ({_R}) SELECT pair_name AS Pair, CAST("rank" AS INT) AS Rank, {_fix('scratch_percentage', 2)} AS Scratch_Pct, {_fix('handicap_percentage', 2)} AS Handicap_Pct, CAST(round(pair_elo) AS INT) AS Pair_Elo FROM res WHERE tournament_id = '2024-01-07-1' AND pair_id <> 'u1_u43'""",
        "entity_history": _U50 + "SELECT *, Elo_After - Elo_Before AS Elo_Delta FROM h",
        "partner_summary": _U50 + f"SELECT Partner, count(*) AS Tournaments, {_mean('Pct_Used', 2)} AS Avg_Pct, {_fix('avg(Rank)', 1)} AS Avg_Rank, arg_max(Elo_After, (Date, Event_ID, Seq)) AS Last_Elo FROM h GROUP BY Partner",
        "club_summary": f"""WITH res AS ({_R}) SELECT club_name AS Club, count(*) AS Tournaments, {_fix('avg(scratch_percentage)', 2)} AS Avg_Scratch_Pct, {_fix('avg(handicap_percentage)', 2)} AS Avg_Handicap_Pct, {_fix('avg("rank")', 1)} AS Avg_Rank FROM res WHERE pair_id = 'u1_u43' GROUP BY club_name""",
        "opponent_history": f"""WITH res AS ({_R}) SELECT tournament_id AS Event_ID, substr(date, 1, 10) AS Date, count(*) AS others, count(DISTINCT pair_name) AS pairs, CAST(min("rank") AS INT) AS best_rank {_OTHERS} GROUP BY ALL""",
        "opponent_me_vs_them": f"""WITH res AS ({_R}), mine AS (SELECT tournament_id AS t, CAST(arg_min("rank", row_seq) AS DOUBLE) AS r, arg_min(scratch_percentage, row_seq) AS s, arg_min(pair_elo, row_seq) AS e FROM res WHERE {_MINE} GROUP BY tournament_id),
            o AS (SELECT tournament_id, pair_name, CAST("rank" AS INT) AS rk, {_fix('scratch_percentage', 2)} AS sp, round(pair_elo) AS pe {_OTHERS})
            SELECT pair_name AS Opponent, count(*) AS Events, {_mean('rk', 1)} AS Opp_Avg_Rank, {_mean('sp', 2)} AS Opp_Avg_Scratch, {_mean('pe', 0)} AS Opp_Avg_Elo, {_mean('r', 1)} AS My_Avg_Rank, {_mean('s', 2)} AS My_Avg_Scratch, {_mean('e', 0)} AS My_Avg_Elo FROM o LEFT JOIN mine ON tournament_id = t GROUP BY pair_name""",
        "result_filters": f"""WITH res AS ({_R}) SELECT event_id, tournament_id, pair_id, club_name FROM res WHERE series_id = 1 AND club_name = 'Club 3' AND substr(date, 1, 10) BETWEEN '2024-01-05' AND '2024-01-20' AND (handicap_percentage IS NULL OR handicap_percentage BETWEEN 0 AND 100) AND scratch_percentage BETWEEN 0 AND 100""",
        "new_tournaments": f"WITH res AS ({_R}) SELECT DISTINCT tournament_id, date FROM res WHERE series_id = 2 AND substr(date, 1, 10) <= '2024-01-20'",
        "filter_tristate": f"WITH b AS ({_B}) SELECT event_id, CASE WHEN is_virtual_game IS NULL THEN 'online' ELSE 'local' END AS mode FROM b WHERE is_virtual_game IS NULL OR is_virtual_game = FALSE",
        "filter_valid_pct": f"WITH b AS ({_B}) SELECT event_id, Pct_NS FROM b WHERE {_VALID} AND strata_bucket = '0-299'",
        "filter_days": "SELECT o_orderstatus, count(*) AS n, min(substr(CAST(o_orderdate AS STRING), 1, 10)) AS first FROM orders WHERE substr(CAST(o_orderdate AS STRING), 1, 10) BETWEEN '1996-03-01' AND '1996-06-30' GROUP BY 1",
        "filter_names_numbers": """SELECT CAST(c_custkey AS STRING) AS id, c_name FROM customer WHERE contains(lower(c_name), '#00000012') UNION ALL SELECT CAST(c_custkey AS STRING), c_name FROM customer WHERE c_custkey = 17
            UNION ALL SELECT c_custkey || '_' || c_nationkey, c_name FROM customer WHERE c_custkey = 7 OR c_nationkey = 7""",
        "filter_masterpoint_bands": f"SELECT {band} AS band, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1",
        "optional_columns": "SELECT s_suppkey, s_name, CAST(NULL AS INT) AS Round FROM supplier",
        "unpivot_seats": f"WITH b AS ({_B}), x AS ({_SEATS}) SELECT id AS Player_ID, count(*) AS n, sum(elo) AS total, first(name ORDER BY Date DESC, Board DESC) AS name FROM x GROUP BY id",
        "unpivot_sides": f"WITH b AS ({_B}), x AS ({_SIDES}) SELECT id AS Pair_IDs, count(*) AS n, sum(elo) AS total, {_r6('avg(geo)')} AS geo, {_r6('avg(seat_elo)')} AS mean_elo FROM x GROUP BY id",
        "union_by_name": "SELECT n_nationkey, n_name, NULL AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region",
        "rating_methods": f"""WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN "value" END AS v FROM events) SELECT user_id, first(v ORDER BY ts DESC, event_id DESC) AS last, arg_max(v, (ts, event_id)) AS last_known, first(v ORDER BY ts, event_id) AS first, {_r6('avg(v)')} AS mean, max(v) AS most FROM e GROUP BY user_id""",
        "distinct_and_spread": f"SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, {_r6('avg(CAST(l_returnflag = chr(82) AS INT))')} AS rate, {_r6('stddev_samp(l_quantity)')} AS sd, {_r6('stddev_pop(l_quantity)')} AS sd_pop, median(l_quantity) AS median, max(l_tax) AS most FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 50",
        "stacked_calibration": f"WITH b AS ({_B}), v AS ({' UNION ALL '.join(f'SELECT Elo_R_{p} AS v FROM b' for p in 'NESW')}) SELECT {_r6('avg(v)')} AS mean, {_r6('stddev_pop(v)')} AS sd, (SELECT min(Date) FROM b) AS first, (SELECT max(Date) FROM b) AS last FROM v WHERE v IS NOT NULL AND NOT isnan(v)",
        "sorted_options": f"WITH res AS ({_R}) SELECT DISTINCT club_name FROM res WHERE club_name <> ''",
        "rank_suite": """WITH g AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, most DESC, o_custkey) AS INT) AS "row", CAST(rank() OVER (ORDER BY n DESC) AS INT) AS by_n, CAST(rank() OVER (ORDER BY most) AS INT) AS by_most FROM g)
            SELECT *, CAST(rank() OVER (ORDER BY (by_n + by_most) / 2.0) AS INT) AS quality FROM r""",
        "pages_of_parts": 'WITH r AS (SELECT p_partkey, p_size, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS INT) AS "row" FROM part) SELECT *, CAST(CASE WHEN "row" <= 20 THEN 1 ELSE ceil(("row" - 20) / 35.0) + 1 END AS INT) AS page FROM r',
        "top_by_two_keys": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 30",
        "scales_and_titles": f"""WITH c AS (SELECT *, CASE WHEN c_nationkey <> 3 THEN c_acctbal / 3 END AS x FROM customer), st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c), q AS (SELECT c_custkey, {_chess('x')} AS z, {_int(_shrunk('x', 'c_nationkey', '1500.0::DOUBLE', 10))} AS shrunk FROM c, st)
            SELECT *, {_title('z')} AS title, list_extract(['SGM','GM','IM','FM','CM','Expert','Advanced','Intermediate','Novice','Beginner'], greatest({_title_no('z')}, {_title_no('shrunk')})) AS pair_title FROM q""",
        "elo_steps": f"""WITH q AS (SELECT p_partkey, p_retailprice AS r, p_size * 1.5::DOUBLE AS pct, 1180.0::DOUBLE + p_size AS f FROM part), s AS (SELECT *, (f - 1200) / 6.0 AS z, 1 / (1 + pow(10.0, least(greatest((f - r) / 400.0, -10.0), 10.0))) AS e FROM q),
            k AS (SELECT *, CASE WHEN z >= 0 THEN 1.0 WHEN z <= -2 THEN 0.7 ELSE 0.7 + 0.3 * (z + 2) / 2 END AS sc FROM s) SELECT p_partkey, {_r6('sc')} AS scale, {_r6('e')} AS expected, {_r6('r + 32 * sc * (pct / 100 - e)')} AS after FROM k""",
        "pair_ids": "WITH x AS (SELECT CAST(s_suppkey AS STRING) AS a, CAST(s_nationkey AS STRING) AS b, s_name FROM supplier) SELECT a, b, least(a, b) || '-' || greatest(a, b) AS id, CASE WHEN a <= b THEN s_name || ' - X' ELSE 'X - ' || s_name END AS name FROM x",
        "strata_limits": r"""WITH e AS (SELECT event_id % 5 AS i, event_id % 10 AS j FROM events), a(i, raw, club) AS (VALUES (0, 'MP Limits: 1,500/750', '0-1500'), (1, 'MP Limits: None/300', 'open'), (2, 'mp limits: 299', '0-299'), (3, '2500', 'other-restricted'), (4, 'nothing', 'open')),
            t(j, other) AS (VALUES (0, 'NLM'), (1, '0-750'), (2, '0-1500/NLM'), (3, 'none'), (4, '2500'), (5, 'NLM/0-500'), (6, '300/0-200'), (7, '500/0-abc'), (8, '0-xyz'), (9, NULL)),
            parts AS (SELECT j, other, list_filter(list_reverse(string_split(upper(trim(other)), '/')), lambda x: x <> 'NLM' AND (starts_with(x, '0-') OR regexp_matches(x, '[0-9]')))[1] AS part, coalesce(starts_with(upper(trim(other)), 'NLM'), false) AS nlm FROM t),
            top AS (SELECT j, other, nlm, CASE WHEN upper(trim(other)) = 'NLM' THEN 500 ELSE TRY_CAST(replace(regexp_extract(regexp_replace(part, '^0-', ''), '[0-9][0-9,]*'), ',', '') AS INT) END AS n FROM parts),
            t2 AS (SELECT j, other, CASE WHEN n IS NULL AND NOT nlm THEN 'open' WHEN nlm AND (n IS NULL OR n <= 500) THEN '0-499-nlm' WHEN n <= 300 THEN '0-299' WHEN n <= 500 THEN '0-499-nlm' WHEN n <= 750 THEN '0-749' WHEN n <= 1500 THEN '0-1500' ELSE 'other-restricted' END AS event FROM top)
            SELECT raw, other, club, event, count(*) AS n FROM e JOIN a USING (i) JOIN t2 USING (j) GROUP BY ALL""",
        "timestamps_parsed": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS t FROM orders",
        "landed_pages": f"""WITH res AS ({_R}), d AS (SELECT DISTINCT tournament_id, date, series_id FROM res), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date, tournament_id) AS place FROM d)
            SELECT tournament_id, date, 'Night ' || tournament_id AS tournament_name, CAST(series_id AS INT) AS series_id, CAST((place - 1) // 5 + 1 AS INT) AS page FROM n WHERE (place - 1) // 5 + 1 <= 4 + series_id AND place <= 23""",
        "club_codes": f"SELECT event_id, coalesce(CASE WHEN n_nationkey BETWEEN 1 AND 6 THEN n_name END, '') AS club_name FROM events LEFT JOIN nation ON {codes} = CAST(n_nationkey AS STRING)",
        "html_to_text": r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS h FROM pages)
            SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS text, regexp_matches(url, '^https?://') AS is_url, substr(regexp_replace(url, '[^A-Za-z0-9_\-]', '_', 'g'), 1, 48) AS key FROM a""",
        "json_payloads": """WITH e AS (SELECT *, event_id % 64 / 2.0::DOUBLE AS pct, event_id % 3 * 3.0::DOUBLE AS bonus FROM events), q AS (SELECT *, event_id % 4 = 0 OR bonus > 0 AS h FROM e)
            SELECT CAST(event_id AS STRING) AS tournament_id, 'm' || user_id AS player1_id, CAST(event_id AS STRING) AS player2_id, 'A B' AS player1_name, 'C' AS player2_name, CASE WHEN h THEN pct - bonus ELSE pct END AS scratch_percentage, CASE WHEN h THEN pct END AS handicap_percentage, bonus AS iv_bonus, event_id % 9 AS "rank" FROM q""",
        "dated_pages": "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CAST(d AS STRING) AS d, CASE isodow(d) WHEN 1 THEN 'http://pages.example/l?c=lo' || strftime(d, '%y%m%d') WHEN 4 THEN 'http://pages.example/j?c=jo' || strftime(d, '%y%m%d') END AS page FROM d",
        "lookups_left_and_filled": "SELECT c_custkey, n_name, coalesce(o.n, 0) AS orders FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey",
        "members_of_region": f"SELECT o_orderpriority, count(*) AS n, {_r6('sum(o_totalprice)')} AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1",
        "ad_hoc_self": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey LIMIT 7",
        "post_processed": f"WITH q AS (SELECT p_partkey, CAST(round(round_even(least(greatest(least(greatest(p_retailprice, -1000.0), 10000.0) * 2.0, 0.0), 3500.0), 1)) AS INT) AS Elo FROM part) SELECT *, {_title('Elo')} AS Title FROM q",
        "elo_history_fold": fold_sql,
        "elo_extended": fold_sql,
        "elo_whole_pool": _elo_fold("0", f"SELECT event_id, {', '.join(f'{_r6(c)} AS {c}' for c in ['scratch_percentage', 'scratch_field_avg', 'handicap_field_avg', 'scratch_field_strength', 'handicap_field_strength', 'player1_scratch_elo_after', 'player2_scratch_elo_before', 'player1_handicap_elo_after', 'player2_handicap_elo_after', 'scratch_pair_elo'])} FROM rated",
            "CASE WHEN event_id % 7 <> 0 THEN scratch_percentage ELSE coalesce(nullif(CASE WHEN event_id % 21 <> 0 THEN percentage END, 0), 50) - event_id % 8 END"),
        "elo_standardized": _elo_fold("series_id", f""", long AS (SELECT a AS id, 1 AS seat, date, tournament_id, row_seq, scratch_percentage AS pct, player1_scratch_elo_after AS s, player1_handicap_elo_after AS h FROM rated UNION ALL SELECT b, 2, date, tournament_id, row_seq, scratch_percentage, player2_scratch_elo_after, player2_handicap_elo_after FROM rated),
            people AS (SELECT id, arg_max(s, (date, tournament_id, row_seq, seat)) AS s, arg_max(h, (date, tournament_id, row_seq, seat)) AS h, count(*) AS n, avg(pct) AS m, stddev_samp(pct) AS sd FROM long GROUP BY id),
            x AS (SELECT count(*) FILTER (n >= 5) AS k, avg(s) FILTER (n >= 5) AS sm, stddev_pop(s) FILTER (n >= 5) AS ss, avg(h) FILTER (n >= 5) AS hm, stddev_pop(h) FILTER (n >= 5) AS hs, avg(s) AS sam, stddev_pop(s) AS sas, avg(h) AS ham, stddev_pop(h) AS has FROM people),
            y AS (SELECT CASE WHEN k < 10 THEN sam ELSE sm END AS sm, CASE WHEN k < 10 THEN sas ELSE ss END AS ss, CASE WHEN k < 10 THEN ham ELSE hm END AS hm, CASE WHEN k < 10 THEN has ELSE hs END AS hs FROM x)
            SELECT id AS player_id, {_fix('least(greatest(1500.0 + (s - sm) / ss * 400.0, 0.0), 3500.0)', 1)} AS scratch_elo, {_fix('least(greatest(1500.0 + (h - hm) / hs * 400.0, 0.0), 3500.0)', 1)} AS handicap_elo, n AS games_played, {_r6('m')} AS avg_percentage, {_r6('sd')} AS stdev_percentage FROM people, y"""),
        "rating_moments": _moments(),
        "detail_at_start": f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID} AND is_virtual_game = FALSE AND strata_bucket = '0-299'), x AS ({' UNION ALL '.join(f"SELECT Date, session_id AS Session, '{p}' AS Seat, Player_Name_{q} AS Partner, {_fix('Pct_NS * 100' if p in 'NS' else '(1 - Pct_NS) * 100', 1)} AS Pct, Elo_R_{p}_Before AS e FROM b WHERE Player_ID_{p} = 'p3' AND Elo_R_{p}_Before IS NOT NULL AND NOT isnan(Elo_R_{p}_Before)" for p, q in ('NS', 'SN', 'EW', 'WE'))}),
            st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM ({' UNION ALL '.join(f'SELECT Elo_R_{p}_Before AS v FROM b' for p in 'NESW')}) WHERE v IS NOT NULL AND NOT isnan(v))
            SELECT Date, Session, Seat, Partner, Pct, CAST(round(least(greatest(1500.0 + (e - m) / s * 400.0, 0.0), 3500.0)) AS INTEGER) AS Elo_Before, CAST(round(least(greatest(1500.0 + (e - m) / s * 400.0, 0.0), 3500.0)) AS INTEGER) AS Elo_After FROM x, st""",
        "leaderboard_found": f"""WITH b AS (SELECT * FROM ({_B}) WHERE {_VALID}), {_PLAYER_POOL}, top AS (SELECT place, id, name, {_int('mp')} AS mp FROM p ORDER BY place LIMIT 60)
            SELECT 'name' AS "by", place AS Player_Elo_Rank, id AS Player_ID, mp AS MasterPoints FROM top WHERE contains(lower(name), 'eve') UNION ALL SELECT 'points', place, id, mp FROM top WHERE mp >= 300 AND mp < 500""",
        "boards_of_members": f"WITH b AS ({_B}) SELECT event_id FROM b WHERE {' OR '.join(f'coalesce(Player_ID_{p} IN (chr(112) || 3, chr(112) || 50), FALSE)' for p in 'NESW')}",
        "date_choices": f"""WITH c(choice, a, z) AS (VALUES ('Current season', '1997-07-01', '1998-03-01'), ('Previous season', '1996-07-01', '1997-05-31'), ('Last 3 months', '{_ago(90)}', NULL), ('Last 6 months', '{_ago(182)}', NULL),
            {', '.join(f"('Last {k} year{'s' * (k > 1)}', '{_ago(365 * k)}', NULL)" for k in range(1, 6))}, ('All time', NULL, NULL)), o AS (SELECT substr(CAST(o_orderdate AS STRING), 1, 10) AS d FROM orders)
            SELECT choice, count(d) AS n FROM c LEFT JOIN o ON (a IS NULL OR d >= a) AND (z IS NULL OR d <= z) GROUP BY choice""",
        "recent_tournaments": f"""WITH res AS ({_R}), r AS (SELECT DISTINCT tournament_id, CASE WHEN event_id % 10 <> 0 THEN substr(date, 1, 10) END AS day FROM res) SELECT tournament_id, day, coalesce(day >= '2024-01-15', FALSE) AS recent FROM r""",
        "series_keys": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '3' WHEN 2 THEN 'all' WHEN 3 THEN '3.0' ELSE '' END AS text, CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.5' WHEN 2 THEN '1' ELSE '1.5' END AS number, s_suppkey % 5 = 3 AS dotted FROM supplier""",
        "numbers_by_name": "SELECT CAST(s_suppkey AS DOUBLE) AS Elo, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS Best_Pct, s_name FROM supplier",
        "pair_surnames": f"""WITH res AS ({_R}), g AS (SELECT pair_name, count(*) AS n, regexp_extract(pair_name, '^Ann ([0-9]+)', 1) AS first, regexp_extract(pair_name, 'Bob ([0-9]+)$', 1) AS second FROM res GROUP BY pair_name)
            SELECT *, CASE WHEN n > 1 THEN 'http://pages.example/' || first || '?of=' || n END AS page FROM g""",
        "private_payloads": """WITH e AS (SELECT *, event_id % 64 / 2.0::DOUBLE AS pct, event_id % 3 * 3.0::DOUBLE AS bonus, event_id % 5 = 0 AS given, event_id % 4 = 0 AS own FROM events)
            SELECT CAST(event_id AS STRING) AS tournament_id, CAST(event_id AS STRING) AS team_id, CAST(user_id AS STRING) AS player1_id, 'D' AS player2_name, CASE WHEN given THEN CAST(event_id % 50 AS DOUBLE) WHEN own THEN pct WHEN bonus > 0 THEN pct - bonus ELSE pct END AS scratch_percentage,
            CASE WHEN given THEN pct WHEN own THEN pct + bonus WHEN bonus > 0 THEN pct END AS handicap_percentage, bonus AS iv_bonus, event_id % 9 AS "rank", '7' AS club_code FROM e""",
        "reconciled_pages": f"""WITH res AS ({_R}), h AS (SELECT substr(date, 1, 10) AS Date, tournament_id AS Event_ID, row_seq AS Seq, replace(replace(pair_name, 'Ann ', 'Ann A'), 'Bob ', 'Bob B') AS Partner, {_fix('scratch_percentage', 2)} AS sp, {_fix('handicap_percentage', 2)} AS hp,
            CAST(substr(date, 1, 10) AS DATE) AS d, CAST(regexp_extract(pair_name, '^Ann ([0-9]+)', 1) AS INT) AS k FROM res WHERE player1_id = 'u50' OR player2_id = 'u50'), m AS (SELECT *, isodow(d) IN (1, 4) AND k % 3 = day(d) % 3 AS ok FROM h)
            SELECT Date, Event_ID, Seq, replace(Partner, ' -', 'X -') || 'X' AS Partner, CASE WHEN ok THEN {_fix('30 + k + day(d) / 100.0::DOUBLE', 2)} ELSE sp END AS Scratch_Pct, CASE WHEN ok THEN {_fix('50 + k + day(d) / 100.0::DOUBLE', 2)} ELSE hp END AS Handicap_Pct, CASE WHEN ok THEN {_fix('30 + k + day(d) / 100.0::DOUBLE', 2)} ELSE sp END AS Pct_Used,
            CASE WHEN ok THEN CASE isodow(d) WHEN 1 THEN 'http://pages.example/l?c=lo' ELSE 'http://pages.example/j?c=jo' END || strftime(d, '%y%m%d') || '&t=s' END AS Organization_URL FROM m""",
    }
    stored = {"stored_leaderboard": "leaderboard_players", "stored_pairs": "leaderboard_pairs", "stored_filtered": "report_filtered", "stored_crossover": "crossover_enrich", "stored_player_detail": "player_detail", "stored_pair_detail": "pair_detail"}
    return plain | {name: plain[same] for name, same in stored.items()}
