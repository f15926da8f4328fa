"""Shared SQL fragments: the bound tables as common table expressions."""

from blendscope.warehouse import K, SQUAD, TYPES

SEASON = "(year({ts})::VARCHAR || '-' || lpad(((year({ts})+1) % 100)::VARCHAR, 2, '0'))"


def season(ts: str) -> str:
    return SEASON.format(ts=ts)


LINES = f"""lines AS (
  SELECT l_suppkey AS member, {season('l_shipdate')} AS season, l_orderkey AS game, l_partkey AS part,
         l_linenumber AS line_no, l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ship,
         l_extendedprice * (1 - l_discount) AS rev
  FROM lineitem)"""

MEMBERS = """members AS (
  SELECT s_suppkey AS member, translate(s_name, '#0123456789', ' abcdefghij') AS name, n_name AS team,
         s_nationkey AS team_id, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SQUADS = f"""squads AS (SELECT s_suppkey AS member, 'squad ' || (s_suppkey // {SQUAD})::VARCHAR AS team FROM supplier)"""

_SUMS = ", ".join(f"sum(CASE WHEN p_type = '{t}' THEN rev ELSE 0 END) AS r{i}" for i, t in enumerate(TYPES))
_TOT = " + ".join(f"r{i}" for i in range(K))
MIX = f"""mixsum AS (
  SELECT member, season, sum(qty) AS min, {_SUMS}
  FROM lines JOIN part ON part = p_partkey GROUP BY member, season),
mix AS (
  SELECT member, season, min, {", ".join(f"r{i} / ({_TOT}) AS w{i}" for i in range(K))} FROM mixsum)"""

MIXLONG = "mixlong AS (" + " UNION ALL ".join(
    f"SELECT member, season, {i} AS component, w{i} AS w FROM mix" for i in range(K)) + ")"

_RATES = """100 * sum(rev_for) / sum(rev) AS off_rating, 100 * sum(rev_against) / sum(rev) AS def_rating,
         100 * sum(rev_for) / sum(rev) - 100 * sum(rev_against) / sum(rev) AS net_rating"""

GM = """gm AS (
  SELECT game, member, sum(qty) AS qty, sum(rev) AS rev,
         sum(CASE WHEN flag = 'A' THEN rev ELSE 0 END) AS rev_for,
         sum(CASE WHEN flag = 'R' THEN rev ELSE 0 END) AS rev_against, max(ship) AS ship, count(*) AS n_lines
  FROM lines GROUP BY game, member)"""

PAIRS = f"""two AS (
  SELECT x.member AS a, y.member AS b, g.ship, x.qty + y.qty AS qty, x.rev + y.rev AS rev,
         x.rev_for + y.rev_for AS rev_for, x.rev_against + y.rev_against AS rev_against
  FROM gm x JOIN gm y ON x.game = y.game AND x.member < y.member
  JOIN (SELECT game, max(ship) AS ship FROM gm GROUP BY game) g ON g.game = x.game),
pairs AS (
  SELECT {season('ship')} AS season, a, b, sum(qty) AS min, {_RATES} FROM two GROUP BY ALL),
edges AS (
  SELECT season, a AS focal, b AS mate, min, off_rating, def_rating, net_rating FROM pairs
  UNION ALL SELECT season, b, a, min, off_rating, def_rating, net_rating FROM pairs)"""

LINEUPS = f"""sets AS (
  SELECT game, list_sort(list(member)) AS ids, count(*) AS size, max(ship) AS ship, sum(qty) AS qty, sum(rev) AS rev,
         sum(rev_for) AS rev_for, sum(rev_against) AS rev_against, sum(n_lines) AS n_lines
  FROM gm GROUP BY game HAVING count(*) >= 2),
lineups AS (
  SELECT {season('ship')} AS season, ids, max(size) AS size, sum(qty) AS min, {_RATES},
         sum(n_lines) * 100.0 / sum(qty) AS pace
  FROM sets GROUP BY ALL)"""

ONCOURT = f"""oncourt AS (
  SELECT member, season, {_RATES} FROM (
    SELECT member, season, rev, CASE WHEN flag = 'A' THEN rev ELSE 0 END AS rev_for,
           CASE WHEN flag = 'R' THEN rev ELSE 0 END AS rev_against FROM lines)
  GROUP BY member, season)"""

_ES = ", ".join(f"sum(e.min * m.w{i}) AS s{i}" for i in range(K))
_ET = " + ".join(f"s{i}" for i in range(K))
EXPOSURE = f"""expsum AS (
  SELECT e.season, e.focal, {_ES}, count(m.member) AS n_mates, count(*) - count(m.member) AS n_dropped,
         sum(CASE WHEN m.member IS NOT NULL THEN e.min END) AS mate_min
  FROM edges e LEFT JOIN mix m ON m.member = e.mate AND m.season = e.season GROUP BY e.season, e.focal),
exposure AS (
  SELECT focal AS member, season, {", ".join(f"s{i} / ({_ET}) AS e{i}" for i in range(K))}, mate_min, n_mates, n_dropped
  FROM expsum WHERE {_ET} > 0)"""


def plog(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END)"


def js(a: list[str], b: list[str]) -> str:
    """Base-2 Jensen-Shannon distance of two mixtures that sum to 1."""
    cells = " + ".join(f"{plog(x)} + {plog(y)} - 2 * {plog(f'(({x} + {y}) / 2)')}" for x, y in zip(a, b))
    return f"sqrt(greatest(0.0, ({cells}) / 2))"


def cols(alias: str, prefix: str, k: int = K) -> list[str]:
    return [f"{alias}.{prefix}{i}" for i in range(k)]


_EX = ", ".join(f"sum(v * e{i}) / sum(v) AS x{i}" for i in range(K))
_PX = ", ".join(
    f"sum(CASE WHEN net_rating > 0 THEN v * e{i} END) / sum(CASE WHEN net_rating > 0 THEN v END) AS p{i}" for i in range(K))
BENCH = f"""tilepairs AS (
  SELECT t.member, t.season, power(1 - {js(cols('t', 'w'), cols('q', 'w'))}, 4) AS v,
         {", ".join(f"x.e{i}" for i in range(K))}, o.net_rating
  FROM mix t JOIN mix q ON t.season = q.season AND t.member <> q.member
  JOIN exposure x ON x.member = q.member AND x.season = q.season
  LEFT JOIN oncourt o ON o.member = q.member AND o.season = q.season),
bench AS (
  SELECT member, season, count(*) AS n_pool, sum(v) * sum(v) / sum(v * v) AS ess, {_EX},
         count(CASE WHEN net_rating > 0 THEN 1 END) AS n_pool_positive,
         power(sum(CASE WHEN net_rating > 0 THEN v END), 2) / sum(CASE WHEN net_rating > 0 THEN v * v END) AS ess_positive,
         {_PX}
  FROM tilepairs GROUP BY member, season)"""

_D = ", ".join(f"x.e{i} - b.x{i} AS d{i}" for i in range(K))
MISMATCH = f"""mis AS (
  SELECT x.member, x.season, {js(cols('x', 'e'), cols('b', 'x'))} AS score, {_D},
         {", ".join(f"x.e{i}, b.x{i}, b.p{i}" for i in range(K))}, b.n_pool, b.ess
  FROM exposure x JOIN bench b ON b.member = x.member AND b.season = x.season)"""

ENV = ",\n".join([LINES, MIX, GM, PAIRS, EXPOSURE])
ENVBENCH = ",\n".join([ENV, ONCOURT, BENCH, MISMATCH])


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def long_of(table: str, names: dict[str, str], keep: str, k: int = K) -> str:
    """Wide component columns to rows."""
    return " UNION ALL ".join(
        f"SELECT {keep}, {i} AS component, " + ", ".join(f"{p}{i} AS {n}" for n, p in names.items()) + f" FROM {table}"
        for i in range(k))


LIFT = "liftrows AS (" + " UNION ALL ".join(
    f"""SELECT e.focal AS member, e.season, {i} AS component, o.net_rating AS own_rating,
        sum(e.min * m.w{i} * (e.net_rating - o.net_rating)) AS num, sum(e.min * m.w{i}) AS mass,
        count(CASE WHEN m.w{i} > 0.01 THEN 1 END) AS n_mates
        FROM edges e JOIN mix m ON m.member = e.mate AND m.season = e.season
        JOIN oncourt o ON o.member = e.focal AND o.season = e.season GROUP BY ALL""" for i in range(K)) + """),
lift AS (SELECT member, season, component, own_rating, CASE WHEN mass > 1e-9 THEN num / mass END AS lift, mass, n_mates
  FROM liftrows)"""

PROFILE = """profile AS (
  SELECT team, season, component, count(*) AS n_members, sum(w) AS soft_sum, avg(w) AS soft_mean,
         count(CASE WHEN component = top THEN 1 END) AS hard_count
  FROM mixlong JOIN members USING (member)
  JOIN (SELECT member, season, arg_max(component, w - component * 1e-15) AS top FROM mixlong GROUP BY ALL) t USING (member, season)
  GROUP BY team, season, component)"""

BASELINE = """baseline AS (
  SELECT season, component, avg(soft_mean) AS league_mean, stddev_pop(soft_mean) AS league_sd, count(*) AS n_teams
  FROM profile GROUP BY season, component)"""
