"""SQL common table expressions shared by the checks."""

from __future__ import annotations

from tsengine.plans.tables import EVENT_TYPES, PRIORITIES

_CELLS = ", ".join(f"sum(CASE WHEN event_type='{c}' THEN value END) AS \"{c}\"" for c in EVENT_TYPES)
_FILLED = ", ".join(f'coalesce("{c}",0) AS "{c}"' for c in EVENT_TYPES)

HOURLY = f"""
hobs AS (SELECT date_trunc('hour', ts) AS date, {_CELLS} FROM events GROUP BY 1),
hgrid AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM hobs),
hourly AS (SELECT 'all' AS series_id, date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n,
           {_FILLED} FROM hgrid LEFT JOIN hobs USING (date))"""

HOURLY_LONG = (
    HOURLY
    + ",\nplong AS ("
    + " UNION ALL ".join(f"SELECT series_id, date, rn, n, '{c}' AS channel, \"{c}\" AS v FROM hourly" for c in EVENT_TYPES)
    + ")"
)

USERS = """
uobs AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS date, sum(value) AS v FROM events GROUP BY 1, 2),
ugrid AS (SELECT series_id, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM uobs GROUP BY 1),
users AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn,
          count(*) OVER (PARTITION BY series_id) AS n, coalesce(v,0) AS v FROM ugrid LEFT JOIN uobs USING (series_id, date)),
plong AS (SELECT series_id, date, rn, n, 'v' AS channel, v FROM users)"""

_DAILY = ", ".join(f"coalesce(sum(CASE WHEN o_orderpriority='{p}' THEN o_totalprice END),0) AS p{p[0]}" for p in PRIORITIES)
ORDERS = f"""
dgrid AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS date FROM orders),
daily AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n, {_DAILY}
          FROM dgrid LEFT JOIN orders ON o_orderdate >= date AND o_orderdate < date + INTERVAL 1 DAY GROUP BY date)"""

NT, NS = "floor(n*0.7::DOUBLE)::BIGINT", "floor(n*0.2::DOUBLE)::BIGINT"

SCALED = f"""
st AS (SELECT series_id, channel, avg(v) AS m, CASE WHEN stddev_pop(v)=0 THEN 1 ELSE stddev_pop(v) END AS s
       FROM plong WHERE rn < {NT} GROUP BY 1, 2),
sc AS (SELECT series_id, channel, date, rn, n, (v-m)/s AS v FROM plong JOIN st USING (series_id, channel))"""


def bounds(split: str, context: int, alias: str = "") -> tuple[str, str]:
    """First position and end of a split as SQL."""
    n = f"{alias}n"
    nt, ns = f"floor({n}*0.7::DOUBLE)::BIGINT", f"floor({n}*0.2::DOUBLE)::BIGINT"
    return {
        "train": ("0", nt),
        "val": (f"({nt}-{context})", f"({n}-{ns})"),
        "test": (f"({n}-{ns}-{context})", n),
    }[split]


def steps(split: str, context: int, horizon: int, source: str = "sc", name: str = "w") -> str:
    """One row per window and step: last context value ``pred`` and truth ``truth``."""
    low, high = bounds(split, context, "a.")
    return f"""
{name} AS (SELECT a.series_id, a.channel, a.rn-{context}+1-{low} AS window_id, (b.rn-a.rn)::INT AS step, a.v AS pred, b.v AS truth
      FROM {source} a JOIN {source} b ON a.series_id=b.series_id AND a.channel=b.channel
       AND b.rn BETWEEN a.rn+1 AND a.rn+{horizon}
      WHERE a.rn-{context}+1 >= {low} AND a.rn+{horizon} < {high})"""


def leads(split: str, context: int, horizon: int, chosen: list[int], source: str = "sc", name: str = "w") -> str:
    """``steps`` for chosen steps, without a join: each row looks ahead in its series."""
    low, high = bounds(split, context)
    ahead = ", ".join(f"struct_pack(step := {h}, truth := lead(v, {h}) OVER s)" for h in chosen)
    return f"""
{name}_rows AS (SELECT series_id, channel, rn-{context}+1-{low} AS window_id, rn-{context}+1 >= {low} AND rn+{horizon} < {high} AS ok, v AS pred, [{ahead}] AS ahead
      FROM {source} WINDOW s AS (PARTITION BY series_id, channel ORDER BY rn)),
{name}_each AS (SELECT series_id, channel, window_id, pred, unnest(ahead) AS a FROM {name}_rows WHERE ok),
{name} AS (SELECT series_id, channel, window_id, a.step::INT AS step, pred, a.truth AS truth FROM {name}_each)"""


def stirred(x: str, a: str, b: str, key: str) -> tuple[list[str], str]:
    """Nested selects that compute ``functions.permutation``: column lists, innermost first, and the result."""
    number = lambda i, v: f"('0x' || substr(md5({key} || ':{i}:' || {v}), 1, 15))::BIGINT"
    stages = [f"{x} // {b} AS l0, {x} % {b} AS r1"]
    stages.append(f"(l0 + {number(0, 'r1')}) % {a} AS l2")
    stages.append(f"(r1 + {number(1, 'l2')}) % {b} AS r3")
    stages.append(f"(l2 + {number(2, 'r3')}) % {a} AS l4")
    stages.append(f"(r3 + {number(3, 'l4')}) % {b} AS r5")
    return stages, f"l4 * {b} + r5"


def nested(stages: list[str], source: str) -> str:
    """A select inside a select for each stage."""
    made = source
    for stage in stages:
        made = f"(SELECT *, {stage} FROM {made})"
    return made


def cells(split: str, context: int, horizon: int, skip: int, length: int, source: str = "sc", name: str = "c") -> str:
    """One row per window and position of the slice [skip, skip+length) of the window."""
    low, high = bounds(split, context, "a.")
    return f"""
{name} AS (SELECT a.series_id, a.channel, a.rn-{low} AS window_id, b.rn-a.rn-{skip} AS pos, b.v, b.date
      FROM {source} a JOIN {source} b ON a.series_id=b.series_id AND a.channel=b.channel
       AND b.rn BETWEEN a.rn+{skip} AND a.rn+{skip}+{length}-1
      WHERE a.rn >= {low} AND a.rn+{context}+{horizon} <= {high})"""
