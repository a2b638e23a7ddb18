"""DuckDB SQL building blocks mirroring ``cohortkit.sources.roles``.

The oracle views are the raw test tables; these CTE fragments derive the
same role tables in SQL so every oracle query reads the whole tables.
"""

EV = """
ev AS (
  SELECT o.o_custkey AS actor_id,
         l.l_suppkey AS subject_id,
         CAST(l.l_shipdate AS DATE) AS event_date,
         strftime(CAST(l.l_shipdate AS DATE), '%Y-%m') AS month,
         year(CAST(l.l_shipdate AS DATE)) * 12 + month(CAST(l.l_shipdate AS DATE)) - 1 AS mi,
         p.p_brand AS product,
         p.p_type AS product_group,
         l.l_quantity AS quantity,
         CASE l.l_returnflag WHEN 'A' THEN '0' WHEN 'R' THEN '1' ELSE 'UNK' END AS use_flag,
         l.l_linestatus AS source,
         CASE WHEN l.l_linestatus <> 'F' THEN l.l_linestatus END AS institution,
         CAST(1940 + (l.l_suppkey * 7) % 80 AS BIGINT) AS birth_year,
         CAST(CASE WHEN l.l_suppkey % 11 = 0 THEN 1940 + (l.l_suppkey * 7 + l.l_linenumber) % 80
                   ELSE 1940 + (l.l_suppkey * 7) % 80 END AS BIGINT) AS birth_year_alt,
         l.l_orderkey AS order_key,
         CAST(l.l_linenumber AS BIGINT) AS line_number
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

ACT = """
act AS (
  SELECT user_id AS actor_id, CAST(ts AS DATE) AS event_date, event_type AS channel,
         value, event_id
  FROM events
)"""

AFFL = """
affl AS (
  SELECT actor_id, org_id, n_rows,
         row_number() OVER (PARTITION BY actor_id ORDER BY n_rows DESC, org_id) AS org_rank
  FROM (SELECT ev.actor_id, s.s_nationkey AS org_id, count(*) AS n_rows
        FROM ev JOIN supplier s ON ev.subject_id = s.s_suppkey
        GROUP BY 1, 2) x
)"""

PROFILE = """
first_ord AS (
  SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS code3
  FROM orders GROUP BY o_custkey
),
profile AS (
  SELECT c.c_custkey AS actor_id, c.c_mktsegment AS code1, r.r_name AS code2, f.code3
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN first_ord f ON c.c_custkey = f.o_custkey
)"""


# The product classes of the test tables; null classes are UNKNOWN, unlisted ones OTHER.
CLASSES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "UNKNOWN", "OTHER")
CLASS_SQL = (f"(CASE WHEN coalesce(product_group, 'UNKNOWN') IN {CLASSES[:-1]} "
             "THEN coalesce(product_group, 'UNKNOWN') ELSE 'OTHER' END)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
