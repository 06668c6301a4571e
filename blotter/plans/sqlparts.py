"""DuckDB SQL fragments shared by the oracle statements.

They restate, in plain SQL, the role mapping of :mod:`blotter.plans.tables`
and the fixed lookups, so each oracle is an independent formulation of the
same question.
"""

from blotter.functions import fixed

INCIDENTS = """
incidents AS (
  SELECT event_id AS "ID", ts AS "Date", upper(event_type) AS "Primary Type",
         event_type AS "Description",
         'K' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS "Location Description",
         (event_type = 'error') AS "Arrest", (value >= 100) AS "Domestic",
         CAST(user_id AS INTEGER) AS "Beat", CAST(user_id AS DOUBLE) AS "District",
         CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS "Ward",
         CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS "Community Area",
         CAST(year(ts) AS INTEGER) AS "Year", value AS "Latitude",
         CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS "Longitude"
  FROM events
)"""

DOCS_LABELLED = """
docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def season_case(month_expr: str) -> str:
    parts = []
    for season in fixed.SEASON_ORDER:
        months = ", ".join(str(m) for m, s in fixed.SEASON_OF_MONTH.items() if s == season)
        parts.append(f"WHEN {month_expr} IN ({months}) THEN '{season}'")
    return "CASE " + " ".join(parts) + " END"


def severity_case(type_expr: str) -> str:
    parts = [f"WHEN {type_expr} = '{k}' THEN CAST({float(v)} AS DOUBLE)" for k, v in fixed.SEVERITY_OF_TYPE.items()]
    return "CASE " + " ".join(parts) + f" ELSE CAST({fixed.DEFAULT_SEVERITY} AS DOUBLE) END"


def ordinal_case(expr: str, order: list[str]) -> str:
    parts = [f"WHEN {expr} = '{name}' THEN {i}" for i, name in enumerate(order)]
    return "CAST(CASE " + " ".join(parts) + " ELSE 0 END AS INTEGER)"


def weekday(ts: str) -> str:
    return f"CAST(isodow({ts}) - 1 AS INTEGER)"


def bin_sum(x: str, mn: str, step: str, bins: int) -> str:
    """Right-closed equal-width bin: count of inner edges i*step+mn below x."""
    terms = [f"CAST({x} > CAST({i} AS DOUBLE) * {step} + {mn} AS INTEGER)" for i in range(1, bins)]
    return "(" + " + ".join(terms) + ")"


def principal_components(k: int, squarings: int = 30) -> str:
    """CTEs over x(id, v): z(id, z) standardised rows, eig(k, lam, v, total) the first k eigenpairs of their correlation matrix.

    The matrix is squared until one direction is left, which is then taken out of it.  The largest entry of a vector is
    positive, as the column with the greatest diagonal element is taken.  A null direction has lam 0 and no vector.
    """
    square = "list_transform(b, lambda r: list_transform(b, lambda q: list_dot_product(r, q)))"
    trace = "list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))"
    return f"""
u AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM x),
mom AS (SELECT i, avg(x) AS mu, CASE WHEN max(x) > min(x) THEN stddev_pop(x) ELSE 0 END AS sd FROM u GROUP BY i),
zu AS (SELECT id, i, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END AS z FROM u JOIN mom USING (i)),
z AS (SELECT id, list(z ORDER BY i) AS z FROM zu GROUP BY id),
pairs AS (SELECT p.i, q.i AS j, avg(p.z * q.z) AS s FROM zu p JOIN zu q ON p.id = q.id GROUP BY ALL),
mat AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS r FROM pairs GROUP BY i)),
pow(k, it, a, b, lam, v) AS (
  SELECT 1, 0, a, a, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE[]) FROM mat
  UNION ALL
  SELECT CASE WHEN it = {squarings} + 1 THEN k + 1 ELSE k END, CASE WHEN it = {squarings} + 1 THEN 0 ELSE it + 1 END,
    CASE WHEN it = {squarings} + 1 THEN rest ELSE a END,
    CASE WHEN it = {squarings} + 1 THEN rest WHEN t > 0 THEN list_transform(sq, lambda r: list_transform(r, lambda e: e / t)) ELSE b END,
    CASE WHEN it = {squarings} THEN COALESCE(list_dot_product(w, list_transform(a, lambda r: list_dot_product(r, w))), 0) END,
    CASE WHEN it = {squarings} THEN w END
  FROM (
    SELECT *, {trace.format(m='sq')} AS t,
      CASE WHEN it = {squarings} AND g > 0 THEN list_transform(b[d], lambda e: e / sqrt(g)) END AS w,
      CASE WHEN it = {squarings} + 1 THEN CASE WHEN lam > 1e-12 THEN list_transform(range(1, len(a) + 1),
        lambda i: list_transform(range(1, len(a) + 1), lambda j: a[i][j] - lam * v[i] * v[j])) ELSE a END END AS rest
    FROM (
      SELECT *, CASE WHEN it < {squarings} THEN {square} ELSE b END AS sq,
        list_max(diag) AS g, list_position(diag, list_max(diag)) AS d
      FROM (SELECT *, list_transform(range(1, len(b) + 1), lambda i: b[i][i]) AS diag FROM pow WHERE k <= {k})))
  WHERE k < {k} OR it <= {squarings}),
eig AS (SELECT k, greatest(lam, 0) AS lam, v, (SELECT {trace.format(m='a')} FROM mat) AS total FROM pow WHERE it = {squarings} + 1)"""
