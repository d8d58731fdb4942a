"""Building blocks of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from wavemill.functions.hashing import (
    INCREMENTS,
    MODULUS,
    MULTIPLIERS,
    STRIDE,
    poisson_cuts,
)
from wavemill.plans.inputs import EVENT_TYPES, FIRST_YEAR, YEARS


def with_parts(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def embedding_ranks() -> str:
    return """ranks AS (
  SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)"""


def embedding_cells(name: str = "cells") -> list[str]:
    return [
        embedding_ranks(),
        f"""{name} AS (
  SELECT *, CAST(max(i) OVER (PARTITION BY matrix_id) + 1 AS INTEGER) AS m FROM (
    SELECT label::VARCHAR AS matrix_id, r::INTEGER AS i,
      unnest(range(len(embedding)))::INTEGER AS j, unnest(embedding)::DOUBLE AS v, len(embedding)::INTEGER AS n
    FROM ranks))""",
    ]


def user_cells(name: str = "cells") -> list[str]:
    return [
        f"""{name} AS (
  SELECT u.user_id::VARCHAR AS matrix_id, 7 AS m, 24 AS n, a.i::INTEGER AS i, b.j::INTEGER AS j, coalesce(s.v, 0.0) AS v
  FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(7)) AS i) a, (SELECT unnest(range(24)) AS j) b
  LEFT JOIN (SELECT user_id, dayofweek(ts) AS i, hour(ts) AS j, sum(value) AS v FROM events GROUP BY ALL) s
    ON s.user_id = u.user_id AND s.i = a.i AND s.j = b.j)"""
    ]


def supplier_cells(name: str = "cells", key: str = "l_suppkey::VARCHAR", extra: str = "") -> list[str]:
    return [
        f"""{name}_sums AS (
  SELECT {key} AS matrix_id, month(l_shipdate) - 1 AS i, year(l_shipdate) - {FIRST_YEAR} AS j,
    sum(l_quantity) AS v, sum(l_extendedprice * l_discount) AS g FROM lineitem GROUP BY ALL)""",
        f"""{name} AS (
  SELECT u.matrix_id, 12 AS m, {YEARS} AS n, a.i::INTEGER AS i, b.j::INTEGER AS j,
    coalesce(s.v, 0.0) AS v, coalesce(s.g, 0.0) AS g
  FROM (SELECT DISTINCT matrix_id FROM {name}_sums) u, (SELECT unnest(range(12)) AS i) a,
    (SELECT unnest(range({YEARS})) AS j) b
  LEFT JOIN {name}_sums s ON s.matrix_id = u.matrix_id AND s.i = a.i AND s.j = b.j)""",
    ]


def _scale(k: str, size: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN sqrt(1.0 / {size}) ELSE sqrt(2.0 / {size}) END)"


def _wave(k: str, i: str, size: str) -> str:
    return f"cos(pi() * (2 * {i} + 1) * {k} / (2.0 * {size}))"


def forward(source: str, out: str, values: dict[str, str] | None = None) -> list[str]:
    """Cells (matrix_id, m, n, i, j, <value>) to coefficients (matrix_id, m, n, k, l, <name>)."""
    values = values or {"c": "v"}
    first = ", ".join(f"sum(x.{v} * {_wave('t.l', 'x.j', 'x.n')}) * {_scale('t.l', 'x.n')} AS {c}" for c, v in values.items())
    second = ", ".join(f"sum(x.{c} * {_wave('t.k', 'x.i', 'x.m')}) * {_scale('t.k', 'x.m')} AS {c}" for c in values)
    return [
        f"{out}_half AS (SELECT x.matrix_id, x.m, x.n, x.i, t.l, {first} FROM {source} x, unnest(range(x.n)) AS t(l) "
        "GROUP BY x.matrix_id, x.m, x.n, x.i, t.l)",
        f"{out} AS MATERIALIZED (SELECT x.matrix_id, x.m, x.n, t.k::INTEGER AS k, x.l::INTEGER AS l, {second} "
        f"FROM {out}_half x, unnest(range(x.m)) AS t(k) GROUP BY x.matrix_id, x.m, x.n, t.k, x.l)",
    ]


def inverse(source: str, out: str, values: dict[str, str]) -> list[str]:
    """Coefficients to cells; ``values`` maps output names to expressions over ``x``."""
    first = ", ".join(f"sum(({e}) * {_scale('x.l', 'x.n')} * {_wave('x.l', 't.j', 'x.n')}) AS {v}" for v, e in values.items())
    second = ", ".join(f"sum(x.{v} * {_scale('x.k', 'x.m')} * {_wave('x.k', 't.i', 'x.m')}) AS {v}" for v in values)
    return [
        f"{out}_half AS (SELECT x.matrix_id, x.m, x.n, x.k, t.j, {first} FROM {source} x, unnest(range(x.n)) AS t(j) "
        "GROUP BY x.matrix_id, x.m, x.n, x.k, t.j)",
        f"{out} AS MATERIALIZED (SELECT x.matrix_id, x.m, x.n, t.i::INTEGER AS i, x.j::INTEGER AS j, {second} "
        f"FROM {out}_half x, unnest(range(x.m)) AS t(i) GROUP BY x.matrix_id, x.m, x.n, t.i, x.j)",
    ]


def profile(source: str, out: str, c: str = "c", share: str = "share") -> str:
    return (f"{out} AS (SELECT *, {c} * {c} / (sum({c} * {c}) OVER (PARTITION BY matrix_id) + 1e-12::DOUBLE) AS {share} "
            f"FROM {source})")


def energy(source: str, out: str, tau: float, share: str = "share", keep: str = "keep", by: str = "matrix_id") -> str:
    return (f"{out} AS (SELECT *, sum({share}) OVER (PARTITION BY {by} ORDER BY {share} DESC, k, l ROWS UNBOUNDED PRECEDING) "
            f"<= {tau}::DOUBLE * sum({share}) OVER (PARTITION BY {by}) AS {keep} FROM {source})")


def largest(source: str, out: str, count: str, c: str, keep: str = "keep", by: str = "matrix_id") -> str:
    return (f"{out} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY abs({c}) DESC, k, l) <= {count} AS {keep} "
            f"FROM {source})")


def quarter() -> str:
    return "greatest(1, floor(m * n * 0.25::DOUBLE))"


def fidelity(v: str, approx: str) -> str:
    return (f"least(greatest(1.0 - sqrt(sum(({v} - {approx}) * ({v} - {approx}))) / greatest(sqrt(sum({v} * {v})), "
            "1e-8::DOUBLE), 0.0), 1.0)")


def ratio(keep: str) -> str:
    return f"1.0 / greatest(avg({keep}::INTEGER), 1e-3::DOUBLE)"


def u32(seed, *parts: str) -> str:
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {joined})), 1, 8))::BIGINT"


def gaussian(seed, *parts: str) -> str:
    u1 = f"(1.0 - {u32(str(seed) + ':a', *parts)} / 4294967296.0::DOUBLE)"
    u2 = f"({u32(str(seed) + ':b', *parts)} / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def key_pair(seed, *parts: str) -> str:
    """Columns ``base`` and ``base2``: the 30-bit state of a key's draws."""
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    digest = f"md5(concat_ws(':', '{seed}', {joined}))"
    return f"('0x' || substr({digest}, 1, 8))::BIGINT >> 2 AS base, ('0x' || substr({digest}, 9, 8))::BIGINT >> 2 AS base2"


def scrambled(source: str, out: str, columns: str, draws: str = "1000", b: str = "b") -> list[str]:
    """From rows with ``base`` and ``base2``, ``draws`` rows each with draw ``b`` and scrambled ``x``."""
    p = MODULUS
    return [
        f"{out}_0 AS (SELECT {columns}, base2, t.{b}, (base + t.{b} * {STRIDE}) % {p} AS x FROM {source}, unnest(range({draws})) AS t({b}))",
        f"{out}_1 AS (SELECT {columns}, base2, {b}, (x * x + {INCREMENTS[0]}) % {p} AS x FROM {out}_0)",
        f"{out}_2 AS (SELECT {columns}, {b}, (x * {MULTIPLIERS[0]} + {b} + base2) % {p} AS x FROM {out}_1)",
        f"{out}_3 AS (SELECT {columns}, {b}, (x * x + {INCREMENTS[1]}) % {p} AS x FROM {out}_2)",
        f"{out} AS (SELECT {columns}, {b}, (x * {MULTIPLIERS[1]}) % {p} AS x FROM {out}_3)",
    ]


def poisson(x: str) -> str:
    return "(" + " + ".join(f"({x} >= {cut})::INTEGER" for cut in poisson_cuts()) + ")"


def _simpson(low: str, high: str, f) -> str:
    step = f"(({high}) - ({low})) / 2000.0"
    point = f"(({low}) + {step} * q)"
    weight = "(CASE WHEN q = 0 OR q = 2000 THEN 1.0 WHEN q % 2 = 1 THEN 4.0 ELSE 2.0 END)::DOUBLE"
    return f"(list_sum(list_transform(range(2001), lambda q: {weight} * {f(point)})) * {step} / 3.0)"


def normal_two_sided(z: str) -> str:
    area = _simpson(f"abs({z})", f"abs({z}) + 10.0", lambda x: f"exp(-{x} * {x} / 2.0)")
    return f"(2.0 / sqrt(2.0 * pi()) * {area})"


def t_two_sided(t: str, df: str) -> str:
    def power(x):
        return f"pow(greatest(cos({x}), 0.0), {df} - 1.0)"

    end = f"least(pi() / 2.0, 40.0 / sqrt({df}))"
    tail = _simpson(f"least(atan(abs({t}) / sqrt({df})), {end})", end, power)
    whole = _simpson("0.0::DOUBLE", end, power)
    return f"(CASE WHEN ({t}) IS NOT NULL THEN {tail} / {whole} END)"


def event_results(name: str = "results", seed: str = "user_id") -> str:
    return (f"{name} AS MATERIALIZED (SELECT event_type AS method, ({seed})::BIGINT AS seed, avg(value) AS value "
            "FROM events GROUP BY ALL)")


def tensor_cells(name: str = "tensor") -> list[str]:
    kinds = ", ".join(f"('{e}', {n})" for n, e in enumerate(EVENT_TYPES))
    return [
        f"kinds AS (SELECT * FROM (VALUES {kinds}) AS t(event_type, head))",
        """tensor_sums AS (SELECT dayofmonth(ts) - 1 AS layer, head, hour(ts) // 6 AS i, hour(ts) % 6 AS j, sum(value) AS v
  FROM events JOIN kinds USING (event_type) GROUP BY ALL)""",
        f"""{name} AS (SELECT a.layer, b.head, c.i, d.j, coalesce(s.v, 0.0) AS v
  FROM (SELECT unnest(range(31)) AS layer) a, (SELECT unnest(range({len(EVENT_TYPES)})) AS head) b,
    (SELECT unnest(range(4)) AS i) c, (SELECT unnest(range(6)) AS j) d
  LEFT JOIN tensor_sums s ON s.layer = a.layer AND s.head = b.head AND s.i = c.i AND s.j = d.j)""",
    ]


def axis(source: str, out: str, name: str, size: int) -> str:
    """One-axis transform of tensor cells along layer or head."""
    columns = ["layer", "head", "i", "j"]
    selected = ", ".join(f"t.f AS {c}" if c == name else f"x.{c} AS {c}" for c in columns)
    grouped = ", ".join("t.f" if c == name else f"x.{c}" for c in columns)
    return (f"{out} AS MATERIALIZED (SELECT {selected}, sum(x.v * {_wave('t.f', 'x.' + name, str(size))}) * {_scale('t.f', str(size))} "
            f"AS v FROM {source} x, unnest(range({size})) AS t(f) GROUP BY {grouped})")


def leading(source: str, out: str, rank: int, squarings: int = 14) -> list[str]:
    """The ``rank`` leading directions of matrices given as cells, one after the other (needs WITH RECURSIVE).

    ``out``: matrix_id, captured (energy along them), vs (list of directions). The products of column pairs are squared until
    one direction is left, which is then taken out on both sides.
    """
    turn = squarings + 1
    return [
        f"{out}_rows AS (SELECT matrix_id, i, list(v ORDER BY j) AS w FROM {source} GROUP BY matrix_id, i)",
        f"""{out}_products AS (SELECT a.matrix_id, a.j AS i, b.j AS j, sum(a.v * b.v) AS v
  FROM {source} a JOIN {source} b ON a.matrix_id = b.matrix_id AND a.i = b.i GROUP BY ALL)""",
        f"""{out}_grams AS MATERIALIZED (SELECT matrix_id, list(w ORDER BY i) AS g
  FROM (SELECT matrix_id, i, list(v ORDER BY j) AS w FROM {out}_products GROUP BY matrix_id, i) GROUP BY matrix_id)""",
        f"""{out}_walk AS (
  SELECT matrix_id, 0 AS step, g, g AS p, 0.0::DOUBLE AS captured, []::DOUBLE[][] AS vs FROM {out}_grams
  UNION ALL
  SELECT matrix_id, step + 1,
    CASE WHEN step % {turn} < {squarings} THEN g ELSE taken END,
    CASE WHEN step % {turn} < {squarings} THEN list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b) / size)) ELSE taken END,
    CASE WHEN step % {turn} < {squarings} THEN captured ELSE captured + list_dot_product(v, gv) END,
    CASE WHEN step % {turn} < {squarings} THEN vs ELSE list_append(vs, v) END
  FROM (SELECT *, list_transform(g, lambda a, x: list_transform(a, lambda e, y:
      e - v[x] * gv[y] - gv[x] * v[y] + list_dot_product(v, gv) * v[x] * v[y])) AS taken
    FROM (SELECT *, list_transform(g, lambda a: list_dot_product(a, v)) AS gv
      FROM (SELECT *, list_transform(column_, lambda x: x / sqrt(list_dot_product(column_, column_))) AS v
        FROM (SELECT *, p[list_position(diagonal, list_max(diagonal))] AS column_
          FROM (SELECT *, list_sum(list_transform(p, lambda a: list_dot_product(a, a))) AS size,
            list_transform(range(1, len(p) + 1), lambda x: p[x][x]) AS diagonal FROM {out}_walk WHERE step < {rank * turn}))))))""",
        f"{out} AS MATERIALIZED (SELECT matrix_id, captured, vs FROM {out}_walk WHERE step = {rank * turn})",
    ]
