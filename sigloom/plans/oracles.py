"""DuckDB SQL for the registered queries, written from the definitions and not from the operators."""

from __future__ import annotations

#: Families in order, whether an atom has a sine and a cosine, parameters, the outer one first. Written out here
#: on its own, so that a wrong grid of the dictionary shows.
GRIDS: list[tuple[str, bool, dict[str, list[float]]]] = [
    ("CHIRP", True, {"f0": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7], "beta": [-0.005, -0.001, 0.0, 0.001, 0.005]}),
    ("MORLET", True, {"sigma": [0.03, 0.07, 0.15], "mu": [0.2, 0.4, 0.6, 0.8], "w": [10.0, 18.0, 26.0]}),
    ("DAMPED", True, {"alpha": [0.05, 0.15, 0.3, 0.6, 1.2], "f0": [0.03, 0.06, 0.12, 0.25]}),
    ("BSPLINE", False, {"scale": [0.05, 0.1, 0.2, 0.4], "position": [0.1, 0.25, 0.4, 0.55, 0.7, 0.85], "order": [3.0]}),
    ("ANTI_DAMPED", True, {"alpha": [0.05, 0.15, 0.3], "f0": [0.05, 0.1, 0.2]}),
    ("SIGMOID", False, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.5, 0.8], "up": [1.0, 0.0]}),
    ("CHEBYSHEV", False, {"order": [1.0, 2.0, 3.0, 4.0, 5.0]}),
    ("DOUBLE_SIGMOID", False, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.4, 0.6, 0.8], "t1": [0.3, 0.5, 0.7, 0.9]}),
    ("GAUSSIAN", False, {"mu": [0.1, 0.3, 0.5, 0.7, 0.9], "sigma": [0.03, 0.06, 0.1, 0.15, 0.2]}),
    ("ERF", False, {"mu": [0.2, 0.4, 0.6, 0.8], "sigma": [0.05, 0.1, 0.2, 0.3]}),
    ("DAMPED_CHIRP", True, {"alpha": [0.1, 0.5, 1.0, 2.0], "f0": [0.01, 0.05, 0.1, 0.2, 0.4], "beta": [-0.01, -0.005, 0.0, 0.005, 0.01]}),
    ("SIGMOID_OSC", True, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.5, 0.8], "f": [0.05, 0.1, 0.2, 0.3]}),
    ("EXP_GROWTH", False, {"alpha": [0.1, 0.5, 1.0, 2.0]}),
    ("EXP_DECAY", False, {"alpha": [0.1, 0.5, 1.0, 2.0, 5.0]}),
    ("TANH", False, {"k": [5.0, 10.0, 20.0, 50.0], "t0": [0.2, 0.5, 0.8]}),
    ("LORENTZIAN", False, {"mu": [0.2, 0.4, 0.6, 0.8], "gamma": [0.02, 0.05, 0.1, 0.15]}),
    ("POWER", False, {"alpha": [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]}),
    ("HAAR", False, {}),
    ("BESSEL", False, {"order": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]}),
]

EVENTS = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS y FROM events"""
Q = "abs({a}[CAST(floor(0.25 * len({a})) AS BIGINT) + 1] - {a}[CAST(floor(0.75 * len({a})) AS BIGINT) + 1]) / 1.349"


def block_sigma(size: int, hop: int, refine: int, middle: bool = False, source: str = "s") -> str:
    """CTE body: user_id, block, sigma; a middle scale is cut to the length of the series."""
    low = f"greatest(0, CAST(floor((i - {size}) / {hop}) AS BIGINT) + 1)"
    high = f"least(greatest(1, CAST(floor((n - {size} + {hop}) / {hop}) AS BIGINT)) - 1, CAST(floor(i / {hop}) AS BIGINT))"
    if middle:
        low, high = f"CASE WHEN n < {size} THEN 0 ELSE {low} END", f"CASE WHEN n < {size} THEN 0 ELSE {high} END"
    q = Q.format(a="a")
    sql = f"""SELECT user_id, block, a, CASE WHEN len(a) < 4 THEN 1e-9 ELSE greatest({q}, 1e-9) END AS f, CASE WHEN len(a) < 4 THEN 1e-9 ELSE greatest({q}, 1e-9) END AS sigma, len(a) >= 4 AS ok FROM (
      SELECT user_id, block, list(y ORDER BY y DESC) AS a FROM (SELECT user_id, y, unnest(range({low}, {high} + 1)) AS block FROM {source} WHERE n >= 4) GROUP BY ALL)"""
    for _ in range(refine):
        sql = f"""SELECT user_id, block, a, f, ok AND len(a) >= 4 AS ok, CASE WHEN NOT (ok AND len(a) >= 4) THEN f WHEN {q} > 1e-9 THEN {q} ELSE sigma END AS sigma FROM (
      SELECT user_id, block, f, sigma, ok, CASE WHEN ok THEN list_filter(a, lambda x: abs(x - a[len(a) // 2 + 1]) < 3.0 * sigma) ELSE a END AS a FROM ({sql}))"""
    return f"SELECT user_id, block, sigma FROM ({sql})"


def multiscale(source: str = "s") -> str:
    def scale(body: str) -> str:
        return f"SELECT user_id, greatest(sum(sigma / (sigma * sigma + 1e-9)) / sum(1 / (sigma * sigma + 1e-9)), 1e-9) AS sigma FROM ({body}) GROUP BY user_id"

    scales = " UNION ALL ".join((scale(block_sigma(8, 4, 2, source=source)), scale(block_sigma(32, 16, 2, middle=True, source=source)), scale(block_sigma(64, 32, 2, source=source))))
    return f"""SELECT user_id, greatest((1e-9 + sum(sigma / (sigma + 1e-9))) / sum(1 / (sigma + 1e-9)), 1e-9) AS sigma FROM ({scales}) GROUP BY user_id
      UNION ALL SELECT DISTINCT user_id, 1e-9 FROM {source} WHERE n < 4"""


def frames(size: int, hop: int, source: str = "s") -> str:
    """CTE body: user_id, frame_start, pos, y."""
    z, h = f"least({size}, n)", f"least({hop}, least({size}, n))"
    return f"""SELECT user_id, k * {h} AS frame_start, i - k * {h} AS pos, y, {z} AS m FROM (
      SELECT *, unnest(range(greatest(0, CAST(floor((i - {z}) / {h}) AS BIGINT) + 1), least(CAST(floor((n - {z} + {h}) / {h}) AS BIGINT) - 1, CAST(floor(i / {h}) AS BIGINT)) + 1)) AS k FROM {source})"""


TICKS = """SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i,
  l_extendedprice / l_quantity AS price, l_quantity AS volume, l_shipdate AS ts FROM lineitem"""
EVENT_TICKS = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS volume, ts
  FROM events WHERE value > 0 AND json_extract_string(props, '$.k') IS NOT NULL"""


def bars(ticks: str, key: str, threshold: float, dollar: bool = False, adaptive: bool = False, spike: float | None = None, ewma: float = 0.005, least: float = 100.0, most: float = 100000.0) -> str:
    """WITH text ending in a CTE `bars`: key, bar_idx, open, high, low, close, volume, vwap, ts."""
    size = "t.price * t.volume" if dollar else "t.volume"
    ok = "TRUE" if spike is None else f"(NOT f.started OR abs(t.price - f.c) / (f.c + 1e-12) <= {spike})"
    closed = "ok AND v >= thr"
    new = f"least(greatest({ewma} * v + (1 - {ewma}) * thr, {least}), {most})" if adaptive else "thr"
    return f"""WITH RECURSIVE t AS ({ticks}), f AS (
      SELECT DISTINCT {key} AS s, CAST(0 AS BIGINT) AS i, FALSE AS started, 0.0::DOUBLE AS o, 0.0::DOUBLE AS h, 0.0::DOUBLE AS l, 0.0::DOUBLE AS c, 0.0::DOUBLE AS v, 0.0::DOUBLE AS pv, {threshold}::DOUBLE AS thr, CAST(0 AS BIGINT) AS nb,
        FALSE AS shut, 0.0::DOUBLE AS bo, 0.0::DOUBLE AS bh, 0.0::DOUBLE AS bl, 0.0::DOUBLE AS bc, 0.0::DOUBLE AS bv, 0.0::DOUBLE AS bw, CAST(NULL AS TIMESTAMP) AS bt FROM t
      UNION ALL
      SELECT s, i, started OR ok, CASE WHEN {closed} THEN price ELSE o END, CASE WHEN {closed} THEN price ELSE h END, CASE WHEN {closed} THEN price ELSE l END, CASE WHEN {closed} THEN price ELSE c END,
        CASE WHEN {closed} THEN 0.0 ELSE v END, CASE WHEN {closed} THEN 0.0 ELSE pv END, CASE WHEN {closed} THEN {new} ELSE thr END, nb + CASE WHEN {closed} THEN 1 ELSE 0 END,
        {closed}, o, h, l, c, v, CASE WHEN v > 0 THEN pv / v ELSE c END, ts
      FROM (
        SELECT f.s, t.i, f.started, {ok} AS ok, t.price, t.ts, f.thr, f.nb,
          CASE WHEN NOT {ok} THEN f.o WHEN f.started THEN f.o ELSE t.price END AS o, CASE WHEN NOT {ok} THEN f.h WHEN f.started THEN greatest(f.h, t.price) ELSE t.price END AS h,
          CASE WHEN NOT {ok} THEN f.l WHEN f.started THEN least(f.l, t.price) ELSE t.price END AS l, CASE WHEN NOT {ok} THEN f.c ELSE t.price END AS c,
          CASE WHEN NOT {ok} THEN f.v ELSE f.v + {size} END AS v, CASE WHEN NOT {ok} THEN f.pv ELSE f.pv + t.price * ({size}) END AS pv
        FROM f JOIN t ON t.{key} = f.s AND t.i = f.i + 1)
    ), bars AS (SELECT s AS {key}, nb - 1 AS bar_idx, bo AS open, bh AS high, bl AS low, bc AS close, bv AS volume, bw AS vwap, bt AS ts FROM f WHERE shut)"""


def bar_columns(key: str, source: str = "bars") -> str:
    return f"SELECT {key}, bar_idx, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume, vwap FROM {source}"


CLAMPS = {
    "CHIRP": {"f0": (0.001, 0.49), "beta": (-0.01, 0.01)}, "MORLET": {"sigma": (0.001, 0.5), "w": (1, 50)}, "DAMPED": {"alpha": (0, 5), "f0": (0.001, 0.49)}, "ANTI_DAMPED": {"alpha": (0, 5), "f0": (0.001, 0.49)},
}


def wave(x: str) -> str:
    return f"(CASE WHEN use_sin THEN sin({x}) ELSE cos({x}) END)"


def _cubic(j: str) -> str:
    x = f"abs(-2.0 + 4.0 * ({j}) / 1023.0)"
    return f"(CASE WHEN {x} < 1 THEN 2.0 / 3.0 - {x} * {x} + 0.5 * {x} * {x} * {x} WHEN {x} < 2 THEN pow(2.0 - {x}, 3) / 6.0 ELSE 0.0 END)"


_SPLINE_AT = "((t - position) / scale * 1023.0)"
_ERF_X = "((t - mu) / (sigma * sqrt(2.0)))"
_ERF_S = f"({_ERF_X} * {_ERF_X})"
FORMULAS = {
    "CHIRP": wave("2 * pi() * (f0 * t + beta * t * t)"),
    "MORLET": f"exp(-pow((t - mu) / sigma, 2) / 2) * {wave('2 * pi() * w * (t - mu)')}",
    "DAMPED": f"exp(-alpha * t) * {wave('2 * pi() * f0 * t')}",
    "ANTI_DAMPED": f"exp(alpha * t) * {wave('2 * pi() * f0 * t')}",
    "BSPLINE": f"CASE WHEN floor({_SPLINE_AT}) < 0 OR floor({_SPLINE_AT}) + 1 >= 1024 THEN 0.0 ELSE (1 - ({_SPLINE_AT} - floor({_SPLINE_AT}))) * {_cubic(f'floor({_SPLINE_AT})')} + ({_SPLINE_AT} - floor({_SPLINE_AT})) * {_cubic(f'(floor({_SPLINE_AT}) + 1)')} END",
    "SIGMOID": "CASE WHEN up = 1 THEN 1 / (1 + exp(-k * (t - t0))) ELSE 1 - 1 / (1 + exp(-k * (t - t0))) END",
    "CHEBYSHEV": 'cos("order" * acos(2 * t - 1))',
    "DOUBLE_SIGMOID": "1 / (1 + exp(-k * (t - t0))) - 1 / (1 + exp(-k * (t - t1)))",
    "GAUSSIAN": "exp(-pow((t - mu) / sigma, 2) / 2)",
    "ERF": f"0.5 * (1 + sign({_ERF_X}) * sqrt(1 - exp(-{_ERF_S} * (4 / pi() + 0.147 * {_ERF_S}) / (1 + 0.147 * {_ERF_S}))))",
    "DAMPED_CHIRP": f"exp(-alpha * t) * {wave('2 * pi() * (f0 * t + 0.5 * beta * t * t)')}",
    "SIGMOID_OSC": f"1 / (1 + exp(-k * (t - t0))) * {wave('2 * pi() * f * t')}",
    "EXP_GROWTH": "exp(alpha * t)",
    "EXP_DECAY": "exp(-alpha * t)",
    "TANH": "(exp(2 * k * (t - t0)) - 1) / (exp(2 * k * (t - t0)) + 1)",
    "LORENTZIAN": "gamma / (pow(t - mu, 2) + gamma * gamma)",
    "POWER": "pow(greatest(t, 1e-12), alpha)",
    "HAAR": "CASE WHEN t < 0.5 THEN 1.0 ELSE -1.0 END",
    "BESSEL": 'list_sum(list_transform(range(40), lambda m: pow(-1, m) * pow(10 * t, 2 * m + "order") / (gamma(m + 1) * gamma(m + "order" + 1))))',
}


def family_specs(kind: str) -> str:
    """atom_index, atom_type, use_sin and the family's parameters."""
    base = 0
    for name, pair, grid in GRIDS:
        count = 1
        for values in grid.values():
            count *= len(values)
        if name == "DOUBLE_SIGMOID":
            count = 3 * sum(b > a for a in grid["t0"] for b in grid["t1"])
        if name == kind:
            break
        base += count * (1 + pair)
    parts = " CROSS JOIN ".join(f"(SELECT unnest([{', '.join(f'{v!r}::DOUBLE' for v in values)}]) AS \"{p}\", unnest(range({len(values)})) AS o{k})" for k, (p, values) in enumerate(grid.items())) or "(SELECT 0 AS o0)"
    order = ", ".join(f"o{k}" for k in range(max(1, len(grid))))
    where = "WHERE t1 > t0" if kind == "DOUBLE_SIGMOID" else ""
    names = "".join(f', "{p}"' for p in grid)
    twice = f"SELECT *, unnest([0, 1]) AS m FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS r{names} FROM {parts} {where})" if pair else f"SELECT *, 0 AS m FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS r{names} FROM {parts} {where})"
    return f"SELECT CAST({base} + r * {1 + pair} + m AS INTEGER) AS atom_index, '{kind}' AS atom_type, m = 0 AS use_sin{names} FROM ({twice})"


def family_atoms(kind: str, n: int) -> str:
    """atom_index, i, v (unit length) and norm."""
    grid = next(g for name, _, g in GRIDS if name == kind)
    clamps = CLAMPS.get(kind, {})
    columns = "".join(f', least(greatest("{p}", {clamps[p][0]}), {clamps[p][1]}) AS "{p}"' if p in clamps else f', "{p}"' for p in grid)
    raw = f"SELECT atom_index, i, {FORMULAS[kind]} AS v FROM (SELECT atom_index, use_sin{columns}, i, i / {n - 1}.0::DOUBLE AS t FROM ({family_specs(kind)}), (SELECT unnest(range({n})) AS i))"
    return f"SELECT atom_index, i, v / norm AS v, norm FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY atom_index)) AS norm FROM ({raw}))"


def atoms(indices: list[int], n: int) -> str:
    """The named atoms, whatever their families."""
    wanted = ", ".join(map(str, indices))
    return " UNION ALL ".join(f"SELECT atom_index, i, v FROM ({family_atoms(kind, n)}) WHERE atom_index IN ({wanted})" for kind, _, _ in GRIDS)


def all_specs() -> str:
    names = ["alpha", "beta", "f", "f0", "gamma", "k", "mu", "order", "position", "scale", "sigma", "t0", "t1", "up", "w"]
    return " UNION ALL ".join("SELECT atom_index, atom_type, use_sin, " + ", ".join(f'"{p}"' if p in grid else f'CAST(NULL AS DOUBLE) AS "{p}"' for p in names) + f" FROM ({family_specs(kind)})" for kind, _, grid in GRIDS)


EMBEDDED = "SELECT vec_id, unnest(embedding)::DOUBLE AS y, unnest(range(len(embedding))) AS i FROM embeddings"


def picks(indices: list[int], count: int, alpha: float = 0.1) -> str:
    """WITH text; CTEs b1, b2, ... hold vec_id, atom_index, amount, energy of each pick, r0, r1, ... the squared residuals."""
    sql = f"""WITH a AS ({atoms(indices, 64)}), e AS ({EMBEDDED}), g AS (SELECT x.atom_index AS j, z.atom_index AS k, sum(x.v * z.v) AS g FROM a x JOIN a z ON x.i = z.i GROUP BY ALL),
    s0 AS (SELECT vec_id, atom_index, sum(y * v) AS p, 0.0::DOUBLE AS c FROM e JOIN a USING (i) GROUP BY ALL), r0 AS (SELECT vec_id, sum(y * y) AS rr FROM e GROUP BY ALL)"""
    for k in range(1, count + 1):
        sql += f""", b{k} AS (SELECT vec_id, atom_index, p / (1 + {alpha} * c) AS amount, p * p / (1 + {alpha} * c) AS energy, p FROM s{k - 1}
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p * p / (1 + {alpha} * c) DESC, atom_index) = 1),
      s{k} AS (SELECT s.vec_id, s.atom_index, s.p - b.amount * g.g AS p, s.c + abs(g.g) AS c FROM s{k - 1} s JOIN b{k} b USING (vec_id) JOIN g ON g.j = s.atom_index AND g.k = b.atom_index),
      r{k} AS (SELECT vec_id, rr - 2 * amount * p + amount * amount AS rr FROM r{k - 1} JOIN b{k} USING (vec_id))"""
    return sql


def welch(size: int, hop: int, fft: int) -> str:
    """CTE body on s: user_id, bin, psd."""
    return f"""SELECT user_id, bin, CASE WHEN bin > 0 AND bin < {fft // 2} THEN 2.0 ELSE 1.0 END * avg(re * re + im * im) / {fft} AS psd FROM (
      SELECT user_id, frame_start, bin, sum(y * cos(2 * pi() * bin * pos / {fft})) AS re, sum(y * sin(2 * pi() * bin * pos / {fft})) AS im FROM (
        SELECT user_id, frame_start, pos, y * (0.54 - 0.46 * cos(2 * pi() * pos / {size - 1})) AS y, unnest(range({fft // 2 + 1})) AS bin FROM ({frames(size, hop, f'(SELECT * FROM s WHERE n >= {size})')}))
      GROUP BY ALL) GROUP BY user_id, bin"""


def golden(points: int, rounds: int, low: float, high: float) -> str:
    phi = (1 + 5**0.5) / 2
    t = "CASE WHEN n > 1 THEN 30.0 * i / (n - 1) ELSE 0.0 END"

    def energy(f: str) -> str:
        return f"(pow(sum(y * sin(2 * pi() * {f} * t)), 2) + pow(sum(y * cos(2 * pi() * {f} * t)), 2)) / (max(n) * max(n) / 4.0)"

    sql = f"""WITH s AS (SELECT *, {t} AS t FROM ({EVENTS})), g AS (SELECT unnest(range({points})) AS k, {low} + ({high} - {low}) * unnest(range({points})) / ({points} - 1) AS f),
    c AS (SELECT user_id, k, f, {energy('f')} AS e FROM s, g GROUP BY ALL), x0 AS (SELECT user_id, greatest({low}, f - {(high - low) / (points - 1)!r}) AS a, least({high}, f + {(high - low) / (points - 1)!r}) AS b FROM c
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e DESC, k) = 1)"""
    for k in range(1, rounds + 1):
        sql += f""", x{k} AS (SELECT user_id, CASE WHEN ec < ed THEN c ELSE a END AS a, CASE WHEN ec < ed THEN b ELSE d END AS b FROM (
        SELECT user_id, a, b, c, d, {energy('c')} AS ec, {energy('d')} AS ed FROM (SELECT user_id, a, b, b - (b - a) / {phi!r} AS c, a + (b - a) / {phi!r} AS d FROM x{k - 1}) JOIN s USING (user_id) GROUP BY user_id, a, b, c, d))"""
    return sql + f" SELECT user_id, round(greatest({low}, least({high}, (a + b) / 2)), 6) AS f FROM x{rounds}"


def rls(forgetting: float = 0.99, scale: float = 100.0) -> str:
    """The two-parameter recursion written out."""
    return f"""WITH RECURSIVE s AS ({EVENTS}), f AS (
      SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS y, 0.0::DOUBLE AS e, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1e6::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS q2, 1e6::DOUBLE AS r FROM s
      UNION ALL
      SELECT user_id, i, y, e, a + u / d * e, b + w / d * e, least((p - u / d * u) / {forgetting}, 1e9), least((q - u / d * w) / {forgetting}, 1e9), least((q2 - w / d * u) / {forgetting}, 1e9), least((r - w / d * w) / {forgetting}, 1e9) FROM (
        SELECT *, {forgetting} + u + w * x AS d FROM (
          SELECT f.user_id, s.i, s.y, s.y - (f.a + f.b * (s.i / {scale})) AS e, f.a, f.b, f.p, f.q, f.q2, f.r, s.i / {scale} AS x, f.p + f.q * (s.i / {scale}) AS u, f.q2 + f.r * (s.i / {scale}) AS w
          FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)))
    SELECT user_id, i, round(y - e, 4) + 0.0 AS trend, round(e, 4) + 0.0 AS residual FROM f WHERE i >= 0"""


def basis(n: int, poly: int, harm: int, morlet: int) -> str:
    """basis_index, i, v."""
    u = f"(i / {n - 1}.0::DOUBLE)"
    i = f"(SELECT unnest(range({n})) AS i)"
    parts = [f"SELECT b AS basis_index, i, cos(b * acos(2 * {u} - 1)) AS v FROM {i}, (SELECT unnest(range({poly})) AS b)"]
    for k in range(1, harm // 2 + 1):
        parts += [f"SELECT {poly + 2 * k - 2}, i, sin({k} * 30 * {u}) FROM {i}", f"SELECT {poly + 2 * k - 1}, i, cos({k} * 30 * {u}) FROM {i}"]
    for j in range(morlet):
        mu = j / (morlet - 1) * 30 if morlet > 1 else 15.0
        parts.append(f"SELECT {poly + 2 * (harm // 2) + j}, i, exp(-pow((30 * {u} - {mu}) / 1.5, 2) / 2) * cos(15.0 * (30 * {u} - {mu})) FROM {i}")
    return " UNION ALL ".join(parts)


def gram_schmidt(source: str, count: int, keys: list[str], last: str) -> str:
    """CTEs on `source` (keys, basis_index, i, v) ending in q, its first `count` rows made orthonormal one by one, twice over
    against rounding, and the final SELECT."""
    on = "USING (i" + "".join(f", {k}" for k in keys) + ")"
    head = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    sql, done = "", []
    for k in range(count):
        sql += f", g{k}_0 AS (SELECT {head}i, v FROM {source} WHERE basis_index = {k})"
        before = " UNION ALL ".join(f"SELECT {head}i, {j} AS j, v FROM q{j}" for j in range(k))
        for turn in range(2 if k else 0):
            sql += f""", c{k}_{turn} AS (SELECT {head}j, sum(x.v * p.v) AS c FROM g{k}_{turn} x JOIN ({before}) p {on} GROUP BY ALL),
      g{k}_{turn + 1} AS (SELECT {head}i, any_value(x.v) - sum(c * p.v) AS v FROM g{k}_{turn} x JOIN ({before}) p {on} JOIN c{k}_{turn} USING (j{"".join(f", {x}" for x in keys)}) GROUP BY {head}i)"""
        sql += f", q{k} AS (SELECT {head}i, v / sqrt(sum(v * v) OVER ({part})) AS v FROM g{k}_{2 if k else 0})"
        done.append(f"SELECT {head}CAST({k} AS BIGINT) AS basis_index, i, v FROM q{k}")
    return sql + f", q AS ({' UNION ALL '.join(done)}) " + last


def pursued(atoms_sql: str, count: int, gamma: float = 0.05, theta: float = 0.001, alpha: float = 0.1) -> str:
    """CTEs on e (vec_id, i, y) and sg (vec_id, sigma): the picks of each vector with both rules that stop it, as `events`
    (vec_id, pick, atom_index, amplitude, energy) and what is left of the squares as r0, r1, ..."""
    sql = f""", a AS ({atoms_sql}), g AS (SELECT x.atom_index AS j, z.atom_index AS k, sum(x.v * z.v) AS g FROM a x JOIN a z ON x.i = z.i GROUP BY ALL),
    s0 AS (SELECT vec_id, atom_index, sum(y * v) AS p, 0.0::DOUBLE AS c FROM e JOIN a USING (i) GROUP BY ALL), r0 AS (SELECT vec_id, sum(y * y) AS rr, CAST(NULL AS DOUBLE) AS was FROM e GROUP BY ALL)"""
    for k in range(1, count + 1):
        sql += f""", b{k} AS (SELECT vec_id, atom_index, amount, energy, p FROM (
        SELECT vec_id, atom_index, p / (1 + {alpha} * c) AS amount, p * p / (1 + {alpha} * c) AS energy, p FROM s{k - 1}
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p * p / (1 + {alpha} * c) DESC, atom_index) = 1) JOIN r{k - 1} USING (vec_id) JOIN sg USING (vec_id)
        WHERE energy >= {gamma} * sigma * sigma AND energy <> 0 AND NOT coalesce(1 - rr / (was + 1e-30) < {theta} * sigma * sigma, FALSE)),
      s{k} AS (SELECT s.vec_id, s.atom_index, s.p - b.amount * g.g AS p, s.c + abs(g.g) AS c FROM s{k - 1} s JOIN b{k} b USING (vec_id) JOIN g ON g.j = s.atom_index AND g.k = b.atom_index),
      r{k} AS (SELECT vec_id, rr - 2 * amount * p + amount * amount AS rr, rr AS was FROM r{k - 1} JOIN b{k} USING (vec_id))"""
    union = " UNION ALL ".join(f"SELECT vec_id, CAST({k - 1} AS BIGINT) AS pick, atom_index, amount AS amplitude, energy FROM b{k}" for k in range(1, count + 1))
    return sql + f", events AS ({union})"


def phased(pairs: list[int]) -> str:
    """CTE body on events: with the phase where both members of a pair (its even, sine member listed) were picked."""
    inside = ", ".join(map(str, [*pairs, *(p + 1 for p in pairs)]))
    return f"""SELECT v.*, CASE WHEN v.atom_index NOT IN ({inside}) OR o.a IS NULL THEN 0.0 WHEN v.atom_index % 2 = 0 THEN atan2(o.a, w.a) ELSE atan2(w.a, o.a) END AS phase FROM events v
      JOIN (SELECT vec_id, atom_index, sum(amplitude) AS a FROM events GROUP BY ALL) w USING (vec_id, atom_index)
      LEFT JOIN (SELECT vec_id, atom_index, sum(amplitude) AS a FROM events GROUP BY ALL) o ON o.vec_id = v.vec_id AND o.atom_index = CASE WHEN v.atom_index % 2 = 0 THEN v.atom_index + 1 ELSE v.atom_index - 1 END"""


def decomposed(size: int, hop: int, indices: list[int], pairs: list[int], count: int, source: str = "s", **stops: float) -> str:
    """CTEs on `source` (user_id, i, n, y): whole frames, their noise, their events with phases, as `found`."""
    return f""", fs AS (SELECT {{'u': user_id, 'f': frame_start}} AS user_id, pos AS i, m AS n, y FROM ({frames(size, hop, source)}) WHERE m = {size}),
    sg AS (SELECT user_id AS vec_id, sigma FROM ({multiscale('fs')})), e AS (SELECT user_id AS vec_id, i, y FROM fs){pursued(atoms(indices, size), count, **stops)}, found AS ({phased(pairs)}) """


#: Of an event: what a query rounds it to.
EVENT_COLUMNS = "CAST(pick AS BIGINT) AS pick, atom_index, round(amplitude, 4) + 0.0 AS amplitude, round(phase, 4) + 0.0 AS phase, round(energy, 2) + 0.0 AS energy"


def taps(size: int, hop: int, fft: int, count: int) -> str:
    """CTE body on s: user_id, k, h of the whitening filter."""
    half = fft // 2
    return f"""SELECT user_id, k, w / sum(w) OVER (PARTITION BY user_id) AS h FROM (
      SELECT user_id, k, (0.54 - 0.46 * cos(2 * pi() * k / {count - 1})) * sum(h * CASE WHEN bin IN (0, {half}) THEN 1.0 ELSE 2.0 END * cos(2 * pi() * k * bin / {fft})) AS w
      FROM (SELECT user_id, bin, 1 / sqrt(psd + 1e-12) AS h FROM ({welch(size, hop, fft)})), (SELECT unnest(range({count})) AS k) GROUP BY user_id, k)"""
