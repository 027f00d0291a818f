"""DuckDB SQL of the tracker: its step as one recursive query, spelled out element by element.

Each level of the recursive term is a subselect that adds the expressions of the level before it.
"""

from __future__ import annotations

from pointloom.config import DEFAULT, Config
from pointloom.streaming.tracker import HALF_HEIGHT, LOW_CONFIDENCE, Q, R

N = range(6)
#: Events as fitted frames, as `model_queries._fits` gives them.
FITS = """fits AS (SELECT user_id AS track, event_id AS frame, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 40000 AS ts, value, event_id % 7 <> 0 AS fitted, event_id % 7 <> 0 AND event_id % 3 = 0 AS target, value / 1000 AS z_ground FROM events),
rows AS (SELECT track, frame, ts, target, z_ground, CASE WHEN fitted THEN sin(ts) END AS zx, CASE WHEN fitted THEN cos(ts) END AS zy, CASE WHEN fitted THEN value / 100 END AS zw, row_number() OVER (PARTITION BY track ORDER BY ts, frame) AS n FROM fits)"""


def _wrapped(angle: str) -> str:
    return f"atan2(sin({angle}), cos({angle}))"


def _inverse(a: str, out: str) -> tuple[str, str]:
    """(columns of the cofactors and the determinant, columns of the inverse) of the 3 x 3 columns a00 to a22."""
    m = lambda i, j: f"{a}{i % 3}{j % 3}"
    cofactors = {(i, j): f"({m(i + 1, j + 1)} * {m(i + 2, j + 2)} - {m(i + 1, j + 2)} * {m(i + 2, j + 1)})" for i in range(3) for j in range(3)}
    det = " + ".join(f"{m(0, j)} * {cofactors[0, j]}" for j in range(3))
    return f"{det} AS det_{out}", ", ".join(f"{cofactors[j, i]} / det_{out} AS {out}{i}{j}" for i in range(3) for j in range(3))


def _level(inner: str, *columns: str) -> str:
    return f"SELECT *, {', '.join(columns)} FROM ({inner})"


def _step(config: Config) -> str:
    """The recursive term, up to the level that the final choice reads."""
    body = """SELECT f.* EXCLUDE (frame, ts, accepted, nis, z_ground), r.frame, r.ts, r.zx, r.zy, r.zw, r.target, r.z_ground,
        CASE WHEN f.last_ts IS NULL THEN 0.1::DOUBLE ELSE greatest(0.01, r.ts - f.last_ts) END AS dt, CASE WHEN f.last_ts IS NULL THEN r.ts ELSE greatest(f.last_ts, r.ts) END AS now
        FROM f JOIN rows r ON r.track = f.track AND r.n = f.n + 1"""
    body = _level(body, "cos(x2) AS c", "sin(x2) AS s")
    body = _level(body, "(x3 * c - x4 * s) AS gx", "(x3 * s + x4 * c) AS gy")
    jacobian = {(0, 2): "(-gy * dt)", (0, 3): "(c * dt)", (0, 4): "(-s * dt)", (1, 2): "(gx * dt)", (1, 3): "(s * dt)", (1, 4): "(c * dt)", (2, 5): "dt"}
    moved = ["x0 + gx * dt", "x1 + gy * dt", _wrapped("x2 + x5 * dt"), "x3", "x4", "x5"]
    left = {(i, j): " + ".join([f"p{i}{j}", *(f"{v} * p{k}{j}" for (a, k), v in jacobian.items() if a == i)]) for i in N for j in N}
    body = _level(body, *[f"CASE WHEN started THEN {moved[i]} ELSE x{i} END AS y{i}" for i in N], *[f"{v} AS l{i}{j}" for (i, j), v in left.items()])
    both = {(i, j): " + ".join([f"l{i}{j}", *(f"{v} * l{i}{k}" for (a, k), v in jacobian.items() if a == j), *([f"{Q[i]} * dt"] if i == j else [])]) for i in N for j in N}
    body = _level(body, *[f"CASE WHEN started THEN {v} ELSE p{i}{j} END AS q{i}{j}" for (i, j), v in both.items()])
    noise = {i: f"{R[i]} * CASE WHEN target THEN 1.0::DOUBLE ELSE {LOW_CONFIDENCE}::DOUBLE END" for i in range(3)}
    body = _level(body, "zx - y0 AS i0", "zy - y1 AS i1", f"{_wrapped('zw - y2')} AS i2", *[f"q{i}{j}{' + ' + noise[i] if i == j else ''} AS s{i}{j}" for i in range(3) for j in range(3)])
    det, inverse = _inverse("s", "v")
    body = _level(_level(body, det), inverse)
    distance = " + ".join(f"i{i} * v{i}{j} * i{j}" for i in range(3) for j in range(3))
    body = _level(body, f"CASE WHEN started AND zx IS NOT NULL THEN {distance} END AS new_nis", *[" + ".join(f"q{i}{k} * v{k}{j}" for k in range(3)) + f" AS k{i}{j}" for i in N for j in range(3)])
    corrected = [f"y{i} + " + " + ".join(f"k{i}{j} * i{j}" for j in range(3)) for i in N]
    corrected[2] = _wrapped(corrected[2])
    body = _level(
        body, f"CASE WHEN zx IS NULL THEN 'none' WHEN target THEN 'target' WHEN NOT started THEN 'first' WHEN new_nis > {config.gate} THEN 'rejected' ELSE 'update' END AS branch",
        *[f"{v} AS u{i}" for i, v in enumerate(corrected)], *[f"q{i}{j} - (" + " + ".join(f"k{i}{k} * q{k}{j}" for k in range(3)) + f") AS w{i}{j}" for i in N for j in N],
    )
    body = _level(body, "coalesce(sqrt(u3 * u3 + u4 * u4) < 0.03 AND ts - last_target < 1.0, false) AS stands", *[f"w{3 + i}{3 + j}{' + 1e-3' if i == j else ''} AS a{i}{j}" for i in range(3) for j in range(3)])
    det, inverse = _inverse("a", "b")
    body = _level(_level(body, det), inverse)
    body = _level(body, *[" + ".join(f"w{i}{3 + k} * b{k}{j}" for k in range(3)) + f" AS g{i}{j}" for i in N for j in range(3)])
    rested = [f"u{i} - (" + " + ".join(f"g{i}{j} * u{3 + j}" for j in range(3)) + ")" for i in N]
    rested[2] = _wrapped(rested[2])
    snapped = f"(branch = 'target' OR branch = 'first' AND least(100.0, health + 5) > {config.init_health})"
    lost = f"(branch = 'none' AND started AND coalesce(ts - last_target > {config.timeout_s}, false))"
    body = _level(
        body, f"{snapped} AS snapped", f"{lost} AS lost",
        *[f"CASE WHEN stands THEN {v} ELSE u{i} END AS e{i}" for i, v in enumerate(rested)], *[f"CASE WHEN stands THEN w{i}{j} - (" + " + ".join(f"g{i}{k} * w{3 + k}{j}" for k in range(3)) + f") ELSE w{i}{j} END AS h{i}{j}" for i in N for j in N],
    )
    measured = ["zx", "zy", "zw", "0.0", "0.0", "0.0"]
    x = [f"CASE WHEN lost THEN 0.0 WHEN snapped THEN {measured[i]} WHEN branch = 'update' THEN e{i} ELSE y{i} END AS x{i}" for i in N]
    p = [f"CASE WHEN lost THEN {0.1 if i == j else 0.0} WHEN branch = 'update' THEN h{i}{j} ELSE q{i}{j} END AS p{i}{j}" for i in N for j in N]
    rest = [
        "(started OR snapped) AND NOT lost AS started",
        "CASE WHEN lost THEN 0.0 WHEN branch = 'none' THEN CASE WHEN started THEN greatest(0.0, health - 5) ELSE health END WHEN branch = 'target' THEN least(100.0, health + 25) WHEN branch = 'rejected' THEN greatest(0.0, health - 5) ELSE least(100.0, health + 5) END AS health",
        "CASE WHEN lost THEN 'SEARCHING' WHEN snapped THEN 'ACTIVE' WHEN branch = 'none' AND started THEN 'COASTING' ELSE life END AS life",
        "CASE WHEN lost THEN NULL WHEN snapped THEN ts ELSE last_target END AS last_target", "now AS last_ts",
        "CASE WHEN lost THEN false WHEN branch = 'update' THEN stands ELSE still END AS still",
        "frame", "ts", "snapped OR branch = 'update' AS accepted", "new_nis AS nis", "z_ground",
    ]
    return f"SELECT track, n + 1 AS n, {', '.join([*x, *p, *rest])} FROM ({body})"


def track_sql(config: Config = DEFAULT) -> str:
    """Track rows of `rows`, rounded as the queries give them."""
    start = ["0.0::DOUBLE"] * 6 + [f"{0.1 if i == j else 0.0}::DOUBLE" for i in N for j in N] + ["false", "0.0::DOUBLE", "'SEARCHING'", "NULL::DOUBLE", "NULL::DOUBLE", "false", "NULL::BIGINT", "NULL::DOUBLE", "false", "NULL::DOUBLE", "NULL::DOUBLE"]
    names = [f"x{i}" for i in N] + [f"p{i}{j}" for i in N for j in N] + "started health life last_target last_ts still frame ts accepted nis z_ground".split()
    return f"""WITH RECURSIVE {FITS}, f(track, n, {', '.join(names)}) AS (SELECT DISTINCT track, 0::BIGINT, {', '.join(start)} FROM rows UNION ALL {_step(config)})
    SELECT track, frame, life AS lifecycle, CAST(CASE life WHEN 'SEARCHING' THEN 1 WHEN 'ACTIVE' THEN 2 ELSE 3 END AS INTEGER) AS fsm_state, accepted, round(x0, 6) + 0.0 AS x, round(x1, 6) + 0.0 AS y,
    round(z_ground + {HALF_HEIGHT}, 6) + 0.0 AS z, round(x2, 6) + 0.0 AS yaw, round(health, 6) + 0.0 AS health, round(nis, 4) + 0.0 AS nis FROM f WHERE n > 0"""
