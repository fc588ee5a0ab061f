"""Check SQL for the split, the series statistics and the 44 features."""

from __future__ import annotations

from faultscope.canonical import METRICS
from faultscope.plans.sql import cte, hash_uniform

MS = ", ".join(METRICS)

_DAY = "CAST(ts AS DATE)"
cte("cases_day", f"""
    SELECT strftime(d, '%Y-%m-%d') || '#' || CAST(cohort AS VARCHAR) AS case_id, 'demo' AS dataset,
           ['online-boutique', 'sock-shop', 'train-ticket'][cohort % 3 + 1] AS system,
           CAST((day(d) + cohort) % 2 AS INTEGER) AS label,
           day(d) % 3 = 0 AS has_type, day(d) % 2 = 0 AS has_mult, day(d) % 4 = 0 AS has_name,
           ['click', 'error', 'purchase', 'signup', 'view'][day(d) % 5 + 1] AS fault_service,
           ['cpu', 'mem', 'disk', 'delay', 'loss', 'socket'][day(d) % 6 + 1] AS fault_type,
           1.0::DOUBLE + (day(d) * 7 % 50) / 10.0::DOUBLE AS load_multiplier,
           CAST(epoch(d) AS BIGINT) + 43200 AS inject_time, day(d) AS dom
    FROM (SELECT DISTINCT {_DAY} AS d, user_id // 50 AS cohort FROM events)""")
cte("cases_long", """
    SELECT DISTINCT 'cohort-' || CAST(user_id // 50 AS VARCHAR) AS case_id,
           CAST((user_id // 50) % 2 AS INTEGER) AS label,
           CAST(epoch((SELECT CAST(min(ts) AS DATE) FROM events)) AS BIGINT)
               + (SELECT (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) * 24 * 2 // 3 FROM events) * 3600 AS inject_time
    FROM events""")


def split_ctes(prefix: str, panel: str, cases: str) -> None:
    cte(f"{prefix}_halves", f"""
        SELECT m.*, CASE WHEN m.ts < c.inject_time THEN 'pre' WHEN m.ts >= c.inject_time THEN 'post' END AS half
        FROM {panel} m JOIN {cases} c USING (case_id)""", panel, cases)
    cte(f"{prefix}_sizes", f"""
        SELECT case_id, max(a) AS n_pre, max(b) AS n_post FROM (
            SELECT case_id, service, count(*) FILTER (WHERE half = 'pre') AS a, count(*) FILTER (WHERE half = 'post') AS b
            FROM {prefix}_halves GROUP BY 1, 2) GROUP BY 1""", f"{prefix}_halves")
    cte(f"{prefix}_placed", f"""
        SELECT h.* EXCLUDE (i, n, role), s.n_pre,
               row_number() OVER (PARTITION BY h.case_id, service, half ORDER BY i) - 1 AS i,
               count(*) OVER (PARTITION BY h.case_id, service, half) AS n
        FROM {prefix}_halves h JOIN {prefix}_sizes s USING (case_id)
        WHERE half IS NULL OR (n_pre >= 10 AND n_post >= 10)""", f"{prefix}_halves", f"{prefix}_sizes")
    q = "CAST(floor(n * 0.25) AS BIGINT)"
    cte(prefix, f"""
        SELECT case_id || '_fault' AS case_id, 'case' AS role, service, ts, i, n, {MS} FROM {prefix}_placed WHERE half = 'post'
        UNION ALL SELECT case_id || '_fault', 'reference', service, ts, i, n, {MS} FROM {prefix}_placed WHERE half = 'pre'
        UNION ALL SELECT case_id || '_normal', unnest(['case', 'reference']), service, ts, i, n, {MS}
                  FROM {prefix}_placed WHERE half = 'pre' AND {q} < 10
        UNION ALL SELECT case_id || '_normal', 'reference', service, ts, i, {q}, {MS}
                  FROM {prefix}_placed WHERE half = 'pre' AND {q} >= 10 AND i < {q}
        UNION ALL SELECT case_id || '_normal', 'case', service, ts, i - {q}, n - {q}, {MS}
                  FROM {prefix}_placed WHERE half = 'pre' AND {q} >= 10 AND i >= {q}
        UNION ALL SELECT case_id, 'case', service, ts, i, n, {MS} FROM {prefix}_placed WHERE half IS NULL""",
        f"{prefix}_placed")


split_ctes("split_day", "day", "cases_day")
split_ctes("split_long", "long", "cases_long")
cte("cases_mixed", """
    SELECT * REPLACE (CASE WHEN dom % 10 = 0 THEN NULL ELSE inject_time - 43200 + (8 + dom % 8) * 3600 END AS inject_time)
    FROM cases_day""", "cases_day")
split_ctes("split_mixed", "day", "cases_mixed")


def _corr(x: str, y: str) -> str:
    return (f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN "
            f"greatest(-1.0, least(1.0, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))) ELSE 0.0 END")


def feature_ctes(p: str, src: str) -> None:
    """Sub-queries ``<p>_profile``, ``<p>_series``, ``<p>_sync`` ... over ``src``."""
    pooled = ", ".join(f"avg({m}) AS mean_{m}, coalesce(stddev_samp({m}), 0.0) AS std_{m}" for m in METRICS[:6])
    cte(f"{p}_profile", f"""
        SELECT case_id, role, service, max(n) AS n, avg(ts) AS ts_mean,
               avg(cpu_usage) AS cpu_mean, stddev_pop(cpu_usage) AS cpu_std, min(cpu_usage) AS cpu_min, max(cpu_usage) AS cpu_max,
               avg(latency) AS lat_mean, avg(error_rate) AS err_mean, max(error_rate) AS err_max,
               stddev_pop(request_rate) AS req_std,
               {_corr('cpu_usage', 'request_rate')} AS corr_cpu_req, {_corr('latency', 'cpu_usage')} AS corr_lat_cpu,
               avg(cpu_usage) FILTER (WHERE i < n // 2) AS cpu_first, avg(cpu_usage) FILTER (WHERE i >= n // 2) AS cpu_second,
               var_pop(cpu_usage) FILTER (WHERE i < n // 2) AS v1, var_pop(cpu_usage) FILTER (WHERE i >= n // 2) AS v2,
               avg(cpu_usage) FILTER (WHERE i >= n - greatest(1, n // 5)) AS cpu_tail,
               avg(error_rate) FILTER (WHERE i >= n // 2) - avg(error_rate) FILTER (WHERE i < n // 2) AS err_delta,
               coalesce(covar_pop(error_rate, i) / nullif(var_pop(i), 0), 0.0) AS err_slope,
               avg(abs(network_in - network_out) / (network_in + network_out + 1e-10)) AS asym
        FROM {src} GROUP BY 1, 2, 3""", src)
    cte(f"{p}_z", f"""
        SELECT m.case_id, m.role, m.service, m.i, m.n, m.cpu_usage,
               CASE WHEN cpu_min < cpu_max THEN (m.cpu_usage - cpu_mean) / cpu_std ELSE 0.0 END AS z, cpu_min < cpu_max AS varies,
               abs(m.cpu_usage - lag(m.cpu_usage) OVER (PARTITION BY m.case_id, m.role, m.service ORDER BY i)) AS step
        FROM {src} m JOIN {p}_profile USING (case_id, role, service)""", src, f"{p}_profile")
    cte(f"{p}_hot", f"""
        SELECT case_id, role, service, count(*) FILTER (WHERE z > 2) AS hot_points, min(i) FILTER (WHERE z > 2) AS first_hot,
               coalesce(max(step), 0.0) AS max_step
        FROM {p}_z GROUP BY 1, 2, 3""", f"{p}_z")
    # Textbook form: all pairs of services at equal positions.
    cte(f"{p}_sync", f"""
        SELECT case_id, role, avg(r) AS sync FROM (
            SELECT a.case_id, a.role, corr(a.cpu_usage, b.cpu_usage) AS r
            FROM {p}_z a JOIN {p}_z b ON a.case_id = b.case_id AND a.role = b.role AND a.i = b.i AND a.service < b.service
            WHERE a.varies AND b.varies GROUP BY a.case_id, a.role, a.service, b.service) GROUP BY 1, 2""", f"{p}_z")
    cte(f"{p}_edges", """
        SELECT * FROM (VALUES ('click', 'view'), ('click', 'purchase'), ('error', 'click'), ('error', 'view'), ('error', 'signup'),
            ('purchase', 'click'), ('purchase', 'error'), ('signup', 'view'), ('view', 'click'), ('view', 'signup'),
            ('view', 'purchase'), ('view', 'error')) t(a, b)""")
    cte(f"{p}_pairs", f"""
        SELECT x.case_id, x.service AS a, y.service AS b, {_corr('x.cpu_usage', 'y.cpu_usage')} AS r
        FROM {p}_z x JOIN {p}_edges e ON x.service = e.a
        JOIN {p}_z y ON y.case_id = x.case_id AND y.role = x.role AND y.i = x.i AND y.service = e.b
        JOIN {p}_hot h ON h.case_id = x.case_id AND h.role = x.role AND h.service = x.service
        WHERE x.role = 'case' AND h.hot_points > 0 GROUP BY 1, 2, 3""", f"{p}_z", f"{p}_edges", f"{p}_hot")
    cte(f"{p}_spread", f"""
        SELECT case_id, CASE WHEN count(*) > 1 THEN stddev_pop(r) ELSE 0.0 END AS anomaly_spread
        FROM {p}_pairs GROUP BY 1""", f"{p}_pairs")
    # Spectrum as a plain discrete Fourier sum over half-overlapping segments.
    cte(f"{p}_seg", f"""
        SELECT case_id, service, s, len, i - s * (len - len // 2) AS j, x - avg(x) OVER (PARTITION BY case_id, service, s) AS x
        FROM (SELECT case_id, service, i, n, least(n, 256) AS len, cpu_usage AS x FROM {src} WHERE role = 'case' AND n >= 8) m,
             unnest(range((n - len) // (len - len // 2) + 1)) u(s)
        WHERE i >= s * (len - len // 2) AND i < s * (len - len // 2) + len""", src)
    cte(f"{p}_dft", f"""
        SELECT case_id, service, s, len, f,
               sum(x * w * cos(2 * pi() * f * j / len)) AS re, sum(x * w * sin(2 * pi() * f * j / len)) AS im, sum(w * w) AS ww
        FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / len) AS w FROM {p}_seg) t, unnest(range(len // 2 + 1)) u(f)
        GROUP BY 1, 2, 3, 4, 5""", f"{p}_seg")
    cte(f"{p}_psd", f"""
        SELECT case_id, service, f, max(len) AS len,
               avg((re * re + im * im) / ww * CASE WHEN f = 0 OR 2 * f = len THEN 1 ELSE 2 END) AS power
        FROM {p}_dft GROUP BY 1, 2, 3""", f"{p}_dft")
    cte(f"{p}_spectral", f"""
        SELECT case_id, service, -sum(q * log2(q + 1e-10)) AS entropy,
               sum(power) FILTER (WHERE f >= bins // 2) / (max(total) + 1e-10) AS high_share,
               min(f) FILTER (WHERE power >= peak * (1 - 1e-9)) / CAST(max(len) AS DOUBLE) AS dominant
        FROM (SELECT *, power / (total + 1e-10) AS q FROM (
                SELECT *, sum(power) OVER w AS total, max(power) OVER w AS peak, count(*) OVER w AS bins
                FROM {p}_psd WINDOW w AS (PARTITION BY case_id, service))) GROUP BY 1, 2""", f"{p}_psd")
    cte(f"{p}_pool", f"SELECT case_id, {pooled}, max(error_rate) AS max_error_rate FROM {src} WHERE role = 'case' GROUP BY 1", src)
    cte(f"{p}_base", f"""
        SELECT p.case_id,
               avg(CASE WHEN cpu_second > cpu_first * 1.1 THEN 1.0::DOUBLE ELSE 0.0 END) AS global_load_ratio,
               avg(corr_cpu_req) AS cpu_request_correlation, coalesce(avg(err_delta), 0.0) AS error_rate_delta,
               avg(corr_lat_cpu) AS latency_cpu_correlation,
               avg(CAST(hot_points AS DOUBLE) / p.n) AS peak_duration,
               CASE WHEN count(first_hot) >= 2 THEN stddev_pop(first_hot) / (max(p.n) + 1e-10) ELSE 0.0 END AS cascade_score,
               greatest(0.0, least(1.0, avg(CASE WHEN p.n >= 4 AND cpu_max > cpu_min
                   THEN (cpu_max - cpu_tail) / (cpu_max - cpu_mean + 1e-10) ELSE 0.0 END))) AS recovery_indicator,
               avg(CASE WHEN hot_points > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS affected_service_ratio,
               avg(CASE WHEN p.n >= 2 THEN ln((v2 + 1e-10) / (v1 + 1e-10)) ELSE 0.0 END) AS variance_change_ratio,
               CAST(count(*) AS DOUBLE) AS n_services,
               max(cpu_mean) / (avg(cpu_mean) + 1e-10) AS max_cpu_service_ratio,
               max(err_mean) / (avg(err_mean) + 1e-10) AS max_error_service_ratio,
               stddev_pop(cpu_mean) AS cpu_spread, stddev_pop(err_mean) AS error_spread, stddev_pop(lat_mean) AS latency_spread,
               avg(coalesce(entropy, 0.0)) AS spectral_entropy, avg(coalesce(high_share, 0.0)) AS high_freq_energy_ratio,
               avg(coalesce(dominant, 0.0)) AS dominant_frequency, avg(asym) AS network_asymmetry,
               avg(CASE WHEN hot_points > 0 THEN CAST(coalesce(deg, 0) AS DOUBLE) ELSE 0.0 END) AS graph_anomaly_centrality,
               max(max_step) AS max_cpu_derivative, avg(err_slope) AS error_rate_slope,
               avg(ts_mean) AS ts_mean
        FROM {p}_profile p JOIN {p}_hot USING (case_id, role, service)
        LEFT JOIN {p}_spectral USING (case_id, service)
        LEFT JOIN (SELECT a AS service, count(*) AS deg FROM {p}_edges GROUP BY 1) USING (service)
        WHERE p.role = 'case' GROUP BY 1""", f"{p}_profile", f"{p}_hot", f"{p}_spectral", f"{p}_edges")
    cte(f"{p}_aligned", f"""
        SELECT coalesce(a.case_id, b.case_id) AS case_id, a.cpu_mean AS a, b.cpu_mean AS b, a.lat_mean AS la, b.lat_mean AS lb,
               a.err_max AS ea, b.err_max AS eb, b.cpu_std AS sb
        FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY service) AS rk FROM {p}_profile WHERE role = 'case') a
        FULL JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY service) AS rk FROM {p}_profile WHERE role = 'reference') b
          ON a.case_id = b.case_id AND a.rk = b.rk""", f"{p}_profile")
    cte(f"{p}_comparison", f"""
        SELECT c.case_id,
               greatest(0.0, least(1.0, 1 - sum(coalesce(a, 0) * coalesce(b, 0)) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-10))) AS cpu_deviation,
               greatest(0.0, least(1.0, max(ea) / (max(eb) + 1e-10) / 100)) AS error_rate_ratio,
               greatest(0.0, least(1.0, abs(coalesce(max(s.sync), 0) - coalesce(max(t.sync), 0)))) AS correlation_shift,
               greatest(0.0, least(1.0, sqrt(sum(pow(coalesce(la, 0) - coalesce(lb, 0), 2))) /
                   (max(greatest(coalesce(la, 0), coalesce(lb, 0))) + 1e-10))) AS latency_deviation,
               1 / (1 + avg(sb)) AS baseline_confidence
        FROM {p}_aligned c LEFT JOIN {p}_sync s ON s.case_id = c.case_id AND s.role = 'case'
        LEFT JOIN {p}_sync t ON t.case_id = c.case_id AND t.role = 'reference'
        GROUP BY 1 HAVING count(a) > 0 AND count(b) > 0""", f"{p}_aligned", f"{p}_sync")
    cte(f"{p}_meancpu", f"SELECT case_id, i, avg(cpu_usage) AS x FROM {src} WHERE role = 'case' GROUP BY 1, 2", src)
    cte(f"{p}_acf", f"""
        SELECT case_id, max(n) AS n, max(var) AS var, max(abs(acf)) AS best FROM (
            SELECT a.case_id, l, max(s.n) AS n, max(s.var) AS var, avg((a.x - s.mean) * (b.x - s.mean)) AS acf
            FROM {p}_meancpu a
            JOIN (SELECT case_id, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM {p}_meancpu GROUP BY 1) s USING (case_id),
                 unnest(range(2, 31)) u(l)
            JOIN {p}_meancpu b ON b.case_id = a.case_id AND b.i = a.i + l
            WHERE l <= s.n // 2 GROUP BY 1, 2) GROUP BY 1""", f"{p}_meancpu")
    cte(f"{p}_gini", f"""
        SELECT case_id, CASE WHEN sum(d) < 1e-10 OR count(*) < 2 THEN 0.5
                   ELSE greatest(0.0, least(1.0, max(diff) / (2 * count(*) * sum(d)))) END AS anomaly_gini,
               CASE WHEN max(d) < 1e-10 THEN 0.5 ELSE min(d) / max(d) END AS load_uniformity
        FROM (SELECT case_id, service, coalesce(abs(cpu_second - cpu_first), 0.0) AS d FROM {p}_profile WHERE role = 'case') g
        JOIN (SELECT case_id, sum(abs(x.d - y.d)) AS diff
              FROM (SELECT case_id, coalesce(abs(cpu_second - cpu_first), 0.0) AS d FROM {p}_profile WHERE role = 'case') x
              JOIN (SELECT case_id, coalesce(abs(cpu_second - cpu_first), 0.0) AS d FROM {p}_profile WHERE role = 'case') y USING (case_id)
              GROUP BY 1) USING (case_id) GROUP BY 1""", f"{p}_profile")


feature_ctes("d", "split_day")
feature_ctes("l", "split_long")


def change_ctes(p: str, src: str, n: int, penalty: float) -> None:
    """``<p>_change``: best change point of every ``n``-point series, by trying
    all segmentations on the grid 5, 10, ..."""
    grid = list(range(5, n - 1, 5))
    cte(f"{p}_x", f"SELECT case_id, service, i, cpu_usage AS x FROM {src} WHERE role = 'case'", src)
    cte(f"{p}_gaps", f"""
        SELECT a.case_id, a.service, a.i AS i, b.i AS j, pow(a.x - b.x, 2) AS d FROM {p}_x a JOIN {p}_x b USING (case_id, service)""", f"{p}_x")
    cte(f"{p}_kernel", f"""
        SELECT case_id, service, i, j, CASE WHEN i = j THEN 1.0::DOUBLE
               ELSE exp(-greatest(0.01, least(100.0, CASE WHEN med > 0 THEN d / med ELSE d END))) END AS k
        FROM {p}_gaps JOIN (SELECT case_id, service, median(d) AS med FROM {p}_gaps WHERE i < j GROUP BY 1, 2) USING (case_id, service)""",
        f"{p}_gaps")
    cte(f"{p}_costs", f"""
        SELECT case_id, service, a, b, (b - a) - sum(k) / (b - a) AS cost
        FROM {p}_kernel, (SELECT x.a, y.b FROM (SELECT unnest({[0] + grid}) AS a) x JOIN (SELECT unnest({grid + [n]}) AS b) y ON x.a < y.b)
        WHERE i >= a AND i < b AND j >= a AND j < b GROUP BY 1, 2, 3, 4""", f"{p}_kernel")
    cte(f"{p}_paths", f"""
        SELECT list_filter({grid}, lambda x: (mask >> (x // 5 - 1)) & 1 = 1) AS cuts FROM (SELECT unnest(range({2 ** len(grid)})) AS mask)""")
    cte(f"{p}_parts", f"""
        SELECT cuts, CASE WHEN k = 1 THEN 0 ELSE cuts[k - 1] END AS a, CASE WHEN k > len(cuts) THEN {n} ELSE cuts[k] END AS b
        FROM {p}_paths, unnest(range(1, len(cuts) + 2)) u(k)""", f"{p}_paths")
    cte(f"{p}_best", f"""
        SELECT case_id, service, arg_min(cuts, total) AS cuts FROM (
            SELECT case_id, service, cuts, sum(cost + {penalty}) AS total FROM {p}_costs JOIN {p}_parts USING (a, b) GROUP BY 1, 2, 3)
        GROUP BY 1, 2""", f"{p}_costs", f"{p}_parts")
    cte(f"{p}_shifts", f"""
        SELECT d.case_id, d.service, c.cp, abs(avg(x) FILTER (WHERE i < c.cp) - avg(x) FILTER (WHERE i >= c.cp)) / (stddev_pop(x) + 1e-10) AS mag,
               abs(max(x) FILTER (WHERE i = c.cp + 1) - max(x) FILTER (WHERE i = c.cp - 1)) / 2 / (stddev_pop(x) + 1e-10) AS abr
        FROM {p}_x d, (SELECT unnest({[g for g in grid if 3 <= g <= n - 3]}) AS cp) c GROUP BY 1, 2, 3""", f"{p}_x")
    cte(f"{p}_change", f"""
        SELECT case_id, service, CAST(coalesce(cp, -1) AS BIGINT) AS cp, coalesce(mag, 0) AS cp_magnitude, coalesce(abr, 0) AS cp_abruptness
        FROM (SELECT DISTINCT case_id, service FROM {p}_x) LEFT JOIN (
            SELECT s.case_id, s.service, arg_max(c.cp, c.mag * 1e6 - c.cp * 1e-6) AS cp, max(c.mag) AS mag, arg_max(c.abr, c.mag * 1e6 - c.cp * 1e-6) AS abr
            FROM {p}_best s, unnest(s.cuts) u(k) JOIN {p}_shifts c ON c.case_id = s.case_id AND c.service = s.service AND c.cp = u.k
            WHERE c.mag > 0 GROUP BY 1, 2) USING (case_id, service)""", f"{p}_x", f"{p}_best", f"{p}_shifts")


def change_scan_ctes(p: str, src: str, penalty: float, *needs: str) -> None:
    """``<p>_scan``: best change point of every series of ``src``, of any length, by a plain recursion over the grid 5, 10, ...

    The cheapest way to each grid point comes from all grid points before it,
    without pruning; segment costs come from summed cells of the kernel matrix.
    """
    cte(f"{p}_sx", f"""
        SELECT case_id, service, i, x, least(i // 5, (n - 2) // 5) AS c, n, s FROM (
            SELECT case_id, service, i, cpu_usage AS x, count(*) OVER w AS n, stddev_pop(cpu_usage) OVER w AS s
            FROM {src} WHERE role = 'case' WINDOW w AS (PARTITION BY case_id, service))""", *needs)
    cte(f"{p}_smed", f"""
        SELECT a.case_id, a.service, median(pow(a.x - b.x, 2)) AS med FROM {p}_sx a JOIN {p}_sx b
        ON a.case_id = b.case_id AND a.service = b.service AND a.i < b.i GROUP BY 1, 2""", f"{p}_sx")
    cte(f"{p}_scell", f"""
        SELECT a.case_id, a.service, a.c AS c1, b.c AS c2, sum(CASE WHEN a.i = b.i THEN 1.0::DOUBLE
               ELSE exp(-greatest(0.01, least(100.0, pow(a.x - b.x, 2) / CASE WHEN med > 0 THEN med ELSE 1 END))) END) AS k
        FROM {p}_sx a JOIN {p}_sx b ON a.case_id = b.case_id AND a.service = b.service
        JOIN {p}_smed m ON m.case_id = a.case_id AND m.service = a.service GROUP BY 1, 2, 3, 4""", f"{p}_sx", f"{p}_smed")
    # Sums of all cells with c1 < a and c2 < b, from 1 on.
    cte(f"{p}_ssum", f"""
        SELECT case_id, service, c1 + 1 AS a, c2 + 1 AS b, sum(k) OVER (PARTITION BY case_id, service, c2 ORDER BY c1) AS p FROM (
            SELECT case_id, service, c1, c2, sum(k) OVER (PARTITION BY case_id, service, c1 ORDER BY c2) AS k FROM {p}_scell)""", f"{p}_scell")
    cte(f"{p}_sends", f"SELECT case_id, service, max(c) + 1 AS last, max(n) AS n FROM {p}_sx GROUP BY 1, 2", f"{p}_sx")
    cte(f"{p}_scost", f"""
        SELECT case_id, service, b, list(width - inside / width ORDER BY a) AS costs FROM (
            SELECT e.case_id, e.service, t.b, f.a, CASE WHEN t.b = e.last THEN e.n ELSE 5 * t.b END - 5 * f.a AS width,
                   t.p - 2 * coalesce(u.p, 0) + coalesce(v.p, 0) AS inside
            FROM {p}_sends e JOIN {p}_ssum t ON t.case_id = e.case_id AND t.service = e.service AND t.a = t.b
            JOIN (SELECT unnest(range(10000)) AS a) f ON f.a < t.b
            LEFT JOIN {p}_ssum u ON u.case_id = e.case_id AND u.service = e.service AND u.a = f.a AND u.b = t.b
            LEFT JOIN {p}_ssum v ON v.case_id = e.case_id AND v.service = e.service AND v.a = f.a AND v.b = f.a) GROUP BY 1, 2, 3""",
        f"{p}_ssum", f"{p}_sends")
    cte(f"{p}_sway", f"""
        WITH RECURSIVE way AS (
            SELECT case_id, service, 0 AS b, [0.0::DOUBLE] AS best, [0::BIGINT] AS origin FROM {p}_sends
            UNION ALL
            SELECT case_id, service, b, list_append(best, list_min(t) + {penalty}), list_append(origin, list_position(t, list_min(t)) - 1) FROM (
                SELECT w.case_id, w.service, c.b, w.best, w.origin, list_transform(list_zip(w.best, c.costs), lambda z: z[1] + z[2]) AS t
                FROM way w JOIN {p}_scost c ON c.case_id = w.case_id AND c.service = w.service AND c.b = w.b + 1))
        SELECT w.* FROM way w JOIN {p}_sends e ON e.case_id = w.case_id AND e.service = w.service AND e.last = w.b""", f"{p}_scost", f"{p}_sends")
    cte(f"{p}_scuts", f"""
        WITH RECURSIVE back AS (
            SELECT case_id, service, origin, CAST(b AS BIGINT) AS b FROM {p}_sway
            UNION ALL SELECT case_id, service, origin, origin[b + 1] FROM back WHERE origin[b + 1] > 0)
        SELECT case_id, service, 5 * b AS cp FROM back ANTI JOIN {p}_sends e ON e.case_id = back.case_id AND e.service = back.service AND e.last = back.b""",
        f"{p}_sway", f"{p}_sends")
    cte(f"{p}_scan", f"""
        SELECT e.case_id, e.service, CAST(coalesce(cp, -1) AS BIGINT) AS cp, coalesce(mag, 0) AS cp_magnitude, coalesce(abr, 0) AS cp_abruptness
        FROM {p}_sends e LEFT JOIN (
            SELECT case_id, service, arg_max(cp, mag * 1e6 - cp * 1e-6) AS cp, max(mag) AS mag, arg_max(abr, mag * 1e6 - cp * 1e-6) AS abr FROM (
                SELECT d.case_id, d.service, c.cp, abs(avg(x) FILTER (WHERE i < cp) - avg(x) FILTER (WHERE i >= cp)) / (max(s) + 1e-10) AS mag,
                       abs(max(x) FILTER (WHERE i = cp + 1) - max(x) FILTER (WHERE i = cp - 1)) / 2 / (max(s) + 1e-10) AS abr
                FROM {p}_sx d JOIN {p}_scuts c ON c.case_id = d.case_id AND c.service = d.service WHERE c.cp BETWEEN 3 AND n - 3 GROUP BY 1, 2, 3)
            WHERE mag > 0 GROUP BY 1, 2) m ON m.case_id = e.case_id AND m.service = e.service""", f"{p}_sx", f"{p}_scuts", f"{p}_sends")


change_scan_ctes("long", "long", 10.0, "long")
change_scan_ctes("l", "split_long", 10.0, "split_long")
# A shift of the load at a place of its own in every second series, so that there is something to find.
cte("stepped_long", """
    SELECT * REPLACE (cpu_usage + CASE WHEN i >= 200 + 37 * (length(service) % 5) AND length(service) % 2 = 1 THEN 60.0 ELSE 0.0 END AS cpu_usage) FROM long""", "long")
change_scan_ctes("stepped", "stepped_long", 10.0, "stepped_long")
change_ctes("d", "split_day", 12, 10.0)
def feature_table_ctes(p: str, src: str, change: str) -> None:
    """``<p>_features``: the features of every case without its context."""
    cte(f"{p}_labels", f"""
        SELECT DISTINCT case_id, CAST(CASE WHEN case_id LIKE '%fault' THEN 0 ELSE 1 END AS INTEGER) AS label FROM {src}""", src)
    cte(f"{p}_features", f"""
        SELECT f.case_id, f.label, b.* EXCLUDE (case_id), p.* EXCLUDE (case_id), coalesce(s.sync, 0.0) AS cross_service_sync,
               coalesce(r.anomaly_spread, 0.0) AS anomaly_spread, c.change_point_magnitude, c.onset_gradient
        FROM {p}_labels f JOIN {p}_base b USING (case_id) JOIN {p}_pool p USING (case_id)
        LEFT JOIN {p}_sync s ON s.case_id = f.case_id AND s.role = 'case' LEFT JOIN {p}_spread r ON r.case_id = f.case_id
        JOIN (SELECT case_id, avg(cp_magnitude) AS change_point_magnitude, avg(cp_abruptness) AS onset_gradient
              FROM {change} GROUP BY 1) c ON c.case_id = f.case_id""", f"{p}_labels", f"{p}_base", f"{p}_pool", f"{p}_sync", f"{p}_spread", change)


feature_table_ctes("d", "split_day", "d_change")
feature_table_ctes("l", "split_long", "l_scan")
cte("d_derived", """
    SELECT g.case_id, anomaly_gini, load_uniformity, 0.5::DOUBLE AS periodicity_strength, coherence AS correlation_coherence,
           greatest(0.0, least(1.0, 1 / (1 + m))) AS regime_stability
    FROM d_gini g JOIN (SELECT case_id, CASE WHEN count(*) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10) >= 2
            THEN greatest(0.0, least(1.0, 1 - stddev_pop(corr_cpu_req) FILTER (WHERE cpu_std >= 1e-10 AND req_std >= 1e-10))) ELSE 0.5 END AS coherence
        FROM d_profile WHERE role = 'case' GROUP BY 1) USING (case_id)
    JOIN (SELECT case_id, avg(cp_magnitude) AS m FROM d_change GROUP BY 1) USING (case_id)""", "d_gini", "d_profile", "d_change")
_F = "substr(case_id, 1, strlen(case_id) - 6)"
_N = "substr(case_id, 1, strlen(case_id) - 7)"
cte("d_external", f"""
    SELECT case_id, has AS event_active, 0.0::DOUBLE AS event_expected_impact,
           CASE WHEN h BETWEEN 9 AND 20 THEN 0.7 + 0.3 * (h - 9) / 11 ELSE 0.1 + 0.3 * (CASE WHEN h < 9 THEN h ELSE h - 20 END) / 8 END AS time_seasonality,
           0.0::DOUBLE AS recent_deployment, 0.3::DOUBLE * has AS context_confidence
    FROM (SELECT case_id, CASE WHEN u < lim THEN 1.0::DOUBLE ELSE 0.0 END AS has, h FROM (
        SELECT case_id, CAST(floor(avg(ts) / 3600) AS BIGINT) % 24 AS h, CASE WHEN case_id LIKE '%fault' THEN 0.3 ELSE 0.7 END AS lim,
               CASE WHEN case_id LIKE '%fault' THEN {hash_uniform('42/fault', _F)} ELSE {hash_uniform('42/normal', _N)} END AS u
        FROM split_day WHERE role = 'case' GROUP BY 1))""", "split_day")
