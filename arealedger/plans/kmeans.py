"""The SQL of cluster.keyed_kmeans."""

from __future__ import annotations

STARTS, ROUNDS = 10, 8


def kmeans_sql(points: str, ks: str, width: int, out: str, starts: int = STARTS, rounds: int = ROUNDS) -> str:
    """CTEs that end in out (as_of, k, dong, cluster): points (as_of, dong, x, w), ks a table of k."""
    far = "round(" + " + ".join(f"(x[{i}] - cx[{i}]) * (x[{i}] - cx[{i}])" for i in range(1, width + 1)) + ", 9)"
    ctes = [f"""{out}_seed AS (SELECT as_of, start, x, row_number() OVER (PARTITION BY as_of, start ORDER BY md5(start || ':' || dong)) - 1 AS c FROM {points}, range({starts}) s(start)),
{out}_c0 AS MATERIALIZED (SELECT as_of, k, start, c, x AS cx FROM {out}_seed JOIN {ks} ON c < k)"""]  # fmt: skip
    for i in range(rounds + 1):
        ctes.append(f"""{out}_a{i} AS MATERIALIZED (SELECT p.as_of, k, start, dong, x, w, c, {far} AS d FROM {points} p JOIN {out}_c{i} q ON p.as_of = q.as_of QUALIFY row_number() OVER (PARTITION BY p.as_of, k, start, dong ORDER BY d, c) = 1)""")
        if i < rounds:
            ctes.append(f"""{out}_c{i + 1} AS MATERIALIZED (SELECT q.as_of, q.k, q.start, q.c, coalesce(m, cx) AS cx FROM {out}_c{i} q
LEFT JOIN (SELECT as_of, k, start, c, [{", ".join(f"sum(w * x[{j}]) / sum(w)" for j in range(1, width + 1))}] AS m FROM {out}_a{i} GROUP BY 1, 2, 3, 4) n ON n.as_of = q.as_of AND n.k = q.k AND n.start = q.start AND n.c = q.c)""")
    ctes.append(f"""{out}_best AS (SELECT as_of, k, start FROM (SELECT as_of, k, start, round(sum(w * d), 6) AS cost FROM {out}_a{rounds} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY as_of, k ORDER BY cost, start) = 1),
{out} AS MATERIALIZED (SELECT as_of, k, dong, c::INT AS cluster FROM {out}_a{rounds} JOIN {out}_best USING (as_of, k, start))""")
    return ",\n".join(ctes)
