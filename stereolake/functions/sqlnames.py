"""Geometry by name for SQL texts: temporary functions of a session, plain SQL but for the decomposition of triangulate."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.trajectory import solver


def _line(m: str, at: tuple[int, int, int], x: str, y: str) -> str:
    return f"({m}[{at[0]}] * {x} + {m}[{at[1]}] * {y} + {m}[{at[2]}])"


def _row(m: str, i: int) -> str:
    return f"({m}[{i}] * x + {m}[{i + 1}] * y + {m}[{i + 2}] * z + {m}[{i + 3}])"


def register(spark: SparkSession) -> None:
    """Makes these known to spark.sql; matrices are arrays of their numbers row by row.

    sampson(f, x0, y0, x1, y1), reproj_error(p, x, y, z, px, py), triangulate(x0, y0, x1, y1, p0, p1) as a struct x, y, z,
    voxel_index(x, size, origin), and the table function voxel_grid(x_lo, x_hi, y_lo, y_hi, z_lo, z_hi, size) with the
    cells of a box, i, j, k, x, y, z. voxel_grid counts in one task; voxels.grid makes large boxes on all of them.
    """
    a = [_line("f", (3 * i, 3 * i + 1, 3 * i + 2), "x0", "y0") for i in range(3)]
    b = [_line("f", (j, 3 + j, 6 + j), "x1", "y1") for j in range(2)]
    inner, scale = f"(x1 * {a[0]} + y1 * {a[1]} + {a[2]})", " + ".join(f"{v} * {v}" for v in (*a[:2], *b))
    u, v, w = (_row("p", 4 * i) for i in range(3))
    four = ", ".join(f"{n} DOUBLE" for n in ("x0", "y0", "x1", "y1"))
    made = [
        f"sampson(f ARRAY<DOUBLE>, {four}) RETURNS DOUBLE RETURN CASE WHEN {scale} > 1e-12 THEN {inner} * {inner} / ({scale}) ELSE 0.0D END",
        f"reproj_error(p ARRAY<DOUBLE>, x DOUBLE, y DOUBLE, z DOUBLE, px DOUBLE, py DOUBLE) RETURNS DOUBLE RETURN sqrt(power({u} / {w} - px, 2) + power({v} / {w} - py, 2))",
        "voxel_index(x DOUBLE, size DOUBLE, origin DOUBLE) RETURNS INT RETURN CAST(floor((x - origin) / size) AS INT)",
        """voxel_grid(x_lo DOUBLE, x_hi DOUBLE, y_lo DOUBLE, y_hi DOUBLE, z_lo DOUBLE, z_hi DOUBLE, size DOUBLE)
        RETURNS TABLE (i INT, j INT, k INT, x DOUBLE, y DOUBLE, z DOUBLE)
        RETURN SELECT a.n, b.n, c.n, (a.n + 0.5D) * size + x_lo, (b.n + 0.5D) * size + y_lo, (c.n + 0.5D) * size + z_lo
        FROM (SELECT explode(sequence(0, greatest(CAST(ceil((x_hi - x_lo) / size) AS INT), 1) - 1)) AS n) a
        CROSS JOIN (SELECT explode(sequence(0, greatest(CAST(ceil((y_hi - y_lo) / size) AS INT), 1) - 1)) AS n) b
        CROSS JOIN (SELECT explode(sequence(0, greatest(CAST(ceil((z_hi - z_lo) / size) AS INT), 1) - 1)) AS n) c""",
    ]
    for text in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udf.register("triangulate", solver().asNondeterministic())
