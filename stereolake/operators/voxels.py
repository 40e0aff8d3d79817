"""Voxel hulls as sparse tables, and their surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import cut
from . import grids
from .grids import dims

CELL = ["i", "j", "k"]


def grid(spark: SparkSession, bounds: tuple, size: float) -> DataFrame:
    """(i, j, k, x, y, z): cells of a box and their centres, generated by the cluster."""
    nx, ny, nz = dims(bounds, size)
    at = spark.range(nx * ny * nz).select((F.col("id") / (ny * nz)).cast("int").alias("i"), ((F.col("id") / nz) % ny).cast("int").alias("j"), (F.col("id") % nz).cast("int").alias("k"))
    return at.select(*CELL, *[g.voxel_center(F.col(c), size, lo).alias(v) for c, v, (lo, _) in zip(CELL, "xyz", bounds)])


def seen_pixels(cells: DataFrame, cameras: list, width: int, height: int) -> DataFrame:
    """(camera, px, py, i, j, k): the pixel of each cell in each camera that has it in its image; the same for all frames."""
    out = None
    for number, p in enumerate(cameras):
        u, v, _ = g.project(p, F.col("x"), F.col("y"), F.col("z"))
        own = cells.select(*CELL, F.lit(number).alias("camera"), u.alias("u"), v.alias("v")).where(g.in_image(F.col("u"), F.col("v"), width, height))
        own = own.select("camera", g.pixel(F.col("u"), width).alias("px"), g.pixel(F.col("v"), height).alias("py"), *CELL)
        out = own if out is None else out.unionByName(own)
    return out


def carve(mask: DataFrame, cameras: DataFrame | list, bounds: tuple, size: float, width: int, height: int) -> DataFrame:
    """(session, frame_idx, i, j, k): cells whose pixel is foreground in both views, see `grids.carve`."""
    carved = grids.carve(grids.pack_masks(mask, width, height), cameras, bounds, size, width, height)
    return grids.cells(carved, ["session", "frame_idx"], dims(bounds, size))


def occupancy(voxels: DataFrame, cells: int) -> DataFrame:
    return voxels.groupBy("session", "frame_idx").agg(F.count(F.lit(1)).alias("n_occupied")).withColumn("fraction", F.col("n_occupied") / cells)


def accumulate(voxels: DataFrame, least_share: float = 1.0) -> DataFrame:
    """Cells of a session that survive (that share of) all its frames with any cell."""
    frames = voxels.groupBy("session").agg(F.countDistinct("frame_idx").alias("n_frames"))
    held = voxels.groupBy("session", *CELL).agg(F.countDistinct("frame_idx").alias("n"))
    return held.join(frames, "session").where(F.col("n") >= least_share * F.col("n_frames")).select("session", *CELL, "n")


def surface(voxels: DataFrame, key: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """Of occupied cells, or packed grids: cells not all of whose 26 neighbours are occupied; cells at the border of the grid always are on the surface."""
    return grids.surface(_packed(voxels, key, shape), key, shape)


def thin(voxels: DataFrame, key: list[str], n: int = 8) -> DataFrame:
    """Every n-th cell in flat order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*CELL)) - 1
    return voxels.withColumn("rank", rank).where(F.col("rank") % n == 0).drop("rank")


def centers(voxels: DataFrame, bounds: tuple, size: float) -> DataFrame:
    return voxels.select(*voxels.columns, *[g.voxel_center(F.col(c), size, lo).alias(v) for c, v, (lo, _) in zip(CELL, "xyz", bounds)])


def mesh_vertices(voxels: DataFrame, key: list[str], shape: tuple, origin: tuple, size: float) -> DataFrame:
    """(key, axis, i, j, k, x, y, z): the middle of each grid edge of which one end is occupied; (i, j, k) is its lower end.

    voxels: occupied cells, or packed grids. Positions are index times size plus origin, half a voxel below the centres, as
    in the files this replaces.
    """
    cut_edges = grids.edges(_packed(voxels, key, shape), key, shape)
    place = [((F.col(c) + F.when(F.col("axis") == a, 0.5).otherwise(0.0)) * size + origin[a]).alias(v) for a, (c, v) in enumerate(zip(CELL, "xyz"))]
    return cut_edges.select(*key, "axis", *CELL, *place)


def _packed(voxels: DataFrame, key: list[str], shape: tuple) -> DataFrame:
    return voxels if "grid" in voxels.columns else grids.pack_voxels(voxels, key, shape)


def cell_triangles() -> list[tuple[int, int, str]]:
    """(code, position, three edges) for the 256 corner codes of a cell, derived rather than listed.

    Corner c has bit b of its axis offsets. On each face the occupied corners are cut off by segments between edge
    middles (opposite corners apart), the segments of all faces are chained to loops, and loops are cut into fans.
    An edge is written as axis and lower corner.
    """
    corner = lambda v: v[0] | v[1] << 1 | v[2] << 2

    def edge(p, q):
        axis = next(a for a in range(3) if p[a] != q[a])
        low = min(p, q)
        return axis, low

    faces = []
    for axis in range(3):
        u, w = [a for a in range(3) if a != axis]
        for side in (0, 1):
            ring = []
            for du, dw in ((0, 0), (1, 0), (1, 1), (0, 1)):
                v = [0, 0, 0]
                v[axis], v[u], v[w] = side, du, dw
                ring.append(tuple(v))
            # seen from outside the cell, the ring runs counter-clockwise
            forward = (axis in (0, 2)) == bool(side)
            faces.append(ring if forward else ring[::-1])
    out = []
    for code in range(1, 255):
        step = {}
        for ring in faces:
            on = [bool(code >> corner(v) & 1) for v in ring]
            for n in range(4):
                if on[n] and not on[n - 1]:  # a run of occupied corners starts at n
                    m = n
                    while on[(m + 1) % 4]:
                        m += 1
                    step[edge(ring[m % 4], ring[(m + 1) % 4])] = edge(ring[n - 1], ring[n])
        position, left = 0, dict(step)
        while left:
            first = min(left)
            loop, at = [first], left.pop(first)
            while at != first:
                loop.append(at)
                at = left.pop(at)
            for n in range(1, len(loop) - 1):
                out.append((code, position, [loop[0], loop[n], loop[n + 1]]))
                position += 1
    return out


def mesh_faces(voxels: DataFrame, key: list[str], shape: tuple) -> DataFrame:
    """(key, i, j, k, position, a, b, c): triangles of each cell between eight grid points, corners named axis:i:j:k like vertices.

    voxels: occupied cells, or packed grids; the corner codes of their cells meet a generated table.
    """
    codes = grids.corner_codes(_packed(voxels, key, shape), key, shape)
    rows = [(code, pos, *[v for ax, low in tri for v in (ax, *low)]) for code, pos, tri in cell_triangles()]
    names = [f"{t}{n}" for t in "pqr" for n in ("x", "i", "j", "k")]
    table = voxels.sparkSession.createDataFrame(rows, ", ".join(["code int", "position int", *[f"{n} int" for n in names]]))
    name = lambda t: F.concat_ws(":", F.col(f"{t}x"), F.col("i") + F.col(f"{t}i"), F.col("j") + F.col(f"{t}j"), F.col("k") + F.col(f"{t}k"))
    return codes.join(F.broadcast(table), "code").select(*key, *CELL, "position", name("p").alias("a"), name("q").alias("b"), name("r").alias("c"))


def _lower_ends(edge: Column, shape: tuple) -> list[Column]:
    """Axis, i, j and k of a grid edge that is given by its number."""
    nx, ny, nz = shape
    return [F.floor(edge / (nx * ny * nz)).cast("int"), (F.floor(edge / (ny * nz)) % nx).cast("int"), (F.floor(edge / nz) % ny).cast("int"), edge % nz]


def meshes(voxels: DataFrame, key: list[str], shape: tuple, origin: tuple, size: float) -> DataFrame:
    """(key, vertices, faces): each mesh as one row, arrays of (x, y, z) and of three vertices' places; nothing is shuffled.

    voxels: occupied cells, or packed grids. The vertices are those of `mesh_vertices`, in the order of their names
    axis:i:j:k, the faces those of `mesh_faces`, in rising order. Grids without a vertex have no mesh.
    """
    found = grids.numbered(_packed(voxels, key, shape), key, shape, cell_triangles()).where(F.size("v") > 0)

    def place(edge: Column) -> Column:
        axis, *cell = _lower_ends(edge, shape)
        return F.struct(*[((c + F.when(axis == a, 0.5).otherwise(0.0)) * size + origin[a]).alias(v) for a, (c, v) in enumerate(zip(cell, "xyz"))])

    return found.select(*key, F.transform("v", place).alias("vertices"), F.col("f").alias("faces"))


def smooth_meshes(voxels: DataFrame, key: list[str], shape: tuple, origin: tuple, size: float, rounds: int = 1) -> DataFrame:
    """(key, v, x, y, z): `laplacian` of the meshes of packed grids or occupied cells; a mesh is smoothed in the task that has its grid."""
    found = grids.smoothed(_packed(voxels, key, shape), key, shape, cell_triangles(), origin, size, rounds)
    rows = found.select(*key, F.inline(F.arrays_zip("v", *"xyz")))
    return rows.select(*key, F.concat_ws(":", *_lower_ends(F.col("v"), shape)).alias("v"), *"xyz")


def adjacency(faces: DataFrame, key: list[str]) -> DataFrame:
    """(key, v, w): distinct neighbours, both ways, of triangles (a, b, c)."""
    pairs = F.array(*[F.struct(F.col(p).alias("v"), F.col(q).alias("w")) for p in "abc" for q in "abc" if p != q])
    return faces.select(*key, F.explode(pairs).alias("e")).select(*key, "e.v", "e.w").distinct()


def laplacian(vertices: DataFrame, neighbours: DataFrame, key: list[str], rounds: int = 1) -> DataFrame:
    """Vertices (key, v, x, y, z), each moved to the mean of its neighbours, round by round.

    Both grow with the meshes, which the packed grids' few bytes don't tell Spark, so neither is broadcast.
    """
    if rounds > 1:
        neighbours = cut(neighbours)
    for _ in range(rounds):
        other = vertices.select(*key, F.col("v").alias("w"), "x", "y", "z")
        vertices = neighbours.join(other.hint("merge"), [*key, "w"]).groupBy(*key, "v").agg(*[F.avg(c).alias(c) for c in "xyz"])
        if rounds > 5:
            vertices = cut(vertices)
    return vertices
