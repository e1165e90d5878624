"""Media columns: cropped and edited copies of images, found by local descriptors.

Harris corners are taken on a pyramid of scales, each 0.71 of the one before, as long as sides have LEAST_SIDE pixels; a
scale has a corner for every AREA pixels, LEAST_CORNERS at least, so corners grow with the image. Each gets an
orientation from its patch's intensity centroid and 320 binary intensity tests within 8 pixels, turned by it. Two Hamming
tables hold one half of the descriptors each: descriptors that differ within one half only (all those that differ by
one bit) meet in a table, and a half of 160 tests is seldom that of another picture's corner. An image needs `agree`
such corners, not all. Images that meet are compared by geometric consensus: the similarity transform (turn, scale,
shift) that a pair of matched corners sets must carry `agree` corners or more onto their matches. Classes are the
connected components of what agrees.

Images with equal bytes are one entry. A table cell that more than `most` different images share (a logo's corner, or
one picture edited thousands of times) isn't paired out at first: its members are compared with the cell's first image,
its hub, so that it costs its members once. Members that end in the hub's class are settled. A second pass compares the
others with members of other classes, and tries pairs again that fell short without their crowded cells, now
with all matches. Images with fewer than `agree` corners in crowded cells can't agree by such cells alone, and the others
needn't be met in all their cells (see `_left_over`). So classes are those of all pairs; n_links counts the links that were tried, not those inside settled groups.

Images are binary PGM (P5, 8 bit); other bytes, null and empty ones, and images without corners are classes of their
own (n_corners 0; equal bytes are still one class). An image is described in memory as a whole. Repeated rows and ids
stay, a null id never names a class. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PATCH, TURNS, TESTS, TABLES = 8, 32, 320, 2
AREA, LEAST_CORNERS, LEAST_SIDE = 256, 8, 32
#: A test asks for a difference of more than this share of the patch's standard deviation, so that noise in flat parts doesn't decide it.
MARGIN = 0.15
#: Corners described at once, so that memory doesn't grow with their number.
SLICE = 4096
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    m = _HEADER.match(data or b"")
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    pixels = np.frombuffer(data, dtype=np.uint8, offset=m.end())
    return pixels.reshape(h, w) if w and h and len(pixels) == w * h else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test points for each turn (TURNS, TESTS, 2 points), spread evenly over a disc, and the disc of the orientation patch, as (y, x)."""
    rng = np.random.default_rng(TESTS)
    angle, far = rng.uniform(0, 2 * np.pi, (TESTS, 2)), PATCH * np.sqrt(rng.uniform(0, 1, (TESTS, 2)))
    y, x = far * np.sin(angle), far * np.cos(angle)
    turns = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(turns)[:, None, None], np.sin(turns)[:, None, None]
    points = np.stack([s * x + c * y, c * x - s * y], -1).round().astype(np.int64)
    disc = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 38])
    return points, disc[:, 0], disc[:, 1]


_POINTS, _DY, _DX = _pattern()


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1) x (2r+1); the edge repeats itself."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float32)
        n = x.shape[axis]
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(2 * r + 1, 2 * r + 1 + n), slice(0, n)
        x = (c[tuple(hi)] - c[tuple(lo)]) / (2 * r + 1)
    return x


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, round(x.shape[1] * scale)), max(1, round(x.shape[2] * scale))
    at = []
    for n, m in ((x.shape[1], h), (x.shape[2], w)):
        p = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.minimum(p.astype(int), max(0, n - 2))
        at.append((i, np.minimum(i + 1, n - 1), (p - i).astype(np.float32)))
    (i, i1, f), (j, j1, g) = at
    rows = x[:, i] * (1 - f)[None, :, None] + x[:, i1] * f[None, :, None]
    return rows[:, :, j] * (1 - g) + rows[:, :, j1] * g


def scales(h: int, w: int) -> Iterator[tuple[float, int]]:
    """The pyramid's scales for an image of that size, and how many corners each may give."""
    k = 0
    while k == 0 or min(h, w) * 0.5 ** (k / 2) >= LEAST_SIDE - 1:
        scale = 0.5 ** (k / 2)
        yield scale, max(LEAST_CORNERS, round(h * w * scale * scale / AREA))
        k += 1


def described(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the equally large images: its corners' places, and their descriptors (packed bits, a row a corner).

    A place packs x and y in the image as given (16 bits each; in units of more pixels where a side is longer than that).
    """
    places, bits = [[np.zeros(0, dtype=np.int32)] for _ in images], [[np.zeros((0, TESTS // 8), dtype=np.uint8)] for _ in images]
    unit = 1 + max(images.shape[1:]) // (1 << 16)
    for scale, k in scales(*images.shape[1:]):
        x = images.astype(np.float32) if scale == 1 else resized(images.astype(np.float32), scale)
        h, w = x.shape[1:]
        if min(h, w) <= 2 * PATCH + 2:
            continue
        smooth = box(x, 1)
        gx, gy = np.zeros_like(x), np.zeros_like(x)
        gx[:, :, 1:-1], gy[:, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2], smooth[:, 2:] - smooth[:, :-2]
        a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        r = (a * b - c * c - 0.05 * (a + b) ** 2)[:, PATCH:-PATCH, PATCH:-PATCH]
        peak = np.ones_like(r, dtype=bool)
        peak[:, 1:-1, 1:-1] = (r[:, 1:-1, 1:-1] > 1.0) & np.logical_and.reduce([r[:, 1:-1, 1:-1] >= r[:, 1 + i : r.shape[1] - 1 + i, 1 + j : r.shape[2] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        peak[:, [0, -1]] = peak[:, :, [0, -1]] = False
        flat = np.where(peak, r, 0).reshape(len(x), -1)
        k = min(k, flat.shape[1])
        top = np.argpartition(-flat, k - 1, axis=1)[:, :k]
        of, at = np.nonzero(np.take_along_axis(flat, top, 1) > 0)
        top = top[of, at]
        # positions in the flattened pictures: one index for each pixel that is looked at
        pixels, near, points = smooth.ravel(), _DY * w + _DX, _POINTS[..., 0] * w + _POINTS[..., 1]
        for lo in range(0, len(of), SLICE):
            n = of[lo : lo + SLICE]
            cy, cx = top[lo : lo + SLICE] // r.shape[2] + PATCH, top[lo : lo + SLICE] % r.shape[2] + PATCH
            centre = (n * h + cy) * w + cx
            patch = pixels.take(centre[:, None] + near)
            turn = np.arctan2((patch * _DY).sum(-1), (patch * _DX).sum(-1)) % (2 * np.pi)
            turn = (turn * TURNS / (2 * np.pi)).round().astype(int) % TURNS
            tests = pixels.take(centre[:, None, None] + points[turn])
            keys = np.packbits(tests[..., 1] - tests[..., 0] > MARGIN * patch.std(-1)[:, None], axis=-1)
            ox, oy = ((cx + 0.5) / scale - 0.5).round().astype(np.int64), ((cy + 0.5) / scale - 0.5).round().astype(np.int64)
            place = (ox // unit << 16 | oy // unit).astype(np.uint32).view(np.int32)
            edges = np.searchsorted(n, np.arange(len(images) + 1))
            for i in np.unique(n).tolist():
                places[i].append(place[edges[i] : edges[i + 1]])
                bits[i].append(keys[edges[i] : edges[i + 1]])
    return [(np.concatenate(p), np.concatenate(b)) for p, b in zip(places, bits, strict=True)]


def cells(keys: np.ndarray) -> np.ndarray:
    """A 64-bit cell for each corner and table (corners, TABLES), from the table's part of the descriptor."""
    parts = np.ascontiguousarray(keys).view("<u4").reshape(len(keys), TABLES, TESTS // 32 // TABLES).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = (out ^ parts[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def consensus(left: np.ndarray, right: np.ndarray, off: float = 3.0, enough: int | None = None) -> int:
    """The most corners (4 pixels apart or more) that one similarity transform carries onto their matches, or `enough` of them; left and right are places."""
    a, b = ((p >> 16) + 1j * (p & 0xFFFF) for p in (left, right))
    squares = [(p >> 18 << 16 | (p & 0xFFFF) >> 2) for p in (left, right)]
    i, j = np.triu_indices(len(a), 1)
    far = (np.abs(a[i] - a[j]) >= 6) & (np.abs(b[i] - b[j]) >= 6)
    i, j, best = i[far], j[far], 0
    for lo in range(0, len(i), 4096):
        u, v = i[lo : lo + 4096], j[lo : lo + 4096]
        turn = (b[v] - b[u]) / (a[v] - a[u])
        turn, u = turn[sized := (np.abs(turn) > 0.4) & (np.abs(turn) < 2.5)], u[sized]
        fits = np.abs(turn[:, None] * (a[None, :] - a[u][:, None]) + b[u][:, None] - b[None, :]) <= off
        count = fits.sum(1)
        for t in np.argsort(-count, kind="stable"):
            if count[t] <= best:
                break
            best = max(best, min(len(np.unique(c[fits[t]])) for c in squares))
        if enough is not None and best >= enough:
            break
    return best


def copies(images: DataFrame, id_col: str, image_col: str, agree: int = 4, most: int = 12) -> DataFrame:
    """A row an image: doc_id, n_corners, class_id (the smallest id of its class), n_links (verified links of its entry)."""
    spark = images.sparkSession
    common.short_batches(spark)
    id_arrow, id_ddl = common.arrow_type(images, id_col), common.ddl_type(images, id_col)
    fields = pa.schema([("doc_id", id_arrow), ("same", pa.int64()), ("n_corners", pa.int32()), ("places", pa.list_(pa.int32())), ("cells", pa.list_(pa.int64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        given: set[int] = set()  # a task gives the corners of equal bytes once
        for batch in batches:
            ids, data = batch.column("doc_id"), batch.column("image").to_pylist()
            none = np.zeros(0, dtype=np.int32), np.zeros((0, TESTS // 8), dtype=np.uint8)
            found = [none for _ in data]
            shapes: dict[tuple, list[int]] = {}
            pixels = [decode_pgm(x) for x in data]
            for i, p in enumerate(pixels):
                if p is not None:
                    shapes.setdefault(p.shape, []).append(i)
            for (h, w), at in shapes.items():
                step = max(1, 1_000_000 // (h * w))
                for lo in range(0, len(at), step):
                    for i, c in zip(at[lo : lo + step], described(np.stack([pixels[i] for i in at[lo : lo + step]])), strict=True):
                        found[i] = c
            same = [xxhash.xxh3_64_intdigest(x or b"") - (1 << 63) for x in data]
            counts = [len(p) for p, _ in found]
            for i, e in enumerate(same):
                if e in given:
                    found[i] = none
                given.add(e)
            yield pa.RecordBatch.from_arrays([ids, pa.array(same, pa.int64()), pa.array(counts, pa.int32()), pa.array([p for p, _ in found], fields.types[3]), pa.array([cells(k).ravel() for _, k in found], fields.types[4])], schema=fields)

    rows = images.select(F.col(id_col).alias("doc_id"), F.col(image_col).alias("image")).mapInArrow(common.tidy(describe), f"doc_id {id_ddl}, same long, n_corners int, places array<int>, cells array<long>")
    rows = common.written(rows, "corners")
    # (e, g, cell): a row for each corner and table. The exchange by cell serves the removal of copies, counts, pairs and hubs.
    one = rows.where(F.size("places") > 0).select(F.col("same").alias("e"), "places", F.posexplode("cells").alias("at", "cell"))
    dealt = one.select("e", F.get("places", F.floor(F.col("at") / TABLES).cast("int")).alias("g"), "cell").repartition("cell").dropDuplicates(["cell", "e", "g"])
    w = Window.partitionBy("cell")
    met = dealt.withColumns({"n": F.count("*").over(w), "hub": F.min(F.struct("e", "g")).over(w)}).where("n > 1")
    few = met.where(F.col("n") <= most).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("e", "g"))).alias("m"))
    after = F.transform("m", lambda x, i: F.struct(x.alias("x"), F.slice(F.col("m"), i + 2, F.size("m")).alias("ys")))
    pairs = few.select(F.explode(after).alias("p")).select("p.x", F.explode("p.ys").alias("y")).where("x.e <> y.e")
    pairs = pairs.select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), _match("x.g", "y.g"))
    to_hub = met.where((F.col("n") > most) & (F.col("e") != F.col("hub.e"))).select(F.col("hub.e").alias("a"), F.col("e").alias("b"), _match("hub.g", "g"))
    tried = _tried(pairs.unionByName(to_hub), agree).withColumns({"cell": F.lit(None).cast("long"), "g": F.lit(None).cast("int"), "n": F.lit(None).cast("long")})
    crowded = met.where(F.col("n") > most).select(F.col("e").alias("a"), F.col("hub.e").alias("b"), F.lit(None).cast("array<long>").alias("m"), "cell", "g", "n")
    tried = common.written(tried.unionByName(crowded), "tried")
    links = tried.where("cell IS NULL AND m IS NULL").select("a", "b")
    roots = common.components(links)
    if not tried.where("cell IS NOT NULL").isEmpty():
        links = common.written(links.unionByName(_left_over(tried, roots, agree)), "links")
        roots = common.components(links)
    own = rows.groupBy("same").agg(F.min("doc_id").alias("first")).join(roots.select(F.col("node").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    least = own.groupBy("root").agg(F.min("first").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("same")).groupBy("same").agg(F.count("*").alias("n_links"))
    named = own.join(least, "root").join(degree, "same", "left").select("same", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.select("doc_id", "same", "n_corners").join(named, "same").select("doc_id", "n_corners", "class_id", "n_links")


def _match(left: str, right: str) -> Column:
    """m: two places in one integer."""
    return F.shiftleft(F.col(left).cast("long"), 32).bitwiseOR(F.col(right).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("m")


def _tried(matches: DataFrame, agree: int) -> DataFrame:
    """(a, b, m): pairs of images; m is null where their matches reach a consensus, else it lists them. A pair has few matches, at most corners times tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for a, b, m in common.rows_of(batches, "a", "b", "m"):
                yield a, b, None if _agree(m, agree) else m

        return common.in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.list_(pa.int64()))]), 4096)

    return matches.groupBy("a", "b").agg(F.collect_set("m").alias("m")).mapInArrow(common.tidy(run), "a long, b long, m array<long>")


def _agree(matches: list[int], agree: int) -> bool:
    if len(matches) < agree:
        return False
    both = np.array(matches, dtype=np.int64)
    return consensus(both >> 32 & 0xFFFFFFFF, both & 0xFFFFFFFF, enough=agree) >= agree


def _left_over(tried: DataFrame, roots: DataFrame, agree: int) -> DataFrame:
    """(a, b): the links between classes that crowded cells hold and their hubs don't show.

    Images that agree by crowded cells alone share cells with `agree` corners or more. Cells have one order, the least crowded
    first; the first cell that such images share has at least `agree` corners of either at or after it. So an image
    only needs to be met in the cells of which that holds: its last and most crowded ones, up to agree - 1 corners, never serve.
    """
    crowd = tried.where("cell IS NOT NULL").select(F.col("a").alias("e"), F.col("b").alias("hub"), "cell", "g", "n")
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    of_e = roots.select(F.col("node").alias("e"), "root")
    crowd = crowd.join(of_hub, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    own = crowd.groupBy("e").agg(F.array_sort(F.collect_set(F.struct("n", "cell", "g", "hub_root"))).alias("s"))
    own = own.join(of_e, "e", "left").withColumn("root", F.coalesce("root", "e"))
    # at: 32 bits of the cell's hash and the corner's place in one integer each
    own = own.withColumn("at", F.transform("s", lambda x: F.shiftleft(x["cell"], 32).bitwiseOR(x["g"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    own = own.withColumn("n", F.size(F.array_distinct(F.transform("s", lambda x: x["g"]))))

    def corners_from(x: Column) -> Column:
        later = F.filter("s", lambda y: F.struct(y["n"], y["cell"]) >= F.struct(x["n"], x["cell"]))
        return F.size(F.array_distinct(F.transform(later, lambda y: y["g"])))

    serves = F.array_distinct(F.transform(F.filter("s", lambda x: corners_from(x) >= agree), lambda x: F.struct(x["cell"], x["hub_root"])))
    own = common.written(own.select("e", "root", "at", "n", F.when(F.col("n") >= agree, serves).alias("serves")), "crowded")
    met = own.select("e", "root", "at", F.explode("serves").alias("c")).select("e", "root", "at", "c.cell", "c.hub_root")
    x, y = (met.select(*(F.col(k).alias(f"{k}_{t}") for k in ("e", "root", "at", "hub_root")), "cell") for t in "ab")
    # a member of the hub's class needs no other such member
    by_cell = x.where("root_a <> hub_root_a").join(y, "cell").where("root_a <> root_b AND (e_a < e_b OR root_b = hub_root_b)")
    by_cell = by_cell.where(_shared("at_a", "at_b") >= agree).select(F.col("e_a").alias("a"), F.col("e_b").alias("b"), F.array().cast("array<long>").alias("m"), "at_a", "at_b")
    short = tried.where("cell IS NULL AND m IS NOT NULL").select("a", "b", "m")
    for t in "ab":
        side = own.select(F.col("e").alias(t), F.col("at").alias(f"at_{t}"), F.col("root").alias(f"root_{t}"), F.col("n").alias(f"n_{t}"))
        short = short.join(side, t).where(F.size("m") + F.col(f"n_{t}") >= agree)
    missing = F.greatest(F.lit(1), agree - F.size("m"))
    short = short.where((F.col("root_a") != F.col("root_b")) & (_shared("at_a", "at_b") >= missing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for a, b, m, left, right in common.rows_of(batches, "a", "b", "m", "at_a", "at_b"):
                if a > b:
                    a, b, left, right = b, a, right, left
                cells: dict[int, list[int]] = {}
                for v in left:
                    cells.setdefault(v >> 32, []).append(v & 0xFFFFFFFF)
                m = {*m, *(_signed(g << 32 | (v & 0xFFFFFFFF)) for v in right for g in cells.get(v >> 32, ()))}
                if _agree(sorted(m), agree):
                    yield a, b

        return common.in_batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]), 4096)

    return by_cell.unionByName(short.select("a", "b", "m", "at_a", "at_b")).mapInArrow(common.tidy(run), "a long, b long").distinct()


def _shared(left: str, right: str) -> Column:
    """How many corners of left lie in cells that right has too."""
    cells = F.transform(right, lambda v: F.shiftright(v, 32))
    return F.size(F.array_distinct(F.transform(F.filter(left, lambda v: F.array_contains(cells, F.shiftright(v, 32))), lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def scene(number: int, size: int = 64) -> np.ndarray:
    """A test picture: overlapping rectangles and a slope, drawn from the number."""
    rng = np.random.Generator(np.random.PCG64(number))
    out = np.tile(np.linspace(40, 140, size, dtype=np.float32), (size, 1))
    for y, x, h, w, v in rng.integers((0, 0, 6, 6, 0), (size, size, 22, 22, 256), (26, 5)):
        out[y : y + h, x : x + w] = 0.25 * out[y : y + h, x : x + w] + 0.75 * v
    return out


def fixture(number: int) -> bytes:
    """The picture of row `number`: of every four, the first is a scene, the second a crop of it, the third an edit, the fourth a scene of its own.

    Crops take off up to a quarter of a side; every fourth is turned by 90 degrees, every fourth is smaller (0.71) as
    well. Edits are brighter with less contrast and a label put in; every second has noise besides.
    """
    kind, own = number % 4, number - number % 4
    x, how = scene(own if kind < 3 else number), number // 4 % 4
    if kind == 1:
        x = (x[6:60, 4:62], x[6:60, 4:62], x[4:52, 10:60], x)[how]
        x = np.rot90(x) if how == 1 else resized(x[None], 0.5**0.5)[0] if how == 3 else x
    if kind == 2:
        x = x * 0.8 + 30
        x[50:60, 3:24] = 235
        if how % 2:
            x = x + np.random.Generator(np.random.PCG64(number)).normal(0, 1.5, x.shape)
    return encode_pgm(np.clip(x, 0, 255))


def fixtures(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, image): a picture for each row, for tables without a media column of their own."""
    id_arrow = common.arrow_type(rows, id_col)
    return common.per_row(rows, lambda: lambda r: (r[0], None if r[0] is None else fixture(r[0])), [id_col], {id_col: id_arrow, "image": pa.binary()}, f"{id_col} {common.ddl_type(rows, id_col)}, image binary")
