"""Independent SQL for every registered query, over the same tables.

Written from the formulas, not from the operators: polygons are tested edge by edge with
slab clipping, resampling starts from the target grid, medians are plain aggregates.
"""

from __future__ import annotations

from charscape.functions import projection as tm

_BASE = "https://store.example/fire-products"
_CAT = "https://catalog.example/stac"
_COG = "image/tiff; application=geotiff; profile=cloud-optimized"

OBS = """
obs AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS scene_id, l_shipdate AS ts,
         CASE WHEN l_linenumber % 2 = 1 THEN 'B8A' ELSE 'B12' END AS band,
         l_partkey // 50 AS "row", l_partkey % 50 AS col,
         ((l_partkey // 50) // 16) * 1000 + (l_partkey % 50) // 16 AS tile_id,
         -116.5 + (l_partkey % 50) * 0.0002 AS x, 33.8 + (l_partkey // 50) * 0.0002 AS y,
         l_quantity AS value, l_linenumber
  FROM lineitem)"""

_PRE = "ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'"
_POST = "ts BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '2001-12-31'"


def composite(source: str) -> str:
    return f"""
comp AS (
  SELECT tile_id, "row", col,
         median(CASE WHEN band = 'B8A' AND {_PRE} THEN value END) AS pre_nir,
         median(CASE WHEN band = 'B12' AND {_PRE} THEN value END) AS pre_swir,
         median(CASE WHEN band = 'B8A' AND {_POST} THEN value END) AS post_nir,
         median(CASE WHEN band = 'B12' AND {_POST} THEN value END) AS post_swir
  FROM {source} WHERE ({_PRE}) OR ({_POST})
  GROUP BY tile_id, "row", col)"""


GRID = (
    OBS
    + ","
    + composite("obs")
    + """,
nbrs AS (
  SELECT tile_id, "row", col,
         (pre_nir - pre_swir) / nullif(pre_nir + pre_swir, 0) AS prefire_nbr,
         (post_nir - post_swir) / nullif(post_nir + post_swir, 0) AS postfire_nbr
  FROM comp),
grid AS (
  SELECT *, prefire_nbr - postfire_nbr AS dnbr,
         (prefire_nbr - postfire_nbr)
           / CASE WHEN prefire_nbr = 0 THEN 0.001 ELSE sqrt(abs(prefire_nbr)) END AS rdnbr,
         (prefire_nbr - postfire_nbr) / nullif(prefire_nbr + 1.001, 0) AS rbr
  FROM nbrs)"""
)

PIXELS = """
pixels AS (SELECT p_partkey // 50 AS "row", p_partkey % 50 AS col FROM part)"""


def zones(null_type: bool = False) -> str:
    kind = "CASE WHEN s_suppkey % 10 <> 9 THEN r_name END" if null_type else "r_name"
    return f"""
zones AS (
  SELECT s_suppkey AS zone_id, {kind} AS veg_type,
         (s_suppkey % 10) * 5 + 0.25::DOUBLE AS c0, (s_suppkey // 10) * 4 + 0.25::DOUBLE AS r0
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


ZONE_EDGES = """
edges AS (
  SELECT zone_id, veg_type, c0 + a AS x1, r0 + b AS y1, c0 + c AS x2, r0 + d AS y2
  FROM zones, (VALUES (0,0,6,0), (6,0,6,3), (6,3,3,5), (3,5,0,5), (0,5,0,0)) AS e(a, b, c, d))"""


def _slab(p: str, q: str, low: str) -> tuple[str, str]:
    """Parameter range where a segment is within the open interval (low, low + 1)."""
    d = f"({q} - {p})"
    inside = f"{p} > {low} AND {p} < {low} + 1"
    enter = f"least(({low} - {p}) / nullif({d}, 0), ({low} + 1 - {p}) / nullif({d}, 0))"
    leave = f"greatest(({low} - {p}) / nullif({d}, 0), ({low} + 1 - {p}) / nullif({d}, 0))"
    return (
        f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 0 ELSE 2 END ELSE {enter} END",
        f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 1 ELSE -1 END ELSE {leave} END",
    )


_X_IN, _X_OUT = _slab("x1", "x2", "col")
_Y_IN, _Y_OUT = _slab("y1", "y2", '"row"')
_HIT = (
    f"greatest(0, {_X_IN}, {_Y_IN}) < least(1, {_X_OUT}, {_Y_OUT})"
)
_CROSSES = (
    '(y1 > "row" + 0.5) <> (y2 > "row" + 0.5) '
    'AND col + 0.5 < x1 + (x2 - x1) * ("row" + 0.5 - y1) / nullif(y2 - y1, 0)'
)


def tested(grid: str, edges: str, keys: str, box: str) -> str:
    """Per polygon and candidate pixel: centre inside, edge through the pixel."""
    return f"""
tested AS (
  SELECT {keys}, g."row", g.col,
         sum(CASE WHEN {_CROSSES} THEN 1 ELSE 0 END) % 2 = 1 AS inside,
         bool_or({_HIT}) AS hit
  FROM {box}
  JOIN {grid} g ON g."row" BETWEEN floor(b.miny) AND floor(b.maxy)
               AND g.col BETWEEN floor(b.minx) AND floor(b.maxx)
  JOIN {edges} e USING ({keys})
  GROUP BY {keys}, g."row", g.col)"""


_ZONE_BOX = (
    "(SELECT zone_id, c0 AS minx, r0 AS miny, c0 + 6 AS maxx, r0 + 5 AS maxy FROM zones) b"
)


def zone_pairs(grid: str, null_type: bool = False) -> str:
    return (
        zones(null_type)
        + ","
        + ZONE_EDGES
        + ","
        + tested(grid, "edges", "zone_id", _ZONE_BOX)
        + """,
pairs AS (SELECT zone_id, veg_type, "row", col FROM tested JOIN zones USING (zone_id)
          WHERE inside OR hit),
dissolved AS (SELECT DISTINCT veg_type, "row", col FROM pairs)"""
    )


def class_table(null_type: bool = False, measure: str = "area") -> str:
    def total(name: str, condition: str) -> str:
        what = "1.0::DOUBLE" if measure == "area" else "rbr"
        return f"coalesce(sum(CASE WHEN {condition} THEN {what} END), 0) * 0.04::DOUBLE AS {name}_ha"

    return (
        GRID
        + ","
        + zone_pairs("grid", null_type)
        + f""",
touched AS (SELECT d.veg_type, g.rbr FROM dissolved d JOIN grid g USING ("row", col)),
classes AS (
  SELECT veg_type, {total("unburned", "rbr >= -0.1 AND rbr < 0.1")},
         {total("low", "rbr >= 0.1 AND rbr < 0.27")},
         {total("moderate", "rbr >= 0.27 AND rbr < 0.66")},
         {total("high", "rbr >= 0.66")}
  FROM touched GROUP BY veg_type),
areas AS (
  SELECT veg_type, abs(sum(part)) * 400 / 10000 AS total_ha FROM (
    SELECT veg_type, (x1 * y2 - x2 * y1) / 2 AS part FROM edges) GROUP BY veg_type),
tab AS (
  SELECT a.veg_type, total_ha, coalesce(unburned_ha, 0) AS unburned_ha,
         coalesce(low_ha, 0) AS low_ha, coalesce(moderate_ha, 0) AS moderate_ha,
         coalesce(high_ha, 0) AS high_ha
  FROM areas a LEFT JOIN classes c ON a.veg_type IS NOT DISTINCT FROM c.veg_type),
full_tab AS (
  SELECT *, coalesce((low_ha * 0.185 + moderate_ha * 0.465 + high_ha * 0.83)
                     / nullif(total_ha, 0), 0) AS mean_severity,
         sum(total_ha) OVER () AS park_ha,
         sum(low_ha + moderate_ha + high_ha) OVER () AS burnt_ha,
         sum(unburned_ha) OVER () AS unburnt_ha
  FROM tab),
var_tab AS (
  SELECT *, (unburned_ha * pow(0.0 - mean_severity, 2) + low_ha * pow(0.185 - mean_severity, 2)
             + moderate_ha * pow(0.465 - mean_severity, 2)
             + high_ha * pow(0.83 - mean_severity, 2)) / nullif(total_ha, 0) AS variance
  FROM full_tab),
matrix AS (
  SELECT *, total_ha / nullif(park_ha, 0) * 100 AS pct_of_park,
         (low_ha + moderate_ha + high_ha) / nullif(burnt_ha, 0) * 100 AS pct_of_burn,
         CASE WHEN total_ha > 0 THEN CASE WHEN variance >= 0 THEN sqrt(variance) END
              ELSE 0 END AS std_severity,
         concat('#', substr(md5(coalesce(veg_type, 'None')), 1, 6)) AS color
  FROM var_tab)"""
    )


def _box_ring(a: str, b: str, c: str, d: str) -> str:
    pairs = [(a, b), (c, b), (c, d), (a, d), (a, b)]
    inner = " || ',' || ".join(f"'[' || {x}::VARCHAR || ',' || {y}::VARCHAR || ']'" for x, y in pairs)
    return f"""'{{"type":"Polygon","coordinates":[[' || {inner} || ']]}}'"""


ITEMS = f"""
raw_items AS (
  SELECT concat('event', o_orderkey % 20) AS fire_event_name,
         CAST((o_orderkey // 4) % 10 AS VARCHAR) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'fire_severity' WHEN 'O' THEN 'fire_boundary'
              ELSE 'vegetation_fire_matrix' END AS product_type,
         CASE o_orderstatus WHEN 'F' THEN 'severity' WHEN 'O' THEN 'boundary'
              ELSE 'veg-matrix' END AS infix,
         CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority < '3' THEN 'refined'
              ELSE 'coarse' END AS boundary_type,
         o_orderdate AS datetime, o_orderkey AS ingest_seq,
         -120.0::DOUBLE + (o_custkey % 40) * 0.1::DOUBLE AS minx,
         33.0::DOUBLE + (o_custkey % 30) * 0.1::DOUBLE AS miny
  FROM orders),
items AS (
  SELECT *, minx + 0.2::DOUBLE AS maxx, miny + 0.2::DOUBLE AS maxy,
         concat(fire_event_name, '-', infix, '-', job_id) AS id,
         concat('{_BASE}/', fire_event_name, '/', job_id, '/') AS folder,
         concat('?generation=', ingest_seq) AS version
  FROM raw_items)"""

REQUESTS = """
requests AS (
  SELECT fire_event_name, CAST(j AS VARCHAR) AS job_id
  FROM (SELECT DISTINCT fire_event_name FROM items), range(12) r(j))"""

FLAT = (
    "id, fire_event_name, job_id, product_type, boundary_type, datetime, "
    "minx, miny, maxx, maxy, ingest_seq"
)


def newest(keys: str, where: str = "true") -> str:
    return (
        f"SELECT * FROM items WHERE {where} QUALIFY row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY datetime DESC, ingest_seq DESC) = 1"
    )


_AOI = [(-118.3, 32.2), (-115.1, 33.9), (-117.9, 36.4), (-118.3, 32.2)]


def _aoi_test(table: str, key: str) -> str:
    """Boxes of a table that the area meets: an edge through, a corner in, or a vertex in."""
    edges = ", ".join(
        f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
        for a, b in zip(_AOI, _AOI[1:])
    )

    def slab(p: str, q: str, low: str, high: str) -> tuple[str, str]:
        d = f"nullif({q} - {p}, 0)"
        inside = f"{p} BETWEEN {low} AND {high}"
        return (
            f"CASE WHEN {q} = {p} THEN CASE WHEN {inside} THEN 0 ELSE 2 END "
            f"ELSE least(({low} - {p}) / {d}, ({high} - {p}) / {d}) END",
            f"CASE WHEN {q} = {p} THEN CASE WHEN {inside} THEN 1 ELSE -1 END "
            f"ELSE greatest(({low} - {p}) / {d}, ({high} - {p}) / {d}) END",
        )

    xi, xo = slab("x1", "x2", "minx", "maxx")
    yi, yo = slab("y1", "y2", "miny", "maxy")
    corner = (
        "sum(CASE WHEN (y1 > miny) <> (y2 > miny) AND "
        "minx < x1 + (x2 - x1) * (miny - y1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1"
    )
    return f"""
aoi(x1, y1, x2, y2) AS (VALUES {edges}),
met AS (
  SELECT {key} FROM {table}, aoi GROUP BY {key}
  HAVING bool_or(greatest(0, {xi}, {yi}) <= least(1, {xo}, {yo})) OR {corner})"""


def _tm_forward(lon: str, lat: str) -> tuple[str, str, str]:
    """Named intermediate columns, then easting and northing."""
    lam = f"radians({lon} - ({tm.central_meridian(tm.DEFAULT_ZONE)}))"
    phi = f"radians({lat})"
    xi = "xi + " + " + ".join(
        f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(tm.ALPHA, 1)
    )
    eta = "eta + " + " + ".join(
        f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(tm.ALPHA, 1)
    )
    k = repr(tm.SCALE * tm.RECTIFYING_RADIUS)
    tau = f"sinh(atanh(sin({phi})) - {tm._ECC!r} * atanh({tm._ECC!r} * sin({phi})))"
    staged = (
        f"atan2({tau}, cos({lam})) AS xi, "
        f"atanh(sin({lam}) / sqrt(1 + pow({tau}, 2))) AS eta"
    )
    return staged, f"{tm.FALSE_EASTING} + {k} * ({eta})", f"{k} * ({xi})"


def _tm_inverse() -> tuple[str, str, str, str]:
    """Stages from x and y: scaled, rectified, conformal; then longitude and latitude."""
    k = repr(tm.SCALE * tm.RECTIFYING_RADIUS)
    first = f"y / {k} AS xi, (x - {tm.FALSE_EASTING}) / {k} AS eta"
    second = (
        "xi - ("
        + " + ".join(
            f"({b!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(tm.BETA, 1)
        )
        + ") AS xi0, eta - ("
        + " + ".join(
            f"({b!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(tm.BETA, 1)
        )
        + ") AS eta0"
    )
    third = "asin(sin(xi0) / cosh(eta0)) AS chi"
    last = (
        f"degrees(atan2(sinh(eta0), cos(xi0))) + ({tm.central_meridian(tm.DEFAULT_ZONE)}) AS lon, "
        "degrees(chi + "
        + " + ".join(f"({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(tm.DELTA, 1))
        + ") AS lat"
    )
    return first, second, third, last


SCENES = """
scenes AS (
  SELECT event_id AS scene_id, ts,
         CASE WHEN event_type IN ('view', 'click') THEN 'sentinel-2-l2a' ELSE 'other' END
           AS collection,
         -120.0::DOUBLE + (user_id % 15) * 0.5::DOUBLE AS minx,
         32.0::DOUBLE + (user_id // 15) * 0.5::DOUBLE AS miny,
         -120.0::DOUBLE + (user_id % 15) * 0.5::DOUBLE + 1 AS maxx,
         32.0::DOUBLE + (user_id // 15) * 0.5::DOUBLE + 1 AS maxy
  FROM events)"""


def _ring_text(close: bool = True) -> str:
    points = [(0, 0), (6, 0), (6, 3), (3, 5), (0, 5)] + ([(0, 0)] if close else [])
    return " || ',' || ".join(
        f"'[' || (c0 + {x})::VARCHAR || ',' || (r0 + {y})::VARCHAR || ']'" for x, y in points
    )


_POLY = f"""('{{"type":"Polygon","coordinates":[[' || {_ring_text()} || ']]}}')"""

DOCS = (
    zones()
    + f""",
docs AS (
  SELECT zone_id, veg_type, c0, r0,
    CASE zone_id % 7
      WHEN 0 THEN {_POLY}
      WHEN 1 THEN '{{"type":"Feature","geometry":' || {_POLY}
                  || ',"properties":{{"name":"' || veg_type || '"}}}}'
      WHEN 2 THEN '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":'
                  || {_POLY} || ',"properties":{{"name":"' || veg_type || '"}}}}]}}'
      WHEN 3 THEN '{{"type":"MultiPolygon","coordinates":[[[' || {_ring_text()} || ']]]}}'
      WHEN 4 THEN '{{"type":"Polygon","coordinates":[[' || {_ring_text(False)} || ']]}}'
      WHEN 5 THEN substr({_POLY}, 1, 30)
      ELSE '{{"type":"Polygon"}}' END AS text
  FROM zones),
parsed AS (
  SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS doc FROM docs),
shaped AS (
  SELECT *, coalesce(doc->'$.geometry', doc->'$.features[0].geometry', doc) AS shape FROM parsed),
checked AS (
  SELECT *, CASE
      WHEN doc IS NULL THEN 'malformed json'
      WHEN shape->>'$.type' IS DISTINCT FROM 'Polygon' THEN 'not a polygon'
      WHEN coalesce(json_array_length(shape->'$.coordinates'), 0) = 0 THEN 'no coordinates'
      WHEN json_array_length(shape->'$.coordinates[0]') < 4 THEN 'ring of fewer than four points'
      WHEN (shape->'$.coordinates[0][0]')::VARCHAR
           <> (shape->'$.coordinates[0][#-1]')::VARCHAR THEN 'ring not closed'
    END AS reason
  FROM shaped),
accepted AS (SELECT * FROM checked WHERE reason IS NULL)"""
)
_FEATURE = (
    f"""'{{"type":"Feature","geometry":' || {_POLY}"""
    """ || ',"properties":{"created":"2024-06-01T00:00:00Z"}}'"""
)

INTERVALS = """
intervals AS (
  SELECT o_orderkey,
    CASE o_orderkey % 7
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '/'
                  || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')
      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '/..'
      WHEN 2 THEN '../' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')
      WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '/'
                  || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')
      WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') || '/'
                  || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') || '/x'
      ELSE '/nonsense' END AS interval
  FROM orders),
bounds AS (
  SELECT *, CASE WHEN len(string_split(interval, '/')) = 2
                 THEN try_cast(rtrim(string_split(interval, '/')[1], 'Z') AS TIMESTAMP) END
              AS start_ts,
         CASE WHEN len(string_split(interval, '/')) = 2
              THEN try_cast(rtrim(string_split(interval, '/')[2], 'Z') AS TIMESTAMP) END AS end_ts
  FROM intervals)"""


def _status(kind: str, where: str, cog: str, geo: str, veg: str) -> str:
    return f"""
  SELECT r.fire_event_name, r.job_id, '{kind}' AS kind,
         CASE WHEN i.id IS NULL THEN 'pending' ELSE 'complete' END AS status,
         {cog} AS cog_url, {geo} AS refined_geojson_url, {veg} AS fire_veg_matrix
  FROM requests r LEFT JOIN ({newest("fire_event_name, job_id", where)}) i
    USING (fire_event_name, job_id)"""


_COARSE = "product_type = 'fire_severity' AND boundary_type = 'coarse'"
_REFINED = "product_type = 'fire_severity' AND boundary_type = 'refined'"
_BOUNDARY = "product_type = 'fire_boundary' AND boundary_type = 'refined'"
_MATRIX = "product_type = 'vegetation_fire_matrix'"
_RECT = _box_ring("minx", "miny", "maxx", "maxy")
_SEARCH = "datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-06-30'"
_MATRIX_COLUMNS = (
    "unburned_ha", "low_ha", "moderate_ha", "high_ha", "total_ha",
    "pct_of_park", "pct_of_burn", "mean_severity", "std_severity",
)
_ROUNDED_MATRIX = ", ".join(f"round({c}, 6) AS {c}" for c in _MATRIX_COLUMNS)
_PRESENTED = (
    'color AS "Color", veg_type AS "Vegetation Community", round(total_ha, 2) AS "Hectares", '
    'round(pct_of_park, 2) AS "% of Park", round(pct_of_burn, 2) AS "% of Burn Area", '
    'round(mean_severity, 3) AS "Mean Severity", round(std_severity, 3) AS "Std Dev"'
)
_INDEX_NAMES = ("prefire_nbr", "postfire_nbr", "dnbr", "rdnbr", "rbr")


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _pyramid() -> str:
    levels = []
    for k in (1, 2, 3):
        levels.append(
            f'SELECT {k} AS level, "row" // {2 ** k} AS "row", col // {2 ** k} AS col, '
            f"round(avg(rbr), 6) AS rbr, count(rbr) AS pixels FROM grid GROUP BY 1, 2, 3"
        )
    return _with(GRID) + " UNION ALL ".join(levels)


def _clip() -> str:
    box = """
box AS (SELECT min(c0) AS minx, min(r0) AS miny, max(c0) + 6 AS maxx, max(r0) + 5 AS maxy
        FROM zones),
edges AS (
  SELECT 1 AS p, minx AS x1, miny AS y1, maxx AS x2, miny AS y2 FROM box UNION ALL
  SELECT 1, maxx, miny, (minx + maxx) / 2, maxy FROM box UNION ALL
  SELECT 1, (minx + maxx) / 2, maxy, minx, miny FROM box)"""
    return (
        _with(GRID, zones(), box, tested("grid", "edges", "p", "(SELECT 1 AS p, * FROM box) b"))
        + 'SELECT "row", col, rbr FROM grid JOIN tested USING ("row", col) WHERE inside OR hit'
    )


def _points() -> str:
    staged, x, y = _tm_forward(
        '(-116.5 + (col + 0.5) * 0.0002)', '(33.8 + ("row" + 0.5) * 0.0002)'
    )
    return (
        _with(PIXELS, f'staged AS (SELECT "row", col, {staged} FROM pixels)')
        + f'SELECT "row", col, round({x}, 3) AS utm_x, round({y}, 3) AS utm_y FROM staged'
    )


def _areas() -> str:
    """Triangles of the suppliers, with their corners."""
    return """
areas AS (
  SELECT *, x0 + 0.8 AS x1, y0 + 0.3 AS y1, x0 + 0.2 AS x2, y0 + 0.9 AS y2,
    first + INTERVAL 9 DAY AS last
  FROM (SELECT s_suppkey::VARCHAR AS job_id, -120.0::DOUBLE + s_suppkey % 37 * 0.21::DOUBLE AS x0,
          32.0::DOUBLE + s_suppkey * 7 % 41 * 0.17::DOUBLE AS y0,
          TIMESTAMP '2024-01-01' + to_days((s_suppkey % 20)::INTEGER) AS first FROM supplier))"""


def _meets(box: str, area: str) -> str:
    """A box and a triangle meet unless an axis or a side of the triangle lies between them."""
    corners = [f"{area}.x{i}, {area}.y{i}" for i in range(3)]
    tests = [f"{box}.minx <= {area}.x1 AND {box}.maxx >= {area}.x0",
             f"{box}.miny <= {area}.y2 AND {box}.maxy >= {area}.y0"]
    for i in range(3):
        (ax, ay), (bx, by) = corners[i].split(", "), corners[(i + 1) % 3].split(", ")
        sides = [f"(({bx} - {ax}) * ({box}.{y} - {ay}) - ({by} - {ay}) * ({box}.{x} - {ax}))"
                 for x in ("minx", "maxx") for y in ("miny", "maxy")]
        tests.append(f"greatest({', '.join(sides)}) >= 0")
    return "(" + " AND ".join(tests) + ")"


def _regrid() -> str:
    """From the target: every pixel of a box around the projected source looks up its source."""
    staged, x, y = _tm_forward("lon", "lat")
    first, second, third, last = _tm_inverse()
    return (
        _with(
            GRID,
            """
corners AS (
  SELECT lon, lat FROM (SELECT -116.5 AS lon UNION ALL
                        SELECT -116.5 + (max(col) + 1) * 0.0002 FROM grid),
                       (SELECT 33.8 AS lat UNION ALL
                        SELECT 33.8 + (max("row") + 1) * 0.0002 FROM grid))""",
            f"s0 AS (SELECT {staged} FROM corners)",
            f"s1 AS (SELECT {x} AS x, {y} AS y FROM s0)",
            """
ends AS (SELECT CAST(floor((min(x) - 546000) / 20) AS BIGINT) - 3 AS c0,
                CAST(floor((max(x) - 546000) / 20) AS BIGINT) + 3 AS c1,
                CAST(floor((min(y) - 3739000) / 20) AS BIGINT) - 3 AS r0,
                CAST(floor((max(y) - 3739000) / 20) AS BIGINT) + 3 AS r1 FROM s1)""",
            """
spine AS (SELECT r AS t_row, c AS t_col, 546000.0 + (c + 0.5) * 20.0 AS x,
                 3739000.0 + (r + 0.5) * 20.0 AS y
          FROM (SELECT unnest(range(r0, r1 + 1)) AS r FROM ends),
               (SELECT unnest(range(c0, c1 + 1)) AS c FROM ends))""",
            f"i0 AS (SELECT t_row, t_col, {first} FROM (SELECT t_row, t_col, x::DOUBLE AS x, "
            "y::DOUBLE AS y FROM spine))",
            f"i1 AS (SELECT t_row, t_col, {second} FROM i0)",
            f"i2 AS (SELECT *, {third} FROM i1)",
            f"i3 AS (SELECT t_row, t_col, {last} FROM i2)",
            """
found AS (SELECT t_row, t_col, CAST(floor((lat - 33.8) / 0.0002) AS BIGINT) AS s_row,
                 CAST(floor((lon - (-116.5)) / 0.0002) AS BIGINT) AS s_col FROM i3)""",
        )
        + 'SELECT CAST(floor(t_row / 16.0) * 1000 + floor(t_col / 16.0) AS BIGINT) AS tile_id, '
        't_row AS "row", t_col AS col, rbr FROM found '
        'JOIN grid ON s_row = grid."row" AND s_col = grid.col'
    )


def _projected_jobs() -> str:
    """Three jobs over projected zones: pixels of the target look up their source, edges meet pixels."""
    regrid = _regrid()
    pixels = regrid[:regrid.rindex("SELECT CAST(floor(t_row")]
    staged, x, y = _tm_forward("lon", "lat")
    names = ("unburned", "low", "moderate", "high")
    breaks = ("-0.1 AND rbr < 0.1", "0.1 AND rbr < 0.27", "0.27 AND rbr < 0.66", "0.66")
    classes = ", ".join(
        f"coalesce(sum(CASE WHEN rbr >= {b} THEN 1.0::DOUBLE END), 0) * 0.04::DOUBLE AS {n}_ha"
        for n, b in zip(names, breaks))
    return (
        pixels.rstrip()
        + ", utm AS (SELECT t_row AS \"row\", t_col AS col, rbr, j::VARCHAR AS job_id FROM found "
        'JOIN grid ON s_row = grid."row" AND s_col = grid.col, range(3) r(j) '
        'WHERE (s_row * 7 + s_col) % 4 <> j), '
        + zones() + ", "
        + f"""
ends_ll AS (
  SELECT zone_id, veg_type, k, -116.5 + (c0 + a) * 0.0002 AS lon, 33.8 + (r0 + b) * 0.0002 AS lat
  FROM zones, (VALUES (0,0,0), (1,6,0), (2,6,3), (3,3,5), (4,0,5), (5,0,0)) AS e(k, a, b)),
ends_s AS (SELECT zone_id, veg_type, k, {staged} FROM ends_ll),
ends_m AS (SELECT zone_id, veg_type, k, {x} AS x, {y} AS y FROM ends_s),
edges AS (
  SELECT p.zone_id, p.veg_type, (p.x - 546000) / 20 AS x1, (p.y - 3739000) / 20 AS y1,
         (q.x - 546000) / 20 AS x2, (q.y - 3739000) / 20 AS y2, p.x * q.y - q.x * p.y AS twice
  FROM ends_m p JOIN ends_m q ON p.zone_id = q.zone_id AND q.k = p.k + 1),
spots AS (SELECT DISTINCT "row", col FROM utm),
{tested("spots", "edges", "zone_id",
        "(SELECT zone_id, min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, "
        "max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy FROM edges GROUP BY zone_id) b")},
kinds AS (SELECT DISTINCT veg_type, "row", col FROM tested JOIN zones USING (zone_id) WHERE inside OR hit),
classes AS (SELECT job_id, veg_type, {classes} FROM kinds JOIN utm USING ("row", col) GROUP BY job_id, veg_type),
areas AS (SELECT veg_type, sum(ha) AS total_ha FROM (
  SELECT zone_id, veg_type, abs(sum(twice)) / 2 / 10000 AS ha FROM edges GROUP BY zone_id, veg_type)
  GROUP BY veg_type),
tab AS (
  SELECT j::VARCHAR AS job_id, a.veg_type, total_ha, {", ".join(f"coalesce({n}_ha, 0) AS {n}_ha" for n in names)}
  FROM areas a JOIN range(4) r(j) ON true LEFT JOIN classes c ON c.veg_type = a.veg_type AND c.job_id = j::VARCHAR),
full_tab AS (
  SELECT *, coalesce((low_ha * 0.185 + moderate_ha * 0.465 + high_ha * 0.83) / nullif(total_ha, 0), 0) AS mean_severity,
    sum(total_ha) OVER (PARTITION BY job_id) AS park_ha,
    sum(low_ha + moderate_ha + high_ha) OVER (PARTITION BY job_id) AS burnt_ha FROM tab),
matrix AS (
  SELECT *, total_ha / nullif(park_ha, 0) * 100 AS pct_of_park,
    (low_ha + moderate_ha + high_ha) / nullif(burnt_ha, 0) * 100 AS pct_of_burn,
    sqrt((unburned_ha * pow(0.0 - mean_severity, 2) + low_ha * pow(0.185 - mean_severity, 2)
      + moderate_ha * pow(0.465 - mean_severity, 2) + high_ha * pow(0.83 - mean_severity, 2)) / total_ha) AS std_severity
  FROM full_tab)
SELECT job_id, veg_type, {", ".join(f"round({c}, 4) AS {c}" for c in _MATRIX_COLUMNS)} FROM matrix"""
    )


def _built() -> str:
    """The three builders side by side, as flat columns."""
    folder = f"concat('{_BASE}/', fire_event_name, '/', job_id, '/')"
    shared = (
        "fire_event_name, job_id, datetime, minx, miny, maxx, maxy, ingest_seq, "
        f"{_RECT} AS geometry"
    )
    return f"""
jobs AS (SELECT * REPLACE (coalesce(boundary_type, 'coarse') AS boundary_type) FROM items),
built AS (
  SELECT concat(fire_event_name, '-severity-', job_id) AS id, {shared},
         'fire_severity' AS product_type, boundary_type, NULL AS title, NULL AS description,
         concat({folder}, 'rbr.tif') AS first_href, 1 AS links, 1 AS assets,
         'Relativized Burn Ratio (RBR)' AS asset_title FROM jobs
  UNION ALL BY NAME
  SELECT concat(fire_event_name, '-boundary-', job_id) AS id, {shared},
         'fire_boundary' AS product_type, boundary_type,
         concat(fire_event_name, ' ', boundary_type, ' boundary') AS title, NULL AS description,
         concat({folder}, 'boundary.geojson') AS first_href, 4 AS links, 2 AS assets,
         concat(upper(boundary_type[1]), boundary_type[2:], ' Fire Severity') AS asset_title
  FROM jobs
  UNION ALL BY NAME
  SELECT concat(fire_event_name, '-veg-matrix-', job_id) AS id, {shared},
         'vegetation_fire_matrix' AS product_type, NULL AS boundary_type,
         concat('Vegetation Fire Matrix for ', fire_event_name) AS title,
         'Matrix of vegetation types affected by different fire severity classes' AS description,
         concat({folder}, 'veg_fire_matrix.csv') AS first_href, 4 AS links, 1 AS assets,
         'Vegetation Fire Severity Matrix' AS asset_title FROM jobs)"""


def _feature_lines() -> str:
    def asset(name: str, file_name: str, media: str) -> str:
        return (
            f"""'"{name}":{{"href":"' || folder || '{file_name}' || version ||"""
            f""" '","type":"{media}","roles":["data"]}}'"""
        )

    assets = f"""CASE product_type
      WHEN 'fire_severity' THEN {asset('rbr', 'rbr.tif', _COG)}
      WHEN 'fire_boundary' THEN
        {asset('refined_boundary', 'refined_boundary.geojson', 'application/geo+json')} || ',' ||
        {asset('refined_severity', 'refined_rbr.tif', _COG)}
      ELSE {asset('veg_fire_matrix', 'veg_fire_matrix.csv', 'text/csv')} END"""
    ring = _box_ring("minx", "miny", "maxx", "maxy").split("|| ", 1)[1].rsplit(" || ", 1)[0]
    # Parsed documents come back with sorted keys and without a trailing ".0".
    geometry = (
        f"""'{{"coordinates":[[' || regexp_replace({ring}, '\\.0([,\\]])', '\\1', 'g')"""
        """ || ']],"type":"Polygon"}'"""
    )
    boundary = (
        """coalesce(',"boundary_type":"' || boundary_type || '"', '')"""
    )
    return f"""
SELECT '{{"type":"Feature","stac_version":"1.0.0","id":"' || id || '","properties":{{"datetime":"'
  || strftime(datetime, '%Y-%m-%dT%H:%M:%SZ') || '","fire_event_name":"' || fire_event_name
  || '","job_id":"' || job_id || '","product_type":"' || product_type || '"' || {boundary}
  || '}},"geometry":' || {geometry}
  || ',"bbox":[' || minx || ',' || miny || ',' || maxx || ',' || maxy || '],"assets":{{'
  || {assets} || '}},"links":[{{"rel":"self","href":"{_CAT}/' || fire_event_name || '/items/'
  || id || '.json","type":"application/json"}}]}}' AS feature
FROM items WHERE fire_event_name = 'event7' AND {_SEARCH}"""


def _flat(where: str = "true") -> str:
    return _with(ITEMS) + f"SELECT {FLAT} FROM items WHERE {where}"


ORACLES: dict[str, str] = {
    "scene_search": _with(SCENES, _aoi_test("scenes", "scene_id, minx, miny, maxx, maxy"))
    + "SELECT s.scene_id, ts, s.minx, s.miny, s.maxx, s.maxy FROM scenes s JOIN met USING (scene_id) "
    "WHERE collection = 'sentinel-2-l2a' "
    "AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'",
    "scene_search_jobs": _with(SCENES, _areas())
    + "SELECT job_id, scene_id, ts FROM scenes s JOIN areas a ON " + _meets("s", "a")
    + " WHERE collection = 'sentinel-2-l2a' AND ts BETWEEN first AND last",
    "aoi_intersects_jobs": _with(ITEMS, _areas())
    + "SELECT a.job_id AS area_id, ingest_seq FROM items s JOIN areas a ON " + _meets("s", "a"),
    "observation_scan_jobs": _with(OBS, """
corner AS (SELECT max(p_partkey // 50) * 0.02 AS top FROM part),
jobs AS (
  SELECT 'south-west' AS job_id, -116.487 AS minx, 33.813 AS miny FROM corner UNION ALL
  SELECT 'north-east', -115.647, 33.8 + top - 0.067 FROM corner)""")
    + """SELECT job_id, tile_id, "row", col, band, ts, value FROM obs, jobs
WHERE -116.5 + col * 0.02 BETWEEN minx - 0.02 AND minx + 0.12
  AND 33.8 + "row" * 0.02 BETWEEN miny - 0.016 AND miny + 0.096
  AND (ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'
    OR ts BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '2001-12-31')""",
    "observation_scan": _with(OBS)
    + 'SELECT scene_id, ts, band, "row", col, value FROM obs WHERE x BETWEEN -116.4985 AND '
    "-116.4935 AND y BETWEEN 33.7999 AND 33.8071",
    "buffered_bounds": _with(
        ITEMS,
        zones(),
        """
boxes AS (
  SELECT 'item' AS source, ingest_seq AS key, minx, miny, maxx, maxy FROM items UNION ALL
  SELECT 'zone', zone_id, c0, r0, c0 + 6, r0 + 5 FROM zones)""",
    )
    + "SELECT source, key, round(minx - least((maxx - minx) / 5, 0.25), 6) AS minx, "
    "round(miny - least((maxy - miny) / 5, 0.25), 6) AS miny, "
    "round(maxx + least((maxx - minx) / 5, 0.25), 6) AS maxx, "
    "round(maxy + least((maxy - miny) / 5, 0.25), 6) AS maxy FROM boxes",
    "severity_grid_scan": _with(GRID)
    + 'SELECT "row", col, rbr, 0.04::DOUBLE AS pixel_area_ha FROM grid',
    "zone_scan": _with(zones())
    + "SELECT zone_id, veg_type, round(-116.5 + c0 * 0.0002, 6) AS minx, "
    "round(33.8 + r0 * 0.0002, 6) AS miny, round(-116.5 + (c0 + 6) * 0.0002, 6) AS maxx, "
    "round(33.8 + (r0 + 5) * 0.0002, 6) AS maxy, 6::BIGINT AS points FROM zones",
    "items_scan": _flat(),
    "collection_listing": _with(ITEMS)
    + "SELECT DISTINCT fire_event_name, 'child' AS rel, "
    "concat('/stac/collections/', fire_event_name) AS href, 'application/json' AS type, "
    "fire_event_name AS title FROM items",
    "items_publish": _flat(),
    "index_grid_sink": _with(GRID)
    + """SELECT 'event-1' AS fire_event_name, 'job-1' AS job_id, "row", col, """
    + ", ".join(f"coalesce({n}, -9999)::FLOAT::DOUBLE AS {n}" for n in _INDEX_NAMES)
    + " FROM grid",
    "overview_pyramid": _pyramid(),
    "matrix_csv_sink": _with(class_table()) + f"SELECT {_PRESENTED} FROM matrix",
    "items_append": _with(ITEMS, _built()) + f"SELECT {FLAT} FROM built",
    "geojson_sink": _with(DOCS)
    + "SELECT concat('event', zone_id % 20) AS fire_event_name, zone_id AS job_id, "
    """'uploaded' AS name, '{"type":"FeatureCollection","features":[' || """
    + _FEATURE
    + " || ']}' AS document FROM accepted",
    "publish_urls": _with(ITEMS)
    + "SELECT ingest_seq, "
    + ", ".join(f"folder || '{n}.tif' AS {n}_url" for n in _INDEX_NAMES)
    + " FROM items",
    "date_window_filter": _with(OBS)
    + f'SELECT scene_id, ts, band, "row", col, value FROM obs WHERE {_PRE}',
    "band_select": _with(OBS) + """SELECT scene_id, "row", col, value FROM obs WHERE band = 'B8A'""",
    "full_date_range": _with(OBS)
    + "SELECT scene_id, ts FROM obs WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND "
    "TIMESTAMP '2001-12-31'",
    "severity_classify": _with(GRID)
    + """SELECT "row", col, rbr, CASE WHEN rbr >= 0.66 THEN 'high' WHEN rbr >= 0.27 THEN 'moderate'
  WHEN rbr >= 0.1 THEN 'low' WHEN rbr >= -0.1 THEN 'unburned' END AS severity_class FROM grid""",
    "severity_masks": _with(GRID)
    + """SELECT "row", col, CASE WHEN rbr >= -0.1 AND rbr < 0.1 THEN rbr ELSE 0 END AS unburned,
  CASE WHEN rbr >= 0.1 AND rbr < 0.27 THEN rbr ELSE 0 END AS low,
  CASE WHEN rbr >= 0.27 AND rbr < 0.66 THEN rbr ELSE 0 END AS moderate,
  CASE WHEN rbr >= 0.66 THEN rbr ELSE 0 END AS high FROM grid""",
    "nodata_normalise": _with(OBS)
    + "SELECT scene_id, CASE WHEN l_linenumber < 5 THEN value END AS value, "
    "CASE WHEN l_linenumber < 5 THEN value ELSE -9999 END AS stored FROM obs",
    "clip_grid": _clip(),
    "project_points": _points(),
    "regrid_nearest": _regrid(),
    "aoi_intersects": _with(ITEMS, _aoi_test("items", "ingest_seq, minx, miny, maxx, maxy"))
    + "SELECT ingest_seq, id FROM items JOIN met USING (ingest_seq)",
    "items_by_event": _flat("fire_event_name = 'event7'"),
    "item_by_id": _with(ITEMS)
    + f"""SELECT {FLAT} FROM ({newest("id", "id = 'event7-severity-1'")})""",
    "item_by_id_and_boundary": _with(ITEMS)
    + f"SELECT {FLAT} FROM ("
    + newest("id", "id = 'event7-boundary-6' AND boundary_type = 'refined'")
    + ")",
    "items_search": _flat(
        "fire_event_name = 'event7' AND product_type = 'fire_severity' AND minx <= -117.05 "
        f"AND maxx >= -118.95 AND miny <= 35.05 AND maxy >= 33.95 AND {_SEARCH}"
    ),
    "matrix_presentation": _with(class_table()) + f"SELECT {_PRESENTED} FROM matrix",
    "align_pre_post": _with(
        OBS,
        *[
            f"""
{name} AS (
  SELECT "row", col, (nir - swir) / nullif(nir + swir, 0) AS {name}_nbr FROM (
    SELECT "row", col, median(CASE WHEN band = 'B8A' THEN value END) AS nir,
           median(CASE WHEN band = 'B12' THEN value END) AS swir
    FROM obs WHERE {window} GROUP BY "row", col))"""
            for name, window in (("prefire", _PRE), ("postfire", _POST))
        ],
    )
    + 'SELECT "row", col, prefire_nbr, postfire_nbr FROM prefire JOIN postfire USING ("row", col)',
    "zone_pixel_join": _with(PIXELS, zone_pairs("pixels"))
    + 'SELECT zone_id, veg_type, "row", col FROM pairs',
    "zone_pixel_join_center": _with(
        PIXELS,
        zone_pairs("pixels"),
        "ids AS (SELECT veg_type, dense_rank() OVER (ORDER BY veg_type) AS id "
        "FROM (SELECT DISTINCT veg_type FROM zones))",
        """
burnt AS (SELECT "row", col, max_by(id, zone_id) AS id FROM tested JOIN zones USING (zone_id)
          JOIN ids USING (veg_type) WHERE inside GROUP BY "row", col)""",
    )
    + 'SELECT "row", col, CAST(coalesce(id, 0) AS INTEGER) AS category_id '
    'FROM pixels LEFT JOIN burnt USING ("row", col)',
    "related_items": _with(
        ITEMS,
        f"sev AS ({newest('fire_event_name, job_id', 'product_type = ' + repr('fire_severity'))})",
    )
    + """SELECT i.ingest_seq, i.id, i.product_type, s.id AS related_id,
  s.folder || 'rbr.tif' || s.version AS related_href
FROM items i LEFT JOIN sev s USING (fire_event_name, job_id)
WHERE i.product_type <> 'fire_severity'""",
    "job_status": _with(ITEMS, REQUESTS)
    + " UNION ALL ".join(
        [
            _status(
                "analyze_fire_severity",
                _COARSE,
                "i.folder || 'rbr.tif' || i.version",
                "NULL::VARCHAR",
                "NULL::VARCHAR",
            ),
            _status(
                "refine",
                _BOUNDARY,
                "i.folder || 'refined_rbr.tif' || i.version",
                "i.folder || 'refined_boundary.geojson' || i.version",
                "NULL",
            ),
            _status(
                "resolve_against_veg_map",
                _MATRIX,
                "NULL",
                "NULL",
                "i.folder || 'veg_fire_matrix.csv' || i.version",
            ),
        ]
    ),
    "pending_jobs": _with(ITEMS, REQUESTS)
    + "SELECT fire_event_name, job_id FROM requests r WHERE NOT EXISTS (SELECT 1 FROM items i "
    f"WHERE i.fire_event_name = r.fire_event_name AND i.job_id = r.job_id AND {_MATRIX})",
    "finished_jobs": _with(ITEMS, REQUESTS)
    + "SELECT fire_event_name, job_id FROM requests r WHERE EXISTS (SELECT 1 FROM items i "
    f"WHERE i.fire_event_name = r.fire_event_name AND i.job_id = r.job_id AND {_BOUNDARY})",
    "matrix_item_lineage": _with(ITEMS, REQUESTS)
    + f"""SELECT concat(fire_event_name, '-veg-matrix-', job_id) AS id, datetime,
  {_RECT} AS geometry, minx, miny, maxx, maxy,
  concat('{_BASE}/', fire_event_name, '/', job_id, '/veg_fire_matrix.csv') AS matrix_url
FROM requests JOIN ({newest("fire_event_name, job_id", _REFINED)}) USING (fire_event_name, job_id)""",
    "refine_lineage": _with(ITEMS, REQUESTS)
    + f"""SELECT r.fire_event_name, r.job_id, i.folder || 'rbr.tif' || i.version AS source_url,
  i.datetime, CASE WHEN i.id IS NULL THEN 'error' ELSE 'ready' END AS status
FROM requests r LEFT JOIN ({newest("fire_event_name, job_id", _COARSE)}) i
  USING (fire_event_name, job_id)""",
    **{
        name: _with(
            OBS,
            "clean AS (SELECT * REPLACE (CASE WHEN l_linenumber < 5 THEN value END AS value) "
            "FROM obs)",
            composite("clean"),
        )
        + "SELECT * FROM comp"
        for name in ("median_composite", "median_composite_ranked")
    },
    "nbr": _with(GRID) + 'SELECT tile_id, "row", col, prefire_nbr, postfire_nbr FROM grid',
    "burn_indices": _with(GRID) + "SELECT * FROM grid",
    "dissolve_zones": _with(PIXELS, zone_pairs("pixels"))
    + 'SELECT veg_type, "row", col FROM dissolved',
    "zonal_class_area": _with(class_table())
    + "SELECT veg_type, round(unburned_ha, 6) AS unburned_ha, round(low_ha, 6) AS low_ha, "
    "round(moderate_ha, 6) AS moderate_ha, round(high_ha, 6) AS high_ha FROM classes",
    "zonal_class_value_sum": _with(class_table(measure="value_sum"))
    + "SELECT veg_type, round(unburned_ha, 6) AS unburned_ha, round(low_ha, 6) AS low_ha, "
    "round(moderate_ha, 6) AS moderate_ha, round(high_ha, 6) AS high_ha FROM classes",
    "zone_area": _with(class_table(null_type=True))
    + "SELECT veg_type, round(total_ha, 6) AS total_ha, polygons FROM areas JOIN "
    "(SELECT veg_type AS v, count(*) AS polygons FROM zones GROUP BY 1) "
    "ON veg_type IS NOT DISTINCT FROM v",
    "park_total": _with(class_table())
    + "SELECT DISTINCT round(park_ha, 6) AS park_ha, round(burnt_ha, 6) AS burnt_ha, "
    "round(unburnt_ha, 6) AS unburnt_ha FROM full_tab",
    "class_percentages": _with(class_table())
    + "SELECT veg_type, "
    + ", ".join(
        f"round({c}_ha / nullif(total_ha, 0) * 100, 6) AS {c}_percent"
        for c in ("unburned", "low", "moderate", "high")
    )
    + " FROM tab",
    **{
        name: _with(class_table()) + f"SELECT veg_type, round({name}, 6) AS {name} FROM matrix"
        for name in ("pct_of_park", "pct_of_burn", "mean_severity", "std_severity")
    },
    "veg_fire_matrix": _with(class_table(null_type=True))
    + f"SELECT color, veg_type, {_ROUNDED_MATRIX} FROM matrix",
    "veg_fire_matrix_value_sum": _with(class_table(null_type=True, measure="value_sum"))
    + f"SELECT color, veg_type, {_ROUNDED_MATRIX} FROM matrix",
    "veg_fire_matrix_jobs": _projected_jobs(),
    "veg_types": _with(zones(True))
    + "SELECT veg_type, count(*) AS polygons FROM zones GROUP BY veg_type",
    "zone_total_bounds": _with(zones())
    + "SELECT min(c0) AS minx, min(r0) AS miny, max(c0) + 6 AS maxx, max(r0) + 5 AS maxy FROM zones",
    "collection_extent": _with(ITEMS)
    + "SELECT fire_event_name, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, "
    "max(maxy) AS maxy, min(datetime) AS first_datetime, max(datetime) AS last_datetime, "
    "count(*) AS items FROM items GROUP BY fire_event_name",
    "product_validity": _with(
        GRID,
        "checks AS (SELECT tile_id AS job_id, count(*) AS pixels, "
        + ", ".join(f"count({n}) * 1.0 / count(*) > 0.95 AS {n}_valid" for n in _INDEX_NAMES)
        + " FROM grid GROUP BY tile_id)",
    )
    + "SELECT *, CASE WHEN "
    + " AND ".join(f"{n}_valid" for n in _INDEX_NAMES)
    + " THEN 'completed' ELSE 'failed_validation' END AS status FROM checks",
    "stack_shape": _with(OBS)
    + "SELECT "
    + ", ".join(
        f"count(DISTINCT CASE WHEN {w} THEN {c} END) AS {n}_{label}"
        for n, w in (("pre", _PRE), ("post", _POST))
        for c, label in (("ts", "times"), ("band", "bands"), ('"row"', "rows"), ("col", "cols"))
    )
    + " FROM obs",
    "zonal_mean_raw": _with(class_table())
    + "SELECT veg_type, round(sum(rbr), 6) AS severity_sum, round(avg(rbr), 6) AS severity_mean, "
    "round(coalesce(sum(rbr), 0) * 0.04, 6) AS original_ha, count(*) AS pixels "
    "FROM touched GROUP BY veg_type",
    "latest_item": _with(ITEMS) + f"SELECT {FLAT} FROM ({newest('id, boundary_type')})",
    "latest_severity_per_event": _with(ITEMS)
    + "SELECT fire_event_name, folder || 'rbr.tif' || version AS cog_url, datetime FROM ("
    + newest("fire_event_name", "product_type = 'fire_severity'")
    + ")",
    "category_encode": _with(
        zones(True),
        "ids AS (SELECT veg_type, CAST(dense_rank() OVER (ORDER BY veg_type) AS INTEGER) "
        "AS category_id FROM (SELECT DISTINCT veg_type FROM zones WHERE veg_type IS NOT NULL))",
    )
    + "SELECT zone_id, veg_type, category_id FROM zones LEFT JOIN ids USING (veg_type)",
    "append_union": _flat(),
    **{
        name: _with(GRID) + f'SELECT "row", col, {name} FROM grid'
        for name in ("dnbr", "rdnbr", "rbr")
    },
    "pixel_area": _with(zones(), ZONE_EDGES)
    + "SELECT zone_id, 120.0::DOUBLE * 100 / 10000 AS pixel_area_ha, "
    "round(abs(sum(x1 * y2 - x2 * y1)) / 2 * 400 / 10000, 6) AS zone_ha "
    "FROM edges GROUP BY zone_id",
    "rounding": """
WITH cents AS (SELECT l_orderkey, l_linenumber,
                      CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS BIGINT) AS v
               FROM lineitem)
SELECT l_orderkey, l_linenumber,
  (v // 10 + CASE WHEN v % 10 > 5 OR (v % 10 = 5 AND (v // 10) % 2 = 1) THEN 1 ELSE 0 END)
    / 10.0::DOUBLE AS to_tenths,
  (v // 100 + CASE WHEN v % 100 > 50 OR (v % 100 = 50 AND (v // 100) % 2 = 1) THEN 1 ELSE 0 END)
    ::DOUBLE AS to_units
FROM cents""",
    "veg_color": _with(zones(True))
    + "SELECT DISTINCT veg_type, concat('#', substr(md5(coalesce(veg_type, 'None')), 1, 6)) AS color "
    "FROM zones",
    "random_palette": _with(
        zones(), "h AS (SELECT DISTINCT veg_type, md5(veg_type) AS m FROM zones)"
    )
    + "SELECT veg_type, "
    + ", ".join(
        f"CAST('0x' || substr(m, {s}, 2) AS INTEGER) AS {n}"
        for n, s in (("red", 1), ("green", 3), ("blue", 5))
    )
    + " FROM h",
    "item_ids": _with(ITEMS)
    + "SELECT ingest_seq, concat(fire_event_name, '-severity-', job_id) AS severity_id, "
    "concat(fire_event_name, '-boundary-', job_id) AS boundary_id, "
    "concat(fire_event_name, '-veg-matrix-', job_id) AS veg_matrix_id FROM items",
    "asset_paths": _with(ITEMS)
    + f"""SELECT ingest_seq, fire_event_name || '/' || job_id || '/rbr.tif' AS cog_path,
  fire_event_name || '/' || job_id || '/coarse_boundary.geojson' AS boundary_path,
  fire_event_name || '/' || job_id || '/veg_fire_matrix.csv' AS matrix_path,
  '{_CAT}/' || fire_event_name || '/items/' || id || '.json' AS item_url,
  '{_CAT}/' || fire_event_name || '/items/' || fire_event_name || '-severity-' || job_id
    || '.json' AS related_url,
  '{_CAT}/' || fire_event_name || '/collection.json' AS collection_url,
  '{_CAT}/' || fire_event_name || '.parquet' AS parquet_url,
  '/stac/collections/' || fire_event_name AS collection_path FROM items""",
    "titles": _with(ITEMS)
    + """SELECT ingest_seq, CASE boundary_type WHEN 'coarse' THEN 'Coarse' WHEN 'refined' THEN 'Refined'
  END AS kind_title, fire_event_name || ' ' || boundary_type || ' boundary' AS boundary_title,
  'Vegetation Fire Matrix for ' || fire_event_name AS matrix_title FROM items""",
    "name_from_path": _with(ITEMS)
    + f"""SELECT ingest_seq, fire_event_name || CASE WHEN {_MATRIX} THEN '.csv' ELSE '.parquet' END
  AS file_name, CASE WHEN NOT ({_MATRIX}) THEN fire_event_name END AS event FROM items""",
    "interval_parse": _with(INTERVALS)
    + """SELECT o_orderkey, interval, start_ts, end_ts,
  CASE WHEN start_ts IS NOT NULL OR end_ts IS NOT NULL THEN
    coalesce(strftime(start_ts, '%Y-%m-%d'), '..') || '/'
      || coalesce(strftime(end_ts, '%Y-%m-%d'), '..') END AS search_text FROM bounds""",
    "utc_format": "SELECT event_id AS scene_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc_text "
    "FROM events",
    "geojson_validate": _with(DOCS)
    + "SELECT zone_id, reason IS NULL AS is_valid, reason, "
    "CASE WHEN reason IS NULL THEN json_array_length(shape->'$.coordinates[0]')::BIGINT END AS points "
    "FROM checked",
    "geojson_feature": _with(DOCS) + f"SELECT zone_id, {_FEATURE} AS feature FROM accepted",
    "geojson_collection": _with(DOCS)
    + """SELECT zone_id, '{"type":"FeatureCollection","features":[' || """
    + _FEATURE
    + """ || '],"zone":' || zone_id || '}' AS collection FROM accepted""",
    "polygon_bounds": _with(DOCS)
    + "SELECT zone_id, c0 AS minx, r0 AS miny, c0 + 6 AS maxx, r0 + 5 AS maxy FROM accepted",
    "bbox_polygon": _with(zones())
    + "SELECT zone_id, "
    + _box_ring("c0", "r0", "(c0 + 6)", "(r0 + 5)")
    + " AS polygon FROM zones",
    "asset_href": _with(ITEMS)
    + """SELECT ingest_seq,
  CASE WHEN product_type = 'fire_severity' THEN folder || 'rbr.tif' || version END AS rbr_href,
  CASE WHEN product_type = 'fire_boundary' THEN folder || 'refined_boundary.geojson' || version END
    AS refined_boundary_href,
  CASE WHEN product_type = 'fire_boundary' THEN folder || 'refined_rbr.tif' || version END
    AS refined_severity_href,
  CASE WHEN product_type = 'vegetation_fire_matrix' THEN folder || 'veg_fire_matrix.csv' || version
    END AS veg_fire_matrix_href FROM items""",
    "links_append": _with(ITEMS)
    + f"""SELECT ingest_seq, 2::BIGINT AS links, 'related' AS last_rel,
  '{_CAT}/' || fire_event_name || '/items/' || fire_event_name || '-severity-' || job_id || '.json'
    AS last_href, 'Related fire severity product' AS last_title FROM items""",
    "item_build": _with(ITEMS, _built())
    + f"SELECT {FLAT}, title, description, geometry, first_href, links::BIGINT AS links, "
    "assets::BIGINT AS assets, asset_title FROM built",
    "item_validate": """
SELECT o_orderkey AS ingest_seq, o_orderkey % 8 NOT IN (1, 2, 3, 4, 5, 6) AS is_valid,
  CASE o_orderkey % 8 WHEN 1 THEN 'id missing' WHEN 2 THEN 'geometry malformed'
    WHEN 3 THEN 'bbox inverted' WHEN 4 THEN 'asset without href'
    WHEN 5 THEN 'link without rel or href' WHEN 6 THEN 'datetime missing' END AS reason
FROM orders""",
    "feature_collection_response": _with(ITEMS) + _feature_lines(),
    "items_append_stream": _with(ITEMS)
    + "SELECT id, boundary_type, datetime, ingest_seq FROM items UNION ALL "
    "SELECT id, boundary_type, datetime, ingest_seq + 1000000000 FROM items WHERE ingest_seq % 10 = 0",
}
