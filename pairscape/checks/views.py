"""Inputs of the right shape, derived from the given tables.

The given tables hold no rasters, months or patches. These views turn them into
monthly tables, images, pairs, patches and predictions; each grows with the
tables it reads. The text runs unchanged in Spark SQL and in the comparison
database; the few that need list functions have one text per side.
"""

from __future__ import annotations

import re

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "Sept", "October", "Nov", "December",
)
_MONTH_TEXT = "CASE month " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(MONTH_NAMES, 1)
) + " END"
_SEASON = (
    "CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} <= 5 THEN 'PreMonsoon' "
    "WHEN {m} <= 9 THEN 'Monsoon' ELSE 'PostMonsoon' END"
)
_ORDER = "CASE {s} WHEN 'Winter' THEN 0 WHEN 'PreMonsoon' THEN 1 WHEN 'Monsoon' THEN 2 ELSE 3 END"
_CLASS = (
    "CASE WHEN {r} >= 0e0 AND {r} < 5e-2 THEN 'low' WHEN {r} >= 5e-2 AND {r} < 2e-1 THEN 'medium' "
    "WHEN {r} >= 2e-1 AND {r} <= 1e0 THEN 'high' ELSE 'invalid' END"
)
_GAP = (
    "CASE WHEN {g} = 0 THEN 'same_year' WHEN {g} = 1 THEN 'short' WHEN {g} <= 3 THEN 'medium' "
    "WHEN {g} <= 6 THEN 'long' WHEN {g} <= 9 THEN 'very_long' ELSE 'other' END"
)

VIEWS = {
    "ord": """
        SELECT o_orderkey, o_totalprice, o_orderpriority,
               CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
               n_nationkey AS nk, CAST(floor(c_custkey / 100) AS INT) AS block,
               concat('Nation_', CAST(n_nationkey AS STRING), '_B',
                      CAST(CAST(floor(c_custkey / 100) AS INT) AS STRING)) AS district
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "monthly": """
        SELECT district, nk, block, year, month,
               CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(o_totalprice) / 6997e0 END AS price_mean,
               CAST(count(*) AS BIGINT) AS order_count,
               CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent_event_count,
               CAST(nk AS DOUBLE) AS elevation
        FROM ord GROUP BY district, nk, block, year, month""",
    "monthly_text": f"""
        SELECT CASE WHEN month % 3 = 0 THEN lower(replace(district, '_', ' ')) ELSE concat(' ', district) END AS district_text,
               year,
               CASE WHEN year % 2 = 0 THEN concat(CAST(month AS STRING), '.0') ELSE {_MONTH_TEXT} END AS month_text,
               price_mean, order_count, urgent_event_count, elevation
        FROM monthly""",
    "seasonal_all": f"""
        SELECT district, nk, block, sy AS year, season, sy * 4 + {_ORDER.format(s='season')} AS ti,
               avg(price_mean) AS price_mean, avg(elevation) AS elevation,
               CAST(sum(order_count) AS BIGINT) AS order_count,
               CAST(sum(urgent_event_count) AS BIGINT) AS urgent_event_count
        FROM (SELECT *, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS sy,
                     {_SEASON.format(m='month')} AS season FROM monthly) m
        GROUP BY district, nk, block, sy, season""",
    "seasonal": """
        SELECT district, year, season, ti, price_mean, elevation, order_count, urgent_event_count
        FROM seasonal_all
        WHERE (ti * 7 + nk) % 17 <> 0 AND NOT (nk % 5 = 0 AND block % 10 = 3)""",
    "images": f"""
        SELECT district, nk, block, year, season, so, year * 4 + so AS ti,
               concat(district, '_', CAST(year AS STRING), '_', season) AS image_id,
               CASE WHEN (nk + block) % 20 < 14 THEN 'train' WHEN (nk + block) % 20 < 17 THEN 'val' ELSE 'test' END AS split,
               concat('/s2/', district, '_', CAST(year AS STRING), '_', season, '.tif') AS sentinel_path,
               concat('/dw/', district, '_', CAST(year AS STRING), '_', season, '.tif') AS dw_path
        FROM (SELECT DISTINCT district, nk, block, sy AS year, season, {_ORDER.format(s='season')} AS so
              FROM (SELECT *, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS sy,
                           {_SEASON.format(m='month')} AS season FROM ord) d) e""",
    "pairs": f"""
        SELECT concat(a.image_id, '_to_', CAST(b.year AS STRING), '_', b.season) AS pair_id,
               a.district, a.nk, a.split, a.image_id AS image_id_t1, b.image_id AS image_id_t2,
               a.year AS year_t1, a.season AS season_t1, b.year AS year_t2, b.season AS season_t2,
               a.so AS season_order_t1, b.so AS season_order_t2, a.ti AS time_index_t1, b.ti AS time_index_t2,
               b.year - a.year AS time_gap_years, b.so - a.so AS season_gap,
               a.season = b.season AS same_season, a.season <> b.season AS cross_season,
               CASE WHEN a.season = b.season THEN 'same_season_multiyear'
                    WHEN a.year = b.year THEN 'cross_season_sameyear' ELSE 'cross_season_multiyear' END AS pair_type,
               {_GAP.format(g='(b.year - a.year)')} AS time_gap_group,
               a.sentinel_path AS sentinel_path_t1, b.sentinel_path AS sentinel_path_t2,
               a.dw_path AS dw_path_t1, b.dw_path AS dw_path_t2
        FROM images a JOIN images b ON a.split = b.split AND a.district = b.district AND b.ti > a.ti""",
    "sizes": """
        SELECT sentinel_path AS path, 256 + 64 * (nk % 3) + CASE WHEN ti % 17 = 0 THEN 64 ELSE 0 END AS width,
               192 + 64 * (nk % 2) AS height
        FROM images WHERE ti % 23 <> 0""",
    "sensor_base": """
        SELECT image_id, district, year, season, nk, ti,
               CASE WHEN nk % 6 = 0 THEN NULL ELSE concat('EPSG:', CAST(32645 + nk % 2 AS STRING)) END AS crs,
               256 + 64 * (nk % 3) AS width, 192 + 64 * (nk % 2) AS height,
               30e0 + nk AS res, 1e3 * nk AS edge
        FROM images""",
    "sensor_a": """
        SELECT image_id, district, year, season, concat('/s2/', image_id, '.tif') AS full_path,
               concat('S2_', image_id, '.tif') AS filename, seq,
               CASE WHEN ti % 31 = 0 THEN 'failed' ELSE 'success' END AS parse_status,
               ti % 19 <> 0 AS readable, crs, width + seq - 1 AS width, height,
               CASE WHEN nk % 4 = 3 THEN 12 ELSE 13 END AS band_count,
               res AS resolution_x, res AS resolution_y,
               edge AS bounds_left, edge AS bounds_bottom, edge + 1e2 AS bounds_right, edge + 1e2 AS bounds_top
        FROM (SELECT *, 1 AS seq FROM sensor_base WHERE (ti * 7 + nk) % 11 <> 0
              UNION ALL SELECT *, 2 AS seq FROM sensor_base WHERE (ti * 7 + nk) % 11 <> 0 AND ti % 9 = 0) s""",
    "sensor_b": """
        SELECT CASE WHEN ti % 29 = 0 THEN NULL ELSE image_id END AS image_id, district, year, season,
               concat('/dw/', image_id, '.tif') AS full_path, concat('DW_', image_id, '.tif') AS filename, 1 AS seq,
               CASE WHEN ti % 37 = 0 THEN 'failed' ELSE 'success' END AS parse_status,
               ti % 23 <> 0 AS readable, crs, width, height + CASE WHEN ti % 5 = 0 THEN 1 ELSE 0 END AS height,
               11 AS band_count, res AS resolution_x,
               CASE WHEN ti % 27 = 0 THEN NULL ELSE res + 1e-7 END AS resolution_y,
               edge AS bounds_left, edge AS bounds_bottom, edge + 1e2 AS bounds_right,
               edge + 1e2 + CASE WHEN ti % 7 = 0 THEN 1e-3 ELSE 0e0 END AS bounds_top
        FROM sensor_base WHERE (ti * 7 + nk) % 13 <> 0""",
    "raster_names": """
        SELECT concat(CASE ti % 6 WHEN 0 THEN 'S2' WHEN 1 THEN 'sentinel2' WHEN 2 THEN 'DW_allclasses' WHEN 3 THEN 'DW'
                                   WHEN 4 THEN 'Landsat' ELSE 'DynamicWorld' END,
                      '_30m_', CASE WHEN nk % 11 = 10 THEN 'y16' ELSE CAST(year + 20 AS STRING) END, '_',
                      CASE WHEN ti % 5 = 0 THEN 'Summer' WHEN ti % 5 = 1 THEN lower(season)
                           WHEN ti % 5 = 2 AND season = 'PreMonsoon' THEN 'Pre_Monsoon' ELSE season END,
                      CASE WHEN block % 7 = 6 THEN '_' ELSE concat('_', CASE WHEN nk % 3 = 0 THEN lower(replace(district, '_', ' ')) ELSE district END) END,
                      CASE WHEN nk % 8 = 7 THEN '.jpg' WHEN nk % 8 = 6 THEN '.TIFF' ELSE '.tif' END) AS file_name, image_id
        FROM images""",
    "li": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
               n_name AS district, n_nationkey AS nk, concat('P', CAST(l_suppkey AS STRING)) AS pair_id,
               CAST((l_partkey % 40) * 64 AS INT) AS x, CAST((l_orderkey % 50) * 64 AS INT) AS y,
               CASE WHEN l_suppkey % 10 < 7 THEN 'train' WHEN l_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split,
               CASE l_returnflag WHEN 'A' THEN 'same_season_multiyear' WHEN 'N' THEN 'cross_season_sameyear'
                                 ELSE 'cross_season_multiyear' END AS pair_type,
               CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_linenumber = 1 THEN 'same_year' WHEN l_linenumber IN (2, 6) THEN 'short'
                    WHEN l_linenumber = 3 THEN 'medium' WHEN l_linenumber = 4 THEN 'long' WHEN l_linenumber = 5 THEN 'very_long'
                    ELSE 'other' END AS time_gap_group,
               concat('P', CAST(l_suppkey AS STRING), '_x', CAST((l_partkey % 40) * 64 AS STRING), '_y',
                      CAST((l_orderkey % 50) * 64 AS STRING), '_o', CAST(l_orderkey AS STRING), 'l', CAST(l_linenumber AS STRING),
                      'k', CAST(l_partkey AS STRING), 'q', CAST(CAST(l_quantity AS INT) AS STRING)) AS patch_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "labeled": """
        SELECT patch_id, pair_id, district, split, pair_type, coalesce(time_gap_group, 'other') AS time_gap_group, x, y,
               64 AS patch_size, concat('/dw/', pair_id, '_1.tif') AS dw_path_t1, concat('/dw/', pair_id, '_2.tif') AS dw_path_t2,
               CASE WHEN mark % 37 = 0 THEN 'failed' WHEN mark % 23 = 0 THEN 'invalid_low_valid_ratio' ELSE 'success' END AS label_status,
               CASE WHEN mark % 37 <> 0 THEN CAST(percent AS DOUBLE) / 1e2 END AS change_ratio,
               CASE WHEN mark % 37 = 0 THEN 'invalid' WHEN percent < 5 THEN 'low' WHEN percent < 20 THEN 'medium' ELSE 'high' END AS change_class
        FROM (SELECT *, l_orderkey + l_linenumber AS mark, (l_partkey + 3 * l_orderkey + l_linenumber) % 100 AS percent FROM li) a""",
    "valid_labeled": """
        SELECT * FROM labeled WHERE label_status = 'success' AND change_ratio IS NOT NULL
               AND change_class IN ('low', 'medium', 'high')""",
    "predictions": f"""
        SELECT patch_id, pair_id, district, split, pair_type, time_gap_group, x, y, experiment, y_true, y_pred,
               abs(y_pred - y_true) AS abs_error, (y_pred - y_true) * (y_pred - y_true) AS squared_error,
               {_CLASS.format(r='y_true')} AS change_class,
               CASE WHEN y_true < 5e-2 THEN 0 WHEN y_true < 2e-1 THEN 1 ELSE 2 END AS true_id, z0, z1, z2,
               CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS pred_id
        FROM (SELECT *, CAST(l_discount AS DOUBLE) * 1e1 AS y_true, CAST(l_tax AS DOUBLE) * 125e-1 AS y_pred,
                     round(CAST(l_quantity AS DOUBLE) / 5e1, 4) AS z0, round(CAST(l_tax AS DOUBLE) * 1e1, 4) AS z1,
                     round(CAST(l_discount AS DOUBLE) * 1e1, 4) AS z2,
                     CASE l_linestatus WHEN 'F' THEN 'cnn_regression' ELSE 'swin_regression' END AS experiment
              FROM li) p""",
    "npz_index": """
        SELECT patch_id, concat('/npz/', split, '/', patch_id, '.npz') AS npz_path, split, change_class, change_ratio,
               pair_id, district FROM labeled""",
    "emb_pix": {
        "spark": "SELECT vec_id, label, pos, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v",
        "duck": "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    },
    "pix": """
        SELECT e.vec_id, e.label, e.pos, CAST(floor(e.pos / 8) AS INT) AS row, e.pos % 8 AS col,
               CASE WHEN e.pos = e.vec_id % 29 THEN NULL ELSE floor((e.v + 5e-1) * 8e0) END AS c1,
               CASE WHEN e.pos < e.vec_id % 64 THEN floor((e.v + 5e-1) * 8e0) ELSE floor((n.v + 5e-1) * 8e0) END AS c2,
               CASE WHEN e.vec_id % 4 = 0 THEN 4e0 ELSE 0e0 END AS nodata
        FROM emb_pix e JOIN emb_pix n ON e.pos = n.pos
             AND n.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "importances": """
        SELECT concat('P', CAST(vec_id AS STRING)) AS patch_id, label, pos + 1 AS band_index,
               concat('band_', CAST(pos + 1 AS STRING)) AS band_name, abs(v) AS importance FROM emb_pix""",
    "path_rows": """
        SELECT page_id, concat('p', CAST(page_id AS STRING)) AS patch_id,
               CASE page_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' ELSE 'other' END AS split,
               CASE page_id % 19 WHEN 3 THEN NULL WHEN 5 THEN '  ' WHEN 7 THEN 'nan' WHEN 11 THEN ' NULL '
                    ELSE concat('/data/', CASE page_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' ELSE 'other' END,
                                '/p', CAST(page_id AS STRING), '.npz') END AS npz_path, url
        FROM pages""",
    "classed_rows": """
        SELECT *, CASE page_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS change_class FROM path_rows
        UNION ALL SELECT *, 'low' AS change_class FROM path_rows WHERE page_id % 17 IN (0, 4)
        UNION ALL SELECT *, 'high' AS change_class FROM path_rows WHERE page_id % 17 = 4""",
    "disk_files": """
        SELECT concat('/data/', CASE page_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' ELSE 'other' END,
                      '/p', CAST(page_id AS STRING), '.npz') AS path, CAST(page_id * 10 AS BIGINT) AS size
        FROM pages WHERE page_id % 10 <> 0
        UNION ALL SELECT concat('/data/extra/q', CAST(page_id AS STRING), '.npz') AS path, CAST(page_id AS BIGINT) AS size
        FROM pages WHERE page_id % 13 = 0""",
}

_WORD = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def view_text(name: str, side: str) -> str:
    text = VIEWS[name]
    return text[side] if isinstance(text, dict) else text


def needed(sql: str, side: str) -> list[str]:
    """Views a statement reads, each after the ones it is built on."""
    order: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _WORD.findall(text):
            if name != own and name not in order:
                visit(view_text(name, side), name)
                if name not in order:
                    order.append(name)

    visit(sql, None)
    return order


def with_views(sql: str, side: str, extra: list[str] = ()) -> str:
    # the database would work out a view again for each use
    kept = "MATERIALIZED " if side == "duck" else ""
    parts = [f"{n} AS {kept}({view_text(n, side)})" for n in needed(sql, side)]
    parts = list(extra) + parts
    body = sql.strip()
    if not parts:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join(parts) + ",\n" + body[len(start):]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """The given tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str):
        whole = with_views(text, "spark")
        used = [t for t in BASE if re.search(rf"\b{t}\b", whole)]
        reads = [f"{t} AS (SELECT * FROM parquet.`{self.folder}/{t}.parquet`)" for t in used]
        return self.spark.sql(with_views(text, "spark", reads))

    def view(self, name: str):
        return self.sql(f"SELECT * FROM {name}")
