"""Independent SQL for every registered query, written for DuckDB.

Views are listed once with the views they read; ``sql`` assembles the WITH
clause a statement needs. The rules are stated in their direct form (self-joins,
EXISTS, ROW_NUMBER over everything, all edges against all points), not in the
form the Spark operators use.
"""

from __future__ import annotations

import re

from tivlens.model import DIMENSION_ORDER, DIMENSIONS, RULES
from tivlens.registry import corruption_sql
from tivlens.registry.workspace import AS_OF_YEAR
from tivlens.sources import derived


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,4))"


def fixed(x: str, scale: int) -> str:
    return f"CAST(CAST({x} AS DECIMAL(28,{scale})) AS VARCHAR)"


def total(x: str) -> str:
    return f"CAST(sum({money(x)}) AS DOUBLE)"


def cents(x: str) -> str:
    return f"round({total(x)}, 2)"


def _values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


POINT = f"concat('latitude=', {fixed('latitude', 8)}, ', longitude=', {fixed('longitude', 8)})"
LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL"
IN_RANGE = f"{LOCATED} AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"


def _flag(rule: str, value: str, where: str, source: str = "raw p") -> str:
    return f"SELECT p.row_id, '{rule}' AS rule_id, {value} AS flagged_value FROM {source} WHERE {where}"


def _inside(edges: str, x: str, y: str) -> str:
    """The point is strictly inside one of the polygons of an edge table."""
    on = (f"({x}-x1)*(y2-y1) = ({y}-y1)*(x2-x1) AND {x} BETWEEN least(x1,x2) AND greatest(x1,x2) "
          f"AND {y} BETWEEN least(y1,y2) AND greatest(y1,y2)")
    cross = f"(y1 > {y}) <> (y2 > {y}) AND {x} < x1 + ({y}-y1)*(x2-x1)/nullif(y2-y1, 0)"
    return (f"EXISTS (SELECT poly_id FROM {edges} GROUP BY poly_id "
            f"HAVING count(*) FILTER (WHERE {cross}) % 2 = 1 AND count(*) FILTER (WHERE {on}) = 0)")


_same = " AND ".join(
    ["p.location_id = q.location_id", "p.account_id = q.account_id"]
    + [f"coalesce(p.{c}, '') = coalesce(q.{c}, '')" for c in (
        "address_line", "city", "district", "state", "postcode", "occupancy_code",
        "construction_code", "currency")]
    + [f"coalesce(p.{c}, -999) = coalesce(q.{c}, -999)" for c in (
        "latitude", "longitude", "year_built", "num_storeys", "floor_area_sqm", "tiv_building",
        "tiv_contents", "tiv_bi", "tiv_total", "deductible", "policy_limit")])

_con, _occ = "lower(trim(p.construction_code))", "lower(trim(p.occupancy_code))"
_b, _t = fixed("p.tiv_building", 4), fixed("p.tiv_total", 4)

RULE_SQL = {
    "C-001": _flag("C-001", POINT, "latitude IS NULL OR longitude IS NULL"),
    "C-002": _flag("C-002", "'construction_code=NULL'",
                   "construction_code IS NULL OR trim(construction_code) = ''"),
    "C-003": _flag("C-003", "'year_built=NULL'", "year_built IS NULL"),
    "C-004": _flag("C-004", "'num_storeys=NULL'", "num_storeys IS NULL"),
    "C-005": _flag("C-005", "'tiv_contents=NULL'", "tiv_contents IS NULL"),
    "C-006": _flag("C-006", "'deductible=NULL'", "deductible IS NULL"),
    "C-007": _flag("C-007", "'occupancy_code=NULL'",
                   "occupancy_code IS NULL OR trim(occupancy_code) = ''"),
    "V-001": _flag("V-001", _t, "tiv_total < 0"),
    "V-002": _flag("V-002", _b, "tiv_building = 0"),
    "V-003": _flag("V-003", POINT, "latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180"),
    "V-004": _flag("V-004", "CAST(year_built AS VARCHAR)", f"year_built > {AS_OF_YEAR}"),
    "V-005": _flag("V-005", "CAST(year_built AS VARCHAR)", "year_built < 1850"),
    "V-006": _flag("V-006", "CAST(num_storeys AS VARCHAR)", "num_storeys <= 0"),
    "V-007": _flag("V-007", f"concat('deductible=', {fixed('deductible', 4)}, ', tiv_total=', {_t})",
                   "deductible > tiv_total"),
    "X-001": _flag("X-001", "concat('construction=', construction_code, ', storeys=', num_storeys)",
                   f"{_con} = 'timber' AND num_storeys > 4"),
    "X-002": _flag("X-002", "concat('construction=', construction_code, ', year=', year_built)",
                   f"{_con} = 'rcc' AND year_built < 1900"),
    "X-003": _flag("X-003", f"concat('occupancy=', occupancy_code, ', tiv_building=', {_b})",
                   f"{_occ} IN ('res', 'residential') AND tiv_building >= 800000000"),
    "X-004": _flag("X-004", "concat('occupancy=', occupancy_code, ', storeys=', num_storeys)",
                   f"{_occ} = 'ind' AND num_storeys > 20"),
    "X-005": _flag("X-005", f"concat('floor_area=', {fixed('floor_area_sqm', 6)}, ', tiv_building=', {_b}, "
                   f"', tiv_per_sqm=', {fixed('tiv_building/nullif(floor_area_sqm, 0)', 2)}, "
                   f"', threshold_per_sqm=', {fixed('r.threshold', 2)})",
                   "floor_area_sqm > 0 AND tiv_building/nullif(floor_area_sqm, 0) > r.threshold",
                   "raw p CROSS JOIN density r"),
    "X-006": _flag("X-006", "concat('postcode=', p.postcode, ', district=', p.district, "
                   "', reference_district=', r.district)", "p.district <> r.district",
                   "raw p JOIN postcodes r ON trim(p.postcode) = trim(r.postcode)"),
    "X-007": _flag("X-007", "concat('city=', city, ', district=', district)", " OR ".join(
        f"(lower(trim(district)) = '{d}' AND lower(trim(city)) <> '{c}')"
        for d, c in derived.DISTRICT_CITIES.items())),
    "D-001": _flag("D-001", "'Exact duplicate of another portfolio record'",
                   f"EXISTS (SELECT 1 FROM raw q WHERE p.row_id > q.row_id AND {_same})"),
    "D-002": _flag("D-002", "concat('location_id=', p.location_id, ', shared coordinates with another location')",
                   "EXISTS (SELECT 1 FROM raw q WHERE p.row_id <> q.row_id AND p.location_id <> q.location_id "
                   "AND p.latitude = q.latitude AND p.longitude = q.longitude)"),
    "D-003": _flag("D-003", "concat('address=', address_line, ', near-duplicate address candidate')",
                   "lower(trim(address_line)) LIKE '% ltd.'"),
    "D-004": _flag("D-004", f"concat('location_id=', p.location_id, ', tiv_building=', {_b}, ', conflicting TIV')",
                   "EXISTS (SELECT 1 FROM raw q WHERE q.location_id = p.location_id AND q.row_id <> p.row_id "
                   "AND q.tiv_building IS DISTINCT FROM p.tiv_building)"),
    "P-001": _flag("P-001", f"concat('tiv_building=', {_b}, ', clean_baseline_median=', {fixed('r.median', 4)}, "
                   f"', multiplier=', r.multiplier, ', threshold_tiv_building=', {fixed('r.threshold', 4)})",
                   "p.tiv_building > r.threshold", "raw p CROSS JOIN building r"),
    "P-002": _flag("P-002", f"concat('tiv_total=', {_t}, ', rounded_value=', {fixed('p.tiv_total', 0)}, "
                   "', occurrences=', x.n)",
                   "p.tiv_total > 0 AND abs(p.tiv_total - round(p.tiv_total/1000000.0)*1000000.0) < 1.0",
                   f"raw p JOIN (SELECT round({money('tiv_total')}, 0) AS v, count(*) AS n FROM raw "
                   f"WHERE tiv_total IS NOT NULL GROUP BY 1 HAVING count(*) >= 10) x ON round({money('p.tiv_total')}, 0) = x.v"),
    "P-003": _flag("P-003", f"concat('tiv_building=', {_b}, ', portfolio_share=', {fixed('p.tiv_total/t.s*100', 2)}, '%')",
                   "p.tiv_total > 0 AND p.tiv_total/t.s >= 0.10",
                   f"raw p CROSS JOIN (SELECT {total('tiv_total')} AS s FROM raw WHERE tiv_total > 0) t"),
    "P-004": _flag("P-004", "concat('year_built=', p.year_built, ', occurrences=', x.n)", "p.year_built = 1900",
                   "raw p JOIN (SELECT year_built, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) >= 100) x "
                   "ON p.year_built = x.year_built"),
    "P-005": _flag("P-005", "concat('occupancy=', occupancy_code, ', storeys=', num_storeys, "
                   f"', industrial_one_storey_share=', {fixed('x.one/x.n*100', 2)}, '%')",
                   f"{_occ} = 'ind' AND num_storeys = 1 AND x.one/x.n >= 0.5",
                   f"raw p CROSS JOIN (SELECT CAST(count(*) FILTER (WHERE {_occ} = 'ind' AND num_storeys = 1) AS DOUBLE) AS one, "
                   f"CAST(count(*) FILTER (WHERE {_occ} = 'ind') AS DOUBLE) AS n FROM raw p) x"),
    "G-001": _flag("G-001", POINT, f"{LOCATED} AND NOT {_inside('land', 'p.longitude', 'p.latitude')}"),
    "G-002": _flag("G-002", POINT, "abs(latitude) <= 90 AND abs(longitude) <= 90 AND latitude <> longitude "
                   f"AND {_inside('land', 'p.latitude', 'p.longitude')}"),
    "G-003": _flag("G-003", POINT, "latitude = 0 AND longitude = 0"),
    "G-004": _flag("G-004", POINT, f"{IN_RANGE} AND NOT {_inside('country', 'p.longitude', 'p.latitude')}"),
    "G-005": _flag("G-005", f"concat({POINT.replace('latitude AS', 'p.latitude AS').replace('longitude AS', 'p.longitude AS')}, "
                   "', geocode_level=', p.geocode_level, ', coordinate_cluster_count=', x.n)",
                   "lower(trim(p.geocode_level)) = 'postcode'",
                   "raw p JOIN (SELECT latitude, longitude, count(*) AS n FROM raw WHERE lower(trim(geocode_level)) = 'postcode' "
                   "GROUP BY 1, 2 HAVING count(*) >= 10) x ON p.latitude = x.latitude AND p.longitude = x.longitude"),
    "K-001": _flag("K-001", "concat('construction_code=', construction_code)",
                   f"{_con} NOT IN ('rcc', 'masonry', 'steel', 'timber') AND trim(construction_code) <> ''"),
    "K-002": _flag("K-002", "concat('occupancy_code=', occupancy_code)",
                   f"{_occ} NOT IN ('res', 'com', 'ind', 'pub') AND trim(occupancy_code) <> ''"),
    "K-003": _flag("K-003", "concat('construction_code=', construction_code)",
                   "trim(construction_code) IN ('01', '02', '03', '04')"),
    "K-004": _flag("K-004", "concat('currency=', currency)", "trim(currency) <> 'INR'"),
}


def _calibration(value: str, where: str, source: str = "clean") -> str:
    return (f"SELECT 'clean_baseline' AS reference_name, median, multiplier, multiplier*median AS threshold, clean_max "
            f"FROM (SELECT median, clean_max, CAST(floor(clean_max/median) AS BIGINT) + 1 AS multiplier FROM ("
            f"SELECT avg(v) FILTER (WHERE rn IN ((n+1)//2, (n+2)//2)) AS median, max(v) AS clean_max FROM ("
            f"SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM ("
            f"SELECT {value} AS v FROM {source} WHERE {where}))))")


_grid = [(i / 4, j / 4, 1e9 * ((i + j) % 7)) for i in range(339, 350) for j in range(75, 90)]


def _nearest(source: str, key: str, lon: str, lat: str, radius: float | None = None,
             more: str = "") -> str:
    """The nearest grid point per row of ``source`` by comparing all pairs."""
    d2 = f"({lon}-grid_lon)*({lon}-grid_lon)+({lat}-grid_lat)*({lat}-grid_lat)"
    near = "" if radius is None else f" AND sqrt(d2) <= {radius}"
    return (f"SELECT {key}{more}, grid_lon, grid_lat FROM (SELECT s.*, g.grid_lon, g.grid_lat, {d2} AS d2, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY {d2}, g.grid_lon, g.grid_lat) AS rn "
            f"FROM {source} s CROSS JOIN grid g WHERE {lon} IS NOT NULL AND {lat} IS NOT NULL) "
            f"WHERE rn = 1{near}")


_usable = "NOT quarantined"
_not_critical = "NOT EXISTS (SELECT 1 FROM critical x WHERE x.row_id = p.row_id)"
_IN_CLEAN = ("latitude_clean IS NOT NULL AND longitude_clean IS NOT NULL AND latitude_clean BETWEEN -90 AND 90 "
             "AND longitude_clean BETWEEN -180 AND 180")
_axis = "(affects_hazard OR affects_vulnerability OR affects_financial)"


def _concentration(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""

    def top(n: int) -> str:
        return (f"round(CAST(sum({money('total_tiv')}) FILTER (WHERE rn <= {n}) AS DOUBLE)/max(portfolio_tiv), 10) "
                f"AS top{n}_share")

    return (f"SELECT {lead}round(max(portfolio_tiv), 2) AS portfolio_tiv, {top(1)}, {top(3)}, {top(5)}, "
            f"round(sum(power(total_tiv/portfolio_tiv, 2)), 10) AS hhi, count(*) AS occupied_cells FROM ("
            f"SELECT *, row_number() OVER ({part} ORDER BY total_tiv DESC NULLS FIRST, grid_lon, grid_lat) AS rn, "
            f"CAST(sum({money('total_tiv')}) OVER ({part}) AS DOUBLE) AS portfolio_tiv FROM {source}){group}")


def _scenario(name: str, condition: str) -> str:
    return (f"SELECT '{name}' AS scenario, p.row_id, tiv_total_clean, latitude_clean, longitude_clean "
            f"FROM cleansed p WHERE {_usable} AND ({condition})")


def _critical_with(column: str) -> str:
    return f"{_not_critical} OR EXISTS (SELECT 1 FROM critical x WHERE x.row_id = p.row_id AND x.{column})"


VIEWS = {
    "marked": derived.PORTFOLIO_SQL.strip(),
    "raw": "SELECT * EXCLUDE (m) FROM marked",
    "clean": "SELECT * EXCLUDE (m) FROM marked WHERE m BETWEEN 910 AND 999",
    "catalogue": "SELECT * FROM (VALUES " + _values([
        (r.rule_id, r.dimension, r.severity, r.classification, r.injection_rule, r.tested_by_injection,
         r.affects_hazard, r.affects_vulnerability, r.affects_financial, r.error_type, r.action,
         r.method, r.seq) for r in RULES])
    + ") t(rule_id, dimension, severity, classification, injection_rule, tested_by_injection, "
      "affects_hazard, affects_vulnerability, affects_financial, error_type, action, method, seq)",
    "dimensions": "SELECT * FROM (VALUES " + _values(
        [(k, v, DIMENSION_ORDER.index(v)) for k, v in DIMENSIONS.items()]) + ") t(letter, dimension, n)",
    "truth": f"SELECT row_id, error_type, rule_id, d.dimension FROM (SELECT row_id, {derived.ERROR_CASE} AS error_type "
             "FROM marked) e JOIN (SELECT error_type, rule_id FROM catalogue) c USING (error_type) "
             "JOIN dimensions d ON d.letter = substr(error_type, 1, 1)",
    "postcodes": "SELECT CAST(700000 + i*1000 + j AS VARCHAR) AS postcode, substr('ABCD', CAST(i + 1 AS INTEGER), 1) AS district "
                 "FROM range(4) a(i) CROSS JOIN range(10) b(j)",
    "land": "SELECT * FROM (VALUES " + _values(
        [e for d, x, y in derived.LAND for e in derived._ring(d, x, y, x + 1, y + 1)])
    + ") t(poly_id, x1, y1, x2, y2)",
    "country": "SELECT * FROM (VALUES " + _values(derived._ring("S", *derived.COUNTRY))
    + ") t(poly_id, x1, y1, x2, y2)",
    "density": _calibration("tiv_building/floor_area_sqm", "floor_area_sqm > 0 AND tiv_building IS NOT NULL"),
    "building": _calibration("tiv_building", "tiv_building > 0"),
    "validated": "SELECT k + 1 AS row_id, tb + tc + ti AS validated_tiv, 'authoritative_clean_portfolio' AS validation_basis "
                 "FROM (" + derived.PORTFOLIO_SQL[:derived.PORTFOLIO_SQL.index("p AS (")].strip().rstrip(",")
                 + " SELECT k, tb, tc, ti FROM b2)",
    "flags": " UNION ALL ".join(RULE_SQL.values()),
    "rule_counts": "SELECT c.rule_id, c.error_type, "
                   "count(*) FILTER (WHERE t AND d) AS TP, count(*) FILTER (WHERE d AND NOT t) AS FP, "
                   "count(*) FILTER (WHERE t AND NOT d) AS FN FROM catalogue c LEFT JOIN ("
                   "SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, a.row_id IS NOT NULL AS t, b.row_id IS NOT NULL AS d "
                   "FROM (SELECT DISTINCT row_id, rule_id FROM truth) a FULL JOIN "
                   "(SELECT DISTINCT row_id, rule_id FROM flags) b ON a.row_id = b.row_id AND a.rule_id = b.rule_id) x "
                   "ON x.rule_id = c.rule_id GROUP BY 1, 2",
    "mtiv": "SELECT p.row_id, coalesce(r.validated_tiv, p.tiv_total) AS materiality_tiv FROM raw p "
            "LEFT JOIN validated r ON r.row_id = p.row_id",
    "percentile": "SELECT row_id, materiality_tiv, CASE WHEN materiality_tiv IS NOT NULL THEN "
                  "round(percent_rank() OVER (ORDER BY materiality_tiv NULLS LAST)*100, 2) END AS tiv_percentile FROM mtiv",
    "cells": "SELECT row_id, CAST(floor(longitude/0.25) AS BIGINT) AS cell_x, CAST(floor(latitude/0.25) AS BIGINT) AS cell_y "
             f"FROM raw WHERE {IN_RANGE}",
    "findings": "SELECT DISTINCT q.row_id, q.rule_id, t.materiality_tiv, t.tiv_percentile, pc.cell_x, pc.cell_y, rc.severity, "
                "rc.classification, rc.affects_hazard, rc.affects_vulnerability, rc.affects_financial FROM flags q "
                "JOIN raw p ON p.row_id = q.row_id JOIN catalogue rc ON rc.rule_id = q.rule_id "
                "LEFT JOIN percentile t ON t.row_id = q.row_id LEFT JOIN cells pc ON pc.row_id = q.row_id",
    "conc": "SELECT a.rule_id, a.cell_x, a.cell_y, flagged_count, total_flags, portfolio_count, "
            "(CAST(flagged_count AS DOUBLE)/CAST(total_flags AS DOUBLE))/(CAST(portfolio_count AS DOUBLE)/CAST(located AS DOUBLE)) AS enrichment_ratio, "
            "flagged_count >= 5 AND CAST(flagged_count AS HUGEINT)*located >= CAST(2 AS HUGEINT)*total_flags*portfolio_count AS is_concentrated "
            "FROM (SELECT rule_id, cell_x, cell_y, count(*) AS flagged_count FROM findings WHERE cell_x IS NOT NULL GROUP BY 1, 2, 3) a "
            "JOIN (SELECT rule_id, count(*) AS total_flags FROM findings GROUP BY 1) b USING (rule_id) "
            "JOIN (SELECT cell_x, cell_y, count(*) AS portfolio_count FROM cells GROUP BY 1, 2) c USING (cell_x, cell_y) "
            "CROSS JOIN (SELECT count(*) AS located FROM cells) d",
    "scores": "SELECT f.row_id, f.rule_id, affects_hazard, affects_vulnerability, affects_financial, tiv_percentile, "
              "coalesce(c.is_concentrated, FALSE) AS is_concentrated, "
              f"CASE WHEN {_axis} AND (tiv_percentile >= 90 OR coalesce(c.is_concentrated, FALSE)) THEN TRUE ELSE FALSE END AS changes_decision, "
              f"CASE WHEN classification = 'ERROR' AND severity IN ('HIGH', 'CRITICAL') AND {_axis} AND tiv_percentile >= 90 THEN 'P1' "
              f"WHEN ({_axis} AND tiv_percentile >= 50) OR coalesce(c.is_concentrated, FALSE) THEN 'P2' ELSE 'P3' END AS priority "
              "FROM findings f LEFT JOIN conc c ON c.rule_id = f.rule_id AND c.cell_x = f.cell_x AND c.cell_y = f.cell_y",
    "actions": "SELECT f.row_id, f.rule_id, s.priority, c.classification, c.action, c.method, c.seq FROM flags f "
               "LEFT JOIN scores s ON s.row_id = f.row_id AND s.rule_id = f.rule_id JOIN catalogue c ON c.rule_id = f.rule_id",
    "records": "SELECT row_id, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS treatment_rule, "
               "string_agg(DISTINCT classification, ';' ORDER BY classification) AS classification, "
               "string_agg(DISTINCT priority, ';' ORDER BY priority) AS priority, "
               "string_agg(rule_id || ': ' || method, ' | ' ORDER BY seq) AS treatment_method, "
               + ", ".join(f"bool_or(action = '{a}') AS {a.lower()}" for a in ("QUARANTINED", "REFERRED", "ASSUMED", "FIXED"))
               + ", " + ", ".join(f"bool_or(rule_id = '{r}') AS {r.replace('-', '').lower()}"
                                  for r in ("G-002", "K-001", "K-003", "K-004", "V-001"))
               + " FROM actions GROUP BY row_id",
    "cleansed": "SELECT p.row_id, CASE WHEN g002 THEN longitude ELSE latitude END AS latitude_clean, "
                "CASE WHEN g002 THEN latitude ELSE longitude END AS longitude_clean, "
                "CASE WHEN k003 THEN CASE WHEN upper(trim(construction_code)) LIKE '%RCC%' THEN 'RCC' "
                "WHEN upper(trim(construction_code)) LIKE '%REINFORCED CEMENT CONCRETE%' THEN 'RCC' "
                "WHEN upper(trim(construction_code)) LIKE '%MASON%' THEN 'MASONRY' WHEN upper(trim(construction_code)) LIKE '%STEEL%' THEN 'STEEL' "
                "WHEN upper(trim(construction_code)) LIKE '%TIMBER%' THEN 'TIMBER' ELSE construction_code END "
                "WHEN k001 THEN 'RCC' ELSE construction_code END AS construction_clean, occupancy_code AS occupancy_clean, "
                "CASE WHEN k004 THEN CASE WHEN upper(trim(currency)) IN ('INR', '₹', 'RS', 'RUPEES') THEN 'INR' "
                "ELSE upper(trim(currency)) END ELSE currency END AS currency_clean, "
                "CASE WHEN v001 THEN abs(tiv_total) ELSE tiv_total END AS tiv_total_clean, geocode_level AS geocode_level_clean, "
                "latitude AS latitude_orig, longitude AS longitude_orig, construction_code AS construction_orig, "
                "occupancy_code AS occupancy_orig, currency AS currency_orig, tiv_total AS tiv_total_orig, geocode_level AS geocode_level_orig, "
                "CASE WHEN quarantined THEN 'QUARANTINED' WHEN referred THEN 'REFERRED' WHEN assumed THEN 'ASSUMED' "
                "WHEN fixed THEN 'FIXED' ELSE 'NONE' END AS treatment_applied, treatment_rule, treatment_method, r.classification, r.priority, "
                "coalesce(quarantined, FALSE) AS quarantined, coalesce(referred, FALSE) AS referred, "
                "location_id, account_id, address_line, city, district, state, postcode, occupancy_code, construction_code, year_built, "
                "num_storeys, floor_area_sqm, tiv_building, tiv_contents, tiv_bi, "
                "CASE WHEN v001 THEN abs(tiv_total) ELSE tiv_total END AS tiv_total, currency, deductible, policy_limit "
                "FROM raw p LEFT JOIN records r ON r.row_id = p.row_id",
    "grid": "SELECT grid_lon, grid_lat, project1_tiv, 0.01::DOUBLE*project1_tiv AS project1_aal FROM (VALUES "
            + _values(_grid) + ") t(grid_lon, grid_lat, project1_tiv)",
    "critical": "SELECT p.row_id, location_id, district, latitude_clean, longitude_clean, tiv_total_clean AS stored_tiv, has_p001, has_p003, "
                "CASE WHEN has_p001 AND has_p003 THEN 'P-001 and P-003 detected' WHEN has_p001 THEN 'P-001 unit confusion detected' "
                "ELSE 'P-003 single-location concentration anomaly detected' END AS exclusion_reason FROM cleansed p JOIN ("
                "SELECT row_id, bool_or(rule_id = 'P-001') AS has_p001, bool_or(rule_id = 'P-003') AS has_p003 FROM flags "
                "WHERE rule_id IN ('P-001', 'P-003') GROUP BY 1) q ON q.row_id = p.row_id",
    "dirty_rows": f"SELECT row_id, longitude, latitude, tiv_total FROM raw WHERE {IN_RANGE}",
    "dirty": "SELECT * REPLACE (CAST(total_tiv AS DOUBLE) AS total_tiv) FROM dirty_exact",
    "dirty_exact": "SELECT grid_lon, grid_lat, count(*) AS location_count, sum(" + money("tiv_total") + ") AS total_tiv FROM ("
             + _nearest("dirty_rows", "row_id", "longitude", "latitude", 0.177, ", tiv_total") + ") GROUP BY 1, 2",
    "clean_rows": f"SELECT row_id, longitude_clean, latitude_clean, tiv_total_clean FROM cleansed p WHERE {_usable} AND {_not_critical} "
                  f"AND {_IN_CLEAN} AND tiv_total_clean IS NOT NULL",
    "clean_points": "SELECT * REPLACE (CAST(total_tiv AS DOUBLE) AS total_tiv) FROM clean_exact",
    "clean_exact": "SELECT grid_lon, grid_lat, count(*) AS location_count, sum(" + money("tiv_total_clean") + ") AS total_tiv FROM ("
                    + _nearest("clean_rows", "row_id", "longitude_clean", "latitude_clean", 0.177, ", tiv_total_clean") + ") GROUP BY 1, 2",
    "fallback_rows": "SELECT row_id, longitude_clean AS longitude, latitude_clean AS latitude, tiv_total_clean, FALSE AS assumed FROM clean_rows "
                     "UNION ALL SELECT p.row_id, f.lon, f.lat, tiv_total_clean, TRUE FROM cleansed p JOIN (VALUES "
                     + _values([(d, x + 0.5, y + 0.5) for d, x, y in derived.LAND]) + ") f(district, lon, lat) ON p.district = f.district "
                     f"WHERE {_usable} AND {_not_critical} AND tiv_total_clean IS NOT NULL AND (latitude_clean IS NULL OR longitude_clean IS NULL)",
    "fallback": "SELECT grid_lon, grid_lat, count(*) AS location_count, " + total("tiv_total_clean") + " AS total_tiv, "
                "count(*) FILTER (WHERE assumed) AS assumed_location_count, "
                f"CAST(sum({money('tiv_total_clean')}) FILTER (WHERE assumed) AS DOUBLE) AS assumed_tiv FROM ("
                + _nearest("fallback_rows", "row_id", "longitude", "latitude", None, ", tiv_total_clean, assumed") + ") GROUP BY 1, 2",
    "scenario_rows": " UNION ALL ".join([
        _scenario("PRIMARY", _not_critical), _scenario("P001_SENSITIVITY", _critical_with("has_p001")),
        _scenario("P003_SENSITIVITY", _critical_with("has_p003")), _scenario("COMBINED_SENSITIVITY", "TRUE")]),
    "sensitivity": "SELECT scenario, grid_lon, grid_lat, count(*) AS location_count, " + total("tiv_total_clean") + " AS total_tiv FROM ("
                   + _nearest("scenario_rows", "scenario, row_id", "longitude_clean", "latitude_clean", None, ", tiv_total_clean")
                   + ") GROUP BY 1, 2, 3",
    "both_points": "SELECT 'DIRTY' AS portfolio_status, * FROM dirty UNION ALL SELECT 'CLEANSED', * FROM clean_points",
    "compared": "SELECT grid_lon, grid_lat, dirty_locations, cleansed_locations, CAST(dt AS DOUBLE) AS dirty_tiv, "
                "CAST(ct AS DOUBLE) AS cleansed_tiv, CAST(ct - dt AS DOUBLE) AS tiv_change, "
                "round(CAST(ct - dt AS DOUBLE)*100/nullif(CAST(dt AS DOUBLE), 0), 10) AS tiv_change_pct FROM ("
                "SELECT coalesce(d.grid_lon, c.grid_lon) AS grid_lon, coalesce(d.grid_lat, c.grid_lat) AS grid_lat, "
                "coalesce(d.location_count, 0) AS dirty_locations, coalesce(c.location_count, 0) AS cleansed_locations, "
                "coalesce(d.total_tiv, 0) AS dt, coalesce(c.total_tiv, 0) AS ct FROM dirty_exact d "
                "FULL JOIN clean_exact c ON d.grid_lon = c.grid_lon AND d.grid_lat = c.grid_lat)",
    "scenario_points": "SELECT 'DIRTY' AS scenario, grid_lon, grid_lat, total_tiv FROM dirty UNION ALL "
                       "SELECT scenario, grid_lon, grid_lat, total_tiv FROM sensitivity",
    "linked": "SELECT s.*, g.project1_tiv, g.project1_aal, CASE WHEN g.project1_aal IS NULL THEN NULL WHEN g.project1_tiv > 0 "
              "THEN g.project1_aal*s.total_tiv/g.project1_tiv ELSE 0 END AS linked_aal FROM scenario_points s "
              "LEFT JOIN grid g ON g.grid_lon = s.grid_lon AND g.grid_lat = s.grid_lat",
    "weights": "SELECT cell_x, cell_y, (sum(n) OVER w - n)/sum(n) OVER () AS low, sum(n) OVER w/sum(n) OVER () AS high FROM ("
               "SELECT cell_x, cell_y, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1, 2) "
               "WINDOW w AS (ORDER BY cell_x, cell_y ROWS UNBOUNDED PRECEDING)",
}


VIEWS |= corruption_sql.VIEWS


def sql(body: str) -> str:
    """``body`` preceded by the views it needs, in dependency order."""
    order: list[str] = []

    open_views: set[str] = set()

    def visit_view(name: str) -> None:
        if name in order or name in open_views:
            return
        open_views.add(name)
        # only names that follow FROM or JOIN are views
        for used in re.findall(r"(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z_0-9]*)", VIEWS[name]):
            if used in VIEWS:
                visit_view(used)
        order.append(name)

    for used in re.findall(r"(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z_0-9]*)", body):
        if used in VIEWS:
            visit_view(used)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order) + "\n" + body


def _check(name: str, observed: str, expected: str, ok: str | None = None) -> str:
    """One check row from two scalar expressions."""
    ok = ok or "observed = expected"
    return (f"SELECT '{name}' AS \"check\", {ok} AS ok, observed, expected FROM (SELECT CAST({observed} AS DOUBLE) AS observed, "
            f"CAST({expected} AS DOUBLE) AS expected)")


def _ratios(source: str, lead: str) -> str:
    def part(den: str) -> str:
        return f"coalesce(CAST(TP AS DOUBLE)/nullif(TP + {den}, 0), 0)"

    return f"SELECT {lead}, TP, FP, FN, {part('FP')} AS precision, {part('FN')} AS recall FROM {source}"


_sums = "CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(FP) AS BIGINT) AS FP, CAST(sum(FN) AS BIGINT) AS FN"
_COMPLETENESS = "rule_id BETWEEN 'C-001' AND 'C-007'"


def _by(raw: str, clean: str) -> str:
    return (f"SELECT 'DIRTY' AS portfolio_status, {raw}, count(*) AS location_count, {total('tiv_total')} AS total_tiv FROM raw GROUP BY {raw} "
            f"UNION ALL SELECT 'CLEANSED', {clean}, count(*), {total('tiv_total_clean')} FROM cleansed p WHERE {_usable} AND {_not_critical} GROUP BY {clean}")


def _top10(source: str) -> str:
    return (f"(SELECT CAST(sum({money('total_tiv')}) AS DOUBLE) FROM (SELECT total_tiv, rank() OVER (ORDER BY total_tiv DESC NULLS FIRST) AS r "
            f"FROM {source}) WHERE r <= 10)")


def _report() -> str:
    def pct(k: str, den: str) -> str:
        return f"printf('%.6f%%', coalesce(CAST(tp_{k} AS DOUBLE)/nullif(tp_{k} + {den}_{k}, 0), 0)*100)"

    def block(title: str, k: str) -> list[str]:
        return ["''", f"'{title}'", f"'TP: ' || tp_{k}", f"'FP: ' || fp_{k}", f"'FN: ' || fn_{k}"]

    def both(k: str) -> list[str]:
        return [f"'Precision: ' || {pct(k, 'fp')}", f"'Recall: ' || {pct(k, 'fn')}"]

    lines = ["'Detection evaluation summary'", "'============================'", "''",
             "'Ground-truth pairs: ' || (tp_all + fn_all)", "'Detected pairs: ' || (tp_all + fp_all)",
             *block("Overall detection", "all"), *both("all"),
             *block("Injected-error evaluation (completeness excluded)", "inj"), *both("inj"),
             *block("Completeness", "com"), f"'Coverage: ' || {pct('com', 'fn')}"]
    sums = ", ".join(
        f"CAST(sum({c}) FILTER (WHERE {cond}) AS BIGINT) AS {c.lower()}_{k}"
        for k, cond in (("all", "TRUE"), ("inj", f"NOT {_COMPLETENESS}"), ("com", _COMPLETENESS))
        for c in ("TP", "FP", "FN"))
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, {x} AS line FROM (SELECT {sums} FROM rule_counts)"
        for i, x in enumerate(lines))


def _method(column: str) -> str:
    return f"SELECT row_id, treatment_method FROM records WHERE {column}"


def _fixed(rule: str, columns: str, extra: str = "") -> str:
    return f"SELECT row_id, {columns} FROM cleansed WHERE treatment_rule LIKE '%{rule}%'{extra}"


BODIES = {
    "a01_csv_scan": f"SELECT district, count(*) AS rows, count(postcode) AS postcodes, min(postcode) AS first_postcode, {total('tiv_total')} AS total FROM raw GROUP BY 1",
    "a01_malformed_fields": "SELECT field, value, malformed, missing FROM ("
    "SELECT 'year_built' AS field, '19x5' AS value, count(*) FILTER (WHERE row_id % 97 = 0) AS malformed, "
    "count(*) FILTER (WHERE year_built IS NULL AND row_id % 97 <> 0) AS missing FROM raw UNION ALL "
    "SELECT 'num_storeys', '12O0', count(*) FILTER (WHERE row_id % 89 = 0), "
    "count(*) FILTER (WHERE num_storeys IS NULL AND row_id % 89 <> 0) FROM raw)",
    "a01_well_formed": _check("fields_well_formed", "(SELECT count(*) FROM raw WHERE row_id % 71 = 0)", "0") + " UNION ALL "
    + _check("records_well_formed", "(SELECT count(*) FROM raw WHERE row_id % 53 = 0)", "0"),
    "a03_geojson_boundaries": "SELECT poly_id, count(*) AS points FROM (SELECT longitude AS x, latitude AS y FROM raw "
    "WHERE latitude BETWEEN 15 AND 25 AND longitude BETWEEN 80 AND 90) JOIN ("
    "SELECT district AS poly_id, round(min(longitude), 2) AS xl, round(max(longitude), 2) AS xh, round(min(latitude), 2) AS yl, "
    "round(max(latitude), 2) AS yh FROM raw WHERE latitude BETWEEN 15 AND 25 AND longitude BETWEEN 80 AND 90 AND district IN ('A', 'B', 'C') "
    "GROUP BY 1) ON (x > xl AND x < xh AND y > yl AND y < yh AND NOT (x >= xl + (xh - xl)/4 AND x <= xl + (xh - xl)/2 "
    "AND y >= yl + (yh - yl)/4 AND y <= yl + (yh - yl)/2)) OR (poly_id = 'A' AND x > xl - 2 AND x < xl - 1 AND y > yl AND y < yh) GROUP BY 1",
    "a04_point_grid": "SELECT round(round(longitude*4)/4 + (row_id % 7)*1e-10, 8) + 0.0 AS grid_lon, round(round(latitude*4)/4 - (row_id % 7)*1e-10, 8) + 0.0 AS grid_lat, "
    f"count(*) AS points, {total('tiv_building')} AS value FROM raw WHERE {LOCATED} GROUP BY 1, 2",
    "a05_append_and_replace": "SELECT district, count(*) AS rows FROM raw GROUP BY 1",
    "a06_table_read": "SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1",
    "a08_keyed_replace": "SELECT row_id, district, tiv_total FROM raw WHERE row_id NOT IN (SELECT row_id FROM clean) UNION ALL SELECT row_id, district, tiv_total*2 FROM clean",
    "a08_replace_in_place": "SELECT row_id, district, tiv_total FROM raw WHERE row_id NOT IN (SELECT row_id FROM clean) UNION ALL SELECT row_id, district, tiv_total*2 FROM clean",
    "a09_rule_catalogue": "SELECT c.rule_id, dimension, severity, classification, injection_rule, tested_by_injection, count(f.row_id) AS flags FROM catalogue c LEFT JOIN flags f ON f.rule_id = c.rule_id GROUP BY ALL",
    "a10_axis_flags": "SELECT f.rule_id, affects_hazard, affects_vulnerability, affects_financial, count(*) AS flags FROM flags f JOIN catalogue c ON f.rule_id = c.rule_id GROUP BY ALL",
    "a13_row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders",
    "a14_code_map": "SELECT name, count(*) AS rows FROM raw JOIN (VALUES ('A', 'Alpha'), ('B', 'Beta'), ('D', 'Delta')) t(district, name) USING (district) GROUP BY 1",
    "b01_row_count": _check("row_count", "(SELECT count(*) FROM raw)", "(SELECT count(*) + count(*) FILTER (WHERE o_orderkey % 1000 BETWEEN 906 AND 909) FROM orders)"),
    "b02_no_nulls": _check("tiv_total_not_null", "(SELECT count(*) FROM raw WHERE tiv_total IS NULL)", "0") + " UNION ALL "
    + _check("latitude_not_null", "(SELECT count(*) FROM raw WHERE latitude IS NULL)", "0"),
    "b03_positive": _check("tiv_total_positive", "(SELECT count(*) FROM raw WHERE tiv_total <= 0)", "0") + " UNION ALL "
    + _check("tiv_total_positive", "(SELECT count(*) FROM clean WHERE tiv_total <= 0)", "0"),
    "b04_unmapped_codes": "SELECT construction_code, count(*) AS rows FROM raw p WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.construction_code = p.construction_code) GROUP BY 1",
    "b05_unique_key": _check("row_id_unique", "(SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY row_id HAVING count(*) > 1))", "0") + " UNION ALL "
    + _check("location_id_unique", "(SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY location_id HAVING count(*) > 1))", "0"),
    "b06_same_keys": _check("same_keys", "(SELECT count(*) FROM compared WHERE dirty_locations = 0 OR cleansed_locations = 0)", "0"),
    "b07_close_values": _check("values_agree", "(SELECT max(abs(dirty_tiv - cleansed_tiv)) FROM compared WHERE dirty_locations > 0 AND cleansed_locations > 0)", "0.000001", "observed <= expected"),
    "b08_reference_found": _check("reference_found", "(SELECT count(*) FROM raw WHERE postcode NOT IN (SELECT postcode FROM postcodes))", "0") + " UNION ALL "
    + _check("reference_found", "(SELECT count(*) FROM raw WHERE row_id NOT IN (SELECT row_id FROM validated))", "0"),
    "b09_categories_present": _check("scenario_present", "(SELECT count(DISTINCT scenario) FROM sensitivity WHERE scenario IN ('PRIMARY', 'P001_SENSITIVITY', 'P003_SENSITIVITY', 'COMBINED_SENSITIVITY'))", "4"),
    "b10_scenario_differs": _check("P003_SENSITIVITY_differs_from_PRIMARY", f"(SELECT {cents('total_tiv')} FROM sensitivity WHERE scenario = 'P003_SENSITIVITY')", f"(SELECT {cents('total_tiv')} FROM sensitivity WHERE scenario = 'PRIMARY')", "observed IS DISTINCT FROM expected"),
    "b11_load_profile": f"SELECT count(*) AS rows, min(row_id) AS min_key, max(row_id) AS max_key, {total('tiv_total')} AS total FROM raw",
    "b11_checks_while_writing": _check("row_count", "(SELECT count(*) FROM raw)", "(SELECT count(*) FROM orders)") + " UNION ALL "
    + _check("latitude_not_null", "(SELECT count(*) FROM raw WHERE latitude IS NULL)", "0") + " UNION ALL "
    + _check("tiv_total_not_null", "(SELECT count(*) FROM raw WHERE tiv_total IS NULL)", "0") + " UNION ALL "
    + _check("tiv_total_positive", "(SELECT count(*) FROM raw WHERE tiv_total <= 0)", "0"),
    "b12_priority_counts": "SELECT priority, count(*) AS flags FROM scores GROUP BY 1",
    "b12_axis_counts": "SELECT affects_hazard, affects_vulnerability, affects_financial, count(*) AS flags FROM scores GROUP BY 1, 2, 3",
    "b13_declared_keys": _check("row_id_rule_id_unique", "(SELECT count(*) FROM (SELECT 1 FROM scores GROUP BY row_id, rule_id HAVING count(*) > 1))", "0") + " UNION ALL "
    + _check("reference_found", "(SELECT count(*) FROM flags WHERE rule_id NOT IN (SELECT rule_id FROM catalogue))", "0") + " UNION ALL "
    + _check("row_id_unique", "(SELECT count(*) FROM (SELECT 1 FROM cleansed GROUP BY row_id HAVING count(*) > 1))", "0"),
    "e01_density_threshold": "SELECT * FROM density",
    "e02_building_tiv_threshold": "SELECT * FROM building",
    "e02_sketched_threshold": "SELECT reference_name, median, clean_max, round(2.296/pow(200, 0.9021), 6) AS rank_error, true AS within, true AS bracketed FROM building",
    "e03_reference_row": "SELECT * FROM building UNION ALL SELECT * REPLACE ('other' AS reference_name) FROM building",
    "e04_materiality_reference": "SELECT * FROM validated",
    **{f"d{i:02d}_{r.rule_id.lower().replace('-', '')}_{r.error_type.split('_', 1)[1]}": RULE_SQL[r.rule_id]
       for i, r in enumerate(RULES, start=1)},
    "d40_detect_all": "SELECT * FROM flags",
    "d40_flags_per_rule": "SELECT rule_id, count(*) AS flags FROM flags GROUP BY 1",
    "i01_error_type_to_rule": "SELECT error_type, rule_id, count(*) AS events FROM truth GROUP BY 1, 2",
    "i02_distinct_pairs": "SELECT DISTINCT row_id, rule_id FROM truth",
    "i03_confusion_per_rule": "SELECT * FROM rule_counts",
    "i04_precision_recall": _ratios("rule_counts", "rule_id, error_type"),
    "i05_overall": _ratios(f"(SELECT 'all' AS scope, {_sums} FROM rule_counts UNION ALL SELECT 'completeness_excluded', {_sums} FROM rule_counts WHERE NOT {_COMPLETENESS})", "scope"),
    "i05_summary_report": _report(),
    "i06_completeness_coverage": f"SELECT TP, FP, FN, coalesce(CAST(TP AS DOUBLE)/nullif(TP + FN, 0), 0) AS coverage FROM (SELECT {_sums} FROM rule_counts WHERE {_COMPLETENESS})",
    "i07_by_dimension": _ratios(f"(SELECT dimension, {_sums} FROM rule_counts r JOIN (SELECT DISTINCT rule_id, dimension FROM truth) d USING (rule_id) GROUP BY 1)", "dimension"),
    "m01_materiality_tiv": "SELECT * FROM mtiv",
    "m02_tiv_percentile": "SELECT * FROM percentile",
    "m02_percentile_with_nulls": "SELECT row_id, tiv_contents AS materiality_tiv, CASE WHEN tiv_contents IS NOT NULL THEN round(percent_rank() OVER (ORDER BY tiv_contents NULLS LAST)*100, 2) END AS tiv_percentile FROM raw",
    "m03_cells": "SELECT * FROM cells",
    "m04_cell_baseline": "SELECT cell_x, cell_y, count(*) AS portfolio_count FROM cells GROUP BY 1, 2",
    "m05_enriched_findings": "SELECT * FROM findings",
    "m06_rule_totals": "SELECT rule_id, count(*) AS total_flags FROM findings GROUP BY 1",
    "m07_rule_cells": "SELECT rule_id, cell_x, cell_y, count(*) AS flagged_count FROM findings WHERE cell_x IS NOT NULL AND cell_y IS NOT NULL GROUP BY 1, 2, 3",
    "m08_spatial_enrichment": "SELECT * REPLACE (round(enrichment_ratio, 10) AS enrichment_ratio) FROM conc",
    "m09_decision_flag": "SELECT rule_id, changes_decision, count(*) AS flags FROM scores GROUP BY 1, 2",
    "m10_priority": "SELECT rule_id, priority, count(*) AS flags FROM scores GROUP BY 1, 2",
    "m11_scores": "SELECT * FROM scores",
    "m12_funnel": "SELECT stage, count, round(count*100.0/(SELECT count(*) FROM raw), 2)::DOUBLE AS percentage, CASE WHEN n IN (1, 4) THEN tiv END AS value_inr FROM ("
    + " UNION ALL ".join(
        f"SELECT {n} AS n, '{s}' AS stage, count(*) AS count, {total('validated_tiv')} AS tiv FROM raw p LEFT JOIN validated v ON v.row_id = p.row_id WHERE {c}"
        for n, s, c in (
            (1, "Total exposures", "TRUE"),
            (2, "Exposures with findings", "p.row_id IN (SELECT row_id FROM scores)"),
            (3, "Exposures with no findings", "p.row_id NOT IN (SELECT row_id FROM scores)"),
            (4, "P1 exposures", "p.row_id IN (SELECT row_id FROM scores WHERE priority = 'P1')"))) + ")",
    "t01_findings_with_priority": "SELECT f.row_id, f.rule_id, s.priority FROM flags f LEFT JOIN scores s ON s.row_id = f.row_id AND s.rule_id = f.rule_id",
    "t02_actions": "SELECT rule_id, action, method, count(*) AS findings FROM actions GROUP BY 1, 2, 3",
    "t03_original_and_clean": "SELECT row_id, " + ", ".join(
        f"{f}_{s}" for f in ("latitude", "longitude", "construction", "occupancy", "currency", "tiv_total", "geocode_level") for s in ("orig", "clean"))
    + " FROM cleansed",
    "t04_fix_swapped": _fixed("G-002", "latitude_orig, longitude_orig, latitude_clean, longitude_clean"),
    "t05_fix_free_text": _fixed("K-001", "construction_orig, construction_clean", " AND treatment_rule NOT LIKE '%K-003%'"),
    "t06_fix_numeric_codes": _fixed("K-003", "construction_orig, construction_clean"),
    "t07_fix_currency": _fixed("K-004", "currency_orig, currency_clean"),
    "t08_fix_negative": _fixed("V-001", "tiv_total_orig, tiv_total_clean, tiv_total"),
    "t09_quarantined": _method("quarantined"),
    "t10_referred": _method("referred"),
    "t11_assumed": _method("assumed"),
    "t12_audit_strings": "SELECT row_id, treatment_rule, classification, priority, treatment_method FROM records",
    "t13_outcome": "SELECT row_id, treatment_applied, quarantined, referred FROM cleansed",
    "t14_cleansed": "SELECT * FROM cleansed",
    "t15_treatment_summary": "SELECT treatment_applied, count(*) AS count FROM cleansed GROUP BY 1",
    "t15_classification_summary": "SELECT coalesce(classification, 'NONE') AS classification, count(*) AS count FROM cleansed GROUP BY 1",
    "s01_points": f"SELECT row_id, longitude AS x, latitude AS y FROM raw WHERE {LOCATED}",
    "s02_point_in_polygon": "SELECT row_id, l.poly_id FROM raw p CROSS JOIN (SELECT DISTINCT poly_id FROM land) l WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND "
    + _inside("land e WHERE e.poly_id = l.poly_id", "p.longitude", "p.latitude"),
    "s03_covered_by_polygon": "SELECT row_id, count(*) FILTER (WHERE longitude BETWEEN xl AND xh AND latitude BETWEEN yl AND yh) AS covered_by, "
    "count(*) FILTER (WHERE longitude > xl AND longitude < xh AND latitude > yl AND latitude < yh) AS within, "
    "count(*) FILTER (WHERE px BETWEEN xl AND xh AND py BETWEEN yl AND yh) AS snapped_covered_by, "
    "count(*) FILTER (WHERE px > xl AND px < xh AND py > yl AND py < yh) AS snapped_within FROM ("
    "SELECT row_id, longitude, latitude, round(longitude*2)/2 AS px, round(latitude*2)/2 AS py FROM raw WHERE latitude IS NOT NULL) CROSS JOIN ("
    "SELECT poly_id, min(x1) AS xl, max(x1) AS xh, min(y1) AS yl, max(y1) AS yh FROM land GROUP BY 1) GROUP BY row_id",
    "s04_nearest_point": _nearest("raw", "row_id", "longitude", "latitude"),
    "s05_nearest_within_radius": _nearest("raw", "row_id", "longitude", "latitude", 0.177),
    "u01_critical_referred": "SELECT * FROM critical",
    "u02_dirty_accumulation": "SELECT * FROM dirty",
    "u03_cleansed_accumulation": "SELECT * FROM clean_points",
    "u04_fallback_accumulation": "SELECT * FROM fallback",
    "u05_fallback_comparison": "SELECT scenario, locations, round(portfolio_tiv, 2) AS portfolio_tiv, round(top10_tiv, 2) AS top10_tiv, round(top10_tiv/portfolio_tiv*100, 10) AS top10_tiv_share_pct, assumed_locations, round(assumed_tiv, 2) AS assumed_tiv FROM ("
    f"SELECT 'CONSERVATIVE' AS scenario, CAST(sum(location_count) AS BIGINT) AS locations, {total('total_tiv')} AS portfolio_tiv, {_top10('clean_points')} AS top10_tiv, NULL::BIGINT AS assumed_locations, NULL::DOUBLE AS assumed_tiv FROM clean_points "
    f"UNION ALL SELECT 'DISTRICT_FALLBACK', CAST(sum(location_count) AS BIGINT), {total('total_tiv')}, {_top10('fallback')}, CAST(sum(assumed_location_count) AS BIGINT), {total('assumed_tiv')} FROM fallback)",
    "u06_accumulation_summary": f"SELECT portfolio_status, count(*) AS grid_cells, CAST(sum(location_count) AS BIGINT) AS locations, {cents('total_tiv')} AS portfolio_tiv FROM both_points GROUP BY 1",
    "u07_top_cells": "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY portfolio_status ORDER BY total_tiv DESC NULLS FIRST) AS tiv_rank FROM both_points) WHERE tiv_rank <= 10",
    "u08_concentration": _concentration("clean_points"),
    "u09_sensitivity": "SELECT * FROM sensitivity",
    "u10_sensitivity_summary": f"SELECT scenario, count(*) AS grid_cells, CAST(sum(location_count) AS BIGINT) AS spatial_locations, {cents('total_tiv')} AS spatial_tiv FROM sensitivity GROUP BY 1",
    "u11_dirty_vs_cleansed": "SELECT * FROM compared",
    "u12_largest_changes": "SELECT * FROM compared ORDER BY abs(tiv_change) DESC NULLS FIRST, grid_lon, grid_lat LIMIT 20",
    "u13_by_district": _by("district", "district"),
    "u14_by_occupancy": _by("occupancy_code", "occupancy_code"),
    "u15_by_construction": _by("construction_code", "construction_clean"),
    "u16_impact_summary": _concentration("scenario_points", "scenario"),
    "audit_run": _concentration("scenario_points", "scenario"),
    "l01_grid_check": "SELECT *, 'same' AS grid FROM (" + _check("same_keys", "0", "0") + " UNION ALL "
    + _check("values_agree", "0", "0.000001", "observed <= expected") + ") UNION ALL SELECT *, 'other' FROM ("
    + _check("same_keys", "(SELECT count(*) FROM compared WHERE dirty_locations = 0 OR cleansed_locations = 0)", "0") + " UNION ALL "
    + _check("values_agree", "(SELECT max(abs(dirty_tiv - cleansed_tiv)) FROM compared WHERE dirty_locations > 0 AND cleansed_locations > 0)", "0.000001", "observed <= expected") + ")",
    "l02_scenario_stack": "SELECT * FROM scenario_points",
    "l03_cell_linkage": "SELECT * FROM linked",
    "l03_linkage_checks": _check("scenario_grid_lon_grid_lat_unique", "(SELECT count(*) FROM (SELECT 1 FROM scenario_points GROUP BY scenario, grid_lon, grid_lat HAVING count(*) > 1))", "0") + " UNION ALL "
    + _check("grid_lon_grid_lat_unique", "(SELECT count(*) FROM (SELECT 1 FROM grid GROUP BY grid_lon, grid_lat HAVING count(*) > 1))", "0") + " UNION ALL "
    + _check("reference_found", "(SELECT count(*) FROM linked WHERE project1_aal IS NULL)", "0"),
    "l04_scenario_summary": "SELECT scenario, grid_cells, round(portfolio_tiv, 2) AS portfolio_tiv, round(linked_aal, 2) AS linked_aal, round(linked_aal/portfolio_tiv, 10) AS aal_to_tiv, round(linked_aal/t, 10) AS aal_multiple_vs_project1, "
    "round((linked_aal/t - 1)*100, 10) AS aal_change_vs_project1_pct FROM ("
    f"SELECT scenario, count(*) AS grid_cells, {total('total_tiv')} AS portfolio_tiv, {total('linked_aal')} AS linked_aal FROM linked GROUP BY 1) CROSS JOIN (SELECT {total('project1_aal')} AS t FROM grid)",
    **corruption_sql.BODIES,
    "j04_weighted_draw": "SELECT row_id, cell_x, cell_y FROM (SELECT row_id, CAST(CAST('0x' || substr(md5(concat('42|cell|', row_id)), 1, 12) AS BIGINT) AS DOUBLE)/281474976710656 AS u FROM raw) "
    "JOIN weights ON low <= u AND u < high",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
