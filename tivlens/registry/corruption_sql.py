"""SQL for error injection: selection, donors, edits, copies and ground truth, by their definitions."""

from __future__ import annotations

from tivlens.operators import corrupt
from tivlens.sources import derived

LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL"
SEED = corrupt.SEED
SHORTS = [t.name.split("_")[0] for t in corrupt.TYPES]
DUPLICATE = corrupt.DUPLICATE


def _md5(label: str, key: str = "row_id") -> str:
    return f"md5(concat('{SEED}|{label}|', {key}))"


def _digits(label: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr({_md5(label)}, {start}, {n}) AS BIGINT)"


def _pick(values: list[str], label: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], {_digits(label + '-value', 13, 7)} % {len(values)} + 1)"


def _wanted(share: float, rows: str = "pristine") -> str:
    return f"CAST(round_even({share}::DOUBLE*(SELECT count(*) FROM {rows}), 0) AS BIGINT)"


def _blockers(i: int) -> list[corrupt.ErrorType]:
    t = corrupt.TYPES[i]
    return [e for e in corrupt.TYPES[:i] if set(e.fields) & set(t.fields) or e.name in t.after]


def _selected(i: int) -> str:
    """The first n free records in digest order, type after type."""
    t = corrupt.TYPES[i]
    taken = "".join(f" AND row_id NOT IN (SELECT row_id FROM sel_{b.name})" for b in _blockers(i))
    return (f"SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_md5(t.name)}) AS rn "
            f"FROM pristine WHERE ({t.eligible}){taken}) WHERE rn <= {'1' if t.share == 0 else _wanted(t.share)}")


def _given(label: str) -> str:
    """Every receiver's donor value: the smallest combined digest in its block, else the smallest digest."""
    blocks = f"(SELECT CAST(pow(2, floor(log2(greatest(count(*) // {corrupt.DONORS_PER_BLOCK}, 1)))) AS BIGINT) FROM donors_{label})"

    def block(u: str) -> str:
        return f"CAST('0x' || substr({u}, 1, 8) AS BIGINT) % {blocks}"

    return (f"SELECT r.row_id, coalesce(arg_min(d.v, md5(concat(r.ru, d.du))), (SELECT arg_min(v, du) FROM donors_{label})) AS v "
            f"FROM (SELECT row_id, {_md5(label + '-receiver')} AS ru FROM sel_{corrupt.SHORT[label]}) r "
            f"LEFT JOIN donors_{label} d ON {block('r.ru')} = {block('d.du')} GROUP BY r.row_id")


_POSTCODES = {d[0]: [str(700000 + i * 1000 + j) for j in range(10)] for i, d in enumerate(derived.LAND)}
_CITIES = {d: [f"{d}ton"] for d in _POSTCODES}


def _elsewhere(values: dict[str, list[str]], label: str) -> str:
    every = sorted(v for vs in values.values() for v in vs)
    cases = " ".join(f"WHEN district = '{d}' THEN {_pick([v for v in every if v not in own], label)}" for d, own in values.items())
    return f"CASE {cases} ELSE {_pick(every, label)} END"


_TIVS = ("tiv_building", "tiv_contents", "tiv_bi")
_FACTOR = ("CASE WHEN P1 THEN 1000 WHEN P2 AND tiv_total > 0 THEN 1e7::DOUBLE/tiv_total WHEN P3 AND tiv_total > 0 "
           "THEN (0.35::DOUBLE/0.65::DOUBLE)*((SELECT s FROM shares) - tiv_total)/tiv_total WHEN D4 THEN 1.15::DOUBLE END")

# Per column: the values that differ from the clean one, in order of precedence.
_EDITS = {
    "latitude": "WHEN C1 THEN NULL WHEN V3 THEN 190.5 WHEN G1 THEN 19.0 WHEN G2 THEN longitude WHEN G3 THEN 0.0 "
                "WHEN G4 THEN 51.5 WHEN G5 OR D2 THEN coalesce(new_latitude, latitude)",
    "longitude": "WHEN C1 THEN NULL WHEN G1 THEN 86.8 WHEN G2 THEN latitude WHEN G3 THEN 0.0 WHEN G4 THEN -0.1 "
                 "WHEN G5 OR D2 THEN coalesce(new_longitude, longitude)",
    "geocode_level": "WHEN G5 THEN 'POSTCODE'",
    "construction_code": f"WHEN C2 THEN NULL WHEN X1 THEN 'TIMBER' WHEN X2 THEN 'RCC' WHEN K1 THEN {_pick(corrupt.FREE_TEXT, 'K1')} "
                         f"WHEN K3 THEN {_pick(corrupt.NUMERIC_CODES, 'K3')}",
    "year_built": "WHEN C3 THEN NULL WHEN V4 THEN 2035 WHEN V5 THEN 1750 WHEN X2 THEN 1880 WHEN P4 THEN 1900",
    "num_storeys": f"WHEN C4 THEN NULL WHEN V6 THEN 0 WHEN X1 THEN 15 + {_digits('X1-value', 1, 7)} % 16 WHEN X4 THEN 25 WHEN P5 THEN 1",
    "occupancy_code": f"WHEN C7 THEN NULL WHEN X3 THEN 'RES' WHEN X4 THEN 'IND' WHEN K2 THEN {_pick(corrupt.UNKNOWN_OCCUPANCY, 'K2')}",
    "floor_area_sqm": "WHEN X5 THEN CASE WHEN V2 THEN 0.0 WHEN X3 THEN 8e8 ELSE tiv_building END/3e6",
    "tiv_building": "WHEN V2 THEN 0.0 WHEN X3 THEN 8e8 WHEN f IS NOT NULL THEN tiv_building*f",
    "tiv_contents": "WHEN C5 THEN NULL WHEN X3 THEN 0.0 WHEN f IS NOT NULL THEN tiv_contents*f",
    "tiv_bi": "WHEN X3 THEN 0.0 WHEN f IS NOT NULL THEN tiv_bi*f",
    "tiv_total": "WHEN V1 THEN -abs(tiv_total) WHEN X3 THEN 8e8 WHEN f IS NOT NULL THEN tiv_building*f + tiv_contents*f + tiv_bi*f",
    "deductible": "WHEN C6 THEN NULL WHEN V7 THEN CASE WHEN NOT V1 AND tiv_total > 0 THEN tiv_total ELSE 1e6 END*5",
    "postcode": f"WHEN X6 THEN {_elsewhere(_POSTCODES, 'X6')}",
    "city": f"WHEN X7 THEN {_elsewhere(_CITIES, 'X7')}",
    "currency": f"WHEN K4 THEN {_pick(corrupt.CURRENCIES, 'K4')}",
    "address_line": "WHEN D3 THEN CASE WHEN respelt = address_line THEN concat(address_line, ' Ltd.') ELSE respelt END",
    "location_id": "WHEN D4 THEN coalesce(new_location, location_id)",
}
_RESPELT = ("trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(address_line, ',', ''), '-', ' '), "
            "'(?i)\\bRoad\\b', 'Rd', 'g'), '(?i)\\bStreet\\b', 'St', 'g'), '\\s+', ' ', 'g'))")

VIEWS = {
    "pristine_marked": derived.PRISTINE_SQL.strip(),
    "pristine": "SELECT * EXCLUDE (m) FROM pristine_marked",
    **{f"sel_{t.name}": _selected(i) for i, t in enumerate(corrupt.TYPES)},
    "marks": "SELECT row_id, " + ", ".join(f"bool_or(t = '{s}') AS {s}" for s in SHORTS) + " FROM ("
             + " UNION ALL ".join(f"SELECT row_id, '{s}' AS t FROM sel_{corrupt.SHORT[s]}" for s in SHORTS) + ") GROUP BY row_id",
    "anchors": f"SELECT row_number() OVER (ORDER BY {_md5('G5-anchor')}) AS k, latitude, longitude FROM pristine "
               f"WHERE {LOCATED} QUALIFY k <= {corrupt.ANCHORS}",
    "snapped": "SELECT s.row_id, a.latitude, a.longitude FROM (SELECT row_id, row_number() OVER (ORDER BY "
               f"{_md5(corrupt.SHORT['G5'])}) AS place FROM sel_{corrupt.SHORT['G5']}) s "
               "JOIN anchors a ON a.k = s.place % (SELECT count(*) FROM anchors) + 1",
    "donors_D2": "SELECT struct_pack(lat := latitude, lon := longitude) AS v, " + _md5("D2-donor") + f" AS du FROM pristine WHERE {LOCATED} "
                 "AND location_id IS NOT NULL" + "".join(
                     f" AND row_id NOT IN (SELECT row_id FROM sel_{corrupt.SHORT[s]})" for s in [*corrupt.MOVED, "D2"]),
    "donors_D4": "SELECT location_id AS v, " + _md5("D4-donor") + " AS du FROM pristine WHERE location_id IS NOT NULL "
                 f"AND row_id NOT IN (SELECT row_id FROM sel_{corrupt.SHORT['D4']})",
    "given_D2": _given("D2"),
    "given_D4": _given("D4"),
    "marked_rows": "SELECT p.*, " + ", ".join(f"coalesce(m.{s}, false) AS {s}" for s in SHORTS)
                   + ", coalesce(s.latitude, g.v.lat) AS new_latitude, coalesce(s.longitude, g.v.lon) AS new_longitude, h.v AS new_location, "
                   + _RESPELT + " AS respelt FROM pristine p LEFT JOIN marks m ON m.row_id = p.row_id LEFT JOIN snapped s ON s.row_id = p.row_id "
                   "LEFT JOIN given_D2 g ON g.row_id = p.row_id LEFT JOIN given_D4 h ON h.row_id = p.row_id",
    "shares": "SELECT CAST(sum(CAST(CASE WHEN V1 THEN -abs(tiv_total) WHEN X3 THEN 8e8 WHEN P1 THEN tiv_total*1000 "
              "WHEN P2 AND tiv_total > 0 THEN 1e7 ELSE tiv_total END AS DECIMAL(28,4))) AS DOUBLE) AS s FROM marked_rows",
    "factors": f"SELECT *, {_FACTOR} AS f FROM marked_rows",
    "edited": "SELECT * EXCLUDE (f, respelt, new_latitude, new_longitude, new_location) REPLACE ("
              + ", ".join(f"CASE {e} ELSE {c} END AS {c}" for c, e in _EDITS.items()) + ") FROM factors",
    "copies": "SELECT *, row_id AS source_row_id, (SELECT max(row_id) FROM edited) + rn AS copy_id FROM ("
              f"SELECT *, row_number() OVER (ORDER BY {_md5(DUPLICATE.name)}) AS rn FROM edited WHERE row_id IN (SELECT row_id FROM marks)) "
              f"WHERE rn <= {_wanted(DUPLICATE.share)}",
}


def _shown(source: str, f: str) -> str:
    def fixed(decimals: int) -> str:
        return f"CAST(CAST({source}.{f} AS DECIMAL(28,{decimals})) AS VARCHAR)"

    if f in corrupt.DECIMALS:
        return fixed(corrupt.DECIMALS[f])
    if f in ("deductible", *_TIVS, "tiv_total"):
        return (f"CASE WHEN abs({source}.{f}) >= {corrupt.LARGE} THEN {fixed(corrupt.LARGE_DECIMALS)} "
                f"ELSE {fixed(corrupt.MONEY_DECIMALS)} END")
    return f"CAST({source}.{f} AS VARCHAR)"


def _json(source: str, t: corrupt.ErrorType) -> str:
    parts = [f"'\"{f}\":', coalesce(CAST(to_json({_shown(source, f)}) AS VARCHAR), 'null')" for f in sorted(t.shown or t.fields)]
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def _lead(t: corrupt.ErrorType) -> str:
    return f"'{t.name}' AS error_type, '{t.dimension}' AS dimension, '{t.classification}' AS classification"


VIEWS["own_events"] = " UNION ALL ".join(
    f"SELECT e.row_id, {_lead(t)}, {_json('p', t)} AS original_value, {_json('e', t)} AS corrupted_value "
    f"FROM edited e JOIN pristine p ON p.row_id = e.row_id WHERE e.{s}" for s, t in zip(SHORTS, corrupt.TYPES, strict=True))
VIEWS["events"] = (
    "SELECT * FROM own_events UNION ALL "
    "SELECT c.copy_id, o.* EXCLUDE (row_id) FROM own_events o JOIN copies c ON c.source_row_id = o.row_id UNION ALL "
    f"SELECT copy_id, {_lead(DUPLICATE)}, concat('{{\"source_row_id\":', source_row_id, '}}'), "
    "concat('{\"duplicated_row_id\":', copy_id, '}') FROM copies")

BODIES = {
    "j00_selection": " UNION ALL ".join(f"SELECT row_id, '{t.name}' AS error_type FROM sel_{t.name}" for t in corrupt.TYPES),
    "j01_ground_truth": "SELECT * FROM events",
    "j02_injection_log": "SELECT *, target - success AS skipped FROM (" + " UNION ALL ".join(
        f"SELECT '{t.name}' AS rule, '{t.dimension}' AS dimension, CAST({'1' if t.share == 0 else _wanted(t.share)} AS BIGINT) AS target, "
        f"(SELECT count(*) FROM sel_{t.name}) AS success" for t in corrupt.TYPES)
    + f" UNION ALL SELECT '{DUPLICATE.name}', '{DUPLICATE.dimension}', {_wanted(DUPLICATE.share)}, (SELECT count(*) FROM copies))",
    "j03_apply_edits": f"SELECT * EXCLUDE ({', '.join(SHORTS)}) FROM edited",
    "j03_duplicate_rows": "SELECT copy_id AS row_id, source_row_id, location_id FROM copies",
    **{f"j03_{d.lower()}_edits": f"SELECT row_id, error_type, classification, original_value, corrupted_value FROM events WHERE dimension = '{d}'"
       for d in sorted({t.dimension for t in corrupt.TYPES})},
}
