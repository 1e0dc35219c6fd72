WITH b0 AS (
 SELECT o_orderkey AS k, o_custkey AS ck, o_orderkey % 1000 AS m,
  (o_orderkey*7919+13) % 10007 AS h1, (o_orderkey*104729+7) % 10009 AS h2, (o_orderkey*1299709+3) % 10037 AS h3,
  CASE WHEN o_orderkey % 1000 BETWEEN 890 AND 897 THEN o_orderkey + 100 ELSE o_orderkey END AS gk,
  CASE WHEN o_orderkey % 1000 BETWEEN 903 AND 905 THEN o_orderkey + 95 ELSE o_orderkey END AS lk
 FROM orders),
b1 AS (
 SELECT *, h1 % 4 AS d, ((gk*7919+13) % 10007) % 4 AS gd, (gk*104729+7) % 10009 AS g2, (gk*1299709+3) % 10037 AS g3,
  CASE WHEN h1 % 20 < 12 THEN 'RES' WHEN h1 % 20 < 17 THEN 'COM' WHEN h1 % 20 < 19 THEN 'IND' ELSE 'PUB' END AS occ,
  CASE WHEN h2 % 20 < 9 THEN 'RCC' WHEN h2 % 20 < 15 THEN 'MASONRY' WHEN h2 % 20 < 18 THEN 'STEEL' ELSE 'TIMBER' END AS con,
  50 + h3 % 900 AS area, 30000 + h2 % 20000 AS rate FROM b0),
b2 AS (
 SELECT *, CAST(area*rate AS DOUBLE) AS tb, CAST(area*rate AS DOUBLE)*0.25E0 AS tc,
  CASE WHEN occ IN ('COM','IND') THEN CAST(area*rate AS DOUBLE)*0.2E0 ELSE 0E0 END AS ti,
  CASE WHEN gd IN (0,2) THEN 85E0 ELSE 86E0 END + 0.05E0 + 0.9E0*g3/10037E0 AS lon,
  CASE WHEN gd IN (0,1) THEN 20E0 ELSE 21E0 END + 0.05E0 + 0.9E0*g2/10009E0 AS lat,
  CASE WHEN m BETWEEN 492 AND 495 THEN 1000E0 WHEN m BETWEEN 903 AND 905 THEN 1.15E0 WHEN k = 516 THEN 200000E0 ELSE 1E0 END AS f FROM b1),
p AS (
 SELECT k + 1 AS row_id, 'LOC' || lpad(CAST(lk AS STRING),8,'0') AS location_id, 'ACC' || lpad(CAST(ck AS STRING),8,'0') AS account_id,
  CASE WHEN m BETWEEN 898 AND 902 THEN 'Synthetic location Ltd.' ELSE 'Synthetic location' END AS address_line,
  CASE (d + CASE WHEN m BETWEEN 482 AND 491 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'Aton' WHEN 1 THEN 'Bton' WHEN 2 THEN 'Cton' ELSE 'Dton' END AS city,
  CASE d WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS district, 'S' AS state,
  CAST(700000 + ((d + CASE WHEN m BETWEEN 467 AND 481 THEN 1 ELSE 0 END) % 4)*1000 + h2 % 10 AS STRING) AS postcode,
  CASE WHEN m < 40 THEN NULL WHEN m BETWEEN 423 AND 424 THEN 190.5E0 WHEN m BETWEEN 717 AND 728 THEN 19E0 WHEN m BETWEEN 729 AND 734 THEN lon WHEN m BETWEEN 735 AND 736 THEN 0E0 WHEN m BETWEEN 737 AND 739 THEN 51.5E0
   WHEN m BETWEEN 740 AND 779 THEN CASE WHEN m % 4 < 2 THEN 20.5E0 ELSE 21.5E0 END ELSE lat END AS latitude,
  CASE WHEN m < 40 THEN NULL WHEN m BETWEEN 717 AND 728 THEN 86.8E0 WHEN m BETWEEN 729 AND 734 THEN lat WHEN m BETWEEN 735 AND 736 THEN 0E0 WHEN m BETWEEN 737 AND 739 THEN -0.1E0
   WHEN m BETWEEN 740 AND 779 THEN CASE WHEN m % 2 = 0 THEN 85.5E0 ELSE 86.5E0 END ELSE lon END AS longitude,
  CASE WHEN m BETWEEN 740 AND 779 THEN 'POSTCODE' ELSE 'EXACT' END AS geocode_level,
  CASE WHEN m BETWEEN 380 AND 409 THEN NULL WHEN m BETWEEN 451 AND 453 THEN 'RES' WHEN m BETWEEN 454 AND 456 OR m BETWEEN 597 AND 716 THEN 'IND' WHEN m BETWEEN 830 AND 859 THEN 'MIXED-USE?' ELSE occ END AS occupancy_code,
  CASE WHEN m BETWEEN 40 AND 139 THEN NULL WHEN m BETWEEN 441 AND 446 THEN 'TIMBER' WHEN m BETWEEN 447 AND 450 THEN 'RCC' WHEN m BETWEEN 780 AND 829 THEN 'R.C.C.' WHEN m BETWEEN 860 AND 879 THEN '0' || CAST(1 + k % 4 AS STRING) ELSE con END AS construction_code,
  CASE WHEN m BETWEEN 140 AND 239 THEN NULL WHEN m BETWEEN 425 AND 428 THEN 2035 WHEN m BETWEEN 429 AND 430 THEN 1750 WHEN m BETWEEN 447 AND 450 THEN 1880 WHEN m BETWEEN 517 AND 596 THEN 1900 ELSE 1960 + h3 % 55 END AS year_built,
  CASE WHEN m BETWEEN 240 AND 299 THEN NULL WHEN m BETWEEN 431 AND 434 THEN 0 WHEN m BETWEEN 441 AND 446 THEN 15 + h1 % 16 WHEN m BETWEEN 454 AND 456 THEN 25 WHEN m BETWEEN 597 AND 716 THEN 1 ELSE 2 + h1 % CASE WHEN con = 'TIMBER' THEN 2 ELSE 7 END END AS num_storeys,
  CASE WHEN m BETWEEN 457 AND 466 THEN tb/3000000E0 ELSE CAST(area AS DOUBLE) END AS floor_area_sqm,
  CASE WHEN m BETWEEN 413 AND 422 THEN 0E0 WHEN m BETWEEN 451 AND 453 THEN 800000000E0 WHEN m BETWEEN 496 AND 515 THEN 8000000E0 ELSE tb*f END AS tiv_building,
  CASE WHEN m BETWEEN 300 AND 339 THEN NULL WHEN m BETWEEN 451 AND 453 THEN 0E0 WHEN m BETWEEN 496 AND 515 THEN 2000000E0 ELSE tc*f END AS tiv_contents,
  CASE WHEN m BETWEEN 451 AND 453 OR m BETWEEN 496 AND 515 THEN 0E0 ELSE ti*f END AS tiv_bi,
  CASE WHEN m BETWEEN 410 AND 412 THEN -(tb+tc+ti) WHEN m BETWEEN 451 AND 453 THEN 800000000E0 WHEN m BETWEEN 496 AND 515 THEN 10000000E0 ELSE (tb+tc+ti)*f END AS tiv_total,
  CASE WHEN m BETWEEN 880 AND 889 THEN CASE WHEN k % 2 = 0 THEN 'Rs' ELSE 'USD' END ELSE 'INR' END AS currency,
  CASE WHEN m BETWEEN 340 AND 379 THEN NULL WHEN m BETWEEN 435 AND 440 THEN (tb+tc+ti)*5E0 ELSE (tb+tc+ti)*0.02E0 END AS deductible,
  (tb+tc+ti)*0.9E0 AS policy_limit, m FROM b2)
SELECT * FROM p UNION ALL
SELECT row_id + (SELECT max(row_id) FROM p), location_id, account_id, address_line, city, district, state, postcode, latitude, longitude, geocode_level, occupancy_code, construction_code, year_built, num_storeys, floor_area_sqm, tiv_building, tiv_contents, tiv_bi, tiv_total, currency, deductible, policy_limit, m + 1000 FROM p WHERE m BETWEEN 906 AND 909
