"""Controlled corruption of a clean portfolio with known ground truth.

Which record gets which error is a pure function of the record: every error
type orders its candidates by a seeded digest of the row id and takes the
smallest ``n``. The n-th smallest digest is found by counting digest prefixes,
ever longer ones, until few records share one; so a selection needs small
aggregations over (row id, mask) and no sort or join of the portfolio. Types that
compete for a field are settled one after the other, types that do not are settled
together. The portfolio itself is read and written once, when all cutoffs are known.

Values borrowed from another record come from the donor whose digest, combined with
the receiver's, is the smallest (highest random weight), among the donors of the
receiver's block of digests. All digests are md5, so any engine can repeat the choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tivlens.functions.columns import fixed, money, order_text, pick
from tivlens.operators.ordering import hash_ranks
from tivlens.sources.tables import materialise

SEED = 42
ANCHORS = 10
MONEY_DECIMALS = 4
#: Doubles from here on don't hold that many decimals; they are shown in cents.
LARGE, LARGE_DECIMALS = 1e9, 2
DECIMALS = {"latitude": 8, "longitude": 8, "floor_area_sqm": 6}


@dataclass(frozen=True)
class ErrorType:
    """One kind of error: how many records, which fields it claims, which may get it.

    ``eligible`` is a condition on clean values; ``after`` names earlier types
    that must not have been applied to the record although they claim other fields.
    """

    name: str
    share: float
    fields: tuple[str, ...]
    classification: str = "ERROR"
    eligible: str = "TRUE"
    after: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()

    @property
    def dimension(self) -> str:
        return {"C": "Completeness", "V": "Validity", "X": "Consistency", "D": "Duplication",
                "P": "Plausibility", "G": "Geography", "K": "Coding"}[self.name[0]]


_POINT = ("latitude", "longitude")
_TIV = ("tiv_building", "tiv_contents", "tiv_bi", "tiv_total")
_LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL"

# Names, shares, claimed fields and classifications, in order of application.
TYPES = [
    ErrorType("C1_missing_coordinates", 0.08, _POINT, "UNKNOWN"),
    ErrorType("C2_missing_construction", 0.30, ("construction_code",), "UNKNOWN"),
    ErrorType("C3_missing_year_built", 0.40, ("year_built",), "UNKNOWN"),
    ErrorType("C4_missing_storeys", 0.25, ("num_storeys",), "UNKNOWN"),
    ErrorType("C5_missing_contents", 0.12, ("tiv_contents",), "UNKNOWN",
              "tiv_building IS NOT NULL"),
    ErrorType("C6_missing_deductible", 0.15, ("deductible",), "UNKNOWN"),
    ErrorType("C7_missing_occupancy", 0.05, ("occupancy_code",), "UNKNOWN"),
    ErrorType("V1_negative_tiv", 0.003, ("tiv_total",)),
    ErrorType("V2_zero_tiv", 0.015, ("tiv_building",), "UNKNOWN"),
    ErrorType("V3_invalid_latitude", 0.002, ("latitude",)),
    ErrorType("V4_future_year", 0.004, ("year_built",)),
    ErrorType("V5_implausibly_old_year", 0.002, ("year_built",), "UNKNOWN"),
    ErrorType("V6_invalid_storeys", 0.005, ("num_storeys",)),
    ErrorType("V7_deductible_gt_tiv", 0.008, ("deductible",), shown=("deductible", "tiv_total")),
    ErrorType("X1_timber_25_storeys", 0.006, ("construction_code", "num_storeys")),
    ErrorType("X2_rcc_1880", 0.004, ("construction_code", "year_built")),
    ErrorType("X3_residential_high_tiv", 0.003, ("occupancy_code", *_TIV)),
    ErrorType("X4_warehouse_25_storeys", 0.003, ("occupancy_code", "num_storeys")),
    ErrorType("X5_floor_area_storey_mismatch", 0.012, ("floor_area_sqm",),
              shown=("floor_area_sqm", "num_storeys", "tiv_building")),
    ErrorType("X6_postcode_district_mismatch", 0.02, ("postcode",), "ERROR",
              "postcode IS NOT NULL AND district IS NOT NULL", shown=("postcode", "district")),
    ErrorType("X7_city_coordinate_mismatch", 0.015, ("city",), "ERROR",
              f"city IS NOT NULL AND {_LOCATED}", ("C1_missing_coordinates",),
              ("city", *_POINT)),
    ErrorType("P1_tiv_x1000", 0.005, _TIV, "UNKNOWN"),
    ErrorType("P2_round_tiv_repeated", 0.03, _TIV, "UNKNOWN"),
    ErrorType("P3_single_location_35pct_tiv", 0.0, _TIV, "UNKNOWN"),
    ErrorType("P4_year_built_1900_cluster", 0.05, ("year_built",), "UNKNOWN"),
    ErrorType("P5_industrial_one_storey_default", 0.04, ("num_storeys",), "UNKNOWN",
              "upper(occupancy_code) = 'IND' AND num_storeys IS NOT NULL AND num_storeys <> 1",
              ("C7_missing_occupancy", "X3_residential_high_tiv"),
              ("num_storeys", "occupancy_code")),
    ErrorType("G1_sea_coordinate", 0.012, _POINT),
    ErrorType("G2_lat_lon_swap", 0.006, _POINT, "ERROR", _LOCATED),
    ErrorType("G3_zero_zero", 0.002, _POINT),
    ErrorType("G4_outside_india", 0.003, _POINT),
    ErrorType("G5_postcode_centroid_clustering", 0.06, (*_POINT, "geocode_level"), "ASSUMPTION",
              _LOCATED),
    ErrorType("K1_free_text_construction", 0.15, ("construction_code",)),
    ErrorType("K2_unknown_occupancy", 0.08, ("occupancy_code",), "UNKNOWN"),
    ErrorType("K3_mixed_construction_scheme", 0.05, ("construction_code",)),
    ErrorType("K4_currency_inconsistency", 0.02, ("currency",)),
    ErrorType("D2_shared_coordinates", 0.015, _POINT, "UNKNOWN",
              f"{_LOCATED} AND location_id IS NOT NULL", shown=(*_POINT, "location_id")),
    ErrorType("D3_near_duplicate_address", 0.01, ("address_line",), "UNKNOWN",
              "address_line IS NOT NULL"),
    ErrorType("D4_same_location_different_tiv", 0.003, ("location_id", *_TIV), "ERROR",
              "location_id IS NOT NULL AND tiv_total IS NOT NULL"),
]
DUPLICATE = ErrorType("D1_exact_row_duplicate", 0.004, ())
FREE_TEXT = ["R.C.C.", "Reinforced Cement Concrete"]
UNKNOWN_OCCUPANCY = ["MIXED-USE?", "SEE NOTES"]
NUMERIC_CODES = ["01", "02", "03", "04"]
CURRENCIES = ["Rs", "USD", "EUR", "GBP"]
# End of fixed values.

BIT = {t.name: i for i, t in enumerate(TYPES)}
SHORT = {t.name.split("_")[0]: t.name for t in TYPES}


def _blockers(t: ErrorType) -> list[ErrorType]:
    """Earlier types that exclude ``t`` from a record."""
    earlier = TYPES[:BIT[t.name]]
    return [e for e in earlier if set(e.fields) & set(t.fields) or e.name in t.after]


def levels() -> list[list[ErrorType]]:
    """Types grouped so that every type comes after all that can block it."""
    depth: dict[str, int] = {}
    for t in TYPES:
        depth[t.name] = 1 + max((depth[b.name] for b in _blockers(t)), default=0)
    return [[t for t in TYPES if depth[t.name] == d] for d in range(1, max(depth.values()) + 1)]


def targets(rows: int) -> dict[str, int]:
    """Number of records per type; P3 always takes one."""
    counts = {t.name: round(t.share * rows) for t in [*TYPES, DUPLICATE]}
    counts["P3_single_location_35pct_tiv"] = 1
    return counts


def _any_bit(mask: Column, names: list[str]) -> Column:
    bits = sum(1 << BIT[n] for n in names)
    return mask.bitwiseAND(F.lit(bits).cast("long")) != 0


def has(short: str, mask: str = "__mask") -> Column:
    """The record was picked for the type with this short name (``C1``, ``V2``, ...)."""
    return _any_bit(F.col(mask), [SHORT[short]])


PREFIX_DIGITS = 4
LEAF = 100_000


def cutoffs(candidates: DataFrame, wanted: dict[str, int], sizes: dict[str, int] | None = None) -> dict[str, str]:
    """The ``n``-th smallest digest of each label in ``(label, u)``.

    Digests are counted by prefix (at most 65,536 per label), the prefix that holds the n-th is
    counted by longer prefixes, and so on until at most ``LEAF`` records share it; those are ranked.
    A label with fewer candidates than wanted gets a cutoff above every digest. ``sizes`` are the
    numbers of candidates where they are known.
    """
    result = {label: "" if n == 0 else "g" for label, n in wanted.items()}
    sizes = sizes or {}
    live = {label: ("", n, sizes.get(label, LEAF + 1)) for label, n in wanted.items() if n}  # prefix, rank in it, records
    digits = 0

    def within(held: dict[str, tuple]) -> DataFrame:
        edge = F.lit(False)
        for label, (prefix, _, _) in held.items():
            edge = edge | ((F.col("label") == label) & F.col("u").startswith(prefix))
        return candidates.filter(edge)

    def rank(held: dict[str, tuple]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, v in held.items() for x in (k, int(v[1]))]), F.col("label"))

    leaves = {k: v for k, v in live.items() if v[2] <= LEAF}
    live = {k: v for k, v in live.items() if k not in leaves}
    while live:
        digits += PREFIX_DIGITS
        running = W.partitionBy("label").orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        prefixes = within(live).groupBy("label", F.substring("u", 1, digits).alias("prefix")).agg(
            F.count("*").alias("n")).withColumn("upto", F.sum("n").over(running))
        found = prefixes.filter((F.col("upto") >= rank(live)) & (F.col("upto") - F.col("n") < rank(live))).select(
            "label", "prefix", (rank(live) - F.col("upto") + F.col("n")).alias("rest"), "n").collect()
        live = {r["label"]: (r["prefix"], r["rest"], r["n"]) for r in found}
        leaves |= {k: v for k, v in live.items() if v[2] <= LEAF or digits >= 32}
        live = {k: v for k, v in live.items() if k not in leaves}
    if leaves:
        place = F.row_number().over(W.partitionBy("label").orderBy("u"))
        exact = within(leaves).withColumn("place", place).filter(F.col("place") == rank(leaves))
        result |= {r["label"]: r["u"] for r in exact.collect()}
    return result


#: Width of the interval of digests that is expected to hold a cutoff, in standard deviations.
DEVIATIONS = 12


def _interval(wanted: int, candidates: int) -> tuple[str, str]:
    """Digests between which the cutoff lies, as they are uniform; the result doesn't depend on it."""
    if wanted == 0:
        return "", ""
    share = wanted / max(candidates, 1)
    margin = DEVIATIONS * (wanted + 1) ** 0.5 / max(candidates, 1)
    low, high = share - margin, share + margin
    return "" if low <= 0 else f"{int(low * 16 ** 12):012x}", "g" if high >= 1 else f"{int(high * 16 ** 12):012x}"


#: Digests in one generated method; with more of them it is too long for the JVM to compile.
DIGESTS_PER_METHOD = 4


def _parts(types: list[ErrorType]) -> list[list[ErrorType]]:
    return [types[i:i + DIGESTS_PER_METHOD] for i in range(0, len(types), DIGESTS_PER_METHOD)]


def _bit(t: ErrorType) -> Column:
    return F.lit(1 << BIT[t.name]).cast("long")


def _digest(t: ErrorType, seed: int) -> Column:
    """The ordering digest of a record as ``order_text`` gives it, from the text ``__id`` of its id."""
    return F.md5(F.concat(F.lit(f"{seed}|{t.name}|"), F.col("__id")))


def _id_text() -> Column:
    return F.coalesce(F.col("row_id").cast("string"), F.lit(""))


def _free(t: ErrorType) -> Column:
    """The record may get ``t`` by ``__may`` and its mask."""
    blockers = F.lit(sum(1 << BIT[b.name] for b in _blockers(t))).cast("long")
    return _any_bit(F.col("__may"), [t.name]) & (F.col("__mask").bitwiseAND(blockers) == 0)


def _total(bits: list[Column], start: Column) -> Column:
    return sum(bits, start)


def _near(rows: DataFrame, group: list[ErrorType], between: dict[str, tuple[str, str]], seed: int) -> DataFrame:
    """The types of one level by digest: below the interval they are in ``__mask``, in it they stay in ``__may``, above they leave it."""
    none = F.lit(0).cast("long")
    rows = rows.select("row_id", "__may", "__mask", _id_text().alias("__id"))
    for part in _parts(group):
        # a generator: the digests are computed once, in a method of their own
        drawn = rows.select("*", F.inline(F.array(F.struct(*[
            F.when(_free(t), _digest(t, seed)).alias(f"__u{i}") for i, t in enumerate(part)]))))
        below = [F.col(f"__u{i}") < F.lit(between[t.name][0]) for i, t in enumerate(part)]
        inside = [~x & (F.col(f"__u{i}") <= F.lit(between[t.name][1])) for i, (t, x) in enumerate(zip(part, below, strict=True))]
        others = F.col("__may").bitwiseAND(F.lit(~sum(1 << BIT[t.name] for t in part)).cast("long"))
        rows = drawn.select(
            "row_id", "__id",
            _total([F.when(x, _bit(t)).otherwise(none) for t, x in zip(part, inside, strict=True)], others).alias("__may"),
            _total([F.when(x, _bit(t)).otherwise(none) for t, x in zip(part, below, strict=True)], F.col("__mask")).alias("__mask"))
    return rows.select("row_id", "__may", "__mask")


def _decided(marks: DataFrame, group: list[ErrorType], cut: dict[str, str], seed: int) -> DataFrame:
    """``__mask`` with the bits of one level: the sure ones, and those near the cutoffs that are not above."""
    none = F.lit(0).cast("long")
    rows = marks.select("row_id", "__may", _id_text().alias("__id"), "__mask")
    for part in _parts(group):
        bits = [F.when(_any_bit(F.col("__may"), [t.name]) & (_digest(t, seed) <= F.lit(cut[t.name])), _bit(t)).otherwise(none)
                for t in part]
        rows = rows.select("row_id", "__may", "__id", F.explode(F.array(_total(bits, F.col("__mask")))).alias("__mask"))
    return rows.drop("__id")


def _settled(rows: DataFrame, group: list[ErrorType], cut: dict[str, str], seed: int) -> DataFrame:
    """``__mask`` with the bits of one level, from all digests; none of its types blocks another."""
    none = F.lit(0).cast("long")
    others = [F.col(f"`{c}`") for c in rows.columns if c != "__mask"]
    for part in _parts(group):
        bits = [F.when(_free(t) & (_digest(t, seed) <= F.lit(cut[t.name])), _bit(t)).otherwise(none) for t in part]
        rows = rows.select(*others, F.explode(F.array(_total(bits, F.col("__mask")))).alias("__mask"))
    return rows


def select_errors(clean: DataFrame, seed: int = SEED) -> DataFrame:
    """The clean rows with ``__mask``: one bit per type applied to the record. Stored.

    A level computes its digests once: digests are uniform, so an interval can be named that holds the
    cutoff. What is below it is counted, what is in it ranked. Should a cutoff lie outside, its interval
    is widened to all digests.
    """
    none = F.lit(0).cast("long")
    may = sum((F.when(F.expr(t.eligible), F.lit(1 << BIT[t.name]).cast("long")).otherwise(none) for t in TYPES), none)
    marks = materialise(clean.select("row_id", may.alias("__may"), none.alias("__mask")), "marks")

    def counted(done: list[ErrorType], ahead: list[ErrorType]):
        """Per type of a level what is sure and near; per type of the next one about how many records may get it."""
        return marks.agg(
            F.count("*").alias("rows"), *[F.count_if(_any_bit(F.col(c), [t.name])).alias(f"{c}{t.name}") for t in done for c in ("__mask", "__may")],
            *[F.count_if(_free(t)).alias(f"__free{t.name}") for t in ahead]).first()

    order = levels()
    seen = counted([], order[0])
    counts = targets(seen["rows"])
    cuts: dict[str, str] = {}
    for level, group in enumerate(order):
        start = marks if level == 0 else _decided(marks, order[level - 1], cuts, seed)
        between = {t.name: _interval(counts[t.name], seen[f"__free{t.name}"]) for t in group}
        while True:
            marks = materialise(_near(start, group, between, seed), "marks")
            seen = counted(group, order[level + 1] if level + 1 < len(order) else [])
            rest = {t.name: counts[t.name] - seen[f"__mask{t.name}"] for t in group}
            missed = [n for n, r in rest.items() if counts[n] and between[n] != ("", "g") and (
                r < 1 or (r > seen[f"__may{n}"] and between[n][1] != "g"))]
            if not missed:
                break
            between |= {n: ("", "g") for n in missed}
        labelled = F.array(*[F.struct(F.lit(t.name).alias("label"), F.when(
            _any_bit(F.col("__may"), [t.name]), order_text(seed, t.name, "row_id")).alias("u")) for t in group])
        near = marks.filter(_any_bit(F.col("__may"), [t.name for t in group])).select(F.inline(labelled)).filter("u IS NOT NULL")
        cuts |= cutoffs(near, rest, {t.name: seen[f"__may{t.name}"] for t in group})
    rows = clean.withColumns({"__may": may, "__id": _id_text(), "__mask": none})
    for group in order:
        rows = _settled(rows, group, cuts, seed)
    return materialise(rows.drop("__may", "__id"), "marked")


def injection_log(marked: DataFrame, duplicates: int | None = None) -> DataFrame:
    """``(rule, dimension, target, success, skipped)`` per type; one pass.

    ``duplicates`` is the number of copies made; with it the log has a line for them.
    """
    copied = 0 if duplicates is None else duplicates
    types = [*TYPES, *([] if duplicates is None else [DUPLICATE])]
    rows = marked.agg(F.count("*").alias("rows"), F.array(*[
        F.struct(F.lit(t.name).alias("rule"), F.lit(t.dimension).alias("dimension"),
                 F.lit(t.share).alias("share"),
                 (F.coalesce(F.max(F.lit(copied)), F.lit(copied)).cast("long") if t is DUPLICATE else
                  F.count_if(_any_bit(F.col("__mask"), [t.name]))).alias("success"))
        for t in types]).alias("types"))
    target = F.when(F.col("t.rule") == SHORT["P3"], F.lit(1)).otherwise(
        F.bround(F.col("t.share") * F.col("rows"), 0).cast("long"))
    return rows.select("rows", F.explode("types").alias("t")).select(
        F.col("t.rule").alias("rule"), F.col("t.dimension").alias("dimension"),
        target.cast("long").alias("target"), F.col("t.success").alias("success"),
        (target - F.col("t.success")).cast("long").alias("skipped"))


def near_duplicate_address(address: Column) -> Column:
    """A cleaned-up spelling of the address, or the address with a suffix if nothing changes."""
    s = F.translate(F.regexp_replace(address, ",", ""), "-", " ")
    s = F.regexp_replace(s, r"(?i)\bRoad\b", "Rd")
    s = F.regexp_replace(s, r"(?i)\bStreet\b", "St")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s == address, F.concat(address, F.lit(" Ltd."))).otherwise(s)


@dataclass(frozen=True)
class Places:
    """Postcodes and cities by district, for the mismatches X6 and X7."""

    postcodes: dict[str, list[str]] = field(default_factory=dict)
    cities: dict[str, str] = field(default_factory=dict)


def _other(values_by_district: dict[str, list[str]], u: Column, unchanged: Column) -> Column:
    """A value of another district; the old one where no other district is known."""
    every = sorted(v for vs in values_by_district.values() for v in vs)
    out = F.lit(None).cast("string")
    for d, own in values_by_district.items():
        rest = [v for v in every if v not in own]
        if rest:
            out = F.when(F.col("district") == d, pick(rest, u)).otherwise(out)
    known = F.col("district").isin(list(values_by_district))
    return F.coalesce(F.when(known, out), pick(every, u) if every else None, unchanged) \
        if every else unchanged


#: Donors in a block of digests, at least half and at most twice as many on average.
DONORS_PER_BLOCK = 48


def _block(u: str, blocks: int) -> Column:
    return F.conv(F.substring(u, 1, 8), 16, 10).cast("long") % F.lit(blocks)


def borrow(marked: DataFrame, label: str, columns: list[str], where: Column, seed: int = SEED) -> DataFrame:
    """``(row_id, given)``: for every record picked for ``label`` the ``columns`` of its donor.

    Donors are the other records where ``where`` holds. A receiver meets those of its block and
    takes the one with the smallest combined digest; if its block has none, the donor with the
    smallest digest of all. Without any donor ``given`` is NULL.
    """
    given = F.struct(*columns)
    pool = marked.filter(where & ~has(label)).select(
        given.alias("given"), order_text(seed, f"{label}-donor", "row_id").alias("du"))
    spare = pool.agg(F.count("*").alias("n"), F.min_by("given", "du").alias("given")).first()
    blocks = 1 << max(0, (spare["n"] // DONORS_PER_BLOCK).bit_length() - 1)
    mine = marked.filter(has(label)).select(
        "row_id", order_text(seed, f"{label}-receiver", "row_id").alias("ru"))
    # the donors are most of the portfolio: never broadcast, however small their few columns look in a file
    best = mine.withColumn("block", _block("ru", blocks)).join(
        pool.withColumn("block", _block("du", blocks)).hint("merge"), "block", "left").groupBy("row_id").agg(
        F.min_by("given", F.md5(F.concat("ru", "du"))).alias("given"))
    rest = F.lit(None) if spare["given"] is None else F.struct(*[
        F.lit(spare["given"][c]).cast(marked.schema[c].dataType).alias(c) for c in columns])
    return best.withColumn("given", F.coalesce("given", rest.cast(best.schema["given"].dataType)))


MOVED = ["C1", "V3", "G1", "G2", "G3", "G4", "G5"]
BORROWERS = ["G5", "D2", "D4"]


def _borrowed(marked: DataFrame, seed: int) -> DataFrame:
    """``(row_id, new_latitude, new_longitude, new_location)`` for G5, D2 and D4."""
    located = F.expr(_LOCATED)
    u = order_text(seed, "G5-anchor", "row_id")
    anchors = marked.filter(located).select("latitude", "longitude", u.alias("u")).orderBy("u").limit(
        ANCHORS).collect()
    points = F.array(*[F.struct(F.lit(a["latitude"]).alias("lat"), F.lit(a["longitude"]).alias("lon"))
                       for a in anchors])
    snapped = hash_ranks(
        marked.filter(has("G5")).select(
            "row_id", order_text(seed, SHORT["G5"], "row_id").alias("u")), "u", "place")
    spot = F.element_at(points, (F.col("place") % max(len(anchors), 1) + 1).cast("int"))
    nothing, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = snapped.select("row_id", spot.getField("lat").alias("new_latitude"),
                           spot.getField("lon").alias("new_longitude"), nothing.alias("new_location"))
    still = ~_any_bit(F.col("__mask"), [SHORT[s] for s in MOVED])
    shared = borrow(marked, "D2", ["latitude", "longitude"], still & located & F.col("location_id").isNotNull(), seed)
    parts = parts.unionByName(shared.select(
        "row_id", F.col("given.latitude").alias("new_latitude"),
        F.col("given.longitude").alias("new_longitude"), nothing.alias("new_location")))
    named = borrow(marked, "D4", ["location_id"], F.col("location_id").isNotNull(), seed)
    parts = parts.unionByName(named.select(
        "row_id", zero.alias("new_latitude"), zero.alias("new_longitude"),
        F.col("given.location_id").alias("new_location")))
    return parts.groupBy("row_id").agg(*[
        F.max(c).alias(c) for c in ("new_latitude", "new_longitude", "new_location")])


def _value_factor(share_total: Column) -> Column:
    """Factor on all value components: unit error, round total, dominant record, conflict."""
    t = F.col("tiv_total")
    return (
        F.when(has("P1"), F.lit(1000.0))
        .when(has("P2") & (t > 0), F.lit(10_000_000.0) / t)
        .when(has("P3") & (t > 0), (0.35 / 0.65) * (share_total - t) / t)
        .when(has("D4"), F.lit(1.15))
    )


def apply_errors(marked: DataFrame, places: Places, seed: int = SEED) -> DataFrame:
    """The corrupted rows (``__mask`` kept). Every field is changed by at most one type,
    so all edits are one projection over the clean values."""
    c = F.col
    t = c("tiv_total")
    settled = (
        F.when(has("V1"), -F.abs(t)).when(has("X3"), F.lit(800_000_000.0))
        .when(has("P1"), t * 1000).when(has("P2") & (t > 0), F.lit(10_000_000.0)).otherwise(t))
    share_total = F.lit(float(marked.agg(F.sum(money(settled)).alias("s")).first()["s"] or 0))

    def u(label: str) -> Column:
        return order_text(seed, f"{label}-value", "row_id")

    factor = _value_factor(share_total)
    parts = {n: c(n) * factor for n in ("tiv_building", "tiv_contents", "tiv_bi")}
    scaled = factor.isNotNull()
    edits = {
        "latitude": F.when(has("C1"), None).when(has("V3"), F.lit(190.5)).when(has("G1"), F.lit(19.0))
        .when(has("G2"), c("longitude")).when(has("G3"), F.lit(0.0)).when(has("G4"), F.lit(51.5))
        .when(has("G5") | has("D2"), F.coalesce("new_latitude", "latitude")).otherwise(c("latitude")),
        "longitude": F.when(has("C1"), None).when(has("G1"), F.lit(86.8))
        .when(has("G2"), c("latitude")).when(has("G3"), F.lit(0.0)).when(has("G4"), F.lit(-0.1))
        .when(has("G5") | has("D2"), F.coalesce("new_longitude", "longitude")).otherwise(c("longitude")),
        "geocode_level": F.when(has("G5"), "POSTCODE").otherwise(c("geocode_level")),
        "construction_code": F.when(has("C2"), None).when(has("X1"), "TIMBER").when(has("X2"), "RCC")
        .when(has("K1"), pick(FREE_TEXT, u("K1"))).when(has("K3"), pick(NUMERIC_CODES, u("K3")))
        .otherwise(c("construction_code")),
        "year_built": F.when(has("C3"), None).when(has("V4"), 2035).when(has("V5"), 1750)
        .when(has("X2"), 1880).when(has("P4"), 1900).otherwise(c("year_built")),
        "num_storeys": F.when(has("C4"), None).when(has("V6"), 0)
        .when(has("X1"), 15 + F.conv(F.substring(u("X1"), 1, 7), 16, 10).cast("int") % 16)
        .when(has("X4"), 25).when(has("P5"), 1).otherwise(c("num_storeys")),
        "occupancy_code": F.when(has("C7"), None).when(has("X3"), "RES").when(has("X4"), "IND")
        .when(has("K2"), pick(UNKNOWN_OCCUPANCY, u("K2"))).otherwise(c("occupancy_code")),
        "floor_area_sqm": F.when(
            has("X5"),
            F.when(has("V2"), F.lit(0.0)).when(has("X3"), F.lit(800_000_000.0))
            .otherwise(c("tiv_building")) / 3_000_000.0).otherwise(c("floor_area_sqm")),
        "tiv_building": F.when(has("V2"), F.lit(0.0)).when(has("X3"), F.lit(800_000_000.0))
        .when(scaled, parts["tiv_building"]).otherwise(c("tiv_building")),
        "tiv_contents": F.when(has("C5"), None).when(has("X3"), F.lit(0.0))
        .when(scaled, parts["tiv_contents"]).otherwise(c("tiv_contents")),
        "tiv_bi": F.when(has("X3"), F.lit(0.0)).when(scaled, parts["tiv_bi"]).otherwise(c("tiv_bi")),
        "tiv_total": F.when(has("V1"), -F.abs(t)).when(has("X3"), F.lit(800_000_000.0))
        .when(scaled, parts["tiv_building"] + parts["tiv_contents"] + parts["tiv_bi"]).otherwise(t),
        "deductible": F.when(has("C6"), None)
        .when(has("V7"), F.when(~has("V1") & (t > 0), t).otherwise(F.lit(1_000_000.0)) * 5)
        .otherwise(c("deductible")),
        "postcode": F.when(has("X6"), _other(places.postcodes, u("X6"), c("postcode")))
        .otherwise(c("postcode")),
        "city": F.when(has("X7"), _other({d: [v] for d, v in places.cities.items()}, u("X7"), c("city")))
        .otherwise(c("city")),
        "currency": F.when(has("K4"), pick(CURRENCIES, u("K4"))).otherwise(c("currency")),
        "address_line": F.when(has("D3"), near_duplicate_address(c("address_line")))
        .otherwise(c("address_line")),
        "location_id": F.when(has("D4"), F.coalesce("new_location", "location_id")).otherwise(c("location_id")),
    }
    # only records that borrow something are joined, all others stay where they are
    borrows = _any_bit(c("__mask"), [SHORT[b] for b in BORROWERS])
    new = _borrowed(marked, seed)
    joined = marked.filter(borrows).join(new, "row_id", "left").unionByName(
        marked.filter(~borrows).select("*", *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema if f.name != "row_id"]))
    types = dict(marked.dtypes)
    return joined.select(*[
        edits[n].cast(types[n]).alias(n) if n in edits else c(n) for n in marked.columns])


def duplicate_rows(dirty: DataFrame, seed: int = SEED) -> DataFrame:
    """Copies (D1) of records that carry an error: new ``row_id`` and ``source_row_id``."""
    shape = dirty.agg(F.count("*").alias("n"), F.max("row_id").alias("top")).first()
    wanted = targets(shape["n"])[DUPLICATE.name]
    u = order_text(seed, DUPLICATE.name, "row_id")
    pool = dirty.filter("__mask <> 0").withColumn("u", u)
    cut = cutoffs(pool.select(F.lit("D1").alias("label"), "u"), {"D1": wanted})["D1"]
    ranked = hash_ranks(pool.filter(F.col("u") <= F.lit(cut)), "u", "place")
    return ranked.withColumn("source_row_id", F.col("row_id")).withColumn(
        "row_id", (F.lit(shape["top"]) + F.col("place")).cast("long")).drop("u", "place")


def ground_truth(clean: DataFrame, dirty: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per event with the fields before and after as JSON. Copies inherit the
    events of their source and add their own."""
    fields = sorted({f for t in TYPES for f in (t.shown or t.fields)})
    kinds_of = dict(clean.dtypes)

    def shown(row: str, f: str) -> Column:
        """Numbers with a fixed number of decimals, so that no engine's way of printing doubles matters."""
        value = F.col(f"{row}.{f}")
        if kinds_of[f] != "double":
            return value.cast("string")
        if f in DECIMALS:
            return fixed(value, DECIMALS[f])
        return F.when(F.abs(value) >= LARGE, fixed(value, LARGE_DECIMALS)).otherwise(fixed(value, MONEY_DECIMALS))

    def snapshot(row: str) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(f) for f in fields]), F.array(*[shown(row, f) for f in fields]))

    # the join is of fields as they are stored, printed after it; both sides are as long as the
    # portfolio, so neither may be broadcast by the size that its file has
    before = clean.select("row_id", F.struct(*fields).alias("before"))
    after = dirty.filter("__mask <> 0").select("row_id", "__mask", F.struct(*fields).alias("after"))
    copied = copies.groupBy(F.col("source_row_id").alias("row_id")).agg(F.collect_list(F.col("row_id")).alias("copy_ids"))
    kinds = F.array(*[F.when(_any_bit(F.col("__mask"), [t.name]), F.struct(
        F.lit(t.name).alias("error_type"), F.lit(t.dimension).alias("dimension"),
        F.lit(t.classification).alias("classification"),
        F.array(*[F.lit(f) for f in sorted(t.shown or t.fields)]).alias("fields")))
        for t in TYPES])

    def as_json(m: str) -> Column:
        kept = F.map_from_arrays(F.col("k.fields"), F.transform(
            F.col("k.fields"), lambda f: F.element_at(F.col(m), f)))
        return F.to_json(kept, {"ignoreNullFields": "false"})

    columns = ["row_id", "error_type", "dimension", "classification",
               "original_value", "corrupted_value"]
    events = after.join(before.hint("merge"), "row_id").join(copied.hint("merge"), "row_id", "left").select(
        "row_id", "copy_ids", kinds.alias("kinds"), snapshot("before").alias("before"), snapshot("after").alias("after")
    ).withColumn("k", F.explode("kinds")).filter("k IS NOT NULL").select(
        F.explode(F.concat(F.array("row_id"), F.coalesce("copy_ids", F.array().cast("array<bigint>")))).alias("row_id"),
        "k.error_type", "k.dimension", "k.classification",
        as_json("before").alias("original_value"), as_json("after").alias("corrupted_value"))
    own = copies.select(
        "row_id", F.lit(DUPLICATE.name).alias("error_type"),
        F.lit(DUPLICATE.dimension).alias("dimension"),
        F.lit(DUPLICATE.classification).alias("classification"),
        F.to_json(F.struct("source_row_id")).alias("original_value"),
        F.to_json(F.struct(F.col("row_id").alias("duplicated_row_id"))).alias("corrupted_value"))
    return events.unionByName(own).select(*columns)
