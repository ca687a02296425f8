"""Voyage maths on columns: weather loss, just-in-time speed, carbon intensity and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beaufort number from wind speed in knots (below the bound).
BEAUFORT = [(1, 0), (3, 1), (6, 2), (10, 3), (16, 4), (21, 5), (27, 6), (33, 7), (40, 8), (47, 9), (55, 10), (63, 11)]
# Direction coefficient by angle off the bow, bounds inclusive, first match.
DIRECTION = [(0, 30, 1.7), (30, 60, 1.4), (60, 90, 1.0), (90, 150, 0.7), (150, 180, 0.4)]
# Hull fullness by least block coefficient, and its factor.
HULL = [(0.78, 1.15), (0.65, 1.00), (0.0, 0.85)]
MAX_LOSS_PCT, LEAST_SPEED_KN = 60.0, 0.5
# By ship type Froude number, block coefficient, deadweight ratio, admiralty coefficient.
HULLS = {
    "bulk_carrier": (0.155, 0.82, 0.82, 600.0),
    "oil_tanker": (0.150, 0.83, 0.83, 550.0),
    "chemical_tanker": (0.150, 0.80, 0.80, 500.0),
    "lng_carrier": (0.180, 0.75, 0.55, 500.0),
    "lpg_carrier": (0.170, 0.75, 0.60, 500.0),
    "container": (0.235, 0.62, 0.65, 450.0),
    "general_cargo": (0.200, 0.70, 0.72, 500.0),
    "refrigerated_cargo": (0.215, 0.65, 0.60, 450.0),
    "ro_ro": (0.220, 0.60, 0.45, 400.0),
    "cruise": (0.270, 0.58, 0.25, 350.0),
    "passenger": (0.260, 0.58, 0.30, 350.0),
    "ferry": (0.280, 0.55, 0.35, 350.0),
}
# Names of ship types as registers write them.
TYPE_NAMES = {
    "bulk carrier": "bulk_carrier", "bulker": "bulk_carrier", "oil tanker": "oil_tanker", "crude oil tanker": "oil_tanker", "chemical tanker": "chemical_tanker", "chemical/oil products tanker": "chemical_tanker",
    "lng carrier": "lng_carrier", "lng tanker": "lng_carrier", "lpg carrier": "lpg_carrier", "lpg tanker": "lpg_carrier", "container ship": "container", "container": "container", "containership": "container",
    "general cargo": "general_cargo", "general cargo ship": "general_cargo", "cargo": "general_cargo", "refrigerated cargo carrier": "refrigerated_cargo", "refrigerated cargo": "refrigerated_cargo", "reefer": "refrigerated_cargo",
    "ro-ro": "ro_ro", "ro-ro cargo ship": "ro_ro", "vehicles carrier": "ro_ro", "cruise": "cruise", "cruise ship": "cruise", "passenger ship": "passenger", "passenger": "passenger", "ferry": "ferry",
}
GRAVITY, SEA_WATER, KNOT_MS, WATERLINE = 9.81, 1.025, 0.5144, 0.97
FUEL_G_PER_KWH, CO2_PER_FUEL = 190.0, 3.114
SPEED_LOW, SPEED_HIGH, ANY_LOW, ANY_HIGH = 0.40, 1.20, 4.0, 30.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places`` as SQL engines round doubles: scaled, rounded to whole numbers (halves away from zero), scaled back.
    Spark's own rounding goes by the shortest decimal text, so it takes halves that the scaling makes or unmakes otherwise."""
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def _steps(x: Column, pairs, default) -> Column:
    out = None
    for bound, value in pairs:
        out = F.when(x < bound, F.lit(value)) if out is None else out.when(x < bound, F.lit(value))
    return out.otherwise(F.lit(default))


def beaufort(wind_kn) -> Column:
    w = _col(wind_kn)
    return F.when(w.isNotNull(), _steps(w, BEAUFORT, 12))


def kwon_loss_pct(wind_kn, angle_off_bow, block_coefficient) -> Column:
    """Speed loss in per cent, 0 to 60; no wind known, no loss."""
    angle, cb = _col(angle_off_bow), _col(block_coefficient)
    direction = None
    for low, high, value in DIRECTION:
        test = angle.between(low, high)
        direction = F.when(test, value) if direction is None else direction.when(test, value)
    hull = F.when(cb >= HULL[0][0], HULL[0][1]).when(cb >= HULL[1][0], HULL[1][1]).otherwise(HULL[2][1])
    loss = direction.otherwise(DIRECTION[-1][2]) * hull * F.pow(beaufort(wind_kn).cast("double"), F.lit(1.5))
    return F.when(_col(wind_kn).isNull() | angle.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MAX_LOSS_PCT), loss)))


def ship_type_key(raw) -> Column:
    """A register's type name, or a numeric message code, to a key of ``HULLS``."""
    key = F.lower(F.trim(_col(raw).cast("string")))
    code = F.when(key.rlike(r"^\d+$"), key.try_cast("int"))
    exact = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv]), key)
    partly = None
    for name, value in TYPE_NAMES.items():
        test = F.contains(key, F.lit(name)) | F.contains(F.lit(name), key)
        partly = F.when(test, value) if partly is None else partly.when(test, value)
    by_code = F.when(code.between(60, 69), "passenger").when(code.between(70, 79), "general_cargo").when(code.between(80, 89), "oil_tanker").when(code.between(40, 49), "ferry").otherwise("general_cargo")
    return F.when(code.isNotNull(), by_code).when(key.isNull() | (key == ""), "general_cargo").otherwise(F.coalesce(exact, partly.otherwise("general_cargo")))


def _of_type(key: Column, place: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in HULLS.items() for x in (k, float(v[place]))]), key)


def block_coefficient(key) -> Column:
    return F.coalesce(_of_type(_col(key), 1), F.lit(0.70))


def design_speed_kn(length_m, key) -> Column:
    return rounded(F.coalesce(_of_type(_col(key), 0), F.lit(0.18)) * F.sqrt(GRAVITY * WATERLINE * _col(length_m)) / KNOT_MS, 2)


def displacement_t(length_m, beam_m, draught_m, key) -> Column:
    return block_coefficient(key) * _col(length_m) * _col(beam_m) * _col(draught_m) * SEA_WATER


def deadweight_t(length_m, beam_m, draught_m, key) -> Column:
    return rounded(displacement_t(length_m, beam_m, draught_m, key) * F.coalesce(_of_type(_col(key), 2), F.lit(0.65)), 1)


def carbon_intensity(speed_kn, length_m, beam_m, draught_m, key, distance_nm, eexi=None, dwt=None) -> Column:
    """struct(cii, method, design_speed_kn, dwt_real_t, dwt_estimated_t, co2_kg); null where inputs do not allow it.

    With an efficiency index, cii = eexi (v / v_design)^2 and CO2 follows only from a real deadweight; without, the
    admiralty formula works from the hull's dimensions.
    """
    v, distance = _col(speed_kn), _col(distance_nm)
    index, real = _col(eexi).cast("double"), _col(dwt).cast("double")
    design = design_speed_kn(length_m, key)
    by_index = rounded(index * F.pow(v / design, F.lit(2)), 4)
    estimated = deadweight_t(length_m, beam_m, draught_m, key)
    power = F.pow(displacement_t(length_m, beam_m, draught_m, key), F.lit(2 / 3)) * F.pow(v, F.lit(3)) / F.coalesce(_of_type(_col(key), 3), F.lit(450.0))
    co2 = power * FUEL_G_PER_KWH * (distance / v) / 1000 * CO2_PER_FUEL
    by_hull = F.when(v <= 0, 0.0).when(estimated <= 0, 0.0).otherwise(rounded(co2 * 1000 / (estimated * distance), 4))
    indexed = (index > 0) & (v > 0)
    possible = (distance > 0) & (_col(length_m) > 0) & (indexed | ((_col(beam_m) > 0) & (_col(draught_m) > 0)))
    indexed = F.coalesce(indexed, F.lit(False))
    none = F.lit(None).cast("double")
    return F.when(
        F.coalesce(possible, F.lit(False)),
        F.struct(
            F.when(indexed, by_index).otherwise(by_hull).alias("cii"),
            F.when(indexed, "eexi").otherwise("fallback_admiralty").alias("method"),
            design.alias("design_speed_kn"),
            F.when(indexed, real).otherwise(none).alias("dwt_real_t"),
            F.when(indexed, none).otherwise(estimated).alias("dwt_estimated_t"),
            F.when(indexed, rounded(by_index * real * distance / 1000, 1)).when(v <= 0, 0.0).otherwise(rounded(co2, 1)).alias("co2_kg"),
        ),
    )


def transit_hours(legs, speed_kn) -> Column:
    """Hours over ``legs`` (array of struct(distance_nm, loss_pct)) at a constant engine speed."""
    v = _col(speed_kn)
    return F.aggregate(_col(legs), F.lit(0.0), lambda t, leg: t + leg["distance_nm"] / F.greatest(v * (1 - leg["loss_pct"] / 100), F.lit(LEAST_SPEED_KN)))


def mean_loss_pct(legs) -> Column:
    total = F.aggregate(_col(legs), F.lit(0.0), lambda t, leg: t + leg["distance_nm"])
    lost = F.aggregate(_col(legs), F.lit(0.0), lambda t, leg: t + leg["distance_nm"] * leg["loss_pct"])
    return F.when(total <= 0, 0.0).otherwise(lost / total)


def jit_speed(legs, target_h, design_kn=None, low_kn=None, high_kn=None, tolerance_h: float = 0.05, steps: int = 50) -> Column:
    """The constant engine speed that takes ``target_h`` hours, by bisection within the hull's range.

    struct(speed_kn, transit_h, iterations, converged, outcome, mean_loss_pct, exceeds_design). outcome: 'ok', 'too_short'
    (even the highest speed is late), 'too_long' (even the lowest is early) or 'not_converged'.
    """
    target, design = _col(target_h), _col(design_kn).cast("double")
    given = F.coalesce(design, F.lit(0.0)) != 0
    low = F.coalesce(_col(low_kn).cast("double"), F.when(given, design * SPEED_LOW).otherwise(ANY_LOW))
    high = F.coalesce(_col(high_kn).cast("double"), F.when(given, design * SPEED_HIGH).otherwise(ANY_HIGH))
    fastest, slowest = transit_hours(legs, high), transit_hours(legs, low)
    start = F.struct(low.alias("lo"), high.alias("hi"), ((low + high) / 2).alias("v"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s, i):
        # The midpoint is bound once, as the only element of an array.
        def at(mid):
            t = transit_hours(legs, mid)
            near = F.abs(t - target) <= tolerance_h
            return F.struct(F.when(~near & (t > target), mid).otherwise(s["lo"]).alias("lo"), F.when(~near & (t <= target), mid).otherwise(s["hi"]).alias("hi"), mid.alias("v"), i.alias("n"), near.alias("done"))

        return F.when(s["done"], s).otherwise(F.transform(F.array((s["lo"] + s["hi"]) / 2), at)[0])

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    def shown(speed, transit, n, converged, outcome):
        return F.struct(
            F.round(speed, 2).alias("speed_kn"), F.round(transit, 2).alias("transit_h"), n.cast("int").alias("iterations"), converged.alias("converged"), outcome.alias("outcome"),
            F.round(mean_loss_pct(legs), 1).alias("mean_loss_pct"), F.coalesce(speed > design, F.lit(False)).alias("exceeds_design"),
        )

    return (
        F.when(target <= fastest, shown(high, fastest, F.lit(0), F.lit(False), F.lit("too_short")))
        .when(target >= slowest, shown(low, slowest, F.lit(0), F.lit(False), F.lit("too_long")))
        .when(target.isNotNull(), F.transform(F.array(found), lambda s: shown(s["v"], transit_hours(legs, s["v"]), s["n"], s["done"], F.when(s["done"], "ok").otherwise("not_converged")))[0])
    )


# What a recommendation's own signals say.
def severity(exceeds_design, worse_cii) -> Column:
    return F.when(_col(exceeds_design), "critical").when(_col(worse_cii), "alert").otherwise("ok")


def confidence(method, fuel_saved_t) -> Column:
    return F.when(_col(method) == "fallback_admiralty", "baja").when(_col(fuel_saved_t).isNotNull(), "alta").otherwise("media")


def saturation(converged, speed_delta_kn) -> Column:
    return F.when(_col(converged), "ninguna").when(_col(speed_delta_kn) < 0, "frenando-al-minimo").otherwise("a-maxima-velocidad")


def will_anchor_anyway(converged, speed_delta_kn) -> Column:
    return saturation(converged, speed_delta_kn) == "frenando-al-minimo"


def headline(exceeds_design, worse_cii, converged, speed_delta_kn) -> Column:
    return (
        F.when(_col(exceeds_design), "Necesita más velocidad de la de diseño")
        .when(will_anchor_anyway(converged, speed_delta_kn), "Fondeará igual: solo recorta el consumo")
        .when(_col(worse_cii), "Llega a tiempo, emitiendo más")
        .otherwise("Llega a tiempo emitiendo menos")
    )


def anchoring_breakdown(idle_h, wait_h, transit_h) -> Column:
    """struct(unchanged, recommended, avoided); avoided may be negative where the advice is to speed up."""
    known = _col(idle_h).isNotNull() & _col(wait_h).isNotNull() & _col(transit_h).isNotNull()
    left = F.greatest(F.lit(0.0), _col(wait_h) - _col(transit_h))
    return F.struct(_col(idle_h).alias("unchanged"), F.when(known, left).alias("recommended"), F.when(known, _col(idle_h) - left).alias("avoided"))


def freshness(age_minutes) -> Column:
    m = _col(age_minutes)
    return F.when(m < 40, "fresco").when(m < 300, "atenuado").otherwise("retirado")


# Sea state by wave height in metres (below the bound).
SEA_STATES = [(0.1, "Mar en calma"), (0.5, "Rizada"), (1.25, "Marejada"), (2.5, "Fuerte marejada")]


def sea_state(wave_m) -> Column:
    w = _col(wave_m)
    return F.when(w.isNull(), "Sin dato del modelo").otherwise(_steps(w, SEA_STATES, "Gruesa o más"))


def short_summary(wait_h, speed_kn, now_kn, saving_pct, design_kn, exceeds_design) -> Column:
    """The plain text of a recommendation: one form where carbon intensity falls, another where it rises."""
    wait, fast, now, saving = (_col(x) for x in (wait_h, speed_kn, now_kn, saving_pct))
    text = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    start = F.concat(F.lit("Atraque libre en "), text(wait), F.lit(" h. "))
    good = F.concat(start, F.lit("Velocidad recomendada: "), text(fast), F.lit(" kn (actual: "), text(now), F.lit(" kn). Ahorro de CII estimado: "), text(saving), F.lit("%."))
    over = F.when(_col(exceeds_design), F.concat(F.lit(" Además supera la velocidad de diseño ("), text(_col(design_kn)), F.lit(" kn)."))).otherwise("")
    bad = F.concat(start, F.lit("AVISO: el CII empeora un "), text(F.abs(saving)), F.lit("% con la velocidad recomendada ("), text(fast), F.lit(" kn, actual: "), text(now), F.lit(" kn)."), over)
    return F.when(saving < 0, bad).otherwise(good)
