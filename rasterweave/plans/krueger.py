"""DuckDB text of the UTM projection, for checks only."""

# fixed values of the WGS 84 ellipsoid, its Krueger series and the UTM grid, apart from the code under check
ECCENTRICITY = 0.0818191908426215
RECTIFYING_RADIUS = 6367449.145823415
KRUEGER = (8.377318206244698e-04, 7.608527773572307e-07, 1.197645503329453e-09, 2.429170607201359e-12, 5.711757677865804e-15, 1.491117731258390e-17)
UTM_SCALE, UTM_EASTING, UTM_SOUTH = 0.9996, 500000.0, 10000000.0
# sine of the largest angle from the central meridian that is projected
UTM_SINE = 0.989526360736194


def _sphere(lon: str, lat: str, epsg: str) -> tuple[str, str]:
    """Tangent of the conformal latitude and angle from the central meridian."""
    phi, ecc = f"radians(({lat})::DOUBLE)", f"{ECCENTRICITY!r}::DOUBLE"
    return f"sinh(atanh(sin({phi})) - {ecc} * atanh({ecc} * sin({phi})))", f"radians(({lon})::DOUBLE - ((({epsg}) % 100) * 6 - 183))"


def within_sql(lon: str, lat: str, epsg: str) -> str:
    """Whether a zone can show a position."""
    t, lam = _sphere(lon, lat, epsg)
    return f"abs(sin({lam}) / sqrt(1 + ({t}) * ({t}))) <= {UTM_SINE!r}::DOUBLE"


def utm_sql(lon: str, lat: str, epsg: str) -> str:
    """Two select items ``e`` and ``n`` projecting a position given as SQL expressions."""
    t, lam = _sphere(lon, lat, epsg)
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1 + ({t}) * ({t})))"
    east = " + ".join(
        [eta, *(f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(KRUEGER, 1))]
    )
    north = " + ".join(
        [xi, *(f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(KRUEGER, 1))]
    )
    scale = f"{UTM_SCALE * RECTIFYING_RADIUS!r}::DOUBLE"
    south = f"CASE WHEN ({epsg}) // 100 = 327 THEN {UTM_SOUTH} ELSE 0 END"
    return f"{UTM_EASTING} + {scale} * ({east}) AS e, {south} + {scale} * ({north}) AS n"
