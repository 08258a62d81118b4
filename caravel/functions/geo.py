"""Distances, bearings and positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres; null if any coordinate is."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    # least() would turn an unknown into 1
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def gradient_pct(rise, metres) -> Column:
    """Rise over run in percent: 0 on the spot with a known rise, null where either is unknown."""
    r, m = _c(rise), _c(metres)
    return F.when(r.isNull() | m.isNull(), None).when(m == 0, 0.0).otherwise(r / m * 100)


def gradient_band(pct) -> Column:
    """Named steepness of a gradient."""
    p = _c(pct)
    return F.when(p.isNull(), "unknown").when(p < -6, "steep down").when(p < -2, "down").when(p <= 2, "flat").when(p <= 6, "up").otherwise("steep up")


def sign_fixed(value, low: float, high: float) -> Column:
    """A coordinate with its sign turned where only the turned one lies in [low, high]."""
    v = _c(value)
    return F.when(~v.between(low, high) & (-v).between(low, high), -v).otherwise(v)


def dms(text) -> Column:
    """M6. Decimal degrees of ``d m s H`` or plain decimal text, negative for S and W, 7 decimals; null if unreadable."""
    t = _c(text)
    number = lambda i: F.expr("try_cast(NULL as double)") if i is None else F.regexp_extract(t, r"(\d+(?:\.\d+)?)\D+?(\d+(?:\.\d+)?)\D+?(\d+(?:\.\d+)?)", i).try_cast("double")
    sexagesimal = number(1) + number(2) / 60 + number(3) / 3600
    plain = F.regexp_extract(t, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    south = F.upper(t).rlike(r"[SWO]\s*$")
    value = F.coalesce(sexagesimal, plain)
    return F.round(F.when(south, -F.abs(value)).otherwise(value), 7)


def position(text) -> Column:
    """M6. Struct (lat, lon) of two coordinates, parted by a comma or, if there is none, by blanks; null parts where unreadable."""
    t = F.trim(_c(text))
    parts = F.when(t.contains(","), F.split(t, ",", 2)).otherwise(F.split(t, r"\s+"))
    return F.struct(dms(F.trim(F.get(parts, 0))).alias("lat"), dms(F.trim(F.get(parts, 1))).alias("lon"))


#: The sixteen compass points, clockwise from north, in Spanish.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO")


def wind_point(degrees) -> Column:
    """M8. Compass point of a wind direction whose fraction is cut off; ``desconocida`` for null."""
    names = F.array(*[F.lit(x) for x in COMPASS])
    whole = F.pmod(_c(degrees).cast("long"), F.lit(360))
    return F.when(_c(degrees).isNull(), "desconocida").otherwise(F.get(names, F.pmod(F.floor(whole / 22.5 + 0.5), F.lit(16)).cast("int")))


#: WMO weather codes and their names in Spanish.
WMO = {
    0: "despejado", 1: "mayormente despejado", 2: "parcialmente nublado", 3: "nublado", 45: "niebla", 48: "niebla con escarcha",
    51: "llovizna ligera", 53: "llovizna moderada", 55: "llovizna densa", 56: "llovizna helada", 57: "llovizna helada densa",
    61: "lluvia ligera", 63: "lluvia moderada", 65: "lluvia intensa", 66: "lluvia helada ligera", 67: "lluvia helada intensa",
    71: "nieve ligera", 73: "nieve moderada", 75: "nieve intensa", 80: "tormenta ligera", 81: "tormenta moderada", 82: "tormenta intensa",
    95: "tormenta eléctrica", 96: "tormenta con granizo ligero", 99: "tormenta con granizo intenso",
}


def weather_label(code) -> Column:
    """M8. Name of a weather code; ``codigo_n`` for one that has none, ``desconocido`` for null."""
    names = F.create_map(*[x for k, v in WMO.items() for x in (F.lit(k), F.lit(v))])
    return F.when(_c(code).isNull(), "desconocido").otherwise(F.coalesce(F.try_element_at(names, _c(code).cast("int")), F.concat(F.lit("codigo_"), _c(code).cast("string"))))


def cell(lat, lon, decimals: int = 1) -> list[Column]:
    """Rounded coordinates that name a grid cell."""
    return [F.round(_c(lat), decimals), F.round(_c(lon), decimals)]
