"""Sun position and twilight from the public NOAA equations, as column expressions in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON = -0.833


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def julian_day(ts) -> Column:
    return F.unix_micros(_c(ts)) / 86_400_000_000.0 + 2_440_587.5


def _sun(jd: Column) -> dict[str, Column]:
    """Declination (radians) and equation of time (minutes) at a Julian day."""
    t = (jd - 2_451_545.0) / 36_525.0
    mean_long = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    orbit = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    center = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    seen = F.radians(mean_long + center - 0.00569 - 0.00478 * F.sin(node))
    tilt = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60
    tilt = F.radians(tilt + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(seen))
    y = F.pow(F.tan(tilt / 2), 2)
    long_ = F.radians(mean_long)
    minutes = 4 * F.degrees(y * F.sin(2 * long_) - 2 * orbit * F.sin(anomaly) + 4 * orbit * y * F.sin(anomaly) * F.cos(2 * long_) - 0.5 * y * y * F.sin(4 * long_) - 1.25 * orbit * orbit * F.sin(2 * anomaly))
    return {"declination": decl, "minutes": minutes}


def elevation(ts, lat, lon) -> Column:
    """Degrees of the sun's centre above the horizon, without refraction."""
    t, a, o = _c(ts), _c(lat), _c(lon)
    jd = julian_day(t)
    sun = _sun(jd)
    minutes_utc = F.pmod(F.unix_micros(t) / 60_000_000.0, F.lit(1440.0))
    hour_angle = F.pmod(minutes_utc + sun["minutes"] + 4 * o, F.lit(1440.0)) / 4 - 180
    phi = F.radians(a)
    cosine = F.sin(phi) * F.sin(sun["declination"]) + F.cos(phi) * F.cos(sun["declination"]) * F.cos(F.radians(hour_angle))
    return 90 - F.degrees(F.acos(F.when(cosine > 1, 1.0).when(cosine < -1, -1.0).otherwise(cosine)))


def solar_noon_minutes(ts, lon) -> Column:
    """Minutes after 00:00 UTC of the date's solar noon."""
    day = F.date_trunc("day", _c(ts))
    return 720 - 4 * _c(lon) - _sun(julian_day(day) + 0.5)["minutes"]


def rise_set_minutes(ts, lat, lon, rising: bool) -> Column:
    """M3. Minutes after 00:00 UTC of sunrise or sunset; null where the sun doesn't cross the horizon."""
    day, a, o = F.date_trunc("day", _c(ts)), F.radians(_c(lat)), _c(lon)

    def at(jd: Column) -> Column:
        sun = _sun(jd)
        d = sun["declination"]
        cosine = F.cos(F.radians(F.lit(90 - HORIZON))) / (F.cos(a) * F.cos(d)) - F.tan(a) * F.tan(d)
        angle = F.degrees(F.acos(F.when(F.abs(cosine) <= 1, cosine)))
        return 720 - 4 * (o + (angle if rising else -angle)) - sun["minutes"]

    first = at(julian_day(day) + 0.5)
    return F.pmod(at(julian_day(day) + first / 1440), F.lit(1440.0))


def twilight(degrees) -> Column:
    """Name of the light at a sun elevation."""
    e = _c(degrees)
    return F.when(e.isNull(), None).when(e >= 12, "day").when(e >= 6, "low sun").when(e >= 0, "golden").when(e >= -6, "civil").when(e >= -12, "nautical").when(e >= -18, "astronomical").otherwise("night")


def since(ts, lat, lon) -> Column:
    """M5. Struct of seconds since sunrise, to sunset and since noon of the date; null where there is no such event."""
    now = F.pmod(F.unix_micros(_c(ts)) / 1e6, F.lit(86_400.0))
    rise, set_, noon = (x * 60 for x in (rise_set_minutes(ts, lat, lon, True), rise_set_minutes(ts, lat, lon, False), solar_noon_minutes(ts, lon)))
    return F.struct((now - rise).alias("since_sunrise"), (set_ - now).alias("to_sunset"), (now - noon).alias("since_noon"))
