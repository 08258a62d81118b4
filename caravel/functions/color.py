"""Colours: hex and rgb, perceptual distance, nearest name of a palette."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 147 CSS colour keywords and their codes.
CSS = {
    "aliceblue": "#f0f8ff", "antiquewhite": "#faebd7", "aqua": "#00ffff", "aquamarine": "#7fffd4", "azure": "#f0ffff", "beige": "#f5f5dc",
    "bisque": "#ffe4c4", "black": "#000000", "blanchedalmond": "#ffebcd", "blue": "#0000ff", "blueviolet": "#8a2be2", "brown": "#a52a2a",
    "burlywood": "#deb887", "cadetblue": "#5f9ea0", "chartreuse": "#7fff00", "chocolate": "#d2691e", "coral": "#ff7f50", "cornflowerblue": "#6495ed",
    "cornsilk": "#fff8dc", "crimson": "#dc143c", "cyan": "#00ffff", "darkblue": "#00008b", "darkcyan": "#008b8b", "darkgoldenrod": "#b8860b",
    "darkgray": "#a9a9a9", "darkgreen": "#006400", "darkgrey": "#a9a9a9", "darkkhaki": "#bdb76b", "darkmagenta": "#8b008b",
    "darkolivegreen": "#556b2f", "darkorange": "#ff8c00", "darkorchid": "#9932cc", "darkred": "#8b0000", "darksalmon": "#e9967a",
    "darkseagreen": "#8fbc8f", "darkslateblue": "#483d8b", "darkslategray": "#2f4f4f", "darkslategrey": "#2f4f4f", "darkturquoise": "#00ced1",
    "darkviolet": "#9400d3", "deeppink": "#ff1493", "deepskyblue": "#00bfff", "dimgray": "#696969", "dimgrey": "#696969", "dodgerblue": "#1e90ff",
    "firebrick": "#b22222", "floralwhite": "#fffaf0", "forestgreen": "#228b22", "fuchsia": "#ff00ff", "gainsboro": "#dcdcdc", "ghostwhite": "#f8f8ff",
    "gold": "#ffd700", "goldenrod": "#daa520", "gray": "#808080", "green": "#008000", "greenyellow": "#adff2f", "grey": "#808080",
    "honeydew": "#f0fff0", "hotpink": "#ff69b4", "indianred": "#cd5c5c", "indigo": "#4b0082", "ivory": "#fffff0", "khaki": "#f0e68c",
    "lavender": "#e6e6fa", "lavenderblush": "#fff0f5", "lawngreen": "#7cfc00", "lemonchiffon": "#fffacd", "lightblue": "#add8e6",
    "lightcoral": "#f08080", "lightcyan": "#e0ffff", "lightgoldenrodyellow": "#fafad2", "lightgray": "#d3d3d3", "lightgreen": "#90ee90",
    "lightgrey": "#d3d3d3", "lightpink": "#ffb6c1", "lightsalmon": "#ffa07a", "lightseagreen": "#20b2aa", "lightskyblue": "#87cefa",
    "lightslategray": "#778899", "lightslategrey": "#778899", "lightsteelblue": "#b0c4de", "lightyellow": "#ffffe0", "lime": "#00ff00",
    "limegreen": "#32cd32", "linen": "#faf0e6", "magenta": "#ff00ff", "maroon": "#800000", "mediumaquamarine": "#66cdaa", "mediumblue": "#0000cd",
    "mediumorchid": "#ba55d3", "mediumpurple": "#9370db", "mediumseagreen": "#3cb371", "mediumslateblue": "#7b68ee", "mediumspringgreen": "#00fa9a",
    "mediumturquoise": "#48d1cc", "mediumvioletred": "#c71585", "midnightblue": "#191970", "mintcream": "#f5fffa", "mistyrose": "#ffe4e1",
    "moccasin": "#ffe4b5", "navajowhite": "#ffdead", "navy": "#000080", "oldlace": "#fdf5e6", "olive": "#808000", "olivedrab": "#6b8e23",
    "orange": "#ffa500", "orangered": "#ff4500", "orchid": "#da70d6", "palegoldenrod": "#eee8aa", "palegreen": "#98fb98", "paleturquoise": "#afeeee",
    "palevioletred": "#db7093", "papayawhip": "#ffefd5", "peachpuff": "#ffdab9", "peru": "#cd853f", "pink": "#ffc0cb", "plum": "#dda0dd",
    "powderblue": "#b0e0e6", "purple": "#800080", "red": "#ff0000", "rosybrown": "#bc8f8f", "royalblue": "#4169e1", "saddlebrown": "#8b4513",
    "salmon": "#fa8072", "sandybrown": "#f4a460", "seagreen": "#2e8b57", "seashell": "#fff5ee", "sienna": "#a0522d", "silver": "#c0c0c0",
    "skyblue": "#87ceeb", "slateblue": "#6a5acd", "slategray": "#708090", "slategrey": "#708090", "snow": "#fffafa", "springgreen": "#00ff7f",
    "steelblue": "#4682b4", "tan": "#d2b48c", "teal": "#008080", "thistle": "#d8bfd8", "tomato": "#ff6347", "turquoise": "#40e0d0",
    "violet": "#ee82ee", "wheat": "#f5deb3", "white": "#ffffff", "whitesmoke": "#f5f5f5", "yellow": "#ffff00", "yellowgreen": "#9acd32",
}
#: Keywords that count as white, grey or black.
NO_COLOR = (
    "antiquewhite", "beige", "black", "darkgray", "darkgrey", "darkslategray", "darkslategrey", "dimgray", "dimgrey", "floralwhite", "gainsboro", "gray", "grey", "honeydew", "ivory",
    "lightgray", "lightgrey", "lightslategray", "lightslategrey", "linen", "mintcream", "oldlace", "seashell", "silver", "slategray", "slategrey", "snow", "white", "whitesmoke",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rgb(code) -> Column:
    """Struct r, g, b of ``#rrggbb``; nulls if it isn't one."""
    c = F.regexp_extract(F.lower(_c(code)), "^#([0-9a-f]{6})$", 1)
    part = lambda i: F.conv(F.nullif(F.substring(c, i, 2), F.lit("")), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def redmean(a: Column, b: Column) -> Column:
    """Weighted distance of two rgb structs."""
    mean = (a["r"] + b["r"]) / 2
    dr, dg, db = a["r"] - b["r"], a["g"] - b["g"], a["b"] - b["b"]
    return F.sqrt((2 + mean / 256) * dr * dr + 4 * dg * dg + (2 + (255 - mean) / 256) * db * db)


def nearest_name(code, palette: dict[str, str] | None = None, factor: float = 1.5) -> Column:
    """M9. Name of the nearest palette colour; of equally near ones the first by name. If that is no colour (white, grey, black), the
    nearest real colour is taken instead where it is less than ``factor`` times as far. Null for what is no code.

    The palette is a constant of the plan; distances to all of it are array operations over a batch of rows, and no join.
    """
    table = palette or CSS
    names = np.array(sorted(table))
    points = np.array([[int(table[n][i : i + 2], 16) for i in (1, 3, 5)] for n in names], float)
    plain = np.isin(names, NO_COLOR)

    @F.arrow_udf(T.StringType())
    def nearest(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
        known = r.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(r), None, object)
        places = np.flatnonzero(known)
        for at in range(0, len(places), 4096):
            rows = places[at : at + 4096]
            own = np.column_stack([c.take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in (r, g, b)]).astype(float)
            d = own[:, None, :] - points[None, :, :]
            mean = (own[:, None, 0] + points[None, :, 0]) / 2
            far = np.sqrt((2 + mean / 256) * d[..., 0] ** 2 + 4 * d[..., 1] ** 2 + (2 + (255 - mean) / 256) * d[..., 2] ** 2)
            best = far.argmin(axis=1)
            if not plain.all():
                colored = np.where(plain, np.inf, far)
                real = colored.argmin(axis=1)
                k = np.arange(len(rows))
                best = np.where(plain[best] & (colored[k, real] < far[k, best] * factor), real, best)
            out[rows] = names[best]
        return pa.array(out, pa.string())

    own = rgb(code)
    return nearest(own["r"], own["g"], own["b"])


def dominant(cells: DataFrame, item: str, top: int = 3) -> DataFrame:
    """M10, JOB5. (item, hex, score, rank): the ``top`` colours of an image from (item, hex, share, centrality) grid rows.

    A cell counts with its share, more in the middle; colours that are near grey count a third.
    """
    c = rgb("hex")
    spread = F.greatest(c["r"], c["g"], c["b"]) - F.least(c["r"], c["g"], c["b"])
    weight = F.col("share") * (1 + F.col("centrality")) * F.when(spread < 20, 1 / 3).otherwise(1.0)
    sums = cells.groupBy(item, "hex").agg(F.sum(weight).alias("score"))
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("hex"))), asc=False), 1, top)
    return sums.groupBy(item).agg(best.alias("b")).select(item, F.posexplode("b").alias("rank", "x")).select(item, "x.hex", "x.score", (F.col("rank") + 1).alias("rank"))


def lerp(low: Column, high: Column, share: Column) -> Column:
    """M19. Rounded mix of two rgb structs."""
    return F.struct(*[F.floor(low[c] + (high[c] - low[c]) * share + 0.5).cast("int").alias(c) for c in ("r", "g", "b")])


def of_hour(hour, palette: list[tuple[int, int, int]]) -> Column:
    """M19. The colour of an hour between those of the whole hours before and behind it (24 colours); any hour wraps."""
    h = F.pmod(_c(hour).cast("double"), F.lit(24.0))
    fixed = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for r, g, b in palette])
    i = F.floor(h).cast("int")
    return lerp(F.get(fixed, i), F.get(fixed, F.pmod(i + 1, F.lit(24))), h - i)
