"""Words matched to reference names on a ladder: equal, near and concentrated, part of a name and concentrated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.functions import text
from caravel.operators import dedup

#: Kinds of names, in the order in which equally good ones count.
KINDS = ("municipio", "departamento", "provincia", "waypoint")


def normal_name(name) -> Column:
    """Lower case without accents, spaces collapsed."""
    return text.compact(text.folded(F.trim(F.col(name) if isinstance(name, str) else name)))


def token_holders(tags: DataFrame, names: DataFrame) -> DataFrame:
    """JN18. Pairs (norm, name_norm): names of several words that hold all words of a tag.

    Prefix filter: all words of a tag are in the name, so its rarest is. Words of names are an index with their
    frequency; a tag meets only the names of its rarest word, and one that isn't in the index none.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.col(c), " "), lambda w: w != ""))
    index = names.select(F.col("norm").alias("name_norm")).distinct().withColumn("w", F.explode(words("name_norm"))).where(F.size(words("name_norm")) > 1)
    often = index.groupBy("w").agg(F.count("*").alias("held"))
    asked = tags.select("norm").distinct().withColumn("all", words("norm")).withColumn("w", F.explode("all"))
    rarest = asked.join(often, "w").groupBy("norm", "all").agg(F.min(F.struct("held", "w")).alias("r"), F.count("*").alias("known")).where(F.col("known") == F.size("all"))
    return rarest.select("norm", F.col("r.w").alias("w")).join(index, "w").where(text.is_token_subset("norm", "name_norm")).select("norm", "name_norm")


def ladder(tags: DataFrame, names: DataFrame, common: Sequence[str] = (), distance: int = 2) -> tuple[DataFrame, DataFrame]:
    """JN18. (matches, near misses) of ``tags`` (tag, provinces) with ``names`` (name, kind, provinces).

    matches: (tag, step, name, kind, distance), one row at most for each tag: ``A`` equal normal forms; else ``B`` the nearest within ``distance`` whose provinces hold the
    tag's only one; else ``C`` a name of several words that holds all of the tag's, under the same rule, with its number of words.
    Of equally good names the kind that comes first counts, then the name. Tags under three characters or in ``common`` match
    nothing. near misses: (tag, name, kind, distance, reason) of tags without a match that are within the distance of a name. Names meet tags by unchanged pieces and by their
    rarest word, never all with all.
    """
    own = tags.select("tag", F.col("provinces").alias("tag_provinces"), normal_name("tag").alias("norm"))
    known = names.select("name", "kind", "provinces", normal_name("name").alias("norm"))
    is_common = F.col("norm").isin(*common) if common else F.lit(False)
    asked = own.where(F.length("norm") >= 3)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    concentrated = text.is_concentrated(F.col("tag_provinces"), F.col("provinces"))
    officials = known.withColumnRenamed("norm", "name_norm")
    near = dedup.similar_names(asked, known, "norm", "norm", distance).select(F.col("a").alias("norm"), F.col("b").alias("name_norm"), "distance")
    near = asked.join(near, "norm").join(officials, "name_norm").withColumn("concentrated", concentrated)
    part = asked.join(token_holders(asked, known), "norm").join(officials, "name_norm").withColumn("concentrated", concentrated)
    words = F.size(F.split("name_norm", " "))
    steps = near.where((F.col("distance") == 0) | F.col("concentrated")).select("tag", is_common.alias("common"), F.when(F.col("distance") == 0, "A").otherwise("B").alias("step"), "distance", place.alias("place"), "name", "kind", F.lit(0).alias("words"))
    steps = steps.unionByName(part.where("concentrated").select("tag", is_common.alias("common"), F.lit("C").alias("step"), F.lit(0).alias("distance"), place.alias("place"), "name", "kind", words.alias("words")))
    best = steps.where("not common").groupBy("tag").agg(F.min(F.struct("step", "distance", "place", "name", "kind", "words")).alias("m"))
    matches = best.select("tag", "m.step", "m.name", "m.kind", F.when(F.col("m.step") == "C", F.col("m.words")).otherwise(F.col("m.distance")).alias("distance"))
    nearest = near.groupBy("tag", is_common.alias("common")).agg(F.min(F.struct("distance", place.alias("place"), "name", "kind", "concentrated")).alias("m"))
    missed = nearest.join(matches.select("tag"), "tag", "left_anti")
    reason = F.concat_ws(" + ", F.when(F.col("common"), "comun"), F.when(~F.col("m.concentrated"), "no concentrada"))
    return matches, missed.select("tag", "m.name", "m.kind", "m.distance", reason.alias("reason")).where("reason <> ''")


def synonym_report(tags: DataFrame, names: DataFrame, common: Sequence[str] = (), synonyms: dict[str, str] | None = None) -> DataFrame:
    """QRY16. (section, tag, n, name, kind, distance, note) of ``tags`` (tag, n, provinces).

    Sections: exactos (these are verified names), cercanos, token-subset, excluidos (near a name, but common or not concentrated), ambiguos (part of a province's name, for
    a person to decide) and propuesta (near ones and parts that are no province and not among ``synonyms``, variant to canonical: ``name`` is the canonical form).
    """
    matches, missed = ladder(tags, names, common)
    section = F.when(F.col("step") == "A", "exactos").when(F.col("step") == "B", "cercanos").otherwise("token-subset")
    found = matches.join(tags.select("tag", "n"), "tag")
    cells = ["section", "tag", "n", "name", "kind", "distance", "note"]
    listed = found.withColumn("section", section).withColumn("note", F.lit(""))
    ambiguous = found.where("step = 'C' and kind = 'provincia'").withColumn("section", F.lit("ambiguos")).withColumn("note", F.lit(""))
    taken = [x.lower() for kv in (synonyms or {}).items() for x in kv]
    free = ~(F.lower("tag").isin(*taken) | F.lower("name").isin(*taken)) if taken else F.lit(True)
    proposed = found.where((F.col("step") != "A") & (F.col("kind") != "provincia") & free).withColumn("section", F.lit("propuesta")).withColumn("name", F.lower("name")).withColumn("note", F.lit(""))
    excluded = missed.join(tags.select("tag", "n"), "tag").withColumn("section", F.lit("excluidos")).withColumnRenamed("reason", "note")
    out = listed.select(cells)
    for more in (ambiguous, proposed, excluded):
        out = out.unionByName(more.select(cells))
    return out
