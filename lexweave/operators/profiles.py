"""Work profiles of tags, co-occurrence context and text rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order, work_bucket, work_priority

#: Quotas of context types, meta types, and bounds of the protocol.
SHOWN_OF_TYPE = {"Fandom": 3, "Character": 3, "Relationship": 2, "Freeform": 4}
DESCRIPTIVE_TYPES = ("Rating", "ArchiveWarning", "Category")
SAMPLE_WORKS, CONTEXT_CAP, MINIMUM_SUPPORT, MINIMUM_WORKS = 32, 24, 2, 3
LENGTH_NAMES = ("short", "medium", "long", "epic")


def length_band(words: str | Column) -> Column:
    """0 to 3 below 5,000, 20,000, 100,000 words and above; unknown stays null."""
    w = F.col(words) if isinstance(words, str) else words
    return F.when(w < 5000, 0).when(w < 20000, 1).when(w < 100000, 2).when(w.isNotNull(), 3)


def assign_works(works: DataFrame, seed: str) -> DataFrame:
    """Works with ``bucket`` and ``priority``."""
    return works.withColumn("bucket", work_bucket(seed, "ordinal")).withColumn("priority", work_priority(seed, "ordinal"))


def visible_context(work_tags: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ordinal, tag_id, type) of a work's catalogue tags of context types: at most the 24 lowest ids of each type."""
    kinds = [*SHOWN_OF_TYPE, *DESCRIPTIVE_TYPES]
    known = catalogue.filter(F.col("type").isin(kinds)).select(F.col("id").alias("tag_id"), "type")
    w = Window.partitionBy("ordinal", "type").orderBy("tag_id")
    return work_tags.select("ordinal", "tag_id").distinct().join(known, "tag_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= CONTEXT_CAP).select("ordinal", "tag_id", "type")


def without_blocked(works: DataFrame, work_tags: DataFrame, blocked: DataFrame) -> DataFrame:
    """Works that hold no blocked tag."""
    bad = work_tags.join(blocked.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("ordinal").distinct()
    return works.join(bad, "ordinal", "left_anti")


def memberships(works: DataFrame, work_tags: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (profile, target, ordinal ...) of works that hold a member tag; members: (tag_id, profile, target)."""
    pairs = work_tags.select("ordinal", "tag_id").join(members, "tag_id").select("profile", "target", "ordinal").distinct()
    return pairs.join(works, "ordinal")


def accumulate(member_works: DataFrame) -> DataFrame:
    """Counts, word sums, length bands and flags of each profile."""
    band = length_band("word_count")
    return member_works.groupBy("profile").agg(
        F.count("*").alias("n"), F.count("word_count").alias("words_n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words_sum"),
        *[F.count_if(band == b).alias(f"band_{b}") for b in range(4)],
        F.count_if(F.col("complete")).alias("complete"), F.count_if(F.col("restricted")).alias("restricted"),
    )


def languages(member_works: DataFrame) -> DataFrame:
    """(profile, languages): map of language to works."""
    one = member_works.groupBy("profile", "language").count()
    return one.groupBy("profile").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "count")))).alias("languages"))


def sample_works(member_works: DataFrame, k: int = SAMPLE_WORKS) -> DataFrame:
    """The ``k`` works of each profile that are lowest by priority, then ordinal."""
    w = Window.partitionBy("profile").orderBy("priority", "ordinal")
    return member_works.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k).select("profile", "target", "ordinal", "place")


def background_counts(support: DataFrame, context: DataFrame) -> DataFrame:
    """Support works whose capped context holds each tag."""
    return context.join(support.select("ordinal"), "ordinal", "left_semi").groupBy("tag_id").agg(F.count("*").alias("background"))


def associated_tags(sample: DataFrame, context: DataFrame, background: DataFrame | None) -> DataFrame:
    """(profile, type, tag_id, works, place): co-occurring tags of the sampled works within the types' quotas.

    Order: more works, then (works + 1) / (background + 10) downwards, then id.
    The cap of a work's context comes before the target leaves it.  Without a
    background, as in reviews, ties go to the id.
    """
    counts = sample.join(context, "ordinal").filter(F.col("tag_id") != F.col("target")).groupBy("profile", "type", "tag_id").agg(F.count("*").alias("works"))
    known = counts.withColumn("background", F.lit(None).cast("bigint")) if background is None else counts.join(background, "tag_id", "left")
    scored = known.withColumn("share", (F.col("works") + 1) / (F.coalesce("background", F.lit(0)) + 10))
    w = Window.partitionBy("profile", "type").orderBy(F.desc("works"), F.desc("share"), "tag_id")
    limit = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in {**SHOWN_OF_TYPE, **dict.fromkeys(DESCRIPTIVE_TYPES, 1)}.items()])
    return scored.filter(F.col("works") >= MINIMUM_SUPPORT).withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit).select("profile", "type", "tag_id", "works", "place")


def one_work(sample: DataFrame, context: DataFrame) -> DataFrame:
    """(profile, type, tag_id, place): the first sampled work's context in id order, within quotas."""
    w = Window.partitionBy("profile", "type").orderBy("tag_id")
    limit = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in SHOWN_OF_TYPE.items()])
    own = sample.filter("place = 1").join(context, "ordinal").filter(F.col("tag_id") != F.col("target"))
    return own.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit).select("profile", "type", "tag_id", "place")


def select_aliases(aliases: DataFrame, blocked: DataFrame, seed: str = "alias-v1", k: int = 5, longest: int = 160) -> DataFrame:
    """At most ``k`` aliases of each canonical in hash order; long and blocked ones are left out first."""
    w = Window.partitionBy("canonical_id").orderBy(hash_order(seed, "id"), "id")
    own = aliases.filter(F.char_length("name") <= longest).join(blocked.select("id"), "id", "left_anti")
    return own.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k).select("canonical_id", "id", "name", "place")


def joined_names(rows: DataFrame, names: DataFrame, by: str, longest: int | None = 160) -> DataFrame:
    """(profile, by, names): names of tags in order of place, long ones left out after the quota."""
    n = names.select(F.col("id").alias("tag_id"), "name")
    j = rows.join(n, "tag_id")
    if longest:
        j = j.filter(F.char_length("name") <= longest)
    return j.groupBy("profile", by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "; ").alias("names")
    )


def percent(part: str | Column, whole: str | Column) -> Column:
    """Whole percent, halves to even."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.concat(F.bround(F.lit(100.0) * part / whole, 0).cast("int").cast("string"), F.lit("%"))


def render(view: str, denominator: Column | None = None) -> Column:
    """Text of a view over columns name, aliases, n, words_n, band_0..3, complete, restricted, top_languages, context (map type -> names).

    Views: raw, template, aliases, fandom, cotags, length, cotags_length, usage, metadata, all.
    """
    lines = [F.concat(F.lit("Tag: "), "name"), F.lit("Type: Freeform")]
    if view == "raw":
        return F.col("name")
    if view == "template":
        return F.concat_ws("\n", *lines)
    lines.append(F.when(F.col("aliases") != "", F.concat(F.lit("Other names: "), "aliases")))
    if view == "aliases":
        return F.concat_ws("\n", *lines)
    has, enough = F.col("n") > 0, F.col("n") >= MINIMUM_WORKS
    if view in ("fandom", "cotags", "cotags_length", "all"):
        for kind in ("Fandom",) if view == "fandom" else SHOWN_OF_TYPE:
            names = F.try_element_at("context", F.lit(kind))
            lines.append(F.when(has & (names != ""), F.concat(F.lit(f"Observed {kind.lower()} context: "), names)))
    if view in ("length", "cotags_length", "all"):
        parts = [F.concat(F.lit(f"{label} "), percent(f"band_{b}", "words_n")) for b, label in enumerate(LENGTH_NAMES)]
        lines.append(F.when(enough & (F.col("words_n") > 0), F.concat(F.lit("Work lengths: "), F.concat_ws(", ", *parts))))
    if view in ("usage", "all"):
        share = F.col("n") / (denominator if denominator is not None else F.lit(1))
        tier = F.when(share < 1e-6, "very rare").when(share < 1e-4, "uncommon").when(share < 1e-2, "common").otherwise("very common")
        lines.append(F.when(enough, F.concat(F.lit("Observed usage frequency: "), tier)))
    if view in ("metadata", "all"):
        lines.append(F.when(enough, F.concat(F.lit("Work language codes: "), F.array_join("top_languages", ", "))))
        lines.append(F.when(enough, F.concat(F.lit("Works complete: "), percent("complete", "n"), F.lit("; restricted: "), percent("restricted", "n"))))
        for kind in DESCRIPTIVE_TYPES:
            names = F.try_element_at("context", F.lit(kind))
            lines.append(F.when(enough & (names != ""), F.concat(F.lit(f"Observed {kind}: "), names)))
    return F.concat_ws("\n", *lines)


def top_languages(languages_map: str, k: int = 2) -> Column:
    """Most frequent languages, ties by code."""
    entries = F.transform(F.map_entries(languages_map), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("code")))
    return F.slice(F.transform(F.array_sort(entries), lambda e: e["code"]), 1, k)


def profile_violations(profiles: DataFrame, sample: DataFrame, associated: DataFrame) -> DataFrame:
    """One row of counts that are 0 if all profile rules hold."""
    p = profiles.agg(F.count_if(F.expr("band_0 + band_1 + band_2 + band_3 <> words_n")).alias("bands"), F.count_if(F.expr("words_n > n")).alias("words"))
    s = sample.groupBy("profile").count().agg(F.count_if(F.col("count") > SAMPLE_WORKS).alias("sample"))
    own = sample.select("profile", "target").distinct()
    a = associated.join(own, "profile").agg(F.count_if(F.col("tag_id") == F.col("target")).alias("own_tag"))
    return p.join(s).join(a)


def slim(profile: DataFrame) -> DataFrame:
    """A profile without its samples: arrays and maps of works stay behind."""
    return profile.select(*[f.name for f in profile.schema.fields if not f.dataType.typeName().startswith("array")])
