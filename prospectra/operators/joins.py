"""Joins that need a plan of their own: chain names inside names, hosts under domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import text as X


def chain_names(*lists: DataFrame) -> DataFrame:
    """Distinct lower-case names of several lists."""
    out = lists[0].select(F.lower(F.trim("name")).alias("chain"))
    for x in lists[1:]:
        out = out.union(x.select(F.lower(F.trim("name"))))
    return out.filter("chain <> ''").distinct()


#: Chains that one piece may key before they are dealt into several keys.
CHAINS_PER_KEY = 1000


def _pieces(text: str, least: int) -> Column:
    """The distinct pieces of ``least`` characters of a text; a shorter text is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - least + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda k: F.substr(F.col(text), k, F.lit(least))))


def names_with_chain(names: DataFrame, chains: DataFrame, least: int = 4) -> DataFrame:
    """(``name``, ``chain``) where a name holds a chain's name of ``least`` letters or more, or is one.

    A chain is filed under the one of its pieces that the fewest names hold, which one counting pass
    over the names tells, of pieces that chains have; a piece that all share, as of "the ..", keys no chain that has another. A
    piece that keys many chains all the same is dealt into several keys. Names meet the keys by
    their pieces in an equi join; what meets is compared in full.
    """
    distinct = names.select("name").distinct().withColumn("_lower", F.lower(F.trim("name")))
    filed = chains.select("chain").distinct().select("chain", F.explode(_pieces("chain", least)).alias("_piece"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_lower") - least + 1, F.lit(1)))
    cut = distinct.select("name", "_lower", F.explode(starts).alias("_at")).select("name", "_lower", F.substr("_lower", F.col("_at"), F.lit(least)).alias("_piece"))
    held = cut.join(filed.select("_piece").distinct(), "_piece", "left_semi").distinct()
    counted = held.groupBy("_piece").agg(F.count(F.lit(1)).alias("_names"))
    # a chain with a piece that no name has is in no name
    known = filed.join(counted, "_piece", "left").groupBy("chain").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_piece")).alias("_best"))
    keyed = known.filter("_best.n > 0").select("chain", F.col("_best._piece").alias("_piece"))
    parts = keyed.groupBy("_piece").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHAINS_PER_KEY)).alias("_parts"))
    keyed = keyed.join(parts, "_piece").select("chain", "_piece", F.pmod(F.xxhash64("chain"), F.col("_parts")).alias("_part"))
    dealt = held.join(parts, "_piece").select("name", "_lower", "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    met = dealt.join(keyed, ["_piece", "_part"])
    return met.filter((F.col("_lower") == F.col("chain")) | ((F.length("chain") >= least) & F.contains("_lower", F.col("chain")))).select("name", "chain").distinct()


def in_chain(businesses: DataFrame, chains: DataFrame) -> DataFrame:
    """Businesses with ``in_chain``: whether their name holds a chain's."""
    held = names_with_chain(businesses.filter("name IS NOT NULL"), chains).select("name", F.lit(True).alias("in_chain")).distinct()
    return businesses.join(held, "name", "left").withColumn("in_chain", F.coalesce("in_chain", F.lit(False)))


def under_domains(urls: DataFrame, url_col: str, listed: DataFrame) -> DataFrame:
    """URLs whose host is, or is under, a listed ``domain``; repeated rows stay repeated.

    The distinct hosts meet the list by their suffixes of two labels or more; rows are then looked up by host and keep all their columns.
    """
    rows = urls.withColumn("_host", X.url_host(url_col))
    # no list holds a bare ending, which all hosts would share
    long = F.filter(X.host_suffixes("_host"), lambda s: F.contains(s, F.lit(".")) | (s == F.col("_host")))
    suffixes = rows.select("_host").distinct().withColumn("_suffix", F.explode(long))
    under = suffixes.join(listed.select(F.col("domain").alias("_suffix")), "_suffix", "left_semi").select("_host").distinct()
    return rows.join(under, "_host", "left_semi").drop("_host")


def exported_flag(rows: DataFrame, ledger: DataFrame, platform: str) -> DataFrame:
    done = ledger.filter(F.col("platform") == platform).select("business_id", F.lit(True).alias("exported")).distinct()
    return rows.join(done, "business_id", "left").withColumn("exported", F.coalesce("exported", F.lit(False)))


def cities_for(areas: DataFrame, cities: DataFrame) -> DataFrame:
    """Areas whose city, by name and country (null equals null), is not there yet."""
    known = cities.select(F.col("name").alias("_n"), F.col("country").alias("_c"))
    return areas.select("name", "country", "region").dropDuplicates(["name", "country"]).join(known, F.col("name").eqNullSafe(F.col("_n")) & F.col("country").eqNullSafe(F.col("_c")), "left_anti")
