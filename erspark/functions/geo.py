"""Countries, regions, postal codes and house numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erspark.functions.names import literal_map
from erspark.functions.tables import COUNTRIES, POSTCODES, long_region_rows, region_rows


def country(raw: Column, aliases: dict[str, str] = COUNTRIES) -> Column:
    """Canonical country: a known spelling, else the text in title case."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(aliases), F.lower(t)), title(t))


def title(text: Column) -> Column:
    """Text with each letter that follows no letter in upper case, and all others in lower case."""
    letters = F.split(F.lower(text), "")
    first = lambda i: (i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit("")).rlike(r"\p{L}")
    return F.array_join(F.transform(letters, lambda c, i: F.when(first(i), F.upper(c)).otherwise(c)), "")


def strip_accents(text: Column) -> Column:
    """Text without combining marks (NFKD); Spark has no such normalisation, so this is an Arrow function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return run(text)


def region_table(spark: SparkSession) -> DataFrame:
    """country, spelling, region; country ``*`` has the long spellings, which hold for any country."""
    return spark.createDataFrame([*region_rows(), *(("*", *r) for r in long_region_rows())], "country string, spelling string, region string")


def canonical_region(df: DataFrame, key: str, value: str, country: str, regions: DataFrame) -> DataFrame:
    """(key, region): a region's canonical name, by its country's spellings, else by those of any country, else as it is."""
    flat = F.rtrim(F.lower(F.trim(strip_accents(F.coalesce(F.col(value), F.lit(""))))), F.lit("."))
    base = df.select(F.col(key), F.col(country).alias("country"), flat.alias("spelling"))
    own = regions.where("country <> '*'")
    anywhere = regions.where("country = '*'").select("spelling", F.col("region").alias("elsewhere"))
    # Registries of known size: some two hundred rows.
    return base.join(F.broadcast(own), ["country", "spelling"], "left").join(F.broadcast(anywhere), "spelling", "left").select(key, F.coalesce("region", "elsewhere", "spelling").alias("region"))


def postcode(address: Column, country: Column) -> Column:
    """The last postal code of the country's form; in the US a lone code that opens the digits is a house number."""
    out = F.lit("")
    for name, pattern in POSTCODES.items():
        found = F.regexp_extract_all(address, F.lit(pattern), F.lit(0))
        last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
        code = F.regexp_replace(last, r"\s", "") if name == "India" else F.substring(last, 1, 5)
        if name == "US":
            code = F.when((F.size(found) == 1) & (F.regexp_extract(address, r"\d+", 0) == code), F.lit("")).otherwise(code)
        out = F.when(country == name, code).otherwise(out)
    return out


def house_number(address: Column, code: Column) -> Column:
    """First run of digits that is not the postal code, its first three digits or the rest of them."""
    other = F.filter(F.regexp_extract_all(address, F.lit(r"\d+"), F.lit(0)), lambda d: ~((code != "") & ((d == code) | (d == F.substring(code, 1, 3)) | (d == F.substr(code, F.lit(4))))))
    return F.coalesce(F.get(other, 0), F.lit(""))


def region(df: DataFrame, key: str, address: str, country: str, regions: DataFrame) -> DataFrame:
    """(key, region): a short code that is a whole comma segment, else the longest run of tokens that names a region.

    Candidates are joined to the registry, a table of known size.
    """
    flat = F.regexp_replace(F.lower(strip_accents(F.coalesce(F.col(address), F.lit("")))), r"[^a-z\s,]", " ")
    base = df.select(F.col(key), F.col(country).alias("country"), flat.alias("flat"))
    segments = base.select(key, "country", F.posexplode(F.split("flat", ",")).alias("at", "spelling")).select(key, "country", F.trim("spelling").alias("spelling"), F.lit(0).alias("first"), "at", F.lit(9).alias("width")).where("length(spelling) between 1 and 3")
    words = base.select(key, "country", F.filter(F.split(F.translate("flat", ",", " "), r"\s+"), lambda t: t != "").alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("spelling"), i.alias("at"), n.alias("width")))))
    runs = words.select(key, "country", F.explode(grams).alias("g")).select(key, "country", "g.spelling", F.lit(1).alias("first"), "g.at", "g.width").where("length(spelling) > 3")
    anywhere = runs.withColumn("country", F.lit("*"))
    hits = segments.unionByName(runs).unionByName(anywhere).join(F.broadcast(regions), ["country", "spelling"])
    order = Window.partitionBy(key).orderBy("first", F.desc("width"), "at", F.col("country") == "*")
    best = hits.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "region")
    return df.select(key).join(best, key, "left").select(key, F.coalesce("region", F.lit("")).alias("region"))
