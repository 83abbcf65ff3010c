"""Scans: contract folders, dictionaries, rosters, knowledge text; one fixed schema per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import fixed
from ledgerloom.functions.documents import filename_date
from ledgerloom.functions.names import norm_client
from ledgerloom.functions.text import strip, text_or_blank


def conform(df: DataFrame, canonical: list[str], aliases: dict[str, list[str]] | None = None, required: tuple[str, ...] = (),
            sort_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in canonical columns, one-row report).

    A canonical column is taken as is, else from its first alias that exists, else blank.
    Missing required columns fail. Names are compared without case.
    """
    have = {c.upper(): c for c in df.columns}
    source = {
        c: next((have[a.upper()] for a in (c, *(aliases or {}).get(c, [])) if a.upper() in have), None) for c in canonical
    }
    missing = [c for c in required if source.get(c) is None]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    out = df.select(*[F.col(f"`{source[c]}`").alias(c) if source[c] else F.lit("").alias(c) for c in canonical])
    report = df.sparkSession.createDataFrame(
        [(
            [c for c in canonical if source[c]], [c for c in canonical if not source[c]],
            [f"{c}={source[c]}" for c in canonical if source[c] and source[c].upper() != c.upper()],
            bool(sort_column and source.get(sort_column)),
        )],
        "present array<string>, missing array<string>, aliased array<string>, can_sort boolean",
    )
    return out, report


def supported(path: Column, extensions=fixed.SUPPORTED_EXTENSIONS) -> Column:
    return F.rlike(path, F.lit(rf"(?i)\.(?:{'|'.join(extensions)})$"))


def _inventory(paths: DataFrame) -> DataFrame:
    """(path, size) to client, filename, extension, date and key; the client is the folder."""
    bits = F.split("path", "/")
    name = F.element_at(bits, -1)
    client = F.when(F.size(bits) > 1, F.element_at(bits, -2)).otherwise("")
    return paths.where(supported(F.col("path"))).select(
        client.alias("client"), name.alias("filename"), "path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        "size", filename_date(name).alias("filename_date"), F.concat(client, F.lit("/"), name).alias("key"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.url_decode(F.regexp_replace("path", "^file:/*", "/")).alias("path"), F.col("length").alias("size"))


def scan_contracts(paths: DataFrame, only_clients: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(inventory, asked clients without a folder). `paths` is (path, size)."""
    found = _inventory(paths)
    if only_clients is None:
        return found, found.select("client").where(F.lit(False))
    asked = only_clients.select("client").distinct()
    return found.join(asked, "client", "left_semi"), asked.join(found.select("client"), "client", "left_anti")


def scan_contracts_flat(paths: DataFrame) -> DataFrame:
    """Inventory of one flat folder: the key is the file name, the group its prefix before `---`."""
    prefix = F.regexp_extract("filename", r"^([A-Z0-9-]+?)---", 1)
    return _inventory(paths).select(
        "filename", "path", "extension", "size", "filename_date", F.col("filename").alias("key"), prefix.alias("file_group")
    )


def pick_dictionary(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(core, path): the largest file with "dict" in its name, else the largest; else the override."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    best = files.groupBy("core").agg(
        F.max_by("path", F.struct(F.contains(name, F.lit("dict")).alias("d"), "size", "path")).alias("path"))
    if overrides is None:
        return best
    rest = overrides.join(best.select("core"), "core", "left_anti").select("core", "path")
    return best.unionByName(rest)


def dictionary_for(clients: DataFrame, on_roster: DataFrame, home: str, abroad: str) -> DataFrame:
    """(client, dictionary): clients on the foreign roster use the other dictionary."""
    flag = on_roster.select("client", F.lit(True).alias("_r")).distinct()
    return clients.join(flag, "client", "left").select("client", F.when(F.col("_r"), abroad).otherwise(home).alias("dictionary"))


def load_dictionary(candidates: list[tuple[str, DataFrame]], required: tuple[str, ...], preferred: tuple[str, ...] = ()) -> DataFrame:
    """The first preferred candidate that has the required columns, else any; rows without them are dropped."""
    named = dict(candidates)
    order = [n for n in preferred if n in named] + [n for n, _ in candidates if n not in preferred]
    for name in order:
        if set(required) <= set(named[name].columns):
            return named[name].dropna(subset=list(required))
    raise ValueError(f"no candidate has the columns {', '.join(required)}")


def load_section_map(rows: DataFrame) -> DataFrame:
    """(raw, section) without blanks."""
    return rows.select(strip(F.col("raw")).alias("raw"), strip(F.col("section")).alias("section")).where(
        (F.col("raw") != "") & (F.col("section") != "")).distinct()


def load_roster(rows: DataFrame, column: str = "name") -> DataFrame:
    """Distinct normalised names; all-digit and shorter than three characters are noise."""
    norm = norm_client(F.col(column))
    return rows.select(norm.alias("norm")).where(
        (F.length("norm") >= 3) & ~F.rlike(F.replace("norm", F.lit(" "), F.lit("")), F.lit(r"^\d+$"))).distinct()


def knowledge_sections(texts: DataFrame, numbers: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(doc, number, position, section): whole `## N.` sections with a listed number; with `most`, their first characters."""
    parts = texts.select("doc", F.posexplode(F.split("text", r"\n(?=## \d+\.)")).alias("position", "section"))
    numbered = parts.withColumn("number", F.regexp_extract("section", r"^## (\d+)\.", 1))
    kept = numbered.where(F.col("number").isin(*numbers))
    return kept.withColumn("section", F.substring("section", 1, most)) if most else kept


def null_hygiene(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.select(*[
        F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def drop_placeholders(df: DataFrame, column: str) -> DataFrame:
    return df.where(text_or_blank(F.col(column)) != "")


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
