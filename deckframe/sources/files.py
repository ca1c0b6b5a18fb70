"""Layout files read and written by Spark."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckframe.sources.schema import DECK_FIELDS


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Objects of a JSON-lines file; a line that does not parse fails, or fills ``_corrupt_record`` if not strict."""
    reader = spark.read.schema(schema)
    return (reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, keys in order of name."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def decks(spark: SparkSession, path: str) -> DataFrame:
    """Deck files, or slide files as decks of one slide named by the file: deck_id, slide_index, slide_id, width, height, elements, slide_metadata."""
    raw = spark.read.option("multiLine", True).schema(DECK_FIELDS).json(path).withColumn("_file", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", ""))
    alone = F.array(F.struct("slide_id", "width", "height", "elements", F.col("metadata").alias("metadata")))
    df = raw.select(F.coalesce("deck_id", "_file").alias("deck_id"), F.posexplode(F.coalesce("slides", alone)).alias("slide_index", "s"))
    return df.select("deck_id", "slide_index", "s.slide_id", F.coalesce("s.width", F.lit(1920)).alias("width"), F.coalesce("s.height", F.lit(1080)).alias("height"), "s.elements", F.col("s.metadata").alias("slide_metadata"))


def arrow_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow IPC files, streams or files, whose columns ``schema`` names."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                try:
                    reader = pa.ipc.open_stream(io.BytesIO(data))
                    parts = list(reader)
                except pa.ArrowInvalid:
                    file = pa.ipc.open_file(io.BytesIO(data))
                    parts = [file.get_batch(i) for i in range(file.num_record_batches)]
                yield from (p.select(names) for p in parts)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def write_csv(df: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    """CSV with a header, the columns of ``first`` before the others, nested values as JSON."""
    order = [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]
    nested = lambda f: isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    kinds = {f.name: f for f in df.schema}
    df.select(*[F.to_json(c).alias(c) if nested(kinds[c]) else F.col(c) for c in order]).write.option("header", True).csv(path)


def manifest_counts(samples: DataFrame, keys: tuple[str, ...] = ("type", "split", "template")) -> DataFrame:
    """Counts by each of ``keys`` and of all rows, in one pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    return samples.groupingSets(sets, *keys).agg(F.count("*").alias("n"))
