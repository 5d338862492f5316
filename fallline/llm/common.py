"""What the training-data operators share: tables, shipping of the code, checkpoints and words."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application.

    Python workers then import it wherever they run, whatever their PYTHONPATH is. Batches sent to
    them are bounded by BATCH_BYTES: texts are long, and 10,000 of them take much memory on both sides.
    """
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(limit).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)
    if getattr(sc, "_fallline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(), "fallline.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("fallline") / p.relative_to(root)))
    sc.addPyFile(out)
    sc._fallline_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names. Where it names none a temporary one, which only a local master can share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fallline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def whole_rows(docs: DataFrame):
    """All columns of docs as one struct, so that none can clash with those an operator adds."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row__")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and the UTF-8 bytes of text (null: empty) of each row of Arrow batches."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").cast(pa.large_binary())
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, text.as_py() or b""


def split_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of texts: how many each has, their numbers in order, and the distinct words that these number.

    Words are split at ASCII white space; `lower` changes A-Z alone.
    """
    col = pa.array(texts, pa.large_binary()).cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(col) if lower else col)
    flat, ends = split.flatten(), split.offsets.to_numpy()
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty word
    if not some.all():
        flat, ends = flat.filter(pa.array(some)), np.concatenate([[0], some.cumsum()])[ends - ends[0]]
    coded = flat.dictionary_encode()
    return np.diff(ends), coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()


def batches_of(made: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `size` rows and about 8 MB of strings and bytes."""
    held: list[tuple] = []
    weight = 0
    for row in made:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= 8 << 20:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def input_partitions(df: DataFrame) -> int:
    """How many partitions Spark reads df in: grows with the input, known without reading it."""
    return max(1, df.rdd.getNumPartitions())
