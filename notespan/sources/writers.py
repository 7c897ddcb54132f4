"""Sinks (SNK): events as JSON, plain texts, model tables, lists, and counts of a run."""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def serialise(docs: DataFrame, labels: dict[str, DataFrame], key: str = "doc_id", include_label_text: bool = False) -> DataFrame:
    """SNK1: ``key`` and json: each document's text and its label lists in order of place."""
    out = docs.select(key, "text")
    for name, df in labels.items():
        cols = [c for c in df.columns if c != key]
        if include_label_text:
            df = df.join(docs.select(key, F.col("text").alias("_t")), key).withColumn("label_text", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")))
            cols = [*cols, "label_text"]
        one = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(one, key, "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out.select(key, F.to_json(F.struct(key, "text", F.struct(*labels).alias("label_indices"))).alias("json"))


def write_json(events: DataFrame, path: str) -> None:
    events.select(F.col("json").alias("value")).write.text(path)


FORMATS = ("json", "yml", "pickle")


def _encoded(json_text: str, kind: str) -> bytes:
    if kind == "json":
        return json_text.encode()
    value = json.loads(json_text)
    if kind == "pickle":
        return pickle.dumps(value)
    import yaml

    return yaml.safe_dump(value, allow_unicode=True, sort_keys=False).encode()


def write_files(rows: DataFrame, path: str, kind: str = "txt", column: str = "text") -> int:
    """SNK1, SNK2: a file ``<event_id>.<kind>`` below ``path`` for every row; the number of files.

    ``kind`` json, yml or pickle takes ``column`` as JSON. Tasks write under another
    name and rename, so a task that runs again leaves whole files only. Any file system
    that Arrow knows by its address will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "://" not in path and not path.startswith("file:"):
            files, base = fs.LocalFileSystem(), path
        else:
            files, base = fs.FileSystem.from_uri(path)
        done = 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [x for x in str(name).split("/") if x not in ("", ".", "..")]
                target = "/".join([base.rstrip("/"), *parts]) + f".{kind}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as f:
                    f.write(_encoded(text, kind) if kind in FORMATS else (text or "").encode())
                files.move(part, target)
                done += 1
        yield pa.record_batch({"n": pa.array([done], pa.int64())})

    return rows.select("event_id", column).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """SNK2, SNK8: a folder an event, one line or text each."""
    texts.select("event_id", F.col(column).alias("value")).write.partitionBy("event_id").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """SNK8: one preprocessed line a document."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.text(path)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """SNK3 to SNK5: a Parquet table each, sorted by key so that readers skip row groups."""
    for name, df in tables.items():
        (df.sortWithinPartitions(*[c for c in ("key", "word", "term", "suffix") if c in df.columns] or df.columns[:1])).write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def source_list(sources: DataFrame) -> DataFrame:
    """SNK6: names in order of their ids."""
    return sources.orderBy("source").select("name")


def write_parts(rows: DataFrame, path: str, by: str) -> None:
    """SNK9: batches or splits as folders."""
    rows.write.partitionBy(by).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """SNK7: ``df`` that counts its rows as it runs; ``Observation.get`` tells them afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
