"""Page images by engines of the caller's: rendered once for each file and resolution, and cut to regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources import side_table

#: A file's pages under the digest of its content and the resolution.
RENDERED = "key string, pages array<struct<page_no: int, image: binary>>"


def documents(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """-> (doc_id, content)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(stem.alias("doc_id"), "content")


def rendered(files: DataFrame, path: str, render: Callable[[bytes, int], list[bytes]], dpi: int = 200) -> tuple[DataFrame, int]:
    """files(doc_id, content) -> ((doc_id, page_no, image), files rendered): a side table at `path` keeps what was rendered before, so that a
    changed file or another resolution is rendered anew, and nothing else. render: a file and a resolution -> its pages' images."""
    keyed = files.withColumn("key", side_table.content_key(f"dpi={dpi}", F.sha2("content", 256)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pages = [[{"page_no": n, "image": image} for n, image in enumerate(render(bytes(content), dpi), 1)] for content in part["content"]]
            yield pd.DataFrame({"key": part["key"], "pages": pages})

    table, made = side_table.fill(keyed.select("key", "content"), path, lambda todo: todo.mapInPandas(run, RENDERED), RENDERED)
    found = keyed.select("doc_id", "key").join(table, "key").select("doc_id", F.explode("pages").alias("p"))
    return found.select("doc_id", "p.*"), made


def cropped(images: DataFrame, regions: DataFrame, crop: Callable[[bytes, float, float], bytes]) -> DataFrame:
    """images(doc_id, page_no, image), regions(doc_id, page_no, y0, y1) -> (doc_id, page_no, image), each cut to its region."""
    rows = images.join(regions.select("doc_id", "page_no", F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1")), ["doc_id", "page_no"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cut = [crop(bytes(image), y0, y1) for image, y0, y1 in zip(part["image"], part["y0"], part["y1"], strict=True)]
            yield part[["doc_id", "page_no"]].assign(image=cut)

    kinds = dict(images.dtypes)
    return rows.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, image binary")
