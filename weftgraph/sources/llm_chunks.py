"""Packing files into prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import ship


def pack(files: DataFrame, budget: int = 40_000) -> DataFrame:
    """(path, folder, chunk, tokens): a folder's files, in order, into chunks of at most ``budget`` tokens; a larger file has its own.

    Each folder fills its chunks by itself, so folders pack at once; ``chunk`` counts from 0 in its folder.
    """
    ship(files.sparkSession)

    def run(batches):
        # folders come one after another, files in order: what is carried from batch to batch is one folder's state
        folder, chunk, load = None, 0, 0
        for pdf in batches:
            out = []
            for at, tokens in zip(pdf["folder"], pdf["tokens"], strict=True):
                if at != folder:
                    folder, chunk, load = at, 0, 0
                elif load and load + tokens > budget:
                    chunk, load = chunk + 1, 0
                load += tokens
                out.append(chunk)
            yield pdf.assign(chunk=pd.Series(out, dtype="int32"))[["path", "folder", "chunk", "tokens"]]

    foldered = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("tokens").cast("long").alias("tokens"))
    return foldered.repartition("folder").sortWithinPartitions("folder", "path").mapInPandas(run, "path string, folder string, chunk int, tokens long")
