"""Bounded, deterministic training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import ensure_checkpoint_dir

#: Bounds of a training sample: rows per class, and characters of a text that may be trained on.
PER_CLASS = 1500
MAX_CHARS = 12_000
CLASSES = 32
#: Bytes that fitting (on the driver) takes through the text kernels at once.
FIT_BYTES = 1 << 19


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int, max_chars: int, where: Column | None = None) -> list[tuple[int, str]]:
    """(label, text) of at most ``per_class`` rows for each label, those with the smallest hash of the id.

    Only fitting reads this sample; texts longer than ``max_chars`` are left out of it
    (never out of scoring), and equal texts count once.  Rows whose text may not be trained on take no place in the
    sample; the rows are chosen by hashes first, so only the sample's texts move.
    """
    key = F.col(id_col).cast("long").alias("_id")
    own = labels.select(key, F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    if where is not None:
        own = own.where(where)
    own = own.distinct()
    classes = sorted(r[0] for r in own.select("_y").distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes in {label_col}")
    if not classes:
        return []
    texts = docs.select(key, F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull() & (F.length("_text") <= max_chars)).withColumn("_h", F.xxhash64("_text"))
    ensure_checkpoint_dir(docs.sparkSession)
    eligible = own.join(texts.select("_id", "_h"), "_id").distinct().checkpoint()
    chosen = None
    for y in classes:
        part = eligible.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id", "_h").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most per_class * CLASSES small rows are broadcast, and as many texts come back
    rows = texts.join(F.broadcast(chosen), ["_id", "_h"]).select("_id", "_y", "_text").distinct().collect()
    return list(dict.fromkeys((r["_y"], r["_text"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_y"], r["_text"]))))
