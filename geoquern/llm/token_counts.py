"""Token counts from an exact histogram of encoded lengths.

Every text is encoded whole with a public vocabulary; documents are then counted
per length.  All further answers (totals, quantiles, totals under every context
limit) come from suffix sums over the histogram, whose size depends on the longest
document and not on their number.  The sums run in two levels (blocks of lengths,
then lengths in a block), so no task holds all lengths.

Edge cases: null and empty texts have length 0 and count as documents; repeated
rows and ties count each; an empty table gives an empty histogram; other columns
are ignored.  Very long texts are encoded whole; runs of white space, on which the
encoder's pattern recurses, are cut out of them at the places where the pattern
cuts as well, and encoded as the single pieces that they are.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import ensure_checkpoint_dir, tidied

#: The split before the merges of byte-level rank files (fixed value of the vocabulary's format).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
#: White space that the encoder's pattern takes in one step; longer runs are cut out before it.
RUN = 256
_LONG_RUN = regex.compile(r"\p{White_Space}{%d,}" % (RUN + 1))

_ENCODINGS: dict = {}


def encoding(path: str):
    """The encoder of a rank file, loaded once per Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_length(encoder, text: str) -> int:
    """How many tokens the encoder makes of the text.

    A run of white space before another sign is one piece without its last sign, which goes with what
    follows; at the end of the text the whole run is one piece.  What stands before a run ends in
    another sign, so the pattern cuts there too."""
    total, at = 0, 0
    if len(text) > RUN:
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encoder.encode_ordinary(text[at : run.start()]))
            total += len(encoder._core_bpe.encode_single_piece(text[run.start() : end].encode()))
            at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of every row."""

    def run(batches):
        encoder = encoding(vocabulary)
        for batch in batches:
            lengths = [encoded_length(encoder, t) if t else 0 for t in (x.as_py() for x in batch.column(1))]  # a text at a time as Python's
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["_id", "n_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(tidied(run), "_id long, n_tokens long").withColumnRenamed("_id", id_col)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: n_docs of it, docs and tokens of lengths >= L,
    truncated_total (sum of min(length, L)), docs_before (documents shorter than L) and all_docs, all_tokens.

    The histogram is used twice and so written to the checkpoint folder first: texts are encoded once."""
    ensure_checkpoint_dir(histogram.sparkSession)
    histogram = histogram.checkpoint()
    block = F.floor(F.col("length") / BLOCK).cast("long")
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("_t"), block.alias("_b"))
    after = Window.orderBy(F.desc("_b"))  # one row for each BLOCK lengths
    tops = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_bt"))
    tops = tops.select(
        "_b",
        (F.sum("_d").over(after) - F.col("_d")).alias("_later_d"),
        (F.sum("_bt").over(after) - F.col("_bt")).alias("_later_t"),
        F.sum("_d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("_bt").over(Window.partitionBy()).alias("all_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("length"))
    out = h.join(tops, "_b").select(
        "length", "n_docs",
        (F.sum("n_docs").over(inside) + F.col("_later_d")).alias("docs_at_least"),
        (F.sum("_t").over(inside) + F.col("_later_t")).alias("tokens_at_least"),
        "all_docs", "all_tokens",
    )
    return out.withColumn("truncated_total", F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).withColumn("docs_before", F.col("all_docs") - F.col("docs_at_least"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total: the tokens left when every document is cut at the limit."""
    cols = [F.coalesce(F.sum(F.least("length", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).cast("long").alias(str(int(x))) for x in limits]
    row = histogram.agg(*cols)
    return row.select(F.explode(F.array(*(F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(str(int(x))).alias("truncated_total")) for x in limits))).alias("r")).select("r.*")


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """quantile, length: the smallest length L such that at least that share of documents has length <= L."""
    upto = F.col("docs_before") + F.col("n_docs")
    cols = [F.min(F.when(upto >= F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("all_docs"))), F.col("length"))).alias(f"_{k}") for k, q in enumerate(at)]
    row = sums.agg(*cols)
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_{k}").alias("length")) for k, q in enumerate(at)))).alias("r")).select("r.*")
