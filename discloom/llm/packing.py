"""Filling containers of a fixed number of tokens with texts.

Every text is measured in tokens of a public tokenizer, texts over the largest
size are split into pieces at exact token counts, and pieces are packed into
containers of several sizes: each piece goes to the smallest size that holds
it, each size is packed by itself with best fit over lengths, and gaps in the
long containers are filled with pieces of the shorter sizes first.

Scale: containers are filled inside shards of bounded size (rows are spread by
a hash of their key, so no shard grows with the corpus); a shard leaves at most
a few part-filled containers behind.  Only lengths and keys are shuffled, never
texts.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloom.session import write_cut

VOCABULARY = os.environ.get("DISCLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIZES = (512, 2048, 8192)
SHARD_TOKENS = 4_000_000


def encoder(path: str):
    """The tokenizer of a vocabulary file, kept for the life of the process."""
    import sys

    import tiktoken

    kept = sys.modules.setdefault("__discloom_encoders__", type(sys)("__discloom_encoders__")).__dict__
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        kept[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens of the whole text; null and empty texts have 0."""
    src = df.select(key, text)
    schema = T.StructType([src.schema[key], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def pack_lengths(lengths: Sequence[int], capacity: int, gaps: Sequence[int] = ()) -> tuple[list[int], list[int]]:
    """Best fit decreasing: the bin of each length, and what each bin has left.

    ``gaps`` are free spaces of bins that exist already; they come first in
    numbering.  The open bins are kept sorted by free space.
    """
    free = list(gaps)
    order = sorted((f, i) for i, f in enumerate(free) if f > 0)
    where = [0] * len(lengths)
    for j in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[j]
        k = bisect_left(order, (n, -1))
        if k < len(order):
            f, i = order.pop(k)
        else:
            f, i = capacity, len(free)
            free.append(capacity)
        where[j], free[i] = i, f - n
        if free[i]:
            insort(order, (free[i], i))
    return where, free


def pack_shard(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> list[tuple[int, int]]:
    """(tier, bin) of every length: long tiers first, their gaps filled with
    the pieces of the next shorter tiers before these open bins of their own."""
    tier_of = [next(t for t, s in enumerate(sizes) if n <= s) for n in lengths]
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    open_gaps: list[tuple[int, int, int]] = []  # free, tier, bin
    for t in range(len(sizes) - 1, -1, -1):
        mine = [j for j, x in enumerate(tier_of) if x == t]
        rest = mine
        if open_gaps:
            # Longest pieces first into the tightest long-window gap.
            gaps = sorted(open_gaps)
            rest = []
            for j in sorted(mine, key=lambda j: -lengths[j]):
                k = bisect_left(gaps, (lengths[j], -1, -1))
                if k == len(gaps):
                    rest.append(j)
                    continue
                f, tt, b = gaps.pop(k)
                out[j] = (tt, b)
                if f > lengths[j]:
                    insort(gaps, (f - lengths[j], tt, b))
            open_gaps = gaps
        where, free = pack_lengths([lengths[j] for j in rest], sizes[t])
        for j, b in zip(rest, where, strict=True):
            out[j] = (t, b)
        open_gaps += [(f, t, b) for b, f in enumerate(free) if f > 0]
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sequence[int] = SIZES, vocabulary: str = VOCABULARY, step_group: int = 8, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """key, piece_no, token_start, n_tokens, capacity, container, step_group.

    A text is split only if it exceeds the largest size; its pieces tell where
    in its tokens they start.  Empty and null texts need no container and have
    no row.  A row repeated under its key is packed once for each copy.
    ``container`` is unique; containers of one capacity are dealt to step
    groups of about ``step_group`` so that the groups of a shard hold like
    numbers of tokens.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    counts = write_cut(token_counts(df, key, text, vocabulary).filter(F.col("n_tokens") > 0), "lengths")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(top).cast("bigint"))
    pieces = counts.select(key, "n_tokens", F.posexplode(starts).alias("piece_no", "token_start")).select(
        key, "piece_no", "token_start", F.least(F.lit(top).cast("bigint"), F.col("n_tokens") - F.col("token_start")).alias("n_tokens")
    )
    # The number of shards follows the tokens counted, so their size is bounded.
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, int(total // shard_tokens))
    spread = pieces.withColumn("__shard", F.pmod(F.xxhash64(key, "piece_no"), F.lit(shards)).cast("int"))
    schema = T.StructType(
        [
            pieces.schema[key],
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("token_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("capacity", T.IntegerType()),
            T.StructField("container", T.StringType()),
            T.StructField("step_group", T.StringType()),
        ]
    )

    def fill(pdf):
        pdf = pdf.sort_values([key, "piece_no"], kind="stable").reset_index(drop=True)
        shard = int(pdf["__shard"].iloc[0]) if len(pdf) else 0
        placed = pack_shard(pdf["n_tokens"].tolist(), sizes)
        load: dict[tuple[int, int], int] = {}
        for (t, b), n in zip(placed, pdf["n_tokens"], strict=True):
            load[(t, b)] = load.get((t, b), 0) + int(n)
        group = {}
        for t in range(len(sizes)):
            bins = sorted((b for b in load if b[0] == t), key=lambda b: (-load[b], b))
            n = max(1, -(-len(bins) // step_group))
            for i, b in enumerate(bins):  # dealt in turn, there and back
                k = i % (2 * n)
                group[b] = f"{shard}-{t}-{k if k < n else 2 * n - 1 - k}"
        pdf["capacity"] = [sizes[t] for t, _ in placed]
        pdf["container"] = [f"{shard}-{t}-{b}" for t, b in placed]
        pdf["step_group"] = [group[p] for p in placed]
        return pdf[schema.names]

    return spread.groupBy("__shard").applyInPandas(fill, schema)


def container_load(packed: DataFrame) -> DataFrame:
    """container, capacity, n_items, used, unused."""
    return packed.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used"), (F.first("capacity") - F.sum("n_tokens")).alias("unused")
    )
