"""Documents packed into token containers of fixed capacity (problem 8).

Cost-balanced packing: a document of n tokens costs ``linear * n + quadratic * n * n`` (attention
stays inside a document). Documents go in descending size to the sequence with the lowest cost that
still has room; only when none has room another sequence is opened. A document is never cut unless
it alone exceeds the capacity; then it is cut into full containers and a rest that is packed.

Scale: token counts are taken where the texts lie (Arrow batches) and written; from there on only ids
and sizes move. Items, pieces of cut documents included, are spread by hash over shards of about
``shard_items`` items each, so a shard is bounded whatever the corpus, looks like the whole, and wastes
at most its few last containers; the number of shards follows from the number of items, and one shard
(``shard_items`` at least as many) packs all together. Full pieces take containers of their own without
a search; for the rest a search takes the same time however many sequences are open. No group is keyed
on data, so no source or length can make one hot.

Defined results: null and empty texts have no tokens and no container, nor have rows without doc_id; of a document delivered
twice the newest counts; equal sizes are taken in order of (doc_id, piece).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written

CAPACITY = 2048
#: Vocabulary file of a public byte-level BPE, a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SHARD_ITEMS = 20_000

_LOADED: dict[tuple[str, str], object] = {}


def tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    """The encoding of a rank file, loaded once per worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def token_counts(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of the newest delivery of each document with a text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "collected_at": pdf["collected_at"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    counted = documents.select("doc_id", "collected_at", "text").where("text <> '' and doc_id is not null").mapInPandas(count, "doc_id bigint, collected_at timestamp, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.max_by("n_tokens", F.struct("collected_at", "n_tokens")).alias("n_tokens")).where("n_tokens > 0")


def items(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_start, size): documents, those over the capacity cut into full pieces and a rest."""
    starts = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))).alias("piece", "token_start")
    cut = counts.select("doc_id", "n_tokens", starts)
    return cut.select("doc_id", "piece", "token_start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("token_start")).alias("size"))


def pack(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The sequence of each size; sizes are in descending order and none exceeds the capacity.

    Open sequences lie in heaps by their free room, so the lowest cost with room is the least of the
    heaps' tops from the size on: one pass over at most ``capacity`` numbers.
    """
    n = len(sizes)
    out = np.empty(n, np.int64)
    full = int(np.searchsorted(-sizes, -capacity, side="right"))
    out[:full] = np.arange(full)
    rest = sizes[full:]
    used = max(1, int(np.ceil(rest.sum() / capacity))) if len(rest) else 0
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, k) for k in range(used)]
    top = np.full(capacity + 1, np.inf)
    if used:
        top[capacity] = 0.0
    for k, size in enumerate(rest.tolist()):
        at = int(top[size:].argmin()) + size
        cost = top[at]
        if cost == np.inf:
            cost, best, room, used = 0.0, used, capacity, used + 1
        else:
            ties = np.flatnonzero(top[size:] == cost) + size
            room = int(min(ties, key=lambda r: heaps[r][0][1])) if len(ties) > 1 else at
            cost, best = heappop(heaps[room])
            top[room] = heaps[room][0][0] if heaps[room] else np.inf
        out[full + k] = full + best
        left = room - size
        if left:
            heappush(heaps[left], (cost + linear * size + quadratic * float(size) * float(size), best))
            top[left] = heaps[left][0][0]
    return out


def packed(documents: DataFrame, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 4096, path: str = TOKENIZER, pattern: str = PATTERN, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, doc_id, piece, token_start, token_end, position): every item with its place in a container."""
    counts = written(token_counts(documents, path, pattern), "token-counts")
    parts = items(counts, capacity)
    total = counts.agg(F.sum(F.ceil(F.col("n_tokens") / capacity))).first()[0] or 0
    shards = max(1, -(-total // shard_items))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        pdf["bin"] = pack(pdf["size"].to_numpy(), capacity, linear, quadratic)
        ahead = pdf.groupby("bin")["size"].cumsum() - pdf["size"]
        return pd.DataFrame({
            "container": pdf["shard"].astype("int64") * (1 << 32) + pdf["bin"], "doc_id": pdf["doc_id"], "piece": pdf["piece"],
            "token_start": pdf["token_start"], "token_end": pdf["token_start"] + pdf["size"], "position": ahead,
        })

    spread = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(place, "container bigint, doc_id bigint, piece int, token_start bigint, token_end bigint, position bigint")


def containers(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(container, n_items, n_tokens, unused): the containers and their unused space."""
    size = F.col("token_end") - F.col("token_start")
    per = packed(documents, capacity, **options).groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum(size).alias("n_tokens"))
    return per.withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
