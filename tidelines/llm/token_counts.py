"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial symbols less the merges that apply to it, so no identifier is ever emitted:
the adjacent pairs of a linked list of symbols wait in a heap by rank, the lowest rank (leftmost on ties) merges first, and
the merged symbol's new pairs go back into the heap.

A text is cut where no piece joins two neighbours, in one pass, so that each part is merged by itself.

Defined results: null and empty texts have 0 bytes and 0 tokens; any length of text, with or without spaces, is counted whole;
repeated rows are counted each; an empty table gives an empty result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, memo, worker_state

#: The escaped form of a space in this kind of model.
SPACE = "▁"
#: A worker's word cache holds up to twice as many entries. Longer chunks are merged anew each time.
CACHE_WORDS, CACHED_LENGTH = 400_000, 48


class PieceMerger:
    """Counts the tokens of byte-pair models with byte fallback, as the library for the model file gives them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with byte fallback and without text normalisation are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        normal = [p for p in proto.pieces if p.type in (1, 5)]
        # equal scores are equal ranks: the leftmost pair of them goes first
        scores = {s: i for i, s in enumerate(sorted({p.score for p in normal}, reverse=True))}
        self.rank = {p.piece: scores[p.score] for p in normal}
        self.unused = {p.piece for p in normal if p.type == 5}
        if self.unused:
            raise ValueError("models with unused pieces are not supported")
        # a chunk boundary that no piece crosses: before a run of spaces, and around a line feed without a piece
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("models with a space inside a piece are not supported")
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.line_feed = not any("\n" in p for p in self.rank)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.line_feed else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, chunk: str) -> int:
        """Tokens of a chunk that no piece crosses."""
        rank = self.rank
        if chunk in rank and len(chunk) <= 2:
            return 1
        symbols: list[str] = list(chunk)
        n = len(symbols)
        # a symbol without a piece falls back to its bytes
        weight = [1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in symbols]
        count = sum(weight)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = following[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            count -= weight[i] + weight[j] - 1
            symbols[i], symbols[j], weight[i] = pair, "", 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + pair) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return count

    def cached(self, chunk: str, counts: dict[str, int]) -> int:
        """merge() of the parts of a chunk between characters that no piece joins: no merge crosses such a place."""
        joined, n = self.joined, len(chunk)
        cuts = [i for i in range(1, n) if chunk[i - 1 : i + 1] not in joined]
        if not cuts:
            return self.merge(chunk) if chunk else 0
        return sum(counts[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, n], strict=True))  # parts have no cuts

    def cache(self) -> dict[str, int]:
        counts = memo(lambda chunk: self.cached(chunk, counts), CACHE_WORDS, CACHED_LENGTH)
        return counts

    def count(self, text: str | None, cache: dict[str, int]) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", SPACE)
        if SPACE * 2 in text or not self.line_feed:
            return sum(map(cache.__getitem__, self.chunk.findall(text)))
        return sum(map(cache.__getitem__, text.replace("\n", " \n ").replace(SPACE, " " + SPACE).split(" ")))


def token_count(text: Column, model: bytes) -> Column:
    """A column with the number of tokens of each text."""
    key = "pieces-" + hashlib.sha256(model).hexdigest()

    def count(texts):
        import pyarrow as pa

        def make():
            merger = PieceMerger(model)
            return merger, merger.cache()

        merger, cache = worker_state(key, make)
        return pa.array([merger.count(t.as_py(), cache) for t in texts], pa.int64())

    count.__annotations__ = {}
    return F.arrow_udf(count, "bigint", F.ArrowUDFType.SCALAR)(text)


def count_tokens(df: DataFrame, model: bytes, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (more than `limit` tokens) of the column text_col; all rows and columns stay."""
    bound_batches(df.sparkSession)
    text = F.coalesce(df[text_col], F.lit(""))
    counted = df.withColumn("__tl_n", token_count(text, model)).withColumn("n_bytes", F.octet_length(text).cast("bigint"))
    return counted.withColumn("n_tokens", F.col("__tl_n")).withColumn("over_limit", F.col("__tl_n") > limit).drop("__tl_n")
