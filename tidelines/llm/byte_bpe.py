"""Byte-level BPE by dynamic programming over prefixes.

Of the tokens that can end a byte prefix exactly one is the last token of the prefix's own encoding: the one that follows
its left neighbour's prefix and whose pair with that prefix's last token encodes to the very two. The table of last tokens
therefore gives the encoding of every prefix, grows by appending, and after an edit is recomputed only until it meets the
old table again.

Defined results: null and empty texts encode to no ids and decode to nothing; any length of text is encoded whole;
repeated rows are encoded each; an empty table gives an empty result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, memo, worker_state

#: A worker's piece cache holds up to twice as many entries. Longer pieces are encoded anew each time. An executor has a worker by
#: core for encoding and one for decoding, which change places between tasks, so that all of them may come to hold a cache.
CACHE_PIECES, CACHED_LENGTH = 200_000, 48
#: Pairs of neighbours that a worker remembers.
CACHED_PAIRS = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def plain_pattern(pattern: str) -> str | None:
    """The pattern with its Unicode classes written out over the Basic Multilingual Plane, for the standard library's faster engine.

    None where it holds an escape that the two engines could read differently.
    """
    import regex

    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF)

    def ranges(name: str) -> str:
        codes = [ord(c) for c in regex.findall(name, plane)]
        starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
        stops = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, stops))

    out, inside = [], False
    for part in regex.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            part = ranges(part) if inside else f"[{ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{ranges(chr(92) + 's')}]"
        elif len(part) > 1 or inside and part == "[":
            return None
        else:
            inside = part == "[" or inside and part != "]"
        out.append(part)
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of pattern in a text."""
    import re

    import regex

    every, plain = regex.compile(pattern).findall, plain_pattern(pattern)
    if plain is None:
        return every
    quick = re.compile(plain).findall

    def split(text: str) -> list[str]:
        inside_plane = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return quick(text) if inside_plane else every(text)

    return split


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.longest = max(map(len, ranks))
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[str, Callable[[str], list[str]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a short string by plain merging; the yardstick for one or two tokens."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int | None, token: int) -> bool:
        """True if token can follow left (or stand first)."""
        if left is None:
            if (ok := self.alone.get(token)) is None:
                ok = self.alone[token] = self.merged(self.tokens[token]) == [token]
            return ok
        if (ok := self.pairs.get((left, token))) is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            both = self.tokens[left] + self.tokens[token]
            # a token that stands for both, and encodes to itself, is their encoding
            whole = self.ranks.get(both)
            ok = not (whole is not None and self.fits(None, whole)) and self.merged(both) == [left, token]
            self.pairs[left, token] = ok
        return ok

    def last_token(self, data: bytes, end: int, last: list) -> int:
        """The last token of data[:end], given those of the shorter prefixes."""
        ranks, tails, found = self.ranks, self.tails, []
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            part = data[start:end]
            if part not in tails:
                break
            if part in ranks:
                found.append((start, ranks[part]))
        for start, token in reversed(found):
            if self.fits(last[start], token):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def table(self, data: bytes, last: list | None = None) -> list:
        """Last tokens of all prefixes of data; `last` holds those of a first part of it."""
        last = last or [None]
        for end in range(len(last), len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def read(self, last: list) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def needed(self, data: bytes, end: int, last: list) -> int:
        """last_token() that asks for shorter prefixes only where a candidate needs them, the longest candidate first."""
        rank, pairs = self.ranks.get, self.pairs
        if (token := rank(data[:end])) is not None and (self.alone.get(token) or self.fits(None, token)):
            last[end] = token
            return token
        for start in range(max(1, end - self.longest), end):
            if (token := rank(data[start:end])) is None:
                continue
            left = last[start]
            if left is None:
                left = self.needed(data, start, last)
            ok = pairs.get((left, token))
            if ok or ok is None and self.fits(left, token):
                last[end] = token
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def encode(self, data: bytes) -> list[int]:
        if (token := self.ranks.get(data)) is not None and self.fits(None, token):
            return [token]
        if not data or len(data) > 64:
            return self.read(self.table(data))
        last = [None] * (len(data) + 1)
        self.needed(data, len(data), last)
        return self.read(last)


class EditableEncoding:
    """The encoding of one piece of bytes that may grow or change."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.table(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.table(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in place of data[start:stop]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = last = old[: start + 1]
        # once as many prefixes in a row as the longest token has bytes end as before, so do all the others
        same, done = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.encoder.longest:
                last.extend(old[end - shift :])
                break
            last.append(self.encoder.last_token(self.data, end, last))
            done += 1
            same = same + 1 if end > start + len(new) and last[end] == old[end - shift] else 0
        return done

    def ids(self) -> list[int]:
        return self.encoder.read(self.last)


def _encoder(key: str, ranks: bytes) -> tuple[PrefixEncoder, dict]:
    def make():
        encoder = PrefixEncoder(parse_ranks(ranks))

        pack = lambda piece: b"".join(i.to_bytes(4, "little") for i in encoder.encode(piece.encode()))
        return encoder, memo(pack, CACHE_PIECES, CACHED_LENGTH)  # little-endian 32-bit ids by piece

    return worker_state("ranks-" + key, make)


def encode_column(text: Column, ranks: bytes, pattern: str) -> Column:
    """array<int> of the ids of each text; every match of pattern is encoded by itself."""
    key = hashlib.sha256(ranks).hexdigest()

    def encode(texts):
        import numpy as np
        import pyarrow as pa

        encoder, cache = _encoder(key, ranks)
        if (split := encoder.splits.get(pattern)) is None:
            split = encoder.splits[pattern] = splitter(pattern)
        rows = [b"".join(map(cache.__getitem__, split(t.as_py() or ""))) for t in texts]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    encode.__annotations__ = {}
    # Coalesced, though never null: functions chained straight onto this one would each encode the texts again.
    return F.coalesce(F.arrow_udf(encode, "array<int>", F.ArrowUDFType.SCALAR)(text), F.array().cast("array<int>"))


def decode_column(ids: Column, ranks: bytes) -> Column:
    """The bytes that ids stand for."""
    key = hashlib.sha256(ranks).hexdigest()

    def decode(rows):
        import pyarrow as pa

        # decoding needs no encoder, which with its caches is many times larger
        token = worker_state("ranks-tokens-" + key, lambda: {i: t for t, i in parse_ranks(ranks).items()}).__getitem__
        return pa.array([b"".join(map(token, r.values.to_pylist())) if r.is_valid else b"" for r in rows], pa.binary())

    decode.__annotations__ = {}
    return F.arrow_udf(decode, "binary", F.ArrowUDFType.SCALAR)(ids)


def ids_digest_column(ids: Column) -> Column:
    """Lower-case hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    def digest(rows):
        import hashlib as h

        import numpy as np
        import pyarrow as pa

        return pa.array([h.sha256(r.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if r.is_valid else b"").hexdigest() for r in rows], pa.string())

    digest.__annotations__ = {}
    return F.arrow_udf(digest, "string", F.ArrowUDFType.SCALAR)(ids)


def encode_documents(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """df with token_ids (array<int>) and n_tokens; all rows and columns stay."""
    bound_batches(df.sparkSession)
    out = df.withColumn("token_ids", encode_column(df[text_col], ranks, pattern))
    return out.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


def decode_documents(df: DataFrame, ranks: bytes, ids_col: str = "token_ids") -> DataFrame:
    """df with decoded (binary)."""
    return df.withColumn("decoded", decode_column(df[ids_col], ranks))
