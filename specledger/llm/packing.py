"""Best-fit packing by minimum bin slack (operator 5).

Each document is tokenised whole and ends with an end id; longer ones are cut into full pieces, the first of which may be shorter. Bins
are filled one after another: the longest piece left goes in, and a subset-sum over a bitset of reachable sums finds the fullest
combination of the other lengths. Only lengths matter, and there are at most ``capacity`` of them, so the plan is made from the
histogram of lengths. The same combination stays the fullest as long as its lengths last, so it is used for as many bins as they
allow at once; each step uses up the stock of at least one length, which bounds the plan by the capacity, not by the corpus. The pieces then take
their places by their rank within their length, found in two levels so that a frequent length is not one task.

Defined results: a null text is empty and gives one piece with the end id alone; repeated rows are packed as often as they occur; an empty
table gives no piece. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from specledger.llm.words import bounded
from specledger.session import stage_table

# Fixed value: how the byte-level tokenizer cuts text before it merges bytes.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOT_ROWS = 50_000
END_ID = 2


# Characters about which the patterns of the two engines may disagree: texts with one are encoded by the tokenizer itself.
_RARE = re.compile("[\x1c-\x1f\x85\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\U00010000-\U0010ffff]")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class TokenIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The ids are those of ``tokenizer``. ``merger`` gives the same ones from the ranks of its vocabulary, about four times as fast.
    """

    def __init__(self, tokenizer, merger):
        self.tokenizer = tokenizer
        self.merger = merger

    def ids(self, text: str) -> bytes:
        if _RARE.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.merger.encode_ordinary(text)
        return np.asarray(found, "<u4").tobytes()


def rank_engine(tokenizer):
    """The merges of a byte-level tokenizer as ranks: a token's id is its place in the order of merges."""
    import tiktoken

    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte_of = {c: b for b, c in enumerate(_byte_alphabet())}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in tokenizer.get_vocab(with_added_tokens=False).items()
             if token not in special}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return TokenIds(tokenizer, rank_engine(tokenizer))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document: all but the first are full."""
    if length <= capacity:
        return [0]
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``tokenizer`` is the path of a tokenizer file on the executors; without it they look up the installed public one.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = token_ids(tokenizer or default_tokenizer())
        for batch in batches:
            for first, last in bounded(batch["text"]):
                out = []
                for doc_id, text in zip(batch["doc_id"].iloc[first:last], batch["text"].iloc[first:last]):
                    ids = (tokens.ids(text) if isinstance(text, str) else b"") + end
                    starts = cut_points(len(ids) // 4, capacity)
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                        out.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, stock: list[tuple[int, int]]) -> dict[int, int]:
    """The combination of lengths (with their numbers) that fills ``room`` best, from ``stock`` in falling order of length."""
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in stock:
        most = min(count, room // length)
        if not most:
            continue
        steps.append((length, sums))
        left, copies = most, 1
        while left:
            take = min(copies, left)
            sums |= (sums << (take * length)) & mask
            left -= take
            copies *= 2
        if sums >> room & 1:
            break
    rest, used = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> rest & 1:
            rest -= length
            used[length] = used.get(length, 0) + 1
    return used


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan rows (``length``, first rank, end rank, number in each bin, first bin, offset in the bin)."""
    stock = {k: v for k, v in sorted(histogram.items(), reverse=True) if v}
    taken = dict.fromkeys(stock, 0)
    plan, bins = [], 0
    while stock:
        longest = next(iter(stock))
        stock[longest] -= 1
        mix = fullest(capacity - longest, [(k, v) for k, v in stock.items() if v])
        stock[longest] += 1
        mix[longest] = mix.get(longest, 0) + 1
        times = min(stock[k] // n for k, n in mix.items())
        offset = 0
        for length, n in sorted(mix.items(), reverse=True):
            plan.append((length, taken[length], taken[length] + n * times, n, bins, offset))
            taken[length] += n * times
            stock[length] -= n * times
            offset += n * length
            if not stock[length]:
                del stock[length]
        bins += times
    return plan


def assign(pieces: DataFrame, capacity: int = 1024, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a staged table of pieces."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = 1 + sum(histogram.values()) // slot_rows
    plan = minimum_slack(histogram, capacity)
    dealt = pieces.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(slots)))
    counts = dealt.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage_table(counts.select("length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    own = Window.partitionBy("length", "_slot").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(bases, ["length", "_slot"]).withColumn(
        "_rank", F.col("_base") + F.col("_own") - 1)
    # At most a few rows per length, and at most ``capacity`` lengths: small enough to broadcast at any corpus size.
    table = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "_length long, _from long, _to long, _each long, _bin long, _at long")
    at = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from"))
                       & (F.col("_rank") < F.col("_to"))).select(
        *pieces.columns, (F.col("_bin") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """One row per piece with its place: ``sequence_id`` and ``offset``."""
    return assign(stage_table(tokenize(docs, tokenizer, capacity), "pieces"), capacity)
