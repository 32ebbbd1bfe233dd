"""Exact removal of repeated byte strings (operator 10): ranks of sampled suffixes at growing lengths.

Every string of ``length`` bytes that starts in two places, in one document or two, is found; each byte it covers is
removed. Plain prefix doubling sorts a row for each byte of the corpus in every round, which no disk budget here allows; so the suffixes are sampled by
content, and the result is still exact to the byte:

1. *Sampled suffixes.* A window of ``length`` bytes has as its anchor the first smallest hash of 8 bytes in its first ``REACH`` part. Equal windows
   have equal anchors at equal places, and the bytes from the anchor that all of them hold (its gram) lie inside the window. Windows with one
   anchor are neighbours, so one row per anchor describes them all.
2. *Ranks at growing lengths.* First rank of an anchor: its gram. Unique ones drop out: none of their windows is repeated. Second rank: all that
   its windows hold together. Past the threshold: if that occurs twice at the same place, all windows of the anchor are repeated. As equal strings have
   equal hashes, the task that holds the text computes the ranks, and Spark groups them; no rank pairs need to be joined.
3. *Edges.* Anchors left over lie at the ends of repeats, where only some of their windows are repeated. Their windows are ranked in blocks of
   ``BLOCK``, then one by one. A place that is already settled still takes part once per distinct string, because
   an edge may match it.

Ranks are hashes of the strings (equal strings have equal ranks); what decides a removal uses 128 bits. Groups are only ever counted, never
gathered, so a passage that half of the corpus shares is no special case. Per document, marks are gathered (bounded by its length).

Defined results: a null text is empty; texts shorter than ``length`` are kept whole; repeated rows count as occurrences of each other, so
all of them are removed; ``doc_id`` may be null or repeated, rows are told apart by a number given when they are staged; other columns are
not read by ``remove_repeats`` and are kept by ``dedup_passages``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from specledger.llm.words import CHUNK_BYTES, bounded
from specledger.session import drop_stages, stage_table

BLOCK = 16
REACH = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def window_anchors(data: bytes, reach: int) -> np.ndarray:
    """For each place, that of the first smallest hash among the ``reach`` places from it (short of places at the end)."""
    n = len(data)
    padded = data + bytes(8)
    grams = np.ndarray((n,), "<u8", padded, strides=(1,))
    mixed = grams * _MIX
    mixed ^= mixed >> np.uint64(29)
    low = ((mixed * _MIX) & _HIGH) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    return (low & ~_HIGH).astype(np.int64)


def _anchor_rows(length: int):
    reach = int(length * REACH)
    gram = length - reach + 1
    columns = ["rid", "a", "lo", "hi", "rank", "u0", "u1"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in bounded(batch["text"]):
                texts = [_bytes(t) for t in batch["text"].iloc[first:last]]
                data = b"".join(texts)
                if len(data) < length:
                    continue
                places = window_anchors(data, reach)
                parts, start = [], 0
                for rid, text in zip(batch["rid"].iloc[first:last], texts):
                    if len(text) >= length:
                        own = places[start:start + len(text) - length + 1] - start
                        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
                        lo = np.concatenate(([0], cut))
                        hi = np.concatenate((cut - 1, [len(own) - 1]))
                        a = own[lo]
                        rank = np.fromiter((xxhash.xxh3_64_intdigest(text[x:x + gram]) for x in a.tolist()), np.uint64, len(a))
                        # The place of the anchor in the string is part of the rank.
                        whole = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[x:y + length], seed=z - x) for x, y, z in zip(
                            lo.tolist(), hi.tolist(), a.tolist())]), "<i8").reshape(-1, 2)
                        parts.append((np.full(len(a), rid), a, lo, hi, rank.view(np.int64), whole[:, 0], whole[:, 1]))
                    start += len(text)
                if parts:
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(columns, zip(*parts))})

    return rows


def repeated_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def cover(starts: np.ndarray, ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the closed ranges ``starts``..``ends``."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        a, b = int(starts[k]), int(ends[k]) + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


BLANKS = " \t\n\x0b\x0c\r"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(data: bytes, spans: list[tuple[int, int]], keep_text: bool) -> dict:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    rest = b"".join(kept)
    out = {"n_bytes": len(data), "n_removed": len(data) - len(rest), "n_spans": len(spans), "kept_sha256": hashlib.sha256(rest).hexdigest()}
    if keep_text and spans:
        # Texts that stay whole are not carried along. A span may cut a character: its remaining bytes go as well.
        out["kept"] = rest.decode("utf-8", "ignore")
    return out


_ARRAYS = ["done_lo", "done_hi"]
_SECOND = (f"kind int, rid long, {RESULT}, kept string, text string, done_lo array<long>, done_hi array<long>,"
           " a long, lo long, hi long, rep boolean, context binary")


def _settle(length: int, keep_text: bool):
    """Documents without open anchors are finished; the others go on, and their open anchors bring the bytes around them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in bounded(batch["text"], CHUNK_BYTES // 4):
                out = []
                for r in batch.iloc[first:last].itertuples(index=False):
                    data = _bytes(r.text)
                    kinds, a, lo, hi = (np.asarray(x if x is not None else [], np.int64) for x in (r.kinds, r.as_, r.los, r.his))
                    done = kinds != 1
                    for k in np.flatnonzero(kinds >= 1).tolist():
                        out.append({"kind": 1, "rid": r.rid, "a": a[k], "lo": lo[k], "hi": hi[k], "rep": bool(kinds[k] == 2),
                                    "context": data[lo[k]:hi[k] + length]})
                    if (kinds == 1).any():
                        out.append({"kind": 2, "rid": r.rid, "text": r.text, "done_lo": lo[done], "done_hi": hi[done]})
                    else:
                        out.append({"kind": 0, "rid": r.rid} | _result(data, cover(lo[done], hi[done], length), keep_text))
                names = [field.split()[0] for field in _SECOND.split(",")]
                yield pd.DataFrame({n: pd.Series([row.get(n) for row in out], dtype=object) for n in names})

    return rows


def block_range(a: int, lo: int, hi: int, b: int) -> tuple[int, int]:
    """First and last window of block ``b`` of an anchor: starts ``BLOCK * b`` to ``BLOCK * b + BLOCK - 1`` bytes before it."""
    return max(lo, a - BLOCK * b - BLOCK + 1), min(hi, a - BLOCK * b)


def _block_rows(length: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for b in range((r.a - r.hi) // BLOCK, (r.a - r.lo) // BLOCK + 1):
                    first, last = block_range(r.a, r.lo, r.hi, b)
                    # What all windows of the whole block have in common, and all that these windows hold.
                    inner = r.a - BLOCK * b - r.lo
                    shared = xxhash.xxh3_64_intdigest(r.context[inner:inner + length - BLOCK + 1], seed=b)
                    whole = xxhash.xxh3_128_digest(r.context[first - r.lo:last - r.lo + length], seed=(b << 16) | (r.a - last))
                    out.append((r.rid, r.a, b, first, last, r.rep, shared, *np.frombuffer(whole, "<i8").tolist()))
            got = pd.DataFrame(out, columns=["rid", "a", "b", "first", "last", "rep", "shared", "w0", "w1"])
            got["shared"] = got["shared"].astype("uint64").astype("int64")
            yield got

    return rows


def _single_rows(length: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid, place, digests = [], [], []
            for r in batch.itertuples(index=False):
                for b in r.blocks:
                    first, last = block_range(r.a, r.lo, r.hi, int(b))
                    for p in range(first, last + 1):
                        rid.append(r.rid)
                        place.append(p)
                        digests.append(xxhash.xxh3_128_digest(r.context[p - r.lo:p - r.lo + length]))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"rid": np.array(rid, np.int64), "p": np.array(place, np.int64), "d0": both[:, 0], "d1": both[:, 1]})

    return rows


def _finish(length: int, keep_text: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lo, hi = (np.concatenate([np.asarray(x if x is not None else [], np.int64) for x in pair])
                          for pair in ((r.done_lo, r.los), (r.done_hi, r.his)))
                out.append({"rid": r.rid, "kept": None} | _result(_bytes(r.text), cover(lo, hi, length), keep_text))
            yield pd.DataFrame(out, columns=["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def _by_row(marks: DataFrame, **lists: str) -> DataFrame:
    """Marks of a row as one array per column."""
    gathered = marks.groupBy("rid").agg(F.collect_list(F.struct(*lists.values())).alias("m"))
    return gathered.select("rid", *[F.col("m")[c].alias(n) for n, c in lists.items()])


def repeats(numbered: DataFrame, length: int, keep_text: bool = False) -> DataFrame:
    """Result columns (and ``kept``, the rest of texts that lose something) per ``rid`` of a staged table with ``rid`` and ``text``."""
    if length < 2 * BLOCK:
        raise ValueError(f"length must be at least {2 * BLOCK}")
    anchors = stage_table(numbered.select("rid", "text").mapInPandas(
        _anchor_rows(length), "rid long, a long, lo long, hi long, rank long, u0 long, u1 long"), "anchors")
    grams = stage_table(repeated_ranks(anchors, ["rank"]), "grams")
    alive = stage_table(anchors.join(grams, "rank", "left_semi"), "alive")
    drop_stages(anchors, grams)

    twice = stage_table(alive.groupBy("u0", "u1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "a")).alias("rep"))
                        .filter("n > 1").drop("n"), "repeated-wholes")
    state = stage_table(alive.join(twice, ["u0", "u1"], "left").select(
        "rid", "a", "lo", "hi", "rank", (F.struct("rid", "a") == F.col("rep")).alias("is_rep")), "state")
    drop_stages(alive, twice)
    open_ranks = stage_table(state.filter("is_rep is null").select("rank").distinct().withColumn("wanted", F.lit(True)), "open-ranks")
    # 0: settled, 1: open, 2: settled and in the comparison for its string.
    marks = state.filter("is_rep is null or not is_rep").select(
        "rid", F.when(F.col("is_rep").isNull(), 1).otherwise(0).alias("kind"), "a", "lo", "hi").unionByName(
        state.filter("is_rep").join(open_ranks, "rank", "left").select(
            "rid", F.when(F.col("wanted"), 2).otherwise(0).alias("kind"), "a", "lo", "hi"))
    marked = numbered.select("rid", "text").join(_by_row(marks, kinds="kind", as_="a", los="lo", his="hi"), "rid", "left")
    second = stage_table(marked.mapInPandas(_settle(length, keep_text), _SECOND), "second")
    drop_stages(state, open_ranks)

    contexts = second.filter("kind = 1").select("rid", "a", "lo", "hi", "rep", "context")
    blocks = stage_table(contexts.mapInPandas(
        _block_rows(length), "rid long, a long, b int, first long, last long, rep boolean, shared long, w0 long, w1 long"), "blocks")
    live = stage_table(blocks.join(stage_table(repeated_ranks(blocks, ["shared"]), "shared"), "shared", "left_semi"), "live-blocks")
    whole = stage_table(live.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "a", "b")).alias("one"))
                        .filter("n > 1").drop("n"), "repeated-blocks")
    judged = stage_table(live.join(whole, ["w0", "w1"], "left").withColumn("full", F.col("one").isNotNull()), "judged-blocks")
    drop_stages(blocks, live, whole)
    unsure = judged.filter("not full and not rep")
    shared = stage_table(unsure.select("shared").distinct(), "open-blocks")
    stand_in = judged.filter((~F.col("full") & F.col("rep")) | (F.col("one") == F.struct("rid", "a", "b")))
    expand = unsure.select("rid", "a", "b").unionByName(stand_in.join(shared, "shared", "left_semi").select("rid", "a", "b"))
    listed = expand.groupBy("rid", "a").agg(F.collect_list("b").alias("blocks"))
    singles = stage_table(contexts.join(listed, ["rid", "a"]).select("rid", "a", "lo", "hi", "context", "blocks").mapInPandas(
        _single_rows(length), "rid long, p long, d0 long, d1 long"), "windows")
    hits = singles.join(stage_table(repeated_ranks(singles, ["d0", "d1"]), "repeated-windows"), ["d0", "d1"], "left_semi")
    ranges = judged.filter("full").select("rid", F.col("first").alias("lo"), F.col("last").alias("hi")).unionByName(
        hits.select("rid", F.col("p").alias("lo"), F.col("p").alias("hi")))
    rest = second.filter("kind = 2").select("rid", "text", *_ARRAYS).join(_by_row(ranges, los="lo", his="hi"), "rid", "left").mapInPandas(
        _finish(length, keep_text), f"rid long, {RESULT}, kept string")
    return second.filter("kind = 0").select("rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").unionByName(rest)


def number_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Staged rows with a number each. It is stored, so every later read sees the same one."""
    return stage_table(docs.select(F.monotonically_increasing_id().alias("rid"), *columns), "numbered")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``text`` (what is left) of every row.

    A removed run may begin or end inside a character; the rest of such a character is counted and hashed, but left out of ``text``.
    """
    numbered = number_rows(docs, "doc_id", "text")
    return numbered.join(repeats(numbered, length, keep_text=True), "rid").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
        F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def dedup_passages(docs: DataFrame, length: int) -> DataFrame:
    """The documents without repeated strings; texts of which nothing but blanks is left go. ``n_chars``, if present, is counted anew."""
    # The document goes into one column, so that no name of its own clashes.
    numbered = number_rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = repeats(numbered.select("rid", F.col("doc.text").alias("text")), length, keep_text=True)
    cut = F.col("n_removed") > 0
    out = numbered.join(kept, "rid").filter(~cut | (F.trim("kept", F.lit(BLANKS)) != ""))
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("doc.n_chars")).cast("long")
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
