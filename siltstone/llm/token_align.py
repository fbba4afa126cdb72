"""Alignment of two tokenizers over the same texts.

Both sides cut ``space + text``, so each token covers a range of the same bytes. A batch of documents is laid out on one
line of byte offsets; ``merge_asof``, keyed by document, finds for each token start the token of the other side that
covers it. Two ranges overlap exactly when one of them covers the start of the other, so the union of both directions
has every overlapping pair of tokens once. Offsets where tokens of both sides end cut the tokens into groups.

The links of each document are written once, as packed id pairs with their number. Corpus-wide counts of the pairs are a
plain aggregate over that table. Back at the documents, pairs are looked up by a broadcast join of the most frequent
ones (fewer than HEAD) and by a shuffled join of all others, which have no hot keys as the frequent ones are gone.

Defined cases: texts that are null or empty, and texts that the tokens of a side don't spell byte for byte (as with
U+2581 in the text), have no tokens: all figures 0, groups ''. A very long text is one chunk of its own. Repeated rows
and shared or null ids are rows of their own, each counted. Of equal counts for one B id, all are its highest. An empty
table gives no rows. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The split of byte-level BPE; the file names it only as its ByteLevel rule. A fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a chunk, and fewer pairs than these are broadcast (24 bytes each).
CHUNK, HEAD = 1_000_000, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in prints else next(others)): b for b in range(256)}


class ByteSide:
    """Byte-level BPE of a tokenizer file, with its ids as merge ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.spelling = [b""] * (max(max(ranks.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1)
        for raw, i in ranks.items():
            self.spelling[i] = raw
        self._tokens = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._tokens.encode_ordinary(" " + t) for t in texts]


class PieceSide:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._pieces.id_to_piece(i) for i in range(self._pieces.get_piece_size())]
        self.spelling = [bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)


@cache
def side(path: str) -> ByteSide | PieceSide:
    """Loaded once in each Python worker."""
    return ByteSide(path) if path.endswith(".json") else PieceSide(path)


def _spells(ids: list[int], spelling: list[bytes], raw: bytes) -> bool:
    return b"".join(map(spelling.__getitem__, ids)) == raw


def _tokens(ids: list[list[int]], spelling: list[bytes]) -> pd.DataFrame:
    """All tokens of some documents on one line of byte offsets."""
    size = np.fromiter(map(len, spelling), np.int64, len(spelling))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
    end = np.cumsum(size[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), list(map(len, ids))), "start": end - size[flat], "end": end, "id": flat, "at": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all overlapping tokens."""
    over_a = pd.merge_asof(a[["doc", "start", "at"]], b[["doc", "start", "at"]], on="start", by="doc", suffixes=("_a", "_b"))
    over_b = pd.merge_asof(b[["doc", "start", "at"]], a[["doc", "start", "at"]], on="start", by="doc", suffixes=("_b", "_a"))
    both = [over_a, over_b[a["start"].to_numpy()[over_b["at_a"]] != over_b["start"]]]  # equal starts are in the first
    return np.concatenate([x["at_a"] for x in both]), np.concatenate([x["at_b"] for x in both])


def group_numbers(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token, and where groups end."""
    ends = np.intersect1d(a["end"], b["end"], assume_unique=True)
    return np.searchsorted(ends, a["end"]), np.searchsorted(ends, b["end"]), ends


def spell_groups(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups in order, and where each token's part ends in it (A and B tokens in order of the text)."""
    n = len(a_ids) + len(b_ids)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)
    b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_at[np.flatnonzero(np.diff(a_group, append=-1))]] = ord("|")
    mark[b_at[np.flatnonzero(np.diff(b_group, append=-1))]] = ord(";")
    width = len(str(int(ids.max(initial=0))))
    digits = np.empty((n, width + 1), np.uint8)
    rest = ids.copy()
    for k in range(width - 1, -1, -1):
        digits[:, k] = rest % 10 + ord("0")
        rest //= 10
    digits[:, width] = mark
    n_digits = np.searchsorted(10 ** np.arange(1, width + 1), ids, side="right") + 1
    shown = np.arange(width + 1) >= (width - n_digits)[:, None]
    return digits[shown].tobytes(), np.cumsum(n_digits + 1)


def align_texts(texts: list[str | None], a_path: str, b_path: str) -> dict:
    """Figures of each text, its groups as bytes, and its links as sorted packed pairs with their number."""
    a_side, b_side = side(a_path), side(b_path)
    some = [i for i, t in enumerate(texts) if t]
    said = [texts[i] for i in some]
    pairs = [(i, x, y) for i, t, x, y in zip(some, said, a_side.encode(said), b_side.encode(said), strict=True) if _spells(x, a_side.spelling, raw := b" " + t.encode()) and _spells(y, b_side.spelling, raw)]
    rows = np.array([p[0] for p in pairs], np.int64)
    a, b = _tokens(list(map(itemgetter(1), pairs)), a_side.spelling), _tokens(list(map(itemgetter(2), pairs)), b_side.spelling)
    a_group, b_group, ends = group_numbers(a, b)
    at_a, at_b = overlaps(a, b)
    span = len(a_side.spelling) * len(b_side.spelling)
    linked = a["doc"].to_numpy()[at_a] * span + a["id"].to_numpy()[at_a] * len(b_side.spelling) + b["id"].to_numpy()[at_b]
    packed, times = np.unique(linked, return_counts=True)
    text, text_end = spell_groups(a["id"].to_numpy(), b["id"].to_numpy(), a_group, b_group)
    out = {"n_a": np.zeros(len(texts), np.int64), "n_b": np.zeros(len(texts), np.int64), "n_groups": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64)}
    bounds = np.arange(len(rows))
    for name, docs in (("n_a", a["doc"]), ("n_b", b["doc"]), ("n_links", a["doc"].to_numpy()[at_a])):
        out[name][rows] = np.bincount(docs, minlength=len(rows))
    last_group = np.searchsorted(ends, np.concatenate([[0], a["end"].to_numpy()[np.cumsum(out["n_a"][rows]) - 1]]), side="right") if len(rows) else np.zeros(1, np.int64)
    out["n_groups"][rows] = np.diff(last_group)
    cut = np.concatenate([[0], text_end[np.cumsum(out["n_a"][rows] + out["n_b"][rows]) - 1]]) if len(rows) else np.zeros(1, np.int64)
    out["groups"] = [b""] * len(texts)
    for i, s, e in zip(rows, cut[:-1], cut[1:], strict=True):
        out["groups"][i] = text[s : e - 1]
    at = np.zeros(len(texts) + 1, np.int64)
    at[rows + 1] = np.diff(np.searchsorted(packed, np.append(bounds, len(rows)) * span))
    return out | {"packed": packed % span, "times": times, "links_at": np.cumsum(at)}


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, whole_groups: bool = True) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups (text, or its sha256 with ``whole_groups`` off; '' without
    tokens) and links, an array of (pair, n) where pair is A id * number of B ids + B id."""
    wide = len(side(a_path).spelling) * len(side(b_path).spelling) >= 1 << 31
    link = pa.struct([("pair", pa.int64() if wide else pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltstone.llm.words import chunks

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, held in chunks(texts, CHUNK):
                x = align_texts(texts[first : first + len(held)], a_path, b_path)
                groups = [g.decode() if whole_groups or not g else hashlib.sha256(g).hexdigest() for g in x["groups"]]
                links = pa.ListArray.from_arrays(pa.array(x["links_at"], pa.int32()), pa.StructArray.from_arrays([pa.array(x["packed"].astype(np.int64 if wide else np.int32)), pa.array(x["times"], pa.int32())], fields=list(link)))
                figures = [pa.array(x[n]) for n in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), *figures, pa.array(groups, pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:{'long' if wide else 'int'},n:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_b_ids: int, scratch: Scratch) -> DataFrame:
    """Each id pair with its number of links (total) and whether no pair of its B id has more (best). Written once."""
    counts = scratch.keep(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("total")), "counts")
    counts = counts.withColumn("b", F.col("pair") % n_b_ids)
    highest = counts.groupBy("b").agg(F.max("total").alias("most"))
    return scratch.keep(counts.join(highest, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best")), "pairs")


def with_pair_counts(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """Per _row: n_best and count_sum over the links. Pairs with many links are broadcast, others joined by a shuffle."""
    by_size = counts.groupBy(F.floor(F.log2("total")).cast("int").alias("log")).count().collect()  # one row for each power of two
    cut, kept = 64, 0
    for log, n in sorted(map(tuple, by_size), reverse=True):
        if kept + n > head:
            break
        cut, kept = log, kept + n
    frequent = F.floor(F.log2("total")) >= cut
    links = aligned.select("_row", F.inline("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum")]
    found = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
    if kept == sum(n for _, n in map(tuple, by_size)):
        return found.groupBy("_row").agg(*sums)
    rare = found.where("total is null").select("_row", "pair", "n").join(counts.where(~frequent).hint("merge"), "pair")
    parts = found.where("total is not null").groupBy("_row").agg(*sums).unionByName(rare.groupBy("_row").agg(*sums))
    return parts.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, head: int = HEAD) -> DataFrame:
    """Per document: its figures and the sha256 of its groups, with its links held against corpus-wide counts."""
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.keep(align(docs, a_path, b_path, whole_groups=False).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned, len(side(b_path).spelling), scratch)
    sums = with_pair_counts(aligned, counts, head)
    figures = aligned.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "_row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return figures.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
