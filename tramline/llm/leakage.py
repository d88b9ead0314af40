"""Test items inside training documents: MinHash containment search in size partitions, verified by exact shingles and words.

The containment of an item in a document is the chance that the item's least shingle, by a random order, is in the document.
So an item is kept as least shingles: each stretch of its shingles that a passage of the wanted length must cover in full has
its least one in the sketch, under as many orders as the item's size partition has.  Only the sketches are indexed.  Documents
are never sketched, only probed once, whatever their length and however many items there are: a stretch of the document that
holds as many of an item's least shingles as a true case must leave is a candidate, and meets the item's whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import BROADCAST_BYTES, cut, hot_keys, skew_join

#: Words of a shingle. Not the usual five: items count when up to a quarter of their words were changed, one by one,
#: after which few runs of five unchanged words need be left.
SHINGLE = 3
#: One true case in so many may be lost to the threshold of its size partition.
MISSED = 5000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Markup of any length: what opens like a tag up to its end, and character references.
TAG = re.compile(r"<[/!?]?[a-zA-Z-][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
WORD = re.compile(r"\w+")


def _fold_table() -> dict[int, object]:
    """Characters to their base letters, apostrophes to blanks, so that accents and quote marks don't count."""
    table: dict[int, object] = {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).casefold()) if not unicodedata.combining(c))
        if base != chr(code):
            table[code] = base
    table |= {code: None for code in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}
    return table


FOLD = _fold_table()
ODD = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\ufeff_]")


def _plain(text: str) -> str:
    if "<" in text or "&" in text:
        text = TAG.sub(" ", text)
    text = text.lower()
    return text if text.isascii() and "_" not in text or not ODD.search(text) else unicodedata.normalize("NFC", text).translate(FOLD).replace("_", " ")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, accents, markup, quote marks, line breaks and spacing."""
    return [w if w.isascii() else w.translate(FOLD) for w in WORD.findall(_plain(text))] if text else []


class _Numbers(dict):
    """Lower-case word -> number of the word without accents; the same in every process."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[w] = xxhash.xxh3_64_intdigest(w if w.isascii() else w.translate(FOLD))
        return n


NUMBERS: list[_Numbers] = []


def _hashed(text: str | None) -> np.ndarray:
    """One number per word of the text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    if not NUMBERS:
        NUMBERS.append(_Numbers())
    ws = WORD.findall(_plain(text))
    return np.fromiter(map(NUMBERS[0].__getitem__, ws), dtype=np.uint64, count=len(ws))


def _shingles(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    if len(h) < width:
        return h[:0]
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            out = out * MIX + h[k : len(h) - width + 1 + k]
        return out ^ (out >> np.uint64(29))


def _sketch(sh: np.ndarray, run: int) -> set[int]:
    """Places in the item of the least shingles: one per stretch of run - SHINGLE + 1, under as many orders as its size class has.

    Class k holds items of 2^k to 2^(k+1) shingles.  One order finds every verbatim run; for items whose words were changed
    one by one no stretch need be whole, so six orders raise the number of least shingles, and two more for each halving of
    the number of stretches below 64.
    """
    width = run - SHINGLE + 1
    size = max(1, len(sh)).bit_length() - 1
    orders = 6 + 2 * max(0, 6 - size)
    picks: set[int] = set()
    with np.errstate(over="ignore"):
        for o in range(orders):
            v = (sh + np.uint64(o) * MIX) * (MIX + np.uint64(2 * o))
            v ^= v >> np.uint64(31)
            if len(v) <= width:
                picks.add(int(v.argmin())) if len(v) else None
            else:
                picks.update((np.lib.stride_tricks.sliding_window_view(v, width).argmin(axis=1) + np.arange(len(v) - width + 1)).tolist())
    return picks


def _common_in_order(item: np.ndarray, part: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole machine words of bits."""
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        masks[w] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in part.tolist():
        hit = masks.get(w)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(item) - bin(row).count("1")


def _longest_run(item: np.ndarray, part: np.ndarray) -> int:
    """Most consecutive words that item and part share."""
    at: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(item.tolist()):
        at[w].append(i)
    best, last = 0, {}
    for w in part.tolist():
        now = {}
        for i in at.get(w, ()):
            now[i] = last.get(i - 1, 0) + 1
            if now[i] > best:
                best = now[i]
        last = now
    return best


def _need(picks: list[int], size: int, words: int, run: int, share: float) -> int:
    """Sketched shingles that a true case leaves in one place; over the number of sketched ones it is the containment asked for.

    A whole run leaves those in it, and the run that has fewest counts.  Words changed one by one leave at least a share of all
    shingles, each of which the orders, being random, have put in the sketch as likely as any other: the number is one that
    fewer than one such case in MISSED falls short of.
    """
    there = np.zeros(max(size, 1), dtype=np.int64)
    there[picks] = 1
    width = min(run, words) - SHINGLE + 1
    total = np.concatenate([[0], np.cumsum(there)])
    in_run = int((total[width:] - total[:-width]).min()) if size >= width > 0 else 1
    intact, chance, missed, left = max(0, size - SHINGLE * int((1 - share) * words)), len(picks) / max(size, 1), 0.0, 0
    while left < intact:
        missed += math.comb(intact, left) * chance**left * (1 - chance) ** (intact - left)
        if missed > 1 / MISSED:
            break
        left += 1
    return max(1, min(in_run, left))


def indexed_items(items: DataFrame, run: int, share: float) -> DataFrame:
    """(key, item, place, words, need): one row per sketched shingle of items(item, h), h the numbers of the item's words as bytes."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for item, h in zip(b["item"], b["h"]):
                h = np.frombuffer(h, dtype=np.uint64)
                sh = _shingles(h)
                if not len(sh):
                    continue
                picks = sorted(_sketch(sh, run))
                need = _need(picks, len(sh), len(h), run, share)
                out += [(int(k), item, p, len(h), need) for k, p in zip(sh[picks].view(np.int64), picks)]
            if out:
                yield pd.DataFrame(out, columns=["key", "item", "place", "words", "need"])

    return items.mapInPandas(sketch, "key bigint, item bigint, place int, words int, need int")


def _joint_shingles(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of texts one after another, which of them lie in one text); ends: where each text's words end."""
    inside = np.ones(max(len(h) - SHINGLE + 1, 0), dtype=bool)
    for k in range(1, SHINGLE):
        at = ends - k
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return _shingles(h), inside


def _candidates(docs: list, ends: np.ndarray, h: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray, words: np.ndarray, need: np.ndarray) -> list[tuple]:
    """(doc, item, part): the stretches of documents' words that may hold an item, from all hits.

    Per hit: the document's place among docs, the item, where the item would begin in it by that hit, and the item's words and
    need.  Hits of an item whose begins lie close together are of one stretch.
    """
    order = np.lexsort((begin, item, doc))
    doc, item, begin, words, need = doc[order], item[order], begin[order], words[order], need[order]
    slack = np.maximum(4, words // 8)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    good = last - first + 1 >= need[first]
    first, last = first[good], last[good]
    d = doc[first]
    start = np.concatenate([[0], ends[:-1]])[d]
    lo = start + np.maximum(0, begin[first] - slack[first])
    hi = np.minimum(ends[d], start + begin[last] + words[first] + slack[first])
    return [(docs[x], i, h[y:z].tobytes()) for x, i, y, z in zip(d.tolist(), item[first].tolist(), lo.tolist(), hi.tolist())]


#: part: the numbers of the words, eight bytes each.
PARTS = "doc_id bigint, item bigint, part binary"
#: Words of documents that are probed together.
TOGETHER = 1 << 20


def _probed(texts: DataFrame, given) -> DataFrame:
    """PARTS of documents probed with an index that every task holds."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, last, item, place, words, need = given.value
        low = np.uint64((1 << 20) - 1)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[keys & low] = True  # most shingles are in no item; one look tells

        def found(docs: list, hs: list[np.ndarray]) -> pd.DataFrame | None:
            h, ends = np.concatenate(hs), np.cumsum([len(x) for x in hs])
            sh, inside = _joint_shingles(h, ends)
            maybe = np.flatnonzero(seen[sh & low] & inside)
            spot = np.searchsorted(keys, sh[maybe])
            spot[spot == len(keys)] = 0
            met = keys[spot] == sh[maybe]
            hits, spot = maybe[met], spot[met]
            if not len(hits):
                return None
            uses = last[spot] - first[spot]
            use = np.repeat(first[spot] - np.cumsum(uses) + uses, uses) + np.arange(uses.sum())
            doc = np.searchsorted(ends, hits, side="right")
            begin = np.repeat(hits - np.concatenate([[0], ends[:-1]])[doc], uses) - place[use]
            rows = _candidates(docs, ends, h, np.repeat(doc, uses), item[use], begin, words[use], need[use])
            return pd.DataFrame(rows, columns=["doc_id", "item", "part"]) if rows else None

        for b in batches:
            docs, hs, size = [], [], 0
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                docs.append(doc)
                hs.append(_hashed(text))
                size += len(hs[-1])
                if size >= TOGETHER:
                    out = found(docs, hs)
                    if out is not None:
                        yield out
                    docs, hs, size = [], [], 0
            out = found(docs, hs) if size and len(keys) else None
            if out is not None:
                yield out

    return texts.mapInPandas(probe, PARTS)


def _joined(texts: DataFrame, index: DataFrame) -> DataFrame:
    """PARTS of documents whose shingles meet an index too large for a task in a join by key; the hits meet the texts again.

    A document's shingles are rows of (key, document, place); keys that hold many of them are spread.
    """

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                h = _hashed(text)
                sh = _shingles(h).view(np.int64)
                if len(sh):
                    yield pd.DataFrame({"key": sh, "doc_id": doc, "copy": xxhash.xxh3_64_intdigest(text) >> 1, "at": np.arange(len(sh), dtype=np.int32)})

    shingles = texts.mapInPandas(spell, "key bigint, doc_id bigint, copy bigint, at int")
    keys = index.groupBy("key").agg(F.count("*").alias("uses"))
    met = cut(shingles.join(keys.select("key"), "key", "left_semi"))
    hits = skew_join(met, index, ["key"], hot_keys(met.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n"), "n")
    begun = hits.groupBy("doc_id", "copy", "item").agg(F.sort_array(F.collect_list(F.col("at") - F.col("place"))).alias("begin"), F.first("words").alias("words"), F.first("need").alias("need")).where(F.size("begin") >= F.col("need"))
    per = begun.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item", "begin", "words", "need")).alias("found"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, copy, text, found in zip(b["doc_id"], b["copy"], b["text"], b["found"]):
                if xxhash.xxh3_64_intdigest(text) >> 1 != copy:
                    continue
                h, n = _hashed(text), [len(f["begin"]) for f in found]
                spread = lambda c: np.repeat([f[c] for f in found], n)  # noqa: B023, E731
                out += _candidates([doc], np.array([len(h)]), h, np.zeros(sum(n), dtype=np.int64), spread("item"), np.concatenate([np.asarray(f["begin"]) for f in found]), spread("words"), spread("need"))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item", "part"])

    return texts.join(per, "doc_id").mapInPandas(parts, PARTS)


def _holds(items: list[np.ndarray], parts: list[np.ndarray], run: int, share: float) -> list[int]:
    """Places of the items that their part holds.

    As many of the item's shingles must be in the part as a whole run leaves, or as many single changes as there may be.  Then
    a shingle of `run` words that both have tells a run, else `share` of the words must come in order.
    """
    spelled = []
    for texts in (items, parts):
        h = np.concatenate(texts)
        spelled += [_shingles(h).tolist(), _shingles(h, run).tolist(), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).tolist()]
    short_i, long_i, at_i, short_p, long_p, at_p = spelled
    out = []
    for k, (x, y, p, q) in enumerate(zip(at_i, at_i[1:], at_p, at_p[1:])):
        n = y - x
        least = min(min(run, n) - SHINGLE + 1, n - SHINGLE + 1 - SHINGLE * int((1 - share) * n))
        held = set(short_p[p : max(p, q - SHINGLE + 1)])
        if sum(map(held.__contains__, short_i[x : max(x, y - SHINGLE + 1)])) < max(1, least):
            continue
        whole = not set(long_p[p : max(p, q - run + 1)]).isdisjoint(long_i[x : y - run + 1]) if n >= run else _longest_run(items[k], parts[k]) >= n
        if whole or _common_in_order(items[k], parts[k]) >= share * n:
            out.append(k)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12, share: float = 0.75, index_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id): documents that hold at least `run` consecutive words of the item's text, or at least `share` of
    its words in order within a stretch about as long as the item; items shorter than `run` words only count whole.

    An index of up to `index_rows` sketched shingles (some 40 bytes each) goes to every task, and the documents are read once
    and not shuffled; a larger one meets the documents' shingles in a join.  Candidate stretches then meet the items' whole
    texts.  Each document gives one row per item however often it holds it; copies of a document give rows of their own, and
    a repeated doc_id with the same text gives one.  Null and empty texts, and items of fewer words than a shingle has, give no
    rows; further columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    listed = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "item": [(xxhash.xxh3_64_intdigest(t, seed=i % (1 << 63)) >> 1) for i, t in zip(b["item_id"], b["text"])], "h": [_hashed(t).tobytes() for t in b["text"]]})

    # `item` tells an item's text apart from another text of the same id.
    held = cut(listed.mapInPandas(number, "item_id bigint, item bigint, h binary"))
    index = cut(indexed_items(held, run, share))
    if index.count() <= index_rows:
        rows = index.toPandas()
        rows = rows.iloc[np.lexsort((rows["place"], rows["item"], rows["key"].to_numpy().astype(np.int64).view(np.uint64)))]
        keys, first = np.unique(rows["key"].to_numpy().astype(np.int64).view(np.uint64), return_index=True)
        last = np.append(first[1:], len(rows)).astype(np.int64) if len(rows) else first
        given = spark.sparkContext.broadcast((keys, first, last, *(rows[c].to_numpy().astype(np.int64) for c in ("item", "place", "words", "need"))))
        found = _probed(texts, given)
    else:
        found = _joined(texts, index)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                good = _holds(*([np.frombuffer(x, dtype=np.uint64) for x in part[c]] for c in ("h", "part")), run, share)
                if good:
                    yield part.iloc[good][["doc_id", "item_id"]]

    size = held.agg(F.sum(F.length("h"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    if small:
        met = found.join(F.broadcast(held), "item")
    else:
        found = cut(found)
        met = skew_join(found, held, ["item"], hot_keys(found.groupBy("item").agg(F.count("*").alias("n")), ["item"], "n"), "n")
    return met.select("doc_id", "item_id", "h", "part").mapInPandas(verify, "doc_id bigint, item_id bigint").distinct()


def leak_report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, items, leaked, documents): per suite how many of its items leaked and into how many documents."""
    found = cut(found)
    per = items.select("item_id", "suite").join(found.groupBy("item_id").agg(F.count("*").alias("docs")), "item_id", "left")
    docs = items.select("item_id", "suite").join(found, "item_id").select("suite", "doc_id").distinct().groupBy("suite").agg(F.count("*").alias("documents"))
    return per.groupBy("suite").agg(F.count("*").alias("items"), F.count("docs").alias("leaked")).join(docs, "suite", "left").fillna(0, ["documents"])
