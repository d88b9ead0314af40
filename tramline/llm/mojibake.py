"""Text garbled by a wrong decoding: which records, by which chain of encodings, and the original where it can be had.

Evidence is pooled: the words with characters beyond ASCII of all records are counted per source and field, and
expectation-maximization fits, per source, how often each chain of encodings occurs, and, per field, a character model of the
original text.  A record is then judged by the posterior of its own words under the chains.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import cut, hot_keys, maybe_broadcast, partitions

#: Chains: name -> steps of (codec the bytes were read with, codec they were written in), the last misreading first.
CHAINS = {
    "utf8 as cp1252": [("cp1252", "utf8")],
    "utf8 as latin1": [("latin1", "utf8")],
    "utf8 as cp1252 twice": [("cp1252", "utf8"), ("cp1252", "utf8")],
    "utf8 as latin1 twice": [("latin1", "utf8"), ("latin1", "utf8")],
    "utf8 as macroman": [("mac_roman", "utf8")],
    "utf8 as cp437": [("cp437", "utf8")],
    "utf8 as cp850": [("cp850", "utf8")],
    "utf8 as cp1251": [("cp1251", "utf8")],
    "utf8 as cp1250": [("cp1250", "utf8")],
    "cp850 as cp1252": [("cp1252", "cp850")],
    "macroman as cp1252": [("cp1252", "mac_roman")],
    "cp850 as latin1": [("latin1", "cp850")],
    "macroman as latin1": [("latin1", "mac_roman")],
}
NAMES = ["clean", *CHAINS, "lossy"]
K = len(NAMES)
UNIT = re.compile(r"[A-Za-z0-9'\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z0-9'\x80-\U0010ffff]*")
BUCKETS = 1 << 16
#: Share of garbled words a source is expected to have before any evidence, and how many words that expectation weighs.
PRIOR_GARBLED, PRIOR_WORDS = 0.05, 30.0
#: Weight of single characters behind pairs of them, and the count a character never seen has.
BACK, RARE = 10.0, 0.002
#: What a pair's count is lessened by, so that no word is its own evidence.
OWN = 1.5
#: Logarithm of how much rarer a word is for each character that stands unnaturally.
ODD = -5.0


def _undo(text: str, read: str, written: str) -> str | None:
    """One misreading undone; None where the text can't have come from it. Bytes cp1252 leaves open stand for themselves."""
    try:
        raw = text.encode(read)
    except UnicodeEncodeError:
        if read != "cp1252":
            return None
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                if ord(ch) not in (0x81, 0x8D, 0x8F, 0x90, 0x9D):
                    return None
                out.append(ord(ch))
        raw = bytes(out)
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def originals(word: str) -> list[str | None]:
    """What the word was under each chain of NAMES: itself if clean, None if the chain is impossible or changes nothing."""
    found: list[str | None] = [word]
    for steps in CHAINS.values():
        x: str | None = word
        for read, written in steps:
            x = _undo(x, read, written) if x is not None else None
            if x is not None and "utf8" in written and len(x) == 0:
                x = None
        found.append(None if x == word else x)
    found.append(word if "�" in word else None)
    return found


def _unnatural(word: str) -> int:
    """How many characters beyond ASCII stand where writing seldom puts them: signs between letters, letters against the word's case."""
    n = 0
    for i, c in enumerate(word):
        if c < "\x80" or c in "’·":
            continue
        before, after = word[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if c.isalpha() and unicodedata.category(c) != "Lm":
            n += c.isupper() and before.islower() or c.islower() and before.isupper() and i > 1 and word[i - 2].isupper() and not after.islower()
        else:
            n += before.isalpha() and after.isalpha()
    return n


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each pair of characters, of its first and of its second character, where each word's pairs begin), with the words' ends."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 2) - 1
    a, b = np.delete(codes, ends), np.delete(codes, ends - size - 1)
    return (a * 40503 + b * 30011 + (a >> 8) * 7) % BUCKETS, a % 4096, b % 4096, np.concatenate([[0], np.cumsum(size + 1)[:-1]])


class Model:
    """Character pairs by bucket: size is fixed, however much text it saw."""

    def __init__(self, pairs: dict[int, float]):
        self.pair = np.zeros(BUCKETS)
        self.first = np.zeros(4096)
        for k, v in pairs.items():
            if k < BUCKETS:
                self.pair[k] = v
            else:
                self.first[k - BUCKETS] = v
        self.total = max(self.first.sum(), 1.0)

    def logs(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word: pairs backed by single characters, as one never seen is hardly meant."""
        pair, first, second, begin = _grams(words)
        single = (self.first[second] + RARE) / (self.total + RARE * 4096)
        got = np.log((np.maximum(self.pair[pair] - OWN, 0.0) + BACK * single) / (self.first[first] + BACK))
        return np.add.reduceat(got, begin)


class Words:
    """What the words of a task were under each chain, and how likely that is; forgets when it holds too many."""

    def __init__(self, models: dict[str, Model], most: int = 100_000):
        self.models, self.most = models, most
        self.place: dict[tuple[str, str], int] = {}
        self.made: list[list[str | None]] = []
        self.chance = np.zeros((0, K))

    def at(self, tabs: list[str], words: list[str]) -> np.ndarray:
        """Rows of made and chance for the words."""
        if len(self.place) > self.most:
            self.place, self.made, self.chance = {}, [], np.zeros((0, K))
        new = [k for k in dict.fromkeys(zip(tabs, words)) if k not in self.place]
        if new:
            self.place |= {k: len(self.made) + i for i, k in enumerate(new)}
            made = [originals(w) for _, w in new]
            self.made += made
            self.chance = np.concatenate([self.chance, self._first(made, new) if not self.models else self._chances(made, new)])
        return np.fromiter((self.place[k] for k in zip(tabs, words)), dtype=np.int64, count=len(words))

    def _first(self, made: list, new: list) -> np.ndarray:
        """At the start only words that no chain through utf8 explains are taken for clean, plain words above all."""
        out = np.zeros((len(new), K))
        out[:, 0] = [0.0 if any(c is not None for c in m[1:10]) or m[-1] is not None else 1.0 if w.isalpha() else 0.3 for m, (_, w) in zip(made, new)]
        return out

    def _chances(self, made: list, new: list) -> np.ndarray:
        out = np.full((len(new), K), -1e9)
        odd: dict[str, float] = {}
        for tab, model in self.models.items():
            spots = [(u, i, c) for u, (m, (t, _)) in enumerate(zip(made, new)) if t == tab for i, c in enumerate(m[:-1]) if c is not None]
            if not spots:
                continue
            for _, _, c in spots:
                if c not in odd:
                    odd[c] = ODD * _unnatural(c)
            rows, cols, cands = zip(*spots)
            out[list(rows), list(cols)] = model.logs(list(cands)) + np.array([odd[c] for c in cands])
        for u, (_, w) in enumerate(new):
            if "�" in w:
                out[u, 0] -= 1e6
                out[u, K - 1] = 0.0
        return out


def _mixtures(column: pd.Series) -> np.ndarray:
    """A mixture per row; that before any evidence where there is none."""
    prior = np.array([1 - PRIOR_GARBLED, *[PRIOR_GARBLED / (K - 1)] * (K - 1)])
    return np.array([prior if m is None else np.maximum(np.asarray(m, dtype=float), 1e-7) for m in column]).reshape(len(column), K)


def garbled_rows(texts: DataFrame, rounds: int = 6) -> DataFrame:
    """(tab, row_id, chain, repaired): the rows of texts(tab, src, row_id, text) that went through a wrong decoding.

    chain is the likeliest one; repaired is the text with the affected words restored, null if none could be (characters
    that were replaced are lost).  Unusual but correct text gives no row, nor do null, empty and ASCII texts.  A null src is
    a source of its own.  Repeated rows come out as often as they are there; further columns are ignored.  Only character
    counts of fixed size, and the mixture per field, reach the driver; the mixture per source stays distributed.
    """
    rows = texts.select(F.coalesce("tab", F.lit("")).alias("tab"), F.coalesce("src", F.lit("")).alias("src"), "row_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[tuple, int] = defaultdict(int)
            for tab, src, text in zip(b["tab"], b["src"], b["text"]):
                for w in UNIT.findall(text):
                    n[tab, src, w] += 1
            if n:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["tab", "src", "word", "n"])

    words = cut(rows.select("tab", "src", "text").mapInPandas(split, "tab string, src string, word string, n long").groupBy("tab", "src", "word").agg(F.sum("n").alias("n")))
    # A word's rows of all sources lie together, so that what its chains make of it is worked out once a round; those of a
    # word that very many sources have are spread.
    hot = hot_keys(words.groupBy("tab", "word").agg(F.count("*").alias("m")), ["tab", "word"], "m")
    spread = words.join(F.broadcast(hot.select("tab", "word", F.ceil(F.col("m") / 20_000).alias("_salts"))), ["tab", "word"], "left")
    salt = F.pmod(F.xxhash64("src"), F.coalesce("_salts", F.lit(1)))
    words = cut(spread.repartition(partitions(texts.sparkSession), "tab", "word", salt).drop("_salts").sortWithinPartitions("tab", "word"))

    def step(models: dict[str, Model]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = Words(models)
            pairs: dict[str, np.ndarray] = {}
            mixes: dict[tuple[str, str], np.ndarray] = {}
            told = lambda: pd.DataFrame([(t, s, i, v) for (t, s), m in mixes.items() for i, v in enumerate(m.tolist()) if v > 1e-9], columns=["tab", "src", "i", "v"])
            for b in batches:
                at = held.at(b["tab"].tolist(), b["word"].tolist())
                post = held.chance[at]
                if models:
                    post = post + np.log(_mixtures(b["mix"]))
                    post = np.exp(post - post.max(axis=1, keepdims=True))
                    post /= post.sum(axis=1, keepdims=True)
                n = b["n"].to_numpy().astype(float)
                # Counts of a word grow with the root of its number, so that a few frequent words don't make the model.
                here, inverse = np.unique(at, return_inverse=True)
                weight = np.zeros((len(here), K))
                np.add.at(weight, inverse, np.sqrt(n)[:, None] * post)
                tab_of = b["tab"].to_numpy()[np.unique(inverse, return_index=True)[1]]
                for tab in dict.fromkeys(tab_of.tolist()):
                    u, i = np.nonzero((weight[:, :-1] > 1e-3) & (tab_of == tab)[:, None])
                    if not len(u):
                        continue
                    pair, first, _, begin = _grams([held.made[here[x]][y] for x, y in zip(u, i)])
                    each = np.repeat(weight[u, i], np.diff(np.append(begin, len(pair))))
                    sums = pairs.setdefault(tab, np.zeros(BUCKETS + 4096))
                    sums[:BUCKETS] += np.bincount(pair, weights=each, minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(first, weights=each, minlength=4096)
                    sums[BUCKETS + 3] += weight[u, i].sum()
                code, keys = pd.factorize(pd.MultiIndex.from_arrays([b["tab"], b["src"]]))
                per = np.zeros((len(keys), K))
                np.add.at(per, code, n[:, None] * post)
                for k, v in zip(keys, per):
                    mixes[k] = mixes[k] + v if k in mixes else v
                if len(mixes) > 20_000:
                    yield told()
                    mixes.clear()
            if mixes:
                yield told()
            for tab, sums in pairs.items():
                i = np.flatnonzero(sums)
                yield pd.DataFrame({"tab": tab, "src": None, "i": i, "v": sums[i]})

        return run

    models: dict[str, Model] = {}
    mixes = None
    for r in range(rounds):
        given = words.withColumn("mix", F.lit(None).cast("array<double>")) if mixes is None else words.join(mixes[0], ["tab", "src"])
        sums = cut(given.mapInPandas(step(dict(models)), "tab string, src string, i int, v double").groupBy("tab", "src", "i").agg(F.sum("v").alias("v")))
        by_tab: dict[str, dict[int, float]] = defaultdict(dict)
        per_tab: dict[str, np.ndarray] = {}
        # Per field at most BUCKETS + 4096 counts and K of the mixture.
        for tab, pair, i, v in sums.groupBy("tab", F.col("src").isNull().alias("pair"), "i").agg(F.sum("v")).collect():
            if pair:
                by_tab[tab][i] = v
            else:
                per_tab.setdefault(tab, np.zeros(K))[i] = v
        models = {tab: Model(by_tab[tab]) for tab in per_tab}
        if r and per_tab:
            base = F.create_map(*[x for t, m in per_tab.items() for x in (F.lit(t), F.array(*map(F.lit, ((m + 0.5) / (m.sum() + 0.5 * K)).tolist())))])
            mix = sums.where("src is not null").groupBy("tab", "src").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"), F.sum("v").alias("all"))
            mix = mix.select("tab", "src", F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) + PRIOR_WORDS * base[F.col("tab")][i]) / (F.col("all") + PRIOR_WORDS)).alias("mix"))
            mixes = maybe_broadcast(cut(mix), 64 + 8 * K)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Words(models)
        for b in batches:
            tabs, texts = b["tab"].tolist(), b["text"].tolist()
            units = [UNIT.findall(t) if tab in models else [] for tab, t in zip(tabs, texts)]
            n = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            w = np.log(_mixtures(b["mix"].iloc[some]))
            n = n[some]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = held.at([tabs[r] for r in some for _ in units[r]], [u for r in some for u in units[r]])
            lik = held.chance[at]
            clean = lik[:, :1]
            # Under a chain a word is garbled by it or was spared; nothing is spared that has lost characters.
            score = np.add.reduceat(np.logaddexp(np.log(0.7) + lik, np.log(0.3) + clean), begin, axis=0) + w
            score[:, 0] = np.add.reduceat(clean[:, 0], begin) + w[:, 0]
            best = score.argmax(axis=1)
            # A chain only counts if some word is likelier garbled by it than clean.
            of = np.repeat(np.arange(len(some)), n)
            gain = lik[np.arange(len(of)), best[of]] + w[of, best[of]] > lik[:, 0] + w[of, 0]
            hit = (best > 0) & np.logical_or.reduceat(gain, begin)
            out = []
            for x in np.flatnonzero(hit):
                r, chain = some[x], int(best[x])
                text, fixed, pos, done = texts[r], [], 0, False
                for j, m in enumerate(UNIT.finditer(text), begin[x]):
                    to = held.made[at[j]][chain]
                    good = chain < K - 1 and to is not None and lik[j, chain] > lik[j, 0]
                    fixed += [text[pos : m.start()], to if good else m.group()]
                    pos, done = m.end(), done or good
                out.append((tabs[r], b["row_id"].iloc[r], NAMES[chain], "".join([*fixed, text[pos:]]) if done else None))
            if out:
                yield pd.DataFrame(out, columns=["tab", "row_id", "chain", "repaired"])

    given = rows.join(mixes[0], ["tab", "src"], "left") if mixes else rows.withColumn("mix", F.lit(None).cast("array<double>"))
    return given.select("tab", "row_id", "text", "mix").mapInPandas(judge, "tab string, row_id bigint, chain string, repaired string")


def restored_lossy(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired also for rows that lost characters, where exactly one known word has that shape.

    rows: (tab, row_id, text). Known are the words of rows that are not in found; lost characters stand for one each.
    """
    found = cut(found)
    good = rows.where(F.col("text").rlike(r"[^\x00-\x7f]")).join(found.select("tab", "row_id"), ["tab", "row_id"], "left_anti")
    word = F.explode(F.split("text", r"[^\p{L}\p{M}'\x{fffd}]+")).alias("word")
    shape = F.regexp_replace("word", r"[^\x00-\x7f]", "�").alias("shape")
    known = good.select("tab", word).where(F.col("word").rlike(r"[^\x00-\x7f]")).select("tab", shape, "word").groupBy("tab", "shape").agg(F.min("word").alias("word"), F.max("word").alias("other")).where("word = other")
    lossy = rows.join(found.where("chain = 'lossy'").select("tab", "row_id"), ["tab", "row_id"])
    parts = lossy.select("tab", "row_id", "text", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{M}'\x{fffd}]+"))).alias("shape")).where(F.col("shape").contains("�"))
    fixes = parts.join(known.select("tab", "shape", "word"), ["tab", "shape"], "left").groupBy("tab", "row_id", "text").agg(F.collect_list(F.struct("shape", "word")).alias("fixes"))
    mended = fixes.select("tab", "row_id", F.when(F.forall("fixes", lambda f: f["word"].isNotNull()), F.aggregate("fixes", F.col("text"), lambda t, f: F.replace(t, f["shape"], f["word"]))).alias("mended"))
    return found.join(mended, ["tab", "row_id"], "left").select("tab", "row_id", "chain", F.coalesce("repaired", "mended").alias("repaired"))
