"""A mix of documents in which each source has its target share of the tokens.

Documents belong to domains softly: one whose source is listed belongs to it, one without a source as far as a classifier
says.  Nonnegative document rates are fitted by distributed projected gradient so that the expected tokens per domain meet
the targets; then rates become whole numbers of copies.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import cut
from tramline.llm.sample import sampled

HASHED = 1 << 14
WORD = re.compile(r"\w+")
RUN = re.compile(r"\s+")


#: Probabilities below it are numerical noise and count as 0.
NIL = 1e-6
#: Texts from this length on are counted in pieces.
LONG = 100_000


def default_tokenizer() -> tuple[str, str]:
    """(file of ranks, pattern) of the public byte-level BPE on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_count(coder, text: str | None) -> int:
    """Tokens of the whole text.

    A long text is cut where a blank follows another character: there a token ends in any pattern whose tokens have blanks
    in front alone.  Of a long run of blanks all but the last, which may belong to the next word, are one piece.
    """
    if not text:
        return 0
    if len(text) < LONG:
        return len(coder.encode_ordinary(text))
    n, at = 0, 0
    for m in RUN.finditer(text):
        if m.start() - at >= LONG or m.end() - m.start() >= LONG:
            n += len(coder.encode_ordinary(text[at : m.start()])) if m.start() > at else 0
            at = m.start()
        if m.end() - m.start() >= LONG:
            end = m.end() - (m.end() < len(text))
            n += len(coder._encode_single_piece(text[at:end]))
            at = end
    return n + (len(coder.encode_ordinary(text[at:])) if at < len(text) else 0)


def with_tokens(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): the number of tokens of each document's whole text by a byte-level BPE.

    vocabulary is the file of its ranks, pattern what it splits words by; by default those of default_tokenizer().  Null
    texts have no tokens.
    """
    path, pattern = (vocabulary, pattern) if vocabulary and pattern else [given or own for given, own in zip((vocabulary, pattern), default_tokenizer())]
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.trim("source").alias("source"), "text").where("doc_id is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [token_count(coder, t) for t in b["text"]]})

    return rows.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def _features(text: str | None) -> np.ndarray:
    import zlib

    return np.fromiter({zlib.crc32(w.encode()) % HASHED for w in WORD.findall((text or "").lower())}, dtype=np.int64)


def fit_domains(rows: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax over `names` by hashed words, from (text, source) rows; averaged stochastic steps."""
    rng = np.random.default_rng(3)
    w, b = np.zeros((HASHED, len(names))), np.zeros(len(names))
    place = {n: i for i, n in enumerate(names)}
    data = [(_features(t), place[s]) for t, s in rows if s in place]
    for epoch in range(4):
        for i in rng.permutation(len(data)):
            f, y = data[i]
            z = w[f].sum(axis=0) / np.sqrt(len(f) + 1) + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = 0.3 / (1 + epoch)
            w[f] -= rate * p / np.sqrt(len(f) + 1)
            b -= 0.05 * rate * p
    return w, b


def domain_memberships(documents: DataFrame, targets: list[str], most_labelled: int = 4000, most_chars: int = 20_000_000, confident: float = 0.0) -> DataFrame:
    """(doc_id, p): the probability of each domain, in the order of targets and then '', for the documents without a source.

    The classifier is fitted on at most `most_labelled` documents with a source, of `most_chars` characters in all, chosen by
    a hash; sources that are not listed count as one further domain ''.  Domains without such a document have probability 0.
    With `confident` above 0, documents whose likeliest domain stays below it belong to '' alone; by default all count as far
    as they are likely to belong.
    """
    spark = documents.sparkSession
    names = [*targets, ""]
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.trim("source").alias("source"), "text").where("doc_id is not null")
    known = docs.where("source is not null and source != '' and text is not null")
    rows = sorted((r.text, r.source if r.source in targets else "") for r in sampled(known, ["doc_id"], most_labelled, F.length("text"), most_chars))
    w, b = fit_domains(rows, names)
    seen = np.array([n in {s for _, s in rows} for n in names])
    given = spark.sparkContext.broadcast((w.astype(np.float32), b, seen if seen.any() else seen | (np.arange(len(names)) == len(names) - 1)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, seen = given.value
        for x in batches:
            out = []
            for doc_id, text in zip(x["doc_id"], x["text"]):
                f = _features(text)
                z = w[f].sum(axis=0) / np.sqrt(len(f) + 1) + b
                p = np.where(seen, np.exp(z - z[seen].max()), 0.0)
                p /= p.sum()
                p = np.where(p >= NIL, p, 0.0)
                p /= p.sum()
                out.append((doc_id, [float(v) for v in (p if p[:-1].max(initial=0.0) >= confident else np.eye(len(p))[-1])]))
            yield pd.DataFrame(out, columns=["doc_id", "p"])

    return docs.where("source is null or source = ''").mapInPandas(judge, "doc_id bigint, p array<double>")


def fit_rates(groups: DataFrame, targets: dict[str, tuple[float, int]], total: float, rounds: int = 60, close: float = 1e-5) -> list[np.ndarray]:
    """The history of residuals from which each document's rate follows (see rate_of), by projected gradient for least squares.

    groups: (p array<double>, cap, tokens): documents of equal membership may come as one row.  A step moves a rate by how far
    the document's domains fall short of `total` times their share, then clips it to 0..cap; each step is one pass over
    groups, which returns one sum per domain.  It ends once every domain is within `close` of the total, which is far less
    than whole copies can keep to, or steps no longer change.
    """
    names = list(targets)
    want = np.array([targets[n][0] for n in names]) * total
    history: list[np.ndarray] = []
    for _ in range(rounds):
        def sums(batches: Iterator[pd.DataFrame], history=list(history)) -> Iterator[pd.DataFrame]:
            for b in batches:
                p = np.array(b["p"].tolist()).reshape(len(b), -1)[:, : len(want)]
                got = (rate_of(p, b["cap"].to_numpy(), history) * b["tokens"].to_numpy())[:, None] * p
                yield pd.DataFrame({"i": np.arange(len(want)), "v": got.sum(axis=0)})

        got = np.zeros(len(want))
        for r in groups.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r.i] = r.v
        if not history:
            size = np.zeros(len(want))
            for r in groups.select(F.posexplode("p").alias("i", "q"), "tokens").groupBy("i").agg(F.sum(F.col("q") * F.col("tokens")).alias("v")).collect():
                if r.i < len(want):
                    size[r.i] = r.v
        step = (want - got) / np.maximum(size, 1.0)
        history.append(step)
        if np.abs(want - got).max() <= close * total or len(history) > 1 and np.abs(history[-1] - history[-2]).max() < close:
            break
    return history


def rate_of(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps of history: membership times shortfall per token of the domain, clipped to what each may have."""
    rate = np.zeros(len(p))
    for step in history:
        rate = np.clip(rate + p @ step, 0, cap)
    return rate


def mixed_documents(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, total: float | None = None, buckets: int = 16, pattern: str | None = None, confident: float = 0.0) -> DataFrame:
    """(doc_id, source, tokens, p, copies): how often each document is used so that each source has its share of all tokens used.

    targets: source_name, target_share, max_repeats; shares are put to sum 1 over the sources that have text.  p says how far
    the document belongs to each source of domains() and, last, to none of them: wholly to its own source, if it has one,
    else as likely as domain_memberships() says; `confident` is explained there.  A source's tokens are those expected by p.
    total is the number of tokens wanted; by default the largest at which no source needs more than max_repeats copies of
    what belongs to it, so that every source that has text reaches its share.  With a larger total, sources too small for it
    stay at their cap, and mix_shares() shows how far they got.  Documents of sources that are not listed are not used
    (copies 0).  Copies are spread evenly over a source's documents in order of their size: whole parts of the rate for all,
    one more for as many as the rest asks, exactly to one document per source.  No document has more than max_repeats copies,
    of any row, of any source it may belong to; null and empty texts have none.
    """
    want = domains(targets)
    names = list(want)
    k = len(names)
    sized = cut(with_tokens(documents, vocabulary, pattern))
    soft = domain_memberships(documents, names, confident=confident)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.lit(None).cast("map<string,int>")
    at = F.coalesce(place[F.col("source")], F.lit(k))
    hard = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == at, 1.0).otherwise(0.0))
    has_source = "source is not null and source != ''"
    rows = sized.where(has_source).withColumn("p", hard).unionByName(sized.where(f"not coalesce({has_source}, false)").join(soft.groupBy("doc_id").agg(F.max("p").alias("p")), "doc_id").select(*sized.columns, "p"))
    caps = F.array(*[F.lit(float(want[n][1])) for n in names], F.lit(None).cast("double"))
    # A document may not be used oftener than the strictest of the sources it may well belong to allows.
    allowed = F.array_min(F.transform(F.filter(F.arrays_zip(F.col("p").alias("p"), caps.alias("c")), lambda x: (x["p"] >= 0.05) & x["c"].isNotNull()), lambda x: x["c"]))
    rows = cut(rows.select("doc_id", "source", "tokens", "p", F.when(F.col("tokens") > 0, F.coalesce(allowed, F.lit(0.0))).otherwise(0.0).alias("cap")))
    groups = cut(rows.where("cap > 0").groupBy("p", "cap").agg(F.sum("tokens").cast("double").alias("tokens")))
    room = {r.i: r.v for r in groups.select(F.posexplode("p").alias("i", "q"), "cap", "tokens").groupBy("i").agg(F.sum(F.col("q") * F.col("cap") * F.col("tokens")).alias("v")).collect()}
    there = {n: want[n] for i, n in enumerate(names) if room.get(i, 0) > 0 and want[n][0] > 0}
    whole = sum(s for s, _ in there.values())
    if not there:
        return rows.select("doc_id", "source", "tokens", "p", F.lit(0).alias("copies"))
    shares = {n: (want[n][0] / whole if n in there else 0.0, want[n][1]) for n in names}
    size = total or min(room[i] / shares[n][0] for i, n in enumerate(names) if n in there)
    history = fit_rates(groups, shares, size)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.array(b["p"].tolist()).reshape(len(b), -1)[:, :k]
            yield b.assign(rate=rate_of(p, b["cap"].to_numpy(), history))

    # Rates of whole members go by their source; only documents without one are worked out one by one.
    own = rate_of(np.eye(k), np.array([float(want[n][1]) for n in names]), history)
    by_source = F.element_at(F.array(*map(F.lit, own.tolist()), F.lit(0.0)), F.array_position("p", F.lit(1.0)).cast("int"))
    sure = F.array_max("p") == 1.0
    rated = rows.where(sure).withColumn("rate", F.when(F.col("cap") > 0, by_source).otherwise(0.0))
    rated = rated.unionByName(rows.where(~sure).mapInPandas(rates, "doc_id bigint, source string, tokens bigint, p array<double>, cap double, rate double"))
    main = F.array_position("p", F.array_max("p"))
    rated = rated.select("doc_id", "source", "tokens", "p", "cap", "rate", main.alias("domain"), F.floor(F.log2(F.greatest("tokens", F.lit(1))) * 16).cast("int").alias("size"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).alias("bucket"), F.xxhash64("doc_id", F.lit(2)).alias("h"))
    # One more copy for every whole step of the running sum of the rates' parts, along the documents' size: so the documents
    # chosen have the sizes of all. The sum runs inside buckets of like size, from what the buckets before them had.
    rated = rated.withColumn("part", F.col("rate") - F.floor("rate"))
    before = rated.groupBy("domain", "size", "bucket").agg(F.sum("part").alias("s")).withColumn("past", F.sum("s").over(W.partitionBy("domain").orderBy("size", "bucket")) - F.col("s")).select("domain", "size", "bucket", "past")
    run = F.sum("part").over(W.partitionBy("domain", "size", "bucket").orderBy("tokens", "h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    spread = rated.join(F.broadcast(before), ["domain", "size", "bucket"]).withColumn("upto", F.col("past") + run)
    extra = F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("part") + 1e-9)
    return spread.select("doc_id", "source", "tokens", "p", F.least(F.floor("rate") + extra, F.col("cap")).cast("int").alias("copies"))


def domains(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source name -> (target share, most copies), in order of the names; a table of targets is small by its nature."""
    rows = targets.select("source_name", "target_share", "max_repeats").collect()
    got = {r.source_name.strip(): (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows if r.source_name and r.source_name.strip()}
    return dict(sorted(got.items()))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_name, target_share, share, tokens_used, documents_used, most_copies) per listed source, and '' for other text that is used.

    A document without a source counts for each source as far as it belongs to it; documents_used and most_copies are those
    of the documents that chiefly belong to it.
    """
    want = domains(targets)
    names = F.array(*map(F.lit, [*want, ""]))
    chief = F.array_position("p", F.array_max("p")) - 1
    each = mixed.where("copies > 0").select(F.posexplode("p").alias("i", "q"), "tokens", "copies", chief.alias("chief")).where("q > 0")
    mine = F.col("i") == F.col("chief")
    used = each.groupBy("i").agg(F.sum(F.col("q") * F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count_if(mine).alias("documents_used"), F.max(F.when(mine, F.col("copies"))).alias("most_copies"))
    used = used.select(names[F.col("i")].alias("source_name"), "tokens_used", "documents_used", "most_copies")
    listed = mixed.sparkSession.createDataFrame([(n, s) for n, (s, _) in want.items()], "source_name string, target_share double")
    every = used.join(listed, "source_name", "full").fillna(0)
    return every.crossJoin(F.broadcast(every.agg(F.sum("tokens_used").alias("all")))).select("source_name", "target_share", F.round(F.col("tokens_used") / F.greatest("all", F.lit(1.0)), 6).alias("share"), F.round("tokens_used").cast("bigint").alias("tokens_used"), "documents_used", "most_copies")
